"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that one of them differs in at most one
bit. That segment is then equal in one of its halves, and in the other half after
one position is made a wildcard. The equal half is the shuffle key; the wildcard
variants of the other half are indexed inside the task by sorting, rows with equal
variants are joined and the whole fingerprints compared. Only distinct
fingerprints are indexed, so copies cost nothing.

For a similarity of shingle sets wider fingerprints only bring candidates together (see
``similar_sets``): every pair that links has its two sets compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from . import similar_sets
from .common import batches_of, whole_text
from .components import components
from .hamming import bytes_of, distances, forest

SEED = 42
# Shingles hashed at a time, which bounds the memory of a very long text.
HASH_BLOCK = 1 << 14
# Fingerprints with one segment value that are compared in one task; more are linked by shared midpoints.
PAIRED_MEMBERS = 20_000
# Runs up to this length are compared all at once with their neighbours in the sort order.
SHORT_RUN = 32
# Rows of whole shuffle keys that a task gathers before it compares them.
FLUSH_ROWS = 50_000


@dataclass(frozen=True)
class Cut:
    """How 64-bit fingerprints are cut and compared."""

    segments: tuple[tuple[int, int], ...]  # (first bit from the left, width)
    distance: int  # bits in which linked fingerprints may differ


def exact_cut(distance: int) -> Cut:
    """``distance // 2 + 1`` segments, one of which differs in at most one bit: no pair is missed."""
    count = distance // 2 + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return Cut(tuple((a, b - a) for a, b in zip(cuts, cuts[1:])), distance)


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of all word shingles, in blocks; nothing without words.

    Words are runs of bytes other than white space (space, tab to carriage
    return) after lower-casing A-Z. A text of fewer words is one shingle.
    """
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(tokens)) - 1:].tolist()
    for block in range(0, n, HASH_BLOCK):
        pieces = map(joined.__getitem__, map(slice, first[block:block + HASH_BLOCK], last[block:block + HASH_BLOCK]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), dtype=np.uint64)


def majority(blocks: Iterable[np.ndarray], words: int = 1) -> bytes:
    """Majority bits, first word first, of hashes; zeros without any.

    The first 64 bits come from the hash itself, further ones from mixing it.
    """
    n, ones = 0, np.zeros(64 * words, dtype=np.int64)
    for hashes in blocks:
        n += len(hashes)
        wide = np.empty((len(hashes), words), dtype=">u8")
        wide[:, 0] = hashes
        for i in range(1, words):
            mixed = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
            wide[:, i] = mixed ^ (mixed >> np.uint64(27))
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: str, shingle: int, words: int = 1) -> bytes:
    """Majority bits of the hashes of all word shingles, repeats included; zeros without words."""
    return majority(shingle_hashes(text, shingle), words)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, fp`` (8 bytes) for every row."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("t"))
    return rows.mapInArrow(of_batches, "id long, fp binary")


def _values(matrix: np.ndarray, low: int, width: int) -> np.ndarray:
    """Bits ``low .. low + width`` of every row as a number."""
    first, last = low // 8, (low + width + 7) // 8
    bits = np.unpackbits(matrix[:, first:last], axis=1)[:, low - 8 * first:low - 8 * first + width]
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64))


def _keyed(nodes: DataFrame, cut: Cut, halves: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``segment, half, part, value, node, fp``: two rows per segment, one for either half being equal."""
    schema = pa.schema([("segment", pa.int32()), ("half", pa.int32()), ("part", pa.int64()), ("value", pa.int64()),
                        ("node", pa.int64()), ("fp", pa.binary())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp = batch.column(0), batch.column(1)
            if not batch.num_rows:
                continue
            matrix = bytes_of(fp, 8)
            for i, (low, width) in enumerate(cut.segments):
                value = _values(matrix, low, width)
                right = width // 2
                for half in halves:
                    part = value & ((1 << right) - 1) if half else value >> right
                    same = np.full(len(value), i), np.full(len(value), half)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(same[0], pa.int32()), pa.array(same[1], pa.int32()), pa.array(part),
                         pa.array(value), node, fp], schema=schema)

    return nodes.select("node", "fp").mapInArrow(
        of_batches, "segment int, half int, part long, value long, node long, fp binary")


def _linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links within each run of equal keys; rows are sorted by key."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    lengths = np.diff(np.append(starts, len(keys)))
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, min(SHORT_RUN, int(lengths.max()))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        at = at[distances(fps[at], fps[at + step]) <= distance]
        left.append(at)
        right.append(at + step)
    for start, length in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
        a, b = forest(fps[start:start + length], distance)
        left.append(start + np.array(a, dtype=np.int64))
        right.append(start + np.array(b, dtype=np.int64))
    return np.concatenate(left), np.concatenate(right)


def _bucket_links(keyed: DataFrame, cut: Cut) -> DataFrame:
    """``a, b``: links between rows that share a segment half and a wildcard variant of the other half.

    They are all pairs in short runs, and in long ones as many as connect what all pairs do.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    widths = [width for _, width in cut.segments]

    def compare(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        segment, half, part, value, node, fps = rows
        pairs = []
        group = np.cumsum(np.concatenate(
            ([0], (segment[1:] != segment[:-1]) | (half[1:] != half[:-1]) | (part[1:] != part[:-1]))))
        right = np.array([w // 2 for w in widths])[segment]
        other = np.where(half == 0, value & ((1 << right) - 1), value >> right)
        free = np.where(half == 0, right, np.array(widths)[segment] - right)
        for bit in range(int(free.max())):
            mine = np.flatnonzero(free > bit)
            keys = group[mine] << 40 | other[mine] & ~(1 << bit)
            order = np.argsort(keys, kind="stable")
            a, b = _linked(keys[order], fps[mine[order]], cut.distance)
            a, b = node[mine[order[a]]], node[mine[order[b]]]
            pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        yield from batches_of(schema, {"a": found[:, 0], "b": found[:, 1]})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.num_columns - 1
            rows = [batch.column(i).to_numpy() for i in range(last)]
            rows.append(bytes_of(batch.column(last), 8).view(np.uint64))
            held.append(rows)
            size += batch.num_rows
            if size >= FLUSH_ROWS:
                rows = [np.concatenate(c) for c in zip(*held)]
                changed = np.zeros(size, dtype=bool)
                for column in rows[:3]:
                    changed[1:] |= column[1:] != column[:-1]
                end = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
                if end:
                    # The last key may go on in the next batch.
                    yield from compare([c[:end] for c in rows])
                held, size = [[c[end:] for c in rows]], size - end
        if size:
            yield from compare([np.concatenate(c) for c in zip(*held)])

    key = ["segment", "half", "part"]
    keyed = keyed.select(*key, "value", "node", "fp")
    return keyed.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(link, "a long, b long")


def _midpoints(fp: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` (at most 2) bits of ``fp``."""
    masks = [0]
    if radius >= 1:
        masks += [1 << i for i in range(64)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.lit(signed), lambda mask: fp.bitwiseXOR(mask))


def _midpoint_links(members: DataFrame, distance: int) -> DataFrame:
    """``a, b`` links between 64-bit fingerprints (``node, head``) without comparing pairs.

    Two values are within ``distance`` bits exactly if a value lies within half
    of the distance, rounded up, of one and within half, rounded down, of the other.
    """
    if distance > 5:
        raise ValueError("midpoints are made for distances up to 5")
    around = members.select("node", F.explode(_midpoints(F.col("head"), distance // 2)).alias("point"))
    lowest = around.groupBy("point").agg(F.min("node").alias("b"))
    wider = around
    if distance % 2:
        bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
        point = F.col("point")
        wider = around.select("node", F.explode(F.array(point, *[point.bitwiseXOR(F.lit(b)) for b in bits])).alias("point"))
    return wider.join(lowest, "point").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def links(nodes: DataFrame, cut: Cut, paired: int = PAIRED_MEMBERS) -> DataFrame:
    """``a, b`` links over ``node, fp``: they connect what chains of pairs within the distance connect.

    A segment value that more than ``paired`` fingerprints share is not compared in
    one task: its members and those one bit away are linked by midpoints.
    """
    keyed = _keyed(nodes, cut)
    once = _keyed(nodes, cut, (0,))
    crowded = stored(once.groupBy("segment", "value").count().where(F.col("count") > paired).select("segment", "value"))
    if crowded.isEmpty():
        return _bucket_links(keyed, cut)
    widths = F.array(*[F.lit(width) for _, width in cut.segments])
    around = crowded.select("segment", F.col("value").alias("centre"), F.explode(F.expr(
        "transform(sequence(-1, 62), b -> if(b < 0, value, value ^ shiftleft(1L, b)))")).alias("value"), widths.alias("w"))
    around = around.where(F.expr("value < shiftleft(1L, w[segment])")).select("segment", "centre", "value")
    usual = _bucket_links(keyed.join(crowded, ["segment", "value"], "left_anti").select(keyed.columns), cut)
    head = F.conv(F.hex("fp"), 16, -10).cast("long")
    members = stored(once.join(around, ["segment", "value"], "left_semi").select("node", head.alias("head")).distinct())
    return usual.union(_midpoint_links(members, cut.distance))


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int | None = None, similarity: float = 0.8,
                    id_column: str = "doc_id", text_column: str = "text", paired: int = PAIRED_MEMBERS) -> DataFrame:
    """``id_column, fingerprint, component_id`` for every row of ``docs``.

    With ``distance`` rows link whose 64-bit fingerprints differ in at most so
    many bits, and no link is missed. Without it rows link whose shingle sets have
    a Jaccard similarity of ``similarity`` or more; wider fingerprints bring them
    together and the sets decide (see ``similar_sets``). ``fingerprint`` is
    lower-case hex; ``component_id`` is the smallest id that links reach. Null and
    empty texts have fingerprint 0, which links like any other, and equal (empty) sets. Rows
    with a null id belong to components but never name one; a component of null
    ids only has a null id. Repeated rows give repeated rows. Other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    if distance is None:
        rows = similar_sets.labelled(docs, shingle, similarity, paired, id_column, text_column)
        return rows.select(F.col("id").alias(id_column), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
    rows = stored(fingerprints(docs, shingle, id_column, text_column))
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    found = components(stored(links(nodes, exact_cut(distance), paired)))
    named = nodes.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(named.join(names, "root").select("fp", "component_id"))
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_column), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_column: str = "doc_id",
                text_column: str = "text", paired: int = PAIRED_MEMBERS) -> DataFrame:
    """The rows of ``docs`` whose id names their component of similar texts, with all their columns.

    A row goes if its id is not the smallest of its component; another row of the same id and another
    text stays if it names a component of its own. Rows with a null id stay, and so do all rows of a component that have the
    naming id. Null and empty texts are alike. An empty table gives no rows; other columns, whatever their names, pass unread.
    """
    found = similar_sets.labelled(docs, shingle, similarity, paired, id_column, text_column)
    dropped = stored(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("_id"), F.col("key").alias("_key")).distinct())
    key = F.unhex(F.sha2(F.encode(whole_text(text_column), "utf-8"), 256))
    return docs.join(dropped, (F.col(id_column).cast("long") == F.col("_id")) & (key == F.col("_key")), "left_anti")
