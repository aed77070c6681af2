"""Near-duplicates by the Jaccard similarity of shingle sets, brought together by SimHash.

Fingerprints of a fixed 512 bits only bring rows together; the sets decide. A fingerprint
is read in 40 segments of 18 bits, so few bits that one segment of two similar sets
differs in at most one. Such a segment is equal in one half, which is the shuffle key, and in the
other half after one bit is made a wildcard; inside the task rows are sorted by each
variant and equal ones are compared by a sketch of 128 bits. What is shuffled for a row is the
same at every table size: 80 keys with 26 bytes each, packed by key.

Rows that candidate pairs connect are a cluster. A task passes on enough links to connect a
cluster, never its pairs. Sets are only made, and moved, for rows of a cluster, from a second look at the
texts; they meet inside a task, which again passes on no more links than connect what is similar.

How a pair at similarity s fares: its sets have cosine 2s / (1 + s), a bit differs with p =
acos(cosine) / pi, and a segment differs in at most one of w bits with h = (1 - p)^w + w p (1 - p)^(w - 1);
k segments all fail with (1 - h)^k. At 0.8 that is 5e-5 at the expected distance and 4e-4 on
average over the distances that occur.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from .common import row_ids, whole_text
from .components import components, stars
from .hamming import bytes_of, distances, forest, group_links

WORDS = 8
WIDTH, SEGMENTS = 18, 40
HALF = WIDTH // 2
SKETCH_WORDS = 2
# Standard deviations over the expected distance up to which sketches, and fingerprints, are candidates.
SKETCH_DEVIATIONS, DEVIATIONS = 5, 6
# Fingerprints with one segment value that are compared in one task.
PAIRED_MEMBERS = 20_000
# Runs of equal variants up to this length are compared all at once with their neighbours in the sort order.
SHORT_RUN = 32
# Rows that are packed together, and rows of whole keys that a task gathers before it compares them.
PACKED_ROWS, FLUSH_ROWS = 16_384, 400_000
# Rows and bytes of the sets of a cluster that meet in one task; a larger cluster is dealt out, with so many rows in all parts.
CLUSTER_ROWS, CLUSTER_BYTES, PIVOTS = 5_000, 64 << 20, 32
# Rows outside of a cluster's largest family that meet a part of the others at a time.
GUESTS = 500
# Bits of the filter of rows whose sets are wanted, at most; the join decides.
FILTER_BITS = 1 << 26

# The bits of each segment: neighbours in shuffled orders of all bits.
_RNG = np.random.default_rng(512)
BITS = np.concatenate([_RNG.permutation(64 * WORDS) for _ in range(-(-SEGMENTS * WIDTH // (64 * WORDS)))])[
    :SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)

PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mark", pa.bool_())])
PAIRS_SQL = "a long, b long, mark boolean"


def differing(similarity: float) -> float:
    """The probability that a fingerprint bit of two sets of this similarity differs."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit(similarity: float, words: int, deviations: float) -> int:
    """The distance of ``words`` 64-bit words up to which two rows are candidates."""
    p, bits = differing(similarity), 64 * words
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def missed(similarity: float, distance: int | None = None) -> float:
    """The share of pairs of this similarity that share no segment, at the expected or the given distance."""
    p = differing(similarity) if distance is None else distance / (64 * WORDS)
    return (1 - (1 - p) ** WIDTH - WIDTH * p * (1 - p) ** (WIDTH - 1)) ** SEGMENTS


def segment_values(fps: np.ndarray) -> np.ndarray:
    """The value of every segment (columns) of every fingerprint, given as rows of bytes."""
    bits = np.unpackbits(fps, axis=1).astype(np.int64)
    powers = np.int64(1) << np.arange(WIDTH - 1, -1, -1, dtype=np.int64)
    return np.stack([bits[:, places] @ powers for places in BITS], axis=1)


def _key(segment, half: int, part):
    return (segment * 2 + half) << HALF | part


# What is shuffled for a row and key: the row, the other half and the sketch.
ENTRY = np.dtype([("node", "<i8"), ("other", "<u2"), ("sketch", "<u8", SKETCH_WORDS)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Nodes and fingerprints (rows of bytes), ``PACKED_ROWS`` or more at a time."""
    held, size = [], 0

    def block() -> list[np.ndarray]:
        table = pa.Table.from_batches(held)
        return [table.column(0).to_numpy(), bytes_of(table.column(1), 8 * WORDS)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= PACKED_ROWS:
            yield block()
            held, size = [], 0
    if size:
        yield block()


def packed(nodes: DataFrame, crowded: np.ndarray | None = None) -> DataFrame:
    """``key, entries``: for every key of every row of ``nodes`` (``node, fp``) an entry, those of many rows in one value.

    Entries of values that ``crowded`` holds (true, by segment and value) are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, fps in _blocks(batches):
            values, n = segment_values(fps), len(node)
            keys = np.empty((SEGMENTS, 2, n), dtype=np.int32)
            entries = np.empty((SEGMENTS, 2, n), dtype=ENTRY)
            entries["node"] = node
            entries["sketch"] = np.ascontiguousarray(fps[:, :8 * SKETCH_WORDS]).view(np.uint64)
            segment = np.arange(SEGMENTS)[:, None]
            left, right = values.T >> HALF, values.T & ((1 << HALF) - 1)
            for half, (part, other) in enumerate(((left, right), (right, left))):
                keys[:, half], entries["other"][:, half] = _key(segment, half, part), other
            keys, entries = keys.reshape(-1), entries.reshape(-1)
            if crowded is not None:
                usual = np.repeat(~crowded[segment, values.T][:, None], 2, axis=1).reshape(-1)
                keys, entries = keys[usual], entries[usual]
            order = np.argsort(keys, kind="stable")
            keys, entries = keys[order], entries[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
            offsets = np.append(starts, len(keys)).astype(np.int64) * ENTRY.itemsize
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(entries.tobytes())])
            whole = pa.RecordBatch.from_arrays([pa.array(keys[starts]), data.cast(pa.binary())], names=["key", "entries"])
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

    return nodes.select("node", "fp").mapInArrow(pack, "key int, entries binary")


def _counts(nodes: DataFrame, heavy: np.ndarray | None) -> DataFrame:
    """``place, n``: rows by key, or, within the keys of first halves that ``heavy`` holds, by segment and value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = np.arange(SEGMENTS)
        for _, fps in _blocks(batches):
            values = segment_values(fps)
            first = _key(segment, 0, values >> HALF)
            if heavy is None:
                places = np.concatenate([first, _key(segment, 1, values & ((1 << HALF) - 1))])
            else:
                places = (segment << WIDTH | values)[heavy[first]]
            place, n = np.unique(places, return_counts=True)
            whole = pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["place", "n"])
            for at in range(0, whole.num_rows, 20_000):
                yield whole.slice(at, 20_000)

    return nodes.select("node", "fp").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def crowded_values(nodes: DataFrame, total: int, paired: int) -> np.ndarray | None:
    """Whether more than ``paired`` rows share a value, by segment and value; null if there is none.

    Only keys that hold far more rows than the others are looked into. What reaches the driver is
    bounded by the number of keys and values, which does not depend on the table.
    """
    most = paired + 2 * total // (1 << HALF)
    found = _counts(nodes, None).where(F.col("n") > most).select("place").toArrow()["place"].to_numpy()
    if not len(found):
        return None
    heavy = np.zeros(2 * SEGMENTS << HALF, dtype=bool)
    heavy[found] = True
    found = _counts(nodes, heavy).where(F.col("n") > paired).select("place").toArrow()["place"].to_numpy()
    if not len(found):
        return None
    crowded = np.zeros(SEGMENTS << WIDTH, dtype=bool)
    crowded[found] = True
    return crowded.reshape(SEGMENTS, 1 << WIDTH)


def _members(nodes: DataFrame, crowded: np.ndarray) -> DataFrame:
    """``g, node, fp``: for every crowded value the rows that have it or one a bit away."""
    bits = np.packbits(crowded)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(bits)[:SEGMENTS << WIDTH].astype(bool)
        around = np.array([0, *(1 << np.arange(WIDTH))])
        for node, fps in _blocks(batches):
            values = segment_values(fps)
            for start in range(0, len(node), 1024):
                # A place of the crowd, for every row, segment and bit that may be flipped.
                places = (np.arange(SEGMENTS)[:, None] << WIDTH) | (values[start:start + 1024, :, None] ^ around)
                row, segment, flip = np.nonzero(full[places])
                g, row = places[row, segment, flip], row + start
                for at in range(0, len(g), 20_000):
                    part = row[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[at:at + 20_000]), pa.array(node[part]), pa.array([f.tobytes() for f in fps[part]], pa.binary())],
                        names=["g", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(gather, "g long, node long, fp binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return starts, np.diff(np.append(starts, len(keys)))


def _linked(keys: np.ndarray, node: np.ndarray, sketch: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
    """``a, b, tree``: what pairs within runs of equal keys connect, each as a link to its first row, and whether it is more than a pair."""
    starts, lengths = _runs(keys)
    short = np.repeat(lengths <= SHORT_RUN, lengths)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for step in range(1, min(SHORT_RUN, int(lengths.max()))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & short[step:])
        at = at[distances(sketch[at], sketch[at + step]) <= distance]
        left.append(at)
        right.append(at + step)
    for start, length in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
        a, b = forest(sketch[start:start + length], distance)
        left.append(start + np.array(a, dtype=np.int64))
        right.append(start + np.array(b, dtype=np.int64))
    # Rows stand in one run each, so what links connect lies in one run.
    root, member = stars(np.concatenate(left), np.concatenate(right)).T
    return node[root], node[member], np.bincount(root, minlength=len(keys))[root] > 1


def _bucket_links(entries: DataFrame, distance: int) -> DataFrame:
    """``a, b, mark``: links between the rows that share a key and a variant of the other half (see ``_linked``).

    What trees of three or more connect in a task is passed on as stars (mark true).
    """

    def compare(key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = key.astype(np.int64) << HALF | rows["other"]
        node, sketch = np.ascontiguousarray(rows["node"]), np.ascontiguousarray(rows["sketch"])
        held = []
        for bit in range(HALF):
            keys = base & ~(1 << bit)
            order = np.lexsort((node, keys))
            held.append(_linked(keys[order], node[order], sketch[order], distance))
        a, b, tree = (np.concatenate(c) for c in zip(*held))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[~tree], axis=0)
        for mark, links in ((False, pairs), (True, stars(a[tree], b[tree]))):
            for at in range(0, len(links), 20_000):
                part = links[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[:, 0]), pa.array(part[:, 1]), pa.array(np.full(len(part), mark))], schema=PAIRS)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, size = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Keys come in order, so what is held is whole once another key begins.
                if size >= FLUSH_ROWS and key != keys[-1]:
                    yield from flush(keys, values)
                    keys, values, size = [], [], 0
                keys.append(key)
                values.append(np.frombuffer(value.as_buffer(), dtype=ENTRY))
                size += len(values[-1])
        if size:
            yield from flush(keys, values)

    def flush(keys: list[int], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield from compare(np.repeat(np.array(keys), list(map(len, values))), np.concatenate(values))

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(link, PAIRS_SQL)


def links(nodes: DataFrame, similarity: float, paired: int = PAIRED_MEMBERS) -> DataFrame:
    """``a, b, mark`` over ``node, fp``: candidate pairs (mark false), and links that connect what more candidate pairs do.

    A segment value that more than ``paired`` rows share is not compared in one task:
    its rows and those one bit away are a group of their own (see ``group_links``).
    """
    crowded = crowded_values(nodes, nodes.count(), paired)
    usual = _bucket_links(packed(nodes, crowded), limit(similarity, SKETCH_WORDS, SKETCH_DEVIATIONS))
    if crowded is None:
        return usual
    members = stored(_members(nodes, crowded))
    found = group_links(members, limit(similarity, WORDS, DEVIATIONS), WORDS, paired)
    return usual.union(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True)))


def near(pairs: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """The pairs ``a, b`` whose whole fingerprints differ in at most ``distance`` bits."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some, others = (bytes_of(batch.column(i), 8 * WORDS).view(np.uint64) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                    pa.array(distances(some, others) <= distance))

    left, right = (nodes.select(F.col("node").alias(n), F.col("fp").alias(f"{n}_fp")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_fp", "b_fp").mapInArrow(compare, "a long, b long")


class _Sets:
    """Sets of hashes, indexed by the hashes that several of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        every = np.concatenate([np.zeros(0, dtype="<u8"), *sets])
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner = every[order], owner[order]
        self.starts = np.flatnonzero(np.append(True, self.hashes[1:] != self.hashes[:-1])[:len(every)])
        self.counts = np.diff(np.append(self.starts, len(every)))
        self.names = self.hashes[self.starts]

    def alike(self, one: np.ndarray, similarity: float) -> np.ndarray:
        """Whether each set has a Jaccard similarity of ``similarity`` or more with ``one``; two empty sets are equal."""
        at = np.searchsorted(self.names, one)
        at = at[at < len(self.names)] if not len(self.names) else at[self.names[np.minimum(at, len(self.names) - 1)] == one]
        counts = self.counts[at]
        places = np.arange(counts.sum()) + np.repeat(self.starts[at] - np.cumsum(counts) + counts, counts)
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        every = self.sizes + len(one) - both
        return (every == 0) | (both / np.maximum(every, 1) >= similarity)


def _forest(sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Links that connect the same sets as all pairs of ``similarity`` or more do."""
    index, todo = _Sets(sets), np.ones(len(sets), dtype=bool)
    for first in range(len(sets)):
        queue = [first] if todo[first] else []
        todo[first] = False
        while queue and todo.any():
            at = queue.pop()
            found = np.flatnonzero(todo & index.alike(sets[at], similarity)).tolist()
            todo[found] = False
            queue.extend(found)
            for other in found:
                yield at, other


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), dtype="<u8") for chunk in getattr(column, "chunks", [column]) for value in chunk]


def _group_forests(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links that connect what is similar among the rows ``g, salt, node, hashes`` of each (g, salt)."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for g, salt, node, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), _sets(batch.column(3))):
                if (g, salt) != key:
                    out += linked(held)
                    held, key = {}, (g, salt)
                held[node] = hashes
            yield passed(out)
        yield passed(linked(held))

    def linked(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        names = list(held)
        return [(names[i], names[j]) for i, j in _forest(list(held.values()), similarity)] if len(names) > 1 else []

    def passed(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([l[i] for l in out], pa.int64()) for i in (0, 1)], schema=LINKS)

    key = ["g", "salt"]
    return (rows.select(*key, "node", "hashes").repartition(*key).sortWithinPartitions(*key, "node")
            .mapInArrow(connect, "a long, b long"))


def _meetings(members: DataFrame, similarity: float, chunk_rows: int) -> DataFrame:
    """``a, b``: links between families over ``g, node, hashes, family``, as many as connect what all similar pairs do.

    One of such a pair is outside of the group's largest family. Those rows meet all of the group, in blocks.
    """

    def compare(part: pa.Table, visiting: pa.Table) -> pa.Table:
        if not part.num_rows or not visiting.num_rows:
            return LINKS.empty_table()
        index, names, families = _Sets(_sets(part["hashes"])), part["node"].to_numpy(), part["family"].to_numpy()
        out, joined = [], set()
        for node, own, one in zip(visiting["node"].to_pylist(), visiting["family"].to_pylist(), _sets(visiting["hashes"])):
            at = np.flatnonzero(index.alike(one, similarity) & (families != own))
            for family, place in zip(*np.unique(families[at], return_index=True)):
                if (pair := (min(own, family), max(own, family))) not in joined:
                    joined.add(pair)
                    out.append((node, int(names[at[place]])))
        return pa.table([pa.array([l[i] for l in out], pa.int64()) for i in (0, 1)], schema=LINKS)

    counted = members.groupBy("g", "family").agg(F.count("*").alias("n")).groupBy("g").agg(
        F.max_by("family", F.struct("n", "family")).alias("largest"), F.sum("n").alias("every"), F.max("n").alias("most"))
    sizes = stored(counted.where("most < every").select(
        "g", "largest", F.ceil(F.col("every") / F.lit(chunk_rows)).alias("homes"),
        F.ceil((F.col("every") - F.col("most")) / F.lit(GUESTS)).alias("guests")))
    dealt = lambda n: F.pmod(F.xxhash64("node"), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1).cast("array<long>"))
    rows, columns = members.join(sizes, "g"), ["g", "node", "hashes", "family"]
    left = rows.select(*columns, dealt(F.col("homes")).alias("i"), spread(F.col("guests")).alias("j"))
    again = [F.col(c).alias(c) for c in columns]  # names of their own in the plan
    right = rows.where("family <> largest").select(*again, dealt(F.col("guests")).alias("j"), spread(F.col("homes")).alias("i"))
    key = ["g", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")


def set_links(members: DataFrame, similarity: float, chunk_rows: int = CLUSTER_ROWS, chunk_bytes: int = CLUSTER_BYTES) -> DataFrame:
    """``a, b`` links over ``g, node, hashes``: within each group they connect what all pairs of ``similarity`` or more do.

    A group of up to ``chunk_rows`` rows and ``chunk_bytes`` meets in one task. A larger one is dealt out in
    parts, all of which hold the same few pivots, and what is left apart of its largest family then meets every part.
    """
    size = F.greatest(F.ceil(F.count("*") / F.lit(chunk_rows)), F.ceil(F.sum(F.length("hashes")) / F.lit(chunk_bytes)), F.lit(1).cast("long"))
    sizes = stored(members.groupBy("g").agg(size.alias("chunks"), F.count("*").alias("n")).where("n > 1"))
    dealt = members.join(sizes, "g")
    parts = dealt.select("g", F.pmod(F.xxhash64("node"), "chunks").alias("salt"), "node", "hashes")
    if sizes.where("chunks > 1").isEmpty():
        return _group_forests(parts, similarity)
    pivots = dealt.where((F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(5)), "n") < PIVOTS)).select(
        "g", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1).cast("array<long>")).alias("salt"), "node", "hashes")
    found = stored(_group_forests(parts.unionByName(pivots), similarity))
    large = dealt.where("chunks > 1").join(components(found), "node", "left").select(
        "g", "node", "hashes", F.coalesce("component", "node").alias("family"))
    return found.union(_meetings(stored(large), similarity, chunk_rows))


def _keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, key, t``: the digest of every whole text with it."""
    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("key"), text.alias("t"))


def fingerprinted(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """``id, key, digest, fp`` for every row: digests of its text and of its set of shingles, and the set's fingerprint.

    A shingle counts once however often it is repeated.
    """
    from .simhash import HASH_BLOCK, majority, shingle_set

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps = [], []
            for text in batch.column(2):
                hashes = shingle_set(text.as_py(), shingle)
                digests.append(hashlib.sha256(hashes.astype("<u8").tobytes()).digest())
                fps.append(majority(np.split(hashes, range(HASH_BLOCK, len(hashes), HASH_BLOCK)), WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())],
                names=["id", "key", "digest", "fp"])

    return _keyed_texts(docs, id_column, text_column).mapInArrow(of_batches, "id long, key binary, digest binary, fp binary")


def _slots(keys: pa.Array, size: int) -> np.ndarray:
    return (bytes_of(keys, 32)[:, :8].copy().view(np.uint64)[:, 0] % np.uint64(size)).astype(np.int64)


def _key_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A bit for the slot of every ``key``: at most ``FILTER_BITS`` of them, whatever their number."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (16 * count).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, at = np.unique(_slots(batch.column(0), size) >> 6, return_inverse=True)
                words = np.zeros(len(place), dtype=np.uint64)
                np.bitwise_or.at(words, at, np.uint64(1) << (_slots(batch.column(0), size) & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words.view(np.int64))], names=["place", "word"])

    found = keys.select("key").mapInArrow(slots, "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(size >> 6, dtype=np.int64)
    words[found["place"].to_numpy()] = found["word"].to_numpy()
    return words


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """``node, hashes`` for the rows of ``docs`` whose text has a ``key`` in ``wanted`` (``node, key``, no key twice).

    A filter of bounded size spares most other texts the work and the shuffle; the join leaves the wanted ones.
    """
    from .simhash import shingle_set

    words = _key_filter(wanted, wanted.count())

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = _slots(batch.column(0), 64 * len(words))
            hit = np.flatnonzero(words.view(np.uint64)[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1))
            # Copies inside a batch are passed on once.
            once = {batch.column(0)[i].as_py(): i for i in hit.tolist()}
            held = [shingle_set(batch.column(1)[i].as_py(), shingle).astype("<u8").tobytes() for i in once.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(once), pa.binary()), pa.array(held, pa.binary())], names=["key", "hashes"])

    found = _keyed_texts(docs, id_column, text_column).select("key", "t").mapInArrow(of_batches, "key binary, hashes binary")
    return found.join(wanted, "key").groupBy("node").agg(F.first("hashes").alias("hashes"))


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float, paired: int, id_column: str,
                  text_column: str) -> DataFrame:
    """``a, b`` links over ``node, key, fp`` that connect what all candidate pairs with ``similarity`` or more connect."""
    found = stored(links(nodes.select("node", "fp"), similarity, paired).distinct())
    pairs = near(found.where("not mark").select("a", "b"), nodes, limit(similarity, WORDS, DEVIATIONS))
    clusters = components(stored(pairs.union(found.where("mark").select("a", "b")))).withColumnRenamed("component", "g")
    clusters = stored(clusters.join(nodes.select("node", "key"), "node"))
    sets = sets_of(docs, clusters.select("node", "key"), shingle, id_column, text_column)
    return stored(set_links(stored(sets.join(clusters.select("node", "g"), "node")), similarity, min(CLUSTER_ROWS, paired)))


def labelled(docs: DataFrame, shingle: int, similarity: float, paired: int = PAIRED_MEMBERS, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``id, key, fp, component_id`` for every row of ``docs``; ``key`` is the SHA-256 of its text.

    See ``simhash.near_duplicates`` for what the columns hold in odd cases.
    """
    rows = stored(fingerprinted(docs, shingle, id_column, text_column))
    # Equal sets are one node; the text of one of them stands for all.
    nodes = stored(rows.groupBy("digest", "fp").agg(F.min("id").alias("least"), F.min("key").alias("key"))
                   .withColumn("node", F.monotonically_increasing_id()))
    found = components(similar_links(docs, nodes, shingle, similarity, paired, id_column, text_column))
    named = nodes.join(found, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = stored(named.join(names, "root").select("digest", "component_id"))
    return rows.join(labels, "digest").select("id", "key", "fp", "component_id")
