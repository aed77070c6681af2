"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Every scan task tokenises its documents, cuts the long ones and packs its pieces
by best fit decreasing. Dual feasible functions of the piece lengths give a lower
bound on the sequences any packing needs; a partition that meets its bound is
certified: its sequences are final but for the emptiest, which holds all that another
partition could save. While the whole table is above its bound, the documents of sequences with gaps are
exchanged and best fit runs again on the mixed groups, which are certified in the same way, until
a round saves nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from .common import whole_text

CAPACITY = 1024
END_ID = 2
# Pieces that a task packs together; a larger partition is packed in several runs.
RUN_PIECES = 200_000
# Pieces that one task packs again after an exchange.
EXCHANGE_PIECES = 200_000

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, "
          "room long, open boolean, ids array<int>")


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to token ids, equal to the tokenizer file's own.

    The file's vocabulary and pattern run in the faster of the two installed
    byte-level BPE engines; a text that engine refuses goes to the other. Strings of special
    tokens inside a text are ordinary text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # Byte-level files write every byte as a printable character.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items()
             if all(c in byte_of for c in token) and not token.startswith("<|")}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:
            return np.asarray(reference.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every length, and the room left in every bin, by best fit decreasing.

    Bins are held by their room, with a bit set for each room in use, so placing a
    piece takes constant time.
    """
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets, room = [0] * len(lengths), [0] * len(lengths), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use = 0
    for item in order:
        length = lengths[item]
        fitting = in_use >> length
        if fitting:
            gap = length + (fitting & -fitting).bit_length() - 1
            chosen = with_room[gap].pop()
            if not with_room[gap]:
                in_use ^= 1 << gap
        else:
            chosen, gap = len(room), capacity
            room.append(capacity)
        bins[item], offsets[item] = chosen, capacity - gap
        left = gap - length
        room[chosen] = left
        if left:
            with_room[left].append(chosen)
            in_use |= 1 << left
    return bins, offsets, room


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs; ``histogram[n]`` pieces have length n.

    The best of two families of dual feasible functions: one rounds lengths up to
    the capacity or down to nothing beyond a threshold, the other maps x to
    floor((k + 1) x) / k where (k + 1) x is not whole.
    """
    counts = histogram.astype(object)
    lengths = np.arange(capacity + 1)
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    ahead = np.cumsum(histogram[::-1])[::-1]
    weights = np.cumsum(histogram * lengths)
    for threshold in range(1, capacity // 2 + 1):
        large = int(ahead[capacity - threshold + 1])
        middle = int(weights[capacity - threshold] - weights[threshold - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 101):
        scaled = lengths * (k + 1)
        whole = scaled % capacity == 0
        # In units of 1 / (k * capacity): x itself where whole, else the rounded value.
        value = np.where(whole, lengths * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def _pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and room per piece, and whether its bin may still change: it has room, and if
    the bin count meets its lower bound it is the emptiest."""
    if not len(lengths):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    bins, offsets, rooms = best_fit(lengths.tolist(), capacity)
    bins, rooms = np.array(bins, dtype=np.int64), np.array(rooms, dtype=np.int64)
    may_change = rooms > 0
    if len(rooms) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
        may_change &= np.arange(len(rooms)) == np.argmax(rooms)
    return bins, np.array(offsets, dtype=np.int64), rooms[bins], may_change[bins]


def first_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                  keep_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents, packed within each scan task."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("room", pa.int64()),
        ("open", pa.bool_()), ("ids", pa.list_(pa.int32()))])

    def emit(rows: list[tuple], run: int) -> pa.RecordBatch:
        ids, pieces, starts, lengths, sums, tokens = zip(*rows)
        bins, offsets, room, may_change = _pack(np.array(lengths, dtype=np.int64), capacity)
        base = (TaskContext.get().partitionId() << 36) + (run << 20)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
            pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(base + bins), pa.array(offsets),
            pa.array(room), pa.array(may_change), pa.array(tokens, pa.list_(pa.int32()))], schema=schema)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        rows: list[tuple] = []
        run = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                start = 0
                # The first piece takes what is over, so that all others are full.
                end = len(tokens) - (len(tokens) - 1) // capacity * capacity
                piece = 0
                while start < len(tokens):
                    part = tokens[start:end]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()),
                                 part.astype(np.int32) if keep_ids else None))
                    start, end, piece = end, end + capacity, piece + 1
                    if len(rows) >= RUN_PIECES:
                        yield emit(rows, run)
                        rows, run = [], run + 1
        if rows:
            yield emit(rows, run)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), whole_text(text_column).alias("t"))
    return rows.mapInArrow(of_batches, PIECES)


def _exchange(loose: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Pack the pieces of sequences with gaps again in mixed groups; a group keeps what it had unless it saves some."""
    columns = loose.columns

    def again(table: pa.Table) -> pa.Table:
        old = table["sequence_id"].to_numpy()
        bins, offsets, room, may_change = _pack(table["length"].to_numpy(), capacity)
        if room.size and bins.max() + 1 < len(np.unique(old)):
            group = table["_group"][0].as_py()
            fresh = {"sequence_id": pa.array((number << 58) + (group << 28) + bins), "offset": pa.array(offsets),
                     "room": pa.array(room), "open": pa.array(may_change)}
            for name, values in fresh.items():
                table = table.set_column(table.schema.get_field_index(name), name, values)
        return table.select(columns)

    group = F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(groups))
    return loose.withColumn("_group", group).groupBy("_group").applyInArrow(again, loose.schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: where its document's ids begin, its length and checksum, its sequence and place there.

    A document is its token ids and ``end_id``; only those over ``capacity`` are
    cut. Null and empty texts are the single end id. Repeated rows and null ids are
    packed like any others, other columns of ``docs`` are not read, and an empty table
    gives no rows. ``sequences_bound`` is the lower bound on sequences for the whole
    table and ``ids`` holds the token ids if ``keep_ids``.
    """
    if capacity > 1 << 20:
        raise ValueError("sequences may have up to 2**20 tokens")
    current = stored(first_packing(docs, tokenizer, capacity, end_id, keep_ids, id_column, text_column))
    lengths = current.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in lengths:
        histogram[row.length] = row.n
    bound = lower_bound(histogram, capacity) if lengths else 0
    parts = []
    loose, settled, before = current, 0, None
    for number in count(1):
        # Sequences that cannot change are final; the others exchange until the whole table meets its bound.
        parts.append(loose.where("not open"))
        settled += parts[-1].select("sequence_id").distinct().count()
        loose = loose.where("open")
        sequences, pieces = loose.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        if settled + sequences in (bound, before) or not pieces:
            break
        before = settled + sequences
        groups = max(1, -(-pieces // EXCHANGE_PIECES))
        loose = stored(_exchange(loose, groups, number, capacity))
        if groups == 1:
            break
    for part in parts:
        loose = loose.unionByName(part)
    return loose.withColumn("sequences_bound", F.lit(bound).cast("long"))
