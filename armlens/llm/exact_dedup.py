"""Exact duplicates by counting quotient filters and byte verification.

Each task builds counting quotient filters over 64-bit fingerprints of its rows.
A fingerprint splits into a segment (the shuffle key), a quotient (the slot it
belongs to) and a remainder. Filters of one segment hold their remainders in
sorted order, so they merge without loss into one filter whose counts are the
corpus counts. Only rows whose fingerprint counts more than one have their texts
compared, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.session import stored
from .common import whole_text

# Fingerprints held in one task before its filters are emitted, and aimed at per merged segment.
FILTER_ROWS = 1 << 20
SEGMENT_ROWS = 1 << 19

FILTER_SCHEMA = "segment int, quotient_bits int, occupied binary, run_ends binary, remainders binary, counts binary"


def build_filter(fingerprints: np.ndarray, counts: np.ndarray, segment_bits: int) -> dict:
    """A counting quotient filter of distinct sorted fingerprints of one segment.

    ``occupied`` has a bit per quotient, ``run_ends`` a bit per filled slot that
    closes the run of a quotient, ``remainders`` and ``counts`` one entry per slot.
    """
    quotient_bits = min(max(int(np.ceil(np.log2(max(1, len(fingerprints)) / 0.75))), 3), 64 - segment_bits - 1)
    below = np.uint64(64 - segment_bits - quotient_bits)
    quotients = (fingerprints >> below) & np.uint64((1 << quotient_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotients.astype(np.int64)] = True
    run_ends = np.append(quotients[1:] != quotients[:-1], True)
    remainders = fingerprints & np.uint64((1 << int(below)) - 1)
    return {
        "quotient_bits": quotient_bits,
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(run_ends).tobytes(),
        "remainders": remainders.astype("<u8").tobytes(),
        "counts": counts.astype("<i8").tobytes(),
    }


def read_filter(segment: int, segment_bits: int, quotient_bits: int, occupied: bytes, run_ends: bytes,
                remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that ``build_filter`` was given."""
    held = np.frombuffer(remainders, dtype="<u8")
    ends = np.unpackbits(np.frombuffer(run_ends, dtype=np.uint8), count=len(held)).astype(bool)
    runs = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64)
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, dtype=np.uint8))).astype(np.uint64)[runs]
    below = np.uint64(64 - segment_bits - quotient_bits)
    above = np.uint64((segment << (64 - segment_bits)) & (2**64 - 1)) if segment_bits else np.uint64(0)
    return above | (quotients << below) | held, np.frombuffer(counts, dtype="<i8")


def merge_filters(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal fingerprints added up, in sorted order."""
    fingerprints = np.concatenate([f for f, _ in filters])
    counts = np.concatenate([c for _, c in filters])
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1]))
    return fingerprints[first], np.add.reduceat(counts, first)


def _filters_of(values: list[np.ndarray], segment_bits: int) -> Iterator[pa.RecordBatch]:
    """One filter per segment from the fingerprints that a task has gathered."""
    if not values:
        return
    fingerprints, counts = np.unique(np.concatenate(values), return_counts=True)
    segments = (fingerprints >> np.uint64(64 - segment_bits)).astype(np.int64) if segment_bits else np.zeros(
        len(fingerprints), dtype=np.int64)
    cuts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
    rows = []
    for start, end in zip(cuts, np.append(cuts[1:], len(segments))):
        rows.append({"segment": int(segments[start]),
                     **build_filter(fingerprints[start:end], counts[start:end], segment_bits)})
    schema = pa.schema([("segment", pa.int32()), ("quotient_bits", pa.int32()), ("occupied", pa.binary()),
                        ("run_ends", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])
    for start in range(0, len(rows), 256):
        yield pa.RecordBatch.from_pylist(rows[start:start + 256], schema=schema)


def repeated_fingerprints(fingerprints: DataFrame, column: str, rows: int) -> DataFrame:
    """``fingerprint, n`` of all values of a long column that occur more than once."""
    segment_bits = max(0, int(np.ceil(np.log2(max(1, rows) / SEGMENT_ROWS))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= FILTER_ROWS:
                yield from _filters_of(held, segment_bits)
                held, size = [], 0
        yield from _filters_of(held, segment_bits)

    def merge(group: pa.Table) -> pa.Table:
        filters = [read_filter(r["segment"], segment_bits, r["quotient_bits"], r["occupied"], r["run_ends"],
                               r["remainders"], r["counts"]) for r in group.to_pylist()]
        values, counts = merge_filters(filters)
        again = counts > 1
        return pa.table({"fingerprint": values[again].view(np.int64), "n": counts[again]})

    filters = fingerprints.select(column).mapInArrow(build, FILTER_SCHEMA)
    return filters.groupBy("segment").applyInArrow(merge, "fingerprint long, n long")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     normalise: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` is the compared text (default: the text, null as empty). Of
    equal texts the largest id stays. Rows with a null id are counted in their
    group and stay only if no row of it has an id. Repeated rows (same id and
    text) all belong to the group and all count as kept. An empty table gives an
    empty result; other columns of ``docs`` are not read.
    """
    text = whole_text(text_column) if normalise is None else normalise
    rows = docs.select(F.col(id_column).alias("id"), text.alias("t"))
    narrow = stored(rows.select("id", F.xxhash64("t").alias("fp"), F.sha2(F.encode("t", "utf-8"), 256).alias("sha")))
    total = narrow.count()
    repeated = stored(repeated_fingerprints(narrow, "fp", total))
    suspects = rows.withColumn("fp", F.xxhash64("t")).join(
        repeated.select(F.col("fingerprint").alias("fp")), "fp", "left_semi")
    # Grouping by the text itself compares the bytes. The digest goes first, so the
    # grouping has a shuffle of its own and a hot fingerprint can be split in the join.
    groups = stored(
        suspects.groupBy(F.sha2(F.encode("t", "utf-8"), 256).alias("sha"), "t")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
        .select("sha", "keep_id", "n")
        .where("n > 1")
    )
    joined = narrow.join(groups, "sha", "left")
    alone = F.col("n").isNull()
    return joined.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows that repeat the kept id and text all stay. Null and empty texts are equal; rows with a null id stay
    only if no equal text has an id. An empty table gives an empty one; other columns, whatever their names, pass unread.
    """
    decided = exact_duplicates(docs, id_column, text_column)
    dropped = decided.where("not kept").select(F.col(id_column).alias("_id"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.encode(whole_text(text_column), "utf-8"), 256)
    return docs.join(dropped.distinct(), F.col(id_column).eqNullSafe(F.col("_id")) & (digest == F.col("_sha")), "left_anti")
