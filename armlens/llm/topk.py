"""Exact top-k by inner product: columnar branch-and-bound over dimension blocks.

Vectors are held in vertical layout (one array per dimension block). Scores add
up block by block; after each block the norms of what remains bound every final
score, and candidates that cannot reach the k-th best score so far are compacted
away before the next block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import stored

# Bytes of vectors in a block of queries or of candidates, and rows at least; a task compares one of each. Every block
# of one side is shuffled once for each block of the other, so larger blocks move less.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 4096
# Dimensions added up between two compactions.
DIMENSIONS = 16
# Sums below this are exact in doubles.
EXACT = float(1 << 53)


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are continued with zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, vector in zip(out, vectors):
        row[:len(vector)] = vector
    return out


def _remaining(matrix: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Euclidean length of every vector from each cut on."""
    squares = matrix.astype(np.float64) ** 2
    return np.stack([np.sqrt(squares[:, cut:].sum(axis=1)) for cut in cuts])


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query id, candidate id, score`` of the k best candidates of each query; ties go to the smaller id.

    Ids are numbers; a candidate with the query's own id is left out. No candidate
    that could be among the k best is dropped: the bound on the rest is the product
    of the remaining norms (Cauchy-Schwarz), rounded up.
    """
    width = queries.shape[1]
    cuts = list(range(DIMENSIONS, width, DIMENSIONS))
    blocks = list(zip([0, *cuts], [*cuts, width]))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < EXACT else np.int64
    columns = [np.ascontiguousarray(candidates[:, a:b].T.astype(kind)) for a, b in blocks]
    left, query_left = _remaining(candidates, cuts), _remaining(queries, cuts)
    whole = candidates.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for number, (query_id, query) in enumerate(zip(query_ids, queries.astype(kind))):
        alive = np.flatnonzero(ids != query_id)
        score = query[:blocks[0][1]] @ columns[0]
        score = score[alive]
        for step, cut in enumerate(cuts):
            if len(alive) > k:
                rest = query_left[step, number] * left[step][alive]
                # The k leaders so far, scored in full, give a score to reach.
                leaders = alive[np.argpartition(-score, k - 1)[:k]]
                reach = (whole[leaders] @ query).min()
                stays = score + rest * (1 + 1e-9) + 1 >= reach
                alive, score = alive[stays], score[stays]
            a, b = blocks[step + 1]
            score = score + query[a:b] @ columns[step + 1][:, alive]
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), query_id), ids[alive[best]], score[best].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_column: str, vector_column: str,
          scale: int, block_rows: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``vectors`` for each row of ``queries``.

    Components become floor(scale * x); the score is the integer inner product,
    over the common components if lengths differ, exact while it fits a long.
    Vectors that are null or hold null or non-finite components take no part, nor
    do rows with a null id. A row never answers a query with its own id. Equal rows count once;
    different vectors of one id count as one row with the better score. Fewer
    candidates give fewer rows; an empty table gives none. Other columns are not read.
    ``block_rows`` is the size of a block; by default as many rows as ``BLOCK_BYTES`` hold, or fewer if
    that leaves cores idle.
    """

    def whole_numbers(table: DataFrame) -> DataFrame:
        vector = F.col(vector_column)
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                          & (F.abs(x.cast("double")) < F.lit(float("inf"))))
        return (table.where(F.col(id_column).isNotNull() & vector.isNotNull() & finite)
                .select(F.col(id_column).cast("long").alias("id"),
                        F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))
                .distinct())

    rows, asked = stored(whole_numbers(vectors)), stored(whole_numbers(queries))
    n_rows, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    if block_rows is None:
        share = -(-n_rows // vectors.sparkSession.sparkContext.defaultParallelism)
        block_rows = max(BLOCK_ROWS, min(BLOCK_BYTES // (8 * max(width, 1)), share))
    row_blocks = max(1, -(-n_rows // block_rows))
    query_blocks = max(1, -(-asked.count() // block_rows))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(asked_part: pa.Table, rows_part: pa.Table) -> pa.Table:
        if not asked_part.num_rows or not rows_part.num_rows:
            return schema.empty_table()
        unpack = lambda part: [np.asarray(v.values, dtype=np.int64) for v in part["v"]]
        questions, candidates = unpack(asked_part), unpack(rows_part)
        width = max(map(len, questions + candidates))
        found = search_block(asked_part["id"].to_numpy(), _matrix(questions, width),
                             rows_part["id"].to_numpy(), _matrix(candidates, width), k)
        return pa.table([pa.array(c, pa.int64()) for c in found], schema=schema)

    block = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count))
    # Each block of queries meets each block of rows once, in a task of its own.
    left = asked.select("id", "v", block(query_blocks).alias("q")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<long>")))
    right = rows.select("id", "v", block(row_blocks).alias("c")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    found = (left.groupBy("q", "c").cogroup(right.groupBy("q", "c"))
             .applyInArrow(search, "query_id long, vec_id long, score long")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
