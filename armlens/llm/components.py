"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored

MAX_ROUNDS = 64
# Links that a task replaces by stars together.
CONTRACTED_LINKS = 200_000


def stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rows of a table of links replaced by one link of each node to the smallest that links reach."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            away = np.flatnonzero(label != np.arange(len(names)))
            return np.stack([names[label[away]], names[away]], axis=1)
        label = new


def contracted(links: DataFrame, block: int = CONTRACTED_LINKS) -> DataFrame:
    """``a, b``: of every ``block`` links of a task one link of each node to the smallest that they reach.

    They connect what the links connect, and are fewer than the nodes of the block however many links
    there are between these. Small partitions are read together and nothing is shuffled.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= block:
                yield one(held)
                held, size = [], 0
        if size:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(held)
        found = stars(both.column(0).to_numpy(), both.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(found[:, 1], pa.int64()), pa.array(found[:, 0], pa.int64())], names=["a", "b"])

    return links.select("a", "b").coalesce(-(-links.count() // block) or 1).mapInArrow(contract, "a long, b long")


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """One star step over links ``a > b``.

    Large star: every larger neighbour of a node is linked to the node's smallest
    neighbour. Small star: every smaller one, and the node itself, is. The minimum
    per node is an aggregate and its spread a join, so no neighbourhood is ever
    gathered in one place and a node with very many links can be split.
    """
    if upward:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return (
            both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a > b").distinct()
        )
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``); component is the smallest node.

    Each round is written to the shared folder, so a lost executor repeats at
    most one round. The rounds grow with the logarithm of the longest path.
    """
    current = stored(contracted(links).where("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        current = stored(_star(_star(current, True), False))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
