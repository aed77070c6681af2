"""Fingerprints as 64-bit words: distances, and links inside groups of any size.

A group that fits one task is searched breadth-first. A larger one is cut into
chunks that all meet the same few pivots; the triangle inequality then tells which
rows still have to meet the rows around a pivot they are not connected to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import stored

# Pivots of a group in the first level, and the most in any; each level has four times as many as the last.
PIVOTS = 64
MOST_PIVOTS = 1024


def bytes_of(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Equally long binary values as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, size)


def distances(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which rows of 64-bit words differ from ``one``."""
    return np.bitwise_count(fps ^ one).sum(axis=1, dtype=np.int64)


def forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect the same rows as all pairs within ``distance`` do; memory stays linear."""
    todo = np.arange(len(fps))
    left, right = [], []
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = distances(fps[todo], fps[at]) <= distance
            found = todo[near].tolist()
            todo = todo[~near]
            queue.extend(found)
            left.extend([at] * len(found))
            right.extend(found)
    return left, right


class _Sets:
    """Disjoint sets of numbers below ``size``, each named by its smallest member."""

    def __init__(self, size: int):
        self.above = list(range(size))

    def name(self, at: int) -> int:
        while self.above[at] != at:
            self.above[at] = self.above[self.above[at]]
            at = self.above[at]
        return at

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart until now."""
        a, b = self.name(a), self.name(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


def _spread(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1).cast("array<long>"))


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks)


def _placed(rows: DataFrame, pivots: DataFrame, distance: int, size: int) -> DataFrame:
    """Every row with its nearest pivot (``cell``, ``dist``), null beyond ``distance``; and rows with ``other``,
    pivots ``node`` and ``other`` that are both within ``distance`` of one row."""
    schema = pa.schema([("g", pa.int64()), ("salt", pa.int64()), ("node", pa.int64()), ("fp", pa.binary()),
                        ("cell", pa.int64()), ("dist", pa.int64()), ("other", pa.int64())])

    def place(part: pa.Table, heads: pa.Table) -> pa.Table:
        n = part.num_rows
        if not n or not heads.num_rows:
            return schema.empty_table()
        fps, names = bytes_of(part["fp"], size).view(np.uint64), heads["node"].to_numpy()
        nearest, least = np.zeros(n, dtype=np.int64), np.full(n, distance + 1)
        touching = np.zeros((len(names), n), dtype=bool)
        for i, head in enumerate(bytes_of(heads["fp"], size).view(np.uint64)):
            apart = distances(fps, head)
            touching[i] = apart <= distance
            closer = apart < least
            nearest[closer], least[closer] = i, apart[closer]
        sets, joined = _Sets(len(names)), []
        for i, rows_near in enumerate(touching):
            joined += [(names[i], names[j]) for j in np.unique(nearest[rows_near]).tolist() if sets.join(i, j)]
        away = least > distance
        m, group = len(joined), part["g"][0].as_py()
        placed = pa.table([
            part["g"], part["salt"], part["node"], part["fp"], pa.array(names[nearest], mask=away),
            pa.array(least, mask=away), pa.nulls(n, pa.int64())], schema=schema)
        links = pa.table([
            pa.array([group] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([a for a, _ in joined], pa.int64()),
            pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
            pa.array([b for _, b in joined], pa.int64())], schema=schema)
        return pa.concat_tables([placed, links])

    return rows.groupBy("g", "salt").cogroup(pivots.groupBy("g", "salt")).applyInArrow(
        place, "g long, salt long, node long, fp binary, cell long, dist long, other long")


def _coloured(pivots: DataFrame, joined: DataFrame) -> DataFrame:
    """``pivots`` with ``colour``, the same for pivots that ``joined`` (g, node, other) connects."""
    schema = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("fp", pa.binary()), ("colour", pa.int64())])

    def colour(heads: pa.Table, pairs: pa.Table) -> pa.Table:
        names = heads["node"].to_pylist()
        place, sets = {name: i for i, name in enumerate(names)}, _Sets(len(names))
        for a, b in zip(pairs["node"].to_pylist(), pairs["other"].to_pylist()):
            sets.join(place[a], place[b])
        colours = [names[sets.name(i)] for i in range(len(names))]
        return pa.table([heads["g"], heads["node"], heads["fp"], pa.array(colours, pa.int64())], schema=schema)

    return (pivots.select("g", "node", "fp").groupBy("g").cogroup(joined.distinct().groupBy("g"))
            .applyInArrow(colour, "g long, node long, fp binary, colour long"))


def _visitors(rows: DataFrame, cells: DataFrame, distance: int, size: int) -> DataFrame:
    """``g, cell, node, fp``: rows that may be within ``distance`` of a row of a cell of another colour.

    If they are, they are within ``distance`` and the cell's radius of its pivot.
    """
    schema = pa.schema([("g", pa.int64()), ("cell", pa.int64()), ("node", pa.int64()), ("fp", pa.binary())])

    def visit(part: pa.Table, heads: pa.Table) -> pa.Table:
        if not part.num_rows or not heads.num_rows:
            return schema.empty_table()
        fps, names = bytes_of(part["fp"], size).view(np.uint64), heads["node"].to_pylist()
        colours, radii = heads["colour"].to_pylist(), heads["radius"].to_pylist()
        colour_of = dict(zip(names, colours))
        mine = np.array([colour_of.get(c, -1) for c in part["cell"].to_pylist()])
        found = []
        for i, head in enumerate(bytes_of(heads["fp"], size).view(np.uint64)):
            at = np.flatnonzero(mine != colours[i])
            at = at[distances(fps[at], head) <= distance + radii[i]]
            if len(at):
                some = part.take(pa.array(at))
                found.append(pa.table([some["g"], pa.array([names[i]] * len(at), pa.int64()), some["node"], some["fp"]],
                                      schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return rows.groupBy("g", "salt").cogroup(cells.groupBy("g", "salt")).applyInArrow(
        visit, "g long, cell long, node long, fp binary")


def _visits(members: DataFrame, visitors: DataFrame, distance: int, size: int, block: int) -> DataFrame:
    """``a, b``: a link of each visitor to each block of a cell's members that holds one within ``distance``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(part: pa.Table, guests: pa.Table) -> pa.Table:
        if not part.num_rows or not guests.num_rows:
            return schema.empty_table()
        fps, names = bytes_of(part["fp"], size).view(np.uint64), part["node"].to_numpy()
        left, right = [], []
        for node, one in zip(guests["node"].to_pylist(), bytes_of(guests["fp"], size).view(np.uint64)):
            apart = distances(fps, one)
            at = int(np.argmin(apart))
            if apart[at] <= distance:
                left.append(node)
                right.append(int(names[at]))
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    cell = ["g", "cell"]
    blocks = lambda name: F.ceil(F.count("*") / F.lit(block)).alias(name)
    sizes = stored(visitors.groupBy(*cell).agg(blocks("guests")).join(members.groupBy(*cell).agg(blocks("homes")), cell))
    left = (members.join(sizes, cell).withColumn("i", _dealt(F.col("homes")))
            .select(*cell, "node", "fp", "i", _spread(F.col("guests")).alias("j")))
    right = (visitors.join(sizes, cell).withColumn("j", _dealt(F.col("guests")))
             .select(*cell, "node", "fp", "j", _spread(F.col("homes")).alias("i")))
    key = [*cell, "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")


def group_links(members: DataFrame, distance: int, words: int, block: int, pivots: int = PIVOTS) -> DataFrame:
    """``a, b`` links over ``g, node, fp``: within each group g they connect what all pairs within ``distance`` do.

    Groups of up to ``block`` rows are searched in one task. Of a larger one a few
    rows are drawn as pivots; every row within ``distance`` of a pivot is linked to
    the nearest, which makes the cells, and cells that share a row are connected.
    Two rows of unconnected cells can only link if one is near enough to the
    other's pivot (see ``_visitors``); those are compared in blocks. Rows near
    no pivot go to the next level, with more pivots. No task holds more than a block of
    each side, and a group of near copies costs a constant per row.
    """
    size = 8 * words
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole(part: pa.Table) -> pa.Table:
        names = part["node"].to_numpy()
        a, b = forest(bytes_of(part["fp"], size).view(np.uint64), distance)
        return pa.table([names[np.array(a, dtype=np.int64)], names[np.array(b, dtype=np.int64)]], schema=schema)

    rest, found, count = stored(members.select("g", "node", "fp")), [], min(pivots, block)
    while True:
        sized = stored(rest.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).alias("chunks")))
        dealt = rest.join(sized, "g")
        found.append(dealt.where("chunks = 1").groupBy("g").applyInArrow(whole, "a long, b long"))
        large = sized.where("chunks > 1")
        if large.isEmpty():
            break
        rows = dealt.where("chunks > 1").withColumn("salt", _dealt(F.col("chunks"))).select("g", "salt", "node", "fp")
        drawn = Window.partitionBy("g").orderBy(F.xxhash64("node", F.lit(len(found))), "node")
        chosen = stored(rows.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= count).select("g", "node", "fp"))
        everywhere = large.select("g", _spread(F.col("chunks")).alias("salt"))
        placed = stored(_placed(rows, chosen.join(everywhere, "g"), distance, size))
        at = placed.where("other is null")
        joined = placed.where("other is not null").select("g", "node", "other")
        members_of = at.where("cell is not null")
        found.append(members_of.where("node <> cell").select(F.col("node").alias("a"), F.col("cell").alias("b")))
        found.append(joined.select(F.col("node").alias("a"), F.col("other").alias("b")))
        radii = members_of.groupBy("g", "cell").agg(F.max("dist").alias("radius")).withColumnRenamed("cell", "node")
        cells = stored(_coloured(chosen, joined).join(radii, ["g", "node"]))
        visitors = stored(_visitors(at, cells.join(everywhere, "g"), distance, size))
        if not visitors.isEmpty():
            found.append(_visits(members_of.select("g", "cell", "node", "fp"), visitors, distance, size, block))
        rest = at.where("cell is null").select("g", "node", "fp")
        count = min(4 * count, MOST_PIVOTS, block)
    out = found[0]
    for links in found[1:]:
        out = out.union(links)
    return out


def crossing_pairs(members: DataFrame, distance: int, words: int, block: int, guests: int) -> DataFrame:
    """``a, b``: all pairs within ``distance`` over ``g, node, fp, family`` that share a group and not a family.

    One of a pair is outside of the group's largest family. Those rows meet all of
    the group, in blocks of about ``guests`` and ``block`` rows.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    size = 8 * words

    def compare(part: pa.Table, visiting: pa.Table) -> pa.Table:
        if not part.num_rows or not visiting.num_rows:
            return schema.empty_table()
        fps, names = bytes_of(part["fp"], size).view(np.uint64), part["node"].to_numpy()
        families, own = part["family"].to_numpy(), visiting["family"].to_numpy()
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, (node, one) in enumerate(zip(visiting["node"].to_pylist(), bytes_of(visiting["fp"], size).view(np.uint64))):
            at = np.flatnonzero((distances(fps, one) <= distance) & (families != own[i]))
            left.append(np.minimum(node, names[at]))
            right.append(np.maximum(node, names[at]))
        return pa.table([np.concatenate(left), np.concatenate(right)], schema=schema)

    counted = members.groupBy("g", "family").agg(F.count("*").alias("n")).groupBy("g").agg(
        F.max_by("family", F.struct("n", "family")).alias("largest"), F.sum("n").alias("every"), F.max("n").alias("most"))
    sizes = stored(counted.where("most < every").select(
        "g", "largest", F.ceil(F.col("every") / F.lit(block)).alias("homes"),
        F.ceil((F.col("every") - F.col("most")) / F.lit(guests)).alias("guests")))
    rows = members.join(sizes, "g")
    columns = ["g", "node", "fp", "family"]
    left = rows.select(*columns, _dealt(F.col("homes")).alias("i"), _spread(F.col("guests")).alias("j"))
    again = [F.col(c).alias(c) for c in columns]  # names of their own in the plan
    right = rows.where("family <> largest").select(*again, _dealt(F.col("guests")).alias("j"), _spread(F.col("homes")).alias("i"))
    key = ["g", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "a long, b long")
