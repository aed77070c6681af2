"""Cheapest repair of the turn order of conversations, by weighted interval parsing.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. Over the states of that
language the repair grammar has a nonterminal [p, q] for every two states and the
rules, in Chomsky normal form,

    [p, q] -> [p, r] [r, q]          at no cost
    [p, q] -> row                    keep 0, rerole 1, delete 2, and 5 more to keep a truncated row
    [p, q] -> nothing                insert, 5 for each turn

A cell holds the least (cost, audit) with which each [p, q] derives a span of rows;
insertions before a row are closed into the cell of that row. Cells are combined bottom-up by
span length. Since a derivation of [p, q] can be cut after any row, one way to cut
a span gives the same cell as all ways together, so spans double and a
conversation of n rows takes n combinations instead of n cubed.

Two audits of one span that cost the same are never prefixes of each other (the longer would
hold more insertions), so the least audits of the parts make the least of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from .common import row_ids

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
ACCEPTED = (0, 3)
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
# Rows, and characters of text, of a span that is kept in one row and rebuilt at once.
SPAN_ROWS, SPAN_CHARACTERS = 64, 1 << 20

# A cell: for every two states, null or (cost, audit, states between the spans).
Cell = list[list[tuple[int, str, str] | None]]


def _insertions() -> list[list[str | None]]:
    """The initials of the fewest turns whose insertion leads from one state to another."""
    found: list[list[str | None]] = [[None] * 4 for _ in STATES]
    for p in STATES:
        reached, found[p][p] = [p], ""
        for at in reached:
            for initial in ROLES:
                q = READS.get((at, initial))
                if q is not None and found[p][q] is None:
                    found[p][q] = found[p][at] + initial
                    reached.append(q)
    return found


INSERTED = _insertions()
# What is inserted after the last row, by the state it leaves.
TAILS = [min((INSERTED[q][end] for end in ACCEPTED if INSERTED[q][end] is not None), key=len) for q in STATES]


def combined(left: Cell, right: Cell, spans: bool = False) -> Cell:
    """The cell of two neighbouring spans; with ``spans`` the state between them is noted."""
    cell: Cell = [[None] * 4 for _ in STATES]
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                a, b = left[p][r], right[r][q]
                if a is None or b is None or best and a[0] + b[0] > best[0]:
                    continue
                found = (a[0] + b[0], a[1] + b[1], a[2] + str(r) + b[2] if spans else "")
                if best is None or found < best:
                    best = found
            cell[p][q] = best
    return cell


NOTHING: Cell = [[(0, "", "") if p == q else None for q in STATES] for p in STATES]
INSERTIONS: Cell = [[None if i is None else (INSERT * len(i), "I" * len(i), "") for i in row] for row in INSERTED]


def row_cell(initial: str, copies: int, bad: bool, truncated: bool) -> Cell:
    """The cell of ``copies`` equal rows, with insertions before them; all copies of ``bad`` rows and all but one of others go."""
    cell: Cell = [[None] * 4 for _ in STATES]
    extra = TRUNCATED if truncated else 0
    for p in STATES:
        cell[p][p] = (DELETE, "D", "")
        if bad:
            continue
        ways = [(KEEP, "K", initial)] + [(REROLE, "R", role) for role in ROLES]
        for cost, letter, role in ways:
            q = READS.get((p, role))
            if q is not None:
                cell[p][q] = min(cell[p][q] or (cost + extra, letter, ""), (cost + extra, letter, ""))
    cell = combined(INSERTIONS, cell)
    if copies > 1:
        gone = copies - 1
        cell = combined(cell, [[(DELETE * gone, "D" * gone, "") if p == q else None for q in STATES] for p in STATES])
    return cell


def parsed(cells: list[Cell], spans: bool = False) -> Cell:
    """The cell of all rows, combined bottom-up by span length."""
    while len(cells) > 1:
        pairs = [combined(a, b, spans) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(cells) - len(cells) % 2:]
    return cells[0] if cells else NOTHING


def _initial(role: str) -> str:
    return role[:1]


@dataclass
class Row:
    """Equal rows of a conversation."""

    role: str
    text: str
    copies: int
    seen: bool  # role and text stood in an earlier turn

    @property
    def blank(self) -> bool:
        return not self.text.strip(WHITE)

    @property
    def truncated(self) -> bool:
        return not self.text.rstrip(WHITE).endswith((".", "!", "?"))

    def cell(self) -> Cell:
        return row_cell(_initial(self.role), self.copies, self.blank or self.seen, self.truncated)


def rebuilt(rows: list[Row], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that ``audit`` leaves or inserts, from ``state`` on."""
    lines, todo = [], iter([row for row in rows for _ in range(row.copies)])
    for letter in audit:
        if letter == "D":
            next(todo)
            continue
        row = None if letter == "I" else next(todo)
        initial = _initial(row.role) if letter == "K" else "a" if state == 2 else "u"
        role = row.role if letter == "K" else ROLES[initial]
        lines.append(f"{role}:{row.text if row else ''}")
        state = READS[state, initial]
    return lines


@dataclass
class Part:
    """What is known about neighbouring rows of one conversation."""

    size: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None  # initials of the first and the last row
    last: str | None = None
    least: int | None = None  # first and last turn that are not null, and how many there are
    most: int | None = None
    turns: int = 0

    def add(self, other: Part) -> None:
        """Take over the rows that follow."""
        self.illegal += other.illegal
        if self.size and other.size and self.last + other.first not in LEGAL:
            self.illegal += 1
        for name in ("size", "blank", "duplicate", "truncated", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.most is not None and self.most == other.least:
            self.turns -= 1
        if other.size:
            self.first, self.last = other.first if self.first is None else self.first, other.last
        self.least = other.least if self.least is None else self.least
        self.most = self.most if other.most is None else other.most

    @classmethod
    def of(cls, row: Row, turn: int | None) -> Part:
        initial, n = _initial(row.role), row.copies
        blank, seen = row.blank, row.seen
        return cls(
            n, n * blank, 0 if blank else n if seen else n - 1, int(not blank and not seen and row.truncated), n - 1,
            initial, initial, turn, turn, int(turn is not None))


@dataclass
class Open:
    """The rows of one conversation that a task is reading."""

    conversation: object
    turn: int | None
    digest: bytes
    part: int
    rows: list[Row] = field(default_factory=list)
    characters: int = 0
    spans: int = 0
    total: Part = field(default_factory=Part)
    # Cells of 1, 2, 4 ... spans, longest first.
    cells: list[tuple[int, Cell]] = field(default_factory=list)

    def close_span(self) -> list[Row]:
        cell, size = parsed([row.cell() for row in self.rows]), 1
        while self.cells and self.cells[-1][0] == size:
            cell, size = combined(self.cells.pop()[1], cell, True), 2 * size
        self.cells.append((size, cell))
        rows, self.rows, self.characters = self.rows, [], 0
        self.spans += 1
        return rows

    def whole(self) -> Cell:
        cell = self.cells[-1][1]
        for _, before in reversed(self.cells[:-1]):
            cell = combined(before, cell, True)
        return cell


ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("seen", pa.bool_())]))
CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
                            ("path", pa.string())]))
TOTALS = list(Part.__dataclass_fields__)
TOTALS_SQL = ", ".join(f"{name} {'string' if name in ('first', 'last') else 'long'}" for name in TOTALS)


def _spans(ordered: DataFrame) -> DataFrame:
    """Spans of rows (``rows`` is not null) and, for each task and conversation, what its spans make together.

    ``part`` is the number of a task's stretch of a conversation and ``span`` a span's number in it; ``turn`` and ``digest``
    are those of the stretch's first row, which order the stretches.
    """
    kind = ordered.schema[0].dataType.simpleString()

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Open | None = None
        out: list[dict] = []
        count, size = 0, 0
        schema = None

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        def head() -> dict:
            return {"conversation": now.conversation, "part": now.part, "turn": now.turn, "digest": now.digest}

        def close() -> None:
            rows = now.close_span()
            out.append(head() | {"span": now.spans - 1, "rows": [vars(row) for row in rows]})

        def finish() -> None:
            if now.rows:
                close()
            cell = now.whole()
            out.append(head() | vars(now.total) | {"cells": [
                dict(zip(("p", "q", "cost", "audit", "path"), (p, q, *cell[p][q])))
                for p in STATES for q in STATES if cell[p][q] is not None]})

        for batch in batches:
            if schema is None:
                schema = pa.schema([
                    ("conversation", batch.schema[0].type), ("part", pa.int64()), ("turn", pa.int64()), ("digest", pa.binary()),
                    ("span", pa.int64()), ("rows", ROWS),
                    *[(name, pa.string() if name in ("first", "last") else pa.int64()) for name in TOTALS], ("cells", CELLS)])
            for conv, turn, digest, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conversation:
                    if now is not None:
                        finish()
                    now = Open(conv, turn, digest, int(row_ids(count, 1)[0]))
                    count += 1
                row = Row(role, text, copies, seen)
                now.total.add(Part.of(row, turn))
                now.rows.append(row)
                now.characters += len(text)
                size += len(text)
                if len(now.rows) == SPAN_ROWS or now.characters > SPAN_CHARACTERS:
                    close()
                if len(out) >= 400 or size > 4 * SPAN_CHARACTERS:
                    yield passed()
                    out, size = [], 0
        if now is not None:
            finish()
        if out:
            yield passed()

    return ordered.mapInArrow(
        of_partition, f"conversation {kind}, part long, turn long, digest binary, span long, "
        f"rows array<struct<role: string, text: string, copies: bigint, seen: boolean>>, {TOTALS_SQL}, "
        "cells array<struct<p: int, q: int, cost: bigint, audit: string, path: string>>")


def _decide(conversation: object, rows: list[dict]) -> dict:
    """Counts, the least repair and the states between the spans, from the parts of one conversation in their order."""
    total, cells = Part(), []
    for row in rows:
        total.add(Part(**{name: row[name] for name in TOTALS}))
        cell: Cell = [[None] * 4 for _ in STATES]
        for c in row["cells"]:
            cell[c["p"]][c["q"]] = (c["cost"], c["audit"], c["path"])
        cells.append(cell)
    whole = parsed(cells, True)
    cost, audit, path, ending = min(
        (whole[0][q][0] + INSERT * len(TAILS[q]), whole[0][q][1] + "I" * len(TAILS[q]), whole[0][q][2], q)
        for q in STATES if whole[0][q] is not None)
    states, at, paths = f"0{path}{ending}", 0, []
    for place, row in enumerate(rows):
        spans = len(row["cells"][0]["path"]) + 1
        paths.append({"part": row["part"], "place": place, "states": states[at:at + spans + 1]})
        at += spans
    gaps = 0 if total.least is None else total.most - total.least + 1 - total.turns
    return {"conversation": conversation, "gaps": gaps, "blank": total.blank, "duplicate": total.duplicate,
            "truncated": total.truncated, "illegal": total.illegal, "cost": cost, "audit": audit, "ending": ending, "paths": paths}


def _decided(parts: DataFrame) -> DataFrame:
    """One row per conversation: counts, ``cost``, ``audit``, the state ``ending`` after its last row, and
    ``paths``, the states before and after the spans of each part."""
    kind = parts.schema[0].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    paths = pa.list_(pa.struct([("part", pa.int64()), ("place", pa.int64()), ("states", pa.string())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        schema = None
        for batch in batches:
            done = []
            schema = pa.schema([("conversation", batch.schema[0].type), *[(name, pa.int64()) for name in counts],
                                ("audit", pa.string()), ("ending", pa.int32()), ("paths", paths)])
            for row in batch.to_pylist():
                if held and held[0]["conversation"] != row["conversation"]:
                    done.append(_decide(held[0]["conversation"], held))
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([_decide(held[0]["conversation"], held)], schema=schema)

    ordered = parts.repartition("conversation").sortWithinPartitions("conversation", "turn", "digest")
    return ordered.mapInArrow(
        decide, f"conversation {kind}, {', '.join(f'{name} long' for name in counts)}, audit string, ending int, "
        "paths array<struct<part: bigint, place: bigint, states: string>>")


def _pieces(spans: DataFrame, decided: DataFrame) -> DataFrame:
    """``conversation, place, span, piece``: the repaired lines of every span that has any, and of the insertions at the end."""
    path = F.explode("paths").alias("at")
    states = (decided.select(path).select("at.part", "at.place", F.posexplode(F.split("at.states", "")).alias("span", "p"),
                                          F.col("at.states").alias("states"))
              .where(F.col("span") < F.length("states") - 1)
              .select("part", "place", F.col("span").cast("long").alias("span"), F.col("p").cast("int").alias("p"),
                      F.substring("states", F.col("span") + 2, F.lit(1)).cast("int").alias("q")))
    kind = spans.schema[0].dataType.simpleString()

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for held, p, q in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                rows = [Row(**row) for row in held]
                cell = parsed([row.cell() for row in rows])
                lines = rebuilt(rows, cell[p][q][1], p)
                pieces.append("\n".join(lines) if lines else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(pieces, pa.string())], names=["conversation", "place", "span", "piece"])

    rows = spans.join(states, ["part", "span"]).select("conversation", "place", "span", "rows", "p", "q")
    pieces = rows.mapInArrow(rebuild, f"conversation {kind}, place long, span long, piece string")
    tail = F.element_at(F.array(*[F.lit("\n".join(f"{ROLES[i]}:" for i in TAILS[q])) for q in STATES]), F.col("ending") + 1)
    after = F.lit((1 << 63) - 1)
    return (pieces.where("piece is not null")
            .unionByName(decided.select("conversation", after.alias("place"), after.alias("span"), tail.alias("piece"))
                         .where("piece <> ''")))


def _hashed(pieces: DataFrame) -> DataFrame:
    """``conversation, repaired_sha256`` of the pieces joined by line ends, in one stream per conversation."""
    kind = pieces.schema[0].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conversation, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if state is None or conversation != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conversation, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(piece.as_buffer())
            kept = batch.schema[0].type
            yield _named(done, kept)
        if state is not None:
            yield _named([(now, state.hexdigest())], kept)

    def _named(done: list[tuple], kept: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], kept), pa.array([h for _, h in done], pa.string())],
            names=["conversation", "repaired_sha256"])

    return (pieces.repartition("conversation").sortWithinPartitions("conversation", "place", "span")
            .select("conversation", "piece").mapInArrow(digest, f"conversation {kind}, repaired_sha256 string"))


def repaired(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
             text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The repair of every conversation, and its repaired lines.

    The first table has ``id_column, gaps, blank, duplicate, truncated, illegal, cost, audit`` and
    ``ending``; the second ``conversation, place, span, piece``, whose pieces ordered by place and span and joined by line
    ends are the ``role:text`` of the repaired turns.

    Rows stand by turn (null first); rows of one turn by the SHA-256 of role and text, equal rows side by side. Null roles and
    texts are one space. A row is blank without a character other than white space, a duplicate if role
    and text stood before, truncated if its last such character is none of ``.!?``; the
    first that holds counts. A role counts by its first character; an empty one has none and cannot be
    kept. ``gaps`` is the number of turns missing between the first and the last. A null
    id is a conversation like any other; other columns are not read; an empty table gives empty tables.

    Equal rows are counted first, and rows are ordered by range over the whole table, so
    a conversation of any length is read by many tasks; each passes on one cell. Only cells (with their
    audits) come together by conversation.
    """
    conv, turn = F.col(id_column).alias("conversation"), F.col(turn_column).cast("long").alias("turn")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_column, "role"), (text_column, "text")))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    counted = stored(rows.select(conv, turn, role, text).groupBy("conversation", "turn", "role", "text")
                     .agg(F.count("*").alias("copies")).withColumn("digest", key))
    # Nulls come first: a turn is compared as (is not null, turn).
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = stored(counted.groupBy(F.col("conversation").alias("c"), F.col("digest").alias("d"))
                   .agg(F.min(order).alias("earliest"), F.count("*").alias("n")).where("n > 1").select("c", "d", "earliest"))
    same = counted["conversation"].eqNullSafe(again["c"]) & (counted["digest"] == again["d"])
    seen = F.coalesce(~order.eqNullSafe(F.col("earliest")) & F.col("d").isNotNull(), F.lit(False)).alias("seen")
    marked = counted.join(again, same, "left").select("conversation", "turn", "digest", "role", "text", "copies", seen)
    keys = ("conversation", "turn", "digest")
    held = stored(_spans(marked.repartitionByRange(*keys).sortWithinPartitions(*keys)))
    decided = stored(_decided(held.where("rows is null").drop("span", "rows")))
    pieces = _pieces(held.where("rows is not null").select("conversation", "part", "span", "rows"), decided)
    return decided.drop("paths").withColumnRenamed("conversation", id_column), pieces


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults, by the CRC-32 of ``conv_id:turn`` (a null is one space) modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row and 4 makes it the user's.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", known[2].alias("role"), known[3].alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return (rows.where("fault <> 0")
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), F.explode(copies).alias("copy")).drop("copy"))


def _null_safe(left: DataFrame, right: DataFrame, other: str) -> Column:
    return left["conv_id"].eqNullSafe(right[other])


def digests(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The repair of ``rows`` for every ``conv_id`` of ``conversations``, with the digest of the repaired lines.

    A conversation without rows has zeros, an empty audit and the digest of an empty string.
    """
    found, pieces = repaired(rows)
    hashed = _hashed(pieces)
    empty = hashlib.sha256().hexdigest()
    every = conversations.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "found_id")
    whole = every.join(found, _null_safe(every, found, "found_id"), "left").join(
        hashed, _null_safe(every, hashed, "conversation"), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
