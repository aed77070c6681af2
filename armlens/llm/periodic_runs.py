"""Periodic runs of words by multi-scale minimizers.

A run with period q in [2^s, 2^(s+1)) holds the same words at distance q, so a
window of a scale's length selects the same minimal k-gram in both places: pairs of
equal minimizers at such a distance seed the extension of a run. A k-gram that
has a short period itself is no minimizer; it lies in a run of that period, which a smaller
scale has found. That keeps equal minimizers apart by half of k, so each meets
a constant number of others. Two copies of a period that consist of such k-grams
only lie in two runs of one short period that touch, and are read off those.
Periods below the first scale are scanned lag by lag.

The texts of a batch are searched side by side as one sequence in which every text ends in a
number of its own; a scale only looks at the texts that are long enough for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Words that a run has at least.
LEAST_LENGTH = 12
# The first scale with minimizers; lags below two to this power are scanned directly.
FIRST_SCALE = 4
# Positions that an extension compares at a time.
STEP, HELD_POSITIONS = 64, 1 << 20
# Words of texts that are searched side by side; a longer text is searched alone.
TOGETHER_WORDS = 1 << 18
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Found:
    """Runs met so far, by period; a stretch belongs to its smallest period only."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    @classmethod
    def none(cls) -> Found:
        return cls(*(np.zeros(0, dtype=np.int64) for _ in range(3)))

    def add(self, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        """Take over stretches that are long enough and not known with a smaller period.

        If a stretch of two periods or more has a smaller one, it is the whole of a run
        of that period, with the same start and length.
        """
        enough = length >= np.maximum(LEAST_LENGTH, 2 * period)
        start, length, period = (np.concatenate([known, new[enough]]) for known, new in (
            (self.start, start), (self.length, length), (self.period, period)))
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        first = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
        self.start, self.length, self.period = start[first], length[first], period[first]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _reach(words: np.ndarray, at: np.ndarray, lag: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many positions from ``at`` on, in direction ``way``, equal the word ``lag`` further on; at most ``limit``."""
    reached, open_rows = np.zeros(len(at), dtype=np.int64), np.flatnonzero(limit > 0)
    step = STEP
    while len(open_rows):
        step = max(STEP, min(2 * step, HELD_POSITIONS // len(open_rows)))
        still = []
        for part in np.array_split(open_rows, -(-len(open_rows) * step // HELD_POSITIONS)):
            there = reached[part, None] + np.arange(step)
            place = at[part, None] + way * there
            inside = (there < limit[part, None]) & (place >= 0) & (place + lag[part, None] < len(words))
            place = np.where(inside, place, 0)
            same = inside & (words[place] == words[np.where(inside, place + lag[part, None], 0)])
            whole = same.all(axis=1)
            reached[part] += np.where(whole, step, np.argmin(same, axis=1))
            still.append(part[whole & (reached[part] < limit[part])])
        open_rows = np.concatenate(still)
    return reached


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and lag of the longest stretches around ``at`` that equal the words ``lag`` further on.

    Seeds of one lag only reach to the next of them, so a stretch is walked once.
    """
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    alone = np.append(True, (at[1:] != at[:-1]) | (lag[1:] != lag[:-1]))[:len(at)]
    at, lag = at[alone], lag[alone]
    if not len(at):
        return at, at, lag
    follows = np.append(lag[1:] == lag[:-1], False)
    limit = np.where(follows, np.append(at[1:], 0) - at, len(words))
    right = _reach(words, at, lag, limit, 1)
    joined = follows & (right == limit)
    last, first = np.flatnonzero(~joined), np.flatnonzero(~np.append(False, joined[:-1]))
    left = _reach(words, at[first] - 1, lag[first], np.full(len(first), len(words)), -1)
    start = at[first] - left
    return start, at[last] + right[last] - start + lag[first], lag[first]


def _sliding(values: np.ndarray, window: int, best) -> np.ndarray:
    """``best`` of every ``window`` neighbouring values, by doubling."""
    size, held = 1, values
    while 2 * size <= window:
        held = best(held[:-size], held[size:])
        size *= 2
    return best(held[:len(values) - window + 1], held[window - size:window - size + len(values) - window + 1])


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    held = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xD6E8FEB86659FD93)
    return held ^ (held >> np.uint64(32))


class _Grams:
    """Hashes of k neighbouring words, for growing k; a hash only proposes, words decide."""

    def __init__(self, words: np.ndarray):
        self.size, self.held = 1, _mixed(words.astype(np.uint64), np.full(len(words), 7, dtype=np.uint64))

    def of(self, k: int) -> np.ndarray:
        while 2 * self.size <= k:
            self.held = _mixed(self.held[:-self.size], self.held[self.size:])
            self.size *= 2
        if k == self.size:
            return self.held
        return _mixed(self.held[:len(self.held) - (k - self.size)], self.held[k - self.size:])


def _minimizer_pairs(hashes: np.ndarray, window: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of equal minimizers that are ``low`` or more, and less than twice as much, apart."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, window, np.minimum)
    # A k-gram is chosen if it is the least of a window around it.
    padded = np.concatenate([np.zeros(window - 1, dtype=np.uint64), least, np.zeros(window - 1, dtype=np.uint64)])
    chosen = np.flatnonzero((_sliding(padded, window, np.maximum) == hashes) & (hashes != NEVER))
    order = chosen[np.argsort(hashes[chosen], kind="stable")]
    value = hashes[order]
    left, distance = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step, open_rows = 1, np.arange(len(order))
    while len(open_rows):
        open_rows = open_rows[open_rows + step < len(order)]
        apart = order[open_rows + step] - order[open_rows]
        near = (value[open_rows + step] == value[open_rows]) & (apart < 2 * low)
        open_rows, apart = open_rows[near], apart[near]
        left.append(order[open_rows[apart >= low]])
        distance.append(apart[apart >= low])
        step += 1
    return np.concatenate(left), np.concatenate(distance)


def _touching(words: np.ndarray, found: Found, most: int, low: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, length and lag of stretches whose copies lie in two touching runs of one period up to ``most``.

    The lag is ``low`` or more and less than twice that. Where the lag leads the end of one run to that of
    the other, the stretch may go on; it is extended.
    """
    short = np.flatnonzero((found.period <= most) & (found.length >= low))
    order = short[np.lexsort((found.start[short], found.period[short]))]
    start, period = found.start[order], found.period[order]
    end = start + found.length[order]
    for i in np.flatnonzero((period[1:] == period[:-1]) & (end[:-1] >= start[1:])).tolist():
        q, a, b, c, d = int(period[i]), int(start[i]), int(end[i]), int(start[i + 1]), int(end[i + 1])
        first, second = words[a:a + q], words[c:c + q]
        # Where the second run's words stand in the period of the first.
        turns = [t for t in np.flatnonzero(first == second[0]).tolist() if np.array_equal(np.roll(first, -t), second)]
        if not turns:
            continue
        phase = (c - a - turns[0]) % q
        lag = np.arange(low + (phase - low) % q, 2 * low, q)
        left, right = np.maximum(a, c - lag), np.minimum(b, d - lag)
        lag, left, right = (v[right - left >= lag] for v in (lag, left, right))
        aligned = (a == c - lag) | (b == d - lag)
        yield left[~aligned], (right - left + lag)[~aligned], lag[~aligned]
        yield _extended(words, left[aligned], lag[aligned])


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers (0 or more) its runs as rows ``start, length, period``, by start and period."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    order = np.argsort(-lengths, kind="stable")
    # Long texts first, so that a scale has a prefix; each text ends in a number of its own.
    words = np.concatenate([part for i, n in enumerate(order.tolist()) for part in (texts[n], np.array([-1 - i]))]
                           + [np.zeros(0, dtype=np.int64)])
    sorted_lengths = lengths[order]
    offsets = np.concatenate(([0], np.cumsum(sorted_lengths + 1)))
    found = Found.none()
    for lag in range(1, 1 << FIRST_SCALE):
        part = words[:offsets[np.searchsorted(-sorted_lengths, -max(LEAST_LENGTH, 2 * lag), side="right")]]
        if not len(part):
            break
        start, end = _stretches(part[lag:] == part[:-lag])
        found.add(start, end - start + lag, np.full(len(start), lag, dtype=np.int64))
    grams, scale = _Grams(words), FIRST_SCALE
    while len(lengths) and 2 << scale <= sorted_lengths[0]:
        low = 1 << scale
        k = max(LEAST_LENGTH, low // 2)
        size = offsets[np.searchsorted(-sorted_lengths, -2 * low, side="right")]
        part, hashes = words[:size], grams.of(k)[:size - k + 1].copy()
        # k-grams that have a period of half of k or less lie in a known run.
        inside = np.flatnonzero((found.period <= k // 2) & (found.length >= k))
        if len(inside):
            edges = np.zeros(size + 2, dtype=np.int64)
            np.add.at(edges, np.minimum(found.start[inside], size), 1)
            np.add.at(edges, np.minimum((found.start + found.length)[inside] - k + 1, size), -1)
            hashes[np.cumsum(edges[:len(hashes)]) > 0] = NEVER
        stretches = [_extended(part, *_minimizer_pairs(hashes, low - k + 1, low)), *_touching(words, found, k // 2, low)]
        found.add(*(np.concatenate(column) for column in zip(*stretches)))
        scale += 1
    text = np.searchsorted(offsets, found.start, side="right") - 1
    by_text = np.lexsort((found.period, found.start, text))
    rows = np.stack([found.start - offsets[text], found.length, found.period], axis=1)[by_text]
    cuts = np.searchsorted(text[by_text], np.arange(len(texts) + 1))
    result = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    for i, n in enumerate(order.tolist()):
        result[n] = rows[cuts[i]:cuts[i + 1]]
    return result


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def _together(counts: list[int]) -> Iterator[range]:
    """Ranges of neighbouring texts of at most ``TOGETHER_WORDS`` words, or of one text."""
    start = total = 0
    for at, count in enumerate(counts):
        if at > start and total + count > TOGETHER_WORDS:
            yield range(start, at)
            start, total = at, 0
        total += count
    if counts:
        yield range(start, len(counts))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, runs, collapsed`` for every row of ``docs``.

    Words are what is between white space (space, tab to carriage return), numbered from 0. ``runs``
    is an array of ``(start, length, period)``, by start and period: the stretches with
    smallest period ``period`` and at least 12 words and two periods, that no
    neighbouring word extends. ``collapsed`` is the text without the words that a run
    contains after its first period, joined by single spaces.

    Null and empty texts have no runs and an empty text. A long text is searched whole, in one task.
    Repeated rows give repeated rows; a null id stays null; other columns of ``docs`` are not read;
    an empty table gives no rows.
    """
    entry = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [text.as_py().encode("utf-8").split() for text in batch.column(1)]
            for some in _together([len(words) for words in split]):
                numbers: dict[bytes, int] = {}
                texts = [np.fromiter((numbers.setdefault(word, len(numbers)) for word in split[i]), dtype=np.int64,
                                     count=len(split[i])) for i in some]
                runs = runs_of(texts)
                collapsed = []
                for i, found in zip(some, runs):
                    words = split[i]
                    if len(found):
                        words = [words[at] for at in np.flatnonzero(kept_words(len(words), found)).tolist()]
                    collapsed.append(b" ".join(words).decode("utf-8"))
                rows = np.concatenate([np.zeros((0, 3), dtype=np.int64), *runs])
                offsets = np.concatenate(([0], np.cumsum([len(found) for found in runs]))).astype(np.int32)
                entries = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(entry))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(some.start, len(some)), pa.ListArray.from_arrays(pa.array(offsets), entries),
                     pa.array(collapsed, pa.string())], names=[id_column, "runs", "collapsed"])

    rows = docs.select(F.col(id_column), whole_text(text_column).alias("text_to_search"))
    return rows.mapInArrow(
        of_batches, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, text_column`` of ``docs``; in a tenth of the texts, by a hash of the id, all words from some place on repeat.

    With ``h`` the CRC-32 of the decimal id and ``g = floor(h / 10)``, texts with ``h % 10 = 0``
    and n words get at each place ``i >= a = g % n`` the word of place
    ``a + (i - a) % p``, ``p = 1 + floor((n - a) / (3 + g % 8))``. Texts without words
    and rows with a null id stay as they are; a null text is empty.
    """
    text = whole_text(text_column)
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    rows = docs.select(F.col(id_column), text.alias("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = F.filter(F.split(F.col("text"), r"[ \t-\r]+"), lambda word: word != "")
    rows = rows.select(id_column, "text", "g", F.when(F.col("g").isNotNull(), words).alias("words"))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.array_join(F.concat(
        F.slice("words", 1, F.col("a").cast("int")),
        F.transform(F.sequence(F.col("a"), (n - 1).cast("long")),
                    lambda i: F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))), " ")
    return rows.select(id_column, F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias(text_column))


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the number of runs, the longest run, and digests of all runs and of the collapsed text.

    Of equally long runs the one with the smallest start, then period, counts as the longest; without a run its columns
    are null. ``exponent_milli`` is ``floor(1000 * length / period)``.
    """
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = periodic_runs(docs, id_column, text_column).select("*", longest.alias("top"))
    return rows.select(
        F.col(id_column), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.shorter")).alias("period"),
        F.expr("1000 * top.length div -top.shorter").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
