"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training rows are a bounded sample in three parts, dealt by a hash of the id: the
lexicon comes from the first, the trees from the second, the calibration from the
third, so that no step learns from words that an earlier one picked for the same
rows. Scoring reads whole texts and nothing else.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from .common import whole_text

# Labelled rows that are learned from, and lexicon entries that are kept.
SAMPLE_ROWS = 24_000
LEXICON_TERMS = 4_000
# An entry needs this many toxic rows, and this log-odds.
SUPPORT = 3
LOG_ODDS = 1.5
# Prefixes of words are entries as well, written with a trailing star.
PREFIXES = (4, 5, 6)
# Words up to this far from a second-person word count as aimed at it.
NEAR = 6

# Second-person pronouns in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros vuestro".split())

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# Signs that stand in for letters in disguised spellings.
STAND_INS = "@$!*#|"

FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_max", "lexicon_distinct", "lexicon_hits", "prefix_density",
    "prefix_weight", "prefix_max", "prefix_hits", "second_person", "aimed", "capitals", "capital_runs",
    "exclamations", "questions", "other_marks", "digits", "disguised", "stretched", "word_length", "log_words")


# Classes of characters, looked up by code point; rarer scripts count as letters.
LETTER, UPPER, DIGIT, MARK, SPACE = range(5)
TABLE_SIZE = 0x3000


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    kinds = np.zeros(TABLE_SIZE + 1, dtype=np.uint8)
    for code in range(TABLE_SIZE):
        c = chr(code)
        kinds[code] = (SPACE if c.isspace() else UPPER if c.isupper() else DIGIT if c.isdigit()
                       else LETTER if c.isalpha() else MARK)
    return kinds


def terms_of(word: str) -> list[str]:
    """Lexicon entries that a lower-case word can match: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def features(text: str, lexicon: dict[str, float], cache: dict[str, tuple[float, float]]) -> list[float]:
    """The numbers of ``FEATURES`` for one whole text; ``cache`` keeps the weights of words met before."""
    words = WORD.findall(text.lower())
    n, length = max(1, len(words)), max(1, len(text))
    hits, whole, prefix, persons = [], [], [], []
    for i, word in enumerate(words):
        found = cache.get(word)
        if found is None:
            found = (lexicon.get(word, 0.0),
                     max((lexicon.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k), default=0.0))
            if len(cache) > 500_000:
                cache.clear()
            cache[word] = found
        if found[0] or found[1]:
            hits.append(i)
            if found[0]:
                whole.append((word, found[0]))
            if found[1]:
                prefix.append(found[1])
        if word in SECOND_PERSON:
            persons.append(i)
    aimed = 0
    if hits and persons:
        at = np.array(persons)
        place = np.searchsorted(at, hits)
        before = np.array(hits) - at[np.maximum(place - 1, 0)]
        after = at[np.minimum(place, len(at) - 1)] - np.array(hits)
        aimed = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = character_classes()[np.minimum(codes, TABLE_SIZE)]
    count = np.bincount(kinds, minlength=5)
    letters = max(1, int(count[LETTER] + count[UPPER]))
    letter = kinds <= UPPER
    stand_in = (kinds == DIGIT) | np.isin(codes, np.array([ord(c) for c in STAND_INS], dtype=np.uint32)) \
        if count[DIGIT] + count[MARK] else np.zeros(len(codes), dtype=bool)
    upper = kinds == UPPER
    same = letter[1:] & (codes[1:] == codes[:-1])
    return [
        len(whole) / n, sum(w for _, w in whole) / n, max((w for _, w in whole), default=0.0),
        float(len({w for w, _ in whole})), float(len(whole)), len(prefix) / n, sum(prefix) / n,
        max(prefix, default=0.0), float(len(prefix)), len(persons) / n, aimed / n, int(count[UPPER]) / letters,
        int((upper[1:] & upper[:-1]).sum()) / letters, text.count("!") / n, text.count("?") / n,
        int(count[MARK]) / length, int(count[DIGIT]) / length,
        int((stand_in[1:-1] & letter[:-2] & letter[2:]).sum()) / n, int((same[1:] & same[:-1]).sum()) / n,
        letters / n, math.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted regression trees on binned features, and the points of the calibration."""

    start: float
    trees: list[list[tuple[int, float, int, int, float]]]  # feature, cut, left, right, value
    knots: np.ndarray  # raw scores, rising
    levels: np.ndarray  # calibrated probabilities at the knots

    def raw(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for tree in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            feature = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            left, right = np.array([t[2] for t in tree]), np.array([t[3] for t in tree])
            value = np.array([t[4] for t in tree])
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                goes_left = rows[inner, feature[node]] <= cut[node]
                at[inner] = np.where(goes_left, left[node], right[node])
            total += value[at]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1; the calibration is a step function joined by straight lines."""
        if not len(rows):
            return np.zeros(0)
        return np.interp(self.raw(rows), self.knots, self.levels)


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, depth: int,
          rate: float, least: int, ridge: float) -> list[tuple[int, float, int, int, float]]:
    """One regression tree: the split with the greatest gain over histograms of gradients, level by level."""
    tree: list[tuple[int, float, int, int, float]] = []

    def leaf(rows: np.ndarray) -> int:
        tree.append((-1, 0.0, 0, 0, -rate * gradient[rows].sum() / (hessian[rows].sum() + ridge)))
        return len(tree) - 1

    def node(rows: np.ndarray, level: int) -> int:
        if level == depth or len(rows) < 2 * least:
            return leaf(rows)
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, -1, -1)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            size = len(cut) + 1
            sums = [np.bincount(bins[rows, f], weights=w, minlength=size).cumsum() for w in (g, h, np.ones(len(g)))]
            gl, hl, nl = (s[:-1] for s in sums)
            gr, hr, nr = (s[-1] - s[:-1] for s in sums)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
            gain[(nl < least) | (nr < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        if best[1] < 0:
            return leaf(rows)
        me = len(tree)
        tree.append((-1, 0.0, 0, 0, 0.0))
        left = bins[rows, best[1]] <= best[2]
        tree[me] = (best[1], float(cuts[best[1]][best[2]]), node(rows[left], level + 1),
                    node(rows[~left], level + 1), 0.0)
        return me

    node(np.arange(len(bins)), 0)
    return tree


def isotonic(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels that fit the labels best, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest raw score
    for x, y in zip(raw[order], labels[order]):
        blocks.append([float(y), 1.0, float(x), float(x)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    # One row of each label keeps the levels off 0 and 1.
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    levels = np.array([v for b in blocks for v in [(b[0] + 0.01) / (b[1] + 0.02)] * 2])
    return knots, np.maximum.accumulate(levels)


def fit_trees(rows: np.ndarray, labels: np.ndarray, calibration: np.ndarray, calibration_labels: np.ndarray,
              rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 5,
              ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss, then isotonic calibration on rows of their own."""
    prior = (labels.sum() + 0.5) / (len(labels) + 1.0)
    start = float(np.log(prior / (1 - prior)))
    cuts, binned = [], np.zeros(rows.shape, dtype=np.int64)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > bins:
            middles = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(middles)
        binned[:, f] = np.searchsorted(middles, rows[:, f], side="left")
    raw = np.full(len(rows), start)
    trees: list[list[tuple[int, float, int, int, float]]] = []
    model = Trees(start, trees, np.array([start]), np.array([prior]))
    if 0 < labels.sum() < len(labels):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            trees.append(_grow(binned, cuts, p - labels, p * (1 - p), depth, rate, least, ridge))
            raw += Trees(0.0, [trees[-1]], model.knots, model.levels).raw(rows)
    if 0 < calibration_labels.sum() < len(calibration_labels):
        model.knots, model.levels = isotonic(model.raw(calibration), calibration_labels)
    else:
        # Too few labels to calibrate: the trees' own probability.
        model.knots = np.linspace(-12, 12, 241)
        model.levels = 1 / (1 + np.exp(-model.knots))
    return model


def held_out(id_column: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % divisor == remainder, F.lit(False))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees


def _count_terms(rows: DataFrame) -> DataFrame:
    """``term, toxic, clean``: rows of either label that hold a term; added up per task first."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def emit() -> Iterator[pa.RecordBatch]:
            every = list(counts[0].keys() | counts[1].keys())
            for at in range(0, len(every), 20_000):
                part = every[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()),
                     pa.array([counts[0][t] for t in part], pa.int64())], names=["term", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                held = set(WORD.findall(text.as_py().lower()))
                counts[label].update({t for word in held for t in terms_of(word)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield from emit()
        yield from emit()

    return (rows.select("t", "label").mapInArrow(of_batches, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def feature_rows(rows: DataFrame, lexicon: dict[str, float], then, schema: str, text: str = "t") -> DataFrame:
    """``rows`` mapped batch by batch; ``then(batch, matrix)`` makes the output from the matrix of features."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, float]] = {}
        for batch in batches:
            if batch.num_rows:
                matrix = np.array([features(t.as_py(), lexicon, cache) for t in batch.column(text)])
                yield then(batch, matrix)

    return rows.mapInArrow(of_batches, schema)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "toxic", divisor: int = 5, remainder: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``sample_rows`` labelled rows whose id is not held out.

    The sample is those of the smallest hashes of the id. Several labels of an
    id count as the highest, and of several texts of an id the one with the smallest hash is learned from, so
    repeated ids add no rows; null labels and ids are not learned from. Without any label of
    one kind the model gives the share of the other.
    """
    chosen = stored(
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column, divisor, remainder))
        .groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample_rows))
    # The sample has a fixed bound, so every task can hold it.
    rows = (docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("t")).join(F.broadcast(chosen), "id")
            .groupBy("id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("label").alias("label")))
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(10))
    sampled = stored(rows.select("id", "t", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"),
                                 F.when(part < 5, 0).when(part < 8, 1).otherwise(2).alias("part")))
    first = sampled.where("part = 0")
    toxic, clean = (first.where(f"label = {v}").count() for v in (1, 0))
    odds = F.log((F.col("toxic") + 0.1) / F.lit(toxic + 0.2)) - F.log((F.col("clean") + 0.1) / F.lit(clean + 0.2))
    terms = (_count_terms(first).where(F.col("toxic") >= SUPPORT).withColumn("odds", odds)
             .where(F.col("odds") >= LOG_ODDS)
             .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON_TERMS).collect())
    lexicon = {r.term: min(float(r.odds), 8.0) for r in terms}

    def with_label(batch: pa.RecordBatch, matrix: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("part"), pa.array(list(matrix), pa.list_(pa.float64()))],
            names=["id", "label", "part", "x"])

    kind = sampled.schema["id"].dataType.simpleString()
    held = (feature_rows(sampled.where("part > 0"), lexicon, with_label,
                         f"id {kind}, label int, part int, x array<double>").orderBy("id", "x").collect())
    split = [[r for r in held if r.part == p] for p in (1, 2)]
    xs = [np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)) for rows in split]
    ys = [np.array([r.label for r in rows], dtype=float) for rows in split]
    return Model(lexicon, fit_trees(xs[0], ys[0], xs[1], ys[1]))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``doc`` (the row as it came), ``score`` in 0..1 for every row; null texts count as empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole_text(text_column).alias("t"))

    def with_score(batch: pa.RecordBatch, matrix: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(model.trees.score(matrix))], names=["doc", "score"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, score double"
    return feature_rows(rows, model.lexicon, with_score, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, held_out, score, predicted`` for every row of ``docs``.

    Scores depend on the text alone, so repeated rows get equal ones; null and
    empty texts are scored like any other. A row with a null id is not held out. An empty table
    gives no rows, and other columns are not read.
    """
    model = fit(docs, labels, id_column, text_column)
    scored = score(docs.select(id_column, text_column), model, text_column)
    return scored.select(
        F.col(f"doc.{id_column}").alias(id_column), held_out(f"doc.{id_column}", 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below 0.5, with all their columns, whatever their names.

    Null and empty texts are scored like any other, equal texts alike; repeated rows stay or go together. Null ids are
    not learned from but scored. An empty table gives no rows; without labels nothing is toxic.
    """
    model = fit(docs, labels, id_column, text_column)
    return score(docs, model, text_column).where("score < 0.5").select("doc.*")
