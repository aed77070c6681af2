"""Language of every word by a linear-chain conditional random field.

A word's features are its beginning, its ending, the letter n-grams inside it and
the word itself; a chain over the words of a text joins them with learned
transitions, and forward-backward gives each word's label probabilities. Training
texts are cut into pieces of one language and spliced, so that the transitions
learn how long a language lasts before a switch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import stored
from .common import whole_text
from .toxicity import held_out

# Texts learned from, characters of one, words of all, and features kept.
SAMPLE_TEXTS = 2_000
SAMPLE_CHARACTERS = 20_000
SAMPLE_WORDS = 160_000
FEATURE_ROWS = 1 << 16
# Lengths of spliced pieces in words.
PIECE_WORDS = (5, 40)
SWEEPS = 15
RATE = 0.5
RIDGE = 1e-5
# Words whose scores a task remembers.
CACHED_WORDS = 200_000
# Words in a stretch of the chain that is multiplied up on its own, so that long texts run in parallel.
STRETCH = 32
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def names_of(word: str) -> list[str]:
    """Features of a lower-case word: itself, and its n-grams of 2 to 4 letters with the word's edges as letters.

    The n-grams that hold an edge are its beginnings and endings.
    """
    e = f"<{word}>"
    size = len(e)
    return [e, *[e[i:i + 2] for i in range(size - 1)], *[e[i:i + 3] for i in range(size - 2)],
            *[e[i:i + 4] for i in range(size - 3)]]


@dataclass
class Model:
    labels: list[str]
    features: dict[str, int]  # feature -> row of the weights; others do not count
    weights: np.ndarray  # rows x labels
    transitions: np.ndarray  # labels x labels, log potentials
    start: np.ndarray  # log potentials of the first word

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials of each word's labels."""
        rows, sizes = [], []
        for word in words:
            found = [r for r in map(self.features.get, names_of(word)) if r is not None]
            rows.extend(found)
            sizes.append(len(found))
        out = np.zeros((len(words), len(self.labels)))
        size = np.array(sizes, dtype=np.int64)
        some = np.flatnonzero(size)
        if len(some):
            begins = (np.cumsum(size) - size)[some]
            out[some] = np.add.reduceat(self.weights[rows], begins, axis=0) / np.sqrt(size[some])[:, None]
        return out


def _normal(values: np.ndarray) -> np.ndarray:
    return values / values.sum(axis=-1, keepdims=True)


def marginals(potentials: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word by forward-backward over many texts at once.

    ``potentials`` are the words' label potentials, texts one after the other with
    ``lengths`` words each (at least 1). Texts are cut into stretches that run side
    by side; the product of a stretch's matrices carries messages across it, so
    only the stretches of one text run in sequence. Messages are scaled every few
    steps and stay in the floating range.
    """
    k = potentials.shape[1]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    per_text = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(lengths)), per_text)
    begin_of = np.cumsum(per_text) - per_text
    first = begins[owner] + (np.arange(len(owner)) - begin_of[owner]) * STRETCH
    size = np.minimum(STRETCH, ends[owner] - first)
    # Longest stretches first, so that the live ones are always a beginning of the arrays.
    order = np.argsort(-size, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, size = first[order], size[order]
    live = [int((size > t).sum()) for t in range(int(size[0]))]
    local = [potentials[first[:n] + t] for t, n in enumerate(live)]
    n_all = len(owner)

    product = np.tile(np.eye(k), (n_all, 1)).reshape(n_all, k, k)
    for t, n in enumerate(live):
        step = (product[:n].reshape(n * k, k) @ move).reshape(n, k, k) * local[t][:, None, :]
        product[:n] = step / step.sum(axis=(1, 2), keepdims=True) if t % 8 == 7 else step
    product /= product.sum(axis=(1, 2), keepdims=True)

    # Messages at the borders of stretches: one round for each place in a text, all texts at once.
    into, back = np.zeros((n_all, k)), np.ones((n_all, k))
    into[rank[begin_of]] = start @ np.linalg.pinv(move)  # so that the first move gives ``start``
    rounds = int(per_text.max())
    for r in range(1, rounds):
        at = begin_of[per_text > r] + r
        now, before = rank[at], rank[at - 1]
        into[now] = _normal(np.einsum("nk,nkj->nj", into[before], product[before]))
    for r in range(rounds - 2, -1, -1):
        at = begin_of[per_text > r + 1] + r
        now, after = rank[at], rank[at + 1]
        back[now] = _normal(np.einsum("nij,nj->ni", product[after], back[after]))

    forward, message = [], into
    for t, n in enumerate(live):
        message = message[:n] @ move * local[t]
        if t % 8 == 7:
            message = _normal(message)
        forward.append(message)
    out = np.empty_like(potentials)
    message = back[:live[-1]]
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        if n > len(message):
            message = np.concatenate([message, back[len(message):n]])
        out[first[:n] + t] = forward[t] * message
        message = (local[t] * message) @ move.T
        if t % 8 == 7:
            message = _normal(message)
    return _normal(out)


def _pair_sums(potentials: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words, and expected label pairs, over short texts of which many run in step."""
    k, n = potentials.shape[1], len(lengths)
    begins = np.cumsum(lengths) - lengths
    longest = int(lengths.max())
    forward = np.zeros((n, longest, k))
    message = np.tile(start, (n, 1))
    for t in range(longest):
        live = np.flatnonzero(lengths > t)
        base = message[live] @ move if t else message[live]
        message[live] = _normal(base * potentials[begins[live] + t])
        forward[live, t] = message[live]
    words, pairs = np.empty_like(potentials), np.zeros((k, k))
    message = np.ones((n, k))
    for t in range(longest - 1, -1, -1):
        live = np.flatnonzero(lengths > t)
        words[begins[live] + t] = _normal(forward[live, t] * message[live])
        ahead = potentials[begins[live] + t] * message[live]
        if t:
            joint = forward[live, t - 1][:, :, None] * move[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        message[live] = _normal(ahead @ move.T)
    return words, pairs


def spliced(texts: list[tuple[list[str], int]], seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Pieces of the texts put together anew, about three to a chain, each piece with its text's label."""
    random = np.random.default_rng(seed)
    pieces = []
    for words, label in texts:
        at = 0
        while at < len(words):
            size = int(random.integers(*PIECE_WORDS))
            pieces.append((words[at:at + size], label))
            at += size
    random.shuffle(pieces)
    chains = []
    for at in range(0, len(pieces), 3):
        group = pieces[at:at + 3]
        chains.append(([w for words, _ in group for w in words], [y for words, y in group for _ in words]))
    return chains


def fit_chain(texts: list[tuple[list[str], int]], labels: list[str]) -> Model:
    """Weights by gradient steps on the chain's likelihood, each weight with a rate of its own."""
    chains = spliced(texts)
    k = len(labels)
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in chains for w in words}))}
    seen_in = Counter(name for word in vocabulary for name in set(names_of(word)))
    # The commonest features, in a fixed order.
    chosen = sorted(seen_in, key=lambda name: (-seen_in[name], name))[:FEATURE_ROWS]
    features = {name: i for i, name in enumerate(chosen)}
    model = Model(labels, features, np.zeros((len(features), k)), np.zeros((k, k)), np.zeros(k))
    if not chains or k < 2:
        return model
    rows = [[features[name] for name in names_of(w) if name in features] or [0] for w in vocabulary]
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.array(r) for r in rows])
    cuts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    scale = 1 / np.sqrt(sizes)
    word_of = np.repeat(np.arange(len(rows)), sizes)
    words = np.array([vocabulary[w] for chain, _ in chains for w in chain])
    truth = np.array([y for _, chain in chains for y in chain])
    lengths = np.array([len(chain) for chain, _ in chains])
    begins = np.cumsum(lengths) - lengths
    inner = np.ones(len(truth), dtype=bool)
    inner[begins] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    first_seen = np.bincount(truth[begins], minlength=k)
    target = np.eye(k)[truth]
    squares = [np.full_like(model.weights, 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)]
    for _ in range(SWEEPS):
        scores = np.add.reduceat(model.weights[flat], cuts, axis=0) * scale[:, None]
        local = np.exp(scores - scores.max(axis=1, keepdims=True))[words]
        move, start = np.exp(model.transitions), np.exp(model.start)
        expected, pairs = _pair_sums(local, lengths, move, start)
        miss = target - expected
        by_word = np.stack([np.bincount(words, weights=miss[:, c], minlength=len(rows)) for c in range(k)], axis=1)
        by_word *= scale[:, None] / len(truth)
        by_feature = np.stack([np.bincount(flat, weights=by_word[word_of, c], minlength=len(features)) for c in range(k)], axis=1)
        steps = [by_feature - RIDGE * model.weights / len(truth), (seen - pairs) / len(truth),
                 (first_seen - expected[begins].sum(axis=0)) / len(lengths)]
        for values, step, square in zip((model.weights, model.transitions, model.start), steps, squares):
            square += step**2
            values += RATE * step / np.sqrt(square)
    return model


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
        divisor: int = 4, remainder: int = 2) -> Model:
    """A model of all labels, from at most ``SAMPLE_TEXTS`` texts (one a label at least) whose id is not held out.

    They are those of the smallest hashes of id and text, an equal number for each label, cut at
    ``SAMPLE_CHARACTERS``; their words are used until the label's share of ``SAMPLE_WORDS`` is reached, the
    last text of a label as far as that. The labels and their transitions are held by the driver and by every task.
    """
    usable = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull()
                        & ~held_out(id_column, divisor, remainder))
    rows = usable.select(F.col(id_column).alias("id"), whole_text(text_column).alias("t"), F.col(label_column).alias("y"))
    counted = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    labels = sorted(counted)
    if not labels:
        return Model([UNKNOWN], {}, np.zeros((0, 1)), np.zeros((1, 1)), np.zeros(1))
    each, budget = max(1, SAMPLE_TEXTS // len(labels)), max(1, SAMPLE_WORDS // len(labels))
    # Rows are thinned by a hash before the sort, with twice what is needed left over.
    wanted = {y: min(1.0, 2.0 * each / n + 20.0 / n) for y, n in counted.items()}
    share = F.create_map(*[v for y, p in wanted.items() for v in (F.lit(y), F.lit(p))])[F.col("y")]
    mark = F.xxhash64("id", "t", F.lit(3))
    thinned = rows.withColumn("h", mark).where((F.col("h") / F.lit(2.0**64) + 0.5) < share)
    thinned = stored(thinned.withColumn("t", F.substring("t", 1, SAMPLE_CHARACTERS)))
    place = F.row_number().over(Window.partitionBy("y").orderBy("h", "id"))
    sample = thinned.withColumn("place", place).where(F.col("place") <= each).orderBy("y", "place").select("t", "y")
    texts: list[tuple[list[str], int]] = []
    held: Counter[str] = Counter()
    for row in sample.toLocalIterator():
        words = WORD.findall(row.t.lower())[:budget - held[row.y]]
        if words:
            texts.append((words, labels.index(row.y)))
            held[row.y] += len(words)
    return fit_chain(texts, labels)


def label_words(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text",
                with_words: bool = False) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and, if asked for, each word's label, for every row.

    The predicted language has the greatest expected share of the words, and the
    score is that share. Texts that are null or have no letter are ``und`` with score 0.
    """
    k = len(model.labels)
    move, start = np.exp(model.transitions), np.exp(model.start)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, k))
        for batch in batches:
            words = [WORD.findall(t.as_py().lower()) for t in batch.column(1)]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            flat = [w for some in words for w in some]
            if len(known) > CACHED_WORDS:
                known, table = {}, np.zeros((0, k))
            new = [w for w in dict.fromkeys(flat) if w not in known]
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new))))
                scores = model.emissions(new)
                table = np.concatenate([table, np.exp(scores - scores.max(axis=1, keepdims=True))])
            shares = np.zeros((len(words), k))
            chosen: list[list[str]] = [[] for _ in words]
            some = np.flatnonzero(lengths)
            if len(some):
                local = table[np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))]
                found = marginals(local, lengths[some], move, start)
                begins = np.cumsum(lengths[some]) - lengths[some]
                shares[some] = np.add.reduceat(found, begins, axis=0) / lengths[some][:, None]
                if with_words:
                    best = [model.labels[i] for i in found.argmax(axis=1)]
                    for row, begin in zip(some, begins):
                        chosen[row] = best[begin:begin + lengths[row]]
            pick = shares.argmax(axis=1) if len(words) else np.zeros(0, dtype=np.int64)
            predicted = [model.labels[p] if n else UNKNOWN for p, n in zip(pick, lengths)]
            score = np.where(lengths > 0, shares[np.arange(len(words)), pick], 0.0) if len(words) else np.zeros(0)
            columns = [batch.column(0), pa.array(predicted, pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
            names = ["id", "lang_pred", "score"]
            if with_words:
                columns.append(pa.array(chosen, pa.list_(pa.string())))
                names.append("word_labels")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(of_batches, schema + (", word_labels array<string>" if with_words else ""))


def languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """``id_column, held_out, lang_pred, score`` for every row of ``docs``.

    Predictions depend on the text alone. Rows with a null id are not held out but
    not learned from either, nor are null labels; repeated rows give repeated rows;
    other columns are not read; an empty table gives no rows, and without any label
    every text is ``und``.
    """
    model = fit(docs, id_column, text_column, label_column)
    return label_words(docs, model, id_column, text_column).select(
        F.col("id").alias(id_column), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")
