"""Byte-level BPE encoding with a segment tree of pair ranks, and decoding.

A text is split by the vocabulary's pattern. A match that is no token itself starts
as single bytes; a segment tree over the byte positions holds the rank of the
pair that starts at each, with its position, so its root is the leftmost pair
of least rank. A merge changes three leaves: the pair it makes, the pair to its
left, and the pair that is gone. Each is a point update of logarithmic cost, so a
match of n bytes takes O(n log n), however long it is.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# Above every rank.
NO_RANK = 1 << 40
# Matches that one worker remembers, and bytes of a match up to which it is remembered and merged together with others.
REMEMBERED = 1 << 19
TOGETHER_BYTES = 33
# Matches that are turned into ids at a time, which bounds the memory of a very long text.
MATCHES = 1 << 16
# Characters up to which a text is split at once, which is faster.
WHOLE_SPLIT = 1 << 18


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``word`` after merging the leftmost pair of least rank until no pair has a rank."""
    n = len(word)
    if n < 2:
        return [ranks[word]] if word else []
    get, limit = ranks.get, NO_RANK * n
    # A leaf is rank * n + position, ``limit`` or more where no pair starts; node k has the children 2k and 2k + 1.
    size = 1 << (n - 2).bit_length()
    level = [get(word[at:at + 2], NO_RANK) * n + at for at in range(n - 1)] + [limit] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [limit, *tree]
    # Neighbours of the live pieces; position n stands for the end.
    after, before = [*range(1, n + 1), n], [*range(-1, n)]
    while tree[1] < limit:
        at = tree[1] % n
        gone = after[at]
        end = after[at] = after[gone]
        before[end] = at
        changed = [(at, get(word[at:after[end]], NO_RANK) * n + at if end < n else limit)]
        if gone < n - 1:
            changed.append((gone, limit))
        left = before[at]
        if left >= 0:
            changed.append((left, get(word[left:end], NO_RANK) * n + left))
        for place, key in changed:
            node = size + place
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                if other < key:
                    key = other
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at:after[at]]])
        at = after[at]
    return ids


class Pairs:
    """Ranks of pairs of ids as arrays, so that many words merge at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = sorted(
            (left << 32 | right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None)
        self.keys = np.array([key for key, _ in found] + [1 << 62], dtype=np.int64)
        self.ranks = np.array([rank for _, rank in found] + [NO_RANK], dtype=np.int64)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


def merged_together(words: list[bytes], pairs: Pairs) -> list[tuple[int, ...]]:
    """``merged`` of words of two bytes or more, whose trees are the rows of one matrix."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    m, size = len(words), 1 << (int(lengths.max()) - 2).bit_length()
    # Positions 0 to size hold pieces; one more stands for the end, and a last one for what lies before the start.
    width = size + 3
    held = np.frombuffer(b"".join(word.ljust(size + 1, b"\0") for word in words), dtype=np.uint8).reshape(m, size + 1)
    pieces = np.zeros((m, width), dtype=np.int64)
    pieces[:, :size + 1] = pairs.of_byte[held]
    alive = np.arange(width) < lengths[:, None]
    place = np.arange(size)
    starts = place < lengths[:, None] - 1
    trees = np.empty((m, 2 * size), dtype=np.int64)
    trees[:, size:] = np.where(starts, pairs(pieces[:, :size], pieces[:, 1:size + 1]), NO_RANK) * size + place
    node = size
    while node > 1:
        trees[:, node // 2:node] = np.minimum(trees[:, node:2 * node:2], trees[:, node + 1:2 * node:2])
        node //= 2
    after = np.tile(np.arange(1, width + 1), m)
    before = np.tile(np.arange(-1, width - 1), m)
    trees, pieces, alive = trees.reshape(-1), pieces.reshape(-1), alive.reshape(-1)
    limit = NO_RANK * size
    rows = np.arange(m)
    while True:
        root = trees[rows * (2 * size) + 1]
        open_rows = root < limit
        rows, root = rows[open_rows], root[open_rows]
        if not len(rows):
            break
        line, top = rows * width, rows * (2 * size)
        at, rank = root % size, root // size
        gone = after[line + at]
        end = after[line + gone]
        after[line + at], before[line + end] = end, at
        pieces[line + at], alive[line + gone] = rank, False
        left = before[line + at]
        first, last = left < 0, end >= lengths[rows]
        mine = np.where(last, NO_RANK, pairs(rank, pieces[line + np.where(last, 0, end)])) * size + at
        theirs = pairs(pieces[line + np.where(first, 0, left)], rank) * size + left
        # A change that a row does not have repeats the one at its merged pair.
        beyond = gone >= size
        nodes = [size + at, size + np.where(beyond, at, gone), size + np.where(first, at, left)]
        for node, key in zip(nodes, (mine, np.where(beyond, mine, limit), np.where(first, mine, theirs))):
            trees[top + node] = key
        for _ in range(size.bit_length() - 1):
            for i, node in enumerate(nodes):
                nodes[i] = node >> 1
                below = top + (node | 1)
                trees[top + nodes[i]] = np.minimum(trees[below], trees[below - 1])
    counts = np.cumsum(alive.reshape(m, width).sum(axis=1)).tolist()
    ids = pieces[alive].tolist()
    return [tuple(ids[start:stop]) for start, stop in zip([0, *counts], counts)]


@lru_cache(maxsize=2)
def _pairs(path: str) -> Pairs:
    return Pairs(read_ranks(path))


class Words:
    """Ids of the matches met so far, as many as are worth remembering."""

    def __init__(self, path: str):
        self.ranks, self.pairs, self.known = read_ranks(path), _pairs(path), {}

    def ids(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The ids of the words of each part, one behind the other."""
        known = self.known
        every = set().union(*parts)
        new = every.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = every
        long, by_size = [], defaultdict(list)
        for word in new:
            held = word.encode("utf-8")
            whole = self.ranks.get(held)
            if whole is not None or len(held) < 2:
                known[word] = (self.ranks[held],)
            elif len(held) <= TOGETHER_BYTES:
                by_size[(len(held) - 2).bit_length()].append((word, held))
            else:
                known[word] = merged(held, self.ranks)
                long.append(word)
        for some in by_size.values():
            known.update(zip([word for word, _ in some], merged_together([held for _, held in some], self.pairs)))
        found = [np.fromiter(chain.from_iterable(map(known.__getitem__, words)), dtype=np.int32) for words in parts]
        for word in long:
            del known[word]
        return found


@lru_cache(maxsize=1)
def _stand_ins() -> dict[int, str]:
    """Characters that ``regex`` and ``tiktoken`` class differently, each with one of the class it has in ``tiktoken``.

    The two libraries may know different versions of Unicode.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    named, differ = {}, set()
    for kind, example in ((r"\p{L}", "א"), (r"\p{N}", "²")):
        theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
        letters = set(bytes(theirs.encode_ordinary(every)).decode("utf-8"))
        differ |= letters ^ set(regex.findall(kind, every))
        named |= dict.fromkeys(letters, example)
    return {ord(c): named.get(c, "") for c in differ}


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Callable[[str], Iterator[str]]:
    """A function from text to the matches of ``pattern`` in it, with the letters and numbers that ``tiktoken`` knows."""
    compiled, stand_ins = regex.compile(pattern), _stand_ins()
    rare = frozenset(map(chr, stand_ins))

    def split(text: str) -> Iterator[str]:
        if text.isascii() or rare.isdisjoint(text):
            if len(text) <= WHOLE_SPLIT:
                return iter(compiled.findall(text))
            return map(regex.Match.group, compiled.finditer(text))
        return (text[m.start():m.end()] for m in compiled.finditer(text.translate(stand_ins)))

    return split


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, ids`` for every row of ``docs``: the ids (array of int) of its whole text, without special tokens.

    ``path`` names a file of ranks that every executor has. Characters that
    ``pattern`` does not match are left out, as ``tiktoken`` leaves them. Null and
    empty texts have no ids. A very long text is split in one stream; a null id stays
    null; repeated rows give repeated rows; other columns of ``docs`` are not read;
    an empty table gives no rows.
    """

    def blocks(texts: Iterable[str]) -> Iterator[list[tuple[int, list[str]]]]:
        """Numbers of texts with their matches, a block of matches at a time."""
        split, held, size = splitter(pattern), [], 0
        for number, text in enumerate(texts):
            for words in batched(split(text), MATCHES):
                held.append((number, words))
                size += len(words)
                if size >= MATCHES:
                    yield held
                    held, size = [], 0
        yield held

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(path)
        for batch in batches:
            ids, lengths = [np.zeros(0, dtype=np.int32)], np.zeros(batch.num_rows, dtype=np.int64)
            for block in blocks(text.as_py() for text in batch.column(1)):
                for (number, _), found in zip(block, known.ids([words for _, words in block])):
                    ids.append(found)
                    lengths[number] += len(found)
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            held = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=[id_column, "ids"])

    rows = docs.select(F.col(id_column), whole_text(text_column).alias("text_to_encode"))
    return rows.mapInArrow(of_batches, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column, ids, decoded`` for every row of ``tokens``: the bytes that its ids stand for, joined.

    Ids need not be those of whole characters, so the result is binary. A null list
    decodes to null, null ids in a list are left out of ``ids`` and ``decoded``, an empty list is empty
    bytes; an id that the file does not have raises ValueError. Repeated rows, null
    ``id_column``, other columns and empty tables are as in ``encode``.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        names = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            names[rank] = token
        token_of, known = pa.array(names, pa.large_binary()), np.array([bool(n) for n in names])
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(known) or not known[ids].all()):
                raise ValueError(f"an id that {path} does not have")
            # The values of the tokens lie one behind the other, so a row is a slice of them.
            tokens_of_batch = token_of.take(pa.array(ids))
            ends = np.frombuffer(tokens_of_batch.buffers()[1], dtype=np.int64)
            data = tokens_of_batch.buffers()[2] or pa.py_buffer(b"")
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = ends[np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))].tolist()
            absent = lists.is_null().to_pylist()
            held = [None if a else data.slice(start, end - start) for a, start, end in zip(absent, cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array([b if b is None else b.to_pybytes() for b in held], pa.binary())],
                names=[id_column, "ids", "decoded"])

    rows = tokens.select(F.col(id_column), F.array_compact(F.col(ids_column).cast("array<int>")).alias("ids"))
    return rows.mapInArrow(
        of_batches, f"`{id_column}` {rows.schema[0].dataType.simpleString()}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded again.

    The digests are lower-case hex, of the decimal ids joined by commas and of the
    decoded bytes; rows are as in ``encode``.
    """
    tokens = decode(encode(docs, path, pattern, id_column, text_column), path, id_column)
    return tokens.select(
        F.col(id_column), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
