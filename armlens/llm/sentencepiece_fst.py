"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Normaliser, pieces and byte fallback are compiled from the model file into arcs.
A text is composed with them word by word: its lattice has a state per place and
last piece, an arc per piece that goes on from there, and byte arcs for characters that
no piece covers. Weights add up along a path and the least sum wins (the tropical
semiring), so the shortest path is the encoding. For models that merge pairs, an
arc exists only if its piece and the one before it stay apart when their letters are
merged from scratch; exactly one path is then left, which is the model's own encoding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

SPACE = "▁"
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Stretches of text whose encoding, and pairs of pieces whose compatibility, a task remembers.
CACHED_WORDS = 400_000
CACHED_PAIRS = 400_000
# Stretches longer than this are not remembered.
LONG_WORD = 64


class Transducer:
    """The arcs of one model file, and shortest paths through their composition with a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normaliser = model.normalizer_spec
        if normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or not normaliser.escape_whitespaces:
            raise ValueError("only normalisers that keep all characters and mark spaces are compiled")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with leading space marks are compiled")
        self.prefix = SPACE if normaliser.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == BPE
        self.byte_fallback = model.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        if any(kind == USER_DEFINED for kind in self.kinds):
            raise ValueError("user-defined pieces are not compiled")
        self.scores: dict[str, float] = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.unknown = next(i for i, kind in enumerate(self.kinds) if kind == UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        # The trie of pieces: a dictionary for each letter, and the piece itself under the empty string.
        self.trie: dict = {}
        for piece in self.scores:
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        self.bare_weight = 10.0 - min(self.scores.values(), default=0.0)
        # No piece goes on after a letter with a space mark, so marks begin stretches that encode on their own.
        if any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            raise ValueError("pieces over several words are not compiled")
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.held_pairs = 0
        # What each id is decoded to.
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == BYTE else " \u2047 ".encode() if kind == UNKNOWN
                         else b"" if kind == CONTROL else p.replace(SPACE, " ").encode("utf-8")
                         for p, kind in zip(self.pieces, self.kinds)]
        # Letters that some piece has side by side; between others no arc passes, so paths can be cut there.
        self.joined = {piece[i:i + 2] for piece in self.scores for i in range(len(piece) - 1)}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the letters of both gives these two pieces again."""
        known = self.pairs.get(left)
        if known is None:
            known = self.pairs[left] = {}
        apart = known.get(right)
        if apart is None:
            if self.held_pairs > CACHED_PAIRS:
                self.pairs, self.held_pairs = {}, 0
            apart = known[right] = self.merged(left + right) == [left, right]
            self.held_pairs += 1
        return apart

    def shortest_path(self, text: str) -> list[str]:
        """Labels along the shortest path over the composition of ``text`` with the pieces.

        From each place reached, arcs go along the trie of pieces; a bare character
        that is no piece has an arc of its own. Each place keeps its best
        state: without the constraint the last label does not matter for what
        follows, and with it only one label reaches a place at all, as a beginning
        of a text has one encoding.
        """
        merges, pairs = self.merges, self.pairs
        none: dict[str, bool] = {}
        size = len(text)
        last: list[str | None] = [None] * (size + 1)
        cost = [0.0] * (size + 1)
        last[0] = ""
        for at in range(size):
            before = last[at]
            if before is None:
                continue
            node, end, base = self.trie, at, cost[at]
            known = pairs.get(before, none)
            while end < size:
                node = node.get(text[end])
                if node is None:
                    break
                end += 1
                label = node.get("")
                if label is None:
                    continue
                if merges and before:
                    apart = known.get(label)
                    if apart is None:
                        apart = self.stay_apart(before, label)
                    if not apart:
                        continue
                # Where the constraint decides, all pieces weigh one.
                total = base + (1.0 if merges else -self.scores[label])
                if last[end] is None or total < cost[end]:
                    last[end], cost[end] = label, total
            letter = text[at]
            if letter not in self.scores and (not merges or not before or self.stay_apart(before, letter)):
                total = base + self.bare_weight
                if last[at + 1] is None or total < cost[at + 1]:
                    last[at + 1], cost[at + 1] = letter, total
        path, at = [], size
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def only_path(self, text: str) -> list[str]:
        """The same for a model that merges pairs, whose composition holds one path: long arcs are followed first.

        A beginning of the text has one encoding, so a place is always reached with the same last label: one
        that nothing leads on from is not tried again, and no place is left twice.
        """
        trie, scores, pairs = self.trie, self.scores, self.pairs
        none: dict[str, bool] = {}
        size = len(text)
        dead = bytearray(size + 1)
        path: list[str] = []
        held: list[list[str]] = []
        at, before, known = 0, "", none
        while at < size:
            node, end = trie.get(text[at]), at + 1
            # Arcs that leave this place, the longest last.
            arcs = [] if text[at] in scores else [text[at]]
            while node is not None:
                label = node.get("")
                if label is not None:
                    arcs.append(label)
                if end == size:
                    break
                node = node.get(text[end])
                end += 1
            while True:
                if not arcs:
                    dead[at] = 1
                    at -= len(path.pop())
                    before = path[-1] if path else ""
                    known = pairs.get(before, none)
                    arcs = held.pop()
                    continue
                label = arcs.pop()
                if dead[at + len(label)]:
                    continue
                if before:
                    apart = known.get(label)
                    if apart is None:
                        apart = self.stay_apart(before, label)
                    if not apart:
                        continue
                break
            path.append(label)
            held.append(arcs)
            at += len(label)
            before = label
            known = pairs.get(before, none)
        return path

    def ids_of(self, label: str) -> list[int]:
        """Output of an arc: a piece's id, or the ids of the character's bytes, or the unknown piece."""
        if label in self.ids:
            return [self.ids[label]]
        if self.byte_fallback:
            return [self.byte_ids[b] for b in label.encode("utf-8")]
        return [self.unknown]

    def encode_stretch(self, stretch: str) -> tuple[int, ...]:
        known = self.words.get(stretch)
        if known is None:
            joined = self.joined
            cuts = [i for i, two in enumerate(map(add, stretch, stretch[1:]), 1) if two not in joined]
            if cuts:
                parts = [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)])]
                known = tuple(i for part in parts for i in (self.words.get(part) or self.encode_stretch(part)))
            else:
                path = self.only_path(stretch) if self.merges else self.shortest_path(stretch)
                known = tuple(i for label in path for i in self.ids_of(label))
            if len(stretch) <= LONG_WORD:
                if len(self.words) > CACHED_WORDS:
                    self.words.clear()
                self.words[stretch] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of the pieces of a text; an empty text has none."""
        if not text:
            return []
        marked = self.prefix + text.replace(" ", SPACE)
        known = self.words
        out: list[int] = []
        for stretch in STRETCH.findall(marked):
            ids = known.get(stretch)
            out.extend(ids if ids is not None else self.encode_stretch(stretch))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces put together, bytes gathered, the prefix mark removed; control pieces are silent."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] not in (BYTE, UNKNOWN) and self.pieces[first].startswith(SPACE)
        return text[1:] if self.prefix and marked else text


STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, ids`` for every row of ``docs``: the piece ids of the whole text.

    Null and empty texts have no ids; null ids and repeated rows are encoded like
    any other row; other columns are not read; an empty table gives no rows.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = pa.array([coder.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("t"))
    found = rows.mapInArrow(of_batches, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return found.select(F.col("id").alias(id_column), "ids")


def decode(encoded: DataFrame, model: str, ids_column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``; null ids give a null text, unknown numbers are an error."""
    others = [c for c in encoded.columns if c != "text"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model)
        for batch in batches:
            texts = [None if v.as_py() is None else coder.decode(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(of_batches, f"row {rows.schema['row'].dataType.simpleString()}, text string").select("row.*", "text")


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encoding and its round trip in one pass: id, number of ids, their checksum, and whether decoding gives the text.

    Null and empty texts have no ids and a checksum of 0. Texts of any length are encoded whole, equal texts and repeated rows alike;
    a null id stays null, other columns are not read, and an empty table gives no rows.
    """
    import zlib

    import numpy as np

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(model)
        for batch in batches:
            counts, sums, same = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                ids = coder.encode(text)
                counts.append(len(ids))
                sums.append(zlib.crc32(np.frombuffer(array("i", ids), dtype=np.int32).astype("<u4").tobytes()))
                # A mark that stands in the text itself is decoded as a space, as the model file has it.
                same.append(coder.decode(ids) == text.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_())],
                names=["id", "n_ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("t"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean"
    return rows.mapInArrow(of_batches, schema).withColumnRenamed("id", id_column)
