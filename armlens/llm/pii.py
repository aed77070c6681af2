"""Personal data: fixed patterns, and terms that disclose what the patterns protect.

E-mail addresses, IP addresses, card and phone numbers are protected entities.
A term near an entity discloses it if seeing the term tells most of what there is
to know about which entity it is: with counts of documents over the whole corpus,
the pointwise mutual information of term and entity reaches a share of the
entity's information content. Such terms are generalised wherever they stand, in all
documents, or removed if they tell all of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import stored
from .common import row_ids, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Share of an entity's information that a term may disclose, and that counts as all of it.
DISCLOSURE = 0.9
FULL_DISCLOSURE = 0.999
# Documents in which a term has to be seen with an entity before it counts as evidence.
SUPPORT = 1
# Documents of background that evidence from a single document is weighed against.
BACKGROUND = 0.5
# Words on either side of an entity that are taken as evidence, and letters a term has at least.
WINDOW = 6
TERM_LETTERS = 4
# Distinct terms a task counts before it passes the counts on.
HELD_TERMS = 200_000
# Bits of the filter that tells which words of a text may be disclosing terms: so many a term, between a least and a most; the
# join decides. A text has hundreds of words, so few that are no term may pass.
TERM_BITS, LEAST_BITS, FILTER_BITS = 1024, 1 << 23, 1 << 26

# The patterns of the kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that is not followed by three more parts has no such start further on in the same digits.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)|(?<=\.)[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost first, in linear time."""
    spans, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return spans


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all kinds, by start and then kind; code points, end exclusive."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity_of(kind: int, value: str) -> str:
    """What a span protects, without differences in writing."""
    kept = value.lower() if kind == 0 else re.sub(r"[^0-9.]" if kind == 1 else r"[^0-9]", "", value)
    return f"{KINDS[kind]}:{kept}"


def nearby(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Terms within ``WINDOW`` words of each span: entity, term and place; ``first`` once per entity and term.

    Only the text around a span is read, so long texts cost no more.
    """
    out, seen = [], set()
    covered = [(a, b) for a, _, b in spans]
    for start, kind, end in spans:
        entity = entity_of(kind, text[start:end])
        # Words have few letters: this many characters hold the window; a longer word is cut off and left out.
        left, right = max(0, start - 40 * WINDOW), min(len(text), end + 40 * WINDOW)
        before = [m for m in WORD.finditer(text, left, start) if m.start() > left or left == 0][-WINDOW:]
        after = [m for m in WORD.finditer(text, end, right) if m.end() < right or right == len(text)][:WINDOW]
        for m in before + after:
            if m.end() - m.start() < TERM_LETTERS or any(a < m.end() and m.start() < b for a, b in covered):
                continue
            term = m[0].lower()
            out.append({"entity": entity, "term": term, "start": m.start(), "end": m.end(),
                        "first": (entity, term) not in seen})
            seen.add((entity, term))
    return out


SPANS = "array<struct<start: long, kind: int, `end`: long>>"
NEAR = "array<struct<entity: string, term: string, start: long, `end`: long, first: boolean>>"


def scan(docs: DataFrame, text_column: str, carried: list[str], only_found: bool) -> DataFrame:
    """One pass over the texts, stored: rows with their spans and nearby terms, and counts of terms.

    Rows have a ``row_id`` and the ``carried`` columns in ``doc``; with
    ``only_found`` they are left out if they have no span. The others have
    ``term`` and ``holding``, a number of documents that hold it, added up over one task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("boolean")
    rows = docs.select(whole.alias("doc"), whole_text(text_column).alias("t"))
    types = (f"row_id long, doc {rows.schema['doc'].dataType.simpleString()}, base {SPANS}, near {NEAR}, "
             "term string, holding long")
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()),
                                    ("end", pa.int64()), ("first", pa.bool_())]))
    names = ["row_id", "doc", "base", "near", "term", "holding"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        doc_type, number = None, 0

        def terms() -> Iterator[pa.RecordBatch]:
            every = list(counts)
            for at in range(0, len(every), 20_000):
                part = every[at:at + 20_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, doc_type), pa.nulls(n, base_type), pa.nulls(n, near_type),
                     pa.array(part, pa.string()), pa.array([counts[t] for t in part], pa.int64())], names=names)
            counts.clear()

        for batch in batches:
            doc_type = batch.column(0).type
            bases, nears, kept = [], [], []
            for place, value in enumerate(batch.column(1)):
                text = value.as_py()
                spans = base_spans(text)
                counts.update({w for w in WORD.findall(text.lower()) if len(w) >= TERM_LETTERS})
                if only_found and not spans:
                    continue
                kept.append(place)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                nears.append(nearby(text, spans) if spans else [])
            n = len(kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids(number, n)), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(bases, base_type), pa.array(nears, near_type),
                 pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
            number += n
            if len(counts) > HELD_TERMS:
                yield from terms()
        if counts:
            yield from terms()

    return stored(rows.mapInArrow(of_batches, types))


def disclosing_terms(scanned: DataFrame, total: int, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``entity, term, share``: the share of the entity's information that the term tells, at or over the threshold.

    With N documents, n(e), n(t) and n(t, e) of them holding the entity, the term
    and both near each other, the share is log(N n(t, e) / (n(t) n(e))) over
    log(N / n(e)). An entity that is in every document has nothing to disclose.
    If they are near each other in a single document only, the share of the term's
    documents that hold the entity is not n(t, e) / n(t) but shrunk towards the
    entity's share of all documents, by ``BACKGROUND`` documents.
    """
    rows = scanned.where(F.col("row_id").isNotNull())
    near = rows.where(F.size("near") > 0).select("row_id", F.explode("near").alias("n")).select("row_id", "n.*")
    pairs = (near.where("first").groupBy("entity", "term").agg(F.count("*").alias("both"))
             .where(F.col("both") >= support))
    entities = near.select("row_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("with_entity"))
    terms = (scanned.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("holding").alias("with_term")))
    information = F.log(F.lit(float(max(total, 1))) / F.col("with_entity"))
    every = F.lit(float(max(total, 1)))
    shrunk = (1 + BACKGROUND * F.col("with_entity") / every) / (F.col("with_term") + BACKGROUND)
    known = F.when(F.col("both") > 1, F.col("both") / F.col("with_term")).otherwise(shrunk)
    told = F.log(known * every / F.col("with_entity"))
    return (pairs.join(entities, "entity").join(terms, "term")
            .withColumn("share", F.when(information > 0, told / information))
            .where(F.col("share") >= disclosure).select("entity", "term", "share"))


def _slot(term: str, size: int) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) % size


def term_filter(terms: DataFrame) -> bytes:
    """A bit for the slot of every ``term``, a power of two of them that grows with the number of terms.

    Up to ``FILTER_BITS / TERM_BITS`` terms one word in ``TERM_BITS`` that is no term passes at most. The filter itself is
    bounded: with more terms more words pass, and the join sorts them out.
    """
    n = terms.select("term").distinct().count()
    size = min(FILTER_BITS, max(LEAST_BITS, 1 << (TERM_BITS * n).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_slot(t.as_py(), size) for t in batch.column(0)], dtype=np.int64)
            place, at = np.unique(found >> 6, return_inverse=True)
            words = np.zeros(len(place), dtype=np.uint64)
            np.bitwise_or.at(words, at, np.uint64(1) << (found & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(words.view(np.int64))], names=["place", "word"])

    found = (terms.select("term").mapInArrow(slots, "place long, word long")
             .groupBy("place").agg(F.bit_or("word").alias("word")).toArrow())
    words = np.zeros(size >> 6, dtype="<i8")
    words[found["place"].to_numpy()] = found["word"].to_numpy()
    return words.tobytes()


class _Places:
    """Places in a text of words that pass a filter, outside of the fixed kinds' spans."""

    def __init__(self, bits: bytes):
        self.bits, self.known, self.any = bits, {}, any(bits)

    def passes(self, word: str) -> bool:
        known = self.known.get(word)
        if known is None:
            term = word.lower()
            slot = _slot(term, 8 * len(self.bits))
            known = bool(self.bits[slot >> 3] >> (slot & 7) & 1)
            if len(self.known) >= HELD_TERMS:
                self.known.clear()
            self.known[word] = known
        return known

    def of(self, text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
        """``term`` and ``places`` for each such word, with all its places."""
        if not self.any:
            return []
        wanted = {w for w in set(WORD.findall(text)) if len(w) >= TERM_LETTERS and self.passes(w)}
        if not wanted:
            return []
        places: dict[str, list[dict]] = {}
        at = 0
        covered = sorted((a, b) for a, _, b in spans)
        reach = 0
        for m in WORD.finditer(text):
            # The furthest end of the spans that begin before the end of the word.
            while at < len(covered) and covered[at][0] < m.end():
                reach = max(reach, covered[at][1])
                at += 1
            if m[0] in wanted and reach <= m.start():
                places.setdefault(m[0].lower(), []).append({"start": m.start(), "end": m.end()})
        return [{"term": t, "places": p} for t, p in places.items()]


HITS = "array<struct<term: string, places: array<struct<start: long, `end`: long>>>>"


def _found(docs: DataFrame, text_column: str, carried: list[str], bits: bytes, disclosing: DataFrame, only_found: bool) -> DataFrame:
    """Rows with ``row_id, doc, base`` and ``terms``: every place in the text of a term of ``disclosing``, and its share.

    With ``only_found`` rows without a span or a word that passes the filter are left out.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"), whole_text(text_column).alias("t"))
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    hits_type = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct(
        [("start", pa.int64()), ("end", pa.int64())])))]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, number = _Places(bits), 0
        for batch in batches:
            bases, hits, kept = [], [], []
            for place, value in enumerate(batch.column(1)):
                text = value.as_py()
                spans = base_spans(text)
                found = finder.of(text, spans)
                if only_found and not spans and not found:
                    continue
                kept.append(place)
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                hits.append(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids(number, len(kept))), batch.column(0).take(pa.array(kept, pa.int64())),
                 pa.array(bases, base_type), pa.array(hits, hits_type)], names=["row_id", "doc", "base", "hits"])
            number += len(kept)

    found = stored(rows.mapInArrow(
        of_batches, f"row_id long, doc {rows.schema['doc'].dataType.simpleString()}, base {SPANS}, hits {HITS}"))
    # A term that discloses several entities has the larger share.
    shares = disclosing.groupBy("term").agg(F.max("share").alias("share"))
    hits = found.where(F.size("hits") > 0).select("row_id", F.explode("hits").alias("h")).select("row_id", "h.*")
    places = (hits.join(shares, "term").select("row_id", F.explode("places").alias("p"), "share")
              .groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("p.start", "p.end", "share"))).alias("terms")))
    return found.drop("hits").join(places, "row_id", "left")


def _text_of(spans: Column, kinds: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: counts per kind, ``base_sha256`` of the fixed kinds' spans, ``spans`` with terms.

    Null and empty texts have no spans: counts of 0, the digest of the empty
    string and an empty ``spans``. Repeated rows give repeated rows and count as documents of
    their own; null ids stay null; other columns are not read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    disclosing = stored(disclosing_terms(scan(rows, "text", [], True), docs.count(), disclosure, support))
    found = _found(rows, "text", ["id"], term_filter(disclosing), disclosing, False)
    kinds = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    base = _text_of(F.col("base"), kinds)
    terms = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,share:double>>")),
                        lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    counts = [_number_of(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("doc.id").alias(id_column), *counts, F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"),
        _text_of(F.sort_array(F.concat("base", terms)), kinds).alias("spans"), F.size(terms).alias("n_terms"))


def replaced(text: str | None, base: list[dict], terms: list[dict] | None) -> str | None:
    """The text with entities and disclosing terms generalised to their kind, or fully disclosing terms removed.

    Of overlapping spans the first, and of those the longest, is replaced with all that the others cover.
    """
    if text is None or not base and not terms:
        return text
    spans = [(s["start"], -s["end"], f"[{KINDS[s['kind']].upper()}]") for s in base]
    spans += [(s["start"], -s["end"], "" if s["share"] >= FULL_DISCLOSURE else f"[{TERM.upper()}]") for s in terms or ()]
    out, done = [], 0
    for start, end, label in sorted(spans):
        if start >= done:
            out.append(text[done:start])
            out.append(label)
        done = max(done, -end)
    out.append(text[done:])
    return "".join(out)


def sanitised(docs: DataFrame, text_column: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT,
              length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text; rows without any are returned as they came.

    A column of text lengths, if there is one, is set anew for changed texts. Null and empty texts stay as they are,
    repeated rows change alike, null ids and other columns, whatever their names, pass unread; an empty table gives an empty one.
    """
    disclosing = stored(disclosing_terms(scan(docs, text_column, [], True), docs.count(), disclosure, support))
    bits = term_filter(disclosing)
    changed = _found(docs, text_column, docs.columns, bits, disclosing, True)

    def without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Places(bits)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("t")]
            same = [not (base_spans(t) or finder.of(t, [])) for t in texts]
            yield batch.filter(pa.array(same, pa.bool_())).select(["doc"])

    # Only rows with spans or words that pass are stored and joined; the others pass straight through.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole_text(text_column).alias("t"))
    same = whole.mapInArrow(without_spans, f"doc {whole.schema['doc'].dataType.simpleString()}").select("doc.*")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replaced(*(v.as_py() for v in row)) for row in zip(*(batch.column(i) for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    rows = changed.select("doc", F.col(f"doc.`{text_column}`").alias("t"), "base", "terms")
    done = rows.mapInArrow(of_batches, f"doc {rows.schema['doc'].dataType.simpleString()}, text string")
    columns = []
    for name in docs.columns:
        if name == text_column:
            columns.append(F.col("text").alias(name))
        elif name == length_column:
            columns.append(F.char_length("text").cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"doc.`{name}`").alias(name))
    return same.unionByName(done.select(*columns))
