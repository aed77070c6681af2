"""Byte-level BPE against its library, periodic runs and conversation repair against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from armlens.llm import byte_bpe, conversation_repair, periodic_runs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
LONG = "alpha beta gamma delta " * 30_000
# Letters that only newer versions of Unicode have, among others.
CHARACTERS = "ab Z9.,'\n\t 　中é́՘֋౜\U0001f600٠\U00011de0\x85"


def sha256(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@lru_cache
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


# --- byte-level BPE


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=CHARACTERS, max_size=60), max_size=4))
def test_ids_equal_the_library(texts):
    split = byte_bpe.splitter(PATTERN)
    found = byte_bpe.Words(RANKS).ids([list(split(text)) for text in texts])
    assert [ids.tolist() for ids in found] == [library().encode_ordinary(text) for text in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 4001, "\n" * 999 + "x", "abcdefgh" * 700 + "é" * 50])
def test_long_matches_equal_the_library(text):
    found = byte_bpe.Words(RANKS).ids([list(byte_bpe.splitter(PATTERN)(text))])
    assert found[0].tolist() == library().encode_ordinary(text)


def test_words_merged_together_equal_words_merged_alone():
    rng, ranks = random.Random(3), byte_bpe.read_ranks(RANKS)
    words = [bytes(rng.choices(b"aeinrst qz\xc3\xa9", k=rng.randint(2, 33))) for _ in range(500)]
    assert byte_bpe.merged_together(words, byte_bpe.Pairs(ranks)) == [tuple(byte_bpe.merged(w, ranks)) for w in words]


def test_forgotten_words_have_the_same_ids(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    words = byte_bpe.Words(RANKS)
    for text in ("some words here", "other words there and elsewhere", "x" * 100, "some words here"):
        assert words.ids([list(byte_bpe.splitter(PATTERN)(text))])[0].tolist() == library().encode_ordinary(text)


BPE_ROWS = [(1, "one two", "x", "y"), (1, "one two", "x", "y"), (2, None, None, None), (3, "", "", ""), (None, "naïve 漢字\u0000", "i", "d"),
            (4, " \n\t ", "i", "d"), (5, LONG, "i", "d"), (None, None, None, None)]
BPE_SCHEMA = "doc_id long, text string, ids string, decoded string"


def test_bpe_rows(spark):
    docs = spark.createDataFrame(BPE_ROWS, BPE_SCHEMA)
    rows = byte_bpe.digests(docs, RANKS, PATTERN).collect()
    wanted = []
    for doc_id, text, *_ in BPE_ROWS:
        ids = library().encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), sha256(",".join(map(str, ids))), sha256(text or "")))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in rows)
    assert byte_bpe.digests(docs.where("false"), RANKS, PATTERN).collect() == []


def test_decoding_is_defined_for_odd_lists(spark):
    tokens = spark.createDataFrame([(1, [72, None, 73]), (2, []), (3, None)], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in byte_bpe.decode(tokens, RANKS).collect()}
    assert found == {1: library().decode_bytes([72, 73]), 2: b"", 3: None}
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), RANKS).collect()


# --- periodic runs


def brute_runs(words):
    """Every stretch that repeats at a lag, by all lags; the smallest lag names it."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def periodic_words(rng):
    """Words of few kinds with repeats, repeats of repeats and Fibonacci words."""
    kinds, n = rng.choice([1, 2, 2, 3, 4, 30]), rng.randint(0, rng.choice([20, 80, 400]))
    way = rng.randrange(4)
    words = []
    if way == 0:
        words = rng.choices(range(kinds), k=n)
    elif way == 1:
        while len(words) < n:
            words += rng.choices(range(kinds), k=rng.randint(1, 60)) * rng.randint(1, 6)
            words += words[-rng.randint(1, 200):] * rng.randint(0, 1)
    elif way == 2:
        words = rng.choices(range(kinds), k=rng.randint(1, 4))
        while len(words) < n:
            words = words * rng.randint(1, 4) + [rng.randrange(kinds)] * rng.randint(0, 2) + [0]
    else:
        a, words = [0], [0, 1]
        while len(words) < n:
            a, words = words, words + a
        words = words + words[::-1] * rng.randint(0, 1)
        words[rng.randrange(len(words))] = rng.randint(0, 2)
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [periodic_words(rng) for _ in range(rng.randint(0, 5))]
        found = periodic_runs.runs_of([np.array(t, dtype=np.int64) for t in texts])
        assert [[tuple(r) for r in runs.tolist()] for runs in found] == [brute_runs(t) for t in texts]


def test_copies_made_of_short_periods():
    # Every odd lag around the middle is a run whose copies hold nothing but the period 2.
    words = [0, 1] * 40 + [0] + [0, 1] * 40 + [0]
    assert [tuple(r) for r in periodic_runs.runs_of([np.array(words)])[0].tolist()] == brute_runs(words)


@pytest.mark.parametrize("words", [np.zeros(300_000), np.arange(300_000) % 7, np.arange(300_000) % 5000])
def test_long_runs_take_linear_time(words):
    runs = periodic_runs.runs_of([words.astype(np.int64)])[0]
    assert len(runs) == 1 and tuple(runs[0][:2]) == (0, 300_000)


RUN_ROWS = [(1, "a b " * 10, "x", "y"), (1, "a b " * 10, "x", "y"), (2, None, None, None), (3, "", "", ""), (4, " \t\n ", "", ""),
            (None, "x " * 13 + "end", "", ""), (5, LONG, "", ""), (6, "no run in this text", "", ""), (None, None, None, None)]


def test_run_rows(spark):
    docs = spark.createDataFrame(RUN_ROWS, "doc_id long, text string, runs string, collapsed string")
    rows = periodic_runs.periodic_runs(docs).collect()
    found = sorted(repr((r.doc_id, [tuple(x) for x in r.runs], r.collapsed)) for r in rows)
    wanted = []
    for doc_id, text, *_ in RUN_ROWS:
        runs = {1: [(0, 20, 2)], 5: [(0, 120_000, 4)]}.get(doc_id, [])
        runs = [(0, 13, 1)] if doc_id is None and text else runs
        collapsed = {1: "a b", 5: "alpha beta gamma delta", None: "x end" if text else ""}.get(doc_id, (text or "").strip())
        wanted.append(repr((doc_id, runs, collapsed)))
    assert found == sorted(wanted)
    assert periodic_runs.digests(docs.where("false")).collect() == []


def planted(doc_id, text):
    words = (text or "").split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    a = h // 10 % len(words)
    p = 1 + (len(words) - a) // (3 + h // 10 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_run_digests_of_planted_repeats(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 150)))) for i in range(300)] + [(None, "a b c"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in periodic_runs.digests(periodic_runs.planted_repeats(docs)).collect()}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10
    for doc_id, text in rows:
        words, row = planted(doc_id, text), found[doc_id]
        runs = brute_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        assert tuple(row)[1:5] == (len(runs), *top)
        assert row.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert row.runs_sha256 == sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert row.collapsed_sha256 == sha256(" ".join(w for i, w in enumerate(words) if i not in gone))


# --- conversation repair


def brute_repair(rows):
    """Least (cost, audit, lines) over every choice of edits, by a search over states; rows are (role, text) in order."""
    white, seen, edits = " \t\n\x0b\x0c\r", set(), []
    for role, text in rows:
        bad = not text.strip(white) or (role, text) in seen
        seen.add((role, text))
        extra = 0 if text.rstrip(white).endswith((".", "!", "?")) else 5
        ways = [(2, "D", None)]
        if not bad:
            ways += [(extra, "K", (role, text)), (1 + extra, "R", ("user", text)), (1 + extra, "R", ("assistant", text))]
        edits.append(ways)
    best = None
    slots = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for choice in itertools.product(*edits):
        for fill in itertools.product(slots, repeat=len(rows) + 1):
            lines, audit, cost = [], "", 0
            for i in range(len(rows) + 1):
                lines += [({"u": "user", "a": "assistant"}[x], "") for x in fill[i]]
                audit, cost = audit + "I" * len(fill[i]), cost + 5 * len(fill[i])
                if i < len(rows):
                    audit, cost = audit + choice[i][1], cost + choice[i][0]
                    lines += [choice[i][2]] if choice[i][2] else []
            initials = "".join(role[:1] for role, _ in lines)
            body = initials[1:] if initials[:1] == "s" else initials
            if all(role for role, _ in lines) and (not initials or body and body == "ua" * (len(body) // 2)):
                found = (cost, audit, "\n".join(f"{role}:{text}" for role, text in lines))
                best = found if best is None or found[:2] < best[:2] else best
    return best


TEXTS = ["Yes.", "no", "", " \n", "Why?", "Well! "]
ROLES = ["user", "assistant", "system", "tool", "", "author"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=3))
def test_cells_give_the_cheapest_repair(rows):
    held, seen = [], set()
    for role, text in rows:
        held.append(conversation_repair.Row(role, text, 1, (role, text) in seen))
        seen.add((role, text))
    cells = conversation_repair.parsed([row.cell() for row in held])
    tails = conversation_repair.TAILS
    cost, audit, end = min((c[0] + 5 * len(tails[q]), c[1] + "I" * len(tails[q]), q) for q, c in enumerate(cells[0]) if c)
    lines = conversation_repair.rebuilt(held, audit, 0)
    assert (cost, audit, "\n".join(lines)) == brute_repair(rows)


def step_repair(rows):
    """The same for many rows, from left to right over the states."""
    cells, seen = {"": (0, "", "")}, set()
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(cells):
        for _ in range(2):
            for (p, x), q in steps.items():
                if x in names and p in cells:
                    cost, audit, lines = cells[p]
                    found = (cost + 5, audit + "I", f"{lines}{names[x]}:\n")
                    cells[q] = min(cells.get(q, found), found)
        return cells

    for role, text in rows:
        bad = not text.strip(" \t\n\x0b\x0c\r") or (role, text) in seen
        seen.add((role, text))
        extra = 0 if text.rstrip(" \t\n\x0b\x0c\r").endswith((".", "!", "?")) else 5
        after = {}
        for p, (cost, audit, lines) in inserted(cells).items():
            ways = [(p, (cost + 2, audit + "D", lines))]
            for (start, x), q in steps.items():
                if start == p and not bad:
                    if role[:1] == x:
                        ways.append((q, (cost + extra, audit + "K", f"{lines}{role}:{text}\n")))
                    if x in names:
                        ways.append((q, (cost + extra + 1, audit + "R", f"{lines}{names[x]}:{text}\n")))
            for q, found in ways:
                after[q] = min(after.get(q, found), found)
        cells = after
    cells = inserted(cells)
    cost, audit, lines = min(cells[q] for q in ("", "a") if q in cells)
    return cost, audit, lines[:-1]


SCHEMA = "conv_id long, turn long, role string, text string, rows string, path string"


def conversations(seed, n, length):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for turn in [None, *range(rng.randint(0, length))]:
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, turn, rng.choice([*ROLES, None]), rng.choice([*TEXTS, f"Text {turn}.", None]), "x", "y"))
    return rows


@pytest.mark.parametrize("span_rows", [3, 64])
def test_repairs_in_spans_and_parts(spark, monkeypatch, span_rows):
    rows = conversations(1, 20, 12) + [(99, i, "user" if i % 2 else "assistant", f"t{i % 50}.", "x", "y") for i in range(900)]
    rows += [(98, 0, "user", "Same.", "x", "y")] * 200
    # A local function takes the limits of its module along to the workers.
    monkeypatch.setattr(conversation_repair, "SPAN_ROWS", span_rows)
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    found, pieces = conversation_repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(7))
    hashed = {r.conversation: r.repaired_sha256 for r in conversation_repair._hashed(pieces).collect()}
    found = {r.conv_id: r for r in found.collect()}
    assert set(found) == set(by_conv)
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        cost, audit, lines = step_repair([r[1:] for r in own])
        row = found[conv]
        turns = {t for t, *_ in own if t is not None}
        assert (row.cost, row.audit) == (cost, audit)
        assert hashed.get(conv, sha256("")) == sha256(lines)
        assert row.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        assert row.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        texts = [(r[1], r[2]) for r in own]
        blank = [not t.strip(" \t\n\x0b\x0c\r") for _, t in texts]
        again = [t in texts[:i] and not blank[i] for i, t in enumerate(texts)]
        assert (row.blank, row.duplicate) == (sum(blank), sum(again))
        assert row.truncated == sum(
            not b and not a and not t.rstrip().endswith((".", "!", "?")) for b, a, (_, t) in zip(blank, again, texts))


def test_parts_of_one_conversation_meet():
    """Cells of spans and stretches, combined, equal the cell of all rows."""
    rng = random.Random(2)
    rows = [conversation_repair.Row(rng.choice(ROLES), rng.choice(TEXTS), rng.choice([1, 1, 3]), rng.random() < 0.2) for _ in range(60)]
    whole = conversation_repair.parsed([row.cell() for row in rows])
    cuts = [0, *sorted(rng.sample(range(1, 60), 9)), 60]
    spans = [conversation_repair.parsed([row.cell() for row in rows[a:b]]) for a, b in zip(cuts, cuts[1:])]
    together = conversation_repair.parsed(spans, True)
    for p, q in itertools.product(range(4), repeat=2):
        assert (whole[p][q] is None) == (together[p][q] is None)
        if whole[p][q]:
            assert whole[p][q][:2] == together[p][q][:2] and len(together[p][q][2]) == len(spans) - 1


def test_conversations_without_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "", "")], SCHEMA)
    found = conversation_repair.digests(rows.where("false"), rows).collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, 0, 0, 0, 0, "", sha256(""))]
    assert conversation_repair.digests(rows, rows.where("false")).collect() == []


def test_faults_of_rows(spark):
    rows = [(c, t, "assistant", "One. Two! Three?", "", "") for c in [None, *range(40)] for t in [None, 0, 1]] + [(7, 5, None, None, "", "")]
    found = conversation_repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    wanted = []
    for c, t, role, text, *_ in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(fault, text)
        wanted += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in found)
