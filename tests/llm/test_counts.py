"""Token counts, collocations and the filter audit: against the library, brute force and on hard rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import filter_audit, phrases, token_transducer
from tests.llm.test_operators import DOCS, hard, hard_rows, none, prose  # noqa: F401

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \t\n", "'", "''s", "'ve''ll'l 'LL I'M don'test a'sb \"'s ''re'", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "12½ ²x é́ é ß中文字  İΣΑΣ", "\x00\x1c\x85　​﻿y",
    "ab" * 5000, "a" * 3001, "ééé" * 700, "!?" * 900, "中文" * 900, "1234567890" * 99, "the" * 2000, "thethe'sthe" * 300, "\U0001f600\U0001f44d\U0001f3fd" * 50, "x " * 3000,
]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(FILE)
    return lambda t: len(own.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def compiled():
    return token_transducer.Compiled(FILE)


def test_token_counts_on_hard_rows(spark, hard, none, library):  # noqa: F811
    got = token_transducer.token_counts(hard, FILE, limit=100).collect()
    by = lambda rows: sorted(rows, key=str)
    assert by(tuple(r) for r in got) == by((i, len((t or "").encode()), n, n > 100) for i, t, *_ in hard_rows() for n in [library(t)])
    assert token_transducer.token_counts(none, FILE).count() == 0
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    assert {r.doc_id: r.n_tokens for r in token_transducer.token_counts(odd, FILE).collect()} == {k: library(t) for k, t in enumerate(ODD)}


@pytest.mark.parametrize("run, chunk, states", [(1 << 12, 16, 1 << 20), (1 << 20, 512, 50), (300, 7, 1 << 20)])
def test_token_counts_in_small_chunks(compiled, library, monkeypatch, run, chunk, states):
    for name, value in (("RUN", run), ("CHUNK", chunk), ("MOST_STATES", states)):
        monkeypatch.setattr(token_transducer, name, value)
    texts = [t or "" for t in ODD] + [prose(k, 40 * k) for k in range(12)]
    count = token_transducer.Counter(compiled)
    assert count.counts(texts).tolist() == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinstrdlm've <|>!.é\n1中Σ"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_token_counts_of_any_text(compiled, library, texts):
    token_transducer.CHUNK, before = 16, token_transducer.CHUNK
    try:
        assert token_transducer.Counter(compiled).counts(texts).tolist() == [library(t) for t in texts]
    finally:
        token_transducer.CHUNK = before


def test_scan_composes_state_maps():
    r = np.random.default_rng(3)
    maps = r.integers(0, 5, (37, 5)).astype(np.uint8)
    scanned = token_transducer._compose(maps)
    for s in range(5):
        at = s
        for k in range(37):
            at = maps[k, at]
            assert scanned[k, s] == at


def brute_phrases(rows, least, top=2000):
    count, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            lang = "und" if lang is None else lang
            n[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in long.items():
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in long.items()):
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for k, (score, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, k + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("slots", [1 << 6, 1 << 17])
def test_collocations_equal_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(phrases, "RUN", 5000)
    monkeypatch.setattr(phrases, "BLOCK", 1 << 12)
    r = random.Random(7)
    words = ["the", "The", "of", "a\x01", "a", "b\x00c", "é", "new", "york", "city", "hall"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]
    text = lambda: "".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(60)))
    rows = [(k, r.choice([text(), text() + " new york city hall " * r.randrange(4), None, "", "the " * 40, "?!"]), r.choice(["en", "de", None, "und", ""])) for k in range(300)]
    rows += [(None, "New York city hall", "en")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = [tuple(x) for x in phrases.collocations(docs, least=8, slots=slots).collect()]
    assert sorted(got) == brute_phrases(rows, 8) and len(got) > 50
    assert sorted(tuple(x) for x in phrases.collocations(docs, least=8, top=5, slots=slots).collect()) == brute_phrases(rows, 8, 5)


def test_collocations_on_hard_rows(spark, hard, none):  # noqa: F811
    got = sorted(tuple(x) for x in phrases.collocations(hard, least=3).collect())
    assert got == brute_phrases(hard_rows(), 3)
    assert phrases.collocations(none).count() == 0


def brute_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = defaultdict(list)
    for i, t, part, *_ in rows:
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        fails = {f for f, c in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and first[t] < i)) if c}
        docs[part or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, ds in docs.items():
        taken = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                past = [d for d in ds if not d[0] & set(order[:k])]
                gone = [d for d in past if f in d[0]]
                taken[f] += len(gone)
                fail = [d for d in ds if f in d[0]]
                out[part, "".join(order), k + 1] = [len(past) - len(gone), len(gone), len(fail) - len(gone), sum(d[0] == {f} for d in ds), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(taken[o[k - 1]])
    return out


def test_audit_equals_brute_force(spark, hard, none):  # noqa: F811
    r = random.Random(11)
    texts = [None, "", "UPPER CASE " * 60, prose(1, 130), prose(2, 99), prose(3, 130) + " #", "a b c " * 70, prose(4, 101)]
    rows = hard_rows() + [(r.choice([None, *range(20, 60)]), r.choice(texts), r.choice(["en", None, "", "de"])) + (None,) * 14 for _ in range(150)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in [None, *range(60), *range(10)]]
    docs = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x[0], x[1], x[2]): list(x[3:]) for x in filter_audit.audit(docs, table).collect()}
    assert got == brute_audit(rows, labels) and len(got) == 600 * 3
    assert filter_audit.audit(none, table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).filter("good_lost > 0 OR toxic_lost > 0").count() == 0
