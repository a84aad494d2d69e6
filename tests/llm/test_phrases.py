"""Collocations against counts of every phrase, and exact scores."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from helpers import documents, write
from tarmaq.llm import phrases
from tarmaq.llm.queries import QUERIES

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_brute_force(docs, least, longest=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[k:k + size]) for k in range(len(words) - size + 1))
    rows = []
    for lang, counts in f.items():
        candidates = [p for p, c in counts.items() if c >= least and len(p) >= 2]
        inside = defaultdict(int)
        for p in candidates:
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    inside[p[k:k + size]] = max(inside[p[k:k + size]], counts[p])
        scored = []
        for p in candidates:
            if 100 * inside[p] >= 100 * counts[p]:
                continue
            cuts = [(1000 * counts[p] * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -counts[p], " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def texts(seed, size=300):
    draw = random.Random(seed)
    words = ["The", "of", "new", "york", "état", "a", "x" * 50, "あ", "city", "\x00", "it's", "n°5"]
    stock = ["the new york city", "of the new york", "a a a a a a a"]
    gaps = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    out = []
    for k in range(size):
        parts = []
        for _ in range(draw.randrange(40)):
            parts += [draw.choice(stock) if draw.random() < .3 else draw.choice(words), draw.choice(gaps)]
        out.append((k, "".join(parts), draw.choice(["en", "fr", None, "und", ""])))
    return out


def found(spark, docs, **how):
    return sorted(tuple(r) for r in phrases.collocations(documents(spark, docs), **how).select(*COLUMNS).collect())


@pytest.mark.parametrize("least, longest", [(3, 5), (10, 5), (5, 3), (4, 2)])
def test_equals_all_phrases(spark, least, longest):
    docs = texts(least + longest)
    want = by_brute_force(docs, least, longest)
    assert len(want) > 50
    assert found(spark, docs, least=least, longest=longest) == want


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    docs = texts(8)
    want = by_brute_force(docs, 4)
    for name in ("bitmap", "crowded"):
        monkeypatch.setattr(phrases, name, lambda *_: np.full(phrases.BITS // 8, 255, np.uint8))
    assert found(spark, docs, least=4) == want


def test_the_bitmap_holds_what_it_was_given(spark):
    rows = [(lang, " ".join(p)) for lang in ("en", "") for p in (["a"], ["b"], ["a", "b"], ["é"] * 5)]
    bits = phrases.bitmap(spark.createDataFrame(rows, "lang string, phrase string"))
    assert int(np.unpackbits(bits).sum()) == len(rows)
    raw = np.frombuffer("a b".encode(), np.uint8)
    words, *_ = phrases._words(raw, np.array([0, 3]))
    for lang, there in (("en", True), ("fr", False)):
        seeds = np.full(2, phrases._seed(lang), np.uint64)
        assert phrases._held(bits, phrases.phrase_hashes(words, seeds, 1)).tolist() == [there] * 2
        assert phrases._held(bits, phrases.phrase_hashes(words, seeds, 2)).tolist() == [there]


@pytest.mark.parametrize("least", [3, 300])
def test_crowded_places_hold_every_frequent_pair(spark, least):
    docs = [(k, "a b c, a b x" if k % 3 else "a b a b", "en") for k in range(4 * least // 3)]
    full = phrases.crowded(documents(spark, docs), 1, 2, np.full(phrases.BITS // 8, 255, np.uint8), least)
    assert int(np.unpackbits(full).sum()) == 1  # "a b"; the other pairs are below
    raw = np.frombuffer(b"a b b c", np.uint8)
    words, *_ = phrases._words(raw, np.array([0, 7]))
    hashes = phrases.phrase_hashes(words, np.full(4, phrases._seed("en"), np.uint64), 2)
    assert phrases._held(full, hashes).tolist() == [True, False, False]


def test_stripes_are_handed_on_when_full(spark, monkeypatch):
    docs = texts(9, 60)
    monkeypatch.setattr(phrases, "HELD", 5)
    assert found(spark, docs, least=3) == by_brute_force(docs, 3)


def test_top_and_ties(spark):
    docs = [(k, "b c. a b. c d.", "en") for k in range(5)]
    got = found(spark, docs, least=5, top=2)
    assert got == by_brute_force(docs, 5, top=2) and [r[2] for r in got] == ["a b", "c d"]


def test_shares_are_ranked_to_the_same_top(spark):
    docs = texts(11, 200)
    want = by_brute_force(docs, 3, top=7)
    assert found(spark, docs, least=3, top=7) == want and len(want) == 7 * len({r[0] for r in want})


def test_odd_rows(spark):
    docs = [(1, None, "en"), (None, "", None), (2, " \t\n", "en"), (2, "a b " * 40_000, "de"), (2, "a b " * 40_000, "de")]
    assert found(spark, docs, least=4) == by_brute_force(docs, 4)
    assert found(spark, []) == []


def test_clashing_columns(spark):
    docs = texts(4, 80)
    frame = documents(spark, docs).selectExpr("*", "1 AS phrase", "2 AS prefix", "3 AS n", "4 AS score")
    got = sorted(tuple(r) for r in phrases.collocations(frame, least=3).select(*COLUMNS).collect())
    assert got == by_brute_force(docs, 3)


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 7 * 10**15 + 1, 9 * 10**17 - 7, 8 * 10**17 + 3, 7 * 10**15 + 5
    row = spark.sql(f"SELECT CAST({a} AS BIGINT) a, CAST({n} AS BIGINT) n, CAST({l} AS BIGINT) l, CAST({r} AS BIGINT) r")
    assert phrases.with_score(row).head()["score"] == 1000 * a * n // (l * r)


def test_query_and_sql(spark, tmp_path):
    docs = [(k, t, v) for k, t, v in texts(5, 900)]
    sf = write(documents(spark, docs), tmp_path, "documents")
    got = QUERIES["op13_phrases"](spark, sf)
    assert tuple(got.columns) == COLUMNS
    got = sorted(tuple(r) for r in got.collect())
    assert got == by_brute_force(docs, 100) and len(got) > 20
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert sorted(con.execute(phrases.oracle_sql()).fetchall()) == got
