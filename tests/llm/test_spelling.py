"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from helpers import documents, write
from tarmaq.llm import spelling
from tarmaq.llm.queries import QUERIES

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def by_brute_force(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    form, degree = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        degree[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], degree[w], n[form[w]] if form[w] else None))
    return rows


def found(spark, docs):
    got = spelling.group(documents(spark, docs)).select(*COLUMNS).collect()
    assert len(got) == len({r["word"] for r in got})
    return {tuple(r) for r in got}


def texts(seed, size=1500):
    """Variants of a few words, with doubled letters, accents and chains of forms."""
    draw = random.Random(seed)
    base = ["accommodation", "aaaaaaa", "éàüñçè", "bookkeeper", "letters", "abcabcabc"]
    made = list(base)
    for _ in range(size):
        w = draw.choice(made)
        k, kind, c = draw.randrange(len(w)), draw.randrange(3), draw.choice("aekprtéÿ×")
        made.append(w[:k] + {0: c, 1: "", 2: c + w[k]}[kind] + w[k + 1:])
    weight = [draw.choice((1, 5, 6, 30, 160)) for _ in made]
    words = draw.choices(made, weight, k=40_000)
    words += ["chained"] * 300 + ["chaines"] * 50 + ["chainess"] * 8
    draw.shuffle(words)
    cut = [words[k:k + 200] for k in range(0, len(words), 200)]
    return [(k, draw.choice((" ", "-", "1", "\n")).join(w.upper() if draw.random() < .2 and w.isascii() else w for w in ws))
            for k, ws in enumerate(cut)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    docs = texts(seed)
    want = by_brute_force(docs)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # some chain has two steps
    assert found(spark, docs) == want


def test_a_doubled_letter_is_one_neighbour(spark):
    docs = [(k, "aaaaaa aaaaaaa letter leter letterr letterrs") for k in range(12)]
    assert found(spark, docs) == by_brute_force(docs)


def test_odd_rows(spark):
    docs = [(None, "wörter wörter wörter wörter worter"), (1, None), (2, ""), (2, "worter " * 30), (2, "worter " * 30),
            (3, "12 ₤ ÷×÷×÷×÷ " * 5 + "a" * 3000)]
    assert found(spark, docs) == by_brute_force(docs)
    assert found(spark, []) == set() == found(spark, [(1, "too few")])


def test_clashing_columns(spark):
    docs = [(k, "spelled speled") for k in range(9)]
    frame = documents(spark, docs).selectExpr("*", "1 AS word", "2 AS n", "3 AS prefix", "4 AS root")
    assert {tuple(r) for r in spelling.group(frame).select(*COLUMNS).collect()} == by_brute_force(docs)


def test_long_chains_reach_their_root(spark):
    rows = [("w" + "abcdefghijkl"[k], "w" + "abcdefghijkl"[k + 1]) for k in range(11)]
    forms = spark.createDataFrame(rows, "word string, form string")
    assert {r["root"] for r in spelling.roots(forms, 5 ** 14).collect()} == {"wl"}


def test_groups_hold_one_full_rotation(spark):
    counted = spark.createDataFrame([("letters", 9), ("lettters", 8), ("lettexs", 7)], "word string, n long")
    rows = spelling.rotations(counted).collect()
    assert len(rows) == sum(2 * len(w) + 1 for w in ("letters", "lettters", "lettexs"))
    full = [r["prefix"] for r in rows if r["tail"] == ""]
    assert len(full) == len(set(full))


def test_query(spark, tmp_path):
    docs = texts(3, 200)
    sf = write(documents(spark, docs), tmp_path, "documents")
    got = QUERIES["op12_spelling_variants"](spark, sf)
    assert tuple(got.columns) == COLUMNS
    assert {tuple(r) for r in got.collect()} == by_brute_force(docs)
