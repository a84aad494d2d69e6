"""The combination join against all pairs, and the guarantee of its prefixes."""

import random
import re

import numpy as np
import pytest

from helpers import documents, write
from tarmaq.llm import combinations
from tarmaq.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 4]) for k in range(len(words) - 3)}


def all_pairs(docs):
    """doc_id, n_shingles, component_id of each row."""
    distinct, root = {}, {}
    for d, t in docs:
        if d is not None:
            one = frozenset(shingles(t))
            distinct.setdefault(one, []).append(d)
    sets = [s for s in distinct if s]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                root[find(k)] = find(j)
    smallest = {}
    for k, s in enumerate(sets):
        smallest[find(k)] = min(smallest.get(find(k), min(distinct[s])), min(distinct[s]))
    place = {s: smallest[find(k)] for k, s in enumerate(sets)}
    return sorted(((d, len(shingles(t)), None if d is None else place.get(frozenset(shingles(t)), d)) for d, t in docs),
                  key=repr)


def found(spark, docs, **how):
    got = combinations.deduplicate(documents(spark, docs), **how)
    return sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def texts(seed, size=260):
    """Templates with few and many edits, shared passages, short texts and copies."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.choice((8, 20, 60)))] for _ in range(6)]
    templates = [[draw.choice(vocabulary) for _ in range(draw.choice((5, 9, 12, 40, 130, 300)))] for _ in range(9)]
    out = []
    for k in range(size):
        kind = draw.random()
        if kind < .6:
            words = list(draw.choice(templates))
            for _ in range(draw.choice((0, 0, 1, 1, 2, 3, 6))):
                at = draw.randrange(len(words))
                words[at:at + draw.choice((0, 1))] = [draw.choice(vocabulary)] * draw.choice((0, 1))
                words = words or ["x"]
        elif kind < .8:
            words = sum((draw.choice(passages) for _ in range(draw.randrange(1, 5))), [])
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.randrange(8))]
        out.append((k, draw.choice((" ", "\n", " \t ")).join(w.upper() if draw.random() < .1 else w for w in words)))
    return out


@pytest.mark.parametrize("seed, rare", [(1, 64), (2, 1), (3, 2), (4, 5)])
def test_equals_all_pairs(spark, seed, rare):
    docs = texts(seed)
    want = all_pairs(docs)
    assert len({c for _, _, c in want}) < .8 * len(docs)
    assert found(spark, docs, rare=rare) == want


@pytest.mark.parametrize("rare", [1, 2, 4])
def test_linked_sets_share_a_key(rare):
    """The guarantee itself: any two linked sets of a random family meet under a key."""
    draw = np.random.default_rng(rare)
    for _ in range(30):
        pool = np.unique(draw.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2))
        family = []
        for _ in range(25):
            size = int(draw.integers(6, 50))
            start = family[draw.integers(len(family))] if family and draw.random() < .7 else draw.choice(pool, size, False)
            kept = start[draw.random(len(start)) < draw.choice((.9, .97, 1))]
            new = draw.integers(0, 2**63, draw.integers(0, 3), dtype=np.uint64) * np.uint64(2)
            family.append(np.unique(np.concatenate((kept, new))))
        family = [s for s in {f.tobytes(): f for f in family}.values() if len(s) >= combinations.LEAST]
        first = [combinations.tokens_of(s, False).astype(np.int64) for s in family]
        rest = [combinations.tokens_of(s, True).astype(np.int64) for s in family]

        def counts(parts):
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            return dict(zip(values.tolist(), n.tolist()))

        df1 = counts(first)
        short = [len(f) - sum(df1[t] > rare for t in f.tolist()) <= combinations.may_miss(len(s))
                 for s, f in zip(family, first)]
        df2 = counts([r for r, s in zip(rest, short) if s] + [np.zeros(0, np.int64)])
        keys = []
        for s, f, r, more in zip(family, first, rest, short):
            df = {t: df1[t] for t in f.tolist()} | ({t: df2[t] for t in r.tolist()} if more else {})
            df = {t: n for t, n in df.items() if n > 1}
            keys.append(set(combinations.prefix_keys(
                len(s), len(f), len(r) if more else None, np.array(list(df), np.int64),
                np.array(list(df.values()), np.int64), rare)[0]))
        for k, a in enumerate(family):
            for j in range(k):
                assert not combinations.linked(a, family[j]) or keys[k] & keys[j]


def test_combinations_grow_with_the_text():
    for n in (100, 1000, 10_000):
        tokens = np.random.default_rng(n).integers(0, 2**48, n)
        for df, most in ((100, .6), (10_000, 2)):
            keys = combinations.combination_keys(n, combinations.may_miss(n) + 1, tokens, np.full(n, df))
            assert .15 * n < len(keys) < most * n * len(combinations.bands(n))


def test_a_template_group_stays_whole(spark):
    """Hundreds of edited copies: linked to the template, and not all to each other."""
    draw = random.Random(5)
    base = [f"t{k}" for k in range(120)]
    docs = []
    for k in range(300):
        words = list(base)
        for _ in range(k % 5):
            words[draw.randrange(len(words))] = f"own{draw.randrange(10**6)}"
        docs.append((1000 - k, " ".join(words)))
    want = all_pairs(docs)
    assert found(spark, docs) == want and found(spark, docs, rare=8) == want


def test_odd_rows(spark):
    long = " ".join(str(k % 7919) for k in range(30_000))
    docs = [(None, "a b c d e f g"), (1, None), (2, ""), (3, " \n "), (4, "A b"), (5, "a B"), (6, "a"), (7, long),
            (8, long + " and more"), (9, "a b c d e f g h i j"), (9, "a b c d e f g h i j"), (9, "quite another text here"),
            (10, "a b c d e f g h i j k")]
    assert found(spark, docs) == all_pairs(docs)
    assert found(spark, []) == []


def test_clashing_columns(spark):
    docs = texts(7, 60)
    frame = documents(spark, docs).selectExpr("*", "1 AS key", "2 AS n", "3 AS `set`", "4 AS component_id", "5 AS a")
    got = combinations.deduplicate(frame).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(docs)


def test_query(spark, tmp_path):
    docs = texts(8, 120)
    got = QUERIES["op11_jaccard_join"](spark, write(documents(spark, docs), tmp_path, "documents"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(docs)
