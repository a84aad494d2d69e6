"""Near duplicates against all pairs, and the guarantee of the index."""

import random
import re

import numpy as np
import pytest

from helpers import documents
from tarmaq.llm import graph, neardup
from tarmaq.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def all_pairs(docs):
    """n_shingles, component and kept of each doc_id."""
    sets = {d: shingles(t) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(QUERIES["op9_near_duplicates"](spark, folder)) == all_pairs(docs)


def near_copies(rng, base, n, share):
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.sample(range(len(words)), int(share * len(words))):
            words[k] = f"w{rng.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("share", [0.01, 0.03, 0.05])
def test_groups_of_near_copies(spark, share):
    rng = random.Random(int(share * 100))
    base = [f"b{rng.randint(0, 500)}" for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = near_copies(rng, base, 60, share) + [" ".join(base)] * 5
    texts += [f"{passage} " + " ".join(f"u{k}x{j}" for j in range(40)) for k in range(40)]
    texts += [" ".join(f"s{rng.randint(0, 3)}" for _ in range(7)) for _ in range(60)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert result(neardup.deduplicate(documents(spark, docs))) == all_pairs(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a B c"), (5, "A b  C"), (6, "a b"), (7, "x " * 30000), (8, "X " * 9), (9, "É é"),
            (10, "é É"), (11, "a\xa0b c")]
    got = result(neardup.deduplicate(documents(spark, docs)))
    assert got == all_pairs(docs) and got[5] == (1, 4, False) and got[8] == (1, 7, False) and got[2] == (0, 2, True)
    repeated = documents(spark, [*docs, (4, "a B c"), (None, "a b c")]).selectExpr("*", "1 AS rep", "'k' AS key", "2 AS label")
    rows = neardup.deduplicate(repeated).collect()
    assert len(rows) == len(docs) + 2
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.deduplicate(documents(spark, [])).count() == 0


def test_signatures_within_the_bound_share_a_key():
    rng = np.random.default_rng(4)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    one = rng.integers(0, 1 << 16, (500, neardup.VALUES)).astype("<u2")
    two = one.copy()
    for k in range(500):
        at = rng.permutation(neardup.VALUES)[:most]
        two[k, at] ^= rng.integers(1, 1 << 16, most).astype("<u2")
    assert ((neardup.chunk_keys(one) == neardup.chunk_keys(two)).any(axis=1)).all()
    assert not (neardup.chunk_keys(one) == neardup.chunk_keys(one[::-1])).any()


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(1, 2), (2, 3), (3, 1), (7, 8), (8, 7), (7, 8)]])
def test_components(spark, edges):
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert len(rows) == len(label) and set(label) == {n for e in edges for n in e}
    assert all(label[a] == label[b] for a, b in edges) and set(label.values()) <= set(label)
    if edges and edges[0] == (1, 2):
        assert label[1] != label[7]
