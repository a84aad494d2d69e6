"""Nearest neighbours: recall against brute force, and rows that take no part."""

import math

import numpy as np

from helpers import EMBEDDINGS, write
from tarmaq.llm import neighbours
from tarmaq.llm.queries import QUERIES


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None) for i, v in rows], EMBEDDINGS)


def test_recall_and_scores(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    out = QUERIES["op2_neighbours"](spark, folder).collect()
    queries = [i for i in rows if i % 100 == 0]
    assert {r.query_id for r in out} == set(queries) and len(out) == 10 * len(queries)
    hits = 0
    for q in queries:
        exact = sorted((float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), i) for i in rows if i != q)[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        for _, i, s in own:
            assert math.isclose(s, float(np.sqrt(((rows[i] - rows[q]) ** 2).sum())), rel_tol=1e-12)
        hits += len({i for _, i, _ in own} & {i for _, i in exact})
    assert hits / (10 * len(queries)) >= 0.9


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(0)
    sample = rng.standard_normal((3000, 24))
    model = neighbours.learn(sample)
    codes = model.codes(sample)
    shard = neighbours.Shard(np.arange(3000), sample, codes)
    for radius in (0, 1, 5, 18, 23, 40):
        model.radius = radius
        for q in range(0, 3000, 300):
            want = np.flatnonzero(neighbours.hamming(codes, codes[q]) <= radius)
            assert (shard.within(model, codes[q]) == want).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k), 1.0, 0.5]) for k in range(1, 8)]
    rows = good + [(0, [0.0, 1.0, 0.5]), (0, [0.0, 1.0, 0.5]), (100, [1.0, 1.0, 0.5]), (200, None), (201, [0.0, 0.0, 0.0]),
                   (300, [nan, 1.0, 1.0]), (301, [inf, 1.0, 1.0]), (302, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
                   (400, [1.0, 2.0]), (500, [])]
    out = neighbours.search(vectors(spark, rows), "vec_id % 100 = 0", 10).collect()
    assert {r.query_id for r in out} == {0, 100}
    own = [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == 0]
    # 1 and 100 are equally far: the smaller id comes first
    assert own == [(1, 1, 1.0), (2, 100, 1.0)] + [(k + 1, k, float(k)) for k in range(2, 8)]


def test_empty_single_and_clashing(spark, tmp_path):
    assert neighbours.search(vectors(spark, []), "vec_id % 100 = 0").count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0])]), "vec_id % 100 = 0").count() == 0
    assert neighbours.search(vectors(spark, [(1, [1.0])]), "vec_id % 100 = 0").count() == 0
    clash = vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]).selectExpr("*", "1 AS rank", "2 AS shard", "3 AS query_id")
    assert [r.vec_id for r in neighbours.search(clash, "vec_id % 100 = 0").collect()] == [1]


def test_copies_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 1)
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(0, 250)] + [(k, [1.0, 2.0, 3.0 + k]) for k in range(250, 320)]
    out = neighbours.search(vectors(spark, rows), "vec_id % 100 = 0").collect()
    for q in (0, 100, 200):
        own = [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q]
        assert own == [i for i in range(11) if i != q][:10]
