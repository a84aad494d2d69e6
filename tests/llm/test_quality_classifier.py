"""The factorisation machine: its identity, held-out accuracy, odd texts."""

import numpy as np

from helpers import documents
from tarmaq.llm import quality
from tarmaq.llm.queries import QUERIES


def test_linear_time_equals_all_pairs():
    rng = np.random.default_rng(0)
    wide = len(quality.STATISTICS)
    model = quality.FactorisationMachine(
        0.3, rng.standard_normal(quality.BUCKETS + wide), rng.standard_normal((quality.BUCKETS + wide, quality.RANK)),
        np.zeros(wide), np.ones(wide))
    buckets, edges = np.array([5, 9, 700, 5, 8]), np.array([0, 3, 3, 5])
    statistics = rng.standard_normal((3, wide))
    got = model.scores(buckets, edges, statistics)
    for r in range(3):
        own = buckets[edges[r]:edges[r + 1]]
        index = np.concatenate([own, quality.BUCKETS + np.arange(wide)])
        x = np.concatenate([np.full(len(own), 1 / np.sqrt(max(len(own), 1))), np.clip(statistics[r], -4, 4)])
        raw = model.bias + model.linear[index] @ x + sum(
            model.factors[index[i]] @ model.factors[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
        assert abs(got[r] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9


def test_query_held_out(spark):
    folder = "/root/testdata/sf0.01"
    out = QUERIES["op7_quality_classifier"](spark, folder)
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert out.count() == 1000 and held
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    bad, good = ([r for r in held if r.quality == q] for q in (0, 1))
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.8
    assert sum(r.predicted == 1 for r in good) / len(good) > 0.97


def test_odd_texts_and_labels(spark):
    rows = [(k, "fine words in a plain order number %d here" % k) for k in range(30)] + \
           [(k, "### $$$ @@ BUY!! NOW!! ### %d" % k) for k in range(30, 60)]
    odd = [(100, None), (101, ""), (102, "BUY!! ### " * 9000), (None, "plain words"), (100, None)]
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(60)] + [(0, 0), (0, None), (None, 1), (1, 7), (999, 1)],
                                   "doc_id long, quality int")
    docs = documents(spark, rows + odd)
    model = quality.train(docs, labels)
    out = quality.score(docs.withColumnRenamed("lang", "quality_score"), model).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.quality_score <= 1 for r in out)
    by = {r.doc_id: r.quality_score for r in out}
    assert by[5] > 0.5 > by[45]
    nothing = quality.train(docs, labels.limit(0))
    assert all(r.quality_score == 0.5 for r in quality.score(docs, nothing).collect())
    assert quality.score(documents(spark, []), model).count() == 0


def test_repeated_rows_of_a_labelled_document_count_once(spark, monkeypatch):
    """However often a row is repeated, the driver gets one of it."""
    rows = [(k, f"text {k % 3} of some words") for k in range(6)] + [(0, "text 0 of some words")] * 400 + [(1, "other")] * 30
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda buckets, edges, statistics, target: seen.append(len(target)))
    quality.train(documents(spark, rows), labels)
    assert seen == [6]
