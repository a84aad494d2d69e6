"""The corpus pipeline, stage by stage."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from helpers import documents, write
from tarmaq.llm import linededup
from test_neardup import all_pairs
from test_packing import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and behind each stage."""
    out, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, FOLDER).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out[name] = before, docs
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert dict(after.dtypes) == dict(before.dtypes) and after.columns == before.columns, name


def test_rejections_spare_good_documents(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good, bad = (ids(labels.filter(f"quality = {q}")) for q in (1, 0))
    before, after = stages["language_id"]
    assert len(ids(after) & good) >= 0.99 * len(ids(before) & good)
    before, after = stages["quality_classifier"]
    assert len(ids(after) & good) >= 0.98 * len(ids(before) & good)
    assert len(ids(after) & bad) <= 0.2 * len(ids(before) & bad)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    con = duckdb.connect()
    con.register("rows", before.toPandas())
    con.execute("CREATE TABLE documents AS SELECT * FROM rows")
    want = {r[0]: r[3] for r in con.execute(linededup.ORACLE_SQL).fetchall() if r[2] == 0 or r[3].strip()}
    got = {r.doc_id: r for r in after.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = {d for d, (_, _, kept) in all_pairs([(r.doc_id, r.text) for r in before.collect()]).items() if kept}
    rows = [r.doc_id for r in after.collect()]
    assert sorted(rows) == sorted(want)


def test_packing(stages):
    before, after = stages["packing"]
    check(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_run_equals_its_stages(spark, stages):
    _, after = stages["packing"]
    one, two = (sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
                for df in (corpus_pipeline.run(spark, FOLDER), after))
    # where documents are cut depends on how tasks are dealt; the documents do not
    assert {(d, sum(r[2] for r in one if r[0] == d)) for d, *_ in one} == {(d, sum(r[2] for r in two if r[0] == d)) for d, *_ in two}


def test_odd_rows(spark, tmp_path):
    text = "The words of a plain sentence that says something about the weather today"
    rows = [(1, text), (2, None), (3, ""), (4, "123 !!"), (None, text + " and more"), (1, text), (5, text * 500), (6, "\n".join([text] * 3))]
    docs = documents(spark, rows).selectExpr("*", "1 AS lang_pred", "2 AS quality_score", "3 AS n_deleted", "4 AS curve", "5 AS kept")
    folder = write(docs, tmp_path, "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        found = after.collect()
        assert {r.doc_id for r in found} <= {r[0] for r in rows} and all(r.kept == 5 and r.lang_pred == 1 for r in found)
        assert stage(spark, docs.limit(0), folder).count() == 0
    run = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in run} <= {1, 5, 6, None} and run


def test_noise_and_unlearned_languages_go(spark):
    rng = np.random.default_rng(3)
    odd = [(-k - 1, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 300)), None) for k in range(20)]
    odd += [(-101, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, None),
            (-102, "色は匂へど散りぬるを我が世誰ぞ常ならむ有為の奥山今日越えて" * 5, None)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    after = corpus_pipeline.language_id(spark, docs.unionByName(documents(spark, odd)), FOLDER)
    kept = ids(after)
    assert not any(d < 0 for d in kept) and len(kept) >= 0.99 * len(ids(docs.filter("text RLIKE '[a-z]'")))


def test_near_dedup_keeps_other_texts_of_a_doc_id(spark):
    one, two = ("river stone valley bridge morning " * 3 + "and some more", "never again shall we count seven blue lamps at night")
    docs = documents(spark, [(7, one), (7, two), (7, two), (3, two), (8, "quite another text that nobody else has here"), (None, one)])
    found = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect())
    assert [d for d, t in found if t == one] == [0, 7] and len([t for _, t in found if t == two]) == 1 and len(found) == 4
