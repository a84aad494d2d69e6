"""Language identification: held-out accuracy and defined results for odd texts."""

import pytest

from helpers import documents, write
from tarmaq.llm import language
from tarmaq.llm.queries import QUERIES

EN = "the quick brown fox jumps over the lazy dog and runs away from the house"
DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft weg vom Haus"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, EN, "en") for k in range(3)] + [(k + 3, DE, "de") for k in range(3)] + [(9, None, "xx"), (10, EN, None)]
    return language.train(documents(spark, rows))


def test_odd_texts(spark, model):
    rows = [(1, EN), (2, DE), (3, None), (4, ""), (5, "12 34 !! \n"), (6, EN * 5000), (1, EN), (None, DE), (7, "ü"),
            (8, "日本"), (9, "𐐨𐐩")]
    found = language.annotate(documents(spark, rows, ).drop("lang"), model)
    out = [(r.doc_id, r.lang_pred, r.lang_score) for r in found.collect()]
    assert len(out) == len(rows)
    by = {d: (p, s) for d, p, s in out}
    assert by[1][0] == "en" and by[6][0] == "en" and by[2][0] == "de" and by[None][0] == "de"
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert by[7][0] == "de" and by[8][0] in ("de", "en") and by[9][0] in ("de", "en")
    assert all(0 <= s <= 1 for _, _, s in out)


def test_nothing_learned_and_no_rows(spark):
    nothing = language.train(documents(spark, []))
    assert nothing.languages == []
    out = rows_of(language.annotate(documents(spark, [(1, EN)]), nothing))
    assert (out[1].lang_pred, out[1].lang_score) == ("und", 0.0)
    assert language.annotate(documents(spark, []), nothing).count() == 0


def test_clashing_columns(spark, model):
    clash = documents(spark, [(1, EN)]).selectExpr("doc_id", "text", "'x' AS lang_pred", "5 AS lang_score", "3 AS n")
    row = language.annotate(clash, model).collect()[0]
    assert row.lang_pred == "en" and row.n == 3


def test_query_is_blind_to_lang_and_accurate_on_held_out(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = QUERIES["op4_language_id"](spark, folder)
    both = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in both if r.held_out]
    assert len(both) == docs.count() and 0.15 < len(held) / len(both) < 0.25
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    hidden = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, 'zz', lang) AS lang",
                             "source", "n_chars")
    again = QUERIES["op4_language_id"](spark, write(hidden, tmp_path, "documents"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
