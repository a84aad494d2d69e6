"""Line deduplication: DataFrame operations only, defined results for odd texts."""

import duckdb
import pandas as pd

from helpers import documents
from tarmaq.llm import linededup
from tarmaq.llm.queries import ORACLE, QUERIES

LONG = "one line of more than ten words that stands in more texts"


def texts(spark, rows):
    return [(r.doc_id, r.text, r.n_lines, r.n_deleted) for r in
            sorted(linededup.deduplicate(documents(spark, rows)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(ORACLE["op10_line_dedup"]).fetchall()
    got = [tuple(r) for r in QUERIES["op10_line_dedup"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 100


def test_runs(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, "a\nb"), (5, f"{LONG}\nq"), (6, f"r\n\n{LONG}\ns"),
            (7, "a\n\nb\n \nc\nd\nz"), (8, "m\nm\nm\nm\nm\nm")]
    assert texts(spark, rows) == [
        (1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "", 3, 3), (4, "a\nb", 2, 0), (5, f"{LONG}\nq", 2, 0), (6, "r\n\ns", 4, 1),
        (7, "\n \nz", 7, 4), (8, "m", 6, 5)]


def test_odd_rows(spark):
    big = "\n".join(f"line {k} of a long text" for k in range(5000))
    rows = [(None, LONG), (1, LONG), (2, None), (3, ""), (4, "\n\n"), (5, big), (6, big), (7, "dup\nrow"), (7, "dup\nrow"), (8, LONG + "!")]
    out = texts(spark, rows)
    assert out[0] == (None, LONG, 1, 0) and out[1] == (1, "", 1, 1) and out[2] == (2, None, 0, 0)
    assert out[3] == (3, "", 1, 0) and out[4] == (4, "\n\n", 3, 0) and out[5] == (5, big, 5000, 0)
    assert out[6] == (6, "", 5000, 5000) and out[7] == out[8] == (7, "dup\nrow", 2, 0) and out[9] == (8, LONG + "!", 1, 0)
    assert texts(spark, []) == []
    clash = documents(spark, [(1, LONG), (2, LONG)]).selectExpr(
        "doc_id", "text", "3 AS seq", "4 AS idx", "5 AS hash", "6 AS n_deleted", "7 AS kept")
    found = {r.doc_id: r for r in linededup.deduplicate(clash).collect()}
    assert found[2].n_deleted == 1 and found[2].idx == 4 and found[1].kept == 7


def test_maximal_runs(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "a\nb\nc\nd\ne"), (3, "z\nb\nc\nd\n\ne\nq")]
    deleted = linededup.later_copies(linededup.numbered_lines(documents(spark, rows)))
    runs = sorted(map(tuple, linededup.repeated_runs(deleted).collect()))
    assert runs == [(2, 0, 5), (3, 1, 4)]


def test_hot_line(spark):
    rows = spark.range(3000).selectExpr(
        "id AS doc_id", f"concat('own text ', id, '\\n', '{LONG}', '\\nend ', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    out = linededup.deduplicate(rows).toPandas()
    assert isinstance(out, pd.DataFrame) and out.n_deleted.sum() == 2999


def test_no_python(spark):
    plan = QUERIES["op10_line_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
