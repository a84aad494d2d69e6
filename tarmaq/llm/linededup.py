"""Line deduplication by the first rounds of a distributed prefix doubling, in DataFrame operations only.

Every document is a sequence of lines that have a word. Classes of places where
the same line stands are refined to classes of places where the same two, then
``MIN_LINES`` lines begin, by pairing a place's class with the class of the place
a step behind it. Places alone in their class leave at once, so a round works on
what repeats.

The doubling ends there: no suffix array is sorted and no longest common prefixes
are computed. A run of more lines that came before is covered by its stretches of
``MIN_LINES`` lines, each of which came before, so a deeper order would not change
what is deleted. What it would add is the extent of each repeated run by its
earliest copy; ``repeated_runs`` only joins neighbouring deleted lines, and two
copies of different passages that stand next to each other become one run.

Deleted are all but the first (by doc_id, then place) copies of a run of at
least ``MIN_LINES`` lines, and of a single line of at least ``MIN_WORDS`` words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.llm.common import stored

MIN_LINES = 3
MIN_WORDS = 10
WORD = r"[^ \t-\r]"


def numbered_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: its document, place among those lines, place in the text, two hashes, length."""
    lines = F.transform(F.split("text", "\n"), lambda line, k: F.struct(line.alias("line"), k.alias("idx")))
    worded = F.filter(lines, lambda x: x["line"].rlike(WORD))
    return (docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(worded).alias("seq", "own"))
            .select("doc_id", "hash", "seq", F.col("own.idx").alias("idx"),
                    F.xxhash64(F.col("own.line")).alias("id1"), F.xxhash64(F.lit(1), F.col("own.line")).alias("id2"),
                    (F.size(F.split(F.trim(F.regexp_replace("own.line", r"[ \t-\r]+", " ")), " ")) >= MIN_WORDS)
                    .alias("long")))


def _refine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur twice, with the first of their class (by document, then place) as its name.

    The classes are a table before they are joined: then both sides of the join
    come straight from a shuffle, and Spark can split a line that is very common.
    """
    place = F.struct("doc_id", "hash", "seq")
    classes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                     .filter("n > 1").drop("n"), "classes")
    return rows.join(classes, keys)


def later_copies(lines: DataFrame) -> DataFrame:
    """The rows of ``lines`` (see ``numbered_lines``) that are deleted."""
    later = F.col("first") < F.struct("doc_id", "hash", "seq")
    repeated = stored(_refine(lines, ["id1", "id2"]).select("doc_id", "hash", "seq", "idx", "long", "first"), "repeated")
    rows, depth = repeated.select("doc_id", "hash", "seq", F.col("first").alias("name")), 1
    in_document = Window.partitionBy("doc_id", "hash").orderBy("seq")
    while depth < MIN_LINES:
        step = min(depth, MIN_LINES - depth)
        behind = F.first("name").over(in_document.rangeBetween(step, step))
        pairs = stored(rows.withColumn("behind", behind).filter("behind IS NOT NULL"), "pairs")
        rows = stored(_refine(pairs, ["name", "behind"])
                      .select("doc_id", "hash", "seq", F.col("first").alias("name")), "suffixes")
        depth += step
    starts = (rows.filter(F.col("name") < F.struct("doc_id", "hash", "seq"))
              .select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.col("seq").alias("s"),
                      F.lit(True).alias("starts")).distinct())
    marked = repeated.join(starts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
                           & (F.col("seq") == F.col("s")), "left")
    in_run = F.max(F.coalesce("starts", F.lit(False))).over(in_document.rangeBetween(1 - MIN_LINES, 0))
    return (marked.withColumn("in_run", in_run).filter(F.col("in_run") | (F.col("long") & later))
            .select("doc_id", "hash", "seq", "idx"))


def repeated_runs(deleted: DataFrame) -> DataFrame:
    """Stretches of deleted lines: doc_id, first_line (place in the text), n_lines.

    A stretch may hold copies of several passages (see the module's text).
    """
    in_document = Window.partitionBy("doc_id", "hash").orderBy("seq")
    rows = deleted.distinct()
    return (rows.withColumn("run", F.col("seq") - F.row_number().over(in_document))
            .groupBy("doc_id", "hash", "run").agg(F.min("idx").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
            .select("doc_id", "first_line", "n_lines"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the later copies gone from text, and with n_lines and n_deleted added.

    Lines are what ``\\n`` separates; lines without a word stay and do not
    interrupt a run. A NULL text stays NULL with 0 lines, an empty one has one
    line. Rows that repeat a doc_id and its text count as one document, and
    each of them is returned; a NULL doc_id comes before all others. Other
    columns pass through, but for those with the names added here.
    """
    own = docs.select(F.col("doc_id"), F.col("text"))
    deleted = later_copies(stored(numbered_lines(own), "lines"))
    gone = deleted.groupBy("doc_id", "hash").agg(F.collect_set("idx").alias("idx"))
    places, written = gone["idx"], docs["text"]
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(written) == gone["hash"]), "left")
    lines = F.split(written, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    text = F.when(places.isNull(), written).otherwise(
        F.array_join(F.transform(kept, lambda k: F.get(lines, k)), "\n"))
    n_lines = F.when(written.isNull(), 0).otherwise(F.size(lines)).cast("long")
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(*columns, n_lines.alias("n_lines"),
                         F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_deleted"))


ORACLE_SQL = rf"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS idx
  FROM documents
), worded AS (
  SELECT doc_id, line, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS seq,
         len(regexp_extract_all(line, '[^ \t\n\v\f\r]+')) >= {MIN_WORDS} AS long
  FROM split WHERE regexp_matches(line, '[^ \t\n\v\f\r]')
), behind AS (
  SELECT *, [line, {", ".join(f"lead(line, {k}) OVER doc" for k in range(1, MIN_LINES))}] AS run,
         lead(line, {MIN_LINES - 1}) OVER doc IS NOT NULL AS whole
  FROM worded WINDOW doc AS (PARTITION BY doc_id ORDER BY seq)
), later AS (
  SELECT doc_id, idx, seq,
         long AND row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS line_later,
         whole AND row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) > 1 AS run_later
  FROM behind
), gone AS (
  SELECT doc_id, idx, line_later OR max(run_later) OVER (
           PARTITION BY doc_id ORDER BY seq ROWS BETWEEN {MIN_LINES - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM later
), kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.idx) FILTER (WHERE NOT coalesce(g.gone, false)) AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE g.gone) AS n_deleted
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.idx = g.idx GROUP BY s.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
