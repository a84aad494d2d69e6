"""The corpus pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import language, linededup, neardup, packing, quality
from tarmaq.llm.common import load, prepare, stored, tokenizer
from tarmaq.session import run_dir

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.5
#: Least share of what a language's own texts gain over even odds, on the mean of a text's n-grams.
MIN_LANGUAGE_FIT = 0.5
#: Least probability of good quality.
MIN_QUALITY = 0.5


def _aside(docs: DataFrame, *needed: str):
    """``docs`` with other columns under names that clash with nothing, and the way back."""
    names = [c if c in needed else f"_{k}_aside" for k, c in enumerate(docs.columns)]
    old = dict(zip(names, docs.columns))
    return docs.toDF(*names), lambda frame: frame.select(*[F.col(n).alias(c) for n, c in old.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, those of which no language is likelier than all others, and those unlike it.

    The last are noise and texts in languages that were not learned: the mean
    log-probability of their n-grams is far below that of the texts that the
    language was learned from, whatever their length.
    """
    prepare(spark)
    docs, restore = _aside(docs, "text", "lang")
    found = language.annotate(docs, language.train(docs), fit=True)
    return restore(found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)
                                & (F.col("lang_fit") >= MIN_LANGUAGE_FIT)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the classifier, learned from the labels, takes for bad ones."""
    docs, restore = _aside(docs, "doc_id", "text", "n_chars")
    model = quality.train(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return restore(quality.score(docs, model).filter(F.col("quality_score") >= MIN_QUALITY))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document of which nothing is left goes."""
    prepare(spark)
    docs, restore = _aside(docs, "doc_id", "text", "n_chars")
    changed = F.col("n_deleted") > 0
    left = linededup.deduplicate(docs).filter(~changed | F.col("text").rlike(linededup.WORD))
    return restore(left.withColumn(
        "n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies; repeated rows of a doc_id and text are one."""
    prepare(spark)
    text_hash = F.xxhash64("text")
    # texts that share a doc_id, all but one of them, are named by a hash of both
    shared = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(text_hash).alias("_least"), F.max(text_hash).alias("_most")).filter("_least != _most")
        .select(F.col("doc_id").alias("_shared"), "_least"), "shared-ids")
    other = F.col("_least").isNotNull() & (F.col("_least") != text_hash)
    named = (docs.join(shared, F.col("doc_id") == F.col("_shared"), "left")
             .withColumn("_name", F.when(other, F.xxhash64("doc_id", text_hash)).otherwise(F.col("doc_id").cast("long"))))
    kept = (neardup.deduplicate(named.select(F.col("_name").alias("doc_id"), "text"))
            .filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_name")).distinct())
    unnamed = docs.filter("doc_id IS NULL")
    return named.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select(*docs.columns).union(unnamed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup),
          ("near_dedup", near_dedup), ("packing", pack)]

#: Language models, classifiers and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    folder = run_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
