"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmaq.llm import (chat, combinations, language, linededup, neardup, neighbours, packing, perplexity, phrases,
                        pieces, quality, spelling, wrappers)
from tarmaq.llm.common import crc_mod, load, stored, tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows that are not held out; predicts every row from its text."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs.filter(crc_mod("doc_id", 5) != 0))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return language.annotate(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the perplexity verdict of every document."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    measured = perplexity.measure(docs, perplexity.train(docs)).drop("text")
    judged = perplexity.judge(stored(measured, "measured"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "log_perplexity")


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, projects the pieces to its bytes and decodes them again."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.digest(docs, tokenizer("piece_bpe_32k.model")).drop("text")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels that are not held out; scores every document."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.deduplicate(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return neighbours.search(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation, and one full of control strings, and reads them back."""
    turns = load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(turns.union(extra)))


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.extract(load(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs."""
    return linededup.deduplicate(load(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_lines", "n_deleted", "text")


ORACLE["op10_line_dedup"] = linededup.ORACLE_SQL


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 85 % of their four-word shingles."""
    return combinations.deduplicate(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.group(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language over all documents."""
    return phrases.collocations(load(spark, sf_dir, "documents", "text", "lang"))


ORACLE["op13_phrases"] = phrases.oracle_sql()
