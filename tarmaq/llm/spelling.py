"""Spelling variants by permuterm rotations, in DataFrame operations only.

A word is marked with a terminator, and all its rotations are sorted. Rotate an
edited character to the end, and what stands before it is the same for the word
and its variant: words that differ by a replaced character share a rotation's
prefix that skips the last character, and a word that lacks the character has
that prefix as a whole rotation. So a word gives two kinds of rows:

* every rotation in full, with no tail;
* every rotation that ends in a letter, cut to the prefix, with the letter as tail.

Rows are sorted by prefix over ranges. A group of equal prefixes holds one full
rotation at most, and one row per letter of the alphabet (90), so it is bounded
whatever the corpus. It is scanned once: each member gets the number of its
neighbours there and the most frequent one; no pairs are written. A doubled
letter could be dropped at either place; only the first place counts, so that
each pair of near words meets exactly once. Words are not carried along: the
prefix, the tail and the terminator's place give the word back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import stored

RUN = r"[A-Za-zÀ-ÿ]+"
MARK = "$"  # sorts before every letter, and is none
MIN_LENGTH, MIN_COUNT = 6, 5
SLIP = 199   # one occurrence in so many loses a character
RATIO = 5    # a form is at least so many times as frequent


def words(docs: DataFrame) -> DataFrame:
    """Words and their number of occurrences: (word, n).

    A word is a run of letters with A-Z lower-cased, of at least ``MIN_LENGTH``
    code points and ``MIN_COUNT`` occurrences. A NULL text has none; a NULL
    doc_id counts as an empty one. Other columns are not looked at.
    """
    runs = (docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
            .filter(F.length("run") >= MIN_LENGTH))
    upper = "".join(map(chr, range(65, 91)))
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(
        F.translate("run", upper, upper.lower()))
    runs = runs.select("doc_id", lowered.alias("run"))
    mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", mark.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (runs.select(F.when(F.col("h") % SLIP == 0, shorter).otherwise(F.col("run")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)))


def rotations(counted: DataFrame) -> DataFrame:
    """The permuterm rows of the words: (prefix, tail, n); an empty tail is a full rotation."""
    marked = F.concat("word", F.lit(MARK))
    turned = (counted.select("n", marked.alias("w"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
              .select("n", "i", F.concat(F.substring("w", F.col("i") + 1, F.length("w")),
                                         F.substring("w", F.lit(1), F.col("i"))).alias("r")))
    kinds = F.when(F.col("i") == 0, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    rows = turned.select("n", "r", F.explode(kinds).alias("cut"))
    return rows.select(
        F.when(F.col("cut"), F.substring("r", F.lit(1), F.length("r") - 1)).otherwise(F.col("r")).alias("prefix"),
        F.when(F.col("cut"), F.right("r", F.lit(1))).otherwise("").alias("tail"), "n")


def _word(prefix: str, tail: str) -> Column:
    """The word whose rotation is the prefix and the tail."""
    return F.concat(F.substring_index(prefix, MARK, -1), F.col(tail), F.substring_index(prefix, MARK, 1))


def near_words(counted: DataFrame) -> DataFrame:
    """Per word that has any: (word, n_near, best), best the struct (-n, word) of its most frequent near word."""
    groups = (rotations(counted).repartitionByRange("prefix").sortWithinPartitions("prefix", "tail")
              .withColumn("member", F.struct((-F.col("n")).alias("m"), _word("prefix", "tail").alias("word"), "tail"))
              .groupBy("prefix").agg(F.collect_list("member").alias("members"))
              .filter(F.size("members") > 1)
              .select(F.right("prefix", F.lit(1)).alias("last"), "members", F.explode("members").alias("me")))

    def meets(other):
        """Two letters there, or a letter against none, at the first place of a doubled letter."""
        doubled = ((other["tail"] == "") & (F.col("me.tail") == F.col("last"))
                   | (F.col("me.tail") == "") & (other["tail"] == F.col("last")))
        return (other["tail"] != F.col("me.tail")) & ~doubled

    met = groups.select(F.col("me.word").alias("word"), F.filter("members", meets).alias("others"))
    best = F.array_min(F.transform("others", lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))))
    return (met.filter(F.size("others") > 0)
            .select("word", F.size("others").cast("long").alias("k"), best.alias("best"))
            .groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for every word with a form, by pointer doubling.

    A form is ``RATIO`` times as frequent as its word, so from ``MIN_COUNT`` up to
    ``most`` occurrences there are so many steps at most, and rounds their logarithm.
    """
    steps = max(1, math.ceil(math.log(max(most, 1) / MIN_COUNT, RATIO)) if most > MIN_COUNT else 1)
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        found = stored(found, "roots")
        onward = found.toDF("root", "next")
        found = found.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found


def group(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word with the most occurrences (ties: the smallest in
    code-point order), if it has ``RATIO`` times the word's; the root is the last
    form that forms lead to, the word itself if it has none. No documents, or no
    word often enough, give no rows.
    """
    counted = stored(words(docs), "words")
    judged = stored(
        counted.join(near_words(counted), "word", "left")
        .withColumn("form_n", F.when(-F.col("best.m") >= RATIO * F.col("n"), -F.col("best.m")))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n",
                F.when(F.col("form_n").isNotNull(), F.col("best.word")).alias("form")), "near")
    most = judged.agg(F.max("n")).head()[0] or 0
    led = roots(judged.filter("form IS NOT NULL"), most)
    return (judged.join(led, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
