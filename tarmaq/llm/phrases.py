"""Phrase collocations by stripes.

A stripe is an associative counter of the words that follow one prefix. Tasks
fill stripes over many texts and Spark merges them elementwise, so the entry of
``prefix`` for ``next`` is the number of times the phrase ``prefix next`` occurs.
Counted phrases give everything from that one structure: the extensions of a
prefix, the totals of both parts of a cut, and the largest extension of a phrase
to the right (the maximum of its own stripe) and to the left (the maximum of
the entries that end in it), which decides whether it is subsumed.

Every part of a phrase occurs as often as the phrase at least. So pairs are counted
of words that are frequent, and longer phrases where all their pairs are. What is
frequent goes to the tasks as a bitmap of fixed size (``BITS``) over hashes of
phrases. Even so most phrases are rare; each level is first counted as hashes, in
an array of that size, and as text only where a place can hold a frequent phrase.
A phrase that shares a place costs some work and changes no result, however full
bitmap and array are. Stripes of single words are dealt in ``SHARDS`` by the next
word, as a common word is followed by many. Counts are exact; phrases travel as text.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.llm.common import LOWER, STEP_KEYS, hash_spans, mix, spans, stored, text_blocks

LONGEST, LEAST, TOP = 5, 100, 2000
BITS = 1 << 26
SHARDS = 8
#: Parts of the prefixes that are sent and summed as one.
BUCKETS = 512
#: Parts of a lang's phrases that are ranked on their own before all are.
SHARES = 64
#: Entries that a task's stripes hold before they are handed on.
HELD = 400_000

CUTS = b".,;:!?\n\v\f\r"
BREAK = np.zeros(256, bool)
BREAK[list(CUTS)] = True
IN_WORD = ~BREAK
IN_WORD[list(b" \t")] = False

PHRASE = "lang string, prefix string, next string, n long"
_EMPTY_LANG = "und"


def _words(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, starts, ends, first word of each text, and whether a word goes on the piece before it."""
    starts, ends, firsts = spans(IN_WORD[data], offsets)
    breaks = np.concatenate(([0], np.cumsum(BREAK[data])))
    joined = np.zeros(len(starts), bool)
    if len(starts) > 1:
        joined[1:] = breaks[starts[1:]] == breaks[ends[:-1]]
    joined[firsts[:-1][firsts[:-1] < len(starts)]] = False
    return hash_spans(data, starts, ends), starts, ends, firsts, joined


def _seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return hash_spans(raw, np.array([0]), np.array([len(raw)]))[0] if len(raw) else np.uint64(1)


def phrase_hashes(words: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (n - 1 places fewer); seeds tell languages apart."""
    count = max(len(words) - n + 1, 0)
    total = seeds[:count].copy()
    for k in range(n):
        total += words[k:k + count] * STEP_KEYS[k]
    return mix(total)


def _langs(batch) -> list[str]:
    return [_EMPTY_LANG if v is None else v for v in batch.column("lang").to_pylist()]


def bitmap(frequent: DataFrame) -> np.ndarray:
    """A bit for each (lang, phrase) of a table; ``BITS`` bits whatever its size."""
    def places(batches):
        for batch in batches:
            langs = _langs(batch)
            for low, high, data, offsets, _ in text_blocks(batch.column("phrase")):
                hashes, _, _, firsts, _ = _words(data, offsets)
                sums = np.array([_seed(lang) for lang in langs[low:high]], np.uint64)
                sizes = np.diff(firsts)
                for k in range(LONGEST):
                    some = np.flatnonzero(sizes > k)
                    sums[some] += hashes[firsts[some] + k] * STEP_KEYS[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mix(sums) & np.uint64(BITS - 1)).astype(np.int64) + 1)], ["place"])

    rows = (frequent.select("lang", "phrase").mapInArrow(places, "place long")
            .groupBy(F.bitmap_bucket_number("place").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
    out = np.zeros(BITS // 8, np.uint8)  # a row per 32,768 bits: BITS / 8 bytes in all
    for row in rows:
        bits = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["part"] - 1) * 4096  # parts, like places, count from 1
        out[at:at + 4096] = bits[:len(out) - at]
    return out


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    place = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _walk(batches, bits: np.ndarray, part: int, longest: int):
    """Some megabytes of text at a time: languages, each word's language, lower-cased bytes, word starts and
    ends, and for each size from part + 1 to ``longest`` the places and hashes of the phrases whose parts of
    ``part`` words have their bit."""
    for batch in batches:
        langs = _langs(batch)
        for low, high, data, offsets, _ in text_blocks(batch.column("text"), 8 << 20):
            data = LOWER[data]
            words, starts, ends, firsts, joined = _words(data, offsets)
            names = sorted(set(langs[low:high]))
            code = np.repeat(np.array([names.index(v) for v in langs[low:high]], np.int64), np.diff(firsts))
            seeds = np.array([_seed(v) for v in names], np.uint64)[code] if len(code) else words[:0]
            # good[k]: the `part` words from k on stand in one piece and have their bit
            good = _held(bits, phrase_hashes(words, seeds, part))
            for k in range(1, part):
                good &= joined[k:k + len(good)]
            found = []
            for size in range(part + 1, longest + 1):
                places = max(len(words) - size + 1, 0)
                ok = good[:places].copy()
                for k in range(1, size - part + 1):
                    ok &= good[k:k + places] & joined[k + part - 1:k + part - 1 + places]
                at = np.flatnonzero(ok)
                found.append((size, at, phrase_hashes(words, seeds, size)[at]))
            yield names, code, data, starts, ends, found


def crowded(docs: DataFrame, part: int, longest: int, known: np.ndarray, least: int) -> np.ndarray:
    """A bit for each place of the bitmap on which the phrases of known parts fall ``least`` times in all.

    Most phrases are rare, and a place without a bit holds rare ones only, so they
    need not be counted as text. A task counts in an array of a byte per place (of
    more than 255, if ``least`` is) and hands on what is not zero, in slices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = np.dtype("u1") if least < 256 else np.dtype("<u4")
    slices, width = BITS >> 16, 1 << 16

    def count(batches):
        bits, seen = shared.value, np.zeros(BITS, kind)
        for *_, found in _walk(batches, bits, part, longest):
            for _, _, hashes in found:
                place, n = np.unique(hashes & np.uint64(BITS - 1), return_counts=True)
                place = place.astype(np.int64)
                seen[place] = np.minimum(seen[place].astype(np.int64) + n, least).astype(kind)
        for k in range(slices):
            own = seen[k * width:(k + 1) * width]
            place = np.flatnonzero(own)
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([place.astype("<u2").tobytes()], pa.binary()),
                     pa.array([own[place].tobytes()], pa.binary())], ["slice", "place", "n"])

    def add(batches):
        own, total = None, None
        for batch in batches:
            for k, place, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "place", "n"))):
                if k != own:
                    if own is not None:
                        yield out(own, total)
                    own, total = k, np.zeros(width, np.int64)
                total[np.frombuffer(place, "<u2")] += np.frombuffer(n, kind)
        if own is not None:
            yield out(own, total)

    def out(own, total):
        return pa.RecordBatch.from_arrays(
            [pa.array([own], pa.int32()),
             pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    rows = (docs.select("lang", "text").mapInArrow(count, "slice int, place binary, n binary")
            .repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, bits binary").collect())
    full = np.zeros(BITS // 8, np.uint8)  # 8 KB from each slice: BITS / 8 bytes in all
    for row in rows:
        full[row["slice"] * width // 8:(row["slice"] + 1) * width // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return full


def _stripes(docs: DataFrame, part: int, longest: int, known: np.ndarray, full: np.ndarray) -> DataFrame:
    """Stripes of all phrases of part + 1 to ``longest`` words whose parts of ``part`` words have their bit, and
    they themselves in ``full``: rows of stripes (lang, prefix, next, n) of one bucket."""
    shared = docs.sparkSession.sparkContext.broadcast((known, full))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.list_(pa.string())),
                               ("n", pa.list_(pa.int64()))]))

    def rows(stripes):
        """The stripes of each bucket as one row."""
        blocks: dict[int, list] = {}
        for (lang, prefix, shard), stripe in stripes.items():
            blocks.setdefault((zlib.crc32(prefix) + shard) % BUCKETS, []).append(
                {"lang": lang, "prefix": prefix.decode(), "next": [w.decode() for w in stripe], "n": list(stripe.values())})
        for bucket, block in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], kind)],
                                             ["bucket", "stripes"])

    def fill(stripes, lang, raw, starts, ends, at, size, hashes):
        """Count the phrases of ``size`` words at the given places, equal ones at once."""
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        added = 0
        for place, count in zip(at[first].tolist(), counts.tolist()):
            *before, last = [raw[starts[k]:ends[k]] for k in range(place, place + size)]
            shard = last[0] * 31 + last[-1] if size == 2 else 0
            stripe = stripes.setdefault((lang, b" ".join(before), shard % SHARDS), {})
            added += last not in stripe
            stripe[last] = stripe.get(last, 0) + count
        return added

    def count(batches):
        bits, full = shared.value
        stripes, held = {}, 0
        for lang_names, code, data, starts, ends, found in _walk(batches, bits, part, longest):
            raw, starts, ends = data.tobytes(), starts.tolist(), ends.tolist()
            for size, at, hashes in found:
                some = _held(full, hashes)
                at, hashes = at[some], hashes[some]
                for k, lang in enumerate(lang_names):
                    own = code[at] == k
                    held += fill(stripes, lang, raw, starts, ends, at[own], size, hashes[own])
                    if held >= HELD:
                        yield from rows(stripes)
                        stripes, held = {}, 0
        yield from rows(stripes)

    return docs.select("lang", "text").mapInArrow(
        count, "bucket int, stripes array<struct<lang: string, prefix: string, next: array<string>, n: array<long>>>")


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes summed elementwise; entries of at least ``least``: (lang, prefix, next, phrase, f).

    The rows of a bucket follow each other, and the summed stripes of one bucket are held at a time.
    """
    def entries(total):
        kept = [(lang, prefix, word, n) for (lang, prefix), stripe in total.items()
                for word, n in stripe.items() if n >= least]
        lang, prefix, word, n = zip(*kept) if kept else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(prefix, pa.string()), pa.array(word, pa.string()),
             pa.array([f"{p} {w}" for p, w in zip(prefix, word)], pa.string()), pa.array(n, pa.int64())],
            ["lang", "prefix", "next", "phrase", "f"])

    def add(batches):
        bucket, total = None, {}
        for batch in batches:
            for k, block in zip(*(c.to_pylist() for c in batch.columns)):
                if k != bucket:
                    yield entries(total)
                    bucket, total = k, {}
                for stripe in block:
                    own = total.setdefault((stripe["lang"], stripe["prefix"]), {})
                    for word, n in zip(stripe["next"], stripe["n"]):
                        own[word] = own.get(word, 0) + n
        yield entries(total)

    return (stripes.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(add, "lang string, prefix string, next string, phrase string, f long"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word: the stripe of the empty prefix."""
    upper = "".join(map(chr, range(65, 91)))
    pieces = F.split(F.translate("text", upper, upper.lower()), r"[ \t.,;:!?\n-\r]+")
    return (docs.select("lang", F.explode(pieces).alias("phrase")).filter("phrase != ''")
            .groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("f")))


def with_score(rows: DataFrame) -> DataFrame:
    """``rows`` with score = floor(1000 a n / (l r)), exact while 1000 a n has 38 digits at most."""
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    up = wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")
    return (rows.withColumns({"_up": up.cast("decimal(38,0)"), "_down": (wide["l"] * wide["r"]).cast("decimal(38,0)")})
            .withColumn("score", F.expr("_up div _down")).drop("_up", "_down"))


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with ``least`` occurrences, (lang, prefix, next, phrase, f), and
    the number n of word occurrences per lang."""
    counted = stored(word_counts(docs), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [counted.filter(F.col("f") >= least)
              .select("lang", F.lit("").alias("prefix"), F.col("phrase").alias("next"), "phrase", "f")]
    for part, upto in ((1, 2), (2, longest))[:longest - 1]:
        known = bitmap(levels[-1])
        full = crowded(docs, part, upto, known, least)
        levels.append(stored(merged(_stripes(docs, part, upto, known, full), least), "stripes"))
    return reduce(DataFrame.unionByName, levels), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Words are what blanks and tabs separate within pieces, pieces what ``.,;:!?``
    and line ends separate; A-Z are lower-cased. A phrase of 2 to ``longest`` words
    with a >= ``least`` occurrences scores floor(1000 a n / (l r)) at a cut into two
    phrases of l and r occurrences; its lowest cut counts (ties: the shortest first
    part). A phrase that a longer candidate contains as often as it occurs is left
    out. A NULL lang is ``und``, a NULL text empty; no texts give no rows. Rows that
    repeat a doc_id count each. Other columns are not looked at.
    """
    docs = docs.select(F.coalesce("lang", F.lit(_EMPTY_LANG)).alias("lang"), "text")
    found, totals = frequent_phrases(docs, least, longest)
    found = stored(found, "phrases")
    candidates = found.filter("prefix != ''")
    # One word more on either side is enough: what a longer phrase subsumes, the step between does too.
    right = candidates.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("f").alias("more"))
    tail = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    left = candidates.groupBy("lang", tail.alias("phrase")).agg(F.max("f").alias("more"))
    more = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    open_ = (candidates.join(more, ["lang", "phrase"], "left")
             .filter(F.col("more").isNull() | (F.col("more") < F.col("f")))
             .select("lang", "phrase", F.col("f").alias("a")))

    words = F.split("phrase", " ")
    cut = (open_.select("lang", "phrase", "a", words.alias("w"), F.explode(
        F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
        .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest")))
    parts = found.select("lang", "phrase", "f")
    scored = (cut.join(parts.toDF("lang", "first", "l"), ["lang", "first"])
              .join(parts.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang"))
    scored = with_score(scored)
    best = (scored.groupBy("lang", "phrase", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
            .select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score"))
    # in shares of a lang first: its last ranking then sees SHARES times ``top`` rows at most
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return (best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same rows in DuckDB: every phrase of every text is counted."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {k} AS size, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase "
        f"FROM word WHERE i + {k - 1} <= len(w)" for k in range(1, longest + 1))
    return rf"""
WITH piece AS (
  SELECT coalesce(lang, '{_EMPTY_LANG}') AS lang, regexp_extract_all(
           unnest(regexp_split_to_array({lower}, '[.,;:!?\n\v\f\r]')), '[^ \t]+') AS w
  FROM documents WHERE text IS NOT NULL
), word AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece
), gram AS ({grams}
), f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= {least}
), total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang
), candidate AS (SELECT * FROM f WHERE size >= 2
), longer AS (
  SELECT s.lang, array_to_string(list_slice(string_split(s.phrase, ' '), i, i + k - 1), ' ') AS phrase, max(s.f) AS more
  FROM candidate s, range(2, {longest}) AS t(k), range(1, {longest}) AS u(i)
  WHERE k < s.size AND i + k - 1 <= s.size GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN longer USING (lang, phrase) WHERE more IS NULL OR 100 * more < 100 * c.f
), cut AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS first,
         array_to_string(list_slice(string_split(phrase, ' '), k + 1, size), ' ') AS rest
  FROM kept, range(1, {longest}) AS t(k) WHERE k < size
), scored AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, t.n,
         (1000::HUGEINT * a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = first JOIN f r ON r.lang = c.lang AND r.phrase = rest
  JOIN total t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {top}"""
