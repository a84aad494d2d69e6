"""Quality rules: base counts of a text and perplexity bands by language.

The language model is a modified Kneser-Ney model of ``ORDER``-grams of UTF-8
bytes. Every byte is a symbol of its own, and every n-gram of every text counts:
the model grows with the different n-grams of the corpus. Spark counts them; the
finished model is broadcast: one sorted array of n-grams of all orders, with
log-probability and back-off weight of each (16 bytes an n-gram). Bands come from
the quartiles of log-perplexity by language, over all distinct texts that pass
the base rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import IS_WORD, add_columns, hash_spans, mix, row_sums, spans, text_blocks, windows, words

ORDER = 4
START = 0  # before a text
SYMBOLS = 257  # START and the bytes, each by its own number plus one

#: Different n-grams that a counting task holds before it hands them on.
HELD = 1 << 21

#: Least distance of the quartiles that a band is made from, in log-perplexity.
LEAST_SPREAD = 0.03

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def base_block(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of ``BASE`` for each text."""
    n = len(offsets) - 1
    hashes, starts, ends, firsts = words(data, offsets)
    # code points: bytes that do not continue one
    chars = np.concatenate(([0], np.cumsum(IS_WORD[data] & ((data & 0xC0) != 0x80))))
    marks = np.concatenate(([0], np.cumsum(MARKS[data])))
    word_chars, n_symbols = np.diff(chars[offsets]), np.diff(marks[offsets])

    grams, edges = windows(hashes, firsts, 3)
    row = np.repeat(np.arange(n), np.diff(edges))
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(grams):
        keys = mix(grams + row.astype(np.uint64))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = np.flatnonzero(counts[inverse] > 1)
        at = again - edges[row[again]] + firsts[row[again]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
    n_repeat = row_sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), firsts)

    lines, finish, first_line = spans(data != 10, offsets)
    worded = np.concatenate(([0], np.cumsum(IS_WORD[data])))
    some = worded[finish] > worded[lines]
    keys = hash_spans(data, lines, finish)
    line_row = np.repeat(np.arange(n), np.diff(first_line))
    dup = np.zeros(n, np.int64)
    if some.any():
        keys, line_row = mix(keys[some] + line_row[some].astype(np.uint64)), line_row[some]
        _, first = np.unique(keys, return_index=True)
        later = np.ones(len(keys), bool)
        later[first] = False
        dup = np.bincount(line_row[later], minlength=n)
    return [np.diff(firsts), word_chars, n_symbols, dup, n_repeat]


def codes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the ``ORDER``-gram that ends at each byte."""
    pad = ORDER - 1
    n = len(offsets) - 1
    padded = np.full(len(data) + pad * n, START, np.int64)
    padded[np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), np.diff(offsets))] = data.astype(np.int64) + 1
    code = padded[pad:].copy()
    for k in range(1, ORDER):
        code += padded[pad - k:len(padded) - k] * SYMBOLS ** k
    # row r's bytes end at its offsets, plus the padding of the rows before it
    edges = offsets + pad * np.arange(n + 1)
    inside = np.ones(len(code), bool)
    for k in range(pad):  # the padding before the next text
        inside[edges[1:-1] - 1 - k] = False
    return code[inside]


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, sorted, with the sums of their counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    sort = np.argsort(code, kind="stable")
    code = code[sort]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(n[sort], first)


def _count(batches):
    codes, counts, waiting = [], [], 0
    for batch in batches:
        for _, _, data, offsets, _ in text_blocks(batch.column("text")):
            if not len(data):
                continue
            code, n = np.unique(codes_of(data, offsets), return_counts=True)
            codes.append(code)
            counts.append(n)
            waiting += len(code)
            if waiting > 2 * HELD:
                code, n = _added(codes, counts)
                if len(code) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                    code, n = code[:0], n[:0]
                codes, counts, waiting = [code], [n], len(code)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _added(codes, counts)], ["code", "n"])


@dataclass
class CharacterModel:
    """N-grams by key: keys sorted, log-probability (NaN: a context only), log back-off weight as a context."""

    keys: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    unseen: float = -np.log(SYMBOLS)  # log-probability of a symbol that never occurs

    def find(self, codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of each n-gram in the arrays, and whether it is there."""
        wanted = gram_key(codes, order)
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == wanted if len(self.keys) else np.zeros(len(wanted), bool)

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each ``ORDER``-gram's last symbol."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            part = codes[open_] % SYMBOLS ** order
            at, there = self.find(part, order)
            if len(self.keys):
                there &= ~np.isnan(self.logp[at])
            out[open_[there]] += self.logp[at[there]]
            open_, part = open_[~there], part[~there]
            if order > 1 and len(open_):
                at, there = self.find(part // SYMBOLS, order - 1)
                out[open_[there]] += self.backoff[at[there]]
        out[open_] += self.unseen
        return out


def gram_key(codes: np.ndarray, order: int) -> np.ndarray:
    """One number for code and order; sorted codes have sorted keys, so they are looked up side by side."""
    return codes.astype(np.uint64) * np.uint64(8) + np.uint64(order)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D0..D3 of modified Kneser-Ney; the usual defaults where counts of counts are missing."""
    n = [int((counts == k).sum()) for k in range(1, 5)]
    if min(n) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    found = [0.0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]
    return np.array([min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(found)])


def estimate(code: np.ndarray, n: np.ndarray) -> CharacterModel:
    """The model from the counts of its highest order."""
    order_codes, order_counts = {ORDER: code.astype(np.int64)}, {ORDER: n}
    for order in range(ORDER - 1, 0, -1):  # how many symbols an n-gram follows
        upper = order_codes[order + 1]
        order_codes[order], order_counts[order] = np.unique(upper % SYMBOLS ** order, return_counts=True)
    below = np.full(SYMBOLS, 1 / SYMBOLS)  # probabilities of the order below, by its codes
    below_codes = np.arange(SYMBOLS)
    keys, logp, weights = [], [], {}
    for order in range(1, ORDER + 1):
        codes, counts = order_codes[order], order_counts[order].astype(np.float64)
        cut = discounts(order_counts[order])[np.minimum(order_counts[order], 3)]
        context = codes // SYMBOLS
        own, at = np.unique(context, return_inverse=True)
        total, kept = np.bincount(at, counts), np.bincount(at, cut)
        gamma = kept / total
        lower = below[np.searchsorted(below_codes, codes % SYMBOLS ** max(order - 1, 1))] if order > 1 else 1 / SYMBOLS
        p = (counts - cut) / total[at] + gamma[at] * lower
        weights[order - 1] = own, np.log(gamma)
        keys.append(gram_key(codes, order))
        logp.append(np.log(p))
        below, below_codes = p, codes
    unseen = float(weights[0][1][0] - np.log(SYMBOLS)) if len(weights[0][1]) else -np.log(SYMBOLS)
    backoff = []
    for order in range(1, ORDER + 1):
        own, gamma = weights.get(order, (np.zeros(0, np.int64), np.zeros(0)))
        found = np.zeros(len(order_codes[order]))
        if len(own):
            at = np.minimum(np.searchsorted(own, order_codes[order]), len(own) - 1)
            found = np.where(own[at] == order_codes[order], gamma[at], 0.0)
        backoff.append(found)
        # contexts that only ever start a text are no n-grams of their own
    extra = [(order, own[~np.isin(own, order_codes[order])], gamma[~np.isin(own, order_codes[order])])
             for order, (own, gamma) in weights.items() if order]
    for order, own, gamma in extra:
        keys.append(gram_key(own, order))
        logp.append(np.full(len(own), np.nan))
        backoff.append(gamma)
    keys = np.concatenate(keys)
    sort = np.argsort(keys)
    return CharacterModel(keys[sort], np.concatenate(logp)[sort].astype(np.float32),
                          np.concatenate(backoff)[sort].astype(np.float32), unseen)


def train(docs: DataFrame) -> CharacterModel:
    """Count every text of ``docs``, copies once as in the bands, and estimate the model."""
    counts = (docs.select("text").filter("text IS NOT NULL").distinct().mapInArrow(_count, "code long, n long")
              .groupBy("code").agg(F.sum("n").alias("n"))).toArrow()
    code, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    sort = np.argsort(code)
    return estimate(code[sort], n[sort])


def measure(docs: DataFrame, model: CharacterModel) -> DataFrame:
    """``docs`` with the counts of ``BASE``, log_perplexity (natural, per byte; NULL without text) and text_key.

    text_key is a hash that equal texts share. NULL and empty texts have counts of 0. Repeated rows stay repeated; other
    columns pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        total, text_keys = [np.zeros(0)], [np.zeros(0, np.uint64)]
        for _, _, data, offsets, _ in text_blocks(batch.column("text")):
            for column, part in zip(columns, base_block(data, offsets)):
                column.append(part)
            text_keys.append(hash_spans(data, offsets[:-1], offsets[1:]))
            code, place = np.unique(codes_of(data, offsets), return_inverse=True)
            found = held.value.log_probability(code)[place]
            total.append(-row_sums(found, offsets) / np.maximum(np.diff(offsets), 1))
        lengths = np.concatenate(columns[0])
        value = np.concatenate(total)
        empty = np.diff(text_offsets(batch.column("text"))) == 0
        return [pa.array(np.concatenate(c).astype(np.int64)) for c in columns] + [
            pa.array(value, mask=empty) if len(lengths) else pa.array([], pa.float64()),
            pa.array(np.concatenate(text_keys).view(np.int64))]

    return add_columns(docs, run, f"{BASE}, log_perplexity double, text_key long", "text")


def text_offsets(column: pa.Array) -> np.ndarray:
    from tarmaq.llm.common import utf8
    return utf8(column)[1]


def base_failed():
    """Fewer than 50 words, or over half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, fence: float = 3.0) -> DataFrame:
    """Adds base_failed, low, high and kept: log-perplexity inside the language's band.

    The band reaches ``fence`` interquartile ranges, of ``LEAST_SPREAD`` at
    least, beyond the quartiles of the texts of that language (NULL is one more)
    that pass the base rules; copies of a text count once. The measured rows are
    read twice, so they should be a table.
    """
    rows = measured.withColumn("base_failed", base_failed())
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10000)
    texts = (rows.filter(~F.col("base_failed")).groupBy(F.col("lang").alias("band_lang"), "text_key")
             .agg(F.min("log_perplexity").alias("log_perplexity")))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_SPREAD))
    bands = (texts.groupBy("band_lang").agg(quartiles.alias("q"))
             .select("band_lang", *[(F.col("q")[k] + sign * fence * spread).alias(name)
                                    for k, sign, name in ((0, -1, "low"), (1, 1, "high"))]))
    return (rows.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
            .withColumn("kept", F.coalesce(~F.col("base_failed") & F.col("log_perplexity").between(
                F.col("low"), F.col("high")), F.lit(False))))
