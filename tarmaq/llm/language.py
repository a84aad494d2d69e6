"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams come from every training text, added up by
Spark. The log-probability matrix (buckets x languages) is broadcast: its size
is ``BUCKETS`` rows of 4 bytes per language, checked against
``MAX_MODEL_BYTES``. A batch is scored sparsely: the matrix rows of its n-grams
are gathered and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import add_columns, row_sums, text_blocks

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
MAX_MODEL_BYTES = 256 << 20
GRAM_KEYS = np.random.default_rng(7).integers(1, 2**31, (len(ORDERS), max(ORDERS)), dtype=np.uint32) * 2 + 1
PRIOR = -1  # the "bucket" that counts documents
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, 0 for whatever is no letter."""
    table = np.zeros(0x11000, np.uint32)
    for code in range(len(table)):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_fold: np.ndarray | None = None


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows (0: no letter) and row offsets in code points."""
    global _fold
    if _fold is None:
        _fold = _fold_table()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    counts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    edges = counts[offsets]
    if len(codes) != edges[-1]:  # not UTF-8: replacement characters moved the rows
        raise ValueError("texts must be UTF-8")
    inside = codes < len(_fold)
    folded = np.where(inside, _fold[np.where(inside, codes, 0)], 0)
    if not inside.all():  # beyond the table: letters by the character database, unfolded
        far = np.unique(codes[~inside])
        alpha = np.array([chr(c).isalpha() for c in far])
        at = np.searchsorted(far, codes[~inside])
        folded[~inside] = np.where(alpha[at], codes[~inside], 0)
    return folded.astype(np.uint32, copy=False), edges


def grams(codes: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
    """For each order: the bucket at each position, ``BUCKETS`` where none counts.

    Runs of non-letters count as one blank, n-grams stay inside their text and
    begin or end in a letter.
    """
    n = len(codes)
    blank = codes == 0
    for order in ORDERS:
        size = n - order + 1
        if size <= 0:
            continue
        value = codes[:size] * GRAM_KEYS[order - 1, 0]
        for k in range(1, order):
            value += codes[k:size + k] * GRAM_KEYS[order - 1, k]
        bucket = (value >> np.uint32(16)).astype(np.int32)
        skip = blank[:size] & blank[order - 1:]
        if order > 2:  # no two blanks in a row
            skip |= blank[1:size + 1] & (blank[:size] | blank[2:])
        bucket[skip] = BUCKETS
        for k in range(1, order):  # would run into the next text
            bucket[(at := edges[1:] - k)[(at >= 0) & (at < size)]] = BUCKETS
        yield bucket


def _count(batches):
    """Per task: n-gram counts by language; the texts' number under PRIOR."""
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        codes_of, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for low, high, data, offsets, _ in text_blocks(batch.column("text")):
            codes, edges = letters(data, offsets)
            own = codes_of[low:high].astype(np.int64)
            for lang in np.unique(own):
                texts[names[lang]] = texts.get(names[lang], 0) + int((own == lang).sum())
            present, local = np.unique(own, return_inverse=True)
            per = np.repeat((local * (BUCKETS + 1)).astype(np.int32), np.diff(edges))
            for bucket in grams(codes, edges):
                found = np.bincount(per[:len(bucket)] + bucket, minlength=(BUCKETS + 1) * len(present))
                for k, part in zip(present, found.reshape(len(present), -1)[:, :BUCKETS]):
                    if names[k] in counts:
                        counts[names[k]] += part
                    else:
                        counts[names[k]] = part.copy()
    for lang, part in counts.items():
        bucket = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(bucket) + 1), pa.string()),
             pa.array(np.append(bucket, PRIOR), pa.int32()),
             pa.array(np.append(part[bucket], texts[lang]), pa.int64())], ["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    weights: np.ndarray  # BUCKETS x languages, float32 log-probabilities; a last row of zeros
    typical: np.ndarray  # mean log-probability of an n-gram in the texts of each language


def train(labelled: DataFrame) -> LanguageModel:
    """Learn from the columns text and lang of every row that has both."""
    rows = labelled.select("text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = (rows.mapInArrow(_count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    names = sorted(r["lang"] for r in counts.filter(F.col("bucket") == PRIOR).select("lang")
                   .limit(MAX_MODEL_BYTES // (4 * BUCKETS) + 1).collect())
    if len(names) * BUCKETS * 4 > MAX_MODEL_BYTES:
        raise ValueError("too many languages for a model that is broadcast")
    table = counts.toArrow()
    lang = np.searchsorted(np.array(names), np.array(table.column("lang").to_pylist(), dtype=str)) if names else []
    bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
    totals = np.full((BUCKETS, len(names)), SMOOTHING)
    prior = np.zeros(len(names))
    if names:
        inside = bucket != PRIOR
        totals[bucket[inside], lang[inside]] += n[inside]
        prior[lang[~inside]] = n[~inside]
        prior = np.log(prior / prior.sum())
    weights = np.log(totals / totals.sum(axis=0, keepdims=True)).astype(np.float32)
    counts_of = totals - SMOOTHING
    typical = (counts_of * weights).sum(axis=0) / np.maximum(counts_of.sum(axis=0), 1)
    return LanguageModel(names, prior, np.vstack([weights, np.zeros((1, len(names)), np.float32)]), typical)


def predict_block(model: LanguageModel, data: np.ndarray, offsets: np.ndarray):
    """Language number (-1: none), posterior and fit of each text.

    The fit is what the text's n-grams gain on the mean over even odds for all
    buckets, as a share of what the language's training texts gain: around 1 for
    its texts of any length, 0 and less for noise.
    """
    n, many = len(offsets) - 1, len(model.languages)
    codes, edges = letters(data, offsets)
    lettered = row_sums((codes > 0).astype(np.int64), edges) > 0
    best, score, fit = np.full(n, -1), np.zeros(n), np.zeros(n)
    if not many or not lettered.any():
        return best, score, fit
    total = np.tile(model.prior, (n, 1))
    count = np.zeros(n, np.int64)
    for bucket in grams(codes, edges):
        total += row_sums(model.weights[bucket], np.minimum(edges, len(bucket)))
        count += row_sums((bucket < BUCKETS).astype(np.int64), np.minimum(edges, len(bucket)))
    own = total.argmax(axis=1)
    mean = (total[np.arange(n), own] - model.prior[own]) / np.maximum(count, 1)
    even = -np.log(BUCKETS)
    fit[lettered] = ((mean - even) / np.maximum(model.typical[own] - even, 1e-9))[lettered]
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best[lettered] = own[lettered]
    score[lettered] = share.max(axis=1)[lettered]
    return best, score, fit


def annotate(docs: DataFrame, model: LanguageModel, fit: bool = False) -> DataFrame:
    """``docs`` with the columns lang_pred and lang_score added, and lang_fit where ``fit`` is set.

    Only the column text is read for a prediction. NULL texts and texts without
    a letter are ``und`` with score 0, as is everything when nothing was
    learned; ties go to the language first in order. Repeated rows stay
    repeated and other columns pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        learned = held.value
        names = np.array([*learned.languages, UNKNOWN], dtype=object)
        limit = max(1 << 14, (4 << 20) // (4 * max(1, len(learned.languages))))
        best, score, fits = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for _, _, data, offsets, _ in text_blocks(batch.column("text"), limit):
            b, s, f = predict_block(learned, data, offsets)
            best.append(b)
            score.append(s)
            fits.append(f)
        found = pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))
        return (*found, pa.array(np.concatenate(fits))) if fit else found

    return add_columns(docs, run, "lang_pred string, lang_score double" + ", lang_fit double" * fit, "text")
