"""Quality classifier: a factorisation machine over hashed words and structure.

Inputs are the presence of hashed words, statistics of the text's structure and
the document's length in the metadata (n_chars). Every pair of inputs interacts
through rank-``RANK`` factors; a text is scored in time linear in its inputs,
as the sum over all pairs is half of (sum of v x) squared less the sum of
(v x) squared. The model is fitted on at most ``MAX_LABELLED`` labelled
documents (those whose hashed doc_id is smallest); its size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import IS_WORD, add_columns, row_sums, text_blocks, words

BUCKETS = 1 << 16
RANK = 8
#: Labelled documents the model is fitted on; the rest of the labels is not read.
MAX_LABELLED = 6000
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.1, 1e-4

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"'\"()[]{}-_/\\@+=~^`"]
STATISTICS = ["log_length", "log_metadata_length", "word_length", "distinct_share", "repeat_share", "line_words",
              *(f"class_{k}" for k in range(len(_CLASSES))), "non_ascii", "has_text"]
_MEMBER = np.zeros((256, len(_CLASSES) + 1), np.float32)
for _k, _c in enumerate(_CLASSES):
    _MEMBER[list(_c), _k] = 1
_MEMBER[0x80:, len(_CLASSES)] = 1


def inputs(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray):
    """Word buckets of each text (each once), their row edges, and the statistics."""
    n = len(offsets) - 1
    hashes, starts, ends, firsts = words(data, offsets, lower=True)
    row = np.repeat(np.arange(n), np.diff(firsts))
    own = np.unique(row * BUCKETS + (hashes >> np.uint64(48)).astype(np.int64))
    edges = np.searchsorted(own, np.arange(n + 1) * BUCKETS)
    buckets = own % BUCKETS

    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    count = np.maximum(np.diff(firsts), 1).astype(np.float64)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    share = row_sums(_MEMBER[data], offsets) / size[:, None]
    word_bytes = row_sums(IS_WORD[data].astype(np.int64), offsets)
    statistics = np.column_stack([
        np.log1p(np.diff(offsets)), np.log1p(np.maximum(n_chars, 0)), word_bytes / count, np.diff(edges) / count,
        row_sums(again, firsts) / count, np.log1p(count / (share[:, 5] * size + 1)),
        np.sqrt(share), np.diff(firsts) > 0])
    return buckets, edges, statistics


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray  # (buckets + statistics) x RANK
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -4, 4)

    def scores(self, buckets, edges, statistics) -> np.ndarray:
        """Probability of label 1 for each row."""
        x = word_values(edges)
        dense = self.standard(statistics)
        per = np.repeat(x, np.diff(edges))[:, None]
        v = self.factors[buckets] * per
        down, wide = self.linear[BUCKETS:], self.factors[BUCKETS:]
        total = row_sums(v, edges) + dense @ wide
        squares = row_sums((v * v).sum(axis=1), edges) + (dense * dense) @ (wide * wide).sum(axis=1)
        raw = (self.bias + row_sums(self.linear[buckets] * per[:, 0], edges) + dense @ down
               + ((total * total).sum(axis=1) - squares) / 2)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def word_values(edges: np.ndarray) -> np.ndarray:
    """The value of each word of a row: rows have length 1."""
    return 1 / np.sqrt(np.maximum(np.diff(edges), 1))


def fit(buckets: np.ndarray, edges: np.ndarray, statistics: np.ndarray, label: np.ndarray) -> FactorisationMachine:
    """Logistic loss, adaptive gradient steps, in a fixed order."""
    rng = np.random.default_rng(5)
    n, wide = len(label), statistics.shape[1]
    size = BUCKETS + wide
    mean = statistics.mean(axis=0) if n else np.zeros(wide)
    scale = statistics.std(axis=0) + 1e-3 if n else np.ones(wide)
    share = (label.sum() + 1) / (n + 2)
    model = FactorisationMachine(float(np.log(share / (1 - share))) if n else 0.0, np.zeros(size),
                                 rng.standard_normal((size, RANK)) * 0.05, mean, scale)
    if not n:  # nothing to learn from: every text scores one half
        model.factors[:] = 0
        return model
    dense = model.standard(statistics)
    value = word_values(edges)
    sum_linear, sum_factors, sum_bias = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    counts = np.diff(edges)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            rows = order[low:low + BATCH]
            lengths = counts[rows]
            inner = np.concatenate(([0], np.cumsum(lengths)))
            at = np.arange(inner[-1]) + np.repeat(edges[rows] - inner[:-1], lengths)
            own = np.concatenate([buckets[at], np.tile(np.arange(BUCKETS, size), len(rows))])
            row = np.concatenate([np.repeat(np.arange(len(rows)), lengths), np.repeat(np.arange(len(rows)), wide)])
            x = np.concatenate([np.repeat(value[rows], lengths), dense[rows].ravel()])
            vx = model.factors[own] * x[:, None]
            total = np.zeros((len(rows), RANK))
            np.add.at(total, row, vx)
            raw = (model.bias + np.bincount(row, model.linear[own] * x, len(rows))
                   + ((total * total).sum(axis=1) - np.bincount(row, (vx * vx).sum(axis=1), len(rows))) / 2)
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]
            push = (slope[row] * x)
            used, where = np.unique(own, return_inverse=True)
            linear = np.bincount(where, push) / len(rows) + DECAY * model.linear[used]
            factors = np.zeros((len(used), RANK))
            np.add.at(factors, where, push[:, None] * (total[row] - vx))
            factors = factors / len(rows) + DECAY * model.factors[used]
            sum_linear[used] += linear ** 2
            sum_factors[used] += factors ** 2
            sum_bias += slope.mean() ** 2
            model.linear[used] -= RATE * linear / np.sqrt(sum_linear[used])
            model.factors[used] -= RATE / 2 * factors / np.sqrt(sum_factors[used])
            model.bias -= RATE * slope.mean() / np.sqrt(sum_bias)
    return model


def train(docs: DataFrame, labels: DataFrame) -> FactorisationMachine:
    """Fit on documents that have a label 0 or 1 (the smallest of several).

    ``MAX_LABELLED`` documents at most, by the hash of their ids; of rows that
    repeat a doc_id, one is taken (the smallest hash of a text).
    """
    sample = (labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(sample), "doc_id")
    # one row of each document, so that the sample bounds what the driver gets
    rows = (rows.groupBy("doc_id", "quality")
            .agg(F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "n_chars")).alias("one"))
            .select("doc_id", "quality", "one.text", "one.n_chars"))

    def run(batch):
        found, counts, statistics = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for low, high, data, offsets, _ in text_blocks(batch.column("text")):
            buckets, edges, own = inputs(data, offsets, _numbers(batch.column("n_chars"))[low:high])
            found.append(buckets)
            counts.append(np.diff(edges))
            statistics.append(own)
        edges = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(counts)))), pa.int32())
        flat = np.concatenate(statistics).ravel() if statistics else np.zeros(0)
        return [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(found), pa.int32())),
                pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(STATISTICS), pa.int32()),
                                         pa.array(flat, pa.float64()))]

    table = (add_columns(rows, run, "buckets array<int>, statistics array<double>", "text", "n_chars")
             .select("doc_id", "quality", "buckets", "statistics").toArrow().combine_chunks()
             .sort_by([("doc_id", "ascending")]))
    if not table.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, len(STATISTICS))), np.zeros(0))
    lists = table.column("buckets").combine_chunks()
    edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return fit(lists.flatten().to_numpy().astype(np.int64), edges,
               table.column("statistics").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS)),
               table.column("quality").to_numpy().astype(np.float64))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``docs`` with quality_score, the probability of label 1, from text and n_chars.

    NULL and empty texts are scored by their statistics alone, a NULL n_chars
    counts as 0. Repeated rows stay repeated; other columns pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found = [np.zeros(0)]
        n_chars = _numbers(batch.column("n_chars"))
        for low, high, data, offsets, _ in text_blocks(batch.column("text"), 1 << 20):
            found.append(held.value.scores(*inputs(data, offsets, n_chars[low:high])))
        return [pa.array(np.concatenate(found))]

    return add_columns(docs, run, "quality_score double", "text", "n_chars")
