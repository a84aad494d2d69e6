"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on at most ``SAMPLE`` vectors (iterative quantisation) turns
a vector into ``BITS`` sign bits. Vectors are dealt to shards of about ``SHARD``
rows; a shard keeps one table per ``PART`` bits of the codes. Two codes within
the radius agree, in one part at least, up to the radius divided by the number
of parts, so probing every part's values that near finds every code within the
radius. What is found is ranked by the exact distance of the vectors. The
radius is the one that holds ``TARGET`` of the true neighbours within the
sample; among more vectors neighbours are nearer, so recall only grows.

A query that finds fewer than k codes in a shard looks at all of that shard, so
no query stays short. Queries are sent to shards in blocks: nothing that grows
with the tables is broadcast, and no pair of rows leaves a task but the k best.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, PART = 64, 16
PARTS = BITS // PART
SAMPLE, SAMPLE_QUERIES = 8192, 512
TARGET = 0.975
SHARD, QUERY_BLOCK = 16384, 1024

FOUND = "query_id long, vec_id long, score double"


@dataclass
class CodeModel:
    mean: np.ndarray
    rotation: np.ndarray  # dimension x BITS
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One 16-bit number per part of each vector's code."""
        bits = (vectors.astype(np.float64) - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view("<u2").astype(np.int64)

    def part_radius(self, part: int) -> int:
        """How near a part must be: the pigeonhole bound, one less for the last parts."""
        return self.radius // PARTS - (part > self.radius % PARTS)


def learn(vectors: np.ndarray, k: int = 10, rounds: int = 30) -> CodeModel:
    """Rotations that make the sample's signs lose least, and the radius."""
    rng = np.random.default_rng(3)
    dimension = vectors.shape[1]
    vectors = vectors.astype(np.float64)
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, vary = np.linalg.eigh(centred.T @ centred)
    pieces, left = [], BITS
    while left:  # as many rotations as the bits need
        wide = min(dimension, left)
        basis = vary[:, ::-1][:, :wide]
        low = centred @ basis
        turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
            turn = (u @ v).T
        pieces.append(basis @ turn)
        left -= wide
    model = CodeModel(mean, np.hstack(pieces), 0)
    codes = model.codes(vectors)
    distances = []
    for at in range(min(SAMPLE_QUERIES, len(vectors))):
        exact = ((vectors - vectors[at]) ** 2).sum(axis=1)
        exact[at] = np.inf
        best = np.argsort(exact, kind="stable")[:min(k, len(vectors) - 1)]
        distances.extend(hamming(codes[best], codes[at]))
    model.radius = int(np.quantile(distances, TARGET, method="higher")) if distances else 0
    return model


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=-1).astype(np.int64)


_flips: dict[int, np.ndarray] = {}


def flips(radius: int) -> np.ndarray:
    """Every number of PART bits with at most ``radius`` set."""
    if radius not in _flips:
        _flips[radius] = np.array([sum(1 << b for b in bits) for size in range(radius + 1)
                                   for bits in combinations(range(PART), size)], np.int64)
    return _flips[radius]


class Shard:
    """The tables of a shard: rows by the value of each part."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors.astype(np.float64), codes
        self.rows = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.edges = [np.searchsorted(codes[r, p], np.arange((1 << PART) + 1)) for p, r in enumerate(self.rows)]

    def within(self, model: CodeModel, code: np.ndarray) -> np.ndarray:
        """Every row whose code lies within the radius of ``code``."""
        found = np.zeros(len(self.ids), bool)
        for part in range(PARTS):
            near = model.part_radius(part)
            if near < 0:
                continue
            values = flips(min(near, PART)) ^ code[part]
            low, high = self.edges[part][values], self.edges[part][values + 1]
            some = high > low
            low, size = low[some], (high - low)[some]
            if len(size):
                first = np.cumsum(size) - size
                found[self.rows[part][np.arange(size.sum()) + np.repeat(low - first, size)]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(self.codes[rows], code) <= model.radius]

    def search(self, model: CodeModel, query_id: int, vector: np.ndarray, code: np.ndarray, k: int):
        rows = self.within(model, code)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:
            rows = np.flatnonzero(self.ids != query_id)
        score = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], score))[:k]
        return self.ids[rows[best]], score[best]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not NULL or zero and holds finite numbers only."""
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return whole.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
                        & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def search(rows: DataFrame, is_query: Column | str, k: int = 10) -> DataFrame:
    """The k nearest rows of each row that the condition ``is_query`` picks.

    Rows query_id, rank (from 1), vec_id, score (Euclidean distance in double
    precision), ties to the smaller vec_id. Vectors that are NULL, zero or hold
    NULL or non-finite components take no part, nor do vectors of another
    length than most. A vec_id counts once (repeated rows: one of them, the
    smallest); fewer than k candidates are all returned; other columns are
    left out.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = usable(rows)
    sizes = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    if sizes is None:
        return empty
    good = (good.filter(F.size("embedding") == sizes["size"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    model = learn(_matrix(good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()), k)
    held = spark.sparkContext.broadcast(model)

    queries = good.filter(is_query)
    n_queries = queries.count()
    if not n_queries:
        return empty
    shards, blocks = -(-sizes["count"] // SHARD), -(-n_queries // QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.xxhash64("vec_id")
    index = good.select("vec_id", "embedding", F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                        every(blocks).alias("block"))
    asked = queries.select("vec_id", "embedding", every(shards).alias("shard"),
                           F.pmod(place, F.lit(blocks)).cast("int").alias("block"))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors, scores = [], [], []
        if left.num_rows and right.num_rows:
            learned = held.value
            own = _matrix(left)
            shard = Shard(left.column("vec_id").to_numpy(), own, learned.codes(own))
            wanted = _matrix(right)
            for query_id, vector, code in zip(right.column("vec_id").to_pylist(), wanted, learned.codes(wanted)):
                found, score = shard.search(learned, query_id, vector, code, k)
                ids.extend([query_id] * len(found))
                vectors.extend(found.tolist())
                scores.extend(score.tolist())
        return pa.table([pa.array(ids, pa.int64()), pa.array(vectors, pa.int64()), pa.array(scores, pa.float64())],
                        names=["query_id", "vec_id", "score"])

    found = (index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(probe, FOUND))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
