"""MinHash near-duplicate detection by a multi-index Hamming join.

A text's set holds its distinct five-word shingles. Its signature has
``CHUNKS * WIDTH`` minhash values of 16 bits; the distance of two signatures is
the number of values that differ. By pigeonhole, two signatures at distance
``CHUNKS * (ERRORS + 1) - 1`` (21) or less have a chunk with at most ``ERRORS``
(1) differing value: every chunk is indexed once for each way to leave one
value out, so all such pairs meet under a key; there is no such guarantee for
distances of 22 to ``LIMIT``. At similarity 0.75 the distance
is 13.75 on average, and 1.6 pairs in 100,000 meet under no key. Candidates
whose signatures differ in more than ``LIMIT`` values go (none in 10 million at
0.75); the rest is confirmed on the full sets of the texts.

Copies do not become pairs: equal sets are one class first. In each key the
classes are tested against the key's first and against the one before, which
joins most of a group with a number of tests in proportion to its rows; then
all pairs of a key that are not yet connected and not yet tested are tested, if
their odd sketches allow it. An odd sketch has a bit for each of ``BITS``
buckets, set if an odd number of the set's members falls there; the bits in
which two sketches differ are at most, and in mean and spread known from, the
size of the symmetric difference, which a link bounds by a seventh of both sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmaq.llm.common import STEP_KEYS, mix, stored, text_blocks, windows, words
from tarmaq.llm.graph import components

SHINGLE = 5
CHUNKS, WIDTH, ERRORS = 11, 5, 1
VALUES = CHUNKS * WIDTH
LIMIT = 32
PERCENT = 75
BITS = 1024

_rng = np.random.default_rng(1999)
_FACTORS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)
_PLACES = _rng.integers(1, 2**63, (CHUNKS, WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(1, 2**63, (CHUNKS, WIDTH), dtype=np.uint64)

SIGNED = "n_shingles long, low long, high long, signature binary, sketch array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, _, _, firsts = words(data, offsets, lower=True)
    shingles, edges = windows(hashes, firsts, SHINGLE)
    out = []
    for k in range(len(offsets) - 1):
        count = firsts[k + 1] - firsts[k]
        if count >= SHINGLE:
            out.append(np.unique(shingles[edges[k]:edges[k + 1]]))
        elif count:  # the whole sequence is the one shingle
            own = hashes[firsts[k]:firsts[k + 1]]
            out.append(mix(np.array([(own * STEP_KEYS[:count]).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sign(batches):
    for batch in batches:
        counts, low, high, signatures, sketches = [], [], [], [], []
        for _, _, data, offsets, _ in text_blocks(batch.column("text"), 1 << 20):
            sets = shingle_sets(data, offsets)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            values = np.zeros((len(sets), VALUES), "<u2")
            odd = np.zeros((len(sets), BITS), bool)
            sums = np.zeros((2, len(sets)), np.uint64)
            if len(some):
                flat = np.concatenate(sets)
                edges = np.concatenate(([0], np.cumsum(sizes)))[:-1][some]
                for k in range(VALUES):
                    least = np.minimum.reduceat((flat ^ _SHIFTS[k]) * _FACTORS[k], edges)
                    values[some, k] = mix(least) >> np.uint64(48)
                bits = np.repeat(np.arange(len(sets)), sizes) * BITS + (flat >> np.uint64(54)).astype(np.int64)
                odd = (np.bincount(bits, minlength=len(sets) * BITS) & 1).astype(bool).reshape(-1, BITS)
                sums[0, some] = np.add.reduceat(mix(flat), edges)
                sums[1, some] = np.add.reduceat(mix(flat ^ _SALTS[0, 0]), edges)
            sketches.append(np.packbits(odd, axis=1).view(np.int64).ravel())
            counts.append(sizes)
            low.append(sums[0])
            high.append(sums[1])
            signatures.extend(v.tobytes() if n else None for v, n in zip(values, sizes))
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(whole(counts, np.int64)), pa.array(whole(low, np.uint64)),
             pa.array(whole(high, np.uint64)), pa.array(signatures, pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * (BITS // 64), pa.int32()),
                                      pa.array(whole(sketches, np.int64)))],
            ["doc_id", "n_shingles", "low", "high", "signature", "sketch"])


def chunk_keys(values: np.ndarray) -> np.ndarray:
    """The index keys of signatures (rows of values): one per chunk and value left out."""
    parts = values.reshape(len(values), CHUNKS, WIDTH).astype(np.uint64)
    keys = np.empty((len(values), CHUNKS, WIDTH), np.uint64)
    for left_out in range(WIDTH):
        others = [k for k in range(WIDTH) if k != left_out]
        keys[:, :, left_out] = (_SALTS[:, left_out] + (parts[:, :, others] * _PLACES[:, left_out, others])
                                .sum(axis=2, dtype=np.uint64))
    return mix(keys.reshape(len(values), -1)).view(np.int64)


def _index(batches):
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, VALUES)
            keys = chunk_keys(values)
            repeat = np.repeat(np.arange(len(values)), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), batch.column("rep").take(pa.array(repeat))], ["key", "rep"])


def _near(batches):
    """Pairs whose signatures differ in at most LIMIT values."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, VALUES)
                        for c in ("sign_a", "sign_b"))
            close = pa.array((one != two).sum(axis=1) <= LIMIT)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(close) for c in ("a", "b")], ["a", "b"])


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Two sets share PERCENT of their union."""
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= PERCENT * (len(one) + len(two) - common) and common > 0


def _confirm(batches):
    for batch in batches:
        sides = [[s for _, _, data, offsets, _ in text_blocks(batch.column(name)) for s in shingle_sets(data, offsets)]
                 for name in ("text_a", "text_b")]
        good = pa.array([linked(a, b) for a, b in zip(*sides)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])


def _ratio(one: str, two: str):
    """Sizes that allow the similarity."""
    return 100 * F.least(one, two) >= PERCENT * F.greatest(one, two)


def sketches_allow(sketch, sketch2, n, n2):
    """Condition that two sketches may belong to a link (false for one link in a billion)."""
    differ = sum((F.bit_count(sketch[k].bitwiseXOR(sketch2[k])) for k in range(BITS // 64)), F.lit(0))
    most = F.floor((n + n2) * ((100 - PERCENT) / (100 + PERCENT)) + 1e-9).cast("double")
    mean = BITS / 2 * (1 - F.exp(-2 / BITS * most))
    spread = F.sqrt(BITS / 4 * (1 - F.exp(-4 / BITS * most)))
    return differ <= F.least(most, mean + 6 * spread)


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links: near signatures first, then the full sets."""
    signs = classes.select("rep", "n_shingles", "signature")
    both = (pairs.join(signs.toDF("a", "n_a", "sign_a"), "a").join(signs.toDF("b", "n_b", "sign_b"), "b")
            .filter(_ratio("n_a", "n_b")).select("a", "b", "sign_a", "sign_b"))
    near = stored(both.mapInArrow(_near, "a long, b long"), "near")
    return (near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .mapInArrow(_confirm, "a long, b long"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links are as in the module's text, without regard to the case of A-Z. Texts
    of fewer than five words are one shingle, texts without words (NULL too)
    have no set and no links. A doc_id stands for one text: rows that repeat it
    get one row each, and a row with a NULL doc_id links with nothing. Other
    columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(texts.mapInArrow(_sign, f"doc_id long, {SIGNED}"), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("n_shingles", "low", "high").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("signature", "sketch"), "doc_id").alias("own"))
        .select("n_shingles", "low", "high", "rep", "own.signature", "own.sketch"), "classes")

    by_key = Window.partitionBy("key").orderBy(F.xxhash64("rep"), "rep")
    crowded = stored(
        classes.select("rep", "signature").mapInArrow(_index, "key long, rep long")
        .select("*", F.lag("rep").over(by_key).alias("before"), F.lead("rep").over(by_key).alias("after"),
                F.first("rep").over(by_key).alias("center"))
        .filter("before IS NOT NULL OR after IS NOT NULL").drop("after"), "crowded")
    met = crowded.select(F.col("rep").alias("doc_id")).distinct()
    texts = stored(texts.join(met, "doc_id", "left_semi"), "texts")
    tested = stored(crowded.filter("before IS NOT NULL")
                    .select("rep", F.explode(F.array("before", "center")).alias("x")).filter("x != rep")
                    .select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct(), "tested")
    links = stored(confirm(tested, classes, texts), "links")
    labels = components(links)

    rows = (crowded.select("key", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
            .select("key", "rep", F.coalesce("label", "rep").alias("label")))
    mixed = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
    rows = stored(rows.join(mixed.select("key"), "key", "left_semi")
                  .join(classes.select("rep", F.col("n_shingles").alias("n"), "sketch"), "rep")
                  .select("key", "rep", "label", "n", "sketch"), "mixed")
    other = rows.toDF("key", "rep2", "label2", "n2", "sketch2")
    open_ = ((F.col("rep") < F.col("rep2")) & (F.col("label") != F.col("label2")) & _ratio("n", "n2")
             & sketches_allow(F.col("sketch"), F.col("sketch2"), F.col("n"), F.col("n2")))
    rest = (rows.join(other, (rows["key"] == other["key"]) & open_)
            .select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()
            .join(tested, ["a", "b"], "left_anti"))
    more = confirm(stored(rest, "rest"), classes, texts)
    labels = components(links.union(more))

    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    named = labels.join(smallest, "label").select(F.col("node").alias("rep"), "component")
    groups = classes.select("n_shingles", "low", "high", "rep").join(named, "rep", "left").select(
        "n_shingles", "low", "high", F.coalesce("component", "rep").alias("component"))
    return (signed.select("doc_id", "n_shingles", "low", "high")
            .join(groups, ["n_shingles", "low", "high"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
