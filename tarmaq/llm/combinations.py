"""Jaccard join of four-word shingles by token-combination prefixes.

A link needs ``PERCENT`` of the union, so at most ``15 n / 100`` of a set's n
tokens may be missing from its partner. All tokens stand in one global order,
rare ones first. A set's prefix goes on until one more token would have to be
missing than may be: then linked sets share something in both their prefixes.

* A token of at most ``RARE`` sets stands for itself and counts one each; a
  token of a single set counts too, but is not indexed, as nobody shares it.
* Frequent tokens are dealt into classes by their frequency and subclasses by
  hash, and stand for each other only in combinations of k (two, or three for
  the very frequent). Of c tokens of a subclass, c - k + 1 must be missing before
  no combination is left, so that is what they count, and the prefix goes on.

Subclasses depend on the size of a set in powers of two, so that the
combinations grow with the text, not with its square; a set whose partners may
be of the next power is indexed under both.

The order needs frequencies, but not of all tokens. A quarter of all tokens, by
hash, comes first, and nearly every text has enough rare tokens among them. Only
for the texts that have not (copies of copies, texts made of common passages),
the rest is counted, among those texts. So the order is rare tokens of the first
quarter, rare ones of the rest, then frequent ones; by frequency, then hash.

Sets of a key are tested against the key's first set, and what links is merged to
components. In keys that still hold several components, two rounds test the sets
of other components against one set drawn per key, which costs as many tests as
there are rows and merges what is linked many times over. In what is still mixed
then, all rows outside the largest component are compared with the others by
size, by what no other set has and by odd sketches, none of which loses a link.
Candidates are confirmed on the full sets of their texts. Equal sets are one
class from the start.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import STEP_KEYS, mix, stored, text_blocks, windows, words
from tarmaq.llm.graph import components

SHINGLE = 4
PERCENT = 85
RARE = 64
BITS = 1024
TOKEN_BYTES = 6  # of an indexed token; a false match costs a comparison
LEAST = 6        # smaller sets link with equal ones only
ROUNDS = 2       # of tests against one set of each mixed key, before all others are compared

_MASK = np.uint64((1 << 8 * TOKEN_BYTES) - 1)
_REST = np.uint64(1 << 8 * TOKEN_BYTES)  # marks tokens that are not of the first quarter
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words are one shingle."""
    hashes, _, _, firsts = words(data, offsets, lower=True)
    shingles, edges = windows(hashes, firsts, SHINGLE)
    out = []
    for k, count in enumerate(np.diff(firsts)):
        if count >= SHINGLE:
            out.append(np.unique(shingles[edges[k]:edges[k + 1]]))
        else:
            own = hashes[firsts[k]:firsts[k + 1]]
            whole = mix(np.array([(own * STEP_KEYS[:count]).sum() + np.uint64(count)], np.uint64))
            out.append(whole if count else whole[:0])
    return out


def tokens_of(hashes: np.ndarray, rest: bool) -> np.ndarray:
    """The index tokens of a set: those of the first quarter, or the others."""
    first = hashes < np.uint64(1 << 62)
    return np.unique((hashes[~first] & _MASK) | _REST) if rest else np.unique(hashes[first] & _MASK)


def may_miss(n):
    """How many of a set's n tokens a linked set may lack."""
    return (100 - PERCENT) * n // 100


def _packed(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of packed ones, and the number in each row."""
    raw = column.to_pylist()
    sizes = np.array([len(r) // TOKEN_BYTES for r in raw], np.int64)
    out = np.zeros((int(sizes.sum()), 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view("<u8").ravel().astype(np.int64), sizes


def _sign(batches):
    for batch in batches:
        counts, sums, first, sketches = [], [], [], []
        for _, _, data, offsets, _ in text_blocks(batch.column("text"), 1 << 20):
            for own in shingle_sets(data, offsets):
                counts.append(len(own))
                sums.append((mix(own).sum(), mix(own ^ _SALT).sum()) if len(own) else (0, 0))
                first.append(_packed(tokens_of(own, rest=False)))
                odd = np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
                sketches.append(np.packbits(odd.astype(bool)).view(np.int64))
        low, high = (np.array([s[k] for s in sums], np.uint64).view(np.int64) for k in (0, 1))
        flat = np.concatenate([np.zeros(0, np.int64), *sketches])
        edges = pa.array(np.arange(batch.num_rows + 1) * (BITS // 64), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("written"), pa.array(counts, pa.int64()), pa.array(low),
             pa.array(high), pa.array(first, pa.binary()), pa.ListArray.from_arrays(edges, pa.array(flat))],
            ["doc_id", "written", "n", "low", "high", "tokens", "sketch"])


def _first_tokens(batches):
    for batch in batches:
        tokens, sizes = _unpacked(batch.column("tokens"))
        rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("set").take(rows), pa.array(tokens)], ["set", "token"])


def _rest_tokens(batches):
    for batch in batches:
        found = [tokens_of(own, rest=True) for _, _, data, offsets, _ in text_blocks(batch.column("text"), 1 << 20)
                 for own in shingle_sets(data, offsets)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("set"), pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64()))],
            ["set", "tokens"])


def shared(rows: DataFrame) -> DataFrame:
    """The rows (set, token) whose token is in more than one set, with df, the number of those sets."""
    common = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return rows.join(common, "token").select("set", "token", "df")


def bands(n: int) -> list[int]:
    """The powers of two under which a set of n tokens is indexed: its own, and the next if a partner may reach it."""
    own = n.bit_length() - 1
    return [own, own + 1] if 100 * n // PERCENT >= 2 << own else [own]


def combination_keys(n: int, missing: int, frequent: np.ndarray, df: np.ndarray, rare: int = RARE) -> list[int]:
    """Keys of a set of n tokens for which its rare tokens are ``missing`` too few.

    ``frequent``: its frequent tokens in global order, with their ``df``.
    """
    keys, of_class = [], np.where(df <= rare * rare, 2, 3)
    for band in bands(n):
        members: dict[tuple[int, int], list[np.uint64]] = {}
        left, scrambled = missing, mix(frequent.astype(np.uint64))
        for token, k in zip(scrambled, of_class.tolist()):
            if left <= 0:
                break
            group = (k, int(token >> np.uint64(32)) % max(1, (1 << band) // (8 if k == 2 else 16)))
            own = members.setdefault(group, [])
            own.append(token)
            left -= len(own) >= k  # the first k - 1 of a subclass count nothing
        for (k, part), own in members.items():
            if len(own) >= k:
                chosen = np.array(list(combinations(own, k)), np.uint64)
                base = mix(np.array([band * 8 + k], np.uint64)) + np.uint64(part)
                keys.extend(mix(mix(chosen).sum(axis=1, dtype=np.uint64) + base).view(np.int64).tolist())
    return keys


def prefix_keys(n: int, n_first: int, n_rest: int | None, tokens: np.ndarray, df: np.ndarray,
                rare: int = RARE) -> tuple[list[int], int]:
    """The index keys of a set, and how many of its tokens no other set has (at least).

    ``tokens`` and ``df`` are its shared tokens. ``n_first`` tokens are of the first
    quarter, ``n_rest`` of the rest (None: not needed, as the first have rare ones enough).
    """
    need = may_miss(n) + 1
    in_rest = tokens >= int(_REST)
    own = n_first - int((~in_rest).sum())
    if own >= need:  # no set can share enough
        return [], own
    order = np.lexsort((tokens, df, in_rest))
    alone = order[df[order] <= rare]
    if n_rest is None:
        picked = alone[:need - own]
        return mix(tokens[picked].astype(np.uint64)).view(np.int64).tolist(), own
    # rare tokens of the first quarter, single ones of the rest, other rare ones, frequent ones
    first = alone[~in_rest[alone]]
    single = n_rest - int(in_rest.sum())  # among the texts whose rest is counted
    later = alone[in_rest[alone]][:max(0, need - own - len(first) - single)]
    keys = mix(tokens[np.concatenate((first, later))].astype(np.uint64)).view(np.int64).tolist()
    missing = need - own - len(first) - single - len(later)
    if missing > 0:
        order = np.lexsort((tokens, df))
        frequent = order[df[order] > rare]
        keys += combination_keys(n, missing, tokens[frequent], df[frequent], rare)
    return keys, own


def _keys(rare: int):
    def run(batches):
        for batch in batches:
            sets, out, known = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("set", "n", "n_first", "n_rest")]
            lists = batch.column("shared")
            edges = np.asarray(lists.offsets)
            tokens, df = (np.asarray(lists.values.field(k)) for k in (0, 1))
            for k, (one, n, n_first, n_rest) in enumerate(zip(*columns)):
                own = slice(edges[k], edges[k + 1])
                keys, single = prefix_keys(n, n_first, n_rest, tokens[own], df[own], rare)
                sets += [one] * len(keys)
                out += keys
                known += [n - single] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.int64()),
                                              pa.array(known, pa.int64())], ["key", "set", "known"])
    return run


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common > 0 and 100 * common >= PERCENT * (len(one) + len(two) - common)


def _confirm(batches):
    for batch in batches:
        sides = [[s for _, _, data, offsets, _ in text_blocks(batch.column(c)) for s in shingle_sets(data, offsets)]
                 for c in ("text_a", "text_b")]
        good = pa.array([linked(a, b) for a, b in zip(*sides)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])


def may_link(n: Column, n2: Column, sketch: Column, sketch2: Column) -> Column:
    """False only where two sets cannot link: by their sizes, or by more odd buckets than they may differ in."""
    differ = sum((F.bit_count(sketch[k].bitwiseXOR(sketch2[k])) for k in range(BITS // 64)), F.lit(0))
    return ((100 * F.least(n, n2) >= PERCENT * F.greatest(n, n2))
            & (differ * (100 + PERCENT) <= (n + n2) * (100 - PERCENT)))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link, by the whole texts."""
    return (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .mapInArrow(_confirm, "a long, b long"))


def index(classes: DataFrame, texts_of, rare: int = RARE) -> DataFrame:
    """The rows (key, set, known) of all sets; ``known`` tokens at most can be shared with any other set.

    ``texts_of`` gives the texts (set, text) of some sets.
    """
    sized = classes.filter(F.col("n") >= LEAST)
    counts = sized.select("set", "n", F.expr(f"octet_length(tokens) div {TOKEN_BYTES}").alias("n_first"))
    first = stored(shared(sized.select("set", "tokens").mapInArrow(_first_tokens, "set long, token long")), "first")
    crowded = first.filter(F.col("df") > rare).groupBy("set").agg(F.count(F.lit(1)).alias("common"))
    short = stored(counts.join(crowded, "set", "left").filter(
        F.col("n_first") - F.coalesce("common", F.lit(0)) <= F.expr(f"{100 - PERCENT} * n div 100")).select("set"), "short")
    others = stored(texts_of(short).mapInArrow(_rest_tokens, "set long, tokens array<long>"), "rest")
    rest = shared(others.select("set", F.explode("tokens").alias("token")))
    both = (first.unionByName(rest).groupBy("set")  # the tokens of one text
            .agg(F.collect_list(F.struct("token", "df")).alias("shared")))
    return (both.join(counts, "set").join(others.select("set", F.size("tokens").cast("long").alias("n_rest")), "set", "left")
            .select("set", "n", "n_first", "n_rest", "shared")
            .mapInArrow(_keys(rare), "key long, set long, known long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()


def _named(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """The index rows with the component of their set."""
    return stored(entries.select("key", "set", "known").join(labels.toDF("set", "label"), "set", "left")
                  .withColumn("label", F.coalesce("label", "set")), "named")


def _mixed(named: DataFrame) -> DataFrame:
    """The index rows of keys that hold several components, with the one that has the most rows there."""
    counts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"))
    most = (counts.groupBy("key").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
            .filter("labels > 1").select("key", F.col("m.label").alias("most")))
    return named.join(most, "key")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links: components of the components that they connect."""
    links = stored(links, "links")
    one, two = labels.toDF("a", "la"), labels.toDF("b", "lb")
    edges = (links.join(one, "a", "left").join(two, "b", "left")
             .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b"))
    onward = stored(components(edges).toDF("label", "next"), "onward")
    old = labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    new = onward.select(F.col("label").alias("node"), F.col("next").alias("label")).join(
        labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(new), "labels")


def deduplicate(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text's set are its distinct four-word shingles without regard to the case of
    A-Z; fewer words are one shingle; a text without words, or NULL, has an empty
    set, which links with nothing. A component's name is its smallest doc_id. Rows
    that repeat a doc_id get one row each, also with other texts; a row with a NULL
    doc_id links with nothing and has no component. Other columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("written"), "text")
    signed = texts.mapInArrow(_sign, "doc_id long, written long, n long, low long, high long, tokens binary, "
                                     "sketch array<long>")
    signed = stored(signed.withColumn("set", F.xxhash64("n", "low", "high")).drop("low", "high"), "signed")
    usable = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("set", "n").agg(
        F.min(F.struct("doc_id", "written")).alias("first"),
        F.min_by(F.struct("tokens", "sketch"), "doc_id").alias("own"))
        .select("set", "n", "first.*", "own.*"), "classes")

    def texts_of(sets: DataFrame) -> DataFrame:
        wanted = classes.select("set", "doc_id", "written").join(sets, "set", "left_semi")
        return (texts.join(wanted, ["doc_id", "written"]).dropDuplicates(["doc_id", "written"])
                .select("set", "text"))

    entries = stored(index(classes, texts_of, rare), "index")
    keys = (entries.groupBy("key").agg(F.min("set").alias("center"), F.max("set").alias("last"))
            .filter("center < last").select("key", "center"))
    entries = stored(entries.join(keys, "key"), "met")
    facts = classes.select("set", "n", "sketch")
    one, two = facts.toDF("a", "n", "sketch"), facts.toDF("b", "n2", "sketch2")
    allowed = may_link(F.col("n"), F.col("n2"), F.col("sketch"), F.col("sketch2"))

    starred = entries.filter("set != center").select(F.col("center").alias("a"), F.col("set").alias("b")).distinct()
    starred = stored(starred.join(one, "a").join(two, "b").filter(allowed).select("a", "b"), "starred")
    links = confirmed(starred, stored(texts_of(_ends(starred)), "texts"))
    labels = components(links)
    tested, named = starred, _named(entries, labels)
    for turn in range(ROUNDS):
        mixed = _mixed(named)
        drawn = F.struct((F.col("label") != F.col("most")) if turn == 0 else F.lit(False),
                         F.xxhash64(F.lit(turn), "key", "set"))
        centers = mixed.groupBy("key").agg(F.min_by(F.struct("set", "label"), drawn).alias("c"))
        pairs = (mixed.join(centers, "key").filter(F.col("label") != F.col("c.label"))
                 .select(F.least("set", "c.set").alias("a"), F.greatest("set", "c.set").alias("b")).distinct()
                 .join(tested, ["a", "b"], "left_anti"))
        pairs = stored(pairs.join(one, "a").join(two, "b").filter(allowed).select("a", "b"), "pairs")
        labels = _merged(labels, confirmed(pairs, stored(texts_of(_ends(pairs)), "texts")))
        tested, named = tested.unionByName(pairs), _named(entries, labels)

    mixed = stored(_mixed(named).join(facts, "set"), "mixed")
    outer = mixed.filter("label != most").select("key", F.col("set").alias("a"), F.col("label").alias("la"),
                                                 F.col("known").alias("ka"), "n", "sketch")
    inner = mixed.select("key", F.col("set").alias("b"), F.col("label").alias("lb"), F.col("known").alias("kb"),
                         F.col("n").alias("n2"), F.col("sketch").alias("sketch2"), "most")
    enough = (100 + PERCENT) * F.least("ka", "kb") >= PERCENT * (F.col("n") + F.col("n2"))
    once = (F.col("lb") == F.col("most")) | (F.col("a") < F.col("b"))
    rest = (outer.join(inner, "key").filter((F.col("la") != F.col("lb")) & once & enough & allowed)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            .join(tested, ["a", "b"], "left_anti"))
    rest = stored(rest, "open")
    labels = _merged(labels, confirmed(rest, stored(texts_of(_ends(rest)), "texts")))

    heads = classes.select("set", F.col("doc_id").alias("head")).join(labels.toDF("set", "label"), "set", "left")
    heads = heads.withColumn("label", F.coalesce("label", "set"))
    names = heads.groupBy("label").agg(F.min("head").alias("component_id"))
    groups = heads.join(names, "label").select("set", "component_id")
    return (signed.select("doc_id", "n", "set").join(groups, "set", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
