"""Packing along a space-filling curve.

Every text's hashed byte n-grams are projected to ``DIMENSIONS`` numbers; the
rows are range-sorted by the Hilbert key of that point (then by doc_id, so a
group of copies with one key spreads over tasks), and each task packs its
stretch of the curve: documents follow each other without a gap and are cut
where a sequence is full. What is left at a task's end goes into sequences whose
lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.common import block_texts, text_blocks

SEQUENCE = 2048
END_OF_TEXT = 1
DIMENSIONS, BITS = 4, 15
BUCKETS = 1 << 16
#: Words kept by a worker; the table starts anew when it is full.
KEPT_WORDS = 500_000
SEQUENCES_PER_TASK = 1 << 36

#: Fixed value: how byte-level BPE splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")

_DIRECTIONS = np.random.default_rng(41).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
_GRAM = np.uint32(0x9E3779B1)


def points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's mean projected n-gram, squeezed into (-1, 1); no text: the origin."""
    n = len(data) - 3
    if n <= 0:
        return np.zeros((len(offsets) - 1, DIMENSIONS))
    grams = np.ndarray(n, "<u4", np.ascontiguousarray(data), strides=(1,))  # every four bytes as a number
    projected = _DIRECTIONS.take(((grams * _GRAM) >> np.uint32(16)).astype(np.intp), axis=0)
    edges = np.minimum(offsets, n)
    some = np.flatnonzero(np.diff(edges) > 0)
    total = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    total[some] = np.add.reduceat(projected, edges[:-1][some], axis=0)
    return np.tanh(4 * total / np.maximum(np.diff(edges), 1)[:, None])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (below 2 ** bits)."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(len(x)):
            turned = (x[k] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    twist = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        twist = np.where((x[-1] & q) > 0, twist ^ (q - 1), twist)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for own in x:
            key = (key << 1) | (((own ^ twist) >> bit) & 1)
    return key


def curve_key(column: pa.Array) -> pa.Array:
    keys = [np.zeros(0, np.int64)]
    for _, _, data, offsets, _ in text_blocks(column, 1 << 18):
        cells = ((points(data, offsets) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
        keys.append(hilbert(cells, BITS))
    return pa.array(np.concatenate(keys))


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to numbers, and the special tokens, of a byte-level BPE file.

    Such a file writes a byte as a character: printable ones as themselves, the
    others in order from U+0100. Numbers follow the order of the merges.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    vocabulary = {t: n for t, n in model["model"]["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("token numbers must follow the order of the merges")
    return {bytes(byte_of[c] for c in t): n for t, n in vocabulary.items()}, special


class WordTokenizer:
    """Token numbers of texts, by way of a table of words.

    The byte-level pattern always starts a new token at a blank that a
    non-blank follows, so texts can be cut there without a change of the
    result. A special token's name in a text is that token, as the tokenizers
    library has it; the text around it is cut there.
    """

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import tiktoken

        ranks, special = byte_ranks(path)
        if max([*ranks.values(), *special.values()]) >= 1 << 16:
            raise ValueError("token numbers must fit into 16 bits")
        self.model = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain: dict[str, bytes] = {}  # a piece as it stands
        self.spaced: dict[str, bytes] = {}  # a word behind a blank
        names = sorted(special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.numbers = {name: np.array([n], np.uint16) for name, n in special.items()}
        self.odd = re.compile(r" (?:\s|\Z)")
        self.cut = re.compile(r"(?= \S)")

    @classmethod
    def open(cls, path: str) -> WordTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _learn(self, table: dict[str, bytes], wanted: set[str], prefix: str) -> None:
        new = [w for w in wanted if w not in table]
        if len(table) + len(new) > KEPT_WORDS:
            table.clear()
            new = list(wanted)
        encode, pack_ = self.model.encode_ordinary, struct.pack
        for word in new:
            own = encode(prefix + word)
            table[word] = pack_(f"<{len(own)}H", *own)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token numbers of each text, as 16-bit numbers."""
        if self.special:
            named = {k: self.special.split(text) for k, text in enumerate(texts) if self.special.search(text)}
            if named:  # pieces at odd places are special tokens
                plain = iter(self._ordinary([p for k, t in enumerate(texts) for p in named.get(k, [t])[::2]]))
                return [np.concatenate([self.numbers[p] if j % 2 else next(plain) for j, p in enumerate(named[k])])
                        if k in named else next(plain) for k in range(len(texts))]
        return self._ordinary(texts)

    def _ordinary(self, texts: list[str]) -> list[np.ndarray]:
        parts = []
        for text in texts:
            if self.odd.search(text):
                own = self.cut.split(text)
                parts.append((own, []))
            else:
                first, *rest = text.split(" ")
                parts.append(([first] if first else [], rest))
        self._learn(self.plain, set(chain.from_iterable(p for p, _ in parts)), "")
        self._learn(self.spaced, set(chain.from_iterable(r for _, r in parts)), " ")
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        return [np.frombuffer(b"".join(chain(map(plain, own), map(spaced, rest))), np.uint16) for own, rest in parts]


class Packer:
    """Fills one sequence after the other; keeps the tokens of the open one only."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.used = 0
        self.open: list[tuple[int, int, int, np.ndarray]] = []  # doc, start, doc_tokens, tokens
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        start, total = 0, len(tokens)
        while start < total:
            part = tokens[start:start + SEQUENCE - self.used]
            self.open.append((doc_id, start, total, part))
            self.used += len(part)
            start += len(part)
            if self.used == SEQUENCE:
                self._close()

    def _close(self) -> None:
        offset = 0
        for doc_id, start, total, part in self.open:
            self.rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), total, self.sequence, offset,
                              self.used))
            offset += len(part)
        self.sequence += 1
        self.used, self.open = 0, []

    def finish(self) -> None:
        """The rest, cut into sequences whose lengths are powers of two."""
        left, self.open, rest = self.open, [], self.used
        size = SEQUENCE
        self.used = 0
        while rest:
            while size > rest:
                size //= 2
            while self.used < size:
                doc_id, start, total, part = left[0]
                taken = part[:size - self.used]
                self.open.append((doc_id, start, total, taken))
                self.used += len(taken)
                if len(taken) < len(part):
                    left[0] = doc_id, start + len(taken), total, part[len(taken):]
                else:
                    left.pop(0)
            self._close()
            rest -= size

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * 8
        self.rows = []
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents, by the columns of ``PIECES``.

    A document is its token numbers and one end number; NULL and empty texts
    are the end number alone. Repeated rows are documents of their own, a NULL
    doc_id stays NULL; other columns are left out. No documents, no rows.
    """
    key = F.arrow_udf(curve_key, "long")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("curve", key("text"))
               .repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id").drop("curve"))

    def run(batches):
        words = WordTokenizer.open(path)
        packer = Packer(TaskContext.get().partitionId() * SEQUENCES_PER_TASK)
        end = np.array([END_OF_TEXT], "<u4")
        for batch in batches:
            ids, low = batch.column("doc_id").to_pylist(), 0
            for texts in block_texts(batch.column("text")):
                for doc_id, tokens in zip(ids[low:], words.encode(texts)):
                    packer.add(doc_id, np.concatenate([tokens.astype("<u4"), end]))
                low += len(texts)
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    return ordered.mapInArrow(run, PIECES)
