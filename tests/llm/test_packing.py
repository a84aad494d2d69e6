"""Packing against its contract, token by token."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import documents, write
from tarmaq.llm import packing
from tarmaq.llm.common import tokenizer
from tarmaq.llm.queries import QUERIES

TEXTS = [(0, "One two three."), (1, None), (2, ""), (3, "x"), (4, "One two three."), (None, "no id"),
         (5, "word " * 5000), (6, "\n \t é日本😀  <|endoftext|> "), (7, "word " * 5000), (7, "again")]


def tokens_of(texts):
    model = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return [[*e.ids, 1] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs):
    """Every token lies in one piece, sequences have no gap and need no padding."""
    want = defaultdict(list)
    for (doc_id, _), ids in zip(docs, tokens_of([t for _, t in docs])):
        want[doc_id].append(ids)
    sequences, spans = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
                   == r.ids_crc32 for ids in want[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        spans[r.doc_id].append((r.start, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    for doc_id, own in spans.items():
        assert sum(length for _, length in own) == sum(map(len, want[doc_id]))
        if len(want[doc_id]) == 1:
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
    assert set(spans) == set(want)


def test_special_tokens_as_the_library_has_them():
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|> x", " <|endoftext|>  \n", "plain",
             "<|endoftext", "|endoftext|>", "a<|endoftext|>b", "", "<|<|endoftext|>|> ", "x  <|endoftext|>y"]
    got = packing.WordTokenizer(tokenizer("byte_bpe_50k.json")).encode(texts)
    assert [[*map(int, ids), 1] for ids in got] == tokens_of(texts)
    assert tokens_of(texts[:1]) == [[31373, 220, 50256, 995, 1]]


def test_edge_cases(spark):
    check(packing.pack(documents(spark, TEXTS), tokenizer("byte_bpe_50k.json")).collect(), TEXTS)


def test_empty_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert packing.pack(empty, tokenizer("byte_bpe_50k.json")).count() == 0
    clash = documents(spark, TEXTS[:3]).selectExpr("doc_id", "text", "1 AS curve", "2 AS start", "3 AS sequence_id")
    check(packing.pack(clash, tokenizer("byte_bpe_50k.json")).collect(), TEXTS[:3])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(QUERIES["op3_packing"](spark, folder).collect(), docs)


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_neighbours(dimensions, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dimensions)).reshape(dimensions, -1).T
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << bits * dimensions))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_tasks_join_without_overlap(spark, tmp_path):
    rows = [(k, f"text number {k} " * (k % 7 + 1)) for k in range(300)]
    folder = write(documents(spark, rows), tmp_path, "documents")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(QUERIES["op3_packing"](spark, folder).collect(), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
