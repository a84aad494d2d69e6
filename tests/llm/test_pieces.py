"""Piece encoding against the library, its spans, and the character map."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from helpers import documents
from tarmaq.llm import pieces
from tarmaq.llm.common import tokenizer
from tarmaq.llm.queries import QUERIES

PATH = tokenizer("piece_bpe_32k.model")
ODD = ["", " ", "  ", " a", "a ", "a  b", "\n", "\n\n a\n", "▁", "▁▁a b▁", "日本語 text 😀 ok", "<s> </s> <unk> <0x41>", "é" * 300,
       "a" * 500, "\t tab", "\x00x", "x" * 70 + " " * 90 + "y", "ﬁ ½", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(" ▁ab\né日😀<>0xZther") for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_numbers_spans_and_text_equal_the_library(library):
    model = pieces.open_model(PATH)
    texts = ODD + random_texts(1500)
    ids, edges, start, stop = pieces.encode_block(model, texts, True)
    decoded = model.decode_many(ids, edges)
    for k, text in enumerate(texts):
        own = slice(edges[k], edges[k + 1])
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids[own].tolist() == want
        assert decoded[k].decode() == library.decode(want)
        spans = list(zip(start[own].tolist(), stop[own].tolist()))[1:-1]
        assert spans == [(p.begin, p.end) for p in library.encode_as_proto(text).pieces]


def test_invalid_bytes_decode_as_in_the_library(library):
    model = pieces.open_model(PATH)
    rng = random.Random(2)
    for _ in range(300):
        ids = np.array([rng.choice([rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(1, 12))])
        assert model.decode_many(ids, np.array([0, len(ids)]))[0].decode() == library.decode(ids.tolist())


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op1_pieces"](spark, folder).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.span_bytes == len(docs[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_columns_nulls_and_repeats(spark):
    rows = [(1, "two words"), (2, None), (2, None), (None, ""), (3, "é日")]
    out = pieces.decode(pieces.encode(documents(spark, rows), PATH), PATH).collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(d, t or "") for d, t in rows]
    assert [len(r.piece_ids) == len(r.span_starts) == len(r.span_ends) for r in out] == [True] * 5
    assert out[1].piece_ids == [] and out[4].span_ends[-1] == 5
    assert pieces.encode(documents(spark, []), PATH).count() == 0
    clash = documents(spark, rows[:1]).selectExpr("text", "7 AS piece_ids", "doc_id AS n_tokens")
    assert pieces.digest(clash, PATH).collect()[0].piece_ids == 7


def compiled(mapping: dict[bytes, bytes]) -> bytes:
    """A character map in the file format: a double-array trie built by trial."""
    nodes: dict[bytes, set[int]] = {}
    for key in mapping:
        for k in range(len(key) + 1):
            nodes.setdefault(key[:k], set())
            if k < len(key):
                nodes[key[:k]].add(key[k])
    units, replaced, place = {0: 0}, b"", {b"": 0}
    used, order = {0}, sorted(nodes, key=lambda n: (len(n), n))
    for node in order:
        own = place[node]
        wanted = sorted(nodes[node]) + ([0] if node in mapping else [])
        if not wanted:
            continue
        offset = next(o for o in range(1, 1 << 20) if not any((own ^ o ^ c) in used for c in wanted))
        units[own] = units[own] | offset << 10 | (256 if node in mapping else 0)
        for char in wanted:
            at = own ^ offset ^ char
            used.add(at)
            if char or node not in mapping or char in nodes[node]:
                units[at] = char
                place[node + bytes([char])] = at
            else:
                units[at] = 0x80000000 | len(replaced)
                replaced += mapping[node] + b"\0"
    array = [units.get(k, 0xFF) for k in range(max(units) + 256)]
    blob = struct.pack(f"<{len(array)}I", *array)
    return struct.pack("<I", len(blob)) + blob + replaced


def test_longest_prefix_normalisation_records_its_source():
    mapping = {"ﬁ".encode(): b"fi", "½".encode(): "1/2".encode(), b"ab": b"X", b"abc": b"", "\t".encode(): b" "}
    charmap = pieces.CharacterMap(compiled(mapping))
    assert charmap.longest(b"abcd", 0) == (3, b"") and charmap.longest(b"abx", 0) == (2, b"X")
    assert charmap.longest(b"axx", 0) is None and charmap.longest("½".encode(), 0) == (2, b"1/2")
    source = pieces.open_model(PATH)
    model = pieces.PieceModel(source.pieces, source.scores, source.kinds, charmap, squeeze=True)
    text = " ﬁn \tab½abcz "
    norm, align = model.normalise(text)
    assert norm.decode() == "▁fin▁X1/2z"
    data = text.encode()
    ids, edges, start, stop = pieces.encode_block(model, [text, "", "\t"], False)
    assert edges[2] == edges[1] == edges[3]
    covered = [data[a:b].decode() for a, b in zip(start, stop)]
    assert "".join(covered).replace(" ", "").replace("\t", "") in ("ﬁnab½abcz", "ﬁnab½z")
    assert (stop >= start).all() and stop[-1] <= len(data)
