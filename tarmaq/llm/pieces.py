"""SentencePiece encoding with byte spans in the original text, and decoding.

A model file of the BPE kind is read once per worker. Text is normalised by
longest-prefix replacement through the compiled character map, which records
for every normalised byte the source byte it came from; each piece is projected
through that record to a span of the original bytes. No piece holds a blank
after another character, so merges never leave a run of blanks and the word
behind it: texts are cut there, and a word's pieces are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarmaq.llm.common import add_columns, block_texts

BLANK = "▁"
BLANK_BYTES = BLANK.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in each of the two tables that a worker keeps.
KEPT_WORDS = 300_000
#: Words above this many characters are merged with a heap.
LONG = 64


#: Numbers of characters that are no piece begin here; pairs are left * SHIFT + right.
FAR, SHIFT = 1 << 20, 1 << 22
NEVER = 1 << 60


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes and their replacements.

    Layout (a fixed public format): the trie's size in bytes as a little-endian
    32-bit number, its units, then the replacements, each ended by a zero byte.
    Of a unit, the low byte is the label, bit 8 says that a value follows, bits
    10 to 30 are the offset (shifted by 8 more when bit 9 is set), and bit 31
    marks a value.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix at ``start`` and its replacement."""
        if not self.units:
            return None
        units, best = self.units, None
        node = self._offset(units[0])
        for at in range(start, len(data)):
            node ^= data[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[at]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                best = at - start + 1, self.replacements[place:self.replacements.index(b"\0", place)]
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def char_length(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@dataclass
class PieceModel:
    pieces: list[bytes]
    scores: list[float]
    kinds: list[int]
    charmap: CharacterMap
    dummy_prefix: bool = True
    squeeze: bool = False  # leading, trailing and doubled blanks go
    escape: bool = True
    begin: int = 1
    end: int = 2
    unknown: int = 0
    unknown_text: bytes = " ⁇ ".encode()
    byte_fallback: bool = True
    by_name: dict = field(default_factory=dict)

    def __post_init__(self):
        self.by_name = {p.decode(): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds))
                        if k in (NORMAL, USER, UNUSED)}
        if UNUSED in self.kinds:
            raise ValueError("models with unused pieces are not supported")
        self.names = [p.decode() if k in (NORMAL, USER) else "" for p, k in zip(self.pieces, self.kinds)]
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.user = sorted((p.decode() for p, k in zip(self.pieces, self.kinds) if k == USER), key=len, reverse=True)
        #: what a piece stands for: normalised length, and bytes when decoded
        self.lengths = np.array([0 if k in (CONTROL, UNKNOWN) else 1 if k == BYTE else len(p)
                                 for p, k in zip(self.pieces, self.kinds)], np.int64)
        surfaces = [b"" if k == CONTROL else self.unknown_text if k == UNKNOWN else bytes([int(p[3:5], 16)])
                    if k == BYTE else p.replace(BLANK_BYTES, b" ") for p, k in zip(self.pieces, self.kinds)]
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_length = np.array([len(s) for s in surfaces], np.int64)
        self.surface_start = np.concatenate(([0], np.cumsum(self.surface_length)[:-1]))
        self.cuttable = not any(BLANK in name.lstrip(BLANK) for name in self.by_name)
        self.rank = {name: (-self.scores[i], i) for name, i in self.by_name.items()}
        order = {score: k for k, score in enumerate(sorted({-self.scores[i] for i in self.by_name.values()}))}
        #: two neighbours, as one number, to the order of their merge and to what they become
        self.pair_order, self.pair_piece = {}, {}
        for name, i in self.by_name.items():
            for cut in range(1, len(name)):
                left, right = self.by_name.get(name[:cut]), self.by_name.get(name[cut:])
                left = left if left is not None or cut > 1 else FAR + ord(name[0])
                right = right if right is not None or cut < len(name) - 1 else FAR + ord(name[-1])
                if left is not None and right is not None:
                    self.pair_order[left * SHIFT + right] = order[-self.scores[i]]
                    self.pair_piece[left * SHIFT + right] = i
        self.words, self.before = _Words(self), {}
        self._pairs = None

    @property
    def plain(self) -> bool:
        """Normalising only turns blanks into marks."""
        return (not self.charmap.units and self.dummy_prefix and not self.squeeze and self.escape and self.cuttable
                and not self.user and self.byte_fallback and len(self.pieces) <= 1 << 16)

    # -- normalising -------------------------------------------------------

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its source byte."""
        data = text.encode()
        out, align = bytearray(), []
        blank = BLANK_BYTES if self.escape else b" "
        user = [u.encode() for u in self.user]
        at, started, was_blank = 0, False, self.squeeze
        while at < len(data):
            own = next((u for u in user if data.startswith(u, at)), None)
            found = (len(own), own) if own else self.charmap.longest(data, at)
            if found is None:
                size = char_length(data[at])
                found = size, data[at:at + size]
            size, new = found
            if self.squeeze:
                while was_blank and new.startswith(b" "):
                    new = new[1:]
            if new:
                if not started and self.dummy_prefix:
                    out += blank
                    align += [at] * len(blank)
                started = True
                for byte in new:
                    if byte == 0x20:
                        out += blank
                        align += [at] * len(blank)
                    else:
                        out.append(byte)
                        align.append(at)
                was_blank = self.squeeze and new.endswith(b" ")
            at += size
        end = len(data)
        if self.squeeze:
            while out.endswith(blank):
                end = align[len(out) - len(blank)]
                del out[-len(blank):], align[len(out):]
        return bytes(out), np.array([*align, end], np.int64)

    # -- segmenting --------------------------------------------------------

    def merge(self, text: str) -> list[int]:
        """Piece numbers of normalised text by best-score merges, leftmost on ties."""
        if len(text) <= LONG and not self.user:
            return self._merge_short(text)
        parts = list(text) if not self.user else re.findall("|".join([*map(re.escape, self.user), "(?s:.)"]), text)
        return self.numbers(self._merge_heap(parts))

    def numbers(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            found = self.by_name.get(part)
            if found is not None:
                out.append(found)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in part.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _merge_short(self, text: str) -> list[int]:
        """The merges of a short word, on piece numbers."""
        name, order, piece = self.by_name, self.pair_order.get, self.pair_piece
        parts = [name[c] if c in name else FAR + ord(c) for c in text]
        costs = [order(a * SHIFT + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            new = parts[i] = piece[parts[i] * SHIFT + parts.pop(i + 1)]
            del costs[i]
            if i:
                costs[i - 1] = order(parts[i - 1] * SHIFT + new, NEVER)
            if i < len(costs):
                costs[i] = order(new * SHIFT + parts[i + 1], NEVER)
        if max(parts, default=0) < FAR:
            return parts
        return self.numbers([self.names[p] if p < FAR else chr(p - FAR) for p in parts])

    def merge_many(self, words: list[str]) -> list[bytes]:
        """``merge`` of many short words at once; the numbers as 16-bit bytes."""
        out: list[bytes] = []
        for low in range(0, len(words), 4096):
            out.extend(self._merge_table(words[low:low + 4096]))
        return out

    def _merge_table(self, words: list[str]) -> list[bytes]:
        if self._pairs is None:
            self._pairs = _PairTable(self.pair_order, self.pair_piece)
        find = self._pairs.find

        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words])
        own, inverse = np.unique(chars, return_inverse=True)
        numbers = np.array([self.by_name.get(chr(c), FAR + c) for c in own.tolist()], np.int64)[inverse]
        width = int(lengths.max())
        table = np.full((len(words), width + 1), -1, np.int64)
        place = np.arange(width + 1)
        table[place < lengths[:, None]] = numbers
        costs, _ = find(table[:, :-1], table[:, 1:])
        rows, part = np.arange(len(words)), table.copy()
        while True:
            index = np.arange(len(rows))
            at = costs.argmin(axis=1)
            going = costs[index, at] < NEVER
            if not going.all():
                table[rows[~going]] = part[~going]
                rows, part, costs, at = rows[going], part[going], costs[going], at[going]
                index = index[:len(rows)]
            if not len(rows):
                break
            _, new = find(part[index, at], part[index, at + 1])
            moved = np.minimum(place + (place > at[:, None]), width)
            part = np.take_along_axis(part, moved, axis=1)
            part[:, width] = -1
            part[index, at] = new
            costs = np.take_along_axis(costs, np.minimum(moved[:, :width], width - 1), axis=1)
            costs[:, width - 1] = NEVER
            costs[index, at], _ = find(new, part[index, at + 1])
            before = np.maximum(at - 1, 0)
            left, _ = find(part[index, before], new)
            costs[index, before] = np.where(at > 0, left, costs[index, before])
        inside = table >= 0
        edges = np.concatenate(([0], np.cumsum(inside.sum(axis=1)))).tolist()
        flat = table[inside]
        if (flat >= FAR).any():
            strange = set(np.flatnonzero(((table >= FAR) & inside).any(axis=1)).tolist())
        else:
            strange = ()
        blob = flat.astype(np.uint16).tobytes()
        return [blob[2 * a:2 * b] if k not in strange else np.array(self.merge(words[k]), np.uint16).tobytes()
                for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def learn(self, words: set[str]) -> None:
        """Adds short words to the kept ones, those kept before the last change of table first."""
        kept, before = self.words, self.before
        new = [w for w in words if w not in kept and len(w) < LONG]
        known = [w for w in new if w in before]
        if known:
            kept.update({w: before[w] for w in known})
            new = [w for w in new if w not in kept]
        new.sort(key=len)
        kept.update(zip(new, self.merge_many([BLANK + w for w in new])))

    def forget(self) -> None:
        """A full table becomes the one before; words that come up again move back."""
        if len(self.words) > KEPT_WORDS:
            self.before, self.words = self.words, _Words(self)

    def _merge_heap(self, parts: list[str]) -> list[str]:
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            found = self.rank.get(parts[i] + parts[j])
            if found:
                heapq.heappush(heap, (found[0], i, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, own, other = heapq.heappop(heap)
            j = after[i]
            if len(parts[i]) != own or not own or j >= len(parts) or len(parts[j]) != other:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    # -- whole texts -------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Piece numbers, without begin and end."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text, without begin and end."""
        if not self.plain:
            return [np.array(self.merge(self.normalise(t)[0].decode()) if t else [], np.int64) for t in texts]
        parts = [self.cut(t) for t in texts]
        self.learn(set(chain.from_iterable(parts)))
        get = self.words.__getitem__
        found = [np.frombuffer(b"".join(map(get, own)), np.uint16) for own in parts]
        self.forget()
        return found

    @staticmethod
    def cut(text: str) -> list[str]:
        """A text's words behind their blank; the dummy prefix is the first word's blank."""
        if not text:
            return []
        if BLANK in text:
            text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:].replace(" ", BLANK) for c in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def project(self, texts: list[str], ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in its text's bytes."""
        size = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        base = np.repeat(upto[edges[:-1]], np.diff(edges))
        starts, ends = upto[:-1] - base, upto[1:] - base
        if self.plain:
            data = np.frombuffer("".join(texts).encode(), np.uint8)
            lengths = np.array([len(t.encode()) if not t.isascii() else len(t) for t in texts], np.int64)
            return self._project_plain(data, lengths, starts, ends, edges)
        for k, text in enumerate(texts):
            own = slice(edges[k], edges[k + 1])
            if text and not self.byte_fallback:  # an unknown run has no fixed length
                starts[own], ends[own] = self._walk(text, ids[own])
            elif text:
                align = self.normalise(text)[1]
                starts[own], ends[own] = align[starts[own]], align[ends[own]]
        return starts, ends

    def _walk(self, text: str, ids: np.ndarray) -> tuple[list[int], list[int]]:
        norm, align = self.normalise(text)
        left = norm.decode()
        at, starts, ends = 0, [], []
        parts = self._merge_heap(list(left))
        k = 0
        for number in ids:
            begin = at
            if number == self.unknown:
                while k < len(parts) and parts[k] not in self.by_name:
                    at += len(parts[k].encode())
                    k += 1
            else:
                at += len(parts[k].encode())
                k += 1
            starts.append(int(align[begin]))
            ends.append(int(align[at]))
        return starts, ends

    @staticmethod
    def _project_plain(data, lengths, starts, ends, edges):
        width = np.where(data == 0x20, 3, 1)
        rows = np.concatenate(([0], np.cumsum(lengths)))
        upto = np.concatenate(([0], np.cumsum(width)))
        # normalised byte to source byte, all texts behind each other
        align = np.append(np.repeat(np.arange(len(data)), width), len(data))
        shift = np.repeat(upto[rows[:-1]], np.diff(edges))
        origin = np.repeat(rows[:-1], np.diff(edges))
        last = np.repeat(rows[1:], np.diff(edges))

        def place(at):  # the dummy prefix has no source bytes
            at = np.maximum(at - len(BLANK_BYTES), 0) + shift
            return np.minimum(align[at], last) - origin

        return place(starts), place(ends)

    def decode_many(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """UTF-8 of each sequence; a first blank that stands for the dummy prefix goes."""
        size = self.surface_length[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.surface_start[ids] - upto[:-1], size) + np.arange(upto[-1])
        flat = self.surface[at].tobytes()
        bounds = upto[edges]
        out = []
        bytes_ = np.isin(ids, np.array(sorted(self.byte_ids.values()) or [-1]))
        for k in range(len(edges) - 1):
            part = flat[bounds[k]:bounds[k + 1]]
            own = ids[edges[k]:edges[k + 1]]
            spoken = np.flatnonzero(size[edges[k]:edges[k + 1]] > 0)
            if len(spoken) and part.startswith(b" ") and not bytes_[edges[k] + spoken[0]]:
                if self.squeeze:
                    part = part.lstrip(b" ")
                elif self.dummy_prefix and self.kinds[own[spoken[0]]] == NORMAL:
                    part = part[1:]
            try:
                part.decode()
            except UnicodeDecodeError:
                part = self._replace(part)
            out.append(part)
        return out

    @staticmethod
    def _replace(data: bytes) -> bytes:
        """Every byte that is not part of a UTF-8 character becomes U+FFFD."""
        out, at = bytearray(), 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out += data[at:at + size].decode().encode()
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out += "�".encode()
                at += 1
        return bytes(out)


class _PairTable:
    """Order and result of the merges by pair: open addressing, looked up for many pairs at once."""

    def __init__(self, orders: dict[int, int], pieces: dict[int, int]):
        keys = np.array(list(orders), np.int64)
        bits = max(8, int(len(keys) * 5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.orders = np.full(1 << bits, NEVER, np.int64)
        self.pieces = np.zeros(1 << bits, np.int64)
        left, slots = np.arange(len(keys)), self.slot(keys)
        while len(left):  # of the pairs that want a free slot the first gets it, the others go on
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]] = keys[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slots = left[rest], (slots[rest] + 1) & self.mask
        filled = np.flatnonzero(self.keys >= 0)
        self.orders[filled] = [orders[k] for k in self.keys[filled].tolist()]
        self.pieces[filled] = [pieces[k] for k in self.keys[filled].tolist()]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the merge (``NEVER``: there is none) and the piece it makes."""
        wanted = np.where((left < 0) | (right < 0), -2, left * SHIFT + right)
        slots = self.slot(wanted)
        held = self.keys[slots]
        flat_slots, flat_wanted = slots.reshape(-1), wanted.reshape(-1)
        going = np.flatnonzero(((held != wanted) & (held >= 0)).reshape(-1))
        while len(going):  # someone else's slot
            flat_slots[going] = (flat_slots[going] + 1) & self.mask
            held = self.keys[flat_slots[going]]
            going = going[(held != flat_wanted[going]) & (held >= 0)]
        there = self.keys[slots] == wanted
        return np.where(there, self.orders[slots], NEVER), self.pieces[slots]


class _Words(dict):
    """Pieces of a word behind a blank mark, as 16-bit numbers."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        return np.array(self.model.merge(BLANK + word), np.uint16).tobytes()


_models: dict[str, PieceModel] = {}


def open_model(path: str) -> PieceModel:
    """The model of a file, read once per process."""
    if path not in _models:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only BPE models are supported")
        _models[path] = PieceModel(
            [p.piece.encode() for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces],
            CharacterMap(proto.normalizer_spec.precompiled_charsmap), proto.normalizer_spec.add_dummy_prefix,
            proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces,
            proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id,
            proto.trainer_spec.unk_surface.encode(), proto.trainer_spec.byte_fallback)
    return _models[path]


def encode_block(model: PieceModel, texts: list[str], ends: bool):
    """Numbers, row edges, starts and ends of the pieces of some texts."""
    rows = model.encode_many(texts)
    edges = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    ids = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    start, stop = model.project(texts, ids, edges)
    if ends:
        sizes = [len(t.encode()) for t in texts]
        at = np.repeat(edges, 2)[1:-1]  # before and behind each text
        ids = np.insert(ids, at, np.tile([model.begin, model.end], len(texts)))
        own = np.ravel(np.column_stack([np.zeros(len(texts), np.int64), sizes])) if texts else []
        start, stop = np.insert(start, at, own), np.insert(stop, at, own)
        edges = edges + 2 * np.arange(len(edges))
    return ids, edges, start, stop


def encode(docs: DataFrame, path: str, ends: bool = False) -> DataFrame:
    """Adds piece_ids, span_starts and span_ends (byte places in the text) to ``docs``.

    With ``ends``, the begin and end numbers are added with empty spans. NULL
    and empty texts have no pieces. Repeated rows stay repeated; other columns
    pass through.
    """
    def run(batch):
        model = open_model(path)
        found = [encode_block(model, texts, ends) for texts in block_texts(batch.column("text"))]
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(f[1]) for f in found]])
        edges = pa.array(np.cumsum(sizes), pa.int32())
        flat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]), pa.int32())
        return [pa.ListArray.from_arrays(edges, flat(k)) for k in (0, 2, 3)]

    return add_columns(docs, run, "piece_ids array<int>, span_starts array<int>, span_ends array<int>", "text")


def decode(rows: DataFrame, path: str, column: str = "piece_ids") -> DataFrame:
    """Adds the decoded text of a column of piece numbers; NULL gives the empty text."""
    def run(batch):
        model = open_model(path)
        own = [np.array(ids or [], np.int64) for ids in batch.column(column).to_pylist()]
        edges = np.concatenate(([0], np.cumsum([len(i) for i in own]))).astype(np.int64)
        return [pa.array([d.decode() for d in model.decode_many(np.concatenate([np.zeros(0, np.int64), *own]), edges)],
                         pa.string())]

    return add_columns(rows, run, "decoded string", column)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and span_bytes: encodes, projects and decodes each text."""
    def run(batch):
        model = open_model(path)
        counts, hashes, decoded, covered = [], [], [], []
        for texts in block_texts(batch.column("text")):
            ids, edges, start, stop = encode_block(model, texts, True)
            raw = ids.astype("<u4").tobytes()
            counts.extend(np.diff(edges))
            hashes.extend(hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(edges, edges[1:]))
            decoded.extend(hashlib.sha256(d).hexdigest() for d in model.decode_many(ids, edges))
            covered.extend(np.add.reduceat(stop - start, edges[:-1]))
        return [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()),
                pa.array(covered, pa.int64())]

    return add_columns(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long", "text")
