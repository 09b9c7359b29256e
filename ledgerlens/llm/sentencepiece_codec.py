"""SentencePiece encoding with original byte spans, and decoding.

Normalisation follows the model's compiled character map: at each position the longest prefix that the map's
double-array trie knows is replaced, other characters stay, and every normalised byte records the source offset
it came from. Pieces are found on the normalised text by the sentencepiece library (a copy of the model whose own
normaliser is switched off), and each piece's normalised bytes are projected through the recorded offsets to a byte
span of the original text.

No piece of a whitespace-split model has a word boundary mark after another character, so merges never reach over such a
boundary and a text's pieces are those of its boundary-to-boundary segments; this is checked on the vocabulary, and a
model that fails it is encoded a whole text at a time. Segments are encoded in batches and short ones are remembered.

A null or empty text has the end id alone. Spans are byte offsets into the UTF-8 text; the end id has an empty span
at the end. In a character that falls back to bytes, the last byte piece carries the character's span.
Repeated rows give repeated results, an empty table an empty result; extra columns pass through.
"""

from __future__ import annotations

import itertools
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct, fresh_name

MARK = "▁"
MARK_BYTES = MARK.encode()
PAIR = np.dtype([("id", "<i4"), ("size", "<i4")])
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

RESULT = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])


def fields(data: bytes):
    """(number, value, raw bytes of the whole field) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        begin = at
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at:at + size]
            at += size
        yield key >> 3, value, data[begin:at]


def length_delimited(number: int, value: bytes) -> bytes:
    out, n = bytearray([number << 3 | 2]), len(value)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n]) + value


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes whose values point at replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0]
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement of the longest known prefix of ``data[at:]``, and the prefix's length."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0]:self.texts.index(b"\0", found[0])], found[1]


class Codec:
    def __init__(self, model_file: str, remember: int = 200_000):
        with open(model_file, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        rules, rest, pieces = {}, [], []
        for number, value, raw in fields(model):
            if number == 3:
                rules = {n: v for n, v, _ in fields(value)}
            else:
                rest.append(raw)
            if number == 1:
                piece = {n: v for n, v, _ in fields(value)}
                pieces.append((piece.get(1, b""), piece.get(3, NORMAL)))
        self.char_map = CharMap(rules[2]) if rules.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        # Fixed value: a normaliser without map, prefix, squeezing or escaping.
        off = length_delimited(1, b"identity") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=b"".join([*rest, length_delimited(3, off)]))
        self.symbols = sorted((p for p, kind in pieces if kind == USER_DEFINED), key=len, reverse=True)
        within = re.compile(rb"(?<!" + re.escape(MARK_BYTES) + rb")(?<!^)" + re.escape(MARK_BYTES))
        self.by_segment = not self.symbols and not any(within.search(p) for p, _ in pieces)
        self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.size_of = np.array([len(p) if kind in (NORMAL, USER_DEFINED, UNUSED) else -1 for p, kind in pieces])
        self.bytes = {k: int(p[3:5], 16) for k, (p, kind) in enumerate(pieces) if kind == BYTE}
        self.remember, self.known = remember, {}

    # -- normalisation ---------------------------------------------------------------------------------------------

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source offset it came from."""
        if self.char_map is None and not self.squeeze and not self.symbols and data:
            return self._unmapped(data)
        out, source, at = bytearray(), [], 0
        space = MARK_BYTES if self.escape else b" "
        if self.squeeze:
            while at < len(data):
                text, size = self._step(data, at)
                if text != b" ":
                    break
                at += size
        if at == len(data):
            return b"", np.array([at])
        if self.prefix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            text, size = self._step(data, at)
            while after_space and text.startswith(b" "):
                text = text[1:]
            if text:
                made = text.replace(b" ", space)
                out += made
                source += [at] * len(made)
                after_space = text.endswith(b" ")
            at += size
            after_space = after_space and self.squeeze
        if self.squeeze:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[len(out) - len(space):], source[len(source) - len(space):]
        return bytes(out), np.array([*source, at])

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        for s in self.symbols:
            if data.startswith(s, at):
                return s, len(s)
        found = self.char_map.longest(data, at) if self.char_map else None
        if found:
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at:at + size], size

    def _unmapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same where no character changes but a space: it stands for the three bytes of its mark."""
        space = MARK_BYTES if self.escape else b" "
        source = np.arange(len(data) + 1)
        wide = np.frombuffer(data + b"x", np.uint8) == 32
        source = np.repeat(source, np.where(wide, len(space), 1))
        if self.prefix:
            source = np.concatenate([np.zeros(len(space), source.dtype), source])
        return (space if self.prefix else b"") + data.replace(b" ", space), source

    # -- pieces ----------------------------------------------------------------------------------------------------

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """Packed (id, normalised size) pairs of each segment."""
        order = list(segments)
        made = self.plain.encode(order, num_threads=1)
        flat = np.zeros(sum(map(len, made)), PAIR)
        flat["id"] = np.fromiter(itertools.chain.from_iterable(made), np.int32, len(flat))
        flat["size"] = self.size_of[flat["id"]]
        edge = list(itertools.accumulate(map(len, made), initial=0))
        odd = np.flatnonzero(flat["size"] < 0)
        for k in np.unique(np.searchsorted(edge, odd, "right") - 1).tolist():
            flat["size"][edge[k]:edge[k + 1]] = self._sizes(order[k], made[k])
        packed, width = flat.tobytes(), PAIR.itemsize
        return {s: packed[width * a:width * b] for s, a, b in zip(order, edge, edge[1:], strict=False)}

    def _sizes(self, text: str, ids: list[int]) -> list[int]:
        sizes = self.size_of[ids].tolist()
        if any(size < 0 and k not in self.bytes for size, k in zip(sizes, ids, strict=True)):
            return [len(p.surface.encode()) for p in self.plain.encode(text, return_type="proto").pieces]
        due = 0
        for k, i in enumerate(ids):
            if i in self.bytes:
                lead = self.bytes[i]
                if not due:
                    size = due = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                due -= 1
                sizes[k] = 0 if due else size
        return sizes

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text, end id included."""
        normal = [self.normalise(t) if t else (b"", np.array([0])) for t in texts]
        split = [self.segment.findall(n.decode()) if self.by_segment else [n.decode()] if n else [] for n, _ in normal]
        if len(self.known) > self.remember:
            self.known.clear()
        fresh = set(itertools.chain.from_iterable(split)).difference(self.known)
        here = self.learn(fresh) if fresh else {}
        self.known.update((s, v) for s, v in here.items() if len(s) <= 64)
        known = self.known if all(len(s) <= 64 for s in fresh) else self.known | here
        out = []
        for text, (_, source), segments in zip(texts, normal, split, strict=True):
            pairs = np.frombuffer(b"".join(map(known.__getitem__, segments)), PAIR)
            edge = source[np.concatenate([[0], np.cumsum(pairs["size"])])] if len(pairs) else np.zeros(1, np.int64)
            end = len(text or b"")
            # a byte piece before the last of its character has an empty span: size 0
            out.append((np.append(pairs["id"], self.library.eos_id()).astype(np.int32),
                        np.append(edge[:-1], end).astype(np.int32), np.append(edge[1:], end).astype(np.int32)))
        return out


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a model file, loaded once per worker process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model_file: str, *, text_col: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` with struct column ``into``: ``ids`` (with the end id), ``starts``, ``ends`` and the ``decoded`` text."""

    def run(texts: list) -> pa.StructArray:
        c = codec(model_file)
        made = c.encode(texts)
        decoded = [c.library.decode(ids.tolist()) for ids, _, _ in made]
        return pa.StructArray.from_arrays([*(lists([m[k] for m in made]) for k in range(3)), pa.array(decoded, pa.string())], names=RESULT.names)

    return append_struct(docs, text_col, run, RESULT, into or fresh_name(docs, "pieces"), slice_bytes=2 << 20)
