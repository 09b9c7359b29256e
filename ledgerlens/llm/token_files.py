"""Token ids in binary files: an adaptive context-mixing range coder in independent, checksummed blocks.

Coder. A block starts with its different ids in ascending order. Its next id is predicted by adaptive counts of these ids (order 0), by the ids
that followed the previous id (order 1: the likely one with a confidence, and the other where order 2 names the likely one already), and by the id
that followed the previous two (order 2, with a confidence). The distributions are mixed linearly; the mixing
weights belong to the pair of confidences and move towards the model that was right. The mixture is one integer frequency
table, whose interval of the id drives a carryless range coder. All numbers are integers, so any machine decodes alike. Blocks
start from the same empty state and can be decoded alone. Up to ``LANES`` blocks of a file advance together, one id a step each, in NumPy. Counts
enter the frequency table when they have grown by a fifth.

File. ``magic``, then blocks (ids, bytes of the different ids and of the payload, crc32 of the ids, both), an index of documents (doc_id and
length each, deflated, crc32), and a footer with sizes. Ids of a file are the ids of its documents in ascending doc_id order; documents may
span blocks. The number of doc_id ranges follows from the bytes of text; a range gives one file, or several where it is larger than others (a hot
doc_id). Files are written under a name of their own and then renamed, so that a repeated task replaces its files by the same bytes.

Null texts are empty; every document has at least the end id. Rows with a null doc_id come first. Repeated rows are kept, equal doc_ids in
the order of their texts' hashes. An empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices

MAGIC = b"MIXR0002"
BLOCK = 2048
LANES = 4096
NEAR = 256  # lanes whose counts are worked on at once
FILE_IDS = BLOCK * LANES  # a file ends with the slice of documents that reaches them
PART_BYTES = 16 << 20  # text of a range of doc_ids, which is a task and, but for skew, a file
SLICE = 4 << 20  # text encoded at once
ONE = 4096  # sum of mixing weights
MOST = 3840  # most weight of the two guesses
SLOTS = 1024  # order-2 contexts of a block
HASH = np.array([30011, 40503], np.uint16).view(np.int16)  # factors of the previous two symbols; a sum's low 14 bits count
FOUR = np.uint64(0x1000100010001)
FULL = np.uint64((1 << 64) - 1)
WORD, LOW, SHIFT = np.uint64(1 << 32), np.uint64((1 << 32) - 1), np.uint64(32)


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` without the checks of bounds, which cost more than the reads."""
    return values.take(at, mode="clip")


def choose(right: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """``np.where`` by arithmetic, which does not branch."""
    return no + (yes - no) * right


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two arrays of 16 bits as one of 32."""
    out = np.empty((len(low), 2), "<i2")
    out[:, 0], out[:, 1] = low, high
    return out.view("<i4")[:, 0]


def halves(both: np.ndarray) -> np.ndarray:
    """What ``joined`` got, in two rows."""
    return both.view("<i2").reshape(-1, 2).T


def running(values: np.ndarray) -> np.ndarray:
    """Running sums in 16 bits, modulo 2 ** 16, of small numbers: first of every four, which one product gives, then of these."""
    sums = values.view("<u8") * FOUR
    fours = sums >> np.uint64(48)
    before = np.cumsum(fours) - fours & np.uint64(0xFFFF)
    return sums.view("<i2") + (before * FOUR).view("<i2")


class Mixer:
    """Model state of a stack of blocks, one lane each. Symbols are numbered within their lane; ``widths`` are the lanes' distinct ids.

    What is read at one place is one number, since steps wait for memory: a symbol's two followers and a context's two weights (16 bits each), a symbol's
    start and count. Symbols, states and weights are worked on in 16 bits, and what is done for both guesses is done to one array of two rows.
    ``history`` has the symbols of all steps, in rows; they are counted when the frequency table is made anew.
    """

    def __init__(self, widths: np.ndarray, history: np.ndarray, tabled: bool):
        lanes, self.tabled, self.history = len(widths), tabled, history
        self.row = np.concatenate([[0], np.cumsum(widths)])
        self.first = self.row[:-1]
        self.counts, self.spans = np.ones(self.row[-1], np.int32), np.zeros(self.row[-1], np.int32)  # a span: start << 12 | count
        self.followers = np.zeros(self.row[-1], np.int32)  # by previous symbol: (the likely successor << 2 | confidence, another one)
        self.longer = np.zeros(lanes * SLOTS, np.int16)  # by hash of the previous two: successor << 2 | confidence
        if tabled:
            self.table = np.empty(self.row[-1] + lanes * len(history), np.int16)
        two, one = np.divmod(np.arange(16), 4)
        start = np.stack([np.array([64, 256, 512, 1024])[two], np.array([64, 384, 1024, 1792])[one]])
        self.weight = np.tile(joined(*start.astype(np.int16)), lanes)  # (of order 2, of order 1)
        self.slot0, self.weight0 = np.arange(lanes) * SLOTS, np.arange(lanes) * 16
        self.here, self.own, self.hashed = self.first, np.zeros(lanes, np.int16), np.zeros(lanes, np.int16)
        self.steps = self.since = self.due = 0

    def refresh(self) -> None:
        """Cumulate the counts of the lanes still in use, and for decoding lay out one table entry per count; some lanes at a time, which stay near."""
        n = len(self.first)
        widths = np.diff(self.row[:n + 1])
        self.total = (widths + self.steps).astype(np.int32)  # what a lane has counted
        self.whole = (self.total * ONE).astype(np.uint64)
        self.base = self.first + np.arange(n) * self.steps
        fresh = self.history[self.since:self.steps]
        for a in range(0, n, NEAR):
            b = min(a + NEAR, n)
            here, first = slice(self.row[a], self.row[b]), self.first[a:b] - self.row[a]
            counts = self.counts[here]
            if len(fresh):
                counts += np.bincount((fresh[:, a:b] + first).ravel(), minlength=len(counts))
            start = np.cumsum(counts, dtype=np.int32)
            start -= counts
            if self.tabled:
                # An entry's symbol is the number of symbols that begin up to it, without those of lanes before.
                size = start[-1] + counts[-1]
                begins = np.zeros(-(-size // 4) * 4, np.int16)
                begins[start] = 1
                np.subtract(running(begins)[:size], np.repeat((first + 1).astype(np.int16), self.total[a:b]), out=self.table[self.base[a]:self.base[a] + size])
            start -= np.repeat((first + np.arange(b - a) * self.steps).astype(np.int32), widths[a:b])
            start <<= 12
            np.bitwise_or(start, counts, out=self.spans[here])
        self.since = self.steps
        self.due = self.steps + max(32, self.steps // 5)

    def shrink(self, n: int) -> None:
        """Go on with the first n lanes only; a lane's numbers do not depend on the others."""
        for name in ("first", "slot0", "weight0", "base", "total", "whole", "here", "own", "hashed"):
            setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> None:
        if self.steps == self.due:
            self.refresh()
        self.slot = self.slot0 + (self.hashed >> 4 & SLOTS - 1)
        self.held = halves(pick(self.followers, self.here))[::-1].copy()
        self.other, self.held[0] = self.held[0].copy(), pick(self.longer, self.slot)
        self.likely, self.sure = self.held >> 2, self.held & 3
        two, one = self.likely
        self.guess = self.likely.copy()
        self.guess[1] = choose(one == two, self.other, one)
        self.at = self.weight0 + (self.sure[0] << 2 | self.sure[1])
        self.w = halves(pick(self.weight, self.at)).copy()
        mixed = self.w.astype(np.int32)
        mixed[1] *= self.guess[1] != two
        self.w0 = ONE - mixed[0] - mixed[1]
        self.mass = mixed * self.total

    def counted(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, start << 12 | count) of the symbols among the counted ones."""
        at = self.first + symbols
        return at, pick(self.spans, at)

    def interval(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the symbols, which ``learn`` gets next, in the mixed frequency table, whose sum is ``whole``."""
        self.there, span = self.counted(symbols)
        self.hit = self.guess == symbols
        below, inside = self.mass * (self.guess < symbols), self.mass * self.hit
        start = (span >> 12) * self.w0 + below[0] + below[1]
        size = (span & 4095) * self.w0 + inside[0] + inside[1]
        return start.astype(np.uint64), size.astype(np.uint64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Symbols whose intervals hold the values."""
        guess, mass = self.guess, self.mass
        span = np.stack([self.counted(g)[1] for g in guess])
        start, size = (span >> 12) * self.w0, (span & 4095) * self.w0
        start += mass[::-1] * (guess[::-1] < guess)
        past = value >= start
        inside = past & (value - start < size + mass)
        passed = mass * past
        # What is left of a value without the guesses below it lies in the order-0 counts alone.
        x = np.maximum(value - passed[0] - passed[1], 0).view(np.uint32) // self.w0.view(np.uint32)
        found = pick(self.table, self.base + x)
        return choose(inside[0], guess[0], choose(inside[1], guess[1], found))

    def learn(self, symbols: np.ndarray) -> None:
        right = self.hit
        np.greater(right[1], right[0], out=right[1])
        self.w += right * np.int16(MOST) - self.w >> 5
        self.weight[self.at] = joined(*self.w)
        hit, doubt = self.likely == symbols, self.sure > 0
        kept = choose(hit, self.held + (self.sure < 3), choose(doubt, self.held - 1, symbols << 2))
        self.longer[self.slot] = kept[0]
        self.followers[self.here] = joined(kept[1], choose(hit[1], self.other, choose(doubt[1], symbols, self.likely[1])))
        self.hashed = self.own * HASH[0] + symbols * HASH[1]
        self.here, self.own = self.there, symbols
        self.steps += 1


def ready(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes that pass on their upper word, and their ``low`` before it; one whose interval crosses into the next word gives up what lies beyond."""
    lanes = np.flatnonzero(width < WORD)
    held = pick(low, lanes)
    width[lanes] = np.minimum(pick(width, lanes), WORD - (held & LOW)) << SHIFT
    low[lanes] = held << SHIFT
    return lanes, held


def in_use(sizes: np.ndarray) -> list[int]:
    """For each step, how many blocks (longest first) have an id left."""
    return np.searchsorted(-sizes, -np.arange(sizes[0]), "left").tolist()


def encode_blocks(blocks: list[np.ndarray], widths: np.ndarray) -> list[bytes]:
    """Payloads of blocks of symbols (each block's below its width), longest block first."""
    sizes = np.array([len(b) for b in blocks])
    n, most = len(blocks), int(sizes[0])
    symbols = np.zeros((most, n), np.int16)
    for k, b in enumerate(blocks):
        symbols[:len(b), k] = b
    model = Mixer(widths, symbols, tabled=False)
    low, width = np.zeros(n, np.uint64), np.full(n, FULL)
    begin = np.arange(n) * (most + 2)
    out, used = np.zeros(n * (most + 2), np.uint32), begin.copy()
    last, active = np.zeros(n, np.uint64), n
    for k, now in enumerate(in_use(sizes)):
        if now < active:
            last[now:active] = low[now:]
            low, width, active = low[:now], width[:now], now
            model.shrink(now)
        model.predict()
        row = symbols[k, :active]
        start, size = model.interval(row)
        unit = width // model.whole
        low = low + unit * start
        width = unit * size
        lanes, held = ready(low, width)
        at = pick(used, lanes)
        out[at] = held >> SHIFT
        used[lanes] = at + 1
        model.learn(row)
    last[:active] = low
    for k, shift in enumerate((SHIFT, np.uint64(0))):
        out[used + k] = (last >> shift) & LOW
    return [out[a:b + 2].astype("<u4").tobytes() for a, b in zip(begin.tolist(), used.tolist(), strict=True)]


def decode_blocks(payloads: list[bytes], sizes: list[int], widths: np.ndarray) -> list[np.ndarray]:
    """Symbols of payloads, longest block first."""
    n, most = len(payloads), sizes[0]
    begin = np.cumsum([0, *(len(p) // 4 for p in payloads)])
    source = np.frombuffer(b"".join(payloads), "<u4")
    out, active = np.zeros((most, n), np.int16), n
    model = Mixer(widths, out, tabled=True)
    low, width = np.zeros(n, np.uint64), np.full(n, FULL)
    code, used = source[begin[:-1]].astype(np.uint64) << SHIFT | source[begin[:-1] + 1], begin[:-1] + 2
    for k, now in enumerate(in_use(np.array(sizes))):
        if now < active:
            low, width, code, active = low[:now], width[:now], code[:now], now
            model.shrink(now)
        model.predict()
        unit = width // model.whole
        value = np.minimum((code - low) // unit, model.whole - np.uint64(1)).astype(np.int32)
        row = model.find(value)
        start, size = model.interval(row)
        low = low + unit * start
        width = unit * size
        lanes, _ = ready(low, width)
        at = pick(used, lanes)
        code[lanes] = pick(code, lanes) << SHIFT | pick(source, at)  # a damaged payload may ask for more
        used[lanes] = at + 1
        model.learn(row)
        out[k, :active] = row
    out = np.ascontiguousarray(out.T)
    return [out[k, :s] for k, s in enumerate(sizes)]


def packed_ids(many: list[np.ndarray]) -> list[bytes]:
    """Each array of ascending ids as gaps: a byte each below 255, and 255 for each whole 255 before."""
    edge = np.cumsum([0, *map(len, many)])
    ids = np.concatenate(many)
    gaps = np.diff(ids, prepend=0) - 1
    gaps[edge[:-1]] = ids[edge[:-1]]
    more, rest = np.divmod(gaps, 255)
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = rest
    raw, cut = out.tobytes(), [0, *ends[edge[1:] - 1].tolist()]
    return [raw[a:b] for a, b in itertools.pairwise(cut)]


def unpacked_ids(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    sums = np.cumsum(raw, dtype=np.int64)[raw != 255]
    return sums + np.arange(len(sums))


def numbered(block: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the block in numbers of these); ``number`` is scratch of the alphabet's size."""
    ids = np.sort(block)
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    ids = ids[new].astype(np.int64)
    number[ids] = np.arange(len(ids), dtype=np.int32)
    return ids, pick(number, block)


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, alphabet: int) -> bytes:
    blocks = [ids[k:k + BLOCK] for k in range(0, len(ids), BLOCK)]
    parts = [MAGIC]
    number = np.zeros(alphabet, np.int32)
    for k in range(0, len(blocks), LANES):
        group = blocks[k:k + LANES]  # only the last block of a file may be shorter
        known, symbols = zip(*(numbered(b, number) for b in group), strict=True)
        for block, own, payload in zip(group, packed_ids(known), encode_blocks(symbols, np.array([len(d) for d in known])), strict=True):
            parts += [struct.pack("<IIII", len(block), len(own), len(payload), zlib.crc32(block.astype("<u4").tobytes())), own, payload]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes())
    return b"".join([*parts, index, struct.pack("<QQQII", len(blocks), len(doc_ids), len(index), zlib.crc32(index), alphabet)])


def parsed(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file's bytes; ValueError where a checksum fails."""
    blocks, docs, size, check, _ = struct.unpack_from("<QQQII", data, len(data) - 32)
    index = data[len(data) - 32 - size:len(data) - 32]
    if data[:8] != MAGIC or zlib.crc32(index) != check:
        raise ValueError("not a token file, or its index is damaged")
    raw = zlib.decompress(index)
    known, doc_ids, lengths = np.frombuffer(raw, np.uint8, docs), np.frombuffer(raw, "<i8", docs, docs), np.frombuffer(raw, "<i8", docs, 9 * docs)
    at, heads, own, payloads = 8, [], [], []
    for _ in range(blocks):
        n, width, held, crc = struct.unpack_from("<IIII", data, at)
        heads.append((n, crc))
        own.append(unpacked_ids(data[at + 16:at + 16 + width]))
        payloads.append(data[at + 16 + width:at + 16 + width + held])
        at += 16 + width + held
    out = []
    for k in range(0, blocks, LANES):
        group = slice(k, k + LANES)
        made = decode_blocks(payloads[group], [n for n, _ in heads[group]], np.array([len(o) for o in own[group]]))
        for (n, crc), ids, symbols in zip(heads[group], own[group], made, strict=True):
            block = ids[symbols].astype("<i4")
            if zlib.crc32(block.tobytes()) != crc:
                raise ValueError(f"block of {n} ids is damaged")
            out.append(block)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, np.concatenate(out) if out else np.zeros(0, np.int32)


class Numbers:
    """Numbers of 64-bit keys other than 0. Keys lie in order, so that looking up many, in order too, reads what is near."""

    def __init__(self) -> None:
        self.keys, self.numbers = np.zeros(1, np.uint64), np.zeros(1, np.int64)

    def further(self, new: np.ndarray) -> np.ndarray:
        """Numbers not used yet, for new keys of which nothing else is to be known."""
        return np.arange(len(self.keys), len(self.keys) + len(new))

    def of(self, keys: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The keys' numbers; ``make`` gives those of new keys, by a place of each among ``keys``."""
        if not len(keys):
            return np.zeros(0, np.int64)
        cut = pa.array(keys).dictionary_encode()
        which, different = cut.indices.to_numpy(), cut.dictionary.to_numpy()
        place = np.empty(len(different), np.int64)
        place[which] = np.arange(len(keys))
        order = np.argsort(different)
        different = different[order]
        at = np.searchsorted(self.keys, different)
        new = pick(self.keys, at) != different
        numbers = pick(self.numbers, at)
        numbers[new] = make(place[order[new]])
        self.keys, self.numbers = np.insert(self.keys, at[new], different[new]), np.insert(self.numbers, at[new], numbers[new])
        mine = np.empty(len(order), np.int64)
        mine[order] = numbers
        return pick(mine, which)


class Encoder:
    """Ids of texts by the tokenizers library, which gets every different piece once and so long as it is remembered.

    A tokenizer that lower-cases, drops white space and cuts the rest by ``CUTS`` into runs that merge on their own is told from its
    file. Texts of code points below 256 (where composition changes nothing and lower case is by character) are cut alike here, a slice of texts
    as one array, and the library's merges work on the different pieces. Other texts of a tokenizer that drops white space go to the library a word at a time,
    texts of any other tokenizer whole.
    """

    #: Fixed value: the pattern of such a tokenizer file.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    SPACE, NUMBER, LETTER, OTHER = range(4)
    KINDS = bytes(0 if chr(c) in "\t\n\v\f\r \x85\xa0" else {"N": 1, "L": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(256))
    LOWER = bytes(ord(chr(c).lower()) for c in range(256))
    FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # bits of the first n bytes

    def __init__(self, tokenizer_file: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.alphabet = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t.content.lower().encode("latin-1", "replace") for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["a b", " a\n b ", "é  é\n\nx", "don't 's re"]
        whole = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in probe]
        self.by_word = whole == [sum((self.tokenizer.encode(w, add_special_tokens=False).ids for w in p.replace("\n", " ").split(" ") if w), []) for p in probe]
        self.by_piece = self.by_word and self.cuts_alike()
        # A byte-level vocabulary writes printable bytes as themselves and the others as code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.spelled = {c: "".join(self.letter[b] for b in chr(c).encode()) for c in range(256)}
        self.remember, self.words = remember, {}
        self.forget()

    def cuts_alike(self) -> bool:
        """Whether the file normalises and cuts as the class says."""
        rules = json.loads(self.tokenizer.to_str())
        steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in (rules["normalizer"] or {}).get("normalizers", [])]
        cuts = [(p["type"], p.get("pattern", {}).get("Regex"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return (steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and rules["post_processor"] is None and rules["model"]["type"] == "BPE"
                and cuts == [("Split", self.CUTS, True, None, None), ("ByteLevel", None, None, False, False)])

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words: each chunk is encoded as one text with the words a newline apart, and cut by the offsets."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 256):
            chunk = words[k:k + 256]
            made = self.tokenizer.encode("\n".join(chunk), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in chunk])
            ids = np.array(made.ids, "<i4")
            cut = np.searchsorted([a for a, _ in made.offsets], ends, "left").tolist()
            out.update(zip(chunk, (ids[a:b].tobytes() for a, b in zip([0, *cut], cut, strict=False)), strict=True))
        return out

    def forget(self) -> None:
        """Start the store of pieces anew: a number of each, and its ids as a run of one array. Number 0 is the end of a text.

        A piece of at most 8 bytes is told by these as one integer, of at most 16 by the numbers of its two halves.
        """
        self.begins, self.ids = np.arange(2), np.zeros(1, np.int32)
        self.short, self.halves, self.middle = Numbers(), Numbers(), Numbers()
        self.pieces: dict[bytes, int] = {}  # the others

    def merge(self, piece: bytes) -> list[int]:
        if piece.isalpha():  # ASCII letters are spelled as themselves
            return [t.id for t in self.model.tokenize(piece.decode())]
        return [] if self.KINDS[piece[0]] == self.SPACE else [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.spelled))]

    def cut(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes, a newline after each text; starts and sizes of its pieces, without other white space; which pieces are these newlines)."""
        raw = b"".join(itertools.chain.from_iterable((t, b"\n") for t in texts)).translate(self.LOWER)
        data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(self.KINDS), np.uint8)
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == self.NUMBER)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        edge[stops] = edge[stops + 1] = True
        # An apostrophe of its own takes a short ending from the letters after it.
        at = np.flatnonzero(data == ord("'"))
        at = at[edge[at] & edge[at + 1] & (kind[at + 1] == self.LETTER)]
        one, two = data[at + 1], data[at + 2]
        short = np.isin(one, list(b"stmd"))
        size = short + 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        at, size = at[size > 0], size[size > 0]
        edge[at + 1], edge[at + 1 + size] = False, True
        kept = kind != self.SPACE
        kept[stops] = True
        starts, ends = np.flatnonzero(edge[:-1] & kept), np.flatnonzero(edge[1:] & kept) + 1
        return raw, starts, ends - starts, np.searchsorted(starts, stops)

    def learned(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces that are new to the store."""
        ids, ends, count = [], [], len(self.begins) - 1
        for piece in pieces:  # lists are not kept, since the garbage collector would go through all of them time and again
            ids += self.merge(piece)
            ends.append(len(ids))
        self.begins = np.concatenate([self.begins, len(self.ids) + np.array(ends, np.int64)])
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        return count + np.arange(len(pieces))

    def numbers(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each piece in the store, which learns the new ones."""
        if len(self.pieces) > self.remember or max(len(self.begins), len(self.ids) // 4) > 2 * self.remember:
            self.forget()
        out = np.empty(len(sizes), np.int64)
        eight = np.ndarray(len(raw) + 8, "<u8", raw + bytes(15), strides=(1,))
        most = 0 if b"\0" in raw else 8  # bytes 0 are those after a piece

        def pieces(of: np.ndarray) -> list[bytes]:
            return [raw[a:a + n] for a, n in zip(starts[of].tolist(), sizes[of].tolist(), strict=True)]

        short = np.flatnonzero(sizes <= most)
        out[short] = self.short.of(eight[starts[short]] & self.FIRST[sizes[short]], lambda new: self.learned(pieces(short[new])))
        middle = np.flatnonzero((sizes > most) & (sizes <= 2 * most))
        half = [eight[starts[middle]], eight[starts[middle] + 8] & self.FIRST[np.maximum(sizes[middle] - 8, 0)]]
        one, two = (self.halves.of(h, self.halves.further).astype(np.uint64) for h in half)
        out[middle] = self.middle.of(one << SHIFT | two, lambda new: self.learned(pieces(middle[new])))
        rest = np.flatnonzero(sizes > 2 * most)
        long = pieces(rest)
        fresh = list(dict.fromkeys(p for p in long if p not in self.pieces))
        self.pieces.update(zip(fresh, self.learned(fresh).tolist(), strict=True))
        out[rest] = [self.pieces[p] for p in long]
        return out

    def encode_plain(self, texts: list[bytes], end: int) -> tuple[list[int], np.ndarray]:
        """(lengths, all ids) of texts given by their code points, all below 256."""
        if not texts:
            return [], np.zeros(0, "<i4")
        raw, starts, sizes, stops = self.cut(texts)
        numbers = self.numbers(raw, starts, sizes)
        numbers[stops] = 0
        self.ids[0] = end
        begins = pick(self.begins, numbers)
        size = pick(self.begins, numbers + 1) - begins
        ends = np.cumsum(size)
        return np.diff(ends[stops], prepend=0).tolist(), pick(self.ids, np.repeat(begins - ends + size, size) + np.arange(ends[-1]))

    def packed(self, split: list[list[str]], known: dict[str, bytes], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """Packed ids of texts given as parts; short parts are remembered."""
        fresh = set(itertools.chain.from_iterable(split)).difference(known)
        if len(known) + len(fresh) > self.remember:
            known.clear()
            fresh = set(itertools.chain.from_iterable(split))
        here = make(list(fresh))
        long = {p: v for p, v in here.items() if len(p) > 64}
        known.update(here if not long else ((p, v) for p, v in here.items() if len(p) <= 64))
        find = (known | long if long else known).__getitem__
        return [b"".join(map(find, parts)) for parts in split]

    def points(self, text: str) -> bytes | None:
        """Code points of a text that may be cut here."""
        try:
            raw = text.encode("latin-1") if self.by_piece else None
        except UnicodeEncodeError:
            return None
        return None if raw is None or any(a in raw.lower() for a in self.added) else raw

    def encode(self, texts: list[str], end: int) -> tuple[list[int], np.ndarray]:
        """(lengths, all ids) of the texts, each with the end id."""
        points = [self.points(t) for t in texts]
        plain = [p is not None for p in points]
        first, ids = self.encode_plain([p for p in points if p is not None], end)
        if all(plain):
            return first, ids
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        if self.by_word:
            made = self.packed([t.replace("\n", " ").split(" ") for t in rest], self.words, self.learn)
        else:
            made = [np.array(e.ids, "<i4").tobytes() for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
        stop = np.array([end], "<i4").tobytes()
        at = np.cumsum([0, *first])
        both = [iter([ids[a:b].tobytes() for a, b in itertools.pairwise(at)]), iter([m + stop for m in made])]
        out = [next(both[not p]) for p in plain]
        return [len(m) // 4 for m in out], np.frombuffer(b"".join(out), "<i4")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer_file: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once per worker process."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def write(docs: DataFrame, path: str, tokenizer_file: str, *, end: int, doc_id: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode ``docs`` into files under ``path``; (name, ids, documents) of the files in doc_id order."""
    uri = path if "://" in path else f"file://{path}"

    def stored(name: str, doc_ids: list, lengths: list[int], ids: list[np.ndarray], alphabet: int) -> pa.RecordBatch:
        data = file_bytes(doc_ids, lengths, np.concatenate(ids), alphabet)
        system, folder = opened(uri)
        trial = f"{folder}/_trial-{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(trial) as f:
            f.write(data)
        system.move(trial, f"{folder}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(lengths)], pa.int64()), pa.array([len(doc_ids)], pa.int64())], names=["name", "n_ids", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file)
        doc_ids, lengths, ids, held, number = [], [], [], 0, 0
        for b in batches:
            part = b.column(2)[0].as_py()
            for at, size in slices(b.column(1), SLICE):
                texts = [t.decode("utf-8", "replace") if t else "" for t in b.column(1).slice(at, size).to_pylist()]
                n, made = encoder.encode(texts, end)
                doc_ids += b.column(0).slice(at, size).to_pylist()
                lengths += n
                ids.append(made.astype(np.int32))
                held += len(made)
                if held >= FILE_IDS:
                    yield stored(f"{part:08d}-{number:08d}.ids", doc_ids, lengths, ids, encoder.alphabet)
                    doc_ids, lengths, ids, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield stored(f"{part:08d}-{number:08d}.ids", doc_ids, lengths, ids, encoder.alphabet)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    parts = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    rows = rows.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    made = rows.mapInArrow(run, "name string, n_ids long, n_docs long").collect()  # one row per file
    return sorted((r["name"], r["n_ids"], r["n_docs"]) for r in made)


def read(spark: SparkSession, path: str, files: list[tuple[str, int, int]], *, packed: bool = False) -> DataFrame:
    """(doc_id, start, ids) of every document of the files; ``start`` counts the ids of all documents before it.

    ``packed``: ids as little-endian unsigned 32-bit integers in one binary value, not as an array.
    """
    begin = dict(zip((f[0] for f in files), itertools.accumulate((f[1] for f in files), initial=0), strict=False))
    shared = spark.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, lengths, ids = parsed(data.as_py())
                starts = np.concatenate([[0], np.cumsum(lengths)])
                for k in range(0, len(doc_ids), 2000):
                    edge = starts[k:k + 2001]
                    flat = ids[edge[0]:edge[-1]].astype("<i4")
                    if packed:
                        raw = flat.tobytes()
                        lists = pa.array([raw[4 * a:4 * b] for a, b in zip(edge - edge[0], edge[1:] - edge[0], strict=False)], pa.binary())
                    else:
                        lists = pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k:k + 2000], pa.int64()), pa.array(edge[:-1] + shared.value[name.rsplit("/", 1)[-1]]), lists], names=["doc_id", "start", "ids"])

    schema = f"doc_id long, start long, ids {'binary' if packed else 'array<int>'}"
    if not files:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path)
    return raw.select("path", "content").mapInArrow(run, schema)
