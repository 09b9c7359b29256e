import hashlib
import struct

import public_tokenizers
import sentencepiece

from ledgerlens.llm import queries
from ledgerlens.llm.sentencepiece_codec import CharMap, Codec, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "▁x ▁", "héllo 𝕏 漢字 \x00 \t\n x́", "a▁▁ b  ", "<s> </s> <unk> <0x41>", "日本" * 50, "x" * 3000, "the the the", "Ünïcode\n\nlines\r\n", "ᚠᛇ ᚻ🙂🙂"]


def test_ids_and_spans_equal_the_library(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = Codec(MODEL).encode([t.encode() for t in docs])
    for text, (ids, starts, ends) in zip(docs, made, strict=True):
        proto = library.encode(text, return_type="proto")
        assert ids.tolist() == [*library.encode(text), 2]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True))[:-1] == [(p.begin, p.end) for p in proto.pieces]
        assert (starts[-1], ends[-1]) == (len(text.encode()), len(text.encode()))


def test_whole_text_path_agrees_with_segments():
    a, b = Codec(MODEL), Codec(MODEL)
    b.by_segment = False
    for x, y in zip(a.encode([t.encode() for t in TEXTS]), b.encode([t.encode() for t in TEXTS]), strict=True):
        assert all((p == q).all() for p, q in zip(x, y, strict=True))


def double_array(entries: dict[bytes, int]) -> list[int]:
    """A small double-array trie, built by first fit: the format the compiled character map uses."""
    units, used = [0] * 4096, {0}

    def place(node: int, depth: int, keys: list[bytes]):
        labels = sorted({k[depth] for k in keys if len(k) > depth})
        leaf = [k for k in keys if len(k) == depth]
        base = next(b for b in range(1, 2048) if all((node ^ b ^ x) not in used for x in [*labels, *([0] if leaf else [])]))
        units[node] |= base << 10 | (1 << 8 if leaf else 0)
        child = node ^ base
        used.update(child ^ x for x in labels)
        if leaf:
            used.add(child)
            units[child] = entries[leaf[0]] | 1 << 31
        for x in labels:
            units[child ^ x] = x
        for x in labels:
            place(child ^ x, depth + 1, [k for k in keys if len(k) > depth and k[depth] == x])

    place(0, 0, list(entries))
    return units


def test_character_map_takes_the_longest_prefix_and_keeps_alignment():
    texts = b"f\0ffi!\0 \0"
    units = double_array({b"F": 0, "ﬀ".encode(): 2, "ﬀi".encode(): 2, "　".encode(): 7})
    codec = Codec(MODEL)
    codec.char_map = CharMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts)
    assert codec.char_map.longest("ﬀix".encode(), 0) == (b"ffi!", 4)
    assert codec.char_map.longest(b"zF", 0) is None
    codec.squeeze = True
    normal, source = codec.normalise(" Fa　 ﬀib ".encode())
    assert normal.decode() == "▁fa▁ffi!b"
    assert source.tolist() == [1, 1, 1, 1, 2, 3, 3, 3, 7, 7, 7, 7, 11, 12]


def test_plain_scan_equals_the_general_scan():
    codec = Codec(MODEL)
    for text in TEXTS[1:]:
        fast = codec.normalise(text.encode())
        codec.symbols = [b"\xff"]  # never found, but it takes the general path
        slow = codec.normalise(text.encode())
        codec.symbols = []
        assert fast[0] == slow[0]
        whole = [k for k, b in enumerate(text.encode()) if b & 0xC0 != 0x80]
        assert set(slow[1].tolist()) <= {*whole, len(text.encode())}


def test_frame_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (3, "", None)]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string, pieces string"), MODEL)
    assert out.columns == ["doc_id", "text", "pieces", "_pieces"]
    got = sorted((r.doc_id or 0, r.text or "", r.pieces or "", list(r._pieces.ids), r._pieces.decoded) for r in out.collect())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert got == sorted([(1, "", "x", [2], ""), (1, "", "x", [2], ""), (0, "a b", "y", [*library.encode("a b"), 2], "a b"), (3, "", "", [2], "")])
    assert encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.QUERIES["op9_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = [*library.encode(d.text), 2]
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
