import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlens.llm import queries
from ledgerlens.llm import token_files as x

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 49407), st.integers(0, 5), st.sampled_from([0, 1, 255, 256, 49407])), max_size=6000), st.integers(1, 4))
def test_files_give_back_what_they_hold(ids, times):
    ids = np.array(ids * times, np.int32)
    data = x.file_bytes([None, -5, 2**62], [0, len(ids) // 2, len(ids) - len(ids) // 2], ids, 49408)
    doc_ids, lengths, back = x.parsed(data)
    assert doc_ids == [None, -5, 2**62] and lengths.tolist() == [0, len(ids) // 2, len(ids) - len(ids) // 2] and (back == ids).all()


def test_predictable_ids_take_few_bits_and_damage_is_noticed():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 49408, 50)
    ids = np.tile(phrase, 400).astype(np.int32)
    data = x.file_bytes([1], [len(ids)], ids, 49408)
    assert 8 * len(data) < 3 * len(ids)
    for at in (60, len(data) - 40):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises((ValueError, zlib.error, IndexError)):
            x.parsed(bytes(broken))


def test_words_are_encoded_as_in_whole_texts():
    texts = ["", " ", "Don't's 're it's", "é́x  ﬁ İstanbul ΣΑΣ", "a\tb\r\nc d　e", "<|endoftext|> x<|startoftext|>", "漢字 👍🏽 123", "x" * 5000, "\n\n  \n", "a" * 300 + " b"]
    library = Tokenizer.from_file(VOCABULARY)
    lengths, ids = x.Encoder(VOCABULARY).encode(texts, 1)
    assert x.Encoder(VOCABULARY).by_word
    edge = np.concatenate([[0], np.cumsum(lengths)])
    for k, t in enumerate(texts):
        assert ids[edge[k]:edge[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1], t


def test_frame_edges(spark, tmp_path):
    rows = [(5, "b b", "x"), (None, "null id", "x"), (3, None, "x"), (4, "", "x"), (5, "b b", "x"), (-1, "long word " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    files = x.write(df, str(tmp_path / "a"), VOCABULARY, end=1)
    got = sorted((r.start, r.doc_id, list(r.ids)) for r in x.read(spark, str(tmp_path / "a"), files).collect())
    library = Tokenizer.from_file(VOCABULARY)
    order = [1, 5, 2, 3, 0, 4]
    expected, at = [], 0
    for k in order:
        ids = [*library.encode(rows[k][1] or "", add_special_tokens=False).ids, 1]
        expected.append((at, rows[k][0], ids))
        at += len(ids)
    assert got == expected
    empty = x.write(df.where("false"), str(tmp_path / "b"), VOCABULARY, end=1)
    assert x.read(spark, str(tmp_path / "b"), empty).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    library, at = Tokenizer.from_file(VOCABULARY), 0
    got = {r.doc_id: r for r in queries.QUERIES["op4_token_files"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 1], "<u4")
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not got


def test_blocks_are_independent_of_their_neighbours():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, w, n) for w, n in ((40, 900), (5, 900), (300, 700), (1, 300))]
    widths = np.array([40, 5, 300, 1])
    payloads = x.encode_blocks(blocks, widths)
    for k, (block, payload) in enumerate(zip(blocks, payloads, strict=True)):
        assert x.encode_blocks([block], widths[k:k + 1]) == [payload]
        assert (x.decode_blocks([payload], [len(block)], widths[k:k + 1])[0] == block).all()


def test_ids_take_clearly_fewer_bits_than_deflated_blocks(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]
    lengths, ids = x.Encoder(VOCABULARY).encode(texts, 1)
    deflated = sum(len(zlib.compress(ids[k:k + x.BLOCK].astype("<u2").tobytes())) for k in range(0, len(ids), x.BLOCK))
    assert len(x.file_bytes([1], [len(ids)], ids, 49408)) < 0.92 * deflated


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="'stmdrevlaZéÉß×µª²½1 \t\n\x85\xa0\x1c\x00.,!<|>ĀΣ́", max_size=30), max_size=5))
def test_cut_pieces_are_the_librarys(texts):
    library, encoder = Tokenizer.from_file(VOCABULARY), x.encoder_of(VOCABULARY)
    assert encoder.by_piece
    lengths, ids = encoder.encode(texts, 1)
    expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert lengths == [len(e) for e in expected] and ids.tolist() == sum(expected, [])


def test_a_hot_range_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(x, "FILE_IDS", 50)
    monkeypatch.setattr(x, "SLICE", 200)
    df = spark.createDataFrame([(7, f"word{k} and some more words") for k in range(60)], "doc_id long, text string")
    files = x.write(df, str(tmp_path / "hot"), VOCABULARY, end=1)
    assert len(files) > 3
    got = x.read(spark, str(tmp_path / "hot"), files).collect()
    assert len(got) == 60 and sorted(r.start for r in got)[1] == len(min(got, key=lambda r: r.start).ids)


def test_a_step_reads_the_model_once_for_what_lies_together(monkeypatch):
    read, plain = [], x.pick

    def counted(values, at):
        read.append(values.dtype)
        return plain(values, at)

    ids = (np.arange(6000) ** 2 // 7 % 300).astype(np.int32)
    blocks = [np.unique(ids[k:k + 1000], return_inverse=True)[1] for k in range(0, 6000, 1000)]
    widths = np.array([b.max() + 1 for b in blocks])
    monkeypatch.setattr(x, "pick", counted)
    payloads = x.encode_blocks(blocks, widths)
    of_model = [sum(d in (np.int16, np.int32) for d in read)]
    read.clear()
    back = x.decode_blocks(payloads, [1000] * 6, widths)
    of_model.append(sum(d in (np.int16, np.int32) for d in read))
    assert all((a == b).all() for a, b in zip(back, blocks, strict=True))
    assert of_model == [4 * 1000, 7 * 1000]  # 7 and 12 a step, when followers, weights, starts and counts were arrays of their own
    assert zlib.crc32(b"".join(payloads)) == 3378777920  # of the former code: files stay the same


@pytest.mark.parametrize("remember", [2, 600_000])
def test_short_pieces_are_told_by_numbers(remember):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abÿé"), n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 30) for _ in range(40)]
    texts = [" ".join(rng.permutation(words)) for _ in range(3)] + ["abcdefgh abcdefghabcdefgh abcdefghi abcdefgh", "aaaaaaaabbbbbbbb bbbbbbbbaaaaaaaa", ""]
    nuls = ["\x00", "\x00\x00 \x00", "a\x00 a !\x00 ! \x00\x00\x00\x00\x00\x00\x00\x00\x00", "abcdefgh\x00"]
    library, encoder = Tokenizer.from_file(VOCABULARY), x.Encoder(VOCABULARY, remember)
    for part in (texts, nuls, texts[::-1], texts + nuls):
        lengths, ids = encoder.encode(part, 1)
        expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in part]
        assert lengths == [len(e) for e in expected] and ids.tolist() == sum(expected, [])
    encoder.forget()
    encoder.encode(texts, 1)
    assert {len(p) for p in encoder.pieces} == {17, 30}  # all of them, when each was a key of a dictionary


def test_counts_are_taken_some_lanes_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    blocks = [np.unique(rng.integers(0, w, n), return_inverse=True)[1] for w, n in ((300, 900), (5, 900), (70, 900), (1, 400), (1, 1))]
    widths = np.array([b.max() + 1 for b in blocks])
    payloads = x.encode_blocks(blocks, widths)
    sizes, plain = [], np.bincount

    def counted(values, minlength):
        sizes.append(minlength)
        return plain(values, minlength=minlength)

    monkeypatch.setattr(np, "bincount", counted)
    monkeypatch.setattr(x, "NEAR", 2)
    assert x.encode_blocks(blocks, widths) == payloads
    assert max(sizes) == widths[0] + widths[1]  # the sum of all widths, when the lanes were counted in one go
    assert all((a == b).all() for a, b in zip(x.decode_blocks(payloads, [len(b) for b in blocks], widths), blocks, strict=True))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=70), st.integers(0, 3000))
def test_running_sums(values, times):
    values = np.array((values * (1 + times))[:4 * (len(values) * (1 + times) // 4)], np.int16)
    assert (x.running(values) == np.cumsum(values, dtype=np.int16)).all()
