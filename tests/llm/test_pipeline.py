"""The pipeline stage by stage against plain versions, and on awkward rows."""

import os
import sys

import public_tokenizers
import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from ledgerlens.llm import decontaminate
from test_native_rules import base_spans
from test_ngram_join import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    odd = [(None, "the and of this is it that was", "en", "s", 30), (900001, None, "en", "s", 0), (900002, "", None, None, None), (900003, "12 34 %%", "de", "s", 8),
           (first.doc_id, first.text, first.lang, first.source, first.n_chars), (900004, first.text, "en", "other", 5), (900005, "Mail bob@example.org or +1 (212) 555-0100 the and of that is", "en", "s", 60)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("identified", docs.source).withColumn("pii", docs.source)
    seen = [[r.asDict() for r in docs.collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([r.asDict() for r in docs.collect()])
    rows, language, near, clean, private, pieces = seen
    ids = lambda x: sorted(str(r["doc_id"]) for r in x)

    # Language: rows without letters go, all others stay and keep or get their language.
    assert ids(language) == ids(r for r in rows if r["text"] and any(c.isalpha() for c in r["text"]))
    assert sum(r["lang"] == {x["doc_id"]: x["lang"] for x in rows}[r["doc_id"]] for r in language) >= 0.99 * len(language)
    # Near duplicates: one row of each group.
    groups = {k: c for k, _, c in near_brute([(r["doc_id"], r["text"]) for r in language])}
    expected = {r["doc_id"] for r in language if r["doc_id"] is not None and groups[r["doc_id"]] == r["doc_id"]}
    assert ids(near) == sorted([*map(str, expected), "None"])
    # Contamination.
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = decontaminate.build(items, 13)

    def contaminated(text):
        words = decontaminate.words_of(text.encode())
        hit = sum(b - a for a, b in decontaminate.search(tables, words)[0])
        return hit > 0 and 20 * hit >= len(words)

    assert ids(clean) == ids(r for r in near if not contaminated(r["text"])) and len(clean) < len(near)
    # Personal data: same rows, no base span left, n_chars follows.
    before = {r["doc_id"]: r["text"] for r in clean}
    assert ids(private) == ids(clean)
    for r in private:
        assert r["n_chars"] == len(r["text"])
        assert not base_spans(r["text"])
        if not base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]] or "<SECRET>" in r["text"]
    assert any("<EMAIL>" in r["text"] and "<PHONE>" in r["text"] for r in private)
    # Pieces: the library's ids, and the text again.
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in private}
    assert ids(pieces) == ids(private)
    for r in pieces:
        assert r["ids"] == [*library.encode(text[r["doc_id"]]), 2] and r["decoded"] == library.decode(r["ids"])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
