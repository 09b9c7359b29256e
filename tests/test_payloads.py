"""The keyed JSON feed: documents per key, broken ones as NULL rows, key ranges as tasks, overwrites, and the leaderboard through it."""

import pytest

from ledgerlens.sources.payloads import read_payloads, write_payloads


def test_round_trip_of_any_key_and_ranges(spark, tmp_path):
    folder = str(tmp_path / "feed")
    rows = [(k, f'{{"v": {i}, "name": "ü"}}') for i, k in enumerate(["app-1", "a/b", "..", "x y", "ü%2F", "", "_hidden", "app-2"])]
    write_payloads(spark.createDataFrame(rows, "slug string, payload string").repartition(3), folder)
    got = read_payloads(spark, folder, keys_per_partition=3)
    assert got.columns == ["slug", "payload", "error"]
    found = {r.slug: (r.payload, r.error) for r in got.collect()}
    plain = {k: (p, None) for k, p in rows if k != "_hidden"}
    assert found == {**plain, "_hidden": ('{"v": 6, "name": "ü"}', None)}
    assert got.rdd.getNumPartitions() == 3


def test_broken_documents_are_null_rows(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    for name, data in (("good", b"{}"), ("cut", b'{"a": '), ("empty", b""), ("bytes", b"\xff\xfe")):
        (folder / f"{name}.json").write_bytes(data)
    (folder / "notes.txt").write_text("no payload")
    (folder / "sub").mkdir()
    got = {r.slug: r for r in read_payloads(spark, str(folder)).collect()}
    assert set(got) == {"good", "cut", "empty", "bytes"}
    assert got["good"].payload == "{}" and got["good"].error is None
    assert all(got[k].payload is None and got[k].error for k in ("cut", "empty", "bytes"))


def test_empty_folder_overwrite_and_null_key(spark, tmp_path):
    folder = str(tmp_path / "feed")
    write_payloads(spark.createDataFrame([], "slug string, payload string"), folder)
    assert read_payloads(spark, folder).count() == 0
    write_payloads(spark.createDataFrame([("a", "1"), ("b", None)], "slug string, payload string"), folder)
    write_payloads(spark.createDataFrame([("a", "2")], "slug string, payload string"), folder)
    assert {r.slug: r.payload for r in read_payloads(spark, folder).collect()} == {"a": "2", "b": None}
    write_payloads(spark.createDataFrame([("c", "3")], "slug string, payload string"), folder, mode="overwrite")
    assert {r.slug: r.payload for r in read_payloads(spark, folder).collect()} == {"c": "3"}
    with pytest.raises(Exception, match="needs a key"):
        write_payloads(spark.createDataFrame([(None, "3")], "slug string, payload string"), folder)
    with pytest.raises(Exception):
        read_payloads(spark, str(tmp_path / "missing")).collect()


def test_key_filter_opens_its_files_only(spark, tmp_path):
    folder = str(tmp_path / "feed")
    write_payloads(spark.createDataFrame([(f"k{i}", str(i)) for i in range(20)], "slug string, payload string"), folder)
    few = read_payloads(spark, folder, keys_per_partition=1).where("slug in ('k3', 'k7', 'none')")
    assert few.rdd.getNumPartitions() == 2
    assert {r.slug: r.payload for r in few.collect()} == {"k3": "3", "k7": "7"}
    one = read_payloads(spark, folder, keys_per_partition=1).where("slug = 'k4' and payload > '0'")
    assert [(r.slug, r.payload) for r in one.collect()] == [("k4", "4")]


def test_leaderboard_reads_its_payloads_from_the_folder(spark, tmp_path):
    """Through the folder as from the table; a slug with a broken document, or none, has no value."""
    from ledgerlens.plans import bd
    from ledgerlens.sources import fixtures as fx

    tables, folder = fx.long_history(spark, "/root/testdata/sf0.001"), tmp_path / "feed"
    write_payloads(tables["protocol_tvl"], str(folder))
    board = lambda t: [tuple(r) for r in bd.leaderboard_tvl(t, fx.LONG_AS_OF, "month", fx.FIXTURE_TVL_CHAIN).collect()]
    plain, fed = board(tables), tables.with_payload_folder(spark, str(folder))
    assert board(fed) == plain and any(r[-1] is not None for r in plain)
    (folder / "app-1.json").write_text("<html>502</html>")
    (folder / "app-2.json").write_text('{"currentChainTvls": {"c1": "unknown"}}')
    lost = [(*r[:-1], None) if r[1] in ("app-1", "app-2") else r for r in plain]
    assert lost != plain and board(fed.with_payload_folder(spark, str(folder))) == lost
