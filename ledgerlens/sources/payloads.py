"""Keyed JSON feed as a Spark data source: a folder that holds one JSON document per key, ``{key}.json``.

``register(spark)`` makes the format ``json_by_key`` known; then

* ``spark.read.format("json_by_key").load(folder)`` gives ``key, payload, error``. The sorted file names are cut into ranges of
  ``keysPerPartition`` (64) keys; each range is one task, which opens its own files. A document that cannot be read, is empty or is
  no JSON gives a NULL payload and the reason in ``error``; it never fails the other keys. An empty folder has no rows, a missing
  one is an error.
* ``key = ..`` and ``key in (..)`` open the files of these keys only (``session.REQUIRED`` turns Spark's pushdown to Python sources on,
  which a reader that takes filters needs).
* ``df.select("key", "payload").write.format("json_by_key").mode("append").save(folder)`` writes one document per row: each under a
  temporary name that is renamed when it is complete, so readers see whole documents and a repeated task overwrites its own. A
  NULL payload becomes an empty document, a NULL key is refused. Mode ``overwrite`` also removes keys that were not written.

Keys are percent-encoded in file names, so any text is a key. Folders are paths or URIs that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "json_by_key"
SUFFIX = ".json"


def _folder(path: str):
    """The file system of ``path`` and the path within it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _file(key: str) -> str:
    return quote(key, safe="") + SUFFIX


@dataclass
class KeyRange(InputPartition):
    """File names of consecutive keys."""

    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per_partition = path, per_partition
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 (name of the interface)
        """Takes key equalities; Spark evaluates the other filters."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("key",):
                keys = {str(k) for k in (f.value if isinstance(f, In) else [f.value]) if k is not None}
                self.wanted = keys if self.wanted is None else self.wanted & keys
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        from pyarrow import fs

        files, root = _folder(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        names = sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(SUFFIX))
        if self.wanted is not None:
            wanted = {_file(k) for k in self.wanted}
            names = [n for n in names if n in wanted]
        return [KeyRange(tuple(names[i:i + self.per_partition])) for i in range(0, len(names), self.per_partition)]

    def read(self, partition: KeyRange | None) -> Iterator[tuple]:
        if not isinstance(partition, KeyRange):
            return  # a folder without documents
        files, root = _folder(self.path)
        for name in partition.names:
            key = unquote(name[: -len(SUFFIX)])
            try:
                with files.open_input_stream(f"{root}/{name}") as f:
                    text = f.read().decode("utf-8")
                json.loads(text)
            except (OSError, ValueError, RecursionError) as e:
                yield key, None, f"{type(e).__name__}: {e}"
            else:
                yield key, text, None


class PayloadWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        names = []
        for row in rows:
            if row["key"] is None:
                raise ValueError("a payload needs a key")
            name, part = _file(row["key"]), f"{root}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as f:
                f.write((row["payload"] or "").encode("utf-8"))
            files.move(part, f"{root}/{name}")
            names.append(name)
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _folder(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            kept = {n for m in messages if m is not None for n in m.names}
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.base_name.endswith(SUFFIX) and f.base_name not in kept:
                    files.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        """Documents that are complete stay: each is whole by itself, and the next run writes it again."""


class JsonByKey(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, payload string, error string"

    def reader(self, schema: StructType) -> PayloadReader:
        per_partition = int(self.options.get("keysPerPartition", "64"))
        if per_partition < 1:
            raise ValueError("keysPerPartition must be at least 1")
        return PayloadReader(self.options["path"], per_partition)

    def writer(self, schema: StructType, overwrite: bool) -> PayloadWriter:
        return PayloadWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonByKey)


def write_payloads(df: DataFrame, folder: str, key: str = "slug", payload: str = "payload", mode: str = "append") -> None:
    """One document per row of ``df``; keys are unique."""
    register(df.sparkSession)
    df.selectExpr(f"`{key}` as key", f"`{payload}` as payload").write.format(FORMAT).mode(mode).save(folder)


def read_payloads(spark: SparkSession, folder: str, key: str = "slug", keys_per_partition: int = 64) -> DataFrame:
    """The folder's documents as ``{key}, payload, error``."""
    register(spark)
    return spark.read.format(FORMAT).option("keysPerPartition", keys_per_partition).load(folder).withColumnRenamed("key", key)
