"""Evaluation records as a data source: JSON lines with a manifest, written whole or not at all.

Tasks write files of their own into a folder of the job, which goes if the job fails; the manifest, written last, says which of them count and between which keys their records lie. A reader opens only those
files whose range can hold what the filters ask for, one partition each. A folder with anything in it is refused.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT, MANIFEST = "statement_records", "manifest.json"
KINDS = (T.LongType, T.IntegerType, T.DoubleType, T.StringType, T.BooleanType)


def _store(path: str):
    """A file system and the path in it, for a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{os.path.abspath(path)}")


def _files(store, root: str) -> list[str]:
    from pyarrow import fs

    return [f.path for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]


def _manifest(path: str) -> dict:
    store, root = _store(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    name: str
    records: int
    least: object
    most: object


@dataclass
class File(InputPartition):
    name: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, key: str) -> None:
        if odd := [f.name for f in schema if not isinstance(f.dataType, KINDS)]:
            raise ValueError(f"records hold numbers, texts and booleans, not {odd}")
        if key not in schema.names:
            raise ValueError(f"records have no column {key}")
        self.path, self.schema, self.key, self.run = path, schema.json(), key, f"run-{uuid.uuid4().hex}"
        store, root = _store(path)
        if found := _files(store, root):
            raise FileExistsError(f"{path} holds {len(found)} files already")
        store.create_dir(f"{root}/{self.run}", recursive=True)  # here only: a task that outlives its job finds no folder

    def write(self, iterator: Iterator) -> Part:
        store, root = _store(self.path)
        name, n, least, most = f"{self.run}/part-{uuid.uuid4().hex}.jsonl", 0, None, None
        try:
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for batch in iterator:
                    rows = batch.to_pylist()
                    out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode())
                    keys = [r[self.key] for r in rows if r[self.key] is not None]
                    n += len(rows)
                    if keys:
                        least = min(keys) if least is None else min(least, *keys)
                        most = max(keys) if most is None else max(most, *keys)
        except BaseException:
            if store.get_file_info(f"{root}/{name}").is_file:
                store.delete_file(f"{root}/{name}")
            raise
        return Part(name, n, least, most)

    def commit(self, messages: list) -> None:
        """Writes the manifest, and lets go the files of attempts that were given up."""
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").is_file:
            self.abort(messages)
            raise FileExistsError(f"{self.path} was written by another job meanwhile")
        kept = [m for m in messages if m is not None and m.records]
        text = json.dumps({"schema": json.loads(self.schema), "key": self.key, "records": sum(m.records for m in kept), "files": [vars(m) for m in kept]})
        with store.open_output_stream(f"{root}/.{MANIFEST}", compression=None) as out:
            out.write(text.encode())
        store.move(f"{root}/.{MANIFEST}", f"{root}/{MANIFEST}")
        names = {os.path.basename(m.name) for m in kept}
        for f in _files(store, f"{root}/{self.run}"):
            if os.path.basename(f) not in names:
                store.delete_file(f)

    def abort(self, messages: list) -> None:
        """All files of the job, those of tasks that were through but not counted as well."""
        store, root = _store(self.path)
        store.delete_dir(f"{root}/{self.run}")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the key choose files; Spark applies all of them to the rows as well."""
        key = (_manifest(self.path)["key"],)
        self.tests = [f for f in filters if getattr(f, "attribute", None) == key]
        yield from filters

    @staticmethod
    def _may_hold(f: Filter, least, most) -> bool:
        if least is None:  # no record has a key
            return not isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
        if isinstance(f, EqualTo):
            return least <= f.value <= most
        if isinstance(f, In):
            return any(least <= v <= most for v in f.value if v is not None)
        if isinstance(f, GreaterThan):
            return most > f.value
        if isinstance(f, GreaterThanOrEqual):
            return most >= f.value
        if isinstance(f, LessThan):
            return least < f.value
        if isinstance(f, LessThanOrEqual):
            return least <= f.value
        return True

    def partitions(self) -> list[File]:
        return [File(f["name"]) for f in _manifest(self.path)["files"] if all(self._may_hold(t, f["least"], f["most"]) for t in self.tests)]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:  # no file may hold a record
            return
        names = [f["name"] for f in _manifest(self.path)["schema"]["fields"]]
        store, root = _store(self.path)
        import io

        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                row = json.loads(line)
                yield tuple(row[n] for n in names)


class RecordSource(DataSource):
    """Options: path, and for writing key (doc_id), the column whose ranges choose files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(_manifest(self.options["path"])["schema"])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("records are never overwritten")
        return _Writer(self.options["path"], schema, self.options.get("key", "doc_id"))


def write_records(records: DataFrame, path: str, key: str = "doc_id") -> None:
    """Records as files of a folder that holds none yet. Ordered by the key beforehand, files are easily left out by a reader."""
    records.sparkSession.dataSource.register(RecordSource)
    records.write.format(FORMAT).option("key", key).mode("append").save(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder, a partition for each file that the filters may need. Lets Spark hand filters to Python sources, for the session."""
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).load(path)
