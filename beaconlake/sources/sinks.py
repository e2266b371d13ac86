"""A sink of text objects, each there once: the data source ``objects`` for tables and streams, and its reader.

A row (``object``, ``text``) is a file. Tasks write files into folders of their own, which nobody sees yet; the commit names these folders in one small file
(``commits/<batch>.json``), which appears whole or not at all. A batch that was committed before is not committed again, so a micro-batch that is run twice leaves one
copy, and what failed or repeated tasks wrote is never read. The driver gets a row a task, whatever the number of objects. Files are written by the tasks through
pyarrow's file systems, so ``path`` may be any folder that all machines reach.

Defined results: a null text is an empty object, a null name is ``unnamed``; several rows of one name are several files. Of a name that takes over 150 characters as a file's name,
only the first twelve and a digest are kept. Other columns than the two are refused by Spark's analysis.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from beaconlake.session import ship_package

OBJECT = "object string, text string"
LINES = "object string, path string, line_no long, line string"
#: Around a file's name, so that no name is hidden or read as a compressed file.
HEAD, TAIL = "o-", ".txt"


@dataclass
class Folder(WriterCommitMessage):
    """What a task wrote: a folder, or none."""

    name: str | None


def _file(name: str | None) -> str:
    quoted = quote("unnamed" if name is None else name, safe="")
    if len(quoted) > 150:
        quoted = f"{quote(name[:12], safe='')}-{hashlib.sha256(name.encode()).hexdigest()}"
    return f"{HEAD}{quoted}{TAIL}"


class _Objects:
    """Both writers' work: files of a task, and the commit of all tasks' folders under one name."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Folder:
        store, root = fs.FileSystem.from_uri(self.path)
        folder, times, made = f"{root}/data/{uuid.uuid4().hex}", Counter(), 0
        for row in iterator:
            name = _file(row["object"])
            # a folder for first files of a name, one for second files, and so on
            if times[name] == made:
                store.create_dir(f"{folder}/{made}", recursive=True)
                made += 1
            with store.open_output_stream(f"{folder}/{times[name]}/{name}") as out:
                out.write((row["text"] or "").encode())
            times[name] += 1
        return Folder(folder.rsplit("/", 1)[1] if made else None)

    def named(self, messages: list, name: str) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        done = f"{root}/commits/{name}.json"
        if store.get_file_info(done).type != fs.FileType.NotFound:
            self.removed(messages)
            return
        store.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/commits/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"folders": [m.name for m in messages if m is not None and m.name]}).encode())
        store.move(draft, done)

    def removed(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_dir(f"{root}/data/{m.name}")


class TableWriter(_Objects, DataSourceWriter):
    def __init__(self, path: str, batch: str):
        super().__init__(path)
        self.batch = batch

    def commit(self, messages: list) -> None:
        self.named(messages, self.batch)

    def abort(self, messages: list) -> None:
        self.removed(messages)


class StreamWriter(_Objects, DataSourceStreamWriter):
    def __init__(self, path: str, query: str):
        super().__init__(path)
        self.query = query

    def commit(self, messages: list, batchId: int) -> None:
        self.named(messages, f"{self.query}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.removed(messages)


class ObjectSink(DataSource):
    """Options: ``path``; ``batch``, the name of a table's write (a new one if not given); ``query``, the name of a stream that shares the path with others."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return OBJECT

    def writer(self, schema, overwrite: bool) -> TableWriter:
        if overwrite:
            raise ValueError("committed objects are not replaced: use mode append")
        return TableWriter(self.options["path"], quote(self.options.get("batch", uuid.uuid4().hex), safe=""))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], quote(self.options.get("query", "stream"), safe=""))


def _registered(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ObjectSink)


def _spread(rows: DataFrame) -> DataFrame:
    """The rows in as many parts as shuffles have here: a row is a file, whose cost isn't that of its few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def write_objects(objects: DataFrame, path: str, batch: str | None = None) -> None:
    """Write ``object, text``; a batch of a name that is committed already changes nothing."""
    _registered(objects.sparkSession)
    store, root = fs.FileSystem.from_uri(path)
    if batch is not None and store.get_file_info(f"{root}/commits/{quote(batch, safe='')}.json").type != fs.FileType.NotFound:
        return  # the commit looks again, for a write that runs beside
    writer = _spread(objects.select("object", "text")).write.format("objects").mode("append").option("path", path)
    (writer if batch is None else writer.option("batch", batch)).save()


def stream_objects(objects: DataFrame, path: str, checkpoint: str, query: str = "stream") -> DataStreamWriter:
    """A writer of a stream of ``object, text``. A new checkpoint counts micro-batches from 0 again, so it needs a new ``query`` name or path."""
    _registered(objects.sparkSession)
    return objects.select("object", "text").writeStream.format("objects").option("path", path).option("query", query).option("checkpointLocation", checkpoint).outputMode("append")


def _committed(spark: SparkSession, path: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/commits").type == fs.FileType.NotFound:
        return []
    return [r[0] for r in spark.read.schema("folders array<string>").json(f"{path}/commits").select(F.explode("folders")).collect()]


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Columns of LINES: the lines of all committed objects. ``line_no`` orders those of one ``path``; ``object`` is the name (its beginning and a digest, if it was too long).

    Tasks list the folders and then read files one after the other; the driver has the folders' names alone, and no table of files is kept anywhere.
    """
    folders = _committed(spark, path)
    if not folders:
        return spark.createDataFrame([], LINES)
    ship_package(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = f"{root}/data/{folder}"
                found = [f.path[len(inside) :].lstrip("/") for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.is_file]
                yield pa.record_batch([pa.array([f"{folder}/{x}" for x in found], pa.string())], ["name"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            rows: list[tuple] = []
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/data/{name}") as source:
                    text = source.read().replace(b"\r\n", b"\n").replace(b"\r", b"\n").decode("utf-8", "replace").removesuffix("\n")
                file = name.rsplit("/", 1)[1]
                called, own = unquote(file[len(HEAD) : -len(TAIL)]), f"{path}/data/{name}"
                rows += [(called, own, i, line) for i, line in enumerate(text.split("\n") if text else [])]
                if len(rows) >= 10_000:
                    yield _lines(rows)
                    rows = []
            if rows:
                yield _lines(rows)

    def _lines(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["object", "path", "line_no", "line"])

    names = spark.createDataFrame([(x,) for x in folders], "folder string").repartition("folder").mapInArrow(listed, "name string")
    return _spread(names).mapInArrow(lines, LINES)


def remove_leftovers(spark: SparkSession, path: str, hours: float = 24) -> int:
    """Remove folders of failed or repeated tasks that are older than ``hours`` (longer than any write takes); how many there were."""
    store, root = fs.FileSystem.from_uri(path)
    kept, limit = set(_committed(spark, path)), datetime.now(timezone.utc) - timedelta(hours=hours)
    found = store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True))
    old = [f.path for f in found if f.base_name not in kept and f.mtime is not None and f.mtime < limit]
    for folder in old:
        store.delete_dir(folder)
    return len(old)
