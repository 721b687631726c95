"""Tables outside of Spark by its Python Data Source API: a provider's graph read in pages, and an event log that a stream
appends to once a batch, whatever fails in between.

Both live in a folder that the driver and all executors mount. A path that cannot be opened is an error, never an empty
table."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

EDGE = "src string, dst string, kind string, confidence double"
NODE = "uid string, kind string, name string"
LOGGED = "run_id string, seq long, t string, payload string"
_TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}


def _local(path: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", path)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


@dataclass
class Page(InputPartition):
    path: str


class GraphReader(DataSourceReader):
    """A page is a file of JSON lines; pages are read by tasks of their own. A line that does not parse is an error.

    `match` (field to value) is tried while a page is read, and a page is left as soon as it gave `most` rows. A field
    that the table has not is an error."""

    def __init__(self, folder: str, table: str, rows: int, match: dict[str, Any] | None = None, most: int | None = None):
        self.folder, self.table, self.rows, self.match, self.most = folder, table, rows, match or {}, most
        self.fields = _fields(NODE if table == "nodes" else EDGE)
        if unknown := sorted(set(self.match) - {n for n, _ in self.fields}):
            raise ValueError(f"{table} have no field {', '.join(unknown)}")

    def partitions(self) -> list[Page]:
        pages = sorted(f for f in os.listdir(self.folder) if re.match(rf"{self.table}[^/]*\.jsonl?$", f))
        if not pages:
            raise FileNotFoundError(f"no page of {self.table} in {self.folder}")
        return [Page(os.path.join(self.folder, f)) for f in pages]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        given = 0
        with open(page.path, encoding="utf-8") as f:
            for line in f:
                row = json.loads(line) if line.strip() else None
                if row is not None and all(row.get(k) == v for k, v in self.match.items()):
                    held.append(row)
                    given += 1
                if len(held) >= self.rows:
                    yield self._batch(held)
                    held = []
                if given == self.most:
                    break
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in self.fields], [n for n, _ in self.fields])


class ProviderGraph(DataSource):
    """format("provider_graph"), options path (a folder of pages), table (edges or nodes), rows (of a batch), match (JSON
    of fields and the values that they equal), most (rows of a page)."""

    @classmethod
    def name(cls) -> str:
        return "provider_graph"

    def schema(self) -> str:
        return NODE if self.options.get("table", "edges") == "nodes" else EDGE

    def reader(self, schema: Any) -> GraphReader:
        get = self.options.get
        most = int(get("most")) if get("most") else None
        return GraphReader(_local(self.options["path"]), get("table", "edges"), int(get("rows", "4096")), json.loads(get("match", "{}")), most)


def matching(spark: SparkSession, path: str, table: str = "edges", limit: int | None = 200, **match: Any) -> DataFrame:
    """At most `limit` rows of a provider's table whose fields equal `match`. The provider filters, and no page is read
    beyond the limit; None reads every page, in tasks of their own. What fails (a folder without pages, a field that is none, a broken line) is raised, never an empty table."""
    if limit is not None and limit < 1:  # Spark would not even ask the provider
        raise ValueError("a limit is at least 1")
    reader = spark.read.format("provider_graph").option("path", path).option("table", table).option("match", json.dumps(match))
    return reader.load() if limit is None else reader.option("most", str(limit)).load().limit(limit)


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class LogWriter(DataSourceStreamWriter):
    """Tasks write files under names of their own into a folder that no reader looks at. A batch is committed by one
    manifest with its number, written whole and then renamed: a file counts only if the manifest names it. So what a failed
    task left, or a batch that is run again, is never read; a batch that has its manifest is not committed anew."""

    def __init__(self, folder: str, schema: Any):
        self.folder, self.names = folder, [f.name for f in schema.fields]

    def write(self, rows: Iterator[Any]) -> Staged:
        os.makedirs(os.path.join(self.folder, "parts"), exist_ok=True)
        name, n, writer, held = f"{uuid.uuid4().hex}.parquet", 0, None, []
        kinds = pa.schema([(c, _TYPES[t]) for c, t in _fields(LOGGED)])
        path = os.path.join(self.folder, "parts", name)

        def flush() -> None:
            nonlocal writer
            writer = writer or pq.ParquetWriter(path, kinds, compression="zstd")
            writer.write_table(pa.table({c: [r[c] for r in held] for c in kinds.names}, kinds))
            held.clear()

        for row in rows:
            held.append(dict(zip(self.names, row, strict=True)))
            n += 1
            if len(held) >= 8192:
                flush()
        if held:
            flush()
        if writer:
            writer.close()
        return Staged(name if n else "", n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        manifest = os.path.join(self.folder, f"batch-{batchId:012d}.json")
        if os.path.exists(manifest):
            self.abort(messages, batchId)
            return
        os.makedirs(self.folder, exist_ok=True)
        draft = f"{manifest}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump({"files": sorted(m.file for m in messages if m and m.file), "rows": sum(m.rows for m in messages if m)}, f)
            f.flush()
            os.fsync(f.fileno())
        os.rename(draft, manifest)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in messages:
            if m and m.file and os.path.exists(path := os.path.join(self.folder, "parts", m.file)):
                os.remove(path)


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        pages = []
        for name in sorted(os.listdir(self.folder)):
            if re.fullmatch(r"batch-\d+\.json", name):
                with open(os.path.join(self.folder, name)) as f:
                    pages += [Page(os.path.join(self.folder, "parts", x)) for x in json.load(f)["files"]]
        return pages or [Page("")]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        if page.path:
            yield from pq.ParquetFile(page.path).iter_batches(8192)


class EventLog(DataSource):
    """format("event_log"), option path: rows of LOGGED, to read, and for streams to append to."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return LOGGED

    def reader(self, schema: Any) -> LogReader:
        return LogReader(_local(self.options["path"]))

    def streamWriter(self, schema: Any, overwrite: bool) -> LogWriter:
        return LogWriter(_local(self.options["path"]), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderGraph)
    spark.dataSource.register(EventLog)
