"""The log as a Spark data source: read, readStream, write and writeStream of format("tidelog").

Reading. Options: path (the store's root), stream_id (optional), startingOffset (earliest,
latest or an offset; a stream's later messages follow by themselves). Files of a commit are
read by executors, a partition each, as Arrow batches; stream and offset are filters of the
Parquet scan. Only messages of streams as they live are given: those of a deleted stream, or
of an earlier life of one, are not - in a batch as of its start, in a stream as of each
micro-batch, whose progress is the number of the commit. `latest` in a batch gives no rows:
nothing follows the tail.

Writing: rows (stream_id, arrival, content_type, body, seq) go to the store's inbox, a file
a task; a batch becomes visible there at once when all tasks are done. LogStore.absorb
appends the inbox's batches, each once: a micro-batch that is written again replaces itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "stream_id string, epoch long, idx long, offset string, data binary, n_bytes int"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
APPENDS = pa.schema([("stream_id", pa.string()), ("arrival", pa.int64()), ("content_type", pa.string()), ("body", pa.binary()), ("seq", pa.string())])


class _File(InputPartition):
    """A data file, and the state tables that say which lives of streams last."""

    def __init__(self, path: str, state: list[str]):
        self.path, self.state = path, state


def _open(options: dict) -> tuple[fs.FileSystem, str]:
    root = options["path"].rstrip("/")
    return fs.FileSystem.from_uri(root if ":/" in root else f"file://{root}")


class _Log:
    def __init__(self, options: dict):
        self.store, self.root = _open(options)
        self.stream_id, start = options.get("stream_id"), options.get("startingOffset", options.get("startingoffset", "earliest"))
        self.latest = start == "latest"
        from tidelog.operators.read import parse

        self.after = 0 if self.latest else parse(start)

    def version(self) -> int:
        found = self.store.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return max((int(x.base_name) for x in found if x.base_name.isdigit()), default=0)

    def commits(self, high: int) -> list[dict]:
        out = []
        for n in range(1, high + 1):
            with self.store.open_input_stream(f"{self.root}/commits/{n:010d}") as f:
                out.append(json.loads(f.read()))
        return out

    def _parts(self, folder: str) -> list[str]:
        return [x.path for x in self.store.get_file_info(fs.FileSelector(f"{self.root}/{folder}")) if x.path.endswith(".parquet")]

    def files(self, low: int, high: int, batch: bool = False) -> list[_File]:
        """Files of the commits after low up to high, with the state as of high. A batch begins at the last compaction; a stream has seen what that holds."""
        done = self.commits(high)
        full = max((i for i, c in enumerate(done) if c.get("full")), default=0)
        state = [p for c in done[full:] if c.get("state") for p in self._parts(f"state/{c['state']}")]
        if batch:
            low = max((i for i, c in enumerate(done) if c.get("compacted")), default=low)
        names = [c["data"] for c in done[low:] if c.get("data") and (batch or not c.get("compacted"))]
        return [_File(p, state) for name in names for p in self._parts(f"data/{name}")]

    def rows(self, part: _File) -> Iterator[pa.RecordBatch]:
        wanted = pc.field("idx") > self.after
        if self.stream_id is not None:
            wanted &= pc.field("stream_id") == self.stream_id
        for batch in ds.dataset(part.path, filesystem=self.store, format="parquet").to_batches(columns=NAMES, filter=wanted, batch_size=8192):
            if not batch.num_rows:
                continue
            # Of the streams in the batch, the newest state rows: at most as many as it has rows.
            ids = pc.unique(batch.column("stream_id"))
            state = ds.dataset(part.state, filesystem=self.store, format="parquet").to_table(columns=["stream_id", "epoch", "version"], filter=pc.field("stream_id").isin(ids))
            newest = {}
            for s, e, v in sorted(zip(*(state.column(k).to_pylist() for k in range(3))), key=lambda r: r[2]):
                newest[s] = e
            live = pa.array([newest.get(s) == e for s, e in zip(batch.column("stream_id").to_pylist(), batch.column("epoch").to_pylist())], pa.bool_())
            yield batch.filter(live)


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        log = _Log(self.options)
        return ([] if log.latest else log.files(0, log.version(), batch=True)) or [_File("", [])]

    def read(self, partition):
        if partition.path:
            yield from _Log(self.options).rows(partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        log = _Log(self.options)
        return {"version": log.version() if log.latest else 0}

    def latestOffset(self) -> dict:
        return {"version": _Log(self.options).version()}

    def partitions(self, start: dict, end: dict):
        return _Log(self.options).files(start["version"], end["version"]) or [_File("", [])]

    def read(self, partition):
        if partition.path:
            yield from _Log(self.options).rows(partition)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Inbox:
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _open(self.options)
        store.create_dir(f"{root}/inbox/data", recursive=True)
        path, out = f"{root}/inbox/data/{uuid.uuid4().hex}.parquet", None
        for batch in iterator:
            if batch.num_rows:
                out = out or pq.ParquetWriter(path, APPENDS, filesystem=store)
                out.write_table(pa.Table.from_batches([batch]).select(APPENDS.names).cast(APPENDS))
        if out:
            out.close()
        return _Written(path if out else "")

    def _ready(self, name: str, messages: list) -> None:
        """The batch's files, listed under its name in one step."""
        store, root = _open(self.options)
        store.create_dir(f"{root}/inbox/ready", recursive=True)
        aside = f"{root}/inbox/{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(json.dumps([m.path for m in messages if m and m.path]).encode())
        store.move(aside, f"{root}/inbox/ready/{name}")

    def _dropped(self, messages: list) -> None:
        store, _ = _open(self.options)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class LogWriter(_Inbox, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        import time

        self._ready(f"batch-{time.time_ns():020d}-{uuid.uuid4().hex}", messages)

    def abort(self, messages: list) -> None:
        self._dropped(messages)


class LogStreamWriter(_Inbox, DataSourceStreamArrowWriter):
    """The option `name` tells the streams that write to one store apart."""

    def commit(self, messages: list, batchId: int) -> None:
        self._ready(f"stream-{self.options.get('name', '')}-{batchId:020d}", messages)

    def abort(self, messages: list, batchId: int) -> None:
        self._dropped(messages)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(LogSource)
