"""A log on shared storage: Parquet tables, and commits by compare-and-swap.

root/data/<name>    messages of one commit: stream_id, epoch, idx, offset, data (bytes), n_bytes
root/state/<name>   a row for each stream that the commit changed: configuration, tail, last_seq, epoch, version
root/results/<name> what a batch was decided to be: its rows with their status and first index; it goes when nobody holds its answers
root/commits/<n>    JSON: the commit's tables; created only if no other writer was faster

A writer reads the newest state, computes, writes its tables under new names and then
creates the next commit. If that exists by then, it waits a little and begins again, until
its time is up; readers never see the tables of a writer that lost or died. What a batch is
decided to be is written once; its messages, state and answers are all made from that.

Commits never change, so each is read once by a process. Every FULL commits the state of
all streams is written whole; between, only what changed. `compact` writes all live
messages as one table in order of stream and index, and readers begin there.

Commits are decided by creating a name that must not exist. On HDFS that is atomic for any
writers; on a local disk for the threads of one process; object stores that let a rename
overwrite are not safe for several writers.
"""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.functions import media, offsets
from tidelog.operators import append as appending
from tidelog.operators import read as reading

STATE = "stream_id string, content_type string, ttl_seconds long, expires_at timestamp, tail long, last_seq string, epoch long, version long"
DATA = "stream_id string, epoch long, idx long, offset string, data binary, n_bytes int"
APPENDS = "stream_id string, arrival long, content_type string, body binary, seq string"
FULL = 16


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def raw(body: str | bytes | None) -> bytes:
    return body.encode("utf-8", "surrogateescape") if isinstance(body, str) else bytes(body or b"")


def shown(content_type: str, data: bytes) -> str | bytes:
    """A message as a client sees it: text of JSON and text streams (bytes that aren't UTF-8 as surrogate escapes), bytes of others."""
    kind = content_type.split(";")[0].strip().lower()
    return bytes(data).decode("utf-8", "surrogateescape") if kind == media.JSON or kind.startswith("text/") else bytes(data)


class Answers:
    """The rows of a batch as they were decided: stream_id, arrival, status, first, n.

    They stay in storage and are read as they are gone through, a part at a time, so a
    batch of any size takes no more of the driver than another. Their table goes after
    close(), or with the store's next write once nobody holds them.
    """

    def __init__(self, rows: DataFrame, drop: Callable):
        self.rows, self._drop = rows, drop

    def __len__(self) -> int:
        return self.rows.count()

    def __iter__(self) -> Iterator[Row]:
        yield from self.rows.toLocalIterator()  # a generator: it holds the answers until it ends

    def collect(self) -> list[Row]:
        """All at once; for batches that came from the driver."""
        return self.rows.collect()

    def close(self) -> None:
        self._drop()


class LogStore:
    """`now` gives the time as a column; tests set it. patience: seconds in which a writer tries to commit."""

    def __init__(self, spark: SparkSession, root: str, now: Callable = F.current_timestamp, patience: float = 120.0):
        self.spark, self.root, self.now, self.patience = spark, root.rstrip("/"), now, patience
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))
        self._known: list[dict] = []
        self._given: dict[str, weakref.ref] = {}
        self._lock, self._turn, self._waiting = threading.Lock(), threading.Lock(), []

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    # commits

    def version(self) -> int:
        return len(self.commits())

    def commits(self) -> list[dict]:
        """All commits, from the first on; those read before are not opened again."""
        with self._lock:
            while self._fs.exists(place := self._path("commits", f"{len(self._known) + 1:010d}")):
                stream = self._fs.open(place)
                self._known.append(json.loads(bytes(stream.readAllBytes()).decode()))
                stream.close()
            return list(self._known)

    def _commit(self, n: int, content: dict) -> bool:
        """Whether commit n is ours: it is written aside and renamed, which fails if it exists."""
        aside, place = self._path("commits", f"_{uuid.uuid4().hex}"), self._path("commits", f"{n:010d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(content | {"version": n}).encode()))
        out.close()
        done = False
        try:
            with _COMMITTING:  # the threads of this process; between processes the file system decides
                done = not self._fs.exists(place) and self._fs.rename(aside, place)
        finally:
            if not done:
                self._fs.delete(aside, False)
        return bool(done)

    def state(self, upto: int | None = None) -> DataFrame:
        """The newest row of each stream."""
        done = self.commits()[:upto]
        full = max((i for i, c in enumerate(done) if c.get("full")), default=0)
        paths = [f"{self.root}/state/{c['state']}" for c in done[full:] if c.get("state")]
        if not paths:
            return self.spark.createDataFrame([], STATE)
        rows = self.spark.read.schema(STATE).parquet(*paths)
        newest = rows.groupBy("stream_id").agg(F.max_by(F.struct(*names(STATE)[1:]), "version").alias("s"))
        return newest.select("stream_id", "s.*")

    def _data(self, done: list[dict]) -> list[str]:
        last = max((i for i, c in enumerate(done) if c.get("compacted")), default=0)
        return [f"{self.root}/data/{c['data']}" for c in done[last:] if c.get("data")]

    def messages(self) -> DataFrame:
        """All messages of streams as they live now."""
        done = self.commits()
        paths = self._data(done)
        rows = self.spark.read.schema(DATA).parquet(*paths) if paths else self.spark.createDataFrame([], DATA)
        return rows.join(self.state(len(done)).select("stream_id", "epoch"), ["stream_id", "epoch"]).drop("epoch")

    def _drop(self, name: str) -> None:
        with self._lock:
            self._given.pop(name, None)
        place = self._path("results", name)
        self._fs.delete(place, True)
        self._fs.cancelDeleteOnExit(place)

    def _give(self, rows: DataFrame, name: str) -> Answers:
        """The answers in a results table, which is dropped when they are closed or held no more, or else with the session."""
        out = Answers(rows, lambda: self._drop(name))
        self._fs.deleteOnExit(self._path("results", name))
        with self._lock:
            self._given[name] = weakref.ref(out)
        return out

    def _write(self, compute: Callable, tag: str | None = None):
        """compute(state, name) -> (changed state or None, messages or None, more of the commit, answer()); committed once, also if several writers try."""
        with self._lock:
            held_no_more = [name for name, held in self._given.items() if held() is None]
        for name in held_no_more:
            self._drop(name)
        end, k = time.monotonic() + self.patience, 0
        while True:
            done = self.commits()
            if tag is not None and any(c.get("tag") == tag for c in done):
                return None
            n, name = len(done) + 1, uuid.uuid4().hex
            state = self.state(len(done))
            changed, data, content, answer = compute(state, name)
            results = content.pop("results", None)
            content = content | {"tag": tag}
            if data is not None:
                data.select(*names(DATA)).write.parquet(f"{self.root}/data/{name}")
                content["data"] = name
            if changed is not None:
                changed = changed.withColumn("version", F.lit(n).cast("long")).select(*names(STATE))
                if n % FULL == 0:
                    changed = changed.unionByName(state.join(changed.select("stream_id"), "stream_id", "left_anti").select(*names(STATE)))
                    content["full"] = True
                changed.write.parquet(f"{self.root}/state/{name}")
                content["state"] = name
            won = self._commit(n, content)
            if won:
                return answer()
            if results:
                self._drop(results)
            if time.monotonic() > end:
                raise errors.Conflict("other writers were faster until the time was up")
            time.sleep(random.uniform(0, min(2.0, 0.05 * 2**k)))
            k += 1

    # operations

    def _row(self, stream_id: str, alive: bool = True):
        row = self.state().where(F.col("stream_id") == stream_id).withColumn("_alive", F.col("expires_at").isNull() | (self.now() <= F.col("expires_at"))).first()
        return row if row and row["epoch"] >= 0 and (row["_alive"] or not alive) else None

    def create(self, stream_id: str, content_type: str | None = None, ttl_seconds: int | None = None, expires_at=None, body: str | bytes | None = None) -> bool:
        """True if created - with the body, in one commit, or not at all -, False if it was there with the same configuration."""
        content_type = content_type or media.DEFAULT

        def same(old) -> bool:
            return old["content_type"].split(";")[0].strip().lower() == content_type.split(";")[0].strip().lower() and old["ttl_seconds"] == (ttl_seconds or None) and old["expires_at"] == expires_at

        def compute(state: DataFrame, name: str):
            old = state.where(F.col("stream_id") == stream_id).first()
            if old and old["epoch"] >= 0:
                if not same(old):
                    raise errors.Conflict(stream_id)
                raise _Exists
            new = self.spark.createDataFrame([(stream_id, content_type, ttl_seconds or None, expires_at, 0, None, -old["epoch"] if old else 0, 0)], STATE)
            if not raw(body):
                return new, None, {}, lambda: True
            first = self.spark.createDataFrame([(stream_id, 1, content_type, raw(body), None)], APPENDS)
            changed, data, content, answer = self._appended(first, new, name)
            answers = answer()
            errors.raise_for(answers.collect()[0]["status"], stream_id)

            def created() -> bool:
                answers.close()
                return True

            return changed, data, content, created

        try:
            return self._write(compute)
        except _Exists:
            return False

    def _appended(self, appends: DataFrame, live: DataFrame, name: str):
        """Decides a batch, writes what it was decided to be, and makes all else from that."""
        moment = self.spark.range(1).select(self.now().alias("t")).first()["t"]
        rows = appends.select("stream_id", "arrival", "content_type", F.col("body").cast("binary").alias("body"), "seq")
        rows = appending.decided(rows, live, F.lit(moment), tails=live.select("stream_id", "tail"), last=live.select("stream_id", "last_seq"))
        rows.write.parquet(f"{self.root}/results/{name}")
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/results/{name}")
        data = appending.stored(rows).join(live.select("stream_id", "epoch"), "stream_id")
        tops = rows.where("status = 'ok'").groupBy("stream_id").agg(F.max(F.col("first") + F.col("n")).alias("_tail"), F.max(F.nullif(F.col("seq"), F.lit(""))).alias("_seq"))
        changed = live.join(tops, "stream_id").withColumns({"tail": F.col("_tail"), "last_seq": F.greatest("_seq", "last_seq")}).drop("_tail", "_seq")
        return changed, data, {"results": name}, lambda: self._give(rows.select("stream_id", "arrival", "status", "first", "n"), name)

    def append(self, appends: DataFrame, tag: str | None = None) -> Answers | None:
        """Appends a batch (stream_id, arrival, content_type, body, seq) and gives its rows with status, as stored; None if tag was committed before."""
        return self._write(lambda state, name: self._appended(appends, state.where("epoch >= 0"), name), tag)

    def append_one(self, stream_id: str, body: str | bytes, content_type: str | None = None, seq: str | None = None) -> str:
        """The offset after the body; raises what is wrong with it.

        Threads that append at once share commits: one of them appends what all have
        handed in by then, in that order, and the others find their answers.
        """
        one: dict = {"stream_id": stream_id, "body": raw(body), "content_type": content_type, "seq": seq}
        with self._lock:
            self._waiting.append(one)
        with self._turn:
            if "answer" not in one:
                with self._lock:
                    batch, self._waiting = self._waiting, []
                self._append_all(batch)
        if isinstance(one["answer"], Exception):
            raise one["answer"]
        errors.raise_for(one["answer"]["status"], stream_id)
        return f"{one['answer']['first'] + one['answer']['n']:010d}"

    def _append_all(self, batch: list[dict]) -> None:
        try:
            kinds = {}
            if any(not x["content_type"] for x in batch):
                ids = sorted({x["stream_id"] for x in batch})
                kinds = {r["stream_id"]: r["content_type"] for r in self.state().where(F.col("stream_id").isin(ids)).select("stream_id", "content_type").collect()}
            rows = [(x["stream_id"], i, x["content_type"] or kinds.get(x["stream_id"], media.DEFAULT), x["body"], x["seq"]) for i, x in enumerate(batch)]
            answers = self.append(self.spark.createDataFrame(rows, APPENDS))
            for r in answers.collect():
                batch[r["arrival"]]["answer"] = r
            answers.close()
        except Exception as e:
            for x in batch:
                x.setdefault("answer", e)

    def read(self, stream_id: str, offset: str | None = None, limit: int = 0) -> dict:
        """messages (offset, data), next_offset and tail_offset.

        Every message has a byte at least, so a page of `limit` bytes ends within as many
        messages: the scan is bounded by index on both sides.
        """
        row = self._row(stream_id)
        if not row:
            raise errors.NotFound(stream_id)
        try:
            at = reading.parse(offset)
        except ValueError as e:
            raise errors.BadRequest(str(e)) from None
        if not 0 <= at <= row["tail"]:
            raise errors.Gone(offset)
        got = []
        if at < row["tail"]:
            bounds = (F.col("idx") > at) & (F.col("idx") <= (at + limit if limit > 0 else row["tail"]))
            got = reading.page(self.messages().where((F.col("stream_id") == stream_id) & bounds), limit).orderBy("idx").select("idx", "offset", "data").collect()  # a page, or a whole stream if no limit is asked for
        last = got[-1]["idx"] if got else at
        return {"messages": [(r["offset"], shown(row["content_type"], r["data"])) for r in got], "next_offset": f"{last:010d}", "tail_offset": f"{row['tail']:010d}", "content_type": row["content_type"], "up_to_date": last == row["tail"]}

    def head(self, stream_id: str) -> dict:
        row = self._row(stream_id)
        if not row:
            raise errors.NotFound(stream_id)
        return {"content_type": row["content_type"], "ttl_seconds": row["ttl_seconds"], "expires_at": row["expires_at"], "next_offset": f"{row['tail']:010d}"}

    def delete(self, stream_id: str) -> None:
        """Ends the stream's life, expired or not; a new one begins at offset 1."""

        def compute(state: DataFrame, name: str):
            row = state.where((F.col("stream_id") == stream_id) & (F.col("epoch") >= 0))
            if not row.take(1):
                raise errors.NotFound(stream_id)
            # epoch -(e + 1) keeps the number of lives
            return row.withColumns({"epoch": -(F.col("epoch") + 1), "last_seq": F.lit(None).cast("string"), "tail": F.lit(0).cast("long")}), None, {}, lambda: None

        self._write(compute)

    def compact(self) -> None:
        """Writes the live messages as one table, sorted by stream and index, where readers begin from now on."""

        def compute(state: DataFrame, name: str):
            rows = self.messages().join(state.select("stream_id", "epoch"), "stream_id")
            return None, rows.repartitionByRange("stream_id", "idx").sortWithinPartitions("stream_id", "idx"), {"compacted": True}, lambda: None

        self._write(compute)

    def sink(self, name: str) -> Callable:
        """For foreachBatch: each micro-batch is appended once, also after a restart."""

        def once(df: DataFrame, batch_id: int) -> None:
            answers = self.append(df, tag=f"{name}:{batch_id}")
            if answers is not None:
                answers.close()

        return once

    def absorb(self) -> int:
        """Appends what df.write and df.writeStream of the data source have handed in, each batch once and in order; how many there were."""
        folder, n = self._path("inbox", "ready"), 0
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        for name in found:
            stream = self._fs.open(self._path("inbox", "ready", name))
            files = json.loads(bytes(stream.readAllBytes()).decode())
            stream.close()
            if files:
                answers = self.append(reduce(DataFrame.union, [self.spark.read.schema(APPENDS).parquet(*files)]), tag=f"inbox:{name}")
                if answers is not None:
                    answers.close()
                    n += 1
            self._fs.delete(self._path("inbox", "ready", name), False)
        return n

    def tails(self) -> DataFrame:
        return self.state().where("epoch >= 0").select("stream_id", offsets.to_offset(F.col("tail")).alias("next_offset"))


class _Exists(Exception):
    pass


_COMMITTING = threading.Lock()
