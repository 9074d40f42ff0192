"""The store, the data source, streaming and the clients, end to end."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.sources import datasource
from tidelog.sources.http import HttpTransport, serve
from tidelog.sources.store import LogStore
from tidelog.streaming import middleware as mw
from tidelog.streaming import stateful
from tidelog.streaming.client import EVENTS, Client, LocalTransport

def NOW():
    return F.lit(datetime(2026, 1, 1)).cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "log"), now=NOW)


def test_life_of_a_stream(spark, store):
    assert store.create("s", "text/plain") and not store.create("s", "TEXT/PLAIN; x=1")
    with pytest.raises(errors.Conflict):
        store.create("s", "text/html")
    assert store.append_one("s", "hello", seq="s2") == "0000000001"
    assert store.append_one("s", " world") == "0000000002"
    with pytest.raises(errors.Conflict):
        store.append_one("s", "x", seq="s1")
    with pytest.raises(errors.BadRequest):
        store.append_one("s", "")
    with pytest.raises(errors.NotFound):
        store.append_one("t", "x")
    assert [d for _, d in store.read("s", "")["messages"]] == ["hello", " world"]
    assert [d for _, d in store.read("s", "-1", 6)["messages"]] == ["hello"]
    for offset, kind in (("0000000099", errors.Gone), ("-2", errors.Gone), ("invalid", errors.BadRequest)):
        with pytest.raises(kind):
            store.read("s", offset)
    again = LogStore(spark, store.root, now=NOW)
    assert again.head("s")["next_offset"] == "0000000002"
    store.delete("s")
    with pytest.raises(errors.NotFound):
        store.head("s")
    assert store.create("s", "application/json") and store.append_one("s", "[1,2]", seq="s1") == "0000000002"
    assert [d for _, d in store.read("s")["messages"]] == ["1", "2"]
    assert store.create("old", "text/plain", expires_at=datetime(2025, 1, 1))
    with pytest.raises(errors.NotFound):
        store.head("old")
    store.delete("old")


def test_batches_and_source(spark, store):
    datasource.register(spark)
    store.create("a", "text/plain")
    rows = spark.createDataFrame([("a", i, "text/plain", f"m{i}", None) for i in range(1, 6)], "stream_id string, arrival long, content_type string, body string, seq string")
    assert len(store.append(rows, tag="b1")) == 5 and store.append(rows, tag="b1") is None
    got = spark.read.format("tidelog").option("path", store.root).option("startingOffset", "0000000002").load()
    assert sorted(bytes(r["data"]) for r in got.collect()) == [b"m3", b"m4", b"m5"]
    stream = spark.readStream.format("tidelog").option("path", store.root).load()
    q = stream.writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tail").count() == 5


def source(spark, store, **options):
    datasource.register(spark)
    return sorted((r["stream_id"], r["epoch"], r["idx"], bytes(r["data"])) for r in spark.read.format("tidelog").option("path", store.root).options(**options).load().collect())


def test_source_gives_streams_as_they_live(spark, store):
    store.create("s", "text/plain", body="dead1")
    store.append_one("s", "dead2")
    store.create("t", "text/plain", body="t1")
    store.delete("s")
    assert source(spark, store) == [("t", 0, 1, b"t1")]
    store.create("s", "text/plain")
    assert store.append_one("s", "live1") == "0000000001"
    assert source(spark, store) == [("s", 1, 1, b"live1"), ("t", 0, 1, b"t1")] == sorted((r["stream_id"], 1 if r["stream_id"] == "s" else 0, r["idx"], bytes(r["data"])) for r in store.messages().collect())
    assert source(spark, store, stream_id="s") == [("s", 1, 1, b"live1")]
    assert source(spark, store, startingOffset="latest") == [] and source(spark, store, startingOffset="0000000001") == []
    store.compact()
    assert source(spark, store) == [("s", 1, 1, b"live1"), ("t", 0, 1, b"t1")]
    assert store.append_one("t", "t2") == "0000000002" and source(spark, store, startingOffset="1") == [("t", 0, 2, b"t2")]
    stream = spark.readStream.format("tidelog").option("path", store.root).load()
    q = stream.writeStream.format("memory").queryName("lives").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["stream_id"], r["idx"], bytes(r["data"])) for r in spark.table("lives").collect()) == [("s", 1, b"live1"), ("t", 1, b"t1"), ("t", 2, b"t2")]


def test_create_with_a_body_is_one_step(store):
    with pytest.raises(errors.BadRequest):
        store.create("j", "application/json", body="{bad")
    with pytest.raises(errors.NotFound):
        store.head("j")
    assert store.version() == 0
    assert store.create("j", "application/json", body="[1,2]") and store.head("j")["next_offset"] == "0000000002" and store.version() == 1
    assert not store.create("j", "application/json", body="3") and store.head("j")["next_offset"] == "0000000002"


def test_bytes(store):
    store.create("b")
    body = bytes(range(256))
    assert store.append_one("b", body) == "0000000001"
    assert store.read("b")["messages"] == [("0000000001", body)]
    store.create("t", "text/plain", body=b"\xff ok")
    (_, text), = store.read("t")["messages"]
    assert text.encode("utf-8", "surrogateescape") == b"\xff ok"


def test_many_writers(spark, store):
    """Ten threads, and a second store on the same folder: nothing is lost, refused or numbered twice."""
    store.create("s", "text/plain")
    other, offsets, wrong = LogStore(spark, store.root, now=NOW), [], []

    def work(k):
        try:
            for i in range(5):
                offsets.append((other if k == 0 else store).append_one("s", f"{k}-{i}"))
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not wrong and sorted(offsets) == [f"{i:010d}" for i in range(1, 51)]
    assert store.head("s")["next_offset"] == "0000000050"
    got = [d for _, d in store.read("s")["messages"]]
    assert sorted(got) == sorted(f"{k}-{i}" for k in range(10) for i in range(5))
    assert all([d for d in got if d.startswith(f"{k}-")] == [f"{k}-{i}" for i in range(5)] for k in range(10))
    assert any(c.get("full") for c in store.commits()) or len(store.commits()) < 16


def test_sink(spark, store, tmp_path):
    """df.write and df.writeStream hand batches in; absorb appends each once."""
    datasource.register(spark)
    store.create("a", "text/plain")
    schema = "stream_id string, arrival long, content_type string, body binary, seq string"
    rows = spark.createDataFrame([("a", i, "text/plain", f"m{i}".encode(), None) for i in range(1, 6)], schema)
    rows.repartition(3).write.format("tidelog").option("path", store.root).mode("append").save()
    assert store.head("a")["next_offset"] == "0000000000"
    assert store.absorb() == 1 and store.absorb() == 0
    assert [d for _, d in store.read("a")["messages"]] == ["m1", "m2", "m3", "m4", "m5"]
    rows.where("arrival <= 2").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("tidelog").option("path", store.root).option("name", "q").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert store.absorb() == 1 and store.head("a")["next_offset"] == "0000000007"
    inbox = datasource.LogStreamWriter({"path": store.root, "name": "q"})
    inbox.commit([inbox.write(iter(rows.toArrow().to_batches()))], 0)  # the batch once more, after a restart
    assert store.absorb() == 0 and store.head("a")["next_offset"] == "0000000007"


def test_append_files(spark, store, tmp_path):
    from tidelog.operators import append

    for name, body in (("b", b"\x00\xff"), ("a", b"first"), ("c", b"")):
        (tmp_path / name).write_bytes(body)
    store.create("f")
    assert {r["status"] for r in store.append(append.from_files(spark, str(tmp_path / "[abc]"), "f", "application/octet-stream", seq="s1"))} == {"ok"}
    assert [d for _, d in store.read("f")["messages"]] == [b"first", b"\x00\xff"]


def test_stateful_equals_batch(spark, tmp_path):
    from tidelog.operators import append

    rows = [(s, i, f"b{i}", f"s{(i * 37) % 20:02d}" if i % 2 else None) for i, s in enumerate("aabbaababaabbbab" * 3)]
    df = spark.createDataFrame(rows, "stream_id string, arrival long, body string, seq string")
    df.write.parquet(str(tmp_path / "in"))
    q = stateful.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("st").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["arrival"]: r["idx"] for r in spark.table("st").collect()}
    gated = append.sequence_gate(df).where("accepted")
    want = {r["arrival"]: r["idx"] for r in append.number(gated).collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and len(got) == len(rows)


def test_client_over_http(store):
    server = serve(LocalTransport(store, poll=0.05), max_append=100, long_poll=0.3, close_after=1.0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        http = HttpTransport(f"http://127.0.0.1:{server.server_address[1]}")
        recorder = mw.Recorder(http)
        client = Client(recorder)
        assert client.create("/s", content_type="application/json") and not client.create("/s", content_type="application/json")
        w = client.writer("/s")
        assert w.send_json({"n": 1}) == "0000000001" and w.send('[{"n":2},{"n":3}]') == "0000000003"
        r = client.reader("/s")
        assert list(r.messages(until_tail=True)) == ['{"n":1}', '{"n":2}', '{"n":3}']
        assert r.read().messages == [] and r.offset == "0000000003"  # a long poll without data keeps the offset
        w.send_json(4)
        assert r.read().messages == ["4"]
        r.seek("0000000003")
        assert r.read().decoded() == [4]
        e = client.reader("/s", mode=EVENTS)
        e.seek("0000000002")
        assert e.read().messages == ['{"n":3}', "4"]
        e.live = True
        e.seek_tail()
        assert e.read().messages == []
        r.close()
        r.close()
        with pytest.raises(errors.Closed):
            r.read()
        with pytest.raises(errors.Conflict):
            http.append("/s", "x", "text/plain")
        with pytest.raises(errors.BadRequest):
            http.append("/s", "{bad", "application/json")
        with pytest.raises(errors.TransportError) as too_large:
            http.append("/s", '"' + "x" * 200 + '"', "application/json")
        assert too_large.value.status == 413
        for query in ("offset=1&offset=2", "offset=", "offset=1,2", "offset=1&live=x", "live=sse"):
            with pytest.raises(errors.BadRequest):
                http._call("GET", "/s", query)
        with pytest.raises(errors.NotFound):
            http.read("/none")
        client.delete("/s")
        with pytest.raises(errors.NotFound):
            client.head("/s")
        assert recorder.count("append") == 3 and recorder.count() > 8
    finally:
        server.shutdown()


def test_http_bodies(store):
    """Bytes, chunked bodies, raw JSON, Location, and a create that fails as a whole."""
    import http.client

    server = serve(LocalTransport(store, poll=0.05), max_append=1000, long_poll=0.3)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host, port = server.server_address[:2]
    try:
        t = HttpTransport(f"http://{host}:{port}")
        c = http.client.HTTPConnection(host, port)

        def ask(method, path, body=None, headers=None, **k):
            c.request(method, path, body, headers or {}, **k)
            r = c.getresponse()
            return r.status, dict(r.headers), r.read()

        status, headers, _ = ask("PUT", "/new", b"\xff\x00", {"Content-Type": "application/octet-stream"})
        assert status == 201 and headers["Location"] == f"http://{host}:{port}/new" and headers["Stream-Next-Offset"] == "0000000001"
        assert ask("PUT", "/new")[0] == 200
        assert ask("POST", "/new", iter([b"ab", b"c\xfe"]), {"Content-Type": "application/octet-stream"}, encode_chunked=True)[0] == 204
        assert t.read("/new").messages == [b"\xff\x00abc\xfe"]
        assert ask("POST", "/new", iter([b"x" * 600] * 2), {"Content-Type": "application/octet-stream"}, encode_chunked=True)[0] == 413
        c.close()
        assert ask("PUT", "/j", b"{bad", {"Content-Type": "application/json"})[0] == 400 and ask("HEAD", "/j")[0] == 404
        assert t.create("/j", "application/json", body='{"é": 1.50}')
        t.append("/j", "1e3", "application/json")
        assert t.read("/j").messages == ['{"é": 1.50}', "1e3"]  # as they are written
    finally:
        server.shutdown()


def test_stubs():
    from tidelog.streaming.client import Chunk, Reader

    events = mw.StubEvents(Chunk(["a"], "1", True), errors.NotFound("s"))
    t = mw.Stub(head={"content_type": "text/plain", "next_offset": "0"}, events=events, append=["1", errors.Conflict("s")], read=lambda s, offset=None: Chunk([s], "1", True))
    assert t.read("s").messages == ["s"] and t.append("s", "x") == "1"
    for _ in range(2):
        with pytest.raises(errors.Conflict):
            t.append("s", "x")
    with pytest.raises(errors.NotImplementedYet):
        t.delete("s")
    with pytest.raises(TypeError):
        mw.Stub(nothing=1)
    r = Reader(t, "s", mode=EVENTS)
    r.seek_tail()
    assert r.read().messages == ["a"]
    with pytest.raises(errors.NotFound):
        r.read()
    events.put(Chunk(["b"], "2", True))
    events.close()
    assert [x.messages for x in events] == [["b"]]


class Flaky:
    def __init__(self, *errors_):
        self.left, self.calls = list(errors_), 0

    def read(self, *_):
        self.calls += 1
        if self.left:
            raise self.left.pop(0)
        return "ok"


@pytest.mark.parametrize("faults,retries,calls,fails", [([], 3, 1, False), ([500, 503], 3, 3, False), ([500] * 9, 2, 3, True), ([404], 3, 1, True), ([429], 3, 2, False)])
def test_retry(faults, retries, calls, fails):
    inner, waits = Flaky(*(errors.from_transport(errors.client_code(s), s) for s in faults)), []
    t = mw.chain(mw.logged(), mw.retrying(mw.Backoff(retries=retries), sleep=waits.append))(inner)
    if fails:
        with pytest.raises(errors.LogError):
            t.read("s")
    else:
        assert t.read("s") == "ok"
    assert inner.calls == calls and waits == [0.1, 0.2, 0.4][: calls - 1]


def test_chain_order():
    seen = []
    tag = lambda n: lambda inner: mw.Wrapped(inner, lambda name, go, _: (seen.append(n), go())[1])
    mw.chain(tag("a"), tag("b"), tag("c"))(Flaky()).read("s")
    assert seen == ["a", "b", "c"] and mw.Backoff(most=1.0).wait(9) == 1.0


def test_answers_of_a_batch_stay_in_storage(spark, store, monkeypatch):
    """An append takes no row of its batch to the driver; answers come part by part, and their table goes when nobody holds them."""
    import gc
    import os

    from pyspark.sql import DataFrame

    store.create("s", "text/plain")
    rows = spark.range(1, 5001, numPartitions=8).selectExpr("'s' AS stream_id", "id AS arrival", "'text/plain' AS content_type", "concat('m', id) AS body", "CAST(NULL AS string) AS seq")
    taken, collect = [], DataFrame.collect

    def counting(df):
        out = collect(df)
        taken.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counting)
    answers = store.append(rows)
    store.sink("k")(rows, 0)
    assert sum(taken) < 100
    monkeypatch.undo()
    kept = os.listdir(f"{store.root}/results")
    assert len(kept) == 1 and len(answers) == 5000
    assert [(r["status"], r["first"], r["n"]) for r in sorted(answers, key=lambda r: r["arrival"])] == [("ok", i, 1) for i in range(5000)]
    assert {r["status"] for r in store.append(rows.where("arrival < 3"))} == {"ok"}
    del answers
    gc.collect()
    store.append_one("s", "x")
    assert os.listdir(f"{store.root}/results") == [] and store.head("s")["next_offset"] == "0000010003"
