"""Operators against sequential versions of themselves."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from tidelog.operators import append, read, scan, streams

def NOW():
    return F.lit(datetime(2026, 1, 1)).cast("timestamp")


def messages(spark, rows):
    df = spark.createDataFrame(rows, "stream_id string, idx long, data string")
    return df.withColumn("n_bytes", F.octet_length("data")).withColumn("offset", F.format_string("%010d", "idx"))


def test_scan_equals_fold(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r["i"]: (r["s"], r["m"]) for r in scan.before(df, "k", "i", {"s": F.col("v")}, {"m": F.col("v")}, span=16).collect()}
    for k, i, _ in rows:
        earlier = [v for kk, ii, v in rows if kk == k and ii < i]
        assert got[i] == (sum(earlier), max(earlier, default=None))


def test_sequence_gate(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, "", *(f"s{n:03d}" for n in range(60))])) for i in range(300)]
    df = spark.createDataFrame(rows, "stream_id string, arrival long, seq string")
    last = spark.createDataFrame([("a", "s005")], "stream_id string, last_seq string")
    got = {r["arrival"]: r["accepted"] for r in append.sequence_gate(df, last=last, span=32).collect()}
    top = {"a": "s005", "b": ""}
    for s, i, q in rows:
        ok = not q or not top[s] or q > top[s]
        assert got[i] == ok
        top[s] = q if ok and q else top[s]


def test_append(spark):
    st = spark.createDataFrame([("j", "application/json", None), ("t", "text/plain", None), ("x", "text/plain", datetime(2025, 1, 1))], "stream_id string, content_type string, expires_at timestamp")
    js, tx = "application/json", "text/plain"
    rows = [
        ("j", 1, js, '{"a": 1}', "s2"), ("j", 2, js, '[{"b": 1},2]', "s3"), ("j", 3, js, "[]", "s9"), ("j", 4, js, "{bad", None), ("j", 5, js, "3", "s3"), ("j", 6, js, '"x"', None),
        ("t", 7, "TEXT/plain; q=1", "hi", None), ("t", 8, js, "1", None), ("t", 9, tx, "", None), ("t", 10, tx, "x" * 200, None), ("x", 11, tx, "late", None), ("?", 12, tx, "a", None), ("t", 13, None, "a", None),
    ]
    df = spark.createDataFrame(rows, "stream_id string, arrival long, content_type string, body string, seq string")
    results, stored = append.append(df, st, NOW(), tails=spark.createDataFrame([("t", 5)], "stream_id string, tail long"), most=100)
    assert {r["arrival"]: r["status"] for r in results.collect()} == {1: "ok", 2: "ok", 3: "bad_request", 4: "bad_request", 5: "conflict", 6: "ok", 7: "ok", 8: "conflict", 9: "bad_request", 10: "payload_too_large", 11: "not_found", 12: "not_found", 13: "bad_request"}
    assert [(r["offset"], r["data"]) for r in stored.where("stream_id = 'j'").orderBy("idx").collect()] == [("0000000001", '{"a": 1}'), ("0000000002", '{"b":1}'), ("0000000003", "2"), ("0000000004", '"x"')]
    assert [r["offset"] for r in stored.where("stream_id = 't'").collect()] == ["0000000006"]


def test_append_bytes(spark):
    """Bytes that are no text are kept as they are in streams of other types, and refused in JSON streams."""
    st = spark.createDataFrame([("b", "application/octet-stream", None), ("j", "application/json", None)], "stream_id string, content_type string, expires_at timestamp")
    rows = [("b", 1, "application/octet-stream", b"\xff\x00\xfe", None), ("j", 2, "application/json", b"[\xff]", None), ("j", 3, "application/json", '["é",{"b":1, "a":2}]'.encode(), None), ("b", 4, "application/octet-stream", b"", None)]
    results, stored = append.append(spark.createDataFrame(rows, "stream_id string, arrival long, content_type string, body binary, seq string"), st, NOW())
    assert {r["arrival"]: r["status"] for r in results.collect()} == {1: "ok", 2: "bad_request", 3: "ok", 4: "bad_request"}
    assert sorted((r["stream_id"], r["idx"], bytes(r["data"])) for r in stored.collect()) == [("b", 1, b"\xff\x00\xfe"), ("j", 1, '"é"'.encode()), ("j", 2, b'{"a":2,"b":1}')]


def test_plans_are_one_pass(spark):
    """The append's messages and a catch-up read the table once, check JSON once, and shuffle it once."""
    import re

    from tidelog.plans import registry

    def parts(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return {k: len(re.findall(k, plan)) for k in ("FileScan", "ArrowEvalPython", "Exchange hashpartitioning", "Window ")}

    for name, scans, python, exchanges in (("append_messages", 2, 1, 3), ("append_status", 2, 1, 3), ("catchup_page", 1, 0, 2), ("log_offsets", 1, 0, 1)):
        got = parts(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert got["FileScan"] <= scans and got["ArrowEvalPython"] <= python and got["Exchange hashpartitioning"] <= exchanges, (name, got)


def test_page(spark):
    m = messages(spark, [("s", 1, "hello"), ("s", 2, "world"), ("s", 3, "extra")])
    take = lambda df, n: [r["data"] for r in read.page(df, n, span=2).orderBy("idx").collect()]
    assert take(m, 8) == ["hello"] and take(m, 0) == ["hello", "world", "extra"] and take(m, 1) == ["hello"] and take(m, 10) == ["hello", "world"]
    assert take(read.after(m, "0000000001"), 0) == ["world", "extra"]
    r = read.catch_up(m, "1", 5).first()
    assert (r["status"], r["next_offset"], r["tail_offset"], r["up_to_date"]) == ("ok", "0000000002", "0000000003", False)
    assert read.catch_up(m, "0000000099").first()["status"] == "gone" and read.catch_up(m, "-2").first()["status"] == "gone"
    assert read.catch_up(m, "3").first()["up_to_date"]


def test_pages_equal_fold(spark):
    rng = random.Random(3)
    rows = [(s, i, "x" * rng.randint(0, 40)) for s in "abc" for i in range(1, 200)]
    got = {(r["stream_id"], r["idx"]): r["page"] for r in read.pages(messages(spark, rows), 100).collect()}
    for s in "abc":
        page = used = 0
        for _, i, d in (r for r in rows if r[0] == s):
            if not page or used + len(d) > 100:
                page, used = page + 1, 0
            used += len(d)
            assert got[s, i] == page


def test_create_head_delete_expiry(spark):
    r = spark.createDataFrame([("s", 1, "text/plain", None, None), ("s", 2, "TEXT/plain;x", None, None), ("s", 3, "text/html", None, None), ("u", 4, "a/b", 5, None), ("u", 5, "a/b", 6, None)], "stream_id string, arrival long, content_type string, ttl_seconds long, expires_at timestamp")
    assert [x["status"] for x in streams.create(r).orderBy("arrival").collect()] == ["created", "ok", "conflict", "created", "conflict"]
    old = r.where("arrival = 1")
    assert [x["status"] for x in streams.create(r, old).orderBy("arrival").collect()] == ["ok", "ok", "conflict", "created", "conflict"]
    st = spark.createDataFrame([("s", None), ("p", datetime(2025, 1, 1)), ("f", datetime(2027, 1, 1))], "stream_id string, expires_at timestamp")
    m = messages(spark, [("s", 1, "a"), ("s", 2, "b"), ("p", 1, "c")])
    assert {x["stream_id"]: x["next_offset"] for x in streams.head(st, m, NOW()).collect()} == {"s": "0000000002", "f": "0000000000"}
    a, b = streams.delete(st, m, st.where("stream_id = 's'"))
    assert a.count() == 2 and b.count() == 1


def test_append_from_files(spark, tmp_path):
    for name, body in (("b.txt", "second"), ("a.txt", "first é"), ("c.txt", "")):
        (tmp_path / name).write_text(body, encoding="utf-8")
    df = append.from_files(spark, str(tmp_path), "s", "text/plain", seq="s1")
    st = spark.createDataFrame([("s", "text/plain", None)], "stream_id string, content_type string, expires_at timestamp")
    results, stored = append.append(df, st, NOW())
    assert [(r["offset"], bytes(r["data"]).decode()) for r in stored.orderBy("idx").collect()] == [("0000000001", "first é"), ("0000000002", "second")]
    assert sorted((r["arrival"], r["status"], r["seq"]) for r in results.collect()) == [(1, "ok", "s1"), (2, "ok", None)]


def test_large_streams_only_are_cut(spark):
    rows = [("few", i) for i in range(5)] + [("hot", i * 1000) for i in range(1000)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "stream_id string, arrival long")
    cut = {r["stream_id"]: r["_step"] for r in scan.large(df, "stream_id", "arrival", span=100).collect()}
    assert cut == {"hot": 99900}  # ten spans, though the order's values are sparse
    assert scan.large(df, "stream_id", "arrival", span=1000) is None
    for span in (100, 1000):
        got = scan.before(df, "stream_id", "arrival", {"n": F.lit(1)}, {"m": F.col("arrival")}, span=span).collect()
        assert sorted((str(r["stream_id"]), r["n"]) for r in got) == sorted((str(s), i // 1000 if s == "hot" else i) for s, i in rows)
        assert {r["arrival"]: r["m"] for r in got if r["stream_id"] == "hot"} == {i * 1000: (i - 1) * 1000 if i else None for i in range(1000)}


def test_hot_stream_is_spread(spark):
    """A window's key is (stream, span): one stream's rows go to as many groups as it has spans."""
    df = spark.range(0, 1000).select(F.lit("hot").alias("stream_id"), F.col("id").alias("arrival"))
    plan = scan.before(df, "stream_id", "arrival", {"n": F.lit(1)}, span=100)._jdf.queryExecution().toString()
    assert "windowspecdefinition(stream_id" in plan and "_span" in plan
    got = append.number(df, span=100)
    assert [r["idx"] for r in got.orderBy("arrival").collect()] == list(range(1, 1001))


def test_large_streams_stay_spread_after_they_meet_their_configuration(spark):
    """With large streams a row's way is by (stream, span), and rows of one stream are many groups; results are those of one group a stream."""
    import re

    js = "application/json"
    bodies = ['{"a": 1}', "[1,2,3]", "[]", "{bad", ""]
    rows = [("hot", i, js, bodies[i * 7 % 5], f"s{(i * 31) % 977:04d}" if i % 3 == 0 else None) for i in range(600)]
    rows += [("few", i, js, bodies[i % 5], None) for i in range(9)] + [(None, i, js, "1", None) for i in range(3)] + [("none", 1, js, "1", None)]
    df = spark.createDataFrame(rows, "stream_id string, arrival long, content_type string, body string, seq string")
    st = spark.createDataFrame([(s, js, None) for s in ("hot", "few", "idle")], "stream_id string, content_type string, expires_at timestamp")
    tails = spark.createDataFrame([("hot", 5), ("few", 7)], "stream_id string, tail long")
    last = spark.createDataFrame([("hot", "s0100")], "stream_id string, last_seq string")

    def decided(span):
        return append.decided(df, st, NOW(), tails=tails, last=last, span=span)

    columns = ["stream_id", "arrival", "status", "json", "first"]
    got, want = (sorted(map(repr, decided(span).select(*columns).collect())) for span in (50, 1000))
    assert got == want and len(got) == len(rows)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a table of streams too large for a broadcast
    try:
        out = append.decided(df, st, NOW(), span=50).select("stream_id", "arrival", "first")
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin) \[([^\]]*)\]", plan)
        assert joins and all("_span" in j for j in joins), joins  # by stream alone, a stream would be one task
        out.collect()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in final and final.count("ArrowEvalPython [strict_json") == 1  # totals and rows read one shuffle
        assert sorted(map(repr, append.decided(df, st, NOW(), tails=tails, last=last, span=50).select(*columns).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
