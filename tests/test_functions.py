"""Tables of expected values for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.functions import events, media, offsets, payload, requests
from tidelog.operators import read


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r) for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").drop("i").collect()]


def test_offset_order(spark):
    cases = [("0000000007", "0000000007", 0), ("0000000007", "0000000008", -1), ("0000000010", "0000000009", 1), ("7", "12", 1), ("q", "", 1), ("log", "logs", -1), ("Z", "a", -1), ("é", "z", 1), ("x.1", "x-1", 1)]
    got = values(spark, [c[:2] for c in cases], "a string, b string", o=offsets.compare(F.col("a"), F.col("b")))
    assert [x[0] for x in got] == [c[2] for c in cases]


def test_offset_parse_and_format(spark):
    cases = [("", 0), ("-1", 0), ("0000000123", 123), ("123", 123), ("invalid", None), ("12abc", 12), ("-2", -2)]
    got = values(spark, [c[0] for c in cases], "o string", n=offsets.to_index(F.col("o")))
    assert [x[0] for x in got] == [c[1] for c in cases]
    assert [x[0] for x in values(spark, [0, 1, 9999999999, 12345678901], "n long", o=offsets.to_offset(F.col("n")))] == ["0000000000", "0000000001", "9999999999", "12345678901"]
    with pytest.raises(ValueError):
        read.parse("invalid")


def test_media(spark):
    c = F.col("c")
    got = values(spark, ["application/json", "Application/JSON; charset=utf-8", "text/plain", "TEXT/html;x", "image/png", "application/jsonl"], "c string", j=media.is_json(c), s=media.event_stream_able(c), f=media.framing(c))
    assert got == [(True, True, "json"), (True, True, "json"), (False, True, "text"), (False, True, "text"), (False, False, "binary"), (False, False, "binary")]


def test_json_flatten(spark):
    cases = [
        ('{"id": 7, "ok": false}', ['{"id": 7, "ok": false}']), ("-0.5", ["-0.5"]), ('"naïve"', ['"naïve"']), ("false", ["false"]), ('\t"x"\n', ['\t"x"\n']),
        ('[ {"z":1, "a":[2]} , {} ]', ['{"a":[2],"z":1}', "{}"]), ('[null,"",0,[],{"k":null}]', ["null", '""', "0", "[]", '{"k":null}']), ("[[],[[8]]]", ["[]", "[[8]]"]),
    ]
    got = values(spark, [c[0] for c in cases], "b string", s=payload.json_status(F.col("b")), m=payload.elements(F.col("b")))
    assert got == [("ok", c[1]) for c in cases]
    bad = values(spark, ["[]", " [ ] ", "{invalid", '{"key":', "", "[1] x", "NaN", "[Infinity]"], "b string", s=payload.json_status(F.col("b")))
    assert [x[0] for x in bad] == ["bad_request"] * 8


def test_raw_elements(spark):
    got = values(spark, ["", '  [  ]  ', '[ {"a": 1} ,2]', '{"a":1}', "[1,]", "[1] 2"], "b string", e=payload.raw_elements(F.col("b")))
    assert [x[0] for x in got] == [[], [], ['{"a": 1}', "2"], None, None, None]


def test_wrap_and_join(spark):
    df = spark.createDataFrame([("s", 2, "2"), ("s", 1, "1"), ("s", 10, "3")], "stream_id string, idx long, data string")
    r = df.groupBy("stream_id").agg(payload.wrapped(F.col("data"), F.col("idx")).alias("w"), payload.joined(F.col("data"), F.col("idx")).alias("j")).first()
    assert (r["w"], r["j"]) == ("[1,2,3]", "123")


def test_requests(spark):
    assert [x[0] for x in values(spark, ["", "0", "+5", "007", "x", "-3", "3600"], "t string", v=requests.ttl_seconds(F.col("t")))] == [None, 0, None, None, None, None, 3600]
    got = values(spark, ["2026-01-15T12:00:00Z", "2026-01-15", "not-a-timestamp"], "t string", v=requests.expires_at(F.col("t")).isNull())
    assert [x[0] for x in got] == [False, True, True]
    ok = values(spark, [(["1", "2"], []), ([""], []), (["123,456"], []), (["1"], ["invalid"]), (["1"], ["sse"]), ([], []), ([], ["sse"])], "o array<string>, l array<string>", s=requests.read_status(F.col("o"), F.col("l")))
    assert [x[0] for x in ok] == ["bad_request"] * 4 + ["ok", "ok", "bad_request"]


def test_events(spark):
    frame = values(spark, [("a\nb", "0000000001")], "d string, o string", f=events.encode(F.col("d"), F.lit(False), F.col("o"), F.lit("abc")))[0][0]
    assert frame == 'event: data\ndata: a\ndata: b\n\nevent: control\ndata: {"streamNextOffset":"0000000001","streamCursor":"abc"}\n\n'
    got = events.decode(frame + ": comment\n\ndata: no type\n\n")
    assert [(x["type"], x["data"]) for x in got][:1] == [("data", "a\nb")] and len(got) == 2
    assert got[1]["next_offset"] == "0000000001" and got[1]["cursor"] == "abc"
    assert events.decode("event: control\n\n")[0]["data"] == "{}"


def test_errors():
    assert errors.status_of("gone") == 410 and errors.status_of("?") == 500 and errors.code_of(413) == "payload_too_large"
    assert isinstance(errors.from_transport("NOT_FOUND"), errors.NotFound) and isinstance(errors.from_transport("bad_request"), errors.BadRequest)
    assert type(errors.from_transport("RATE_LIMITED", 429)) is errors.TransportError
    assert [errors.retryable(s) for s in (500, 503, 429, 404, 400)] == [True, True, True, False, False]
    assert [errors.client_code(s) for s in (401, 403, 418)] == ["UNAUTHORIZED", "FORBIDDEN", "UNKNOWN"]
