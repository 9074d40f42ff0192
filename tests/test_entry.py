"""The queries with SQL against DuckDB, on the smallest tables, and the entry point."""

import os

import pytest

import __spark_entry__ as entry
from tidelog.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, tmp_path, name):
    import duckdb

    registry.QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    got, want = duckdb.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'"), duck.sql(registry.SQL[name])
    columns = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.project(columns).fetchall())) == sorted(map(repr, want.project(columns).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("limit", [None, 100])
def test_response_pages_hold_every_message(spark, limit):
    """Against a plain loop over all events; pages end in the middle of streams."""
    import pyarrow.parquet as pq

    streams = {}
    for r in sorted(pq.read_table(f"{DATA}/events.parquet", columns=["event_id", "event_type", "props"]).to_pylist(), key=lambda r: r["event_id"]):
        streams.setdefault(r["event_type"], []).append(r["props"])
    want = []
    for s, messages in streams.items():
        assert len(messages) > 20
        pages, used = [], 0
        for data in messages:
            n = len(data.encode())
            if not pages or used + n > (limit or 1 << 20):
                pages, used = [*pages, []], 0
            pages[-1].append(data)
            used += n
        first = 1
        for k, page in enumerate(pages, 1):
            want.append((s, k, first, first + len(page) - 1, "".join(page) if s == "click" else "[" + ",".join(page) + "]"))
            first += len(page)
    query = entry.queries()["response_pages"]
    got = query(spark, DATA) if limit is None else query(spark, DATA, limit)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_append_files_takes_whole_files(spark):
    import hashlib

    names = sorted(n for n in os.listdir(DATA) if n.split(".")[0] in ("nation", "region", "supplier"))
    want = [(i, f"{i:010d}", hashlib.sha256(open(f"{DATA}/{n}", "rb").read()).hexdigest()) for i, n in enumerate(names, 1)]
    assert sorted((r["idx"], r["offset"], r["sha256"]) for r in entry.queries()["append_files"](spark, DATA).collect()) == want
