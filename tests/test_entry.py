"""The driver contract: every query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.QUERIES, entry.ORACLES
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return int(v) if isinstance(v, bool) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    result = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:3] == ["term", "place", "id"]


def test_rate_cap_against_one_by_one(spark):
    """x03: the cap of the stream, counted push by push."""
    got = {r.id: r.decision for r in QUERIES["x03_stream_rate_cap"](spark, SF).collect()}
    hour, sent, want = datetime.timedelta(hours=1), {}, {}
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "ts", "value").collect()
    for e in sorted(events, key=lambda e: (e.ts, -int(e.value), str(e.event_id))):
        recent = [s for s in sent.get(e.user_id, []) if e.ts - s < hour]
        want[str(e.event_id)] = "interrupt" if len(recent) < 3 else "digest"
        sent[e.user_id] = recent + [e.ts] * (len(recent) < 3)
    assert got == want
