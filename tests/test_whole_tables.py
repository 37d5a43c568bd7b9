"""Registered queries against brute force over whole tables."""

import duckdb
import pytest

from gridloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_nearest_haversine_meets_every_customer(spark):
    place = "select {k} as k, cast({k} * 37 % 1800 as double) / 20 - 90 as lat, cast({k} * 911 % 3600 as double) / 10 - 180 as lon from '{sf}/{t}.parquet'"
    q, p = place.format(k="s_suppkey", sf=SF, t="supplier"), place.format(k="c_custkey", sf=SF, t="customer")
    metres = "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2))))"
    want = dict(duckdb.sql(f"select q.k, min({metres}) from ({q}) q, ({p}) p group by 1").fetchall())
    got = {r["s_suppkey"]: r["distance"] for r in QUERIES["nearest_haversine"](spark, SF).collect()}
    assert got == pytest.approx(want, abs=0.01)


def test_deepest_valid_level_reads_whole_profiles(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want = {v: max((k for k, x in enumerate(e) if x is not None and x > 0), default=-1) for v, e in rows}
    assert max(want.values()) > 7
    assert {r["vec_id"]: r["deepest"] for r in QUERIES["deepest_valid_level"](spark, SF).collect()} == want
