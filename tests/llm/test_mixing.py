"""Mixing: shares, caps, spread and the edge cases."""

import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing as M


def test_shares_and_caps(spark):
    rows = [(i, "big", 50 + i % 100) for i in range(3000)] + [(10_000 + i, "small", 80 + i % 40) for i in range(60)] + [(20_000, "other", 5), (20_001, None, 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 4), ("absent", 0.05, 9), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    rates = M.plan(sizes, targets)
    r = {x["source"]: x for x in rates.collect()}
    assert r["absent"]["rate"] == 0 and max(r["small"]["rate"] / 4, r["big"]["rate"]) == pytest.approx(1.0)
    drawn = M.draw(sizes, rates)
    got = {x["source"]: x for x in drawn.groupBy("source").agg(F.sum("copies").alias("c"), F.max("copies").alias("m"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert set(got) == {"big", "small"} and got["small"]["m"] <= 4 and got["big"]["m"] <= 1
    for s, n in (("big", 3000), ("small", 60)):
        assert abs(got[s]["c"] - n * r[s]["rate"]) <= 1
    assert got["small"]["t"] / got["big"]["t"] == pytest.approx(0.15 / 0.8, rel=0.02)
    again = M.draw(sizes, M.plan(sizes, targets))
    assert {tuple(x) for x in drawn.collect()} == {tuple(x) for x in again.collect()}


def test_total_and_empty(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "a", 0), (2, "a", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    assert M.plan(sizes, targets, total=1e9).first()["rate"] == 2.0
    assert M.plan(sizes, targets, total=5.0).first()["rate"] == 0.5
    assert M.draw(sizes.limit(0), M.plan(sizes.limit(0), targets)).count() == 0
    assert M.draw(sizes, M.plan(sizes, targets.limit(0))).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, "a", ""), (4, "a", "x " * 50_000)], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in M.count_tokens(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000
    chosen, shares = M.mix(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert shares.first()["actual_share"] == 1.0 and chosen.count() == 4
