"""Resolution, cases, discovery, provenance and the online path against plain Python, with the edge cases."""

import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import anomaly, casework, discovery, graph, profiles, quality, resolution, sequences, temporal
from tracewright.streaming.pipeline import FIELDS, Pipeline

REG = "entity_id string, match_confidence double, actor_id string, actor_name string, device_id string, ip_subnet string"
REC = "k string, actor_id string, actor_name string, device_id string, ip_subnet string"


def test_resolution_against_a_registry(spark):
    reg = spark.createDataFrame([("E1", 0.97, "a1", "Torvin Belcalby", "D1", "10.0.0.0/24"), ("E2", 1.0, "a2", "Liora Kolden", "D2", "10.0.0.0/24"), ("E3", 1.0, None, None, None, None)], REG)
    rows = [("exact", "A1 ", None, None, None), ("device", "x", "Torvin Belcalbi", "d1", None), ("subnet", "y", "Someone Else", "D9", "10.0.0.0/24"), ("new", "z", None, None, None), ("blank", None, None, "UNKNOWN", "0.0.0.0/0")]
    got = {r["k"]: r for r in resolution.resolve_records(spark.createDataFrame(rows, REC), reg, "k").collect()}
    assert (got["exact"]["entity"], got["exact"]["rule"], got["exact"]["p"], got["exact"]["status"]) == ("E1", "exact_actor_id", 0.97, "CONFIRMED")
    assert got["device"]["entity"] == "E1" and got["device"]["rule"] == "device_id"
    assert got["subnet"]["status"] == "REJECTED" and got["subnet"]["candidates"] == 2 and got["subnet"]["entity"].startswith("ENT_")
    assert got["new"]["candidates"] == 0 and got["new"]["status"] == got["blank"]["status"] == "CONFIRMED" and got["new"]["entity"] != got["blank"]["entity"]
    empty = resolution.resolve_records(spark.createDataFrame(rows, REC), reg.limit(0), "k")
    assert empty.where("candidates = 0").count() == 5 and resolution.resolve_records(spark.createDataFrame([], REC), reg, "k").count() == 0
    with pytest.raises(ValueError):
        resolution.require_registry(reg.limit(0), "entity_id", "actor_id", F.col("match_confidence"))
    assert resolution.require_registry(reg.where("actor_id is not null"), "entity_id", "actor_id", F.col("match_confidence")).count() == 2


def test_integrity_of_chains(spark):
    rows = [(1, None, True), (2, 1, True), (3, 2, False), (4, 3, True), (5, 99, True), (6, 5, True), (7, 8, True), (8, 7, True)] + [(100 + i, 99 + i if i else None, True) for i in range(70)] + [(None, 1, True)]
    got = {r["node"]: r["status"] for r in graph.verified(spark.createDataFrame(rows, "id int, up int, ok boolean"), "id", "up", F.col("ok")).collect()}
    assert [got[i] for i in range(1, 9)] == ["VERIFIED", "VERIFIED", "TAMPERED", "ANCESTOR_TAMPERED", "MISSING_ANCESTOR", "MISSING_ANCESTOR", "MISSING_ANCESTOR", "MISSING_ANCESTOR"]
    assert all(got[100 + i] == "VERIFIED" for i in range(70)) and None not in got
    assert graph.verified(spark.createDataFrame([], "id int, up int, ok boolean"), "id", "up", F.col("ok")).count() == 0


def test_growing_and_bounds(spark):
    e = spark.createDataFrame([(i, i + 1, i, "r", i) for i in range(30)], "src int, dst int, t int, rel string, event_id int")
    got = graph.grown(e, spark.createDataFrame([(0,)], "id int"), 10)
    assert got.count() == 10 and got.agg(F.max("hop")).first()[0] == 9 and graph.grown(e, spark.createDataFrame([(0,)], "id int"), 1000).count() == 31
    assert graph.bounded_state(e, 40).count() == 30 and {r["t"] for r in graph.bounded_state(e, 20).collect()} == set(range(20, 30))
    assert graph.recorded_edges(e, spark.createDataFrame([(1,), (2,), (None,)], "id int")).count() == 1


def test_fusion_of_cases(spark):
    items = [("a", "BANK", 1, 0.9, 0, "r"), ("a", "CDR", 2, 0.8, 1_000_000, "r"), ("a", "CDR", 1, 0.0, 2_000_000, None), ("b", "BANK", 3, 0.9, 0, "r"), ("b", "CDR", 4, 0.1, 0, "r"), ("c", "BANK", 5, None, 0, None), ("d", "BANK", 6, 0.9, 0, "r"), (None, "BANK", 7, 0.9, 0, "r")]
    df = spark.createDataFrame(items, "entity string, domain string, event_id int, score double, t long, evidence_ref string")
    links = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9), ("d", 0.5), ("e", 1.0)], "entity string, confidence double")
    got = {r["entity"]: r for r in casework.fuse(df, links, 86400.0).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "SUPPORTED", "b": "CONFLICTED", "c": "INSUFFICIENT_EVIDENCE", "d": "IDENTITY_UNCERTAIN", "e": "INSUFFICIENT_EVIDENCE"}
    assert got["a"]["domains"] == 2 and got["a"]["supporting"] == 2 and got["d"]["score"] == 0.0 and got["e"]["domains"] == 0
    assert casework.fuse(df.limit(0), links, 1.0).count() == 5 and casework.fuse(df, links.limit(0), 1.0).count() == 0


def test_reliability_of_findings(spark):
    shape = "f string, id int, category string, cluster int, identity double, quality double, temporal double, data double, provenance double, is_future boolean, is_duplicate boolean"
    s = lambda f, i, cat="SUPPORTING", identity=0.95, future=False, dup=False: (f, i, cat, i, identity, 1.0, 1.0, 1.0, 1.0, future, dup)
    rows = [*[s("high", i) for i in range(3)], s("none", 1, identity=0.0), s("against", 1, "CONTRADICTING"), s("both", 1), s("both", 2, "CONTRADICTING"), s("one", 1), s("one", 2, future=True), s("dup", 1), s("dup", 2, "CONTRADICTING", dup=True)]
    got = {r["f"]: r["status"] for r in casework.reliability(spark.createDataFrame(rows, shape), "f").collect()}
    assert got == {"high": "HIGH", "none": "INSUFFICIENT_EVIDENCE", "against": "LOW", "both": "CONFLICTED", "one": "MEDIUM", "dup": "MEDIUM"}


def test_reliability_adds_in_the_order_of_records(spark):
    """Means that lie between two roundings come out as their sum in the records' order says, however the records are cut; those of decimals are exact."""
    rng = random.Random(8)
    to4 = lambda x: math.floor(x * 10000 + 0.5) / 10000
    rows, want = [], {}
    for f in range(60):
        tenths = [rng.randrange(7, 11) for _ in range(16)]
        tenths[0] -= sum(tenths) % 2 == 0
        total = 0.0
        for k, t in enumerate(tenths):
            total += 0.5 + (t - 5) / 10.0
            rows.append((f"f{f}", k, "SUPPORTING", k, 0.5 + (t - 5) / 10.0, Decimal("0.9") if k < 7 else Decimal("0.5"), 1.0, 1.0, 1.0, False, False, k))
        # 7 of 16 at 0.9 and 9 at 0.5 are 0.675.
        want[f"f{f}"] = to4(0.25 * to4(total / 16) + 0.15 * 1.0 + 0.15 * 0.675 + 0.2 * 1.0 + 0.1 * 1.0 + 0.15 * 1.0)
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "f string, id int, category string, cluster int, identity double, quality decimal(2,1), temporal double, data double, provenance double, is_future boolean, is_duplicate boolean, place int")
    for parts in (1, 5):
        assert {r["f"]: r["score"] for r in casework.reliability(e.repartition(parts), "f", "place").collect()} == want


def test_motifs(spark):
    rng = random.Random(2)
    part = lambda i: {"types": [rng.choice("AB") for _ in range(rng.randrange(3, 6))], "gaps": [rng.random() * 9 for _ in range(4)], "span": rng.random() * 30, "start": i, "length": 3}
    parts = [{**p, "domains": [x.lower() for x in p["types"]]} for p in map(part, range(14))]
    d = np.array([[discovery.part_distance(p, q) if i != j else 0.0 for j, q in enumerate(parts)] for i, p in enumerate(parts)])
    assert np.allclose(d, d.T)
    want = Counter(sequences.complete_linkage(d, 0.25))
    got = discovery.cluster_parts(parts, 0.25, 1)
    assert sorted(len(m) for m, _, _ in got) == sorted(want.values())
    assert all(d[i, j] <= 0.25 for m, _, _ in got for i in m for j in m)
    a, b = np.array([1.0, 2.0, 9.0]), np.array([1.0, 9.0])
    assert discovery.warp(a, b) == round(1 / 5, 4)
    day = [("u", i, 1_000_000_000 * 100 * (i // 4) + 120_000_000 * (i % 4), ["LOGIN", "QUERY", "TRANSFER", "MESSAGE"][i % 4], "BANK") for i in range(16)]
    e = spark.createDataFrame(day, "actor_id string, event_id int, t long, event_type string, source_domain string")
    subs = discovery.subsequences(e, 3, 4)
    assert subs.count() == 14 + 13 and subs.where("id = 'SUB_u_0_L3'").first()["types"] == ["LOGIN", "QUERY", "TRANSFER"]
    motifs = discovery.discover(subs)
    assert motifs.agg(F.max("members")).first()[0] >= 4 and {r["kind"] for r in motifs.collect()} == {"DISCOVERED"}
    assert discovery.discover(subs.limit(0)).count() == 0 and discovery.subsequences(e.limit(2), 3, 4).count() == 0


def test_ranking_of_real_scores(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "BUCKETS", 7)
    rng = random.Random(3)
    rows = [(rng.choice([round(rng.random(), 2), rng.random()]), int(rng.random() < 0.3)) for _ in range(400)] + [(None, 1)]
    got = anomaly.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y and s is not None], [s for s, y in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    at = lambda x: sum(s >= x for s in pos) / sum(s >= x for s in pos + neg)
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(sum(at(p) for p in pos) / len(pos))
    assert anomaly.ranking_metrics(spark.createDataFrame([(0.5, 1)] * 3, "s double, y int"), "s", "y").first()["roc_auc"] is None


def test_texts_and_profiles(spark):
    def grams(t):
        return Counter(g for w in t.lower().split() for n in (2, 3, 4) for p in [f" {w} "] for g in (p[i : i + n] for i in range(len(p) - n + 1)))

    def cosine(a, b):
        p, q = grams(a), grams(b)
        w = lambda g: 1.0 if g in p and g in q else 1 + math.log(1.5)
        dot = sum(p[g] * q[g] for g in p)
        return round(dot / math.sqrt(sum((p[g] * w(g)) ** 2 for g in p) * sum((q[g] * w(g)) ** 2 for g in q)), 4)

    pairs = [("the old mill", "the mill house"), ("abc", "xyz"), ("same", "same "), ("", "x"), (None, "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in S.ngram_cosine(df, "a", "b", "s").orderBy("i").collect()]
    assert got == [cosine(*pairs[0]), 0.0, 1.0, 0.0, 0.0]
    k = spark.createDataFrame([(0.9, 0.9, 0.9, 50), (1.0, 0.0, 0.0, 50), (0.9, 0.9, 0.9, 1), (0.0, 1.0, 1.0, 9)], "a double, b double, c double, n int").select(profiles.decide([F.col(c) for c in "abc"], F.col("n"))["class"]).collect()
    assert [r[0] for r in k] == ["HIGH", "CONFLICTED", "INSUFFICIENT_EVIDENCE", "CONFLICTED"]
    assert quality.vocabulary_rate(df, {"a": ["abc"]}).first()[0] == 0.8 and quality.hash_status(df.limit(0), "a").first()["status"] == "HEALTHY"


def test_pipeline_in_batches(spark, tmp_path):
    """Batches of any size lead to the same state; a restart goes on, and repeats of earlier batches are found."""
    rng = random.Random(7)
    rows = []
    for i in range(60):
        who = rng.choice("abcd")
        rows.append((i, f"act-{who}", f"act-{rng.choice('abcd')}", rng.choice([None, *[10_000_000 * i] * 9]), "X", rng.choice(["BANK", "CDR", "NOPE"]), rng.choice([5.0, 800.0, -1.0]), None, f"dev-{who}", None))
    rows += rows[:9]
    shape = "event_id int, actor_id string, target_id string, t long, event_type string, source_domain string, amount double, actor_name string, device_id string, ip_subnet string"
    df = spark.createDataFrame(rows, shape)
    assert tuple(df.columns) == FIELDS

    def state(name, sizes):
        p, at = Pipeline(spark, str(tmp_path / name)), 0
        for n, size in enumerate(sizes):
            part = spark.createDataFrame(rows[at : at + size], shape)
            p.process(part, n)
            if n == 0:
                p.process(part, n)  # run again after a failure
            at += size
        return p

    one, many = state("one", [69]), state("many", [20, 30, 19])
    c = one.counts().first()
    assert c == many.counts().first() and c["received"] == 69 and c["accepted"] + c["rejected"] == 69 and 0 < c["repeats"] <= 9
    key = lambda p: {(r["event_id"], r["entity"]) for r in p.events().collect()}
    assert key(one) == key(many) and one.registry().count() == many.registry().count() == len({r[1] for r in rows})
    assert {tuple(r) for r in one.live_finding().collect()} == {tuple(r) for r in many.live_finding().collect()}
    who = one.registry().first()["entity_id"]
    assert one.timeline(who).count() == many.timeline(who).count() > 0 and one.network(who).count() > 0 and one.why(who).count() <= 2
    assert {r["reason"] for r in many.dead_letters().collect()} <= {"INVALID_EVENT_TYPE", "INVALID_TIMESTAMP", "INVALID_AMOUNT"}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = Pipeline(spark, str(tmp_path / "live"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.run(stream)
    live.run(stream)
    assert key(live) == key(one)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("after", [True, False])
def test_neighbours_of_pivots(spark, inclusive, after):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for i in range(80)]
    pivots = [(k, t) for k in ("a", "b", "c") for t in (-1, 0, 5, 5, 11, 20)] + [(None, 3), ("a", None)]
    e, p = spark.createDataFrame(rows, "event_id int, actor_id string, t long"), spark.createDataFrame(pivots, "actor_id string, pivot_t long")
    got = sorted((r["actor_id"], r["pivot_t"], r["rank"], r["event_id"]) for r in temporal.previous_events(e, p, 3, inclusive=inclusive, after=after).collect())
    want = []
    for k, at in pivots:
        if k is None or at is None:
            continue
        side = [(t, i) for i, a, t in rows if a == k and t is not None and (t == at and inclusive or (t > at if after else t < at))]
        want += [(k, at, n + 1, i) for n, (_, i) in enumerate(sorted(side, reverse=not after)[:3])]
    assert got == sorted(want)
    near = sorted((r["event_id"], r["pivot_t"], r["side"]) for r in temporal.around(e, p.distinct(), 4, 2).collect())
    assert near == sorted((i, at, "PRE" if t < at else "POST") for i, a, t in rows for k, at in set(pivots) if a == k and k and t is not None and at is not None and t != at and at - 4 <= t <= at + 2)
