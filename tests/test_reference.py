"""Every query with SQL against DuckDB on the smallest data, and pieces that SQL cannot express against plain Python."""

import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import oracle
from tracewright.functions import scalars as S
from tracewright.operators import anomaly, fusion, graph, linkage, quality, sequences, temporal, validate
from tracewright.streaming import runtime

D = "/root/testdata/sf0.001"
Q, O = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", sorted(O))
def test_query_matches_sql(spark, con, name):
    assert oracle.differences(Q[name](spark, D), con, O[name]) == ""


def test_every_sql_has_a_query():
    assert set(O) <= set(Q)


def test_jaro_winkler():
    assert S.jaro_winkler_value("MARTHA", "marhta ") == pytest.approx(0.9611, abs=1e-4)
    assert S.jaro_winkler_value("", "x") == 0 and S.jaro_winkler_value(None, None) == 0 and S.jaro_winkler_value("abcd", "axyz") == pytest.approx(0.5 + 0.1 * 0.5)


def test_jaro_winkler_of_batches():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(12)))
    a, b = [word() for _ in range(3000)] + [None, "x" * 100, "ab"], [word() for _ in range(3000)] + ["q", "x" * 99 + "y", "ab"]
    assert S.jaro_winkler_batch(a, b) == pytest.approx([S.jaro_winkler_value(p, q) for p, q in zip(a, b, strict=True)])
    assert len(S.jaro_winkler_batch([], [])) == 0


def test_token_distance_of_many_tokens(spark):
    """Any number of distinct tokens, nulls among them."""
    a, b = [f"t{i}" for i in range(2500)], [f"t{i}" for i in range(2200)]
    df = spark.createDataFrame([(a, b), (["x", None], ["x"]), ([], ["x", "y"]), (["k", "m"], ["m", "k"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(S.token_levenshtein(F.col("a"), F.col("b"))).collect()] == [300, 1, 2, 2]


def test_json_and_text_scalars(spark):
    df = spark.createDataFrame([('{"a": 1}', "90s"), ("nope", "7d"), (None, "x"), ("", None)], "j string, l string")
    got = df.select(S.json_or_raw(F.col("j")), S.duration_seconds(F.col("l")), S.json_number(F.col("j"), "$.b", "$.a")).collect()
    assert [tuple(r) for r in got] == [('{"a": 1}', 90, 1.0), ('{"raw":"nope"}', 604800, None), ("{}", None, None), ("{}", None, None)]
    got = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "x array<string>").select(S.bigrams(F.col("x")), F.size(S.slices(F.col("x"), 2, 3))).collect()
    assert got[0][0] == ["a>b", "b>c"] and got[0][1] == 3 and got[1][0] == [] and got[1][1] == 0
    grams = spark.createDataFrame([("ab",)], "s string").select(S.char_ngrams(F.col("s"))).first()[0]
    assert sorted(grams) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])


def test_uuid5(spark):
    import uuid

    assert spark.createDataFrame([("x",)], "s string").select(S.uuid5(F.col("s"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "x"))


def test_observable(spark):
    df = spark.createDataFrame([(1, 2)], "a int, Label int")
    assert validate.observable(df).columns == ["a"]
    with pytest.raises(ValueError):
        validate.observable(df, strict=True)


def test_clusters_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(up)}
    got = {r["id"]: r["component"] for r in linkage.clusters(spark.createDataFrame(edges + [(None, 3)], "left_id int, right_id int")).collect()}
    assert got == want


def test_large_block_stays_connected(spark):
    df = spark.createDataFrame([(i, "k") for i in range(30)], "id int, k string")
    pairs = linkage.candidate_pairs(df, {"k": F.col("k")}, "id")
    assert pairs.count() == 435 and linkage.clusters(pairs).select("component").distinct().count() == 1


def test_no_pair_of_a_large_block_is_lost(spark):
    df = spark.createDataFrame([(i, "k" if i < 30 else f"s{i // 2}") for i in range(40)], "id int, block string")
    want = sorted((a, b) for a in range(40) for b in range(a + 1, 40) if b < 30 or (a >= 30 and a // 2 == b // 2))
    for cell in (4, 10, 100):
        assert sorted((r["left_id"], r["right_id"]) for r in linkage.pairs_within(df, "block", cell).collect()) == want


def test_hot_subnet_keeps_clusters(spark, tmp_path):
    """Two people with one device each behind a subnet of all records, none of them its least id."""
    row = lambda i: (f"r{i:05d}", f"{hashlib.md5(str(i).encode()).hexdigest()}" if i < 700 else ("anna okoro", "bertil lund")[i // 2 % 2], f"dev{i}" if i < 700 else f"twin{i // 2}", "10.0.0.0/24", "x")
    spark.createDataFrame([row(i) for i in range(704)], "raw_id string, actor_name string, device_id string, ip_subnet string, home_city string").write.parquet(f"{tmp_path}/raw_identity.parquet")
    from tracewright.queries import reference

    scored = reference._scored(spark, str(tmp_path))
    assert {tuple(r) for r in scored.where("p >= 0.6").select("left_id", "right_id").collect()} == {("r00700", "r00701"), ("r00702", "r00703")}


def test_agreement_em(spark):
    rng = random.Random(4)
    rows = [tuple(int(rng.random() < (0.9 if m else 0.1)) for _ in range(3)) for m in (rng.random() < 0.3 for _ in range(3000))]
    m, p = linkage.fit_agreement(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"])
    assert abs(p - 0.3) < 0.06 and all(abs(v[0] - 0.9) < 0.06 and abs(v[1] - 0.1) < 0.06 for v in m.values())


def test_ancestors_and_cycle(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "c int, p int")
    got = {(r["node"], r["ancestor"], r["depth"]) for r in graph.ancestors(links, "c", "p").collect()}
    assert {(4, 1, 3), (4, 2, 2), (2, 1, 1), (8, 8, 2)} <= got


def test_ancestors_of_long_chains(spark):
    links = [(i + 1, i) for i in range(100)] + [(100, 40), (200, 201), (201, 202), (202, 200)]
    up = {}
    for c, p in links:
        up.setdefault(c, []).append(p)
    want = {}
    for n in up:
        k, now = 1, set(up[n])
        while now:
            for a in now:
                want.setdefault((n, a), k)
            k, now = k + 1, {q for a in now for q in up.get(a, ()) if (n, q) not in want}
    got = [(r["node"], r["ancestor"], r["depth"]) for r in graph.ancestors(spark.createDataFrame(links, "c int, p int"), "c", "p").collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_closure_covers_all_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "parent_doc_id", "revision_no").collect()
    up = {r["doc_id"]: r["parent_doc_id"] for r in docs}
    want = set()
    for n in up:
        a, k = up[n], 1
        while a is not None:
            want.add((n, a, k))
            a, k = up.get(a), k + 1
    assert {tuple(r) for r in Q["gr18_lineage"](spark, D).collect()} == want and max(k for *_, k in want) > 2


def test_masses_follow_the_fold(spark):
    def python(ms):
        a, n, t, c = 0.0, 0.0, 1.0, 0.0
        for x, y, z in ms:
            k = a * y + n * x
            c = min(1.0, c + k)
            if k > 1 - 1e-12:
                a, n, t = 0.5, 0.5, 0.0
            else:
                a, n, t = (a * x + a * z + t * x) / (1 - k), (n * y + n * z + t * y) / (1 - k), t * z / (1 - k)
        return a, n, t, c

    for scores in ([0.9, 0.1, None], [1.0, 0.0], [], [None]):
        ms = [(0.0, 0.0, 1.0) if s is None else (0.8 * s, 0.8 * (1 - s), 0.2) for s in scores]
        arr = F.array(*[fusion.mass(F.lit(s).cast("double")) for s in scores]) if scores else F.array().cast("array<struct<a:double,n:double,t:double>>")
        got = spark.range(1).select(fusion.combine_masses(arr).alias("m")).first()["m"]
        assert tuple(got) == pytest.approx(python(ms))


def test_dtw_and_linkage():
    a = np.array([[0.0], [1.0], [2.0]])
    assert sequences.dtw(a, a) == (0.0, 3)
    assert sequences.dtw(a, np.array([[0.0], [0.0], [1.0], [2.0]]))[0] == 0.0
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]])
    assert sequences.complete_linkage(d, 0.25) == [0, 0, 1]
    x = np.sin(np.arange(60) / 3)
    assert sequences.series_motif(x, 10)[0] < 0.2


def test_isolation_forest_finds_the_outlier():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 2)), [[9, 9]]])
    assert anomaly.IsolationForest(x).score(x).argmax() == 300


def test_single_class_metrics(spark):
    r = anomaly.ranking_metrics(spark.createDataFrame([(0.4, 1), (0.9, 1)], "s double, y int"), "s", "y").first()
    assert r["roc_auc"] is None and r["recall"] == 0.5


def test_future_violations_and_windows(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (2, None), (3, None)], "t long, seq int")
    assert temporal.future_violations(e, 2, "t", "seq", 2).count() == 2
    with pytest.raises(ValueError):
        temporal.between(e, 5, 1)
    with pytest.raises(ValueError):
        temporal.require_observed_time("SEQUENCE_ORDER_SURROGATE")


def test_quality_levels(spark):
    s = spark.createDataFrame([("a", "HEALTHY"), ("b", "DEGRADED")], "d string, status string")
    assert quality.overall(s).first()[0] == "DEGRADED" and quality.overall(s.limit(0)).first()[0] == "UNKNOWN"
    assert quality.schema_gaps(s, ["d", "x"]) == ["x"]


def test_adaptive_tracker():
    t = runtime.AdaptiveTracker()
    said = [t.observe(x)[1] for x in [10, 11, 9, 10, 10, 10.2, 50, 60, 10.1]]
    drift = runtime.AdaptiveTracker(n=5, mean=10.0, var=1.0)
    assert [drift.observe(x)[1] for x in (12.0, 10.3, 12.4, 10.8, 12.6, 9.0)] == ["STABLE", "STABLE", "ADAPTING", "STABLE", "STABLE", "ADAPTING"]
    assert said[:5] == ["COLD_START"] * 5 and said[6:8] == ["EXCLUDED", "QUARANTINED"] and said[5] == said[8] == "STABLE" and t.mean < 11


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), 1_000_000_000 * (i // 4) - rng.choice([0, 0, 0, 100_000_000, 900_000_000, 3_000_000_000])) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, k string, t long")
    for part in range(3):
        df.where((F.col("event_id") >= part * 20) & (F.col("event_id") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {r["event_id"]: r["ordering"] for r in temporal.arrival_status(df, "k", "t", ["event_id"]).collect()}
    files = sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)
    for i, f in enumerate(files):
        os.utime(f, (1e9 + i, 1e9 + i))
    stream = runtime.event_stream(spark, str(tmp_path / "in"), df.schema)
    runtime.drain(runtime.arrival_status_stream(stream, "k", "t", "event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["event_id"]: r["ordering"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and "LATE_EVENT_FLAGGED" in got.values()


def test_stream_deduplicates_across_batches(spark, tmp_path):
    for _ in range(2):
        spark.createDataFrame([(1, "x"), (2, "y")], "n int, p string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = runtime.event_stream(spark, str(tmp_path / "in"), "n int, p string")
    runtime.drain(runtime.once_per_payload(s, S.pipe_hash(F.col("n"), F.col("p"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_robust_z_guards(spark):
    r = spark.range(1).select(S.robust_z(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)), S.score_from_z(F.lit(0.0)), S.score_from_z(F.lit(2.0))).first()
    assert r[0] == pytest.approx(1e4) and r[1] == 0.05 and r[2] == pytest.approx(2 / (1 + math.exp(-1)) - 1)


def _long_users(spark, tmp_path):
    """Two users whose thirty events differ in the twenty-fifth only from the first's (type) and in the fifth (amount)."""
    import datetime

    at = datetime.datetime(2026, 1, 1)
    rows = [(u * 100 + i, u, at + datetime.timedelta(hours=i), "error" if u == 2 and i == 24 else "click", 500.0 if u == 2 and i == 4 else 100.0, "{}") for u in (1, 2) for i in range(30)]
    like = spark.read.parquet(f"{D}/events.parquet").schema
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string")
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.fields]).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_whole_sequences_are_compared(spark, tmp_path):
    d = _long_users(spark, tmp_path)
    assert [tuple(r) for r in Q["str2_token_distances"](spark, d).collect()] == [(1, 1)]
    got = Q["seq5_warping"](spark, d).collect()
    assert len(got) == 1 and got[0]["dtw"] > 0


def test_hub_counts_as_shared_counterparty(spark):
    """A hub of more than max_degree ends counts in every pair, also in those that share nothing else."""
    links = [(i, 0) for i in range(1, 31)] + [(1, 50), (2, 50), (7, 51), (9, 51)]
    edges = spark.createDataFrame(links, "src int, dst int")
    got = {(r["a"], r["b"]): r["shared"] for r in graph.shared_counterparties(edges, 10).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert got == {(a, b): n for a in near for b in near if a < b and (n := len(near[a] & near[b]))} and got[1, 2] == 2


def test_pairs_by_shared_counterparties(spark):
    """Hubs, light neighbours, nodes with equal hubs, and pairs that share both kinds, for several bounds between the kinds."""
    rng = random.Random(5)
    links = [(f"u{i}", "hub") for i in range(40)] + [(f"u{i}", f"h{j}") for i in range(25) for j in range(6) if rng.random() < 0.5] + [(f"u{rng.randrange(60)}", f"u{rng.randrange(60)}") for _ in range(150)] + [("u1", None)]
    edges = spark.createDataFrame(links, "src string, dst string")
    near = {}
    for a, b in links:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = Counter(n for a in near for b in near if a < b and (n := len(near[a] & near[b])))
    for light in (0, 3, 8, 1000):
        assert {r["shared"]: r["n_pairs"] for r in graph.shared_counts(edges, light).collect()} == want
    assert graph.shared_counts(edges.limit(0)).count() == 0


def test_block_counts():
    """Both ways to count, small strips, rows for several nodes and moved pairs, against sets."""
    rng = random.Random(6)

    def side(rows):
        hubs = [sorted({rng.choice([1, 2, rng.randrange(3, 400)]) for _ in range(rng.randrange(1, 12))}) for _ in range(rows)]
        return hubs, (np.array([i for i, h in enumerate(hubs) for _ in h]), np.array([x for h in hubs for x in h]), np.array([rng.randrange(1, 4) for _ in hubs]))

    (a, left), (b, right) = side(150), side(70)
    for other, right_, same in ((b, right, False), (a, left, True)):
        want = Counter()
        for i, x in enumerate(a):
            for j, y in enumerate(other):
                if not same or i <= j:
                    n = int(left[2][i])
                    want[len(set(x) & set(y))] += n * (n - 1) // 2 if same and i == j else n * int(right_[2][j])
        want[len(set(a[3]) & set(other[5]))] -= 2
        want[len(set(a[3]) & set(other[5])) + 9] += 2
        for cells in (50, 3000, 10**6):
            got = graph.block_counts(left, right_, same, tuple(np.array([v]) for v in (3, 5, 9, 2)), cells)
            assert {i: int(n) for i, n in enumerate(got) if n} == {i: n for i, n in want.items() if n}


def test_hub_of_many_users_is_counted_without_its_pairs(spark, tmp_path):
    """60,000 users of one target are 1.8 billion pairs, too many to be written or sent."""
    e = spark.range(60_000).select(F.col("id").alias("event_id"), (F.col("id") + 10).alias("user_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    again = e.where("event_id < 3").withColumn("props", F.lit('{"k": 2}'))
    e.unionByName(again).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["shared"]: r["n_pairs"] for r in Q["jn15_shared_counterparties"](spark, str(tmp_path)).collect()}
    assert got == {1: 60_000 * 59_999 // 2 - 3, 2: 3, 3: 1}  # the targets share three users
