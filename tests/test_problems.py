"""The general training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import normalize as N
from tracewright.operators import cdc, dedupe, feature_table, nested


# ---- 1: messages delivered more than once ----


@pytest.mark.parametrize("hot_share", [1 / 1000, 0.0])
def test_first_delivery_kept(spark, hot_share):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", f"s{i}", None]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, id string, is_first double")
    got = {r["n"]: r["is_first"] for r in dedupe.mark_first(df, F.col("id"), [F.col("n")], hot_share=hot_share).collect()}
    seen = set()
    for n, k, _ in rows:
        assert got[n] == (k is None or k not in seen)
        seen.add(k)


def test_dedupe_stored_and_new_with_other_columns(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "n int, id string")
    new = spark.createDataFrame([(3, "x", "new"), (4, "z", "new")], "n int, id string, extra string")
    kept = dedupe.deduplicate(old, F.col("id"), [F.col("n")], new)
    assert sorted((r["n"], r["extra"]) for r in kept.collect()) == [(1, None), (2, None), (4, "new")]


def test_dedupe_ties_and_equal_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "x", "a")] * 5 + [(1, "x", "b")] * 2, "n int, id string, v string")
    assert dedupe.deduplicate(df, F.col("id"), [F.col("n")]).count() == 1
    assert dedupe.repeated_deliveries(df, F.col("id"), [F.col("n")]).count() == 6


def test_dedupe_empty(spark):
    df = spark.createDataFrame([], "n int, id string")
    assert dedupe.mark_first(df, F.col("id"), [F.col("n")]).count() == 0


def test_uuid_and_instants(spark):
    u = "0a95dd49-55ff-4e99-a358-e9b6826f9d3c"
    forms = [u, u.upper(), f"{{{u}}}", f"urn:uuid:{u}", u.replace("-", ""), f" {u} "]
    got = spark.createDataFrame([(f,) for f in [*forms, "no uuid ", "", None]], "s string").select(N.canonical_uuid(F.col("s"))).collect()
    assert [r[0] for r in got] == [u] * 6 + ["no uuid", None, None]
    times = ["2026-01-05T18:02:08.590000+00:00", "2026-01-05T23:32:08.590+05:30", "2026-01-05T14:02:08.590-0400", "2026-01-05 18:02:08.590", "2026-01-05T18:02:08.590Z", "1767636128590"]
    got = spark.createDataFrame([(f,) for f in [*times, "soon", None]], "s string").select(N.instant_millis(F.col("s"))).collect()
    assert [r[0] for r in got] == [1767636128590] * 6 + [None, None]


# ---- 3: nested records ----

REC = "struct<id string, row_key string, ctx struct<n int, items array<struct<k string, subs array<struct<v string>>>>>>"


def flat(df, carry=()):
    rec, kind = nested.merged_record(df, "m", "j")
    return nested.flatten(df, ["key"], rec, kind, "r", carry)


def test_flatten_typed_and_json(spark):
    item = lambda k, *vs: {"k": k, "subs": [{"v": v} if v else None for v in vs]}
    rows = [
        ("a", {"id": "1", "row_key": "x", "ctx": {"n": 2, "items": [item("p", "u", None, "w"), None, item("q")]}}, None),
        ("b", None, '{"id": 7, "ctx": {"n": "3", "items": {"k": "r", "subs": {"v": "z"}}, "new": true}}'),
        ("c", None, '{"ctx": {"items": [null, {"k": "s"}]}}'),
        ("d", None, "not json"),
        ("e", None, None),
        ("f", {"id": "9", "row_key": None, "ctx": None}, None),
    ]
    df = spark.createDataFrame(rows, f"key string, m {REC}, j string")
    t = flat(df, ["id", "k"])
    root = {r["key"]: r for r in t["r"].collect()}
    assert len(root) == 6 and root["a"]["n_ctx_items"] == 2 and root["a"]["ctx_n"] == 2 and root["b"]["ctx_n"] == 3 and root["b"]["id"] == "7" and root["b"]["ctx_new"] is True
    assert root["a"]["row_key_"] == "x" and root["e"]["n_ctx_items"] == 0 and root["d"]["id"] is None
    items = sorted((r["key"], r["ordinal"], r["k"], r["n_subs"]) for r in t["r.ctx_items"].collect())
    assert items == [("a", 0, "p", 2), ("a", 2, "q", 0), ("b", 0, "r", 1), ("c", 1, "s", 0)]
    subs = sorted((r["key"], r["k"], r["ordinal"], r["v"], r["parent_key"]) for r in t["r.ctx_items.subs"].collect())
    assert [s[:4] for s in subs] == [("a", "p", 0, "u"), ("a", "p", 2, "w"), ("b", "r", 0, "z")]
    keys = {r["row_key"] for r in t["r.ctx_items"].collect()}
    assert all(s[4] in keys for s in subs)


def test_flatten_empty_and_json_only(spark):
    df = spark.createDataFrame([], f"key string, m {REC}, j string")
    assert all(x.count() == 0 for x in flat(df).values())
    df = spark.createDataFrame([("a", '{"xs": [{"y": 1}]}'), ("b", '{"xs": {"y": 2}}'), ("c", '{"xs": "text"}')], "key string, j string")
    rec, kind = nested.merged_record(df.where("key <> 'c'"), None, "j")
    t = nested.flatten(df.where("key <> 'c'"), ["key"], rec, kind)
    assert sorted((r["key"], r["y"]) for r in t["root.xs"].collect()) == [("a", 1), ("b", 2)]


def test_merge_types():
    s = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
    a, b = s(x=T.IntegerType(), y=T.ArrayType(s(p=T.StringType()))), s(x=T.DoubleType(), y=s(q=T.LongType()), z=T.StringType())
    m = nested.merge_types(a, b)
    assert m.simpleString() == "struct<x:double,y:array<struct<p:string,q:bigint>>,z:string>"


# ---- 4: feature table ----


def test_features_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        e = rng.choice(["hub", "hub", None, *[f"e{k}" for k in range(20)]])
        rows.append((rng.choice([None, *[f"id{k}" for k in range(400)]]), e, rng.choice(["A", "B", None, *[f"T{k}" for k in range(9)]]), rng.choice(["x", "y"]), rng.choice([None, rng.randrange(1000)]), rng.choice([None, rng.randrange(-50, 50)])))
    rows += rows[:100]
    df = spark.createDataFrame(rows, "event_id string, ent string, typ string, dom string, at long, cents long")
    want = {}
    once = {}
    for k, r in enumerate(rows):
        if r[1] is None or r[2] is None:
            continue
        key = r[0] if r[0] is not None else ("row", k)
        # The least by (entity, type, domain, time, amount), nulls first.
        rank = tuple((x is not None, x if x is not None else 0) for x in r[1:])
        if key not in once or rank < once[key][0]:
            once[key] = (rank, r)
    for _, r in once.values():
        c = want.setdefault(r[1:4], [0, None, 0])
        c[0] += 1
        c[1] = r[4] if c[1] is None else c[1] if r[4] is None else max(c[1], r[4])
        c[2] += r[5] or 0
    entities = spark.createDataFrame([("hub",), ("silent",), (None,)], "ent string")
    whole = feature_table.feature_blocks(df, "ent", ["typ", "dom"], "event_id", "at", "cents", entities, 3)
    names = [r["ent"] for r in whole.collect()]
    assert len(names) == len(set(names)) and "silent" in names and None not in names
    got = {(r["ent"], r["typ"], r["dom"]): [r["n_events"], r["last_at"], r["total"]] for r in feature_table.long_features(whole, "ent").collect()}
    assert got == want
    wide = {r["ent"]: r for r in feature_table.wide_features(whole, "ent", ["A", "none"], "typ").collect()}
    assert wide["hub"]["A_n_events"] == sum(v[0] for k, v in want.items() if k[:2] == ("hub", "A")) and wide["silent"]["A_total"] == 0 and wide["hub"]["none_n_events"] == 0 and wide["hub"]["none_last_at"] is None


def test_features_empty(spark):
    df = spark.createDataFrame([], "event_id string, ent string, typ string, at long, cents long")
    assert feature_table.feature_blocks(df, "ent", ["typ"], "event_id", "at", "cents", df.select("ent")).count() == 0


def test_times_and_amounts(spark):
    r = spark.createDataFrame([(1767571200.5, None), (1767571200500.0, None), (None, dt.datetime(2026, 1, 5)), (float("nan"), dt.datetime(2026, 1, 5)), (None, None)], "e double, t timestamp").select(F.floor(N.epoch_seconds(F.col("e"), F.col("t")))).collect()
    assert [x[0] for x in r] == [1767571200] * 4 + [None]
    r = spark.createDataFrame([(x,) for x in (1.005, -2.5, None, float("nan"), float("inf"))], "a double").select(N.cents(F.col("a"))).collect()
    assert [x[0] for x in r][1:] == [-250, 0, 0, 0]


# ---- 5: change feeds ----


def fold(changes):
    """Changes of one key in order: (op, {field: value})."""
    state = None
    for op, vals in changes:
        if op == "D":
            state = None
        else:
            state = {} if op == "R" or state is None else state
            state.update({k: v for k, v in vals.items() if v is not None})
    return state


def test_changes_against_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["k1", "k1", "k2", "k3", None]), i, rng.choice(["U", "U", "R", "D", None]), rng.choice([None, f"a{i}"]), rng.choice([None, f"b{i}"])) for i in range(120)]
    want = {}
    for k in {r[0] for r in rows}:
        s = fold([(r[2] or "U", {"a": r[3], "b": r[4]}) for r in rows if r[0] == k])
        if s is not None:
            want[k] = (s.get("a"), s.get("b"))
    shuffled = rows + rows[:40]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "k string, s int, op string, a string, b string")
    got = {r["k"]: (r["a"], r["b"]) for r in cdc.apply_changes(df, ["k"], ["a", "b"], "s").collect()}
    assert got == want


def test_changes_empty(spark):
    df = spark.createDataFrame([], "k string, s int, op string, a string")
    assert cdc.apply_changes(df, ["k"], ["a"], "s").count() == 0


@pytest.mark.parametrize("first", [True, False])
def test_simultaneous_changes_are_chained(spark, first):
    h = 3_600_000
    moves = [
        ("fits", 10, "NONE", "A"), ("fits", h + 5, "A", "B"), ("fits", h + 5, "B", "A"),  # only history tells: A > B > A
        ("plain", 5, "NONE", "A"), ("plain", 5, "A", "C"),
        ("unknown", 1, None, "P"), ("unknown", 1, "P", "Q"),
        ("twice", 1, "NONE", "X"), ("twice", 1, "X", "Y"), ("twice", 2, "Y", "X"), ("twice", 2, "X", "Y"),
        ("gone", 1, "NONE", "A"), ("gone", 2, "A", None), ("gone", 2, "NONE", "B"),
        ("single", None, "NONE", "Z"),
    ]
    ids = list(range(len(moves)))
    if not first:
        ids.reverse()
    df = spark.createDataFrame([(i, *m) for i, m in zip(ids, moves, strict=True)], "n int, k string, at long, b string, a string")
    ranked = cdc.rank_simultaneous(df, ["k"], "at", "b", "a", "n").selectExpr("*", "CASE WHEN coalesce(a, 'NONE') = 'NONE' THEN 'D' ELSE 'U' END AS op")
    got = {r["k"]: r["a"] for r in cdc.apply_changes(ranked, ["k"], ["a"], "seq").collect()}
    assert got == {"fits": "A", "plain": "C", "unknown": "Q", "twice": "Y", "gone": "B", "single": "Z"}


def walk(moves):
    """The state after moves (at, before, after, tie) of one key, taken one by one."""
    state = "NONE"
    for at in sorted({m[0] for m in moves}):
        todo = {}
        for _, b, a, t in sorted((m for m in moves if m[0] == at), key=lambda m: m[3]):
            todo.setdefault((b, a or "NONE"), t)
        while todo:
            left = sorted(todo, key=todo.get)
            p = next((x for x in left if x[0] == state), None) or next((x for x in left if not any(y != x and y[1] == x[0] for y in left)), left[0])
            state = p[1]
            del todo[p]
    return state


@pytest.mark.parametrize("bits", [9, 12])
def test_any_number_of_tied_instants(spark, monkeypatch, bits):
    monkeypatch.setattr(cdc, "BITS", bits)
    rng = random.Random(bits)
    rows = []
    for n in range(2, 8):  # n tied instants in a row, each of which only the state before it can order
        rows += [(f"run{n}", 1, "NONE", "A")] + [(f"run{n}", 10 + 7 * i, *m) for i in range(n) for m in (("B", "A"), ("A", "B"))]
    for k in range(60):
        for at in sorted(rng.choices([0, 1, 2, 3, 4095, 4096, 5000, 10**6, 1_700_000_000_000, 1_700_000_000_001, -5], k=6)):
            rows += [(rng.choice([f"k{k}", f"k{k}", "hub"]), at, rng.choice(["NONE", "A", "B", "C", None]), rng.choice(["A", "B", "C", None])) for _ in range(rng.randrange(1, 5))]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "n int, k string, at long, b string, a string")
    ranked = cdc.rank_simultaneous(df, ["k"], "at", "b", "a", "n").selectExpr("*", "CASE WHEN a IS NULL THEN 'D' ELSE 'U' END AS op")
    assert ranked.count() == len(rows)
    got = {r["k"]: r["a"] for r in cdc.apply_changes(ranked, ["k"], ["a"], "seq").collect()}
    want = {k: walk([(r[2], r[3], r[4], r[0]) for r in rows if r[1] == k]) for k in {r[1] for r in rows}}
    assert got == {k: s for k, s in want.items() if s != "NONE"}
    assert all(want[f"run{n}"] == "A" for n in range(2, 8))
    assert cdc.rank_simultaneous(df.limit(0), ["k"], "at", "b", "a", "n").count() == 0
