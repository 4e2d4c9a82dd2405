"""Frequent subsequences against brute force, with pieces small enough to be cut and reduced."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import subsequences as Q


def held(events, k):
    """All patterns of up to k items of a sequence of (index, item), strictly rising."""
    events = sorted(set(events))
    out = set()
    for n in range(1, k + 1):
        for c in itertools.combinations(events, n):
            if all(a[0] < b[0] for a, b in itertools.pairwise(c)):
                out.add(tuple(x for _, x in c))
    return out


def test_reduction_keeps_exactly_the_patterns():
    rng = random.Random(1)
    for _ in range(60):
        e = sorted({(rng.randrange(12), rng.randrange(3)) for _ in range(rng.randrange(1, 16))})
        for k in (2, 3, 4):
            r = Q.reduce_sequence(e, k)
            assert set(r) <= set(e) and held(r, k) == held(e, k)
    long = [(i, i % 3) for i in range(3000)]
    assert len(Q.reduce_sequence(long, 4)) < 40


def test_diagram_shares_and_counts():
    d = Q.Diagram()
    seqs = [([1, 2, 3], 2), ([4, 2, 3], 1), ([2, 1, 2 + Q.JOINED], 1)]
    root = d.build(iter(seqs))
    # [2, 3] after [1] and after [4] differ in weight only at their head; [3] is shared where weights agree.
    assert len(d.item) <= sum(len(s) for s, _ in seqs) + 1
    before = len(d.item)
    assert d.holds(root, 2) == 4 and d.holds(d.push(root, 1), 2) == 2 and d.holds(d.push(d.push(root, 1), 2), 3) == 2
    after = len(d.item)
    assert d.push(d.push(root, 1), 2) and len(d.item) == after >= before  # identical subproblems make nothing new
    twin = Q.Diagram()
    root = twin.build(iter([([1, 2, 3], 1), ([4, 2, 3], 1)]))
    assert len(twin.item) == 5 and twin.push(root, 1) == twin.push(root, 4)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(Q, "PIECE", 16)
    monkeypatch.setattr(Q, "FANOUT", 2)
    monkeypatch.setattr(Q, "LONG", 8)
    monkeypatch.setattr(Q, "BLOCK", 7)


def test_against_brute_force(spark, small):
    rng = random.Random(2)
    rows = []
    for e in range(30):
        for _ in range(rng.randrange(1, 9)):
            rows.append((f"e{e}", rng.choice("ABCDE"), rng.randrange(6)))
    rows += [("hub", rng.choice("ABCDE"), i) for i in range(-40, 160)]
    rows += rows[:20] + [(None, "A", 1), ("e1", None, 1), ("e2", "A", None), ("only", None, None)]
    df = spark.createDataFrame(rows, "e string, x string, i long")
    total = len({r[0] for r in rows} - {None})
    count = {}
    for e in {r[0] for r in rows} - {None, "hub"}:
        for p in held([(i, x) for a, x, i in rows if a == e and x and i is not None], 4):
            count[p] = count.get(p, 0) + 1
    for n in range(1, 5):  # the hub has every pattern
        for p in itertools.product("ABCDE", repeat=n):
            count[p] = count.get(p, 0) + 1
    least = -(-total // 10)
    want = {p: n for p, n in count.items() if n >= least and len(p) >= 1}
    got = {tuple(r["pattern"]): r["support"] for r in Q.frequent_subsequences(df, F.col("e"), F.col("x"), F.col("i"), 0.1, (1, 4)).collect()}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "e string, x string, i long")
    assert Q.frequent_subsequences(df, F.col("e"), F.col("x"), F.col("i")).count() == 0
