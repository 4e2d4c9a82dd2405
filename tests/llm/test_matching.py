"""Matching without keys on generated people: held-out accuracy, and the edge cases."""

import random

import numpy as np
import pytest

from tracewright.llm import matching as M

COLS = {"key": "id", "name": "name", "phone": "phone", "device": "device", "subnet": "net", "city": "city", "year": "year"}
SCHEMA = "id string, name string, phone string, device string, net string, city string, year int"
GIVEN = ["Torvin", "Maresh", "Odalie", "Cessily", "Dorrek", "Fenric", "Liora", "Nerissa", "Osric", "Quilla", "Runa", "Tamsin"]
FAMILY = [a + b + c for a in ("Bel", "Cor", "Dun", "Gar", "Kol", "Lam") for b in ("cal", "den", "hes", "lan", "mer") for c in ("by", "sen", "mann", "wick", "ell")]


def people(rng, n, prefix):
    out = []
    for i in range(n):
        out.append((f"{prefix}{i:04d}", f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}", f"{rng.randrange(10**10):010d}", f"DEV-{rng.randrange(16**8):08x}", f"10.{rng.randrange(250)}.{rng.randrange(250)}.0/24", rng.choice(["Millford", "Ashgate", "Dunwick", "Ravenburn"]), rng.randrange(1930, 2010)))
    return out


def noisy(rng, p, key):
    _, name, phone, device, net, city, year = p
    g, f = name.split(" ", 1)
    name = rng.choice([name, f"{g[0]}. {f}", f"{f}, {g}", name.upper(), name.replace("e", "é", 1), None])
    phone = rng.choice([f"+999-{phone[:3]}-{phone[3:6]}-{phone[6:]}", phone, phone[:4] + phone[5] + phone[4] + phone[6:], "0000000000", None])
    device = rng.choice([device, device[4:].upper(), "unknown", device])
    return (key, name, phone, device, rng.choice([net, None]), rng.choice([city, city.lower(), None]), rng.choice([year, year, None]))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    left = people(rng, 500, "L")
    right, truth = [], set()
    for i in range(400):
        p = rng.choice(left)
        right.append(noisy(rng, p, f"R{i:04d}"))
        truth.add((p[0], f"R{i:04d}"))
    right += [(f"S{r[0]}", *r[1:]) for r in people(rng, 150, "x")]
    return spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right + right[:30], SCHEMA), truth


def test_accuracy(tables):
    left, right, truth = tables
    got = {(r["l"], r["r"]) for r in M.match(left, right, COLS, COLS).collect()}
    assert len(got & truth) / len(got) > 0.97 and len(got & truth) / len(truth) > 0.9
    assert len({r for _, r in got}) == len(got)


def brute(lt, rt, near=M.NEAR):
    """For every query the nearest entries by BM25 over all pairs."""
    n, df = len(lt) + len(rt), {}
    for ts in [*lt.values(), *rt.values()]:
        for t in ts:
            df[t] = df.get(t, 0) + 1
    w = {t: np.log1p((n - d + 0.5) / (d + 0.5)) * M.FIELD[t[:2]] for t, d in df.items()}
    width, out = np.mean([len(t) for t in lt.values()]), {}
    for r, ts in rt.items():
        scored = [(-sum(w[t] for t in ts & us) * (M.K1 + 1) / (1 + M.K1 * (1 - M.B + M.B * len(us) / width)), x) for x, us in lt.items() if ts & us]
        least = max(M.LEAST * sum(w[t] for t in ts), near * -min(scored, default=(0, ""))[0])
        for k, (s, x) in enumerate(sorted(c for c in scored if -c[0] >= least - 1e-9)[: M.TOP], 1):
            out[r, k] = (x, -s)
    return out


def same(pairs, want):
    """Equal scores at every place, and equal entries but for ties."""
    got = {(p["r"], p["place"]): (p["l"], p["score"]) for p in pairs.collect()}
    assert set(got) == set(want)
    for k, (x, s) in want.items():
        assert got[k][1] == pytest.approx(s)
        if all(abs(s - v) > 1e-9 for j, (_, v) in want.items() if j[0] == k[0] and j != k) and k[1] < M.TOP:
            assert got[k][0] == x


@pytest.mark.parametrize("short, hot, share", [(8, 1000, 0.0), (1, 6, 0.0), (2, 3, 1.0), (0, 0, 0.0)])
def test_retrieval_is_exact(tables, monkeypatch, short, hot, share):
    """Every pair that reaches the bounds is found, whichever postings count as short or hot."""
    monkeypatch.setattr(M, "SHORT", short)
    monkeypatch.setattr(M, "HOT", hot)
    lhs, rhs = (M.tokens(t, **COLS) for t in tables[:2])
    lt, rt = ({r["id"]: set(r["toks"]) for r in t.collect()} for t in (lhs, rhs))
    same(M.retrieve(lhs, rhs, share)[0], brute(lt, rt, 0.0 if share else M.NEAR))


def test_common_tokens_count(spark, monkeypatch):
    """Pairs that share a name part and a city only are scored too, however common they are, and a token that all share gives ties."""
    monkeypatch.setattr(M, "HOT", 20)
    left = [(f"L{i:03d}", f"Al{'abcdefghij'[i % 10]} Bo{'klmnopqrst'[i // 10 % 10]}", None, None, None, "Millford", 1950 + i % 7) for i in range(300)]
    right = [(f"R{i:03d}", p[1].split(" ")[1], None, None, None, p[5], None) for i, p in enumerate(left)]
    right += [(f"S{i}", None, None, None, "10.1.1.0/24", None, None) for i in range(50)]
    left += [(f"T{i}", None, None, f"dev{i:05d}", "10.1.1.0/24", None, None) for i in range(50)]
    lhs, rhs = (M.tokens(spark.createDataFrame(t, SCHEMA), **COLS) for t in (left, right))
    lt, rt = ({r["id"]: set(r["toks"]) for r in t.collect()} for t in (lhs, rhs))
    pairs = M.retrieve(lhs, rhs)[0]
    same(pairs, brute(lt, rt))
    assert pairs.where("place = 1").count() == 350 and {p["l"] for p in pairs.where("r like 'S%' and place = 1").collect()} == {"T0"}


def test_calibration(tables):
    """Confidence is a probability: on queries not used, its error is small."""
    lhs, rhs = (M.tokens(t, **COLS) for t in tables[:2])
    pairs, weights = M.retrieve(lhs, rhs, 1.0)
    told = M.examples(M.compared(lhs, rhs, pairs), weights)
    model, report = M.calibrate(told, 10_000)
    assert len(model) == len(M.FEATURES) + 1 and report["brier"] < 0.08 and report["ece"] < 0.1
    left, right, truth = tables
    got = M.match(left, right, COLS, COLS, least=0.0).toPandas()
    hit = np.array([(a, b) in truth for a, b in zip(got["l"], got["r"], strict=True)], float)
    assert np.mean((got["confidence"] - hit) ** 2) < 0.08


def test_edges(spark, tables):
    left, right, _ = tables
    assert M.match(left.limit(0), right, COLS, COLS).count() == 0 and M.match(left, right.limit(0), COLS, COLS).count() == 0
    bare = spark.createDataFrame([("a", None, None, None, None, None, None), (None, "X Y", "1", "1", "1", "1", 1), ("b", "", "", "", "", "", None)], SCHEMA)
    assert M.match(left, bare, COLS, COLS).count() == 0
    hot = spark.createDataFrame([(f"h{i}", "Hot Hotson", "5550001111", "DEV-abcdef01", "10.9.9.0/24", "Millford", 1999) for i in range(200)], SCHEMA)
    assert M.match(hot.limit(1).union(left), hot, COLS, COLS).count() <= 200


def test_logistic_one_class():
    assert M._logistic(np.ones((3, 2)), np.ones(3))[0] > 0 > M._logistic(np.ones((3, 2)), np.zeros(3))[0]
