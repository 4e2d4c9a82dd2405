"""Fusing evidence of several domains: weighted means, Dempster-Shafer masses, conflict, attribution, risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.scalars import clip


def mass(score: Column, sensitivity: float = 0.8) -> Column:
    """struct<a, n, t>: belief in an anomaly, in its absence, and what is left to ignorance; a null score is all ignorance."""
    s = clip(score, 0.0, 1.0)
    return F.when(s.isNull(), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("n"), F.lit(1.0).alias("t"))).otherwise(F.struct((s * sensitivity).alias("a"), ((1 - s) * sensitivity).alias("n"), F.lit(1 - sensitivity).alias("t")))


def combine_masses(masses: Column) -> Column:
    """struct<a, n, t, conflict> of an array of masses, folded in order.

    Conflict is the sum of the steps' conflicts, 1 at most; where a step is nothing but conflict the result is (.5, .5, 0).
    """
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("n"), F.lit(1.0).alias("t"), F.lit(0.0).alias("conflict"))

    def step(x: Column, y: Column) -> Column:
        k = x["a"] * y["n"] + x["n"] * y["a"]
        left = F.lit(1.0) - k
        total = F.least(x["conflict"] + k, F.lit(1.0)).alias("conflict")
        part = lambda v, name: (v / left).alias(name)
        fused = F.struct(part(x["a"] * y["a"] + x["a"] * y["t"] + x["t"] * y["a"], "a"), part(x["n"] * y["n"] + x["n"] * y["t"] + x["t"] * y["n"], "n"), part(x["t"] * y["t"], "t"), total)
        return F.when(k > 1 - 1e-12, F.struct(F.lit(0.5).alias("a"), F.lit(0.5).alias("n"), F.lit(0.0).alias("t"), total)).otherwise(fused)

    return F.aggregate(masses, start, step)


def weighted_mean(scores: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean over the domains that are present; null if none is."""
    top = w = F.lit(0.0)
    for d, s in scores.items():
        top = top + F.coalesce(s * weights[d], F.lit(0.0))
        w = w + F.when(s.isNotNull(), weights[d]).otherwise(0.0)
    return F.when(w > 0, top / w)


def conflict_level(k: Column) -> Column:
    return F.when(k >= 0.5, "CONFLICTED").when(k >= 0.25, "MATERIAL").otherwise("CONSISTENT")


def finding_status(conflict: Column, uncertainty: Column, composite: Column) -> Column:
    return F.when(conflict >= 0.5, "CONFLICTED").when((uncertainty >= 0.8) & (composite < 0.3), "INSUFFICIENT_EVIDENCE").otherwise("SUPPORTED")


def pignistic(m: Column) -> Column:
    """Probability of an anomaly once ignorance is split in halves."""
    return m["a"] + m["t"] / 2


def hellinger(p: Sequence[Column], q: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(p, q, strict=True):
        total = total + F.pow(F.sqrt(x) - F.sqrt(y), 2)
    return F.sqrt(total) / F.sqrt(F.lit(2.0))


def cosine(p: Sequence[Column], q: Sequence[Column]) -> Column:
    dot = n = m = F.lit(0.0)
    for x, y in zip(p, q, strict=True):
        dot, n, m = dot + x * y, n + x * x, m + y * y
    return F.when((n > 0) & (m > 0), dot / F.sqrt(n * m)).otherwise(0.0)


def compound_conflict(x: Column, y: Column) -> Column:
    """Hellinger distance of the pignistic pairs times (1 - cosine of the belief vectors), rounded between the steps as well."""
    px, py = F.round(pignistic(x), 6), F.round(pignistic(y), 6)
    h = F.round(hellinger([px, 1 - px], [py, 1 - py]), 4)
    c = F.round(cosine([x["a"], x["n"], x["t"]], [y["a"], y["n"], y["t"]]), 4)
    return F.round(h * (1 - c), 4)


def corroboration(scores: Sequence[Column]) -> Column:
    """1 - product of (1 - score) over the domains present."""
    left = F.lit(1.0)
    for s in scores:
        left = left * (1 - F.coalesce(s, F.lit(0.0)))
    return 1 - left


def shapley(scores: Mapping[str, Column]) -> dict[str, Column]:
    """Exact Shapley values of :func:`corroboration`, over all coalitions of the domains (2^n terms; n is the number of domains)."""
    names, out = list(scores), {}
    n = len(names)
    for d in names:
        rest = [x for x in names if x != d]
        total = F.lit(0.0)
        for k in range(n):
            w = factorial(k) * factorial(n - k - 1) / factorial(n)
            for s in combinations(rest, k):
                total = total + (corroboration([scores[x] for x in (*s, d)]) - corroboration([scores[x] for x in s])) * w
        out[d] = total
    return out


def redistributed(parts: Mapping[str, tuple[Column, float]]) -> Column:
    """Weighted sum of parts, the weight of missing ones going to those present."""
    return weighted_mean({k: c for k, (c, _) in parts.items()}, {k: w for k, (_, w) in parts.items()})


def risk_level(r: Column) -> Column:
    return F.when(r >= 0.65, "HIGH").when(r >= 0.40, "MEDIUM").otherwise("LOW")


def temporal_coherence(span: Column, window: float) -> Column:
    return clip(1 - span / F.lit(window), 0.05, 1.0)


def posterior_mean(followed: Column, ignored: Column) -> Column:
    """Mean of the Beta posterior of a uniform prior."""
    return (1 + followed) / (2 + followed + ignored)
