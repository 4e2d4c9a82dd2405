"""Motifs, distances and clusters of event sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import ship

SECOND = 1_000_000


def motif_matches(events: DataFrame, steps: Sequence[str], max_total: int, max_gap: int | None = None, by: str = "actor_id", t: str = "t", label: str = "event_type", key: str = "event_id") -> DataFrame:
    """All ordered tuples of an entity's events with the given labels: times never go back, each gap and the total bounded (microseconds).

    A chain of joins on the entity and on coarse time buckets: a step looks only into its own and the following bucket
    of ``max_total``, so a hot entity is spread over time and no join multiplies its whole history.
    """
    width = max(max_total, 1)
    # Rows equal in time follow their id.
    base = events.select(F.col(by).alias("e"), F.col(t).alias("t"), F.col(label).alias("l"), F.col(key).alias("k")).withColumn("b", F.floor(F.col("t") / width))
    found = base.where(F.col("l") == steps[0]).select("e", "b", F.col("t").alias("t0"), F.col("t").alias("tn"), F.col("k").alias("kn"), F.array("k").alias("events"))
    for name in steps[1:]:
        nxt = base.where(F.col("l") == name).select("e", F.col("t").alias("nt"), F.col("k").alias("nk"), F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"))
        gap = F.lit(True) if max_gap is None else F.col("nt") - F.col("tn") <= max_gap
        found = found.join(nxt, ["e", "b"]).where((F.struct("nt", "nk") > F.struct("tn", "kn")) & (F.col("nt") - F.col("t0") <= max_total) & gap).select("e", "b", "t0", F.col("nt").alias("tn"), F.col("nk").alias("kn"), F.array_append("events", F.col("nk")).alias("events"))
    return found.select(F.col("e").alias(by), "events", F.col("t0").alias("start_t"), F.col("tn").alias("end_t"))


def bursts(events: DataFrame, size: int, within: int, by: str = "actor_id", t: str = "t", tie: str = "event_id") -> DataFrame:
    """First events of ``size`` consecutive ones that fit into ``within`` microseconds."""
    w = Window.partitionBy(by).orderBy(t, tie)
    return events.withColumn("burst_end", F.lead(t, size - 1).over(w)).where(F.col("burst_end") - F.col(t) <= within)


def repeats(events: DataFrame, size: int = 3, by: str = "actor_id", t: str = "t", label: str = "event_type", tie: str = "event_id") -> DataFrame:
    """First events of ``size`` consecutive ones of one type."""
    w = Window.partitionBy(by).orderBy(t, tie)
    same = F.lit(True)
    for k in range(1, size):
        same = same & (F.lead(label, k).over(w) == F.col(label))
    return events.withColumn("__same", same).where("__same").drop("__same")


def first_after(events: DataFrame, steps: Sequence[str], by: str = "actor_id", t: str = "t", label: str = "event_type") -> DataFrame:
    """(by, t_0, t_1, ...): greedy chain of the first event of each step after the one before; entities that complete it."""
    out = events.where(F.col(label) == steps[0]).groupBy(by).agg(F.min(t).alias("t_0"))
    for k, name in enumerate(steps[1:], 1):
        nxt = events.where(F.col(label) == name).select(by, F.col(t).alias("__n"))
        held = [by, *[f"t_{i}" for i in range(k)]]
        out = out.join(nxt, by).where(F.col("__n") > F.col(f"t_{k - 1}")).groupBy(*held).agg(F.min("__n").alias(f"t_{k}"))
    return out


def dtw(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Cost and length of the best warping path under squared distances; ties prefer up, then left, then the diagonal."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf"), 0
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            c[i, j] = d[i - 1, j - 1] + min(c[i - 1, j], c[i, j - 1], c[i - 1, j - 1])
    i, j, length = n, m, 0
    while i or j:
        length += 1
        up, left, diag = c[i - 1, j] if i else np.inf, c[i, j - 1] if j else np.inf, c[i - 1, j - 1] if i and j else np.inf
        best = min(up, left, diag)
        if up == best:
            i -= 1
        elif left == best:
            j -= 1
        else:
            i, j = i - 1, j - 1
    return float(c[n, m]), length


def dtw_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of two array<array<double>> columns with ``dtw`` (cost by path length) and ``similarity`` exp(-dtw)."""
    ship(pairs.sparkSession)

    @F.pandas_udf("double")
    def cost(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            v, n = dtw(np.array([list(r) for r in p], float), np.array([list(r) for r in q], float))
            out.append(v / n if n else None)
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("dtw", cost(F.col(a), F.col(b))).withColumn("similarity", F.exp(-F.col("dtw")))


def complete_linkage(d: np.ndarray, limit: float) -> list[int]:
    """Cluster numbers of complete-linkage merging up to ``limit``; ties by the least pair of numbers."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((max(d[x][y] for x in p for y in q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > limit:
            break
        _, i, j = best
        groups[i] += groups.pop(j)
    out = [0] * len(d)
    for k, g in enumerate(groups):
        for x in g:
            out[x] = k
    return out


def series_motif(series: np.ndarray, m: int) -> tuple[float, int, int]:
    """Least z-normalised distance of two windows of length ``m`` that do not overlap by more than half."""
    n = len(series) - m + 1
    if n < 2:
        return float("nan"), -1, -1
    w = np.lib.stride_tricks.sliding_window_view(series, m)
    z = (w - w.mean(1, keepdims=True)) / np.where(w.std(1, keepdims=True) > 1e-12, w.std(1, keepdims=True), 1.0)
    best = (np.inf, -1, -1)
    for i in range(n):
        far = np.arange(i + m // 2 + 1, n)
        if len(far):
            dist = np.sqrt(((z[far] - z[i]) ** 2).sum(1))
            k = int(dist.argmin())
            if dist[k] < best[0]:
                best = (float(dist[k]), i, int(far[k]))
    return best


def series_motifs(df: DataFrame, key: str, values: str, m: int) -> DataFrame:
    """(key, distance, first, second) for each row's array of numbers."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *series_motif(np.asarray(v, float), m)) for k, v in zip(pdf[key], pdf[values], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "distance", "first", "second"])

    return df.select(key, values).mapInPandas(run, f"`{key}` {kind}, distance double, first int, second int")
