"""Detectors, their combination, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators.entity_features import long_rows, population_statistics


def robust_scores(wide: DataFrame, key: str, names: Sequence[str], top: int = 3) -> DataFrame:
    """(key, mean_top_z, score): the mean of a row's three largest |robust z| through a sigmoid; 0.5 for a population of one."""
    long = long_rows(wide, key, names)
    # One row a feature.
    stats = F.broadcast(population_statistics(long))
    z = long.join(stats, "feature_name").withColumn("z", F.abs(S.robust_z(F.col("feature_value"), F.col("median"), F.col("mad"), F.col("std"))))
    row = z.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("z"), False), 1, top).alias("tops"), F.max("n").alias("n"))
    mean = F.aggregate("tops", F.lit(0.0), lambda a, x: a + x) / F.size("tops")
    return row.select(key, mean.alias("mean_top_z"), F.when(F.col("n") <= 1, 0.5).otherwise(S.score_from_z(mean)).alias("score"))


def combine(scores: Sequence[Column]) -> Column:
    """struct<score, disagreement, n>: the mean of the detectors present and their deviation over 0.5."""
    there = F.array_compact(F.array(*scores))
    n = F.size(there)
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(there, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when(n > 0, F.struct(mean.alias("score"), F.least(F.sqrt(var) / 0.5, F.lit(1.0)).alias("disagreement"), n.alias("n")))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.35, "MEDIUM").otherwise("LOW")


class IsolationForest:
    """Isolation trees on a bounded sample; scoring is vectorised and runs wherever the rows are."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], depth, rng) for _ in range(trees)]

    @staticmethod
    def _path(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        span = np.ptp(x, axis=0) if len(x) else np.zeros(0)
        wide = np.flatnonzero(span > 0)
        if depth == 0 or len(x) <= 1 or not len(wide):
            return self._path(len(x))
        f = int(rng.choice(wide))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], depth - 1, rng), self._grow(x[~left], depth - 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is easier to isolate."""
        total = np.zeros(len(x))

        def walk(node, rows: np.ndarray, depth: int) -> None:
            if not isinstance(node, tuple):
                total[rows] += depth + node
                return
            left = x[rows, node[0]] < node[1]
            walk(node[2], rows[left], depth + 1)
            walk(node[3], rows[~left], depth + 1)

        for t in self.trees:
            walk(t, np.arange(len(x)), 0)
        return np.power(2.0, -total / len(self.trees) / max(self._path(self.size), 1e-9))


def isolation_scores(wide: DataFrame, key: str, names: Sequence[str], sample_rows: int = 20_000, seed: int = 42) -> DataFrame:
    """(key, score) of a forest fitted on at most ``sample_rows`` rows, chosen by a hash of the key; below five rows every score is 0.5."""
    n = wide.count()
    share = min(1.0, 1.2 * sample_rows / max(n, 1))
    x = wide.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)).select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]).orderBy(F.xxhash64(F.lit(seed), F.col(key))).limit(sample_rows).toPandas()[list(names)].to_numpy()
    if n < 5 or len(x) < 5:
        return wide.select(key, F.lit(0.5).alias("score"))
    from tracewright.session import ship

    ship(wide.sparkSession)
    forest = wide.sparkSession.sparkContext.broadcast(IsolationForest(x, seed=seed))
    kind = wide.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "score": forest.value.score(pdf[list(names)].fillna(0.0).to_numpy(dtype=float))})

    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"`{key}` {kind}, score double")


#: Ranges of scores in ranking metrics.
BUCKETS = 1024


def ranking_metrics(scored: DataFrame, score: str, label: str, at: float = 0.5) -> DataFrame:
    """One row: positives, ROC AUC (ties share their mean rank), average precision (ties together), precision, recall, F1 and false positive rate.

    Rows are first counted by score. The cumulative sums run over at most ``BUCKETS`` equal ranges of scores, then within
    each, so the distinct scores are never one task. A single class gives null AUC; null scores are left out.
    """
    c = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    ends = c.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    c = c.crossJoin(F.broadcast(ends)).withColumn("b", F.least(F.floor(F.coalesce(F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1))).drop("lo", "hi")
    whole = c.groupBy("b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    over = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    under = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("b", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("bn") - F.col("bp")).over(under), F.lit(0)).alias("neg0"))
    down = Window.partitionBy("b").orderBy(F.desc("s"))
    up = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    c = c.join(F.broadcast(base), "b").withColumn("tp", F.sum("p").over(down) + F.col("p0")).withColumn("k", F.sum("n").over(down) + F.col("n0"))
    c = c.withColumn("neg_below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(up), F.lit(0)) + F.col("neg0"))
    r = c.agg(
        F.sum("p").alias("positives"), F.sum(F.col("n") - F.col("p")).alias("negatives"),
        F.sum(F.col("p") * (F.col("neg_below") + (F.col("n") - F.col("p")) / 2)).alias("u"), F.sum(F.col("p") * F.col("tp") / F.col("k")).alias("ap"),
        F.sum(F.when(F.col("s") >= at, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("s") >= at, F.col("n") - F.col("p")).otherwise(0)).alias("fp"),
    )
    return r.select(
        "positives", "negatives", F.try_divide(F.col("u"), F.col("positives") * F.col("negatives")).alias("roc_auc"), F.try_divide("ap", "positives").alias("average_precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "positives").alias("recall"), F.try_divide(2 * F.col("tp"), F.col("positives") + F.col("tp") + F.col("fp")).alias("f1"), F.try_divide("fp", "negatives").alias("fpr"),
    )


def calibration(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row (brier, ece): squared error, and the gap of mean score and rate over equal bins, the last closed."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    cells = scored.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"), F.sum(F.col(label).cast("double")).alias("y"), F.sum(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("e"))
    return cells.agg((F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))
