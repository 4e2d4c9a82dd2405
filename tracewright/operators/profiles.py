"""Scores and profiles of entities from baselines, graph features and behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars as S

# Thresholds of the rules, and the type of anomaly of each level.
RULES = {"robust_z": 3.0, "weighted_degree": 100_000.0, "degree": 5.0, "night_call_ratio": 0.8, "transaction_count": 20.0}
TYPE_OF = {"ENTITY": "ENTITY_DEVIATION", "EVENT": "EVENT_DEVIATION", "RELATIONSHIP": "RELATIONSHIP_DEVIATION", "COMMUNITY": "COMMUNITY_DEVIATION", "SUBGRAPH": "SUBGRAPH_DEVIATION", "SEQUENCE": "SEQUENCE_DEVIATION"}


def rule_score(top_z: Column, night_ratio: Column, transactions: Column, weighted_degree: Column, degree: Column) -> Column:
    """0.2 for each of five rules that holds; missing values hold none."""
    rules = [top_z >= RULES["robust_z"], night_ratio >= RULES["night_call_ratio"], transactions >= RULES["transaction_count"], weighted_degree >= RULES["weighted_degree"], degree >= RULES["degree"]]
    total = F.lit(0.0)
    for r in rules:
        total = total + F.when(F.coalesce(r, F.lit(False)), 0.2).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def deviations(baselines: DataFrame, by: str) -> DataFrame:
    """(by, any_z, top_z, behaviour) of :func:`temporal.causal_baselines`: the greatest |z| of all rows and of those with a history, and the latter over 10."""
    z = F.abs("robust_z")
    known = F.when(F.col("status") != "COLD_START", z)
    return baselines.groupBy(by).agg(F.max(z).alias("any_z"), F.max(known).alias("top_z"), F.least(F.max(known) / 10, F.lit(1.0)).alias("behaviour"))


def graph_novelty(degree: Column, shared: Column, paths: Column) -> Column:
    """The mean of degree / 10, shared counterparties / 5 and paths / 10, 1 at most; missing parts are 0."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return F.least((z(degree) / 10 + z(shared) / 5 + z(paths) / 10) / 3, F.lit(1.0))


def relationship_score(counterparties: Column) -> Column:
    return F.least(F.coalesce(counterparties, F.lit(0)) / 10.0, F.lit(1.0))


def classify(deviation: Column, novelty: Column, relationship: Column, rules: Column, isolation: Column | None = None) -> Column:
    """struct<level, type>: the first of deviation >= 3, novelty >= 0.5, relationship >= 0.5, rules >= 0.4 and isolation < -0.1 that holds; else an entity to be watched."""
    level = F.when(deviation >= 3.0, "ENTITY").when(novelty >= 0.5, "SUBGRAPH").when(relationship >= 0.5, "RELATIONSHIP").when(rules >= 0.4, "EVENT").otherwise("ENTITY")
    del isolation  # gives the same level as none
    return F.struct(level.alias("level"), S.mapped(level, TYPE_OF).alias("type"))


def temporal_score(cadence: Column, burstiness: Column, novelty: Column, surge: Column) -> Column:
    """.35 cadence + .25 burstiness + .20 novelty + .20 surge, each brought into [0, 1], within .05 and .98."""
    a = F.when(cadence > 1, S.clip((cadence - 1) / 3, 0, 1)).otherwise(0.05)
    return S.clip(0.35 * a + 0.25 * S.clip((burstiness + 1) / 2, 0, 1) + 0.20 * S.clip(novelty, 0, 1) + 0.20 * S.clip(surge / 5, 0, 1), 0.05, 0.98)


def decide(scores: list[Column], events: Column, least: int = 2) -> Column:
    """struct<class, score, disagreement, confidence> of detectors: INSUFFICIENT_EVIDENCE with too few events, CONFLICTED above .65 disagreement, then HIGH, ELEVATED or NORMAL."""
    n = len(scores)
    mean = sum(scores, F.lit(0.0)) / n
    std = F.sqrt(sum(((s - mean) * (s - mean) for s in scores), F.lit(0.0)) / n)
    apart = F.round(F.least(std / 0.5, F.lit(1.0)), 3)
    sure = S.clip((1 - apart) * (1 - 1.0 / (events + 1)), 0.10, 0.95)
    kind = F.when(apart > 0.65, "CONFLICTED").when((mean >= 0.65) & (1 - apart >= 0.5), "HIGH").when(mean >= 0.40, "ELEVATED").otherwise("NORMAL")
    few = events < least
    return F.struct(F.when(few, "INSUFFICIENT_EVIDENCE").otherwise(kind).alias("class"), F.when(few, 0.10).otherwise(mean).alias("score"), F.when(few, 1.0).otherwise(apart).alias("disagreement"), F.when(few, 0.20).otherwise(sure).alias("confidence"))


def financial_profile(events: DataFrame, pivot: int, by: str = "actor_id", t: str = "t", amount: str = "amount", target: str = "target_id") -> DataFrame:
    """Payments up to ``pivot`` (microseconds): number, volume, mean, most and deviation of positive amounts, last hour's amount per second, counterparties and their turnover."""
    pos = F.when(F.col(amount) > 0, F.col(amount))
    hour = F.when(F.col(t) >= pivot - 3_600_000_000, F.col(amount))
    return events.where(F.col(t) <= pivot).groupBy(by).agg(
        F.count(F.lit(1)).alias("transactions"), F.coalesce(F.sum(pos), F.lit(0.0)).alias("volume"), F.coalesce(F.avg(pos), F.lit(0.0)).alias("mean_amount"), F.coalesce(F.max(pos), F.lit(0.0)).alias("max_amount"), F.coalesce(F.stddev_pop(pos), F.lit(0.0)).alias("std_amount"),
        (F.coalesce(F.sum(hour), F.lit(0.0)) / 3600).alias("velocity"), F.countDistinct(target).alias("counterparties"), (F.countDistinct(target) / F.count(F.lit(1))).alias("turnover"),
    )


def network_profile(gapped: DataFrame, pivot: int, by: str = "actor_id", t: str = "t", target: str = "target_id") -> DataFrame:
    """Flows up to ``pivot``: number, destinations, burstiness (s - m) / (s + m) of the gaps (``gap_s``; 0 below three flows)."""
    sd, mu = F.stddev_pop("gap_s"), F.avg("gap_s")
    return gapped.where(F.col(t) <= pivot).groupBy(by).agg(F.count(F.lit(1)).alias("flows"), F.countDistinct(target).alias("destinations"), F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.try_divide(sd - mu, sd + mu), F.lit(0.0))).otherwise(0.0).alias("burstiness"))


def social_profile(events: DataFrame, pivot: int, by: str = "actor_id", t: str = "t", target: str = "target_id") -> DataFrame:
    """Interactions up to ``pivot``: number, contacts, number an hour (over a second at least) and contacts per interaction."""
    n = F.count(F.lit(1))
    return events.where(F.col(t) <= pivot).groupBy(by).agg(n.alias("interactions"), F.countDistinct(target).alias("contacts"), (n / (F.greatest((F.max(t) - F.min(t)) / 1e6, F.lit(1.0)) / 3600)).alias("per_hour"), (F.countDistinct(target) / n).alias("new_contact_rate"))


def score_value(value: Column, history: Column) -> Column:
    """struct<center, scale, z, rank, ewma, status> of one value against an array of those before it."""
    n = F.size(history)
    mid = lambda xs: F.when(F.size(xs) % 2 == 1, F.get(xs, (F.size(xs) / 2).cast("int"))).otherwise((F.get(xs, (F.size(xs) / 2).cast("int") - 1) + F.get(xs, (F.size(xs) / 2).cast("int"))) / 2)
    center = F.when(n > 0, mid(F.array_sort(history))).otherwise(value)
    scale = F.when(n > 0, 1.4826 * mid(F.array_sort(F.transform(history, lambda x: F.abs(x - center))))).otherwise(0.0) + 1e-9
    mean = F.aggregate(history, F.lit(0.0), lambda a, x: a + x) / n
    return F.struct(
        center.alias("center"), scale.alias("scale"), F.when(n > 0, (value - center) / scale).otherwise(0.0).alias("z"), F.when(n >= 3, F.size(F.filter(history, lambda x: x <= value)) * 100.0 / n).alias("rank"),
        (0.3 * value + 0.7 * F.when(n > 0, mean).otherwise(value)).alias("ewma"), F.when(n < 3, "COLD_START").when(n < 10, "LOW_HISTORY").otherwise("STABLE_BASELINE").alias("status"),
    )


def signals(long: DataFrame, key: str, factor: float = 2.5, least: float = 5.0) -> DataFrame:
    """(key, features): for each row the features above ``factor`` medians and above ``least``, in order; rows without any are left out."""
    m = F.broadcast(long.groupBy("feature_name").agg(F.median("feature_value").alias("median")))  # one row a feature
    hit = long.join(m, "feature_name").where((F.col("feature_value") > factor * F.col("median")) & (F.col("feature_value") > least))
    return hit.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("feature_name")), ",").alias("features"))
