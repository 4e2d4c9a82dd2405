"""Per-entity features of calls, sessions, payments, social acts and networks, as wide tables or long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.session import materialize

SECOND = 1_000_000


def call_features(events: DataFrame, by: str = "actor_id", target: str = "target_id", t: str = "t", ts: str = "ts", duration: str = "amount", tie: str = "event_id") -> DataFrame:
    """Calls, contacts, mean and longest duration, share at night, reciprocity and burstiness of each caller.

    Burstiness is the population deviation of the gaps over their mean, 0 unless there are several gaps with a mean
    above 0. Reciprocity is |called and calling back| / |called or calling|.
    """
    g = events.withColumn("__gap", (F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(t, tie))) / SECOND)
    mu, sd, n = F.avg("__gap"), F.stddev_pop("__gap"), F.count("__gap")
    own = g.groupBy(by).agg(
        F.count(F.lit(1)).alias("call_count"), F.countDistinct(target).alias("unique_contacts"), F.avg(duration).alias("mean_duration"), F.max(duration).alias("max_duration"),
        F.avg(S.is_night(F.col(ts)).cast("int")).alias("night_call_ratio"), F.when((n > 1) & (mu > 0), sd / mu).otherwise(0.0).alias("burstiness"),
    )
    pair = events.where(F.col(target).isNotNull() & (F.col(by) != F.col(target))).select(F.col(by).alias("x"), F.col(target).alias("y"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = pair.union(pair.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(0).alias("o"), F.lit(1).alias("i"))).groupBy("x", "y").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    back = both.groupBy(F.col("x").alias(by)).agg((F.sum(F.col("o") * F.col("i")) / F.count(F.lit(1))).alias("reciprocity"))
    return own.join(back, by, "left").fillna({"reciprocity": 0.0})


def money_features(payments: DataFrame, by: str, counterparty: str, amount: str) -> DataFrame:
    """Count, sum, mean, median, MAD, counterparties of each payer. The deviations are a second pass over the amounts, which are written once, and never a list."""
    payments = materialize(payments.select(by, counterparty, amount))
    base = payments.groupBy(by).agg(F.count(F.lit(1)).alias("transaction_count"), F.sum(amount).alias("transaction_velocity"), F.avg(amount).alias("mean_amount"), F.median(amount).alias("median_amount"), F.countDistinct(counterparty).alias("unique_counterparties"))
    dev = payments.join(base.select(by, "median_amount"), by).groupBy(by).agg(F.median(F.abs(F.col(amount) - F.col("median_amount"))).alias("amount_deviation"))
    return base.join(dev, by)


def flow_ratio(payments: DataFrame, payer: str, payee: str, amount: str) -> DataFrame:
    """Money in, money out and their ratio of every party; 999999.0 where nothing was sent."""
    flows = payments.select(F.col(payer).alias("id"), F.col(amount).alias("o"), F.lit(0.0).alias("i")).unionByName(payments.select(F.col(payee).alias("id"), F.lit(0.0).alias("o"), F.col(amount).alias("i")))
    return flows.groupBy("id").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow")).withColumn("inflow_outflow_ratio", F.when(F.col("outflow") > 0, F.col("inflow") / F.col("outflow")).otherwise(999999.0))


def social_features(events: DataFrame, by: str = "actor_id", target: str = "target_id") -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("activity_frequency"), F.count(target).alias("interaction_count"))


def degree_features(edges: DataFrame) -> DataFrame:
    """Distinct counterparties and number of edges of every node."""
    ends = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("o")).union(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("o")))
    return ends.groupBy("id").agg(F.countDistinct("o").alias("degree"), F.count(F.lit(1)).alias("weighted_degree"))


def long_rows(wide: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, feature_name, feature_value); null becomes 0."""
    return wide.select(key, *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]).unpivot([key], list(names), "feature_name", "feature_value")


def wide_matrix(long: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The mean of each named feature a column, 0 where missing."""
    return long.groupBy(key).pivot("feature_name", list(names)).agg(F.avg("feature_value")).fillna(0.0)


def participants(events: DataFrame, actor: str = "actor_id", target: str = "target_id") -> DataFrame:
    """Events once per party, actor or target, in ``entity``; a party on both ends counts once."""
    return events.withColumn("entity", F.explode(F.array_distinct(F.array_compact(F.array(actor, target)))))


def entity_contract(events: DataFrame, by: str = "actor_id", label: str = "event_type", domain: str = "source_domain") -> DataFrame:
    """Events, domains and types of each entity, its most frequent type (ties to the least) and domains in order."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct(domain).alias("n_domains"), F.countDistinct(label).alias("n_types"), F.mode(label, True).alias("main_type"), F.array_join(F.array_sort(F.collect_set(domain)), ",").alias("domains"))


def history_summary(events: DataFrame, by: str = "actor_id", t: str = "t", target: str = "target_id", key: str = "event_id") -> DataFrame:
    """First and last event, counterparties and span of each entity."""
    return events.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_events"), F.min_by(key, F.struct(t, key)).alias("first_event"), F.max_by(key, F.struct(t, key)).alias("last_event"), F.countDistinct(target).alias("counterparties"), ((F.max(t) - F.min(t)) / SECOND).alias("span_s")
    )


def domain_counts(events: DataFrame, domains: Sequence[str], by: str = "actor_id", domain: str = "source_domain") -> DataFrame:
    """A count column per domain, in one pass."""
    return events.groupBy(by).agg(*[F.count_if(F.col(domain) == d).alias(f"n_{d.lower()}") for d in domains])


def sequence_features(events: DataFrame, by: str = "actor_id", t: str = "t", label: str = "event_type", domain: str = "source_domain", tie: str = "event_id") -> DataFrame:
    """Length, mean gap, rapid steps (60 s at most), repeated types, changes of domain and distinct transitions of each sequence."""
    w = Window.partitionBy(by).orderBy(t, tie)
    s = events.withColumn("__g", (F.col(t) - F.lag(t).over(w)) / SECOND).withColumn("__l", F.lag(label).over(w)).withColumn("__d", F.lag(domain).over(w))
    return s.groupBy(by).agg(
        F.count(F.lit(1)).alias("length"), F.avg("__g").alias("mean_gap"), F.count_if(F.col("__g") <= 60).alias("rapid"), F.count_if(F.col("__l") == F.col(label)).alias("repeated"), F.count_if(F.col("__d") != F.col(domain)).alias("cross_domain"),
        F.countDistinct(F.when(F.col("__l").isNotNull(), F.struct("__l", label))).alias("unique_transitions"),
    )


def population_statistics(long: DataFrame) -> DataFrame:
    """Median, MAD and deviation of every feature over the population."""
    m = long.groupBy("feature_name").agg(F.median("feature_value").alias("median"), F.stddev_pop("feature_value").alias("std"), F.count(F.lit(1)).alias("n"))
    # One row a feature name.
    d = long.join(F.broadcast(m.select("feature_name", "median")), "feature_name").groupBy("feature_name").agg(F.median(F.abs(F.col("feature_value") - F.col("median"))).alias("mad"))
    return m.join(d, "feature_name")
