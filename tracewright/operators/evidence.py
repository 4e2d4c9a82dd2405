"""Evidence and lineage: resolving references, grounding claims, reliability and risk of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import fusion
from tracewright.session import materialize


def resolve_references(findings: DataFrame, refs: str, records: DataFrame, key: str, finding: str) -> DataFrame:
    """(finding, n_refs, n_found, status): how many of a finding's references name a record: FULLY, PARTIALLY or UNREFERENCED."""
    asked = findings.select(finding, F.explode_outer(F.array_distinct(F.col(refs))).alias("__ref"))
    there = records.select(F.col(key).alias("__ref"), F.lit(1).alias("__hit")).where("__ref is not null").distinct()
    c = asked.join(there, "__ref", "left").groupBy(finding).agg(F.count("__ref").alias("n_refs"), F.count("__hit").alias("n_found"))
    return c.withColumn("status", F.when(F.col("n_found") == 0, "UNREFERENCED").when(F.col("n_found") < F.col("n_refs"), "PARTIALLY").otherwise("FULLY"))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values; null counts as empty."""
    norm = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))))
    return norm(a) == norm(b)


def missing_records(left: DataFrame, column: str, right: DataFrame, key: str) -> DataFrame:
    """Rows whose record must exist and does not (a null reference is missing too)."""
    return left.join(right.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct(), column, "left_anti")


def lookup(evidence: DataFrame, term: str, columns: Sequence[tuple[str, bool]]) -> DataFrame:
    """Records by the first column that matches: equality, or a prefix of at least eight characters where that is allowed."""
    rank = None
    for i, (c, prefix) in enumerate(columns):
        hit = F.col(c) == term
        if prefix and len(term) >= 8:
            hit = hit | F.col(c).startswith(term)
        rank = F.when(hit, F.lit(i)) if rank is None else rank.when(hit, F.lit(i))
    found = evidence.withColumn("match_rank", rank).where("match_rank is not null")
    best = found.agg(F.min("match_rank").alias("match_rank"))
    return found.join(F.broadcast(best), "match_rank")  # one row


def ungrounded(claims: DataFrame, claim: str, refs: str, bound: DataFrame, key: str) -> DataFrame:
    """Claims without evidence, or with evidence that is not bound."""
    empty = claims.where(F.size(F.coalesce(F.col(refs), F.array().cast(claims.schema[refs].dataType))) < 1).select(claim)
    bad = missing_records(claims.select(claim, F.explode(refs).alias("__ref")), "__ref", bound.select(F.col(key).alias("__ref")), "__ref").select(claim)
    return empty.union(bad).distinct()


def dependency_clusters(evidence: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """(id, component): evidence that shares an event, a hash or a source row stands for one observation.

    Each shared value links its members to the least of them (an aggregate), and the links' components are the clusters;
    evidence that shares nothing is a cluster of its own.
    """
    from tracewright.operators.linkage import clusters

    links = None
    for c in shared:
        e = evidence.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v"), F.col(key).alias("right_id"))
        part = e.join(e.groupBy("v").agg(F.min("right_id").alias("left_id")), "v").where("left_id <> right_id").select("left_id", "right_id")
        links = part if links is None else links.union(part)
    found = materialize(clusters(links))
    return evidence.select(F.col(key).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reliability(support: Column, contradiction: Column, sources: Column, identity: Column, completeness: Column, future_leak: Column) -> Column:
    """struct<score, level>: a weighted mean less contradiction, behind gates for identity and causality."""
    score = S.clip(0.35 * support + 0.25 * F.least(sources / 3.0, F.lit(1.0)) + 0.25 * identity + 0.15 * completeness - 0.35 * contradiction, 0.0, 1.0)
    level = F.when(future_leak, "INVALID").when(identity < 0.5, "INSUFFICIENT_EVIDENCE").when((contradiction >= 0.5) & (support >= 0.5), "CONFLICTED").when(score >= 0.65, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")
    return F.struct(score.alias("score"), level.alias("level"))


def risk(anomaly: Column, degree: Column, age_days: Column, cluster: Column) -> Column:
    """struct<score, level> of anomaly, connectedness, recency (30 days' half-life) and cluster size; missing parts pass their weight on."""
    parts = {"a": (S.clip(anomaly, 0, 1), 0.35), "d": (S.clip(degree / 10.0, 0, 1), 0.20), "r": (S.half_life(age_days), 0.25), "c": (S.clip(cluster / 5.0, 0, 1), 0.20)}
    r = F.coalesce(fusion.redistributed(parts), F.lit(0.0))
    return F.struct(r.alias("score"), fusion.risk_level(r).alias("level"))


def replay(log: DataFrame, by: str, order: Sequence[str], state: str) -> DataFrame:
    """The last state of each key in order; see the change feed operator for deletes and ties."""
    return log.groupBy(by).agg(F.max_by(state, F.struct(*order)).alias(state))


def forbidden_transitions(log: DataFrame, by: str, order: Sequence[str], state: str, allowed: DataFrame) -> DataFrame:
    """Consecutive states (src, dst) of a key that are not among the allowed pairs."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = log.select(by, F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).where("src is not null")
    return steps.join(allowed.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(by, "src", "dst")


def overlap_of_requests(requests: DataFrame, key: str, targets: str, kind: str) -> DataFrame:
    """(a, b, shared, is_equal), a < b: requests of one kind that have targets in common, from an equality join on the target."""
    t = requests.select(F.col(key).alias("id"), F.col(kind).alias("k"), F.explode(F.array_distinct(F.col(targets))).alias("t"), F.size(F.array_distinct(F.col(targets))).alias("n"))
    j = t.select(F.col("id").alias("a"), "k", "t", F.col("n").alias("na")).join(t.select(F.col("id").alias("b"), "k", "t", F.col("n").alias("nb")), ["k", "t"]).where("a < b")
    return j.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).select("a", "b", "shared", ((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb"))).alias("is_equal"))
