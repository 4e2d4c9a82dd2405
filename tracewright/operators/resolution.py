"""Resolving records against a registry of entities, and views of identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import linkage

FIELDS = ("actor_id", "actor_name", "device_id", "ip_subnet")


def resolve_records(records: DataFrame, registry: DataFrame, key: str, entity: str = "entity_id", confidence: str = "match_confidence") -> DataFrame:
    """(key, entity, candidates, rule, p, status) of every record against the registry (both with ``FIELDS``).

    Candidates share the actor, the device or the subnet; one with the same actor counts with the registry's own
    confidence, others by their match probability. From 0.85 on the best is CONFIRMED, from 0.60 on POSSIBLE (named, not to
    be merged), below REJECTED; without candidates, or rejected, the record is an entity of its own, named by its actor.
    Ties go to the same actor, then to the least entity. Missing, blank and placeholder fields bring no candidates. A
    registry's hot device or subnet meets each record once, in the join's own splits.
    """
    r = records.select(F.col(key).alias("k"), *[F.col(c).alias(c) for c in FIELDS])
    g = registry.select(F.col(entity).alias("e"), F.col(confidence).cast("double").alias("conf"), *[F.col(c).alias("g_" + c) for c in FIELDS])
    parts = None
    for rank, c in enumerate(("actor_id", "device_id", "ip_subnet")):
        block = linkage.usable(F.col(c))
        met = r.select("k", block.alias("block")).where("block is not null").distinct().join(g.select("e", linkage.usable(F.col("g_" + c)).alias("block")).where("block is not null").distinct(), "block").select("k", "e", F.lit(rank).alias("rank"))
        parts = met if parts is None else parts.unionByName(met)
    pairs = parts.groupBy("k", "e").agg(F.min("rank").alias("rank")).join(r, "k").join(g, "e")
    weight = linkage.match_weight({c: (F.col(c), F.col("g_" + c)) for c in FIELDS})
    p = F.when(F.col("rank") == 0, F.coalesce("conf", F.lit(1.0))).otherwise(linkage.match_probability(weight))
    best = pairs.withColumn("p", p).groupBy("k").agg(F.count(F.lit(1)).alias("candidates"), F.min_by(F.struct("e", "rank", "p"), F.struct(-F.col("p"), "rank", "e")).alias("b"))
    own = S.short_id("ENT_", F.coalesce(F.upper(F.trim("actor_id")), F.lit("")))
    status = linkage.match_status(F.col("b.p"))
    out = r.join(best, "k", "left").withColumn("status", F.when(F.col("b").isNull(), "CONFIRMED").otherwise(status))
    taken = F.col("b").isNotNull() & (F.col("status") != "REJECTED")
    return out.select(
        F.col("k").alias(key), F.when(taken, F.col("b.e")).otherwise(own).alias("entity"), F.coalesce("candidates", F.lit(0)).cast("bigint").alias("candidates"),
        F.when(F.col("b").isNull(), "none").when(F.col("b.rank") == 0, "exact_actor_id").when(F.col("b.rank") == 1, "device_id").otherwise("ip_subnet").alias("rule"), F.coalesce("b.p", F.lit(1.0)).alias("p"), "status",
    )


def registry_errors(registry: DataFrame, entity: str, identifier: str, confidence: Column) -> DataFrame:
    """(error, n) of what makes a registry unfit: missing ids, an identifier under several entities, a confidence outside [0, 1]. None must be above 0."""
    one = registry.agg(F.count_if(F.coalesce(F.trim(F.col(entity)), F.lit("")) == "").alias("MISSING_ENTITY"), F.count_if(F.coalesce(F.trim(F.col(identifier)), F.lit("")) == "").alias("MISSING_IDENTIFIER"), F.count_if(~F.coalesce(confidence.between(0, 1), F.lit(False))).alias("INVALID_CONFIDENCE"))
    many = registry.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.countDistinct(entity).alias("n")).agg(F.count_if(F.col("n") > 1).alias("CONFLICTING_IDENTIFIER"))
    both = one.crossJoin(many)  # one row each
    return both.unpivot([], both.columns, "error", "n")


def require_registry(registry: DataFrame, entity: str, identifier: str, confidence: Column) -> DataFrame:
    """``registry``, or ValueError if anything is wrong with it or it is empty."""
    bad = {r["error"]: r["n"] for r in registry_errors(registry, entity, identifier, confidence).where("n > 0").collect()}
    if bad or registry.isEmpty():
        raise ValueError(f"registry refused: {bad or 'empty'}")
    return registry


def bridge_status(links: DataFrame, raw: str, entity: str, known: DataFrame) -> DataFrame:
    """(raw, entities, status) of the raw ids of a ledger: UNMAPPED if not among ``known``, CONFLICTING under several entities, else VERIFIED."""
    n = links.where(F.col(raw).isNotNull()).groupBy(raw).agg(F.countDistinct(entity).alias("entities"))
    there = known.select(F.col(raw)).where(F.col(raw).isNotNull()).distinct().withColumn("__there", F.lit(True))
    return n.join(there, raw, "left").select(raw, "entities", F.when(F.col("__there").isNull() | (F.col("entities") == 0), "UNMAPPED").when(F.col("entities") > 1, "CONFLICTING").otherwise("VERIFIED").alias("status"))


def aliases(links: DataFrame, raw: str, entity: str) -> DataFrame:
    """(entity, alias): each entity under its own id and all its raw ones."""
    e = links.where(F.col(entity).isNotNull())
    return e.select(F.col(entity).alias("entity"), F.col(entity).alias("alias")).union(e.where(F.col(raw).isNotNull()).select(entity, raw)).distinct()


def lookup(entities: DataFrame, key: str, name: str, term: str) -> DataFrame:
    """(key, match, rank, ambiguous): entities whose id or name is the term, else those that hold it; the exact ones alone where there are any."""
    low = term.lower().strip()
    exact = (F.lower(F.trim(F.col(key))) == low) | (F.lower(F.trim(F.col(name))) == low)
    part = F.contains(F.lower(F.col(key)), F.lit(low)) | F.contains(F.lower(F.col(name)), F.lit(low))
    hit = entities.withColumn("match", F.when(exact, "EXACT").when(part, "PARTIAL")).where("match is not null")
    any_exact = hit.agg(F.coalesce(F.bool_or(F.col("match") == "EXACT"), F.lit(False)).alias("x"))
    kept = hit.crossJoin(F.broadcast(any_exact)).where("not x or match = 'EXACT'")  # one row
    n = kept.agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return kept.crossJoin(F.broadcast(n)).select(key, "match", "ambiguous")


def identity_status(members: DataFrame, key: str, scored: DataFrame) -> DataFrame:
    """(key, status): PAIRWISE_CONFIRMED if in a confirmed pair, CLUSTER_UNCONFIRMED if only in others, else SINGLETON."""
    ends = scored.select(F.col("left_id").alias(key), "p").union(scored.select("right_id", "p")).groupBy(key).agg(F.max("p").alias("p"))
    return members.select(key).distinct().join(ends, key, "left").select(key, F.when(F.col("p") >= 0.85, "PAIRWISE_CONFIRMED").when(F.col("p").isNotNull(), "CLUSTER_UNCONFIRMED").otherwise("SINGLETON").alias("status"))


def uncertain_pairs(scored: DataFrame, of_case: DataFrame, key: str) -> DataFrame:
    """Possible pairs both of whose ends are among a case's identifiers."""
    ids = of_case.select(key).where(F.col(key).isNotNull()).distinct()
    return scored.where("p >= 0.60 and p < 0.85").join(ids.withColumnRenamed(key, "left_id"), "left_id", "left_semi").join(ids.withColumnRenamed(key, "right_id"), "right_id", "left_semi").select("left_id", "right_id", "p")


def ranked_choices(candidates: DataFrame, hops: str, recency: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """``candidates`` with ``rank``: fewest hops first (999 where unreachable), then the most recent, then by id."""
    w = Window.partitionBy(*by).orderBy(F.coalesce(F.col(hops), F.lit(999)), F.col(recency).desc_nulls_last(), F.col(key))
    return candidates.withColumn("rank", F.row_number().over(w))
