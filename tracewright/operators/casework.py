"""Cases from evidence of several domains: binding, fusion, conflict, reliability and quality of single records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tracewright.functions.scalars import clip
from tracewright.operators import fusion

# Thresholds and weights of fusion, of conflict, and of reliability.
SUPPORTS, CONTRADICTS, LINKED, TARGET_DOMAINS, PENALTY = 0.45, 0.25, 0.70, 3, 0.35
FUSED = {"domain_support": 0.35, "temporal_coherence": 0.25, "identity_confidence": 0.25, "evidence_quality": 0.15}
MATERIAL, ABSTAIN = 0.25, 0.38
RELIABLE = {"identity": 0.25, "temporal": 0.15, "quality": 0.15, "corroboration": 0.20, "data": 0.10, "provenance": 0.15}
CONFLICT_PENALTY = {"NO_CONFLICT": 0.0, "WEAK_CONFLICT": 0.10, "MODERATE_CONFLICT": 0.25, "STRONG_CONFLICT": 0.35}


def conflict_status(c: Column) -> Column:
    return F.when(c >= ABSTAIN, "ABSTENTION_REQUIRED").when(c >= MATERIAL, "MATERIAL_CONFLICT").otherwise("NO_MATERIAL_CONFLICT")


def worst_pair(scores: dict[str, Column]) -> Column:
    """struct<pair, conflict, status>: the pair of domains with the greatest compound conflict, the first in order of names if several; null with fewer than two."""
    names = sorted(scores)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    each = [F.when(scores[a].isNotNull() & scores[b].isNotNull(), F.struct(fusion.compound_conflict(fusion.mass(scores[a]), fusion.mass(scores[b])).alias("c"), F.lit(-k).alias("k"), F.lit(f"{a}-{b}").alias("pair"))) for k, (a, b) in enumerate(pairs)]
    worst = F.array_max(F.array_compact(F.array(*each)))
    return F.when(worst.isNotNull(), F.struct(worst["pair"].alias("pair"), worst["c"].alias("conflict"), conflict_status(worst["c"]).alias("status")))


def fuse(items: DataFrame, links: DataFrame, window: float, entity: str = "entity", domain: str = "domain", event: str = "event_id", score: str = "score", t: str = "t", ref: str = "evidence_ref") -> DataFrame:
    """(entity, status, score, uncertainty, domains, supporting, contradicting, coherence): one fused case for every entity of ``links`` (entity, confidence).

    An entity without a link, or linked with less than ``LINKED`` on average, abstains as IDENTITY_UNCERTAIN, one without
    items as INSUFFICIENT_EVIDENCE. Items of one event count once, the least by (time, domain, score). A domain's score
    is the mean of its items: it supports from ``SUPPORTS`` on and contradicts up to ``CONTRADICTS``. Both kinds, or a
    compound conflict that asks to abstain, make the case CONFLICTED; fewer than two domains are too little. Coherence
    is 1 - span / window within .05 and 1; items beyond the window of the first are left out. Missing scores are .5.
    """
    linked = links.groupBy(entity).agg(F.avg("confidence").alias("identity"))
    rows = items.where(F.col(entity).isNotNull()).select(entity, F.upper(F.coalesce(F.col(domain), F.lit("UNKNOWN"))).alias("dom"), F.col(event).alias("ev"), F.coalesce(F.col(score), F.lit(0.5)).alias("s"), F.col(t).alias("t"), F.col(ref).isNotNull().alias("has_ref"))
    first = rows.groupBy(entity).agg(F.min("t").alias("t0"))
    near = rows.join(first, entity).where((F.col("t") - F.col("t0")) / 1e6 <= window)
    span = near.groupBy(entity).agg(((F.max("t") - F.min("t")) / 1e6).alias("span"), F.avg(F.col("has_ref").cast("int")).alias("quality"))
    # An event is one observation, whichever domain tells of it.
    once = near.where("ev is not null").groupBy(entity, "ev").agg(F.min(F.struct("t", "dom", "s")).alias("x")).select(entity, "x.dom", "x.s").unionByName(near.where("ev is null").select(entity, "dom", "s"))
    by_domain = once.groupBy(entity, "dom").agg(F.round(F.avg("s"), 9).alias("s"))
    # At most one row a domain: pairs of an entity's domains are few.
    pairs = by_domain.select(entity, F.col("dom").alias("da"), F.col("s").alias("sa")).join(by_domain.select(entity, F.col("dom").alias("db"), F.col("s").alias("sb")), entity).where("da < db")
    clash = pairs.groupBy(entity).agg(F.max(fusion.compound_conflict(fusion.mass(F.round("sa", 3)), fusion.mass(F.round("sb", 3)))).alias("conflict"))
    n = by_domain.groupBy(entity).agg(F.count(F.lit(1)).alias("domains"), F.count_if(F.col("s") >= SUPPORTS).alias("supporting"), F.count_if(F.col("s") <= CONTRADICTS).alias("contradicting"))
    all_ = linked.join(n, entity, "left").join(span, entity, "left").join(clash, entity, "left")
    coherence = fusion.temporal_coherence(F.col("span"), window)
    conflicted = (F.col("supporting") > 0) & (F.col("contradicting") > 0) | F.coalesce(F.col("conflict") >= ABSTAIN, F.lit(False))
    raw = FUSED["domain_support"] * F.least(F.col("supporting") / TARGET_DOMAINS, F.lit(1.0)) + FUSED["temporal_coherence"] * coherence + FUSED["identity_confidence"] * F.col("identity") + FUSED["evidence_quality"] * F.col("quality") - F.when(conflicted, PENALTY).otherwise(0.0)
    gone = (F.col("identity") < LINKED) | F.col("domains").isNull()
    status = F.when(F.col("identity") < LINKED, "IDENTITY_UNCERTAIN").when(F.col("domains").isNull(), "INSUFFICIENT_EVIDENCE").when(conflicted, "CONFLICTED").when(F.col("domains") < 2, "INSUFFICIENT_EVIDENCE").otherwise("SUPPORTED")
    return all_.select(
        entity, status.alias("status"), F.when(gone, 0.0).otherwise(clip(raw, 0, 1)).alias("score"), F.when(gone, 0.95).otherwise(clip(1 - F.col("identity") * F.col("domains") / TARGET_DOMAINS, 0.05, 0.95)).alias("uncertainty"),
        *[F.when(gone, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("domains", "supporting", "contradicting")], F.when(~gone, coherence).alias("coherence"),
    )


def ordered_cases(cases: DataFrame, key: str) -> DataFrame:
    """``cases`` with ``rank``: by score, then by number of domains, then by key."""
    return cases.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("domains"), key)))  # one row an entity case


def identity_binding(records: DataFrame, source: str, entity: str, bridge: DataFrame) -> DataFrame:
    """``records`` with ``identity``: the greatest confidence of the bridge (entity, raw, confidence) for the record's source and entity; 1.0 if the source is the entity itself; else 0."""
    best = bridge.groupBy(F.col("entity").alias(entity), F.col("raw").alias(source)).agg(F.max("confidence").alias("__c"))
    return records.join(best, [entity, source], "left").withColumn("identity", F.coalesce("__c", F.when(F.col(source) == F.col(entity), 1.0), F.lit(0.0))).drop("__c")


def record_quality(file: Column, row: Column, stamp: Column, digest: Column) -> Column:
    """1 less .20 without a file, .10 without a row number, .20 without a time and .50 without a 64-character hash; 0 at least."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    lost = F.when(blank(file) | (file == "UNKNOWN"), 0.20).otherwise(0.0) + F.when(F.coalesce(row < 0, F.lit(True)), 0.10).otherwise(0.0) + F.when(blank(stamp), 0.20).otherwise(0.0) + F.when(F.coalesce(F.length(digest) != 64, F.lit(True)), 0.50).otherwise(0.0)
    return clip(1 - lost, 0, 1)


def rounded(x: Column, places: int = 4) -> Column:
    """``x`` as SQL rounds doubles: its product with the power of ten is rounded, where Spark's own round takes the digits it prints."""
    return F.round(x * 10**places, 0) / 10**places


def reliability(evidence: DataFrame, finding: str, place: str | None = None) -> DataFrame:
    """(finding, score, status, support, contradiction, corroboration) of findings from their evidence.

    ``evidence`` has the finding, ``id``, ``category`` (SUPPORTING, CONTRADICTING or else), ``cluster`` of dependent records,
    ``identity``, ``quality``, ``temporal``, ``data`` and ``provenance`` in [0, 1], and ``is_future``, ``is_duplicate``. Records of the future
    count nowhere; strengths are sums of identity, quality and time over records that are no duplicates and bound to the
    entity with at least ``LINKED``. Without any bound record a finding is INSUFFICIENT_EVIDENCE with score 0.

    Means are rounded, and some lie just between two roundings. Those of decimal columns are exact. That of ``identity``
    is a sum of doubles, which depends on their order: with ``place``, a column that orders the records, they are added
    in that order, however Spark cuts the input; without, in any.
    """
    c = F.col
    e = evidence.where(~F.coalesce(c("is_future"), F.lit(False)))
    sound = ~F.coalesce(c("is_duplicate"), F.lit(False)) & (c("identity") >= LINKED)
    weight = c("identity") * c("quality") * c("temporal")
    strength = lambda kind: F.coalesce(F.sum(F.when(sound & (c("category") == kind), weight)), F.lit(0.0))
    mean = {x: F.avg(c(x).cast("decimal(20,12)") if isinstance(evidence.schema[x].dataType, DecimalType) else x).cast("double") for x in ("identity", "temporal", "quality", "data", "provenance")}
    if place:
        e = e.withColumn("so_far", F.sum("identity").over(Window.partitionBy(finding).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        mean["identity"] = F.max_by("so_far", place) / F.count("identity")
    m = e.groupBy(finding).agg(
        rounded(clip(strength("SUPPORTING") / 2.0, 0, 1)).alias("support"), rounded(clip(strength("CONTRADICTING"), 0, 1)).alias("contradiction"),
        F.countDistinct(F.when((c("identity") >= LINKED) & (c("category") == "SUPPORTING"), c("cluster"))).alias("clusters"),
        *[rounded(v).alias(x) for x, v in mean.items()], F.count_if(c("identity") > 0).alias("bound"), F.count_if(c("identity") >= LINKED).alias("strong"),
    )
    disagree = (c("support") >= 0.25) & (c("contradiction") >= 0.25)
    severity = F.when(~disagree & (c("contradiction") == 0), "NO_CONFLICT").when(~disagree | (c("contradiction") <= 0.25), "WEAK_CONFLICT").when(c("contradiction") <= 0.60, "MODERATE_CONFLICT").otherwise("STRONG_CONFLICT")
    factor = F.create_map(*[F.lit(x) for kv in CONFLICT_PENALTY.items() for x in kv])
    corroboration = rounded(clip(c("clusters") / 3.0, 0, 1))
    m = m.withColumn("corroboration", corroboration).withColumn("severity", severity)
    base = RELIABLE["identity"] * c("identity") + RELIABLE["temporal"] * c("temporal") + RELIABLE["quality"] * c("quality") + RELIABLE["corroboration"] * c("corroboration") + RELIABLE["data"] * c("data") + RELIABLE["provenance"] * c("provenance")
    m = m.withColumn("score", rounded(clip(base - rounded(c("contradiction") * factor[c("severity")]), 0, 1)))
    weak = (c("strong") == 0) | (c("identity") < LINKED) | (c("clusters") < 2) | (c("provenance") < 0.80) | (c("temporal") < 0.70)
    status = (
        F.when(c("bound") == 0, "INSUFFICIENT_EVIDENCE").when((c("support") < 0.25) & (c("contradiction") > 0), "LOW").when(disagree | c("severity").isin("MODERATE_CONFLICT", "STRONG_CONFLICT"), "CONFLICTED")
        .when(weak, F.when((c("score") >= 0.50) & (c("identity") >= LINKED) & (c("provenance") >= 0.80) & (c("clusters") >= 1), "MEDIUM").otherwise("LOW"))
        .when((c("score") >= 0.80) & (c("identity") >= 0.85) & (c("clusters") >= 3), "HIGH").when(c("score") >= 0.50, "MEDIUM").otherwise("LOW")
    )
    return m.select(finding, F.when(c("bound") == 0, 0.0).otherwise(c("score")).alias("score"), status.alias("status"), "support", "contradiction", "corroboration")


def domain_findings(scores: dict[str, Column]) -> Column:
    """struct<score, belief, conflict>: the domains present as masses, combined in order of names, and belief plus half of what is left open; .05 where there is none."""
    there = F.filter(F.array(*[F.struct(s.alias("s")) for _, s in sorted(scores.items())]), lambda x: x["s"].isNotNull())
    m = fusion.combine_masses(F.transform(there, lambda x: fusion.mass(x["s"])))
    none = F.size(there) == 0
    return F.struct(F.when(none, 0.05).otherwise(m["a"] + 0.5 * m["t"]).alias("score"), F.when(none, 0.05).otherwise(m["a"]).alias("belief"), F.when(none, 0.0).otherwise(m["conflict"]).alias("conflict"))


def trial_metrics(trials: DataFrame, by: Sequence[str], said: str, truth: str, confidence: str) -> DataFrame:
    """(by, n, accuracy, mean_confidence, overconfidence, underconfidence, brier): an answer other than the truth, or none, is wrong; missing confidence is .5."""
    ok = F.coalesce(F.col(said) == F.col(truth), F.lit(False))
    c = clip(F.coalesce(F.col(confidence), F.lit(0.5)), 0, 1)
    y = ok.cast("double")
    return trials.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("accuracy"), F.avg(c).alias("mean_confidence"), F.avg((~ok & (c >= 0.70)).cast("double")).alias("overconfidence"), F.avg((ok & (c <= 0.40)).cast("double")).alias("underconfidence"), F.avg((c - y) * (c - y)).alias("brier"))


def propagation(traces: DataFrame, stages: str, most: int = 4) -> DataFrame:
    """One row: how many stages errors reached: mean, median, most, and the shares contained at each stage and not at all."""
    s = F.col(stages)
    return traces.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.median(s).alias("median"), F.max(s).alias("largest"), *[F.avg((s <= k).cast("double")).alias(f"contained_{k}") for k in range(most)], F.avg((s == most).cast("double")).alias("not_contained"))
