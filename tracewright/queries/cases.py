"""Queries on cases, evidence, conflict, quality and discovered sequences, each with the same in SQL where it can say it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import casework, discovery, fusion, graph, quality, temporal
from tracewright.queries import reference as R
from tracewright.streaming import runtime

QUERIES: dict = {}
SQL: dict[str, str] = {}
events, table, r7 = R.events, R.table, R.r7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ev}", R.EV)
        return f

    return add


# ---- conflict and fusion ----


def _conflict(x: str, y: str) -> str:
    """Compound conflict of two scores in SQL."""
    p = lambda s: f"round(0.8 * {s} + 0.1, 6)"
    h = f"round(sqrt(pow(sqrt({p(x)}) - sqrt({p(y)}), 2) + pow(sqrt(1 - {p(x)}) - sqrt(1 - {p(y)}), 2)) / sqrt(2.0), 4)"
    n = lambda s: f"(0.64 * {s} * {s} + 0.64 * (1 - {s}) * (1 - {s}) + 0.04)"
    c = f"round((0.64 * {x} * {y} + 0.64 * (1 - {x}) * (1 - {y}) + 0.04) / sqrt({n(x)} * {n(y)}), 4)"
    return f"round({h} * (1 - {c}), 4)"


_STATUS = "CASE WHEN {c} >= 0.38 THEN 'ABSTENTION_REQUIRED' WHEN {c} >= 0.25 THEN 'MATERIAL_CONFLICT' ELSE 'NO_MATERIAL_CONFLICT' END"


@query("WITH " + R._SCORES + f" SELECT c_custkey, {_conflict('b', 'c')} AS conflict FROM x")
def cf1_compound_conflict(spark, d):
    return R._domain_scores(spark, d).select("c_custkey", fusion.compound_conflict(fusion.mass(F.col("b")), fusion.mass(F.col("c"))).alias("conflict"))


@query(
    "WITH "
    + R._SCORES
    + f", y AS (SELECT c_custkey, CASE WHEN a IS NOT NULL THEN least(greatest(a, 0), 1) END AS a, b, c FROM x), p AS (SELECT c_custkey, 0 AS k, 'a-b' AS pair, {_conflict('a', 'b')} AS conflict FROM y WHERE a IS NOT NULL UNION ALL SELECT c_custkey, 1, 'a-c', {_conflict('a', 'c')} FROM y WHERE a IS NOT NULL UNION ALL SELECT c_custkey, 2, 'b-c', {_conflict('b', 'c')} FROM y), w AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY conflict DESC, k) AS rn FROM p) SELECT c_custkey, pair, conflict, {_STATUS.replace('{c}', 'conflict')} AS status FROM w WHERE rn = 1"
)
def cf2_worst_pairs(spark, d):
    w = casework.worst_pair({k: F.col(k) for k in "abc"})
    return R._domain_scores(spark, d).select("c_custkey", w.alias("w")).select("c_custkey", "w.pair", "w.conflict", "w.status")


@query("WITH f AS (" + R.SQL["fu2_dempster_shafer"] + ") SELECT c_custkey, CASE WHEN conflict >= 0.5 THEN 'CONFLICTED' WHEN conflict >= 0.25 THEN 'MATERIAL' ELSE 'CONSISTENT' END AS flag, CASE WHEN conflict >= 0.5 THEN 'CONFLICTED' WHEN ignorance >= 0.008 AND belief < 0.3 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS status FROM f")
def fu6_finding_status(spark, d):
    m = fusion.combine_masses(F.array(*[fusion.mass(F.col(c)) for c in "abc"]))
    x = R._domain_scores(spark, d).select("c_custkey", m.alias("m"))
    k, t, b = (F.round(F.col(c), 7) for c in ("m.conflict", "m.t", "m.a"))
    # With three domains little is left open, so ignorance counts a hundredfold here.
    return x.select("c_custkey", fusion.conflict_level(k).alias("flag"), fusion.finding_status(k, t * 100, b).alias("status"))


@query("WITH f AS (" + R.SQL["fu2_dempster_shafer"].replace(", 7)", ", 15)") + ") SELECT c_custkey, round(belief + 0.5 * ignorance, 6) AS score, round(belief, 6) AS belief, round(conflict, 6) AS conflict FROM f")
def fu10_case_scores(spark, d):
    f = casework.domain_findings({k: F.col(k) for k in "abc"})
    return R._domain_scores(spark, d).select("c_custkey", f.alias("f")).select("c_custkey", *[F.round(f"f.{c}", 6).alias(c) for c in ("score", "belief", "conflict")])


_ITEMS = "i AS (SELECT actor_id AS entity, source_domain AS dom, event_id AS ev, least(amount / 200, 1.0) AS s, t, event_id % 10 <> 0 AS has_ref FROM ev), l AS (SELECT DISTINCT actor_id AS entity, 0.6 + (actor_id % 5) * 0.1 AS identity FROM ev)"
_FUSED = (
    "WITH {ev}, "
    + _ITEMS
    + f""", f AS (SELECT entity, min(t) AS t0 FROM i GROUP BY 1), n AS (SELECT i.* FROM i JOIN f USING (entity) WHERE (t - t0) / 1e6 <= 432000), s AS (SELECT entity, (max(t) - min(t)) / 1e6 AS span, avg(has_ref::INT) AS quality FROM n GROUP BY 1),
    m AS (SELECT entity, dom, round(avg(s), 9) AS s FROM n GROUP BY 1, 2), p AS (SELECT a.entity, round(a.s, 3) AS x, round(b.s, 3) AS y FROM m a JOIN m b ON a.entity = b.entity AND a.dom < b.dom), c AS (SELECT entity, max({_conflict('x', 'y')}) AS conflict FROM p GROUP BY 1),
    k AS (SELECT entity, count(*) AS domains, count(*) FILTER (WHERE s >= 0.45) AS supporting, count(*) FILTER (WHERE s <= 0.25) AS contradicting FROM m GROUP BY 1),
    y AS (SELECT l.*, k.domains, k.supporting, k.contradicting, least(greatest(1 - span / 432000, 0.05), 1.0) AS coherence, quality, supporting > 0 AND contradicting > 0 OR coalesce(conflict >= 0.38, false) AS clash FROM l LEFT JOIN k USING (entity) LEFT JOIN s USING (entity) LEFT JOIN c USING (entity)),
    fused AS (SELECT entity, CASE WHEN identity < 0.7 THEN 'IDENTITY_UNCERTAIN' WHEN clash THEN 'CONFLICTED' WHEN domains < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'SUPPORTED' END AS status, round(CASE WHEN identity < 0.7 THEN 0 ELSE least(greatest(0.35 * least(supporting / 3.0, 1.0) + 0.25 * coherence + 0.25 * identity + 0.15 * quality - CASE WHEN clash THEN 0.35 ELSE 0 END, 0), 1) END, 6) AS score,
    round(CASE WHEN identity < 0.7 THEN 0.95 ELSE least(greatest(1 - identity * domains / 3, 0.05), 0.95) END, 6) AS uncertainty, CASE WHEN identity < 0.7 THEN 0 ELSE domains END AS domains, CASE WHEN identity < 0.7 THEN 0 ELSE supporting END AS supporting, CASE WHEN identity < 0.7 THEN 0 ELSE contradicting END AS contradicting FROM y)"""
)


def _fused(spark, d):
    e = events(spark, d)
    items = e.select(F.col("actor_id").alias("entity"), F.col("source_domain").alias("domain"), "event_id", F.least(F.col("amount") / 200, F.lit(1.0)).alias("score"), "t", F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("evidence_ref"))
    links = e.select(F.col("actor_id").alias("entity")).distinct().withColumn("confidence", F.lit(0.6) + (F.col("entity") % 5) * 0.1)
    return casework.fuse(items, links, 432000.0).withColumns({"score": F.round("score", 6), "uncertainty": F.round("uncertainty", 6)}).drop("coherence")


@query(_FUSED + " SELECT * FROM fused")
def fu8_fused_cases(spark, d):
    return _fused(spark, d)


@query(_FUSED + " SELECT entity, row_number() OVER (ORDER BY score DESC, domains DESC, entity) AS rank FROM fused")
def tk9_ordered_cases(spark, d):
    return casework.ordered_cases(_fused(spark, d), "entity").select("entity", F.col("rank").cast("bigint").alias("rank"))


# ---- reliability ----

_RL = """e AS (SELECT canonical_entity_id AS finding, CASE WHEN upper(trim(source_domain)) LIKE 'B%' THEN 'CONTRADICTING' ELSE 'SUPPORTING' END AS category, event_id AS cluster, 0.5 + (sequence_index % 6) / 10.0 AS identity, CASE WHEN metadata.duration_sec IS NULL THEN 0.5 ELSE 0.9 END AS quality, CASE WHEN "timestamp" IS NULL THEN 0.6 ELSE 1.0 END AS temporal,
    1.0 - CASE WHEN "timestamp" IS NULL THEN 0.2 ELSE 0 END AS data, CASE WHEN evidence_ref IS NULL THEN 0.0 ELSE 1.0 END AS provenance, coalesce(metadata.duration_sec % 7 = 0, false) AS dup FROM temporal_sequence WHERE canonical_entity_id IS NOT NULL AND sequence_index IS NOT NULL AND "timestamp" IS NOT NULL AND sequence_index < 100000)"""


@query(
    "WITH "
    + _RL
    + """, m AS (SELECT finding, round(least(coalesce(sum(identity * quality * temporal) FILTER (WHERE NOT dup AND identity >= 0.7 AND category = 'SUPPORTING'), 0) / 2, 1), 4) AS support, round(least(coalesce(sum(identity * quality * temporal) FILTER (WHERE NOT dup AND identity >= 0.7 AND category = 'CONTRADICTING'), 0), 1), 4) AS contradiction,
        count(DISTINCT cluster) FILTER (WHERE identity >= 0.7 AND category = 'SUPPORTING') AS clusters, round(avg(identity), 4) AS i, round(avg(temporal), 4) AS t, round(avg(quality), 4) AS q, round(avg(data), 4) AS d, round(avg(provenance), 4) AS p, count(*) FILTER (WHERE identity >= 0.7) AS strong FROM e GROUP BY 1),
    s AS (SELECT *, round(least(clusters / 3.0, 1), 4) AS corroboration, CASE WHEN NOT (support >= 0.25 AND contradiction >= 0.25) AND contradiction = 0 THEN 0.0 WHEN NOT (support >= 0.25 AND contradiction >= 0.25) OR contradiction <= 0.25 THEN 0.1 WHEN contradiction <= 0.6 THEN 0.25 ELSE 0.35 END AS f FROM m),
    z AS (SELECT *, round(least(greatest(0.25 * i + 0.15 * t + 0.15 * q + 0.2 * corroboration + 0.1 * d + 0.15 * p - round(contradiction * f, 4), 0), 1), 4) AS score FROM s)
    SELECT finding, round(score + 1e-6, 3) AS score, support, contradiction, CASE WHEN support < 0.25 AND contradiction > 0 THEN 'LOW' WHEN support >= 0.25 AND contradiction >= 0.25 THEN 'CONFLICTED' WHEN strong = 0 OR i < 0.7 OR clusters < 2 OR p < 0.8 OR t < 0.7 THEN CASE WHEN score >= 0.5 AND i >= 0.7 AND p >= 0.8 AND clusters >= 1 THEN 'MEDIUM' ELSE 'LOW' END WHEN score >= 0.8 AND i >= 0.85 AND clusters >= 3 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS status FROM z"""
)
def rl1_reliability(spark, d):
    x = table(spark, d, "temporal_sequence").where("canonical_entity_id is not null and sequence_index is not null and timestamp is not null")
    dur, ts = F.col("metadata.duration_sec"), F.col("timestamp")
    tenths = lambda when, a, b: F.when(when, F.lit(Decimal(a))).otherwise(F.lit(Decimal(b)))
    e = x.select(
        F.col("canonical_entity_id").alias("finding"), F.col("event_id").alias("id"), F.when(F.upper(F.trim("source_domain")).startswith("B"), "CONTRADICTING").otherwise("SUPPORTING").alias("category"), F.col("event_id").alias("cluster"), (F.lit(0.5) + (F.col("sequence_index") % 6) / 10.0).alias("identity"),
        tenths(dur.isNull(), "0.5", "0.9").alias("quality"), tenths(ts.isNull(), "0.6", "1.0").alias("temporal"), tenths(ts.isNull(), "0.8", "1.0").alias("data"),
        tenths(F.col("evidence_ref").isNull(), "0.0", "1.0").alias("provenance"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"), (F.col("sequence_index") >= 100000).alias("is_future"), F.coalesce(dur % 7 == 0, F.lit(False)).alias("is_duplicate"),
    )
    return casework.reliability(e, "finding", "place").select("finding", F.round(F.col("score") + 1e-6, 3).alias("score"), "support", "contradiction", "status")


@query("SELECT doc_id, round(greatest(1 - CASE WHEN coalesce(trim(contributor), '') IN ('', 'UNKNOWN') THEN 0.2 ELSE 0 END - CASE WHEN coalesce(revision_no < 3, true) THEN 0.1 ELSE 0 END - CASE WHEN revised_at IS NULL THEN 0.2 ELSE 0 END - CASE WHEN text IS NULL THEN 0.5 ELSE 0 END, 0), 6) AS quality FROM documents")
def rl3_record_quality(spark, d):
    q = casework.record_quality(F.col("contributor"), F.col("revision_no") - 3, F.col("revised_at"), F.sha2("text", 256))
    return table(spark, d, "documents").select("doc_id", F.round(q, 6).alias("quality"))


@query("WITH b AS (SELECT metadata.canonical_entity_id AS e, metadata.raw_id AS r, max(CASE WHEN metadata.is_correction THEN 0.95 ELSE 0.8 END) AS c FROM paper3_events_14a04386 GROUP BY 1, 2) SELECT r.event_id, CAST(coalesce(max(b.c), 0) AS DOUBLE) AS identity FROM paper3_events_14a04386 r LEFT JOIN b ON b.e = r.entity_id AND b.r = r.metadata.raw_id GROUP BY 1")
def rl4_identity_binding(spark, d):
    x = table(spark, d, "paper3_events_14a04386")
    bridge = x.select(F.col("metadata.canonical_entity_id").alias("entity"), F.col("metadata.raw_id").alias("raw"), F.when(F.col("metadata.is_correction"), 0.95).otherwise(0.8).alias("confidence"))
    return casework.identity_binding(x.select("event_id", F.col("entity_id").alias("who"), F.col("metadata.raw_id").alias("source")), "source", "who", bridge).groupBy("event_id").agg(F.max("identity").alias("identity"))


# ---- metrics ----


@query("WITH {ev}, s AS (SELECT actor_id % 5 AS slice, avg(amount) AS m FROM ev GROUP BY 1) SELECT count(*) AS slices, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM s")
def ag25_slices(spark, d):
    s = events(spark, d).groupBy((F.col("actor_id") % 5).alias("slice")).agg(F.avg("amount").alias("m"))
    return s.agg(F.count(F.lit(1)).alias("slices"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"))


_TRIALS = "t AS (SELECT metadata.prompt_type AS kind, upper(metadata.outcome) AS said, least(greatest(coalesce(metadata.context_snapshot.bounded_prob, 0.5), 0), 1) AS c FROM features5_6_events WHERE event_type = 'PROMPT_OUTCOME' AND metadata IS NOT NULL), u AS (SELECT *, coalesce(said = 'FOLLOWED', false)::INT AS y FROM t)"


@query("WITH " + _TRIALS + " SELECT kind, count(*) AS n, round(avg(y), 6) AS accuracy, round(avg(c), 6) AS mean_confidence, round(avg((y = 0 AND c >= 0.7)::INT), 6) AS overconfidence, round(avg((y = 1 AND c <= 0.4)::INT), 6) AS underconfidence, round(avg((c - y) * (c - y)), 6) AS brier FROM u GROUP BY 1")
def ag28_trial_calibration(spark, d):
    t = table(spark, d, "features5_6_events").where("event_type = 'PROMPT_OUTCOME' and metadata is not null").select(F.col("metadata.prompt_type").alias("kind"), F.upper("metadata.outcome").alias("said"), F.lit("FOLLOWED").alias("truth"), F.col("metadata.context_snapshot.bounded_prob").alias("c"))
    m = casework.trial_metrics(t, ["kind"], "said", "truth", "c")
    return m.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_confidence", "overconfidence", "underconfidence", "brier")])


@query("WITH s AS (SELECT revision_no % 5 AS s FROM documents WHERE revision_no IS NOT NULL) SELECT count(*) AS n, round(avg(s), 6) AS mean, median(s) AS median, CAST(max(s) AS INT) AS largest, round(avg((s <= 0)::INT), 6) AS contained_0, round(avg((s <= 1)::INT), 6) AS contained_1, round(avg((s <= 2)::INT), 6) AS contained_2, round(avg((s <= 3)::INT), 6) AS contained_3, round(avg((s = 4)::INT), 6) AS not_contained FROM s")
def ag29_propagation(spark, d):
    p = casework.propagation(table(spark, d, "documents").where("revision_no is not null").select((F.col("revision_no") % 5).alias("s")), "s")
    return p.select("n", F.round("mean", 6).alias("mean"), "median", "largest", *[F.round(c, 6).alias(c) for c in ("contained_0", "contained_1", "contained_2", "contained_3", "not_contained")])


_FOLD = (
    R._DAILY
    + """, o AS (SELECT actor_id, d, v, row_number() OVER (PARTITION BY actor_id ORDER BY d) AS k FROM day),
    r AS (SELECT actor_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS d, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS var, 0 AS drifts, 0 AS odd, false AS adapting, CAST(NULL AS DOUBLE) AS z, '' AS state FROM (SELECT DISTINCT actor_id FROM day)
    UNION ALL SELECT actor_id, k, d, CASE WHEN k <= 5 THEN mean + (v - mean) / k WHEN z > 3 THEN mean ELSE mean + 0.15 * (v - mean) END,
        CASE WHEN k = 1 THEN 1.0 WHEN k <= 5 THEN greatest(var + ((v - mean) * (v - (mean + (v - mean) / k)) - var) / k, 1e-4) WHEN z > 3 THEN var ELSE greatest(0.85 * (var + 0.15 * (v - mean) * (v - mean)), 1e-4) END,
        CASE WHEN k <= 5 THEN 0 WHEN z > 3 THEN 0 WHEN z > 1.5 THEN drifts + 1 WHEN adapting THEN 0 ELSE drifts END, CASE WHEN k <= 5 THEN 0 WHEN z > 3 THEN odd + 1 ELSE 0 END,
        CASE WHEN k <= 5 THEN false WHEN z > 3 THEN adapting WHEN z > 1.5 THEN adapting OR drifts + 1 >= 2 ELSE false END, CASE WHEN k > 5 THEN z END,
        CASE WHEN k <= 5 THEN 'COLD_START' WHEN z > 3 THEN CASE WHEN odd + 1 >= 2 THEN 'QUARANTINED' ELSE 'EXCLUDED' END WHEN z > 1.5 AND (adapting OR drifts + 1 >= 2) THEN 'ADAPTING' ELSE 'STABLE' END
    FROM (SELECT r.actor_id, o.k, o.d, o.v, r.mean, r.var, r.drifts, r.odd, r.adapting, abs(o.v - r.mean) / sqrt(r.var) AS z FROM r JOIN o ON o.actor_id = r.actor_id AND o.k = r.k + 1))"""
)


def _tracked(spark, d):
    daily = R._daily(spark, d).withColumn("d", F.date_format("d", "yyyy-MM-dd"))
    return runtime.adaptive_baseline(daily, "actor_id", "d", "v")


@query("WITH RECURSIVE {ev}, " + _FOLD + " SELECT actor_id, strftime(d, '%Y-%m-%d') AS d, round(z, 3) AS z, state, round(mean, 4) AS mean FROM r WHERE k > 0")
def wn4_adaptive_baseline(spark, d):
    return _tracked(spark, d).select("actor_id", "d", F.round("z", 3).alias("z"), "state", F.round("mean", 4).alias("mean"))


@query("WITH RECURSIVE {ev}, " + _FOLD + " SELECT actor_id, count(*) AS observations, count(*) FILTER (WHERE state IN ('EXCLUDED', 'QUARANTINED')) AS kept_out, arg_max(state, d) AS state, round(arg_max(mean, d), 5) AS mean FROM r WHERE k > 0 GROUP BY 1")
def wn5_baseline_states(spark, d):
    t = _tracked(spark, d)
    return t.groupBy("actor_id").agg(F.count(F.lit(1)).alias("observations"), F.count_if(F.col("state").isin("EXCLUDED", "QUARANTINED")).alias("kept_out"), F.max_by("state", "d").alias("state"), F.round(F.max_by("mean", "d"), 5).alias("mean"))


# ---- sequences ----


@query(
    "WITH {ev}, b AS (SELECT actor_id, row_number() OVER w - 1 AS s, event_type AS l0, " + ", ".join(f"lead(event_type, {k}) OVER w AS l{k}" for k in range(1, 5)) + " FROM ev WINDOW w AS (PARTITION BY actor_id ORDER BY t, event_id)) SELECT concat('SUB_', actor_id, '_', s, '_L3') AS id, concat_ws('>', l0, l1, l2) AS types FROM b WHERE l2 IS NOT NULL UNION ALL SELECT concat('SUB_', actor_id, '_', s, '_L4'), concat_ws('>', l0, l1, l2, l3) FROM b WHERE l3 IS NOT NULL UNION ALL SELECT concat('SUB_', actor_id, '_', s, '_L5'), concat_ws('>', l0, l1, l2, l3, l4) FROM b WHERE l4 IS NOT NULL"
)
def seq9_subsequences(spark, d):
    return discovery.subsequences(events(spark, d), 3, 5).select("id", F.array_join("types", ">").alias("types"))


@query()
def seq12_motifs(spark, d):
    """Recurring parts of each user's sequence, clustered by complete linkage, with their representatives."""
    return discovery.discover(discovery.subsequences(events(spark, d), 3, 4))


@query("WITH {ev}, s AS (SELECT actor_id, t - lag(t) OVER (PARTITION BY actor_id ORDER BY event_id) AS s, t FROM ev) SELECT actor_id, count(*) AS length, count(*) FILTER (WHERE s < 0) AS backwards, count(*) FILTER (WHERE s = 0) AS ties, round((max(t) - min(t)) / 1e6, 4) AS span_s, count(*) FILTER (WHERE s < 0) = 0 AS valid FROM s GROUP BY 1")
def seq14_sequence_health(spark, d):
    return discovery.sequence_health(events(spark, d)).withColumn("span_s", F.round("span_s", 4))


_CODES = {"click": 0.0, "view": 1 / 6, "error": 2 / 6, "purchase": 3 / 6, "signup": 4 / 6}


@query("WITH {ev}, e AS (SELECT actor_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY 1) SELECT event_id, round(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END / 6.0, 7) AS c0, round(CASE source_domain WHEN 'IPDR' THEN 1 WHEN 'BANK' THEN 2 WHEN 'SOCIAL' THEN 3 ELSE 0 END / 3.0, 7) AS c1, round((t - lo) / greatest(hi - lo, 0.001), 7) AS c2, round(least(amount / 100000, 1.0), 7) AS c3 FROM ev JOIN e USING (actor_id)")
def seq4_encoded(spark, d):
    x = discovery.encoded(events(spark, d), _CODES, {"CDR": 0.0, "IPDR": 1 / 3, "BANK": 2 / 3, "SOCIAL": 1.0})
    return x.select("event_id", *[r7(F.get("code", F.lit(k)), f"c{k}") for k in range(4)])


def _compared(spark, d):
    g = temporal.gaps(events(spark, d))
    s = g.groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type", F.coalesce("gap_s", F.lit(1.0)).alias("g")))).alias("x")).select("actor_id", F.col("x.event_type").alias("a"), F.col("x.g").alias("ga"))
    other = s.select((F.col("actor_id") - 1).alias("actor_id"), F.col("a").alias("b"), F.col("ga").alias("gb"))
    return discovery.compared(s.join(other, "actor_id"), "a", "b", "ga", "gb")


@query(
    "WITH {ev}, s AS (SELECT actor_id, string_agg(CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'error' THEN 'c' WHEN 'purchase' THEN 'd' ELSE 'e' END, '' ORDER BY t, event_id) AS w, list(event_type ORDER BY t, event_id) AS l FROM ev GROUP BY 1), g AS (SELECT *, list_distinct(list_transform(range(1, len(l)), lambda i: concat(l[i], '>', l[i + 1]))) AS g FROM s) SELECT a.actor_id, levenshtein(a.w, b.w) AS edit_distance, round(1 - levenshtein(a.w, b.w) / greatest(len(a.w), len(b.w), 1), 4) AS similarity, len(list_filter(a.g, lambda q: list_contains(b.g, q))) AS common FROM g a JOIN g b ON b.actor_id = a.actor_id + 1"
)
def seq7_compared(spark, d):
    """Each user's whole sequence against the next user's; the timing distance has no SQL and is left out here (see seq7_timing)."""
    return _compared(spark, d).select("actor_id", F.col("edit_distance").cast("bigint").alias("edit_distance"), "similarity", F.size("common_patterns").cast("bigint").alias("common"))


@query()
def seq7_timing(spark, d):
    return _compared(spark, d).select("actor_id", "timing_distance")


# ---- quality ----


@query("SELECT round(least(sum((upper(trim(source_domain)) NOT IN ('CDR', 'IPDR', 'BANK', 'SOCIAL', 'IAM'))::INT + (event_type IS NULL)::INT) / count(*), 1.0), 6) AS rate FROM temporal_sequence")
def dq1_schema_validity(spark, d):
    x = table(spark, d, "temporal_sequence").select(F.upper(F.trim("source_domain")).alias("dom"), F.when(F.col("event_type").isNotNull(), "known").alias("typ"))
    return quality.vocabulary_rate(x, {"dom": ["CDR", "IPDR", "BANK", "SOCIAL", "IAM"], "typ": ["known"]}).select(F.round("rate", 6).alias("rate"))


@query("SELECT count(*) FILTER (WHERE text IS NULL) AS bad, CASE WHEN count(*) FILTER (WHERE text IS NULL) = 0 THEN 'HEALTHY' ELSE 'DEGRADED' END AS status FROM documents")
def dq7_provenance(spark, d):
    return quality.hash_status(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("WITH x AS (SELECT source, count(*) AS received, count(*) FILTER (WHERE n_chars > 500) AS accepted, count(*) FILTER (WHERE n_chars <= 500) AS rejected FROM documents GROUP BY 1) SELECT source, round(rejected / received, 6) AS rate, CASE WHEN received <> accepted + rejected THEN 'CRITICAL' WHEN rejected / received > 0.20 THEN 'CRITICAL' WHEN rejected / received > 0.05 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM x")
def dq11_rejections(spark, d):
    c = F.col
    x = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("received"), F.count_if(c("n_chars") > 500).alias("accepted"), F.count_if(c("n_chars") <= 500).alias("rejected"))
    return quality.rejection_status(x, c("received"), c("accepted"), c("rejected")).select("source", F.round("rate", 6).alias("rate"), "status")


@query("WITH r AS (SELECT 'completeness' AS dimension, sum((home_city IS NULL OR trim(home_city) = '')::INT + (phone_number IS NULL OR trim(phone_number) = '')::INT) / (count(*) * 2.0) AS rate, 0.05 AS lo, 0.20 AS hi FROM entity_profile UNION ALL SELECT 'duplicate', (count(*) - count(DISTINCT canonical_entity_id)) / count(*), 0.01, 0.15 FROM entity_profile), s AS (SELECT dimension, rate, CASE WHEN rate > hi THEN 'CRITICAL' WHEN rate > lo THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM r) SELECT dimension, round(rate, 6) AS rate, status FROM s UNION ALL SELECT 'overall', NULL, CASE WHEN bool_or(status = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(status = 'DEGRADED') THEN 'DEGRADED' ELSE 'HEALTHY' END FROM s")
def dq14_source_health(spark, d):
    p = table(spark, d, "entity_profile")
    part = lambda df, name: df.select(F.lit(name).alias("dimension"), F.col("rate").cast("double").alias("rate"), quality.level(F.col("rate"), name).alias("status"))
    h = quality.source_health([part(quality.missing_rate(p, ["home_city", "phone_number"]), "completeness"), part(quality.duplicate_rate(p, ["canonical_entity_id"]), "duplicate")])
    return h.withColumn("rate", F.round("rate", 6))


# ---- graph, provenance ----


@query("WITH {ev} SELECT event_id, actor_id AS src, target_id AS dst FROM ev WHERE actor_id % 3 <> 0 AND target_id % 3 <> 0 AND target_id IN (SELECT actor_id FROM ev)")
def gr2_recorded_edges(spark, d):
    """Edges both of whose ends are recorded; a third of the nodes is not."""
    e = graph.edges_of(events(spark, d))
    return graph.recorded_edges(e, e.select(F.col("src").alias("id")).where("id % 3 <> 0")).select("event_id", "src", "dst")


@query("WITH {ev} SELECT event_id FROM ev ORDER BY t DESC, event_id DESC LIMIT 1000")
def gr3_bounded_state(spark, d):
    """The feature is the bound: a graph of more than 2,000 events keeps the newest thousand."""
    return graph.bounded_state(events(spark, d), 2000).select("event_id")


@query("WITH {ev}, x AS (SELECT actor_id AS id, 1 AS o, 0 AS i FROM ev UNION ALL SELECT target_id, 0, 1 FROM ev) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x WHERE id = 7 GROUP BY 1")
def gr4_node_profile(spark, d):
    return graph.vertices_of(graph.edges_of(events(spark, d))).where("id = 7")


@query("WITH RECURSIVE " + R._SPARSE + ", r AS (SELECT id, 0 AS hop FROM s0 UNION SELECT n.dst, hop + 1 FROM r JOIN n ON n.src = r.id WHERE hop < 8), m AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1), c AS (SELECT hop, sum(count(*)) OVER (ORDER BY hop) AS total FROM m GROUP BY 1) SELECT id, CAST(hop AS INT) AS hop FROM m WHERE hop <= (SELECT coalesce(min(hop), 99) FROM c WHERE total >= 100)")
def gr14_grown_subgraph(spark, d):
    e = R._sparse(spark, d)
    return graph.grown(e, e.where("src <> dst").agg(F.min("src").alias("id")), 100)


@query("SELECT DISTINCT f.finding_id AS src, e.evidence_ref AS dst FROM (SELECT unnest(metadata.context_snapshot.findings) AS f FROM features5_6_events), LATERAL (SELECT unnest(f.evidence) AS e) WHERE f.finding_id IS NOT NULL AND e.evidence_ref IS NOT NULL")
def gr17_evidence_graph(spark, d):
    f = table(spark, d, "features5_6_events").select(F.explode("metadata.context_snapshot.findings").alias("f")).select("f.finding_id", F.explode("f.evidence").alias("e"))
    return f.where("finding_id is not null and e.evidence_ref is not null").select(F.col("finding_id").alias("src"), F.col("e.evidence_ref").alias("dst")).distinct()


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, parent_doc_id, coalesce(doc_id % 97 <> 0, false) AS own FROM documents), w AS (SELECT doc_id AS node, own, parent_doc_id AS up, false AS gone, false AS bad FROM d UNION ALL SELECT w.node, w.own, d.parent_doc_id, w.gone OR d.doc_id IS NULL, w.bad OR NOT coalesce(d.own, true) FROM w LEFT JOIN d ON d.doc_id = w.up WHERE w.up IS NOT NULL)
    SELECT node, CASE WHEN NOT own THEN 'TAMPERED' WHEN gone THEN 'MISSING_ANCESTOR' WHEN bad THEN 'ANCESTOR_TAMPERED' ELSE 'VERIFIED' END AS status FROM w WHERE up IS NULL"""
)
def gr19_integrity(spark, d):
    return graph.verified(table(spark, d, "documents"), "doc_id", "parent_doc_id", F.col("doc_id") % 97 != 0)


# ---- texts, digests ----


@query("WITH p AS (SELECT doc_id, page_title AS a, edit_summary AS b FROM documents WHERE page_title IS NOT NULL AND edit_summary IS NOT NULL) SELECT doc_id, CASE WHEN trim(a) = trim(b) THEN 'same' WHEN trim(a) = '' OR trim(b) = '' THEN 'blank' ELSE 'other' END AS kind FROM p")
def str4_text_kinds(spark, d):
    p = table(spark, d, "documents").where("page_title is not null and edit_summary is not null")
    p = S.ngram_cosine(p, "page_title", "edit_summary", "s")
    kind = F.when(F.col("s") == 1, "same").when((F.trim("page_title") == "") | (F.trim("edit_summary") == ""), "blank").otherwise("other")
    return p.select("doc_id", kind.alias("kind"))


@query()
def str4_cosines(spark, d):
    """n-gram cosine of every document's title and edit summary."""
    return S.ngram_cosine(table(spark, d, "documents"), "page_title", "edit_summary", "cosine").select("doc_id", "cosine")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(edit_summary), 'revert|undo|rv') THEN 'history' END, CASE WHEN regexp_matches(lower(edit_summary), 'ref|source|cite') THEN 'evidence' END, CASE WHEN regexp_matches(lower(edit_summary), 'link') THEN 'network' END], lambda x: x IS NOT NULL), ',') AS tools FROM documents WHERE edit_summary IS NOT NULL")
def str7_routes(spark, d):
    t = S.routed(F.col("edit_summary"), [("history", "revert|undo|rv"), ("evidence", "ref|source|cite"), ("network", "link")])
    return table(spark, d, "documents").where("edit_summary is not null").select("doc_id", F.array_join(t, ",").alias("tools"))


@query("SELECT doc_id, CASE lower(trim(lang)) WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' ELSE 'und' END AS code FROM documents")
def str8_languages(spark, d):
    return table(spark, d, "documents").select("doc_id", S.mapped(F.lower(F.trim("lang")), {"en": "eng", "de": "deu", "es": "spa", "fr": "fra"}, "und").alias("code"))


@query("""SELECT o_orderkey, sha256(concat('{"customer":', o_custkey, ',"priority":"', o_orderpriority, '","status":"', o_orderstatus, '"}')) AS digest FROM orders""")
def snk5_packet_digests(spark, d):
    """Digests of packets in a fixed order of fields; what changes afterwards does not count."""
    o = table(spark, d, "orders")
    digest = S.payload_digest({"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "customer": F.col("o_custkey"), "status_detail": F.lit("open")})
    return o.select("o_orderkey", digest.alias("digest"))


@query("SELECT case_id, count(*) AS n_events, count(DISTINCT entity_id) AS n_entities, count(DISTINCT officer_id) AS n_officers, arg_min(event_id, delivery_id) AS first_event FROM features5_6_events WHERE case_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1")
def snk4_dossiers(spark, d):
    """One flat row a case."""
    x = table(spark, d, "features5_6_events").where("case_id is not null and event_id is not null")
    return x.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("officer_id").alias("n_officers"), F.min_by("event_id", "delivery_id").alias("first_event"))


@query("WITH " + R._SCORES + ", y AS (SELECT c_custkey, list_filter([a, b, c], lambda v: v IS NOT NULL) AS s FROM x) SELECT c_custkey, round(list_sum(list_transform(s, lambda v: (v - 0.5) / len(s))), 6) AS attribution FROM y")
def ml6_snapshot_attribution(spark, d):
    """The sum of (v - 0.5) / n over the values there."""
    there = F.array_compact(F.array(*[F.col(k) for k in "abc"]))
    parts = F.transform(there, lambda v: (v - 0.5) / F.size(there))
    return R._domain_scores(spark, d).select("c_custkey", F.round(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), 6).alias("attribution"))
