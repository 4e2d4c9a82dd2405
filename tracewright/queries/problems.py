"""The general training-data problems as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.operators import cdc, dedupe, feature_table, nested
from tracewright.session import materialize


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/features5_6_events.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of a message that was delivered before."""
    log = _messages(spark, d).select("delivery_id", "event_id")
    return dedupe.repeated_deliveries(log, N.canonical_uuid(F.col("event_id")), [F.col("delivery_id")]).select("delivery_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """Exactly one delivery of every message, with its identifier and time in one spelling."""
    log = _messages(spark, d).select("delivery_id", "event_id", "timestamp")
    kept = dedupe.deduplicate(log, N.canonical_uuid(F.col("event_id")), [F.col("delivery_id")])
    return kept.select("delivery_id", N.canonical_uuid(F.col("event_id")).alias("event_id"), N.instant_millis(F.col("timestamp")).alias("ts_millis"))


def p1_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """What the deliveries of the latest month add to those stored before: one delivery of each message not stored yet."""
    log = _messages(spark, d).select("delivery_id", "event_id", F.date_trunc("month", "received_at").alias("month"))
    last = log.agg(F.max("month").alias("month"))  # one row
    stored = log.join(F.broadcast(last), "month", "left_anti").select("delivery_id", "event_id", F.lit(0).alias("is_new"))
    new = log.join(F.broadcast(last), "month", "left_semi").select("event_id", "delivery_id", F.lit(1).alias("is_new"), "month")
    kept = dedupe.deduplicate(stored, N.canonical_uuid(F.col("event_id")), [F.col("is_new"), F.col("delivery_id")], new)
    return kept.where("is_new = 1").select("delivery_id")


def _flat(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    shown = _messages(spark, d).where("event_type = 'PROMPT_SHOWN'").select("delivery_id", "event_id", "metadata", "metadata_json")
    once = dedupe.deduplicate(shown, N.canonical_uuid(F.col("event_id")), [F.col("delivery_id")])
    record, kind = nested.merged_record(shown, "metadata", "metadata_json")
    # Written once, as every table of the result is read from it.
    once = materialize(once.select("delivery_id", N.canonical_uuid(F.col("event_id")).alias("event_id"), record.alias("record")))
    return nested.flatten(once, ["delivery_id", "event_id"], F.col("record"), kind, "prompts", carry=["decision_id", "finding_id"])


def _child(tables: dict[str, DataFrame], end: str) -> DataFrame:
    return next(t for n, t in tables.items() if n.endswith(end))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each evidence object below a finding, once per message; a finding without any gives one row with ''."""
    tables = _flat(spark, d)
    evidence = _child(tables, "evidence").select("event_id", "decision_id", "finding_id", F.coalesce("evidence_ref", F.lit("")).alias("evidence_ref"))
    bare = _child(tables, "findings").where("n_evidence = 0").select("event_id", "decision_id", "finding_id", F.lit("").alias("evidence_ref"))
    return evidence.unionByName(bare)


def p3_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The root table: one row per prompt message."""
    t = _flat(spark, d)["prompts"]
    return t.select("event_id", "row_key", "decision_id", "prompt_type", F.col("context_snapshot_case_id").alias("case_id"), F.col("context_snapshot_findings_count").cast("bigint").alias("findings_count"), F.col("n_context_snapshot_findings").cast("bigint").alias("n_findings"))


def p3_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings table, each row with its prompt's key and its place in the list."""
    t = _child(_flat(spark, d), "findings")
    return t.select("event_id", "row_key", "parent_key", F.col("ordinal").cast("bigint").alias("ordinal"), "decision_id", "finding_id", "severity", F.col("score").cast("double").alias("score"), F.col("n_evidence").cast("bigint").alias("n_evidence"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.read.parquet(f"{d}/domain_alias.parquet").select(F.col("alias_name").alias("__alias"), F.col("source_domain").alias("__domain"))
    raw = spark.read.parquet(f"{d}/temporal_sequence.parquet")
    named = raw.select(
        "event_id",
        N.blank_to_null(F.col("canonical_entity_id")).alias("canonical_entity_id"),
        N.event_type_name(F.col("event_type")).alias("event_type"),
        F.upper(F.trim("source_domain")).alias("__alias"),
        F.floor(N.epoch_seconds(F.col("epoch_time"), F.col("timestamp"))).alias("epoch"),
        N.cents(F.col("metadata.amount")).alias("cents"),
    )
    # The alias table is fixed at 14 rows.
    return named.join(F.broadcast(alias), "__alias", "left").withColumn("source_domain", F.coalesce("__domain", "__alias")).drop("__alias", "__domain")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    entities = spark.read.parquet(f"{d}/entity_profile.parquet").select("canonical_entity_id")
    return feature_table.feature_blocks(_events(spark, d), "canonical_entity_id", ["event_type", "source_domain"], "event_id", "epoch", "cents", entities)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Count, latest time and total of every (entity, event type, domain) with an event."""
    cells = feature_table.long_features(_blocks(spark, d), "canonical_entity_id")
    return cells.select("canonical_entity_id", "event_type", "source_domain", "n_events", F.col("last_at").alias("last_epoch"), F.col("total").alias("total_cents"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity: how many types and events it has, its latest time and total."""
    whole = _blocks(spark, d)
    cells = feature_table.long_features(whole, "canonical_entity_id")
    sums = cells.groupBy("canonical_entity_id").agg(F.countDistinct("event_type").alias("n_types"), F.sum("n_events").alias("n_events"), F.max("last_at").alias("last_epoch"), F.sum("total").alias("total_cents"))
    return whole.select("canonical_entity_id").join(sums, "canonical_entity_id", "left").select("canonical_entity_id", F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce("n_events", F.lit(0)).alias("n_events"), "last_epoch", F.coalesce("total_cents", F.lit(0)).alias("total_cents"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity with count, latest time and total of every event type there is, a column each."""
    whole = _blocks(spark, d)
    # The vocabulary: some hundreds of types.
    types = [r[0] for r in feature_table.long_features(whole, "canonical_entity_id").select("event_type").distinct().orderBy("event_type").collect()]
    return feature_table.wide_features(whole, "canonical_entity_id", types)


def _links(spark: SparkSession, d: str) -> DataFrame:
    moves = _messages(spark, d).where("event_type LIKE 'IDENTITY\\_%'").select(
        "delivery_id", "case_id", "entity_id", "officer_id", "reason", N.canonical_uuid(F.col("event_id")).alias("event_id"), N.instant_millis(F.col("timestamp")).alias("at"), N.state_name(F.col("previous_state")).alias("previous_state"), N.state_name(F.col("requested_state")).alias("requested_state")
    )
    once = spark.sql(
        """SELECT m.* FROM (SELECT min_by(struct(*), delivery_id) AS m FROM {moves} GROUP BY coalesce(event_id, concat('#', delivery_id)))""",
        moves=moves,
    )
    # Written once, as the ordering and its result both read it.
    once = materialize(once)
    ranked = cdc.rank_simultaneous(once, ["case_id", "entity_id"], "at", "previous_state", "requested_state", "delivery_id")
    return spark.sql(
        """SELECT case_id, entity_id, seq, nullif(requested_state, 'NONE') AS current_state, officer_id, reason,
                  CASE WHEN requested_state IS NULL OR requested_state = 'NONE' THEN 'D' WHEN previous_state = 'NONE' THEN 'R' ELSE 'U' END AS op FROM {ranked}""",
        ranked=ranked,
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each link present after all changes, with its state."""
    return cdc.apply_changes(_links(spark, d), ["case_id", "entity_id"], ["current_state"], "seq")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Each link present with its state and the last officer and reason named since it was made anew (a change from NONE replaces it)."""
    return cdc.apply_changes(_links(spark, d), ["case_id", "entity_id"], ["current_state", "officer_id", "reason"], "seq")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_arrivals, p3_found, p3_prompts, p3_findings, p4_found, p4_entities, p4_wide, p5_found, p5_links)}


_UUID = "lower(regexp_replace(regexp_replace(trim({c}), '^urn:uuid:', '', 'i'), '[{{}} -]', '', 'g'))".replace("{{}}", "{}")
_DASHED = "regexp_replace({u}, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_MS = """CASE WHEN regexp_matches(trim("timestamp"), '^[0-9]+$') THEN CAST(trim("timestamp") AS BIGINT)
     WHEN regexp_matches("timestamp", '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN epoch_ms(CAST(regexp_replace("timestamp", '([+-][0-9][0-9])([0-9][0-9])$', '\\1:\\2') AS TIMESTAMPTZ))
     ELSE epoch_ms(CAST("timestamp" AS TIMESTAMP)) END"""
_EVENT_ID = _DASHED.replace("{u}", _UUID.replace("{c}", "event_id"))

_FLAT = f"""
WITH m AS (
    SELECT *, {_EVENT_ID} AS uid, row_number() OVER (PARTITION BY coalesce({_EVENT_ID}, CAST(delivery_id AS VARCHAR)) ORDER BY delivery_id) AS rn
    FROM features5_6_events WHERE event_type = 'PROMPT_SHOWN'
), j AS (
    SELECT delivery_id, uid, CASE WHEN metadata IS NOT NULL THEN CAST(to_json(metadata) AS JSON) ELSE CAST(metadata_json AS JSON) END AS r FROM m WHERE rn = 1
), p AS (
    SELECT delivery_id, uid, r, r->>'$.decision_id' AS decision_id,
           CASE json_type(r->'$.context_snapshot.findings') WHEN 'OBJECT' THEN [r->'$.context_snapshot.findings'] WHEN 'ARRAY' THEN CAST(r->'$.context_snapshot.findings' AS JSON[]) ELSE [] END AS fs FROM j
), f AS (
    SELECT delivery_id, uid, decision_id, CAST(i - 1 AS BIGINT) AS ordinal, fs[i] AS x,
           CASE json_type(fs[i]->'$.evidence') WHEN 'OBJECT' THEN [fs[i]->'$.evidence'] WHEN 'ARRAY' THEN CAST(fs[i]->'$.evidence' AS JSON[]) ELSE [] END AS es
    FROM p, LATERAL (SELECT unnest(range(1, len(fs) + 1)) AS i) WHERE json_type(fs[i]) = 'OBJECT'
), g AS (
    SELECT *, x->>'$.finding_id' AS finding_id, list_filter(es, lambda e: json_type(e) = 'OBJECT') AS ev FROM f
)
"""
_CELLS = """
WITH e AS (
    SELECT event_id, canonical_entity_id, translate(upper(trim(event_type)), ' -', '__') AS event_type, a.source_domain,
           CAST(floor(coalesce(CASE WHEN epoch_time > 1e11 THEN epoch_time / 1e3 ELSE epoch_time END, epoch("timestamp"))) AS BIGINT) AS ms,
           CASE WHEN isnan(metadata.amount) OR isinf(metadata.amount) THEN 0 ELSE coalesce(CAST(round(metadata.amount * 100) AS BIGINT), 0) END AS cents,
           row_number() OVER (PARTITION BY event_id ORDER BY 1) AS rn
    FROM temporal_sequence t LEFT JOIN domain_alias a ON a.alias_name = upper(trim(t.source_domain))
    WHERE canonical_entity_id IS NOT NULL AND event_type IS NOT NULL
), cells AS (
    SELECT canonical_entity_id, event_type, source_domain, count(*) AS n_events, max(ms) AS last_epoch, CAST(sum(cents) AS BIGINT) AS total_cents
    FROM e WHERE rn = 1 GROUP BY ALL
)
"""
# Changes of one instant are taken one by one, whatever their number; what they leave to officer and reason is folded along.
_CHANGES = f"""
WITH RECURSIVE d AS (
    SELECT case_id, entity_id, {_MS} AS ms, upper(trim(previous_state)) AS b, coalesce(upper(trim(requested_state)), 'NONE') AS a, officer_id, reason, delivery_id,
           row_number() OVER (PARTITION BY coalesce({_EVENT_ID}, CAST(delivery_id AS VARCHAR)) ORDER BY delivery_id) AS rn
    FROM features5_6_events WHERE event_type LIKE 'IDENTITY!_%' ESCAPE '!'
), c AS (
    SELECT case_id, entity_id, ms, b, a, min(delivery_id) AS t, CASE WHEN a = 'NONE' THEN 'D' WHEN b = 'NONE' THEN 'R' ELSE 'U' END AS op,
           CASE WHEN b = 'NONE' THEN arg_max_null(officer_id, delivery_id) ELSE arg_max(officer_id, delivery_id) FILTER (WHERE officer_id IS NOT NULL) END AS o,
           CASE WHEN b = 'NONE' THEN arg_max_null(reason, delivery_id) ELSE arg_max(reason, delivery_id) FILTER (WHERE reason IS NOT NULL) END AS r
    FROM d WHERE rn = 1 GROUP BY case_id, entity_id, ms, b, a
), steps AS (
    SELECT case_id, entity_id, dense_rank() OVER (PARTITION BY case_id, entity_id ORDER BY ms) AS k, list(struct_pack(t := t, b := b, a := a, op := op, o := o, r := r) ORDER BY t) AS cs FROM c GROUP BY case_id, entity_id, ms
), walk AS (
    SELECT case_id, entity_id, CAST(0 AS BIGINT) AS k, 0 AS i, 'NONE' AS s, CAST(NULL AS VARCHAR) AS officer, CAST(NULL AS VARCHAR) AS reason, (SELECT list_filter(any_value(cs), lambda x: false) FROM steps) AS todo FROM (SELECT DISTINCT case_id, entity_id FROM c)
    UNION ALL
    SELECT case_id, entity_id, k, i + 1, p.a,
           CASE p.op WHEN 'D' THEN NULL WHEN 'R' THEN p.o ELSE coalesce(p.o, officer) END, CASE p.op WHEN 'D' THEN NULL WHEN 'R' THEN p.r ELSE coalesce(p.r, reason) END, list_filter(cs, lambda x: x.t <> p.t)
    FROM (
        SELECT *, coalesce(list_filter(cs, lambda x: x.b = s)[1], list_filter(cs, lambda x: NOT coalesce(list_contains(list_transform(list_filter(cs, lambda y: y.t <> x.t), lambda y: y.a), x.b), false))[1], cs[1]) AS p
        FROM (
            SELECT w.case_id, w.entity_id, w.k, w.i, w.s, w.officer, w.reason, w.todo AS cs FROM walk w WHERE len(w.todo) > 0
            UNION ALL
            SELECT w.case_id, w.entity_id, x.k, 0, w.s, w.officer, w.reason, x.cs FROM walk w JOIN steps x ON x.case_id IS NOT DISTINCT FROM w.case_id AND x.entity_id IS NOT DISTINCT FROM w.entity_id AND x.k = w.k + 1 WHERE coalesce(len(w.todo), 0) = 0
        )
    )
), last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY case_id, entity_id ORDER BY k DESC, i DESC) = 1)
"""

SQL = {
    "p1_found": f"""SELECT delivery_id FROM (SELECT delivery_id, event_id, row_number() OVER (PARTITION BY {_EVENT_ID} ORDER BY delivery_id) AS rn FROM features5_6_events)
                    WHERE event_id IS NOT NULL AND rn > 1""",
    "p1_kept": f"""SELECT delivery_id, {_EVENT_ID} AS event_id, {_MS} AS ts_millis
                   FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({_EVENT_ID}, CAST(delivery_id AS VARCHAR)) ORDER BY delivery_id) AS rn FROM features5_6_events) WHERE rn = 1""",
    "p1_arrivals": f"""WITH m AS (SELECT *, {_EVENT_ID} AS uid, date_trunc('month', received_at) IS NOT DISTINCT FROM (SELECT max(date_trunc('month', received_at)) FROM features5_6_events) AS is_new FROM features5_6_events),
                       r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(uid, CAST(delivery_id AS VARCHAR)) ORDER BY is_new, delivery_id) AS rn FROM m) SELECT delivery_id FROM r WHERE is_new AND rn = 1""",
    "p3_found": _FLAT + """SELECT uid AS event_id, decision_id, finding_id, e.r->>'$.evidence_ref' AS evidence_ref FROM g, LATERAL (SELECT unnest(ev) AS r) e
                           UNION ALL SELECT uid, decision_id, finding_id, '' FROM g WHERE len(ev) = 0""",
    "p3_prompts": _FLAT + """SELECT uid AS event_id, concat(delivery_id, '/', coalesce(uid, '')) AS row_key, decision_id, r->>'$.prompt_type' AS prompt_type, r->>'$.context_snapshot.case_id' AS case_id,
                             CAST(r->>'$.context_snapshot.findings_count' AS BIGINT) AS findings_count, len(list_filter(fs, lambda x: json_type(x) = 'OBJECT')) AS n_findings FROM p""",
    "p3_findings": _FLAT + """SELECT uid AS event_id, concat(delivery_id, '/', coalesce(uid, ''), '/context_snapshot_findings:', ordinal) AS row_key, concat(delivery_id, '/', coalesce(uid, '')) AS parent_key,
                              ordinal, decision_id, finding_id, x->>'$.severity' AS severity, CAST(x->>'$.score' AS DOUBLE) AS score, len(ev) AS n_evidence FROM g""",
    "p4_found": _CELLS + "SELECT * FROM cells",
    "p4_entities": _CELLS + """SELECT i.canonical_entity_id, coalesce(count(DISTINCT event_type), 0) AS n_types, CAST(coalesce(sum(n_events), 0) AS BIGINT) AS n_events, max(last_epoch) AS last_epoch, CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS total_cents
                               FROM (SELECT canonical_entity_id FROM entity_profile WHERE canonical_entity_id IS NOT NULL UNION SELECT canonical_entity_id FROM cells) i LEFT JOIN cells USING (canonical_entity_id) GROUP BY 1""",
    "p4_wide": _CELLS + """, i AS (SELECT canonical_entity_id FROM entity_profile WHERE canonical_entity_id IS NOT NULL UNION SELECT canonical_entity_id FROM cells),
                           g AS (SELECT x.canonical_entity_id, y.event_type, coalesce(z.n, 0) AS n, z.l, coalesce(z.t, 0) AS t FROM i x CROSS JOIN (SELECT DISTINCT event_type FROM cells) y
                                 LEFT JOIN (SELECT canonical_entity_id, event_type, CAST(sum(n_events) AS BIGINT) AS n, max(last_epoch) AS l, CAST(sum(total_cents) AS BIGINT) AS t FROM cells GROUP BY 1, 2) z ON z.canonical_entity_id = x.canonical_entity_id AND z.event_type = y.event_type)
                           PIVOT g ON event_type USING any_value(n) AS n_events, any_value(l) AS last_at, any_value(t) AS total GROUP BY canonical_entity_id""",
    "p5_found": _CHANGES + "SELECT case_id, entity_id, s AS current_state FROM last WHERE s <> 'NONE'",
    "p5_links": _CHANGES + "SELECT case_id, entity_id, s AS current_state, officer AS officer_id, reason FROM last WHERE s <> 'NONE'",
}
