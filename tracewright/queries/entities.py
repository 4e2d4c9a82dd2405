"""Queries on identities, scores and profiles of entities, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import entity_features, graph, profiles, resolution, temporal, validate
from tracewright.queries import reference as R

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


# ---- identities ----

_USABLE = "CASE WHEN upper(trim({c})) NOT IN ('', 'UNKNOWN', 'NONE', 'NAN', '0.0.0.0/0') THEN upper(trim({c})) END"
_U = lambda c: _USABLE.replace("{c}", c)
_MINE = ("phone_number", "actor_name", "device_id", "ip_subnet")


@query(
    f"""WITH r AS (SELECT raw_id AS k, min(phone_number) AS a, min(actor_name) AS n, min(device_id) AS d, min(ip_subnet) AS s FROM raw_identity GROUP BY 1),
    x AS (SELECT k, a, nullif(trim(regexp_replace(n, '[^ -~]', '', 'g')), '') AS n, {_U('a')} AS ua, {_U('d')} AS ud, {_U('s')} AS us FROM r), g AS (SELECT canonical_entity_id AS e, nullif(trim(regexp_replace(display_name, '[^ -~]', '', 'g')), '') AS n, {_U('phone_number')} AS ua, {_U('device_id')} AS ud, {_U('ip_subnet')} AS us FROM entity_profile),
    c AS (SELECT k, e, min(rank) AS rank FROM (SELECT k, e, 0 AS rank FROM x JOIN g ON x.ua = g.ua UNION ALL SELECT k, e, 1 FROM x JOIN g ON x.ud = g.ud UNION ALL SELECT k, e, 2 FROM x JOIN g ON x.us = g.us) GROUP BY 1, 2),
    w AS (SELECT k, e, rank, CASE WHEN x.ua IS NULL OR g.ua IS NULL THEN 0 WHEN x.ua = g.ua THEN log2(0.95 / 0.001) ELSE log2(0.05 / 0.999) END + CASE WHEN x.n IS NULL OR g.n IS NULL THEN 0 WHEN jaro_winkler_similarity(lower(x.n), lower(g.n)) >= 0.85 THEN log2(0.88 / 0.01) ELSE log2(0.12 / 0.99) END
        + CASE WHEN x.ud IS NULL OR g.ud IS NULL THEN 0 WHEN x.ud = g.ud THEN log2(0.90 / 0.005) ELSE log2(0.10 / 0.995) END + CASE WHEN x.us IS NULL OR g.us IS NULL THEN 0 WHEN x.us = g.us THEN log2(0.85 / 0.02) ELSE log2(0.15 / 0.98) END AS weight FROM c JOIN x USING (k) JOIN g USING (e)),
    p AS (SELECT k, e, rank, CASE WHEN rank = 0 THEN 1.0 ELSE (0.05 / 0.95 * pow(2, weight)) / (1 + 0.05 / 0.95 * pow(2, weight)) END AS p FROM w), b AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY p DESC, rank, e) AS rn FROM p)
    SELECT x.k AS raw_id, CASE WHEN b.p >= 0.6 THEN e ELSE 'new' END AS entity, coalesce(b.n, 0) AS candidates, CASE rank WHEN 0 THEN 'exact_actor_id' WHEN 1 THEN 'device_id' WHEN 2 THEN 'ip_subnet' ELSE 'none' END AS rule, round(coalesce(b.p, 1.0), 4) AS p,
    CASE WHEN b.p IS NULL OR b.p >= 0.85 THEN 'CONFIRMED' WHEN b.p >= 0.6 THEN 'POSSIBLE' ELSE 'REJECTED' END AS status FROM x LEFT JOIN b ON b.k = x.k AND b.rn = 1"""
)
def er4_resolved_records(spark, d):
    raw = table(spark, d, "raw_identity").groupBy("raw_id").agg(*[F.min(c).alias(c) for c in _MINE]).withColumnRenamed("phone_number", "actor_id")
    registry = table(spark, d, "entity_profile").select(F.col("canonical_entity_id").alias("entity_id"), F.lit(1.0).alias("match_confidence"), F.col("phone_number").alias("actor_id"), F.col("display_name").alias("actor_name"), "device_id", "ip_subnet")
    # Letters with marks are left out, as the SQL compares bytes.
    plain = lambda t: t.withColumn("actor_name", F.regexp_replace("actor_name", "[^ -~]", ""))
    out = resolution.resolve_records(plain(raw), plain(registry), "raw_id")
    return out.select("raw_id", F.when((F.col("candidates") > 0) & (F.col("status") != "REJECTED"), F.col("entity")).otherwise("new").alias("entity"), "candidates", "rule", F.round("p", 4).alias("p"), "status")


@query("""WITH c AS (SELECT phone_number, count(DISTINCT canonical_entity_id) AS n FROM entity_profile WHERE phone_number IS NOT NULL GROUP BY 1), o AS (SELECT count(*) FILTER (WHERE coalesce(trim(canonical_entity_id), '') = '') AS a, count(*) FILTER (WHERE coalesce(trim(phone_number), '') = '') AS b, count(*) FILTER (WHERE NOT coalesce(birth_year / 2000.0 BETWEEN 0 AND 1, false)) AS c FROM entity_profile)
    SELECT 'MISSING_ENTITY' AS error, a AS n FROM o UNION ALL SELECT 'MISSING_IDENTIFIER', b FROM o UNION ALL SELECT 'INVALID_CONFIDENCE', c FROM o UNION ALL SELECT 'CONFLICTING_IDENTIFIER', count(*) FILTER (WHERE n > 1) FROM c""")
def er5_registry_errors(spark, d):
    return resolution.registry_errors(table(spark, d, "entity_profile"), "canonical_entity_id", "phone_number", F.col("birth_year") / 2000.0)


@query("WITH h AS (SELECT canonical_entity_id, CASE WHEN lower(trim(display_name)) = 'runa' OR lower(trim(canonical_entity_id)) = 'runa' THEN 'EXACT' ELSE 'PARTIAL' END AS match FROM entity_profile WHERE contains(lower(display_name), 'runa') OR contains(lower(canonical_entity_id), 'runa')), k AS (SELECT * FROM h WHERE match = 'EXACT' OR NOT (SELECT coalesce(bool_or(match = 'EXACT'), false) FROM h)) SELECT *, (SELECT count(*) > 1 FROM k) AS ambiguous FROM k")
def er6_lookup(spark, d):
    return resolution.lookup(table(spark, d, "entity_profile"), "canonical_entity_id", "display_name", "Runa")


def _ledger(spark, d):
    return table(spark, d, "paper3_events_14a04386").select(F.col("metadata.raw_id").alias("raw_id"), F.col("metadata.canonical_entity_id").alias("entity"), "event_id", "timestamp", "case_id", "requested_state", F.col("metadata.is_correction").alias("is_correction"))


@query("WITH n AS (SELECT metadata.raw_id AS raw_id, count(DISTINCT metadata.canonical_entity_id) AS entities FROM paper3_events_14a04386 WHERE metadata.raw_id IS NOT NULL GROUP BY 1) SELECT raw_id, entities, CASE WHEN raw_id NOT IN (SELECT raw_id FROM raw_identity WHERE raw_id IS NOT NULL) OR entities = 0 THEN 'UNMAPPED' WHEN entities > 1 THEN 'CONFLICTING' ELSE 'VERIFIED' END AS status FROM n")
def jn11_bridge_status(spark, d):
    return resolution.bridge_status(_ledger(spark, d), "raw_id", "entity", table(spark, d, "raw_identity"))


@query("SELECT metadata.canonical_entity_id AS entity, metadata.canonical_entity_id AS alias FROM paper3_events_14a04386 WHERE metadata.canonical_entity_id IS NOT NULL UNION SELECT metadata.canonical_entity_id, metadata.raw_id FROM paper3_events_14a04386 WHERE metadata.canonical_entity_id IS NOT NULL AND metadata.raw_id IS NOT NULL")
def jn12_aliases(spark, d):
    return resolution.aliases(_ledger(spark, d), "raw_id", "entity")


@query("WITH " + R._SCORED + ", b AS (SELECT id, max(p) AS p FROM (SELECT left_id AS id, p FROM scored UNION ALL SELECT right_id, p FROM scored) GROUP BY 1) SELECT DISTINCT r.raw_id, CASE WHEN b.p >= 0.85 THEN 'PAIRWISE_CONFIRMED' WHEN b.p IS NOT NULL THEN 'CLUSTER_UNCONFIRMED' ELSE 'SINGLETON' END AS status FROM raw_identity r LEFT JOIN b ON b.id = r.raw_id")
def qs18_identity_status(spark, d):
    return resolution.identity_status(table(spark, d, "raw_identity"), "raw_id", R._scored(spark, d))


@query("WITH " + R._SCORED + ", i AS (SELECT DISTINCT metadata.raw_id AS id FROM paper3_events_14a04386 WHERE metadata.raw_id IS NOT NULL) SELECT left_id, right_id, round(p, 7) AS p FROM scored WHERE p >= 0.6 AND p < 0.85 AND left_id IN (SELECT id FROM i) AND right_id IN (SELECT id FROM i)")
def qs17_uncertain_pairs(spark, d):
    return resolution.uncertain_pairs(R._scored(spark, d), _ledger(spark, d), "raw_id").select("left_id", "right_id", r7("p", "p"))


@query("WITH " + R._SCORED + " SELECT CASE WHEN p >= 0.85 THEN 'CONFIRMED' WHEN p >= 0.6 THEN 'POSSIBLE' ELSE 'REJECTED' END AS status, count(*) AS n FROM scored GROUP BY 1")
def ag7_match_statuses(spark, d):
    return R._scored(spark, d).groupBy(R.linkage.match_status(F.col("p")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH RECURSIVE " + R._SPARSE + ", h AS (SELECT id, 0 AS hop FROM s0 UNION SELECT n.dst, hop + 1 FROM h JOIN n ON n.src = h.id WHERE hop < 2), m AS (SELECT id, min(hop) AS hop FROM h GROUP BY 1), l AS (SELECT actor_id AS id, max(epoch_us(\"timestamp\")) AS t FROM temporal_sequence WHERE actor_id IS NOT NULL GROUP BY 1) SELECT l.id, row_number() OVER (ORDER BY coalesce(hop, 999), t DESC NULLS LAST, l.id) AS rank FROM l LEFT JOIN m USING (id)")
def tk12_disambiguation(spark, d):
    e = R._sparse(spark, d)
    near = graph.hop_distances(e, e.where("src <> dst").agg(F.min("src").alias("id")), 2)
    last = table(spark, d, "temporal_sequence").where("actor_id is not null").groupBy(F.col("actor_id").alias("id")).agg(F.max(F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("t"))
    return resolution.ranked_choices(last.join(near, "id", "left"), "hop", "t", "id").select("id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT n_name, l_returnflag, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def jn2_events_targets(spark, d):
    n = F.broadcast(table(spark, d, "nation"))  # 25 rows
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {ev}, s AS (SELECT actor_id, max(amount) / 1000 AS s FROM ev GROUP BY 1), y AS (SELECT actor_id, bool_or(event_type = 'error' AND amount > 150) AS y FROM ev GROUP BY 1) SELECT y AS label, count(*) AS n, round(avg(s), 7) AS mean_score, (SELECT count(*) FROM s WHERE actor_id NOT IN (SELECT actor_id FROM y)) AS unknown FROM s JOIN y USING (actor_id) GROUP BY 1")
def jn10_scored_truth(spark, d):
    e = events(spark, d)
    s = e.groupBy("actor_id").agg((F.max("amount") / 1000).alias("s"))
    y = e.groupBy("actor_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("amount") > 150)).alias("y"))
    unknown = validate.require_all(s, y, "actor_id")
    return s.join(y, "actor_id").groupBy(F.col("y").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 7).alias("mean_score")).withColumn("unknown", F.lit(unknown))


# ---- scores ----

_BASE = (
    R._DAILY
    + """, b0 AS (SELECT *, count(*) OVER w AS n, median(v) OVER w AS med, mad(v) OVER w AS mad FROM day WINDOW w AS (PARTITION BY actor_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    dev AS (SELECT actor_id, max(abs(z)) AS any_z, max(abs(z)) FILTER (WHERE n >= 3) AS top_z FROM (SELECT actor_id, n, CASE WHEN n > 0 THEN (v - med) / (mad * 1.4826 + 1e-9) ELSE 0 END AS z FROM b0) GROUP BY 1)"""
)


def _deviations(spark, d):
    return profiles.deviations(temporal.causal_baselines(R._daily(spark, d), ["actor_id"], ["d"], "v"), "actor_id")


@query("WITH {ev}, " + _BASE + " SELECT actor_id, round(least(top_z / 10, 1.0), 6) AS behaviour FROM dev")
def ag10_behaviour_scores(spark, d):
    return _deviations(spark, d).select("actor_id", F.round("behaviour", 6).alias("behaviour"))


_GRAPH = """g AS (SELECT id, count(DISTINCT o) AS degree, count(*) AS weighted FROM (SELECT actor_id AS id, target_id AS o FROM ev WHERE actor_id <> target_id UNION ALL SELECT target_id, actor_id FROM ev WHERE actor_id <> target_id) GROUP BY 1)"""


@query("WITH {ev}, " + _GRAPH + ", s AS (SELECT actor_id AS id, count(*) AS n FROM (SELECT actor_id, lead(t, 2) OVER (PARTITION BY actor_id ORDER BY t, event_id) - t AS w FROM ev) WHERE w <= 7200000000 GROUP BY 1) SELECT id, round(least((degree / 10.0 + weighted / 10.0) / 3, 1.0), 7) AS graph_score, round(least(coalesce(n, 0) / 5.0, 1.0), 7) AS temporal_score FROM g LEFT JOIN s USING (id)")
def ag11_graph_scores(spark, d):
    e = events(spark, d)
    g = entity_features.degree_features(graph.edges_of(e))
    n = R.sequences.bursts(e, 3, 7200 * R.SECOND).groupBy(F.col("actor_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, "id", "left").select("id", r7(profiles.graph_novelty(F.col("degree"), F.lit(None), F.col("weighted_degree")), "graph_score"), r7(F.least(F.coalesce("n", F.lit(0)) / 5.0, F.lit(1.0)), "temporal_score"))


def _five(spark, d):
    """What the rules look at, per actor."""
    e = events(spark, d)
    calls = e.where("source_domain = 'CDR'").groupBy("actor_id").agg(F.avg(S.is_night(F.col("ts")).cast("int")).alias("night"))
    pays = e.where("source_domain = 'BANK'").groupBy("actor_id").agg(F.count(F.lit(1)).alias("payments"))
    g = entity_features.degree_features(graph.edges_of(e)).withColumnRenamed("id", "actor_id")
    met = e.groupBy("actor_id").agg(F.countDistinct("target_id").alias("targets"))
    return _deviations(spark, d).join(met, "actor_id").join(calls, "actor_id", "left").join(pays, "actor_id", "left").join(g, "actor_id", "left")


_FIVE = (
    _BASE
    + ", "
    + _GRAPH
    + """, k AS (SELECT actor_id, avg((hour(ts) >= 22 OR hour(ts) < 6)::INT) FILTER (WHERE source_domain = 'CDR') AS night, count(*) FILTER (WHERE source_domain = 'BANK') AS payments, count(DISTINCT target_id) AS targets FROM ev GROUP BY 1),
    f AS (SELECT dev.*, night, payments, targets, degree, weighted, 0.2 * (coalesce(any_z >= 3, false)::INT + coalesce(night >= 0.8, false)::INT + (payments >= 20)::INT + coalesce(weighted >= 100000, false)::INT + coalesce(degree >= 5, false)::INT) AS rules FROM dev JOIN k USING (actor_id) LEFT JOIN g ON g.id = dev.actor_id)"""
)


@query("WITH {ev}, " + _FIVE + " SELECT actor_id, round(rules, 7) AS score FROM f")
def an3_rule_scores(spark, d):
    s = profiles.rule_score(F.col("any_z"), F.col("night"), F.col("payments"), F.col("weighted_degree"), F.col("degree"))
    return _five(spark, d).select("actor_id", r7(s, "score"))


@query(
    "WITH {ev}, "
    + _FIVE
    + """, s AS (SELECT actor_id, rules, coalesce(top_z, 0) AS deviation, least((coalesce(degree, 0) / 10.0 + coalesce(weighted, 0) / 10.0) / 3, 1.0) AS novelty, least(targets / 10.0, 1.0) AS relationship FROM f)
    SELECT actor_id, round(rules, 7) AS rules, round(deviation, 6) AS deviation, round(novelty, 7) AS novelty, round(relationship, 7) AS relationship, round(rules + deviation * 0.5, 6) AS score,
    CASE WHEN deviation >= 3 THEN 'ENTITY' WHEN novelty >= 0.5 THEN 'SUBGRAPH' WHEN relationship >= 0.5 THEN 'RELATIONSHIP' WHEN rules >= 0.4 THEN 'EVENT' ELSE 'ENTITY' END AS level,
    CASE WHEN deviation >= 3 THEN 'ENTITY_DEVIATION' WHEN novelty >= 0.5 THEN 'SUBGRAPH_DEVIATION' WHEN relationship >= 0.5 THEN 'RELATIONSHIP_DEVIATION' WHEN rules >= 0.4 THEN 'EVENT_DEVIATION' ELSE 'ENTITY_DEVIATION' END AS type FROM s"""
)
def an2_entity_scores(spark, d):
    c = F.col
    f = _five(spark, d).select(
        "actor_id", profiles.rule_score(c("any_z"), c("night"), c("payments"), c("weighted_degree"), c("degree")).alias("rules"), F.coalesce("top_z", F.lit(0.0)).alias("deviation"),
        profiles.graph_novelty(c("degree"), F.lit(None), c("weighted_degree")).alias("novelty"), profiles.relationship_score(c("targets")).alias("relationship"),
    )
    k = profiles.classify(c("deviation"), c("novelty"), c("relationship"), c("rules"))
    return f.withColumn("k", k).select("actor_id", r7("rules", "rules"), F.round("deviation", 6).alias("deviation"), r7("novelty", "novelty"), r7("relationship", "relationship"), F.round(c("rules") + c("deviation") * 0.5, 6).alias("score"), "k.level", "k.type")


_SHIFT = """x AS (SELECT *, (t - lag(t) OVER (PARTITION BY actor_id ORDER BY t, event_id)) / 1e6 AS gap, min(t) OVER (PARTITION BY actor_id, target_id) = t AS fresh, t >= 1705968000000000 AS late FROM ev),
    m AS (SELECT actor_id, avg(gap) FILTER (WHERE NOT late) AS g0, avg(gap) FILTER (WHERE late) AS g1, stddev_pop(gap) AS sd, avg(gap) AS mu, count(*) FILTER (WHERE late) AS n1, count(*) FILTER (WHERE NOT late) AS n0, count(*) FILTER (WHERE late AND fresh) AS f1, count(*) AS n FROM x GROUP BY 1),
    q AS (SELECT actor_id, n, coalesce(g0 / nullif(g1, 0), 1) AS cadence, coalesce((sd - mu) / nullif(sd + mu, 0), 0) AS burst, coalesce(f1 / nullif(n1, 0), 0) AS novel, coalesce(n1 * 3.0 / nullif(n0, 0), 0) AS surge FROM m),
    s AS (SELECT actor_id, n, least(greatest(0.35 * CASE WHEN cadence > 1 THEN least((cadence - 1) / 3, 1) ELSE 0.05 END + 0.25 * least(greatest((burst + 1) / 2, 0), 1) + 0.2 * least(novel, 1) + 0.2 * least(surge / 5, 1), 0.05), 0.98) AS s FROM q)"""


def _shift(spark, d):
    """How the last days differ from before, per actor."""
    e = temporal.gaps(events(spark, d)).withColumn("late", F.col("t") >= 1705968000000000)
    fresh = e.groupBy("actor_id", "target_id").agg(F.min("t").alias("first"))
    e = e.join(fresh, ["actor_id", "target_id"])
    late, before = F.col("late"), ~F.col("late")
    m = e.groupBy("actor_id").agg(F.avg(F.when(before, F.col("gap_s"))).alias("g0"), F.avg(F.when(late, F.col("gap_s"))).alias("g1"), F.stddev_pop("gap_s").alias("sd"), F.avg("gap_s").alias("mu"), F.count_if(late).alias("n1"), F.count_if(before).alias("n0"), F.count_if(late & (F.col("t") == F.col("first"))).alias("f1"), F.count(F.lit(1)).alias("n"))
    z = lambda c, v: F.coalesce(c, F.lit(v))
    s = profiles.temporal_score(z(F.try_divide("g0", "g1"), 1.0), z(F.try_divide(F.col("sd") - F.col("mu"), F.col("sd") + F.col("mu")), 0.0), z(F.try_divide("f1", "n1"), 0.0), z(F.try_divide(F.col("n1") * 3.0, F.col("n0")), 0.0))
    return m.select("actor_id", "n", s.alias("s"))


@query("WITH {ev}, " + _SHIFT + " SELECT actor_id, round(s, 6) AS score FROM s")
def an9_temporal_scores(spark, d):
    return _shift(spark, d).select("actor_id", F.round("s", 6).alias("score"))


@query(
    "WITH {ev}, "
    + _SHIFT
    + """, w AS (SELECT actor_id, least(max(amount) / 500, 1.0) AS a, least(avg(amount) / 100, 1.0) AS b FROM ev GROUP BY 1), y AS (SELECT actor_id, n, (a + b + s) / 3 AS m, round(least(sqrt((pow(a - (a + b + s) / 3, 2) + pow(b - (a + b + s) / 3, 2) + pow(s - (a + b + s) / 3, 2)) / 3) / 0.5, 1.0), 3) AS apart FROM s JOIN w USING (actor_id))
    SELECT actor_id, CASE WHEN n < 60 THEN 'INSUFFICIENT_EVIDENCE' WHEN apart > 0.65 THEN 'CONFLICTED' WHEN m >= 0.65 AND 1 - apart >= 0.5 THEN 'HIGH' WHEN m >= 0.4 THEN 'ELEVATED' ELSE 'NORMAL' END AS class, round(CASE WHEN n < 60 THEN 0.1 ELSE m END, 6) AS score, round(CASE WHEN n < 60 THEN 0.2 ELSE least(greatest((1 - apart) * (1 - 1.0 / (n + 1)), 0.1), 0.95) END, 6) AS confidence FROM y"""
)
def an10_decisions(spark, d):
    w = events(spark, d).groupBy("actor_id").agg(F.least(F.max("amount") / 500, F.lit(1.0)).alias("a"), F.least(F.avg("amount") / 100, F.lit(1.0)).alias("b"))
    k = profiles.decide([F.col("a"), F.col("b"), F.col("s")], F.col("n"), 60)
    return _shift(spark, d).join(w, "actor_id").select("actor_id", k.alias("k")).select("actor_id", "k.class", F.round("k.score", 6).alias("score"), F.round("k.confidence", 6).alias("confidence"))


@query("WITH {ev}, " + R._WIDE + ", l AS (UNPIVOT f ON n, total, contacts, largest INTO NAME k VALUE v), p AS (SELECT k, median(v) AS med FROM l GROUP BY 1) SELECT actor_id, string_agg(k, ',' ORDER BY k) AS features FROM l JOIN p USING (k) WHERE v > 1.2 * med AND v > 5 GROUP BY 1")
def an11_signals(spark, d):
    return profiles.signals(entity_features.long_rows(R._wide(spark, d), "actor_id", R._NAMES), "actor_id", 1.2)


@query("WITH {ev}, " + R._DAILY + """, x AS (SELECT actor_id, list(v ORDER BY d) AS h FROM day GROUP BY 1), y AS (SELECT actor_id, h[len(h)] AS v, h[1:len(h) - 1] AS h, len(h) - 1 AS n FROM x), z AS (SELECT *, coalesce(list_median(h), v) AS c FROM y), u AS (SELECT *, coalesce(list_median(list_transform(h, lambda q: abs(q - c))), 0) * 1.4826 + 1e-9 AS s FROM z)
    SELECT actor_id, round(c, 6) AS center, CASE WHEN n < 2 THEN NULL ELSE round((v - c) / s, 2) + 0.0 END AS z, round(CASE WHEN n >= 3 THEN len(list_filter(h, lambda q: q <= v)) * 100.0 / n END, 6) AS rank, round(0.3 * v + 0.7 * coalesce(list_avg(h), v), 6) AS ewma, CASE WHEN n < 3 THEN 'COLD_START' WHEN n < 10 THEN 'LOW_HISTORY' ELSE 'STABLE_BASELINE' END AS status FROM u""")
def wn3_latest_scored(spark, d):
    x = R._daily(spark, d).groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("d", "v")))["v"].alias("h"))
    s = x.select("actor_id", F.size("h").alias("n"), profiles.score_value(F.element_at("h", -1), F.slice("h", F.lit(1), F.size("h") - 1)).alias("s"))
    return s.select("actor_id", F.round("s.center", 6).alias("center"), F.when(F.col("n") > 2, F.round("s.z", 2) + 0.0).alias("z"), F.round("s.rank", 6).alias("rank"), F.round("s.ewma", 6).alias("ewma"), "s.status")


_PIVOT = 1705708800000000


@query("WITH {ev} SELECT actor_id, count(*) AS transactions, round(coalesce(sum(amount) FILTER (WHERE amount > 0), 0), 4) AS volume, round(coalesce(stddev_pop(amount) FILTER (WHERE amount > 0), 0), 6) AS std_amount, round(coalesce(sum(amount) FILTER (WHERE t >= 1705705200000000), 0) / 3600, 6) AS velocity, round(count(DISTINCT target_id) / count(*), 6) AS turnover FROM ev WHERE source_domain = 'BANK' AND t <= 1705708800000000 GROUP BY 1")
def ag15_financial_profiles(spark, d):
    p = profiles.financial_profile(events(spark, d).where("source_domain = 'BANK'"), _PIVOT)
    return p.select("actor_id", "transactions", F.round("volume", 4).alias("volume"), *[F.round(c, 6).alias(c) for c in ("std_amount", "velocity", "turnover")])


@query("WITH {ev}, g AS (SELECT *, (t - lag(t) OVER (PARTITION BY actor_id ORDER BY t, event_id)) / 1e6 AS gap FROM ev WHERE source_domain = 'IPDR') SELECT actor_id, count(*) AS flows, count(DISTINCT target_id) AS destinations, round(CASE WHEN count(*) >= 3 THEN coalesce((stddev_pop(gap) - avg(gap)) / nullif(stddev_pop(gap) + avg(gap), 0), 0) ELSE 0 END, 6) AS burstiness FROM g WHERE t <= 1705708800000000 GROUP BY 1")
def ag15_network_profiles(spark, d):
    return profiles.network_profile(temporal.gaps(events(spark, d).where("source_domain = 'IPDR'")), _PIVOT).withColumn("burstiness", F.round("burstiness", 6))


@query("WITH {ev} SELECT actor_id, count(*) AS interactions, count(DISTINCT target_id) AS contacts, round(count(*) / (greatest((max(t) - min(t)) / 1e6, 1.0) / 3600), 5) AS per_hour, round(count(DISTINCT target_id) / count(*), 6) AS new_contact_rate FROM ev WHERE source_domain = 'SOCIAL' AND t <= 1705708800000000 GROUP BY 1")
def ag15_social_profiles(spark, d):
    p = profiles.social_profile(events(spark, d).where("source_domain = 'SOCIAL'"), _PIVOT)
    return p.select("actor_id", "interactions", "contacts", F.round("per_hour", 5).alias("per_hour"), F.round("new_contact_rate", 6).alias("new_contact_rate"))


# ---- orders, limits, timelines ----


@query("WITH {ev}, " + R._WIDE + ", l AS (UNPIVOT f ON n, total, contacts, largest INTO NAME k VALUE v), r AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY v DESC, k) AS rank FROM l WHERE v > 0) SELECT actor_id, k AS feature_name, rank FROM r WHERE rank <= 2")
def tk6_top_features(spark, d):
    long = entity_features.long_rows(R._wide(spark, d), "actor_id", R._NAMES).where("feature_value > 0")
    return validate.numbered(long, ["actor_id"], [F.desc("feature_value"), F.col("feature_name")], "rank").where("rank <= 2").select("actor_id", "feature_name", F.col("rank").cast("bigint").alias("rank"))


@query("WITH {ev}, " + R._DAILY + ", b AS (SELECT *, count(*) OVER w AS n, median(v) OVER w AS med, mad(v) OVER w AS mad FROM day WINDOW w AS (PARTITION BY actor_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), z AS (SELECT actor_id, d, round(abs((v - med) / (mad * 1.4826 + 1e-9)), 5) AS z FROM b WHERE n >= 3) SELECT actor_id, d, rank FROM (SELECT actor_id, d, row_number() OVER (PARTITION BY actor_id ORDER BY z DESC, d) AS rank FROM z) WHERE rank <= 2")
def tk7_top_deviations(spark, d):
    b = temporal.causal_baselines(R._daily(spark, d), ["actor_id"], ["d"], "v").where("status <> 'COLD_START'").withColumn("z", F.round(F.abs("robust_z"), 5))
    return validate.numbered(b, ["actor_id"], [F.desc("z"), F.col("d")], "rank").where("rank <= 2").select("actor_id", "d", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT DISTINCT event_id, canonical_entity_id, position FROM (SELECT event_id, canonical_entity_id, dense_rank() OVER (PARTITION BY canonical_entity_id ORDER BY strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S.%f') NULLS LAST, event_id) AS position FROM temporal_sequence WHERE canonical_entity_id IS NOT NULL)")
def tk2_timeline_order(spark, d):
    """Timelines by the time as text, then id, with rows without a time last."""
    x = table(spark, d, "temporal_sequence").where("canonical_entity_id is not null")
    w = Window.partitionBy("canonical_entity_id").orderBy(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").asc_nulls_last(), "event_id")
    return x.select("event_id", "canonical_entity_id", F.dense_rank().over(w).cast("bigint").alias("position")).distinct()


@query("WITH {ev} SELECT event_id FROM ev ORDER BY t, event_id LIMIT 100")
def tk10_bounded_events(spark, d):
    """The feature is the bound: the first hundred in time."""
    return events(spark, d).orderBy("t", "event_id").limit(100).select("event_id")


@query("WITH {ev}, o AS (SELECT *, CASE source_domain WHEN 'SOCIAL' THEN 0 WHEN 'IPDR' THEN 1 WHEN 'BANK' THEN 2 ELSE 3 END AS k FROM ev), p AS (SELECT event_id, unnest(list_distinct([actor_id, target_id])) AS entity, source_domain, k FROM o) SELECT entity, arg_min(source_domain, (k, source_domain)) AS dataset FROM p WHERE entity IS NOT NULL GROUP BY 1")
def tq1_dataset_of_entity(spark, d):
    p = entity_features.participants(events(spark, d))
    return temporal.first_dataset(p, "entity", "source_domain", ["SOCIAL", "IPDR", "BANK"]).withColumnRenamed("source_domain", "dataset")


@query("WITH {ev} SELECT event_id, 'CASE' AS origin FROM ev WHERE t BETWEEN 1704844800000000 AND 1705449600000000 AND event_type <> 'error' UNION ALL SELECT event_id, 'LIVE' FROM ev WHERE t BETWEEN 1704844800000000 AND 1705449600000000 AND event_type = 'error'")
def tq14_timeline_with_live(spark, d):
    e = events(spark, d)
    return temporal.timeline(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), 1704844800000000, 1705449600000000).select("event_id", "origin")


@query("SELECT count(*) AS n FROM documents")
def src10_count(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 50")
def snk10_reader(spark, d):
    return validate.first_rows(table(spark, d, "events"), ["event_id"], 50).select("event_id")


@query("SELECT event_id, CASE upper(event_type) WHEN 'CLICK' THEN 'CONNECTED_TO' WHEN 'VIEW' THEN 'INTERACTED_WITH' WHEN 'ERROR' THEN 'CALLED' WHEN 'PURCHASE' THEN 'TRANSFERRED_TO' ELSE 'ASSOCIATED_WITH' END AS relation FROM events")
def prj12_relations(spark, d):
    return table(spark, d, "events").select("event_id", graph.relation(F.col("event_type"), {"CLICK": "CONNECTED_TO", "VIEW": "INTERACTED_WITH", "ERROR": "CALLED", "PURCHASE": "TRANSFERRED_TO"}).alias("relation"))


@query("SELECT v AS value, CASE WHEN regexp_full_match(v, '[0-9]{1,3}([.][0-9]{1,3}){3}(/[0-9]{1,2})?') THEN 'IP' WHEN starts_with(upper(v), 'DEV') THEN 'DEVICE' WHEN regexp_full_match(v, '[+]?[0-9][0-9 ().-]{6,}') THEN 'PHONE' WHEN starts_with(upper(v), 'ENT') THEN 'ENTITY' ELSE 'NAME' END AS kind FROM (SELECT DISTINCT unnest([trim(display_name), trim(phone_number), trim(device_id), trim(ip_subnet), canonical_entity_id]) AS v FROM entity_profile) WHERE v IS NOT NULL")
def prj15_search_kinds(spark, d):
    p = table(spark, d, "entity_profile")
    v = p.select(F.explode(F.array(F.trim("display_name"), F.trim("phone_number"), F.trim("device_id"), F.trim("ip_subnet"), F.col("canonical_entity_id"))).alias("value")).where("value is not null").distinct()
    return v.select("value", validate.search_kind(F.col("value")).alias("kind"))


@query("SELECT canonical_entity_id, CASE WHEN lower(trim(display_name)) = 'runa' THEN 'CONFIRMED' ELSE 'POSSIBLE' END AS status, CASE WHEN lower(trim(display_name)) = 'runa' THEN 0.95 ELSE 0.65 END AS confidence FROM entity_profile WHERE contains(lower(display_name), 'runa')")
def prj18_registry_search(spark, d):
    p = table(spark, d, "entity_profile").where(F.contains(F.lower("display_name"), F.lit("runa")))
    return p.select("canonical_entity_id", validate.registry_hit(F.lower(F.trim("display_name")) == "runa", F.lit("CONFIRMED"), F.lit(0.95)).alias("h")).select("canonical_entity_id", "h.status", "h.confidence")


@query("WITH {ev} SELECT event_id FROM ev WHERE source_domain = 'BANK' AND amount >= 100")
def prj20_filtered(spark, d):
    return validate.filtered(events(spark, d), source_domain="BANK", actor_id=None).where("amount >= 100").select("event_id")
