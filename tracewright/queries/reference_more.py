"""Further analytics queries: evidence, reach, profiles, rankings, hashes, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import anomaly, entity_features, evidence, fusion, graph, learning, linkage, quality, temporal, validate
from tracewright.queries import reference as R
from tracewright.sources import files
from tracewright.streaming import runtime

QUERIES: dict = {}
SQL: dict[str, str] = {}
EV, SECOND = R.EV, R.SECOND
events, table, r7 = R.events, R.table, R.r7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{ev}", EV)
        return f

    return add


# ---- projection, sinks ----


@query("SELECT count(*) AS received, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS rejected, CAST(sum((event_type <> 'error')::INT) AS BIGINT) AS accepted, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def snk2_manifest(spark, d):
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("received"), F.count_if(bad).alias("rejected"), F.count_if(~bad).alias("accepted"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("WITH {ev}, n AS (SELECT event_id FROM ev ORDER BY t DESC, event_id DESC LIMIT 500) SELECT event_id, actor_id AS src, target_id AS dst FROM ev WHERE event_id IN (SELECT event_id FROM n)")
def snk8_recovered_state(spark, d):
    return graph.newest_events(events(spark, d), 500).select("event_id", F.col("actor_id").alias("src"), F.col("target_id").alias("dst"))


@query("SELECT event_id FROM events LIMIT 1000")
def src11_first_rows(spark, d):
    """The feature is the bound: the first thousand rows in the order of the file."""
    e = table(spark, d, "events").select("event_id", F.col("_metadata.file_path").alias("source_file"))
    return files.with_row_index(e).where("source_row_index < 1000").select("event_id")


@query("SELECT raw_id, coalesce(nullif(trim(phone_number), ''), nullif(trim(device_id), ''), nullif(trim(ip_subnet), '')) AS contact, count(*) AS n FROM raw_identity GROUP BY ALL")
def prj2_first_alias(spark, d):
    raw = table(spark, d, "raw_identity")
    return raw.select("raw_id", validate.coalesce_aliases(raw, ["no_such_column", "phone_number", "device_id", "ip_subnet"]).alias("contact")).groupBy("raw_id", "contact").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def prj14_cutoff(spark, d):
    return table(spark, d, "events").where("ts <= timestamp_ntz '2024-01-15 00:00:00'").select("event_id")


@query(
    """SELECT canonical_entity_id, concat_ws(',', CASE WHEN phone_number IS NULL THEN 'NO_PHONE' END, CASE WHEN birth_year IS NULL OR birth_year < 1940 THEN 'BAD_YEAR' END, CASE WHEN home_city IS NULL THEN 'NO_CITY' END) AS errors FROM entity_profile"""
)
def prj22_scope_errors(spark, d):
    e = validate.scope_errors([(F.col("phone_number").isNull(), "NO_PHONE"), (F.col("birth_year").isNull() | (F.col("birth_year") < 1940), "BAD_YEAR"), (F.col("home_city").isNull(), "NO_CITY")])
    return table(spark, d, "entity_profile").select("canonical_entity_id", F.array_join(e, ",").alias("errors"))


# ---- joins ----


@query("SELECT t.event_id, coalesce(p.display_name, t.canonical_entity_id, 'NONE') AS who, count(*) AS n FROM temporal_sequence t LEFT JOIN entity_profile p USING (canonical_entity_id) GROUP BY ALL")
def jn5_with_fallback(spark, d):
    j = table(spark, d, "temporal_sequence").select("event_id", "canonical_entity_id").join(table(spark, d, "entity_profile").select("canonical_entity_id", "display_name"), "canonical_entity_id", "left")
    return j.groupBy("event_id", F.coalesce("display_name", "canonical_entity_id", F.lit("NONE")).alias("who")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH {ev}, p AS (SELECT event_id, actor_id AS entity FROM ev UNION SELECT event_id, target_id FROM ev) SELECT entity, count(*) AS n FROM p GROUP BY 1")
def jn6_participation(spark, d):
    return entity_features.participants(events(spark, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


_PROMPT_REFS = """m AS (SELECT delivery_id, list_filter(flatten(list_transform(list_filter(metadata.context_snapshot.findings, lambda x: x IS NOT NULL AND x.evidence IS NOT NULL), lambda x: list_transform(x.evidence, lambda e: e.evidence_ref))), lambda r: r IS NOT NULL) AS refs FROM features5_6_events WHERE metadata.context_snapshot.findings IS NOT NULL)"""


def _prompts(spark, d):
    m = table(spark, d, "features5_6_events").where("metadata.context_snapshot.findings is not null")
    found = F.filter("metadata.context_snapshot.findings", lambda x: x.isNotNull() & x["evidence"].isNotNull())
    refs = F.filter(F.flatten(F.transform(found, lambda x: F.transform(x["evidence"], lambda e: e["evidence_ref"]))), lambda r: r.isNotNull())
    return m.select("delivery_id", refs.alias("refs"))


@query(
    "WITH "
    + _PROMPT_REFS
    + """, x AS (SELECT delivery_id, unnest(list_distinct(refs)) AS ref FROM m), e AS (SELECT DISTINCT event_id FROM temporal_sequence), c AS (SELECT m.delivery_id, count(x.ref) AS n_refs, count(e.event_id) AS n_found FROM m LEFT JOIN x ON x.delivery_id = m.delivery_id LEFT JOIN e ON e.event_id = x.ref GROUP BY 1)
    SELECT *, CASE WHEN n_found = 0 THEN 'UNREFERENCED' WHEN n_found < n_refs THEN 'PARTIALLY' ELSE 'FULLY' END AS status FROM c"""
)
def jn8_resolved_references(spark, d):
    return evidence.resolve_references(_prompts(spark, d), "refs", table(spark, d, "temporal_sequence").select("event_id"), "event_id", "delivery_id")


@query("WITH " + _PROMPT_REFS + ", x AS (SELECT delivery_id, unnest(refs) AS ref FROM m) SELECT delivery_id FROM m WHERE len(refs) = 0 UNION SELECT delivery_id FROM x WHERE ref NOT IN (SELECT event_id FROM temporal_sequence WHERE source_domain = 'BANK')")
def qs16_ungrounded_claims(spark, d):
    return evidence.ungrounded(_prompts(spark, d), "delivery_id", "refs", table(spark, d, "temporal_sequence").where("source_domain = 'BANK'"), "event_id")


@query("SELECT event_id FROM temporal_sequence WHERE event_id IS NOT NULL AND event_id NOT IN (SELECT replace(evidence_ref, 'EVD', 'EVT') FROM temporal_sequence WHERE evidence_ref IS NOT NULL)")
def jn7_missing_ledger_rows(spark, d):
    e = table(spark, d, "temporal_sequence")
    return evidence.missing_records(e.select("event_id"), "event_id", e.select(F.regexp_replace("evidence_ref", "EVD", "EVT").alias("event_id")), "event_id")


@query("WITH {ev}, e AS (SELECT DISTINCT actor_id AS s, target_id AS d FROM ev WHERE event_type = 'purchase' AND actor_id <> target_id), t AS (SELECT s, d FROM e UNION SELECT a.s, b.d FROM e a JOIN e b ON b.s = a.d) SELECT s AS id, count(*) AS reach FROM t WHERE s <> d GROUP BY 1")
def jn16_two_hop_reach(spark, d):
    e = graph.edges_of(events(spark, d).where("event_type = 'purchase'")).where("src <> dst").select("src", "dst").distinct()
    two = e.select("src", F.col("dst").alias("m")).join(e.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst")
    return e.union(two).where("src <> dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("reach"))


@query(
    """WITH b AS (SELECT o_orderkey AS id, o_orderpriority AS k, list(DISTINCT l_partkey) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), x AS (SELECT id, k, unnest(t) AS p, len(t) AS n FROM b)
    SELECT a.id AS a, c.id AS b, count(*) AS shared, count(*) = min(a.n) AND count(*) = min(c.n) AS is_equal FROM x a JOIN x c ON a.k = c.k AND a.p = c.p AND a.id < c.id GROUP BY 1, 2"""
)
def jn21_request_overlap(spark, d):
    b = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.collect_set("l_partkey").alias("t"))
    return evidence.overlap_of_requests(b, "o_orderkey", "t", "o_orderpriority")


# ---- aggregation ----


@query("WITH {ev} SELECT actor_id, count(*) AS session_count, round(sum(amount), 7) AS bytes_in, count(DISTINCT target_id) AS destination_diversity FROM ev WHERE source_domain = 'IPDR' GROUP BY 1")
def ag2_sessions(spark, d):
    return events(spark, d).where("source_domain = 'IPDR'").groupBy("actor_id").agg(F.count(F.lit(1)).alias("session_count"), F.round(F.sum("amount"), 7).alias("bytes_in"), F.countDistinct("target_id").alias("destination_diversity"))


@query("WITH {ev}, x AS (SELECT actor_id AS id, target_id AS o FROM ev WHERE actor_id <> target_id UNION ALL SELECT target_id, actor_id FROM ev WHERE actor_id <> target_id) SELECT id, count(DISTINCT o) AS degree, count(*) AS weighted_degree FROM x GROUP BY 1")
def ag5_degrees(spark, d):
    return entity_features.degree_features(graph.edges_of(events(spark, d)))


@query("WITH {ev} SELECT actor_id, count(*) AS activity_frequency, count(target_id) AS interaction_count FROM ev WHERE source_domain = 'SOCIAL' GROUP BY 1")
def ag4_social(spark, d):
    return entity_features.social_features(events(spark, d).where("source_domain = 'SOCIAL'"))


@query(
    """WITH {ev}, """
    + R._WIDE
    + """, l AS (UNPIVOT f ON n, total, contacts, largest INTO NAME k VALUE v), p AS (SELECT k, median(v) AS med, mad(v) AS mad FROM l GROUP BY 1) SELECT actor_id, round(max(least(1.0, abs(v - med) / (1.4826 * mad + 1e-6) / 5)), 7) AS score FROM l JOIN p USING (k) GROUP BY 1"""
)
def ag9_domain_scores(spark, d):
    long = entity_features.long_rows(R._wide(spark, d), "actor_id", R._NAMES)
    stats = F.broadcast(entity_features.population_statistics(long))  # one row a feature
    s = F.least(F.lit(1.0), F.abs(F.col("feature_value") - F.col("median")) / (1.4826 * F.col("mad") + 1e-6) / 5)
    return long.join(stats, "feature_name").groupBy("actor_id").agg(F.round(F.max(s), 7).alias("score"))


@query("WITH {ev}, g AS (SELECT *, (t - lag(t) OVER (PARTITION BY actor_id ORDER BY t, event_id)) / 1e6 AS gap FROM ev) SELECT actor_id, round(avg(amount) FILTER (WHERE amount > 0), 7) AS mean_amount, round((stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)), 7) AS burstiness, round(count(*) / (greatest((max(t) - min(t)) / 1e6, 1.0) / 3600), 7) AS rate_per_h FROM g GROUP BY 1 HAVING count(*) > 2")
def ag14_profiles(spark, d):
    g = temporal.gaps(events(spark, d))
    sd, mu = F.stddev_pop("gap_s"), F.avg("gap_s")
    p = g.groupBy("actor_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("amount") > 0, F.col("amount"))), 7).alias("mean_amount"), F.round(F.try_divide(sd - mu, sd + mu), 7).alias("burstiness"), F.round(F.count(F.lit(1)) / (F.greatest((F.max("t") - F.min("t")) / 1e6, F.lit(1.0)) / 3600), 7).alias("rate_per_h"))
    return p.where("n > 2").drop("n")


@query("WITH {ev}, a AS (SELECT actor_id, max(amount) AS x FROM ev WHERE t % 2 = 0 GROUP BY 1), b AS (SELECT actor_id, max(amount) AS y FROM ev WHERE t % 2 = 1 GROUP BY 1) SELECT count(*) AS either, count(x) AS in_a, count(y) AS in_b, round(avg(abs(x - y)), 7) AS mae FROM a FULL JOIN b USING (actor_id)")
def ag26_stability(spark, d):
    e = events(spark, d)
    a = e.where("t % 2 = 0").groupBy("actor_id").agg(F.max("amount").alias("x"))
    b = e.where("t % 2 = 1").groupBy("actor_id").agg(F.max("amount").alias("y"))
    return a.join(b, "actor_id", "full").agg(F.count(F.lit(1)).alias("either"), F.count("x").alias("in_a"), F.count("y").alias("in_b"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 7).alias("mae"))


@query("SELECT case_id, count(*) AS n, count(DISTINCT entity_id) AS n_links, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM features5_6_events WHERE case_id IS NOT NULL GROUP BY 1")
def ag23_cases(spark, d):
    c = table(spark, d, "features5_6_events").where("case_id is not null")
    return c.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_links"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


# ---- windows, temporal queries, ranking ----


@query("WITH {ev}, s AS (SELECT actor_id, event_id, row_number() OVER (PARTITION BY actor_id ORDER BY t, event_id) - 1 AS pos FROM ev) SELECT actor_id, event_id, pos FROM s WHERE pos >= 2 AND pos < 5")
def tq6_slice(spark, d):
    s = temporal.ordered_sequence(events(spark, d), "actor_id", [F.col("t"), F.col("event_id")], ["t"])
    return s.where("position >= 2 and position < 5").select("actor_id", "event_id", F.col("position").cast("bigint").alias("pos"))


@query("WITH {ev}, p AS (SELECT actor_id, max(t) AS pt FROM ev GROUP BY 1), r AS (SELECT e.actor_id, event_id, target_id, row_number() OVER (PARTITION BY e.actor_id ORDER BY t DESC, event_id DESC) AS rank FROM ev e JOIN p USING (actor_id) WHERE t < pt) SELECT actor_id, event_id, target_id AS counterparty, 'OUTFLOW_TO' AS direction FROM r WHERE rank <= 3")
def tq12_backtrack(spark, d):
    e = events(spark, d)
    last = e.groupBy("actor_id").agg(F.max("t").alias("pivot_t"))
    return temporal.previous_events(e, last, 3).select("actor_id", "event_id", F.col("target_id").alias("counterparty"), F.lit("OUTFLOW_TO").alias("direction"))


@query("WITH {ev}, p AS (SELECT actor_id, min(t) AS pt FROM ev GROUP BY 1), r AS (SELECT e.actor_id, event_id, row_number() OVER (PARTITION BY e.actor_id ORDER BY t, event_id) AS rank FROM ev e JOIN p USING (actor_id) WHERE t >= pt) SELECT actor_id, event_id, rank FROM r WHERE rank <= 3")
def tq10_forwardtrack(spark, d):
    e = events(spark, d)
    first = e.groupBy("actor_id").agg(F.min("t").alias("pivot_t"))
    return temporal.previous_events(e, first, 3, inclusive=True, after=True).select("actor_id", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("WITH {ev} SELECT actor_id, event_id, round((t - min(t) OVER (PARTITION BY actor_id)) / 1e6, 7) AS offset_s, t = max(t) OVER (PARTITION BY actor_id) AS is_trigger FROM ev")
def wn14_timeline_rows(spark, d):
    e = events(spark, d)
    ends = e.groupBy("actor_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return e.join(ends, "actor_id").select("actor_id", "event_id", F.round((F.col("t") - F.col("lo")) / 1e6, 7).alias("offset_s"), (F.col("t") == F.col("hi")).alias("is_trigger"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS triage FROM customer QUALIFY triage <= 3")
def wn16_triage(spark, d):
    return validate.numbered(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], "triage").where("triage <= 3").select("c_custkey", F.col("triage").cast("bigint").alias("triage"))


@query("WITH {ev}, c AS (SELECT actor_id, row_number() OVER (PARTITION BY actor_id ORDER BY t, event_id) AS n, sha256(CAST(event_id AS VARCHAR)) AS digest, lag(sha256(CAST(event_id AS VARCHAR))) OVER (PARTITION BY actor_id ORDER BY t, event_id) AS prev, event_id FROM ev) SELECT event_id FROM c WHERE prev IS NOT NULL AND event_id % 97 = 0")
def wn18_chain_breaks(spark, d):
    w = Window.partitionBy("actor_id").orderBy("t", "event_id")
    h = F.sha2(F.col("event_id").cast("string"), 256)
    # Every 97th link is broken on purpose, and must be the ones found.
    log = events(spark, d).withColumn("n", F.row_number().over(w)).withColumn("digest", h).withColumn("prev", F.when(F.col("event_id") % 97 == 0, F.lit("tampered")).otherwise(F.lag(h).over(w)))
    return temporal.chain_breaks(log, "actor_id", "n", "digest", "prev").select("event_id")


@query("WITH {ev}, r AS (SELECT actor_id, amount, row_number() OVER (PARTITION BY actor_id ORDER BY amount DESC, event_id) AS k FROM ev) SELECT actor_id, round(avg(amount), 7) AS mean_top3 FROM r WHERE k <= 3 GROUP BY 1")
def tk8_mean_of_top(spark, d):
    w = validate.numbered(events(spark, d), ["actor_id"], [F.desc("amount"), F.col("event_id")], "k").where("k <= 3")
    return w.groupBy("actor_id").agg(F.round(F.avg("amount"), 7).alias("mean_top3"))


@query("WITH {ev}, a AS (SELECT actor_id, 'CDR' AS store, count(*) AS n FROM ev WHERE source_domain = 'CDR' GROUP BY 1 UNION ALL SELECT actor_id, 'BANK', count(*) FROM ev WHERE source_domain = 'BANK' GROUP BY 1) SELECT store, actor_id, n FROM a")
def so1_union_of_stores(spark, d):
    e = events(spark, d)
    part = lambda x: e.where(F.col("source_domain") == x).groupBy("actor_id").agg(F.count(F.lit(1)).alias("n")).withColumn("store", F.lit(x))
    return part("CDR").unionByName(part("BANK")).select("store", "actor_id", "n")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def so3_intersection(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'purchase' and value > 100").select("user_id"))


# ---- graph ----


@query("WITH {ev}, n AS (SELECT actor_id AS s, target_id AS d FROM ev WHERE actor_id <> target_id UNION SELECT target_id, actor_id FROM ev WHERE actor_id <> target_id) SELECT s AS id, count(*) AS neighbours FROM n GROUP BY 1")
def gr10_neighbours(spark, d):
    return graph.undirected(graph.edges_of(events(spark, d))).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("neighbours"))


@query("WITH {ev}, x AS (SELECT lag(event_type) OVER (PARTITION BY actor_id ORDER BY t, event_id) AS src, event_type AS dst FROM ev) SELECT src, dst, round(count(*) / sum(count(*)) OVER (PARTITION BY src), 7) AS weight FROM x WHERE src IS NOT NULL GROUP BY 1, 2")
def gr16_transition_graph(spark, d):
    x = temporal.transitions(events(spark, d))
    return x.select("src", "dst", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("src")), 7).alias("weight"))


@query("WITH RECURSIVE r AS (SELECT doc_id AS node, parent_doc_id AS ancestor, 1 AS depth FROM documents WHERE parent_doc_id IS NOT NULL UNION ALL SELECT r.node, d.parent_doc_id, depth + 1 FROM r JOIN documents d ON d.doc_id = r.ancestor WHERE d.parent_doc_id IS NOT NULL) SELECT node, ancestor, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1, 2")
def gr18_lineage(spark, d):
    """Every ancestor of every document."""
    return graph.ancestors(table(spark, d, "documents"), "doc_id", "parent_doc_id")


# ---- scalars ----


@query("SELECT event_id, sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type)) AS h, concat('hash:', substr(sha256(concat_ws('|', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type)), 1, 16)) AS label FROM events")
def hsh3_event_hashes(spark, d):
    e = table(spark, d, "events").withColumn("h", S.pipe_hash(F.col("event_id"), F.col("user_id"), F.col("event_type")))
    return e.select("event_id", "h", F.concat(F.lit("hash:"), F.substring("h", 1, 16)).alias("label"))


@query("SELECT doc_id, round(exp(-0.693147 * date_diff('day', CAST(revised_at AS DATE), DATE '2026-07-01') / 30.0), 7) AS weight FROM documents WHERE revised_at IS NOT NULL")
def dat5_decay(spark, d):
    age = F.datediff(F.lit("2026-07-01").cast("date"), F.to_date("revised_at"))
    return table(spark, d, "documents").where("revised_at is not null").select("doc_id", F.round(S.half_life(age), 7).alias("weight"))


@query(
    """WITH {ev}, s AS (SELECT actor_id, list(event_type ORDER BY t, event_id) AS xs FROM ev GROUP BY 1), g AS (SELECT actor_id, unnest(list_transform(range(1, len(xs)), lambda i: concat(xs[i], '>', xs[i + 1]))) AS g FROM s) SELECT g AS bigram, count(*) AS n FROM g GROUP BY 1"""
)
def arr1_bigrams(spark, d):
    s = events(spark, d).groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type")))["event_type"].alias("xs"))
    return s.select(F.explode(S.bigrams(F.col("xs"))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT canonical_entity_id AS id, lower(trim(display_name)) AS s FROM entity_profile WHERE display_name IS NOT NULL), p AS (SELECT id, concat(' ', unnest(list_filter(string_split_regex(s, '\\s+'), lambda x: len(x) > 0)), ' ') AS w FROM w),
    g AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: substr(w, i, 3))) AS g FROM p WHERE len(w) >= 3) SELECT g AS trigram, count(*) AS n FROM g GROUP BY 1"""
)
def str4_ngram_counts(spark, d):
    return table(spark, d, "entity_profile").where("display_name is not null").select(F.explode(S.char_ngrams(F.col("display_name"), 3, 3)).alias("trigram")).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))


# ---- linkage, anomaly, learning ----


@query()
def er2_fitted_agreement(spark, d):
    """m and u of each field as expectation maximisation finds them."""
    raw = table(spark, d, "raw_identity").groupBy("raw_id").agg(*[F.min(linkage.usable(F.col(c))).alias(c) for c in ("actor_name", "device_id", "ip_subnet", "home_city")])
    side = lambda p, k: raw.select(F.col("raw_id").alias(k), *[F.col(c).alias(p + c) for c in raw.columns[1:]])
    j = R._pairs(spark, d).join(side("a_", "left_id"), "left_id").join(side("b_", "right_id"), "right_id")
    fields = ["actor_name", "device_id", "ip_subnet", "home_city"]
    m, p = linkage.fit_agreement(j.select(*[(F.col("a_" + f) == F.col("b_" + f)).cast("int").alias(f) for f in fields]), fields)
    return spark.createDataFrame([(f, float(a), float(b), float(p)) for f, (a, b) in m.items()], "field string, m double, u double, prior double")


@query("WITH " + R._PAIRS + ", t AS (SELECT a.raw_id AS left_id, b.raw_id AS right_id FROM (SELECT DISTINCT raw_id, phone_number FROM raw_identity) a JOIN (SELECT DISTINCT raw_id, phone_number FROM raw_identity) b ON a.phone_number = b.phone_number AND a.raw_id < b.raw_id WHERE a.phone_number <> '0000000000') SELECT count(*) AS n_true, count(p.left_id) AS n_found, round(count(p.left_id) / nullif(count(*), 0), 7) AS recall FROM t LEFT JOIN pairs p USING (left_id, right_id)")
def er7_blocking_recall(spark, d):
    raw = table(spark, d, "raw_identity").where("phone_number <> '0000000000'").select("raw_id", "phone_number").distinct()
    truth = raw.select(F.col("raw_id").alias("left_id"), "phone_number").join(raw.select(F.col("raw_id").alias("right_id"), "phone_number"), "phone_number").where("left_id < right_id").select("left_id", "right_id")
    n = table(spark, d, "raw_identity").select("raw_id").distinct().count()
    return linkage.pair_quality(R._pairs(spark, d), truth, n).select("n_true", "n_found", F.round("recall", 7).alias("recall"))


@query("WITH " + R._SCORES + ", y AS (SELECT c_custkey, list_filter([a, b, c], lambda x: x IS NOT NULL) AS s FROM x) SELECT c_custkey, round(list_avg(s), 7) AS score, round(least(list_stddev_pop(s) / 0.5, 1.0), 7) AS disagreement FROM y")
def an10_combined_detectors(spark, d):
    c = anomaly.combine([F.col(k) for k in "abc"])
    return R._domain_scores(spark, d).select("c_custkey", c.alias("x")).select("c_custkey", r7("x.score", "score"), r7("x.disagreement", "disagreement"))


@query("WITH {ev} SELECT event_id, round(least(greatest(amount / 50000, 0.05), 0.95), 7) AS score FROM ev")
def an13_generic_scores(spark, d):
    return events(spark, d).select("event_id", r7(F.coalesce(S.clip(F.col("amount") / 50000, 0.05, 0.95), F.lit(0.20)), "score"))


@query("WITH " + R._SCORES + ", r AS (SELECT c_custkey, least(greatest(a, 0), 1) * 0.35 AS pa, b * 0.2 AS pb, exp(-0.693147 * (c_custkey % 90) / 30.0) * 0.25 AS pr, least(c * 2, 1) * 0.2 AS pc, CASE WHEN a IS NULL THEN 0 ELSE 0.35 END + 0.65 AS w FROM x) SELECT c_custkey, round((coalesce(pa, 0) + pb + pr + pc) / w, 7) AS risk, CASE WHEN (coalesce(pa, 0) + pb + pr + pc) / w >= 0.65 THEN 'HIGH' WHEN (coalesce(pa, 0) + pb + pr + pc) / w >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r")
def rk1_risk(spark, d):
    r = evidence.risk(F.col("a"), F.col("b") * 10, F.col("c_custkey") % 90, F.col("c") * 10)
    return R._domain_scores(spark, d).select("c_custkey", r.alias("r")).select("c_custkey", r7("r.score", "risk"), F.col("r.level").alias("level"))


@query()
def rl2_evidence_clusters(spark, d):
    e = table(spark, d, "temporal_sequence").select(F.xxhash64("event_id", "ingested_at").alias("id"), "event_id", "evidence_ref").distinct()
    return evidence.dependency_clusters(e, "id", ["event_id", "evidence_ref"]).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH {ev}, o AS (SELECT actor_id, event_type AS x, row_number() OVER (PARTITION BY actor_id ORDER BY t, event_id) AS k FROM ev), p1 AS (SELECT actor_id, x AS p, min(k) AS k FROM o GROUP BY 1, 2),
    p2 AS (SELECT p1.actor_id, concat(p, ' > ', x) AS p, min(o.k) AS k FROM p1 JOIN o ON o.actor_id = p1.actor_id AND o.k > p1.k GROUP BY 1, 2), p3 AS (SELECT p2.actor_id, concat(p, ' > ', x) AS p, min(o.k) AS k FROM p2 JOIN o ON o.actor_id = p2.actor_id AND o.k > p2.k GROUP BY 1, 2),
    p4 AS (SELECT p3.actor_id, concat(p, ' > ', x) AS p, min(o.k) AS k FROM p3 JOIN o ON o.actor_id = p3.actor_id AND o.k > p3.k GROUP BY 1, 2) SELECT p AS pattern, count(*) AS support FROM (SELECT p FROM p2 UNION ALL SELECT p FROM p3 UNION ALL SELECT p FROM p4) GROUP BY 1"""
)
def seq2_sequential_patterns(spark, d):
    p = learning.sequential_patterns(events(spark, d), "actor_id", "event_type", ["t", "event_id"], 0.001, 4)
    return p.where(F.contains("pattern", F.lit(" > "))).select("pattern", "support")


@query()
def ml1_trajectory_predictor(spark, d):
    e = temporal.future_label(temporal.trailing_features(events(spark, d)), F.col("event_type") == "error", 6 * temporal.HOUR)
    cut = F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    _, scored = learning.train_predictor(e, ["count_1h", "count_15m", "amount_1h", "mean_gap_1h", "acceleration", "amount"], "label", cut, iterations=5)
    return anomaly.ranking_metrics(scored, "p", "label")


@query("WITH {ev}, g AS (SELECT event_id, (count(*) OVER q) / greatest(1.0, (count(*) OVER h) / 4.0) AS a FROM ev WINDOW h AS (PARTITION BY actor_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), q AS (PARTITION BY actor_id ORDER BY t RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW)), p AS (SELECT event_id, least(greatest(0.15 + 0.25 * least(a, 3.0), 0.05), 0.95) AS p FROM g) SELECT event_id, round(p, 7) AS p, CASE WHEN p >= 0.7 THEN 'ELEVATED' WHEN p >= 0.4 THEN 'WATCH' ELSE 'NORMAL' END AS state FROM p")
def ml3_fallback_trajectory(spark, d):
    f = temporal.trailing_features(events(spark, d)).select("event_id", learning.fallback_trajectory(F.col("acceleration")).alias("x"))
    return f.select("event_id", r7("x.p", "p"), F.col("x.state").alias("state"))


@query("WITH {ev}, x AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 'train' WHEN ts < TIMESTAMP '2024-01-16' THEN 'val' ELSE 'test' END AS part, t FROM ev), s AS (SELECT part, min(t) AS lo, max(t) AS hi FROM x GROUP BY 1) SELECT (SELECT hi FROM s WHERE part = 'train') < (SELECT lo FROM s WHERE part = 'val') AND (SELECT hi FROM s WHERE part = 'val') < (SELECT lo FROM s WHERE part = 'test') AS in_order")
def ex5_splits_in_order(spark, d):
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    x = events(spark, d).withColumn("part", F.when(F.col("ts") < day("2024-01-12 00:00:00"), "train").when(F.col("ts") < day("2024-01-16 00:00:00"), "val").otherwise("test"))
    return learning.splits_in_order(x, "t", "part", ["train", "val", "test"])


# ---- quality, state ----


@query("SELECT CASE WHEN max(revised_at) IS NULL THEN 'UNKNOWN' WHEN greatest(date_diff('day', CAST(max(revised_at) AS DATE), DATE '2026-08-15'), 0) > 180 THEN 'CRITICAL' WHEN greatest(date_diff('day', CAST(max(revised_at) AS DATE), DATE '2026-08-15'), 0) > 30 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, CAST(greatest(date_diff('day', CAST(max(revised_at) AS DATE), DATE '2026-08-15'), 0) AS INT) AS days FROM documents")
def dq8_freshness(spark, d):
    return quality.freshness_days(table(spark, d, "documents"), "revised_at", F.lit("2026-08-15").cast("date"))


@query("WITH {ev}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, CASE WHEN n / 2000.0 < 0.2 OR n / 2000.0 > 3 THEN 'CRITICAL' WHEN n / 2000.0 < 0.8 OR n / 2000.0 > 1.5 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM n")
def dq9_volume(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", quality.volume_status(F.col("n"), 2000.0).alias("status"))


@query("SELECT CASE WHEN len(list_filter(['BANK', 'CDR', 'IPDR', 'SOCIAL'], lambda x: NOT list_contains(f, x))) > 0 THEN 'CRITICAL' WHEN len(list_filter(f, lambda x: NOT list_contains(['BANK', 'CDR', 'IPDR', 'SOCIAL'], x))) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM (SELECT list(DISTINCT upper(trim(source_domain))) AS f FROM temporal_sequence)")
def dq10_domains(spark, d):
    found = table(spark, d, "temporal_sequence").agg(F.collect_set(F.upper(F.trim("source_domain"))).alias("f"))
    return found.select(quality.domain_status(F.col("f"), ["BANK", "CDR", "IPDR", "SOCIAL"]).alias("status"))


@query("WITH s AS (SELECT case_id, entity_id, upper(trim(requested_state)) AS dst, lag(upper(trim(requested_state))) OVER (PARTITION BY concat(case_id, '/', entity_id) ORDER BY delivery_id) AS src FROM features5_6_events WHERE event_type LIKE 'IDENTITY!_%' ESCAPE '!' AND requested_state IS NOT NULL) SELECT concat(case_id, '/', entity_id) AS link, src, dst FROM s WHERE src IS NOT NULL AND NOT ((src = 'POSSIBLE' AND dst = 'CONFIRMED') OR (src = 'NONE' AND dst = 'POSSIBLE'))")
def ld1_forbidden_transitions(spark, d):
    log = table(spark, d, "features5_6_events").where("event_type LIKE 'IDENTITY\\_%' and requested_state is not null").select(F.concat_ws("/", "case_id", "entity_id").alias("link"), "delivery_id", F.upper(F.trim("requested_state")).alias("state"))
    allowed = spark.createDataFrame([("POSSIBLE", "CONFIRMED"), ("NONE", "POSSIBLE")], "src string, dst string")
    return evidence.forbidden_transitions(log, "link", ["delivery_id"], "state", allowed)


@query("WITH {ev} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start_ts, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def st12_tumbling_windows(spark, d):
    w = events(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@query("SELECT user_id AS actor_id, event_type, count(*) AS n, round(sum(value), 7) AS total, max(value) AS largest FROM events GROUP BY 1, 2")
def st8_running_state(spark, d):
    """The running summary after the whole table has streamed through (one file a batch, update mode upserted by key)."""
    import uuid

    from tracewright.session import shared_dir

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # A stream reads folders: the table's file is named by a glob.
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet").withColumnRenamed("user_id", "actor_id")
    runtime.drain(runtime.running_summary_stream(stream, "actor_id", "value", "event_type"), "", f"{base}/cp", "update", lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out"))
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("actor_id", "event_type").agg(F.max_by(F.struct("n", "total", "largest"), "batch").alias("x"))
    return last.select("actor_id", "event_type", "x.n", F.round("x.total", 7).alias("total"), "x.largest")


# ---- sequences, conflict, sessions of state ----


@query("WITH {ev} SELECT actor_id, string_agg(event_type, ',' ORDER BY t, event_id) AS sequence FROM ev GROUP BY 1")
def seq3_sequences(spark, d):
    s = events(spark, d).groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type")))["event_type"].alias("x"))
    return s.select("actor_id", F.array_join("x", ",").alias("sequence"))


@query()
def seq5_warping(spark, d):
    """Dynamic time warping of each user's amounts and gaps, in order of time, against the next user's."""
    from tracewright.operators import sequences

    e = temporal.gaps(events(spark, d))
    s = e.groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", F.array(F.col("amount") / 100, F.least(F.coalesce("gap_s", F.lit(0.0)) / 3600, F.lit(1.0))).alias("v"))))["v"].alias("a"))
    other = s.select((F.col("actor_id") - 1).alias("actor_id"), F.col("a").alias("b"))
    return sequences.dtw_scores(s.join(other, "actor_id"), "a", "b").select("actor_id", "dtw", "similarity")


@query()
def seq13_series_motifs(spark, d):
    """The most alike pair of weeks in each user's daily totals."""
    from tracewright.operators import sequences

    daily = R._daily(spark, d).groupBy("actor_id").agg(F.array_sort(F.collect_list(F.struct("d", "v")))["v"].alias("xs"))
    return sequences.series_motifs(daily, "actor_id", "xs", 7)


@query("WITH {ev}, f AS (SELECT actor_id, event_type AS feature, 1 AS store, CAST(count(*) AS DOUBLE) AS v FROM ev GROUP BY 1, 2 UNION ALL SELECT actor_id, event_type, 2, sum(amount) FROM ev WHERE amount > 100 GROUP BY 1, 2) SELECT actor_id, feature, round(arg_max(v, store), 7) AS v FROM f GROUP BY 1, 2")
def jn9_last_store_wins(spark, d):
    e = events(spark, d)
    one = e.groupBy("actor_id", F.col("event_type").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("v")).withColumn("store", F.lit(1))
    two = e.where("amount > 100").groupBy("actor_id", F.col("event_type").alias("feature")).agg(F.sum("amount").alias("v")).withColumn("store", F.lit(2))
    return one.unionByName(two).groupBy("actor_id", "feature").agg(F.round(F.max_by("v", "store"), 7).alias("v"))


@query("WITH {ev}, m AS (SELECT actor_id, source_domain, max(amount) AS x FROM ev GROUP BY 1, 2) SELECT a.actor_id, a.source_domain AS da, b.source_domain AS db, round(abs(a.x - b.x), 7) AS gap FROM m a JOIN m b ON a.actor_id = b.actor_id AND a.source_domain < b.source_domain")
def jn22_domain_pairs(spark, d):
    m = events(spark, d).groupBy("actor_id", "source_domain").agg(F.max("amount").alias("x"))
    # At most one row a domain and entity: ten pairs.
    j = m.select("actor_id", F.col("source_domain").alias("da"), F.col("x").alias("xa")).join(m.select("actor_id", F.col("source_domain").alias("db"), F.col("x").alias("xb")), "actor_id").where("da < db")
    return j.select("actor_id", "da", "db", F.round(F.abs(F.col("xa") - F.col("xb")), 7).alias("gap"))


@query("WITH {ev}, m AS (SELECT actor_id, max(t) - min(t) AS span FROM ev GROUP BY 1) SELECT actor_id, round(least(greatest(1 - span / 1e6 / 2592000.0, 0.05), 1.0), 7) AS coherence FROM m")
def fu9_temporal_coherence(spark, d):
    m = events(spark, d).groupBy("actor_id").agg(((F.max("t") - F.min("t")) / 1e6).alias("span"))
    return m.select("actor_id", r7(fusion.temporal_coherence(F.col("span"), 2592000.0), "coherence"))


@query("SELECT case_id, officer_id, count(*) AS n FROM features5_6_events WHERE case_id = 'CASE-HUB-0001' AND officer_id IS NOT NULL GROUP BY 1, 2")
def src17_case_log(spark, d):
    return table(spark, d, "features5_6_events").where("case_id = 'CASE-HUB-0001' and officer_id is not null").groupBy("case_id", "officer_id").agg(F.count(F.lit(1)).alias("n"))
