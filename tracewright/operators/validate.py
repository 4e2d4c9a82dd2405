"""Validation with full row accountability, normalisation and canonical events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S

DOMAINS = ("CDR", "IPDR", "BANK", "SOCIAL")
ACCEPTED = "ACCEPTED"


def coalesce_aliases(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several columns that is there and not blank."""
    there = [F.nullif(S.clean_identifier(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def reason_code(checks: Sequence[tuple[Column, str]]) -> Column:
    """The code of the first failing check, else ACCEPTED. A check is (what is wrong, code); null counts as not wrong."""
    out = None
    for wrong, code in checks:
        w = F.coalesce(wrong, F.lit(False))
        out = F.when(w, F.lit(code)) if out is None else out.when(w, F.lit(code))
    return out.otherwise(F.lit(ACCEPTED))


def mark_repeated_payloads(df: DataFrame, payload: Sequence[str], order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``payload_hash`` and ``is_repeat``: a payload seen on an earlier row (of the same file, if named).

    The first row of a payload is found by an aggregate, so a payload that fills a third of the table is no hot window.
    """
    hashed = df.withColumn("payload_hash", S.pipe_hash(*[F.col(c) for c in payload]))
    first = hashed.groupBy(*within, "payload_hash").agg(F.min(F.struct(*order)).alias("__first"))
    return hashed.join(first, [*within, "payload_hash"]).withColumn("is_repeat", F.struct(*order) != F.col("__first")).drop("__first")


def validate_events(df: DataFrame, domain: str, actor: Column, ts: Column, event_type: Column, types: Sequence[str], amount: Column | None = None, duration: Column | None = None) -> DataFrame:
    """``df`` with ``reason``; the first failing check wins: domain, repeated payload, actor, time, type, domain rule.

    A wrong domain has code INVALID_EVENT_TYPE and a repeated payload DUPLICATE_SOURCE_ROW, even where the row would be
    wrong otherwise. ``is_repeat`` must be there (see :func:`mark_repeated_payloads`).
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)
    checks = [
        (~F.col(domain).isin(*DOMAINS) | F.col(domain).isNull(), "INVALID_EVENT_TYPE"),
        (F.col("is_repeat"), "DUPLICATE_SOURCE_ROW"),
        (F.coalesce(S.clean_identifier(actor.cast("string")), F.lit("")) == "", "MISSING_REQUIRED_FIELD"),
        (ts.isNull(), "INVALID_TIMESTAMP"),
        (event_type.isNull() | ~event_type.isin(*types), "INVALID_EVENT_TYPE"),
    ]
    if duration is not None:
        checks.append(((F.col(domain) == "CDR") & bad(duration), "INVALID_DURATION"))
    if amount is not None:
        checks.append(((F.col(domain) == "BANK") & bad(amount), "INVALID_AMOUNT"))
    return df.withColumn("reason", reason_code(checks))


def accountability(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows received, accepted and rejected, and the rejected by reason; received = accepted + rejected."""
    return df.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("reason") == ACCEPTED, 1).otherwise(0)).alias("accepted")).withColumn("rejected", F.col("n") - F.col("accepted"))


def ip_or_subnet_ok(c: Column) -> Column:
    """An IPv4 address or CIDR block; blank, UNKNOWN and 0.0.0.0/0 pass as well."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    four = rf"^{octet}(\.{octet}){{3}}(/(3[0-2]|[12]?\d))?$"
    six = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*(/(12[0-8]|1[01]\d|\d?\d))?$"
    t = F.trim(F.coalesce(c, F.lit("")))
    return (t == "") | (F.upper(t) == "UNKNOWN") | t.rlike(four) | (t.rlike(six) & ~t.rlike(":::"))


def identifier_kind(c: Column) -> Column:
    """PHONE, IP, ACCOUNT, HANDLE or USER_ID, by the first rule that fits."""
    return (
        F.when(F.contains(c, F.lit("555")) | F.contains(c, F.lit("+")) | c.rlike(r"^\d+$"), "PHONE")
        .when(F.contains(c, F.lit(".")) & (F.contains(c, F.lit("/")) | (F.size(F.split(c, r"\.")) == 4)), "IP")
        .when(c.startswith("ACC"), "ACCOUNT")
        .when(c.startswith("@"), "HANDLE")
        .otherwise("USER_ID")
    )


def canonical_events(df: DataFrame, event_id: Column, ts: Column, actor: Column, target: Column, event_type: Column, domain: Column, attributes: Mapping[str, Column]) -> DataFrame:
    """The eight canonical columns, the last a hash over the first seven."""
    attrs = F.to_json(F.struct(*[attributes[k].alias(k) for k in sorted(attributes)])) if attributes else F.lit("{}")
    base = df.select(event_id.cast("string").alias("event_id"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), actor.cast("string").alias("actor_id"), target.cast("string").alias("target_id"), event_type.alias("event_type"), domain.alias("source_domain"), attrs.alias("attributes"))
    return base.withColumn("sha256_hash", S.pipe_hash(*[F.col(c) for c in base.columns]))


def provenance_ledger(df: DataFrame, source_id: Column, source_file: str, row_index: Column, version: str = "1.0") -> DataFrame:
    """One ledger row per event hash."""
    return df.select("sha256_hash", source_id.alias("source_id"), F.lit(source_file).alias("source_file"), row_index.alias("source_row_index"), F.lit(version).alias("schema_version"))


#: Columns that tell the truth and must not be seen by inference.
TRUTH = ("is_anomalous", "anomaly_type", "label", "ground_truth", "is_fraud", "attack_cat", "class", "is_true_match", "is_sockpuppet_ring", "is_elevated_state")


def observable(df: DataFrame, strict: bool = False) -> DataFrame:
    """``df`` without columns of ground truth; with ``strict`` they raise ValueError instead."""
    seen = [c for c in df.columns if c.lower() in TRUTH]
    if seen and strict:
        raise ValueError(f"ground truth in the input of inference: {seen}")
    return df.drop(*seen)


def substring_search(df: DataFrame, columns: Sequence[str], needle: str, limit: int | None = None) -> DataFrame:
    """Candidates (value, n_events, confidence) whose value holds ``needle``; 1.0 for equality, else 0.85."""
    values = df.select(F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in columns]))).alias("value")).where(F.contains(F.lower("value"), F.lit(needle.lower())))
    found = values.groupBy("value").agg(F.count(F.lit(1)).alias("n_events")).withColumn("confidence", F.when(F.lower("value") == needle.lower(), 1.0).otherwise(0.85))
    return found.orderBy(F.desc("confidence"), F.desc("n_events"), "value").limit(limit) if limit else found


def scope_errors(checks: Sequence[tuple[Column, str]]) -> Column:
    """The codes of all failing checks, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(c)) for w, c in checks]))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def jaccard(members: DataFrame, group: str, member: str) -> DataFrame:
    """(a, b, jaccard), a < b, of groups that share a member, from an equality join on the member; ``members`` are distinct."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    side = lambda x: members.select(F.col(group).alias(x), F.col(member).alias("m"))
    both = side("a").join(side("b"), "m").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    return both.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def require_all(left: DataFrame, right: DataFrame, key: str) -> int:
    """0 if every key of ``left`` is in ``right``; else ValueError."""
    gone = left.join(right.select(key).distinct(), key, "left_anti").count()
    if gone:
        raise ValueError(f"{gone} keys without a counterpart")
    return gone


def first_rows(df: DataFrame, order: Sequence[str], limit: int, most: int = 1000) -> DataFrame:
    """A bounded page of a table in order; ``limit`` is between 1 and ``most``."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be within 1 and {most}")
    return df.orderBy(*order).limit(limit)


def search_kind(c: Column) -> Column:
    """What a search term is meant for, by its form: IP, DEVICE, PHONE, ENTITY or NAME."""
    return F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$"), "IP").when(F.upper(c).startswith("DEV"), "DEVICE").when(c.rlike(r"^\+?\d[\d ().-]{6,}$"), "PHONE").when(F.upper(c).startswith("ENT"), "ENTITY").otherwise("NAME")


def registry_hit(exact: Column, status: Column, confidence: Column) -> Column:
    """struct<status, confidence> of a search hit: what is CONFIRMED counts as POSSIBLE unless the hit is exact, at most at .70, or .65 if it was confirmed."""
    down = ~F.coalesce(exact, F.lit(False))
    return F.struct(F.when(down & (status == "CONFIRMED"), "POSSIBLE").otherwise(status).alias("status"), F.when(down & (status == "CONFIRMED"), 0.65).when(down, F.least(confidence, F.lit(0.70))).otherwise(confidence).alias("confidence"))


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to all given values; those that are None do not count."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df
