"""Data quality: rates from one pass over a table, and their levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (degraded above, critical above).
LIMITS = {"completeness": (0.05, 0.20), "timestamp": (0.02, 0.10), "identifier": (0.02, 0.10), "duplicate": (0.01, 0.15), "referential": (0.01, 0.10), "domain": (0.0, 0.10), "consistency": (0.02, 0.10), "rejection": (0.05, 0.20)}
PLACEHOLDERS = ("UNKNOWN", "NULL", "NONE", "N/A", "NAN", "-", "0")


def level(rate: Column, dimension: str) -> Column:
    degraded, critical = LIMITS[dimension]
    return F.when(rate.isNull(), "UNKNOWN").when(rate > critical, "CRITICAL").when(rate > degraded, "DEGRADED").otherwise("HEALTHY")


def rates(df: DataFrame, wrong: Mapping[str, Column]) -> DataFrame:
    """(dimension, rate, status): the share of rows for which each condition holds, all in one pass; null rates for an empty table."""
    one = df.agg(*[F.avg(F.coalesce(w, F.lit(False)).cast("double")).alias(d) for d, w in wrong.items()])
    cells = one.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("rate"), level(F.col(d), d).alias("status")) for d in wrong])).alias("x"))
    return cells.select("x.*")


def missing_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (rate): null or blank cells of all cells of ``columns``; null for an empty table."""
    bad = sum((F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)).cast("int") for c in columns), F.lit(0))
    return df.agg(F.try_divide(F.sum(bad), F.count(F.lit(1)) * len(columns)).alias("rate"))


def placeholder(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c.cast("string"))).isin("", *PLACEHOLDERS)


def duplicate_rate(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row (rate): rows beyond the first of their key; null counts as one value."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") - 1) / F.sum("n")).alias("rate"))


def broken_references(df: DataFrame, column: str, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is there but names nothing."""
    return df.where(F.col(column).isNotNull()).join(valid.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def schema_gaps(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that are missing; no job runs."""
    return [c for c in required if c not in df.columns]


def freshness_days(df: DataFrame, ts: str, reference: Column) -> DataFrame:
    d = F.greatest(F.datediff(reference, F.max(ts)), F.lit(0))
    return df.agg(d.alias("days")).withColumn("status", F.when(F.col("days").isNull(), "UNKNOWN").when(F.col("days") > 180, "CRITICAL").when(F.col("days") > 30, "DEGRADED").otherwise("HEALTHY"))


def volume_status(n: Column, baseline: float) -> Column:
    r = n / F.lit(baseline)
    return F.when((r < 0.2) | (r > 3), "CRITICAL").when((r < 0.8) | (r > 1.5), "DEGRADED").otherwise("HEALTHY")


def domain_status(found: Column, expected: Sequence[str]) -> Column:
    want = F.array(*[F.lit(d) for d in expected])
    return F.when(F.size(F.array_except(want, found)) > 0, "CRITICAL").when(F.size(F.array_except(found, want)) > 0, "DEGRADED").otherwise("HEALTHY")


def overall(statuses: DataFrame, status: str = "status") -> DataFrame:
    """One row: the worst status; UNKNOWN only if nothing is known."""
    any_of = lambda s: F.coalesce(F.bool_or(F.col(status) == s), F.lit(False))
    return statuses.agg(F.when(any_of("CRITICAL"), "CRITICAL").when(any_of("DEGRADED"), "DEGRADED").when(any_of("HEALTHY"), "HEALTHY").otherwise("UNKNOWN").alias("overall"))


def vocabulary_rate(df: DataFrame, checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row (rate): cells of the named columns that hold none of their known values, over the rows, 1 at most."""
    bad = sum((F.coalesce(~F.col(c).isin(*known), F.lit(True)).cast("int") for c, known in checks.items()), F.lit(0))
    return df.agg(F.least(F.try_divide(F.sum(bad), F.count(F.lit(1))), F.lit(1.0)).alias("rate"))


def hash_status(df: DataFrame, digest: str) -> DataFrame:
    """One row (bad, status) of provenance without a manifest: HEALTHY only if every row has a hash of 64 hexadecimal digits."""
    return df.agg(F.count_if(~F.coalesce(F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("bad")).withColumn("status", F.when(F.col("bad") == 0, "HEALTHY").otherwise("DEGRADED"))


def rejection_status(df: DataFrame, received: Column, accepted: Column, rejected: Column) -> DataFrame:
    """``df`` with ``rate`` and ``status``: CRITICAL where the counts do not add up, else by the rate of rejections."""
    rate = F.try_divide(rejected.cast("double"), received)
    return df.withColumn("rate", rate).withColumn("status", F.when(received != accepted + rejected, "CRITICAL").otherwise(level(rate, "rejection")))


def source_health(parts: Sequence[DataFrame]) -> DataFrame:
    """(dimension, rate, status) of several checks, and a row 'overall' with the worst."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.unionByName(overall(every).select(F.lit("overall").alias("dimension"), F.lit(None).cast("double").alias("rate"), F.col("overall").alias("status")))
