"""Ordered and causal analytics: windows, baselines, trailing features, timelines, pivots.

Times are whole microseconds (bigint), so that strict frames are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S

SECOND = 1_000_000
HOUR, QUARTER = 3600 * SECOND, 900 * SECOND


def strictly_before(by: str, t: str):
    return Window.partitionBy(by).orderBy(t).rangeBetween(Window.unboundedPreceding, -1)


def trailing(by: str, t: str, micros: int, strict: bool = False):
    return Window.partitionBy(by).orderBy(t).rangeBetween(-micros, -1 if strict else 0)


def gaps(events: DataFrame, by: str = "actor_id", t: str = "t", tie: str = "event_id") -> DataFrame:
    """``events`` with ``gap_s``: seconds since the event before, null for the first."""
    return events.withColumn("gap_s", (F.col(t) - F.lag(t).over(Window.partitionBy(by).orderBy(t, tie))) / SECOND)


def causal_baselines(features: DataFrame, by: Sequence[str], order: Sequence[str], value: str, last: int = 10) -> DataFrame:
    """Each observation against those before it: median, MAD, robust z, quartiles, percentile rank, mean of the last ten, status.

    Without history the center is the value itself and z is 0; below three values before it the quartiles and the mean
    are the center and there is no rank. The scale is 1.4826 MAD + 1e-9. A key's rows are its windows (days, say), a
    bounded number; history is COLD_START below 3 and LOW_HISTORY below 10.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = features.withColumn("__h", F.collect_list(value).over(w)).withColumn("history_n", F.size("__h"))
    q = lambda p: F.percentile(value, p).over(w)
    out = seen.withColumn("median", q(0.5)).withColumn("q25", q(0.25)).withColumn("q75", q(0.75)).withColumn("rolling_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-last, -1)))
    dev = F.array_sort(F.transform("__h", lambda x: F.abs(x - F.col("median"))))
    n = F.col("history_n")
    mid = F.when(n % 2 == 1, F.get(dev, (n / 2).cast("int"))).otherwise((F.get(dev, (n / 2).cast("int") - 1) + F.get(dev, (n / 2).cast("int"))) / 2)
    out = out.withColumn("mad", F.when(n > 0, mid))
    below = F.size(F.filter("__h", lambda x: x <= F.col(value)))
    enough = lambda c: F.when(n >= 3, F.col(c)).otherwise(F.col("median"))
    return (
        out.withColumn("mad", F.coalesce("mad", F.lit(0.0))).withColumn("median", F.coalesce("median", F.col(value).cast("double")))
        .withColumn("robust_z", F.when(n > 0, (F.col(value) - F.col("median")) / (F.col("mad") * 1.4826 + 1e-9)).otherwise(0.0))
        .withColumns({c: enough(c) for c in ("q25", "q75", "rolling_mean")})
        .withColumn("percentile_rank", F.when(n >= 3, below * 100.0 / n))
        .withColumn("status", F.when(n < 3, "COLD_START").when(n < 10, "LOW_HISTORY").otherwise("STABLE_BASELINE"))
        .drop("__h")
    )


def ewma(features: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.3) -> DataFrame:
    """``features`` with ``ewma``: the first value, then alpha times the value and the rest of what was, folded over each key's windows so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    fold = F.aggregate(F.slice("__h", 2, F.size("__h")), F.element_at("__h", 1), lambda acc, x: acc * (1 - alpha) + x * alpha)
    return features.withColumn("__h", F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("ewma", fold).drop("__h")


def trailing_features(events: DataFrame, by: str = "actor_id", t: str = "t", amount: str = "amount") -> DataFrame:
    """Counts and totals of the last hour and quarter of an hour up to each event (inclusive), gaps, novelty and acceleration."""
    h, q = trailing(by, t, HOUR), trailing(by, t, QUARTER)
    g = gaps(events, by, t)
    pos = F.when(F.col(amount) > 0, F.col(amount))
    return (
        g.withColumn("count_1h", F.count(F.lit(1)).over(h)).withColumn("count_15m", F.count(F.lit(1)).over(q))
        .withColumn("amount_1h", F.coalesce(F.sum(pos).over(h), F.lit(0.0))).withColumn("max_1h", F.coalesce(F.max(pos).over(h), F.lit(0.0)))
        .withColumn("mean_gap_1h", F.coalesce(F.avg("gap_s").over(h), F.lit(1800.0)))
        .withColumn("acceleration", F.col("count_15m") / F.greatest(F.lit(1.0), F.col("count_1h") / 4.0))
    )


def future_label(events: DataFrame, flag: Column, horizon: int, by: str = "actor_id", t: str = "t") -> DataFrame:
    """``events`` with ``label``: whether a later event of the key, up to ``horizon`` microseconds on, has the flag; ties are not later."""
    w = Window.partitionBy(by).orderBy(t).rangeBetween(1, horizon)
    return events.withColumn("label", F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)))


def walk_forward(events: DataFrame, by: str = "actor_id", t: str = "t", target: str = "target_id") -> DataFrame:
    """Per event what was known before it: history, rate, burst of the last hour, whether the counterparty is new.

    Novelty is one aggregate (first time of each pair) joined back, not a growing list per row.
    """
    first = events.groupBy(by, target).agg(F.min(t).alias("__first"))
    prior, hour = strictly_before(by, t), trailing(by, t, HOUR, strict=True)
    e = events.withColumn("prior_n", F.count(F.lit(1)).over(prior)).withColumn("burst_1h", F.count(F.lit(1)).over(hour)).withColumn("prior_first", F.min(t).over(prior))
    e = e.join(first, [by, target], "left").withColumn("new_counterparty", F.coalesce(F.col("__first") == F.col(t), F.lit(False)))
    rate = F.col("prior_n") / F.greatest((F.col(t) - F.col("prior_first")) / HOUR, F.lit(1 / 3600))
    return e.withColumn("rate_per_h", F.when(F.col("prior_n") >= 2, rate)).withColumn("status", F.when(F.col("prior_n") < 2, "INSUFFICIENT").otherwise("SCORED")).drop("__first", "prior_first")


def ordered_sequence(events: DataFrame, by: str, keys: Sequence[Column], tie: Sequence[str]) -> DataFrame:
    """``events`` with ``position`` (0-based) in a deterministic order, nulls last, and ``is_tied`` where ``tie`` does not tell two apart."""
    w = Window.partitionBy(by).orderBy(*keys)
    return events.withColumn("position", F.row_number().over(w) - 1).withColumn("is_tied", F.count(F.lit(1)).over(Window.partitionBy(by, *tie)) > 1)


def sessions(events: DataFrame, by: str = "actor_id", t: str = "t", gap_micros: int = HOUR, tie: str = "event_id") -> DataFrame:
    """``events`` with ``session``: a new one begins after a pause longer than ``gap_micros``."""
    w = Window.partitionBy(by).orderBy(t, tie)
    new = F.when(F.col(t) - F.lag(t).over(w) > gap_micros, 1).otherwise(0)
    return events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def arrival_status(events: DataFrame, by: str, t: str, arrival: Sequence[str], late_micros: int = 600 * SECOND) -> DataFrame:
    """IN_ORDER, OUT_OF_ORDER_ACCEPTED or LATE_EVENT_FLAGGED against the latest time seen before, in order of arrival; a late event never moves it."""
    before = F.max(t).over(Window.partitionBy(by).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("ordering", F.when(before.isNull() | (F.col(t) >= before), "IN_ORDER").when(before - F.col(t) <= late_micros, "OUT_OF_ORDER_ACCEPTED").otherwise("LATE_EVENT_FLAGGED"))


def chain_breaks(log: DataFrame, by: str, order: str, digest: str, previous: str) -> DataFrame:
    """Rows whose link to the row before is wrong, or whose number does not follow on."""
    w = Window.partitionBy(by).orderBy(order)
    return log.withColumn("__p", F.lag(digest).over(w)).withColumn("__o", F.lag(order).over(w)).where((F.col("__p").isNotNull() & ~F.col("__p").eqNullSafe(F.col(previous))) | (F.col("__o").isNotNull() & (F.col(order) != F.col("__o") + 1))).drop("__p", "__o")


def ngrams(events: DataFrame, low: int = 2, high: int = 4, by: str = "actor_id", t: str = "t", label: str = "event_type", tie: str = "event_id") -> DataFrame:
    """(pattern, length, n, mean_span_s, first_start, last_end) of contiguous runs of ``low`` to ``high`` labels."""
    w = Window.partitionBy(by).orderBy(t, tie)
    ahead = events
    for k in range(1, high):
        ahead = ahead.withColumn(f"__l{k}", F.lead(label, k).over(w)).withColumn(f"__t{k}", F.lead(t, k).over(w))
    grams = [
        F.when(F.col(f"__l{n - 1}").isNotNull(), F.struct(F.lit(n).alias("length"), F.concat_ws(" -> ", F.col(label), *[F.col(f"__l{k}") for k in range(1, n)]).alias("pattern"), F.col(t).alias("s"), F.col(f"__t{n - 1}").alias("e")))
        for n in range(low, high + 1)
    ]
    return ahead.select(F.explode(F.array_compact(F.array(*grams))).alias("g")).select("g.*").groupBy("pattern", "length").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("e") - F.col("s")) / SECOND).alias("mean_span_s"), F.min("s").alias("first_start"), F.max("e").alias("last_end"))


def transitions(events: DataFrame, by: str = "actor_id", t: str = "t", label: str = "event_type", tie: str = "event_id") -> DataFrame:
    """(src, dst, n, mean, median, least and most gap in seconds) of consecutive events."""
    w = Window.partitionBy(by).orderBy(t, tie)
    pair = events.select(F.lag(label).over(w).alias("src"), F.col(label).alias("dst"), ((F.col(t) - F.lag(t).over(w)) / SECOND).alias("gap")).where("src is not null")
    return pair.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))


def previous_events(events: DataFrame, pivots: DataFrame, k: int, by: str = "actor_id", t: str = "t", tie: str = "event_id", inclusive: bool = False, after: bool = False) -> DataFrame:
    """For each pivot (by, pivot_t) its ``k`` nearest events before (or after) it, nearest first, as ``rank``.

    Events are numbered in order, and one ordered pass over events and pivots together counts the events up to each pivot;
    its neighbours are then looked up by their numbers, so no pivot meets the whole history of its entity. Pivots
    without a key or time have no neighbours; repeated pivots repeat theirs.
    """
    numbered = events.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(t, tie)))
    at = pivots.where(F.col(by).isNotNull() & F.col("pivot_t").isNotNull()).withColumn("__p", F.struct(*pivots.columns))
    marks = events.select(F.col(by).alias("__k"), F.col(t).alias("__t"), F.lit(1).alias("__e"), F.lit(None).cast(at.schema["__p"].dataType).alias("__p")).where("__t is not null").unionByName(at.select(F.col(by).alias("__k"), F.col("pivot_t").alias("__t"), F.lit(0).alias("__e"), "__p"))
    # Up to and with the pivot's own time, or strictly before it.
    upto = 0 if inclusive != after else -1
    c = F.sum("__e").over(Window.partitionBy("__k").orderBy("__t").rangeBetween(Window.unboundedPreceding, upto))
    found = marks.withColumn("__c", F.coalesce(c, F.lit(0))).where("__e = 0").select("__p", "__c", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    place = F.col("__c") + F.col("rank") if after else F.col("__c") - F.col("rank") + 1
    found = found.select(F.col(f"__p.{by}").alias(by), place.alias("__n"), *[F.col(f"__p.{x}").alias(x) for x in pivots.columns if x != by], F.col("rank").cast("int").alias("rank"))
    # Rows without a time come first in order and are nobody's neighbours.
    blank = events.where(F.col(t).isNull()).groupBy(by).agg(F.count(F.lit(1)).alias("__b"))
    found = found.join(blank, by, "left").withColumn("__n", F.col("__n") + F.coalesce("__b", F.lit(0))).where("__n > coalesce(__b, 0)").drop("__b")
    return numbered.join(found, [by, "__n"]).drop("__n")


def around(events: DataFrame, pivots: DataFrame, before: int, after: int, by: str = "actor_id", t: str = "t") -> DataFrame:
    """Events in [T - before, T) and (T, T + after] of each pivot, with ``side``.

    Both are met in buckets of time as wide as the longer side, of which a pivot reaches three at most.
    """
    width = max(before, after, 1)
    b = lambda c: F.floor(c / width)
    near = pivots.withColumn("__b", F.explode(F.sequence(b(F.col("pivot_t") - before), b(F.col("pivot_t") + after))))
    j = events.withColumn("__b", b(F.col(t))).join(near, [by, "__b"]).drop("__b").where((F.col(t) != F.col("pivot_t")) & (F.col(t) >= F.col("pivot_t") - before) & (F.col(t) <= F.col("pivot_t") + after))
    return j.withColumn("side", F.when(F.col(t) < F.col("pivot_t"), "PRE").otherwise("POST"))


def between(events: DataFrame, start: int, end: int, t: str = "t", closed: bool = True) -> DataFrame:
    """[start, end], or [start, end) unless ``closed``. A reversed window raises ValueError."""
    if start > end:
        raise ValueError("the window ends before it starts")
    return events.where((F.col(t) >= start) & ((F.col(t) <= end) if closed else (F.col(t) < end)))


def require_observed_time(basis: str) -> None:
    """Calendar windows make no sense over surrogate times."""
    if basis != "OBSERVED_TIMESTAMP":
        raise ValueError(f"calendar windows need observed timestamps, not {basis}")


def future_violations(events: DataFrame, pivot: int, t: str = "t", seq: str | None = None, pivot_seq: int | None = None) -> DataFrame:
    """Rows that evidence for a pivot must not hold: later ones, and simultaneous ones not known to come first."""
    same = F.lit(True) if seq is None or pivot_seq is None else (F.col(seq).isNull() | (F.col(seq) >= pivot_seq))
    return events.where((F.col(t) > pivot) | ((F.col(t) == pivot) & same))


def pivot_deviation(events: DataFrame, by: str = "actor_id", t: str = "t", amount: str = "amount") -> DataFrame:
    """Each event's amount against those strictly before: z with a deviation of at least 1, and z / 5 clipped."""
    w = strictly_before(by, t)
    z = (F.col(amount) - F.avg(amount).over(w)) / F.greatest(F.stddev_pop(amount).over(w), F.lit(1.0))
    return events.withColumn("z", z).withColumn("deviation", S.clip(F.coalesce(F.abs("z") / 5, F.lit(0.0)), 0, 1))


def first_dataset(rows: DataFrame, by: str, dataset: str, order: Sequence[str]) -> DataFrame:
    """(by, dataset): the first dataset in ``order`` that holds the entity; others come after, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(dataset))
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.min_by(dataset, F.struct(F.when(place > 0, place).otherwise(len(order) + 1), dataset)).alias(dataset))


def timeline(stored: DataFrame, live: DataFrame, start: int, end: int, t: str = "t") -> DataFrame:
    """Stored and live rows within [start, end], with ``origin``; sort with nulls last for showing."""
    return between(stored.withColumn("origin", F.lit("CASE")).unionByName(live.withColumn("origin", F.lit("LIVE")), allowMissingColumns=True), start, end, t)
