"""Messages delivered at least once: keep exactly one delivery of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import materialize

HOT_SHARE = 1 / 1000
#: Bits of the filter of repeated identifiers: 2**26 of them in 2**20 words of 64, whatever the input.
BITS = 26


def split_by_frequency(rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows`` in two parts, those whose key certainly occurs once (or is null) and the rest, and (__h, __n) of the repeated keys' hashes.

    Only hashes of keys are exchanged. The repeated ones are kept as bits of a filter of fixed size, which is broadcast;
    rows whose bit is not set stay in their task. Keys that share a bit with a repeated one are in the rest too.
    """
    h = F.xxhash64(key)
    repeated = materialize(rows.where(key.isNotNull()).select(h.alias("__h")).groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    bit = F.pmod("__h", F.lit(1 << BITS))
    words = repeated.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("__bits"))
    split = rows.withColumn("__h", F.when(key.isNotNull(), h)).withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 6)).join(F.broadcast(words), "__word", "left")
    set_ = F.coalesce(F.expr("getbit(__bits, cast(__bit & 63 as int)) = 1"), F.lit(False))
    single, several = split.where(~set_), split.where(set_)
    return single.drop("__h", "__bit", "__word", "__bits"), several.drop("__bit", "__word", "__bits"), repeated


def mark_first(
    stored: DataFrame,
    key: Column,
    order: Sequence[Column],
    new: DataFrame | None = None,
    hot_share: float = HOT_SHARE,
    salts: int = 64,
) -> DataFrame:
    """Every row of ``stored`` and ``new`` with ``is_first``: true for the one delivery of a message to keep.

    Identifiers are split by their aggregated frequency (see :func:`split_by_frequency`): singletons pass directly, their
    payload never leaving its task, and the others are ranked by identifier. The more identifiers repeat, the more rows
    are ranked, but no result changes. Repeated identifiers that hold more than ``hot_share`` of the rows (at most
    ``1 / hot_share`` of them can exist, which bounds that broadcast) are ranked within salts against the least ``order``
    of all, an aggregate, so no task ever holds a whole hot group.

    Nulls: a row whose key is null is a message of its own and is first. Ties in ``order`` are broken by a hash of the
    whole row; rows equal in every column are interchangeable. ``new`` may have other or fewer columns (missing ones
    become null). An empty table gives an empty table. A column of the input named ``is_first`` is replaced.
    """
    rows = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    names = [c for c in rows.columns if c != "is_first"]
    packed = rows.select(
        F.struct(*[rows[c] for c in names]).alias("__row"),
        key.alias("__key"),
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(*[rows[c] for c in names if not _has_map(rows, c)]).alias("h")).alias("__order"),
    )
    single, several, repeated = split_by_frequency(packed, F.col("__key"))
    hot = repeated.where(F.col("__n") > max(int(rows.count() * hot_share), 1)).select("__h")
    if hot.isEmpty():
        first = F.row_number().over(Window.partitionBy("__key").orderBy("__order")) == 1
    else:
        least = several.join(F.broadcast(hot), "__h").groupBy("__key").agg(F.min("__order").alias("__least"))
        several = several.join(F.broadcast(least), "__key", "left").withColumn("__salt", F.when(F.col("__least").isNotNull(), F.pmod(F.xxhash64("__order"), F.lit(salts))))
        # Rows that tie for the least have one salt.
        first = (F.row_number().over(Window.partitionBy("__key", "__salt").orderBy("__order")) == 1) & (F.col("__least").isNull() | (F.col("__order") == F.col("__least")))
    every = single.select("__row", F.lit(True).alias("is_first")).unionByName(several.select("__row", first.alias("is_first")))
    return every.select(*[F.col("__row").getField(c).alias(c) for c in names], "is_first")


def _has_map(df: DataFrame, name: str) -> bool:
    kind = df.schema[name].dataType.simpleString()
    return "map<" in kind or "variant" in kind


def deduplicate(stored: DataFrame, key: Column, order: Sequence[Column], new: DataFrame | None = None, **kw) -> DataFrame:
    """The rows to keep, one per message; see :func:`mark_first` for nulls, ties and hot identifiers."""
    return mark_first(stored, key, order, new, **kw).where("is_first").drop("is_first")


def repeated_deliveries(stored: DataFrame, key: Column, order: Sequence[Column], new: DataFrame | None = None, **kw) -> DataFrame:
    """The rows to drop: each delivery of a message that has one before it in ``order``."""
    return mark_first(stored, key, order, new, **kw).where("not is_first").drop("is_first")
