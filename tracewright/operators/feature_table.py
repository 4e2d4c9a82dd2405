"""Per-entity feature tables from long event logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.dedupe import split_by_frequency
from tracewright.session import bucketed, materialize

MEASURES = {"n_events": "sum", "last_at": "max", "total": "sum"}


def cell_features(events: DataFrame, entity: str, cell: Sequence[str], event_id: str | None, at: str, amount: str) -> DataFrame:
    """Count, latest time and total of every (entity, cell) that occurs: ``n_events``, ``last_at``, ``total``.

    ``event_id`` counts once: of rows with the same id the least (by entity, cell, time, amount) is taken; only rows whose
    id repeats are exchanged for that. All steps combine within the map tasks, so a hot entity or id costs no more than
    any other. Rows with a null entity or cell
    part do not count; a null ``event_id`` makes the row an event of its own. Null times do not enter ``last_at`` and
    null amounts count 0. Empty input gives an empty table.
    """
    need = [entity, *cell, at, amount]
    rows = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [entity, *cell]))
    if event_id:
        single, several, _ = split_by_frequency(rows.select(event_id, *need), F.col(event_id))
        once = several.groupBy(event_id).agg(F.min(F.struct(*need)).alias("__e")).select("__e.*")
        rows = single.select(*need).unionByName(once)
    return rows.groupBy(entity, *cell).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("last_at"), F.sum(F.coalesce(F.col(amount), F.lit(0))).alias("total"))


def feature_blocks(events: DataFrame, entity: str, cell: Sequence[str], event_id: str | None, at: str, amount: str, entities: DataFrame, blocks: int = 4, buckets: int | None = None) -> DataFrame:
    """One row per entity of ``entities`` (and of ``events``) with an array ``block_<i>`` of its cells (see :func:`cell_features`) in each block of event types.

    Types, the first of ``cell``, are spread over ``blocks`` by hash. The cells are written once, a folder per block; each
    block is gathered by entity into a table bucketed by it, and as all blocks and the entity table are bucketed alike,
    joining them moves nothing. An array holds at most the combinations of one block, so a hot entity's row is bounded by
    the vocabulary and not by its events. Entities without events get null blocks; null entities are left out.
    """
    cells = cell_features(events, entity, cell, event_id, at, amount)
    buckets = buckets or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(cells.withColumn("__block", F.pmod(F.xxhash64(cell[0]), F.lit(blocks)).cast("int")), ["__block"])
    whole = bucketed(entities.select(entity).union(stored.select(entity)).where(F.col(entity).isNotNull()).distinct(), entity, buckets)
    rest = [c for c in cells.columns if c != entity]
    for i in range(blocks):
        gathered = stored.where(F.col("__block") == i).repartition(buckets, entity).groupBy(entity).agg(F.collect_list(F.struct(*rest)).alias(f"block_{i}"))
        whole = whole.join(bucketed(gathered, entity, buckets), entity, "left")
    return whole


def long_features(table: DataFrame, entity: str) -> DataFrame:
    """The cells of a blocked feature table, one row each."""
    blocks = [F.coalesce(F.col(c), F.array().cast(table.schema[c].dataType)) for c in table.columns if c.startswith("block_")]
    return table.select(entity, F.explode(F.concat(*blocks)).alias("__c")).select(entity, "__c.*")


def wide_features(table: DataFrame, entity: str, names: Sequence[str], name_of: str = "event_type", measures: Mapping[str, str] = MEASURES) -> DataFrame:
    """One row per entity with named columns ``<name>_<measure>`` for given values of ``name_of``, added up over the other cell parts; 0, or null for the latest time, where an entity has none.

    ``measures`` says how each is put together, by sum or max. The cells of a row are first gathered in a map from name to
    measures, so a column is one look-up however many there are.
    """
    blocks = [F.coalesce(F.col(c), F.array().cast(table.schema[c].dataType)) for c in table.columns if c.startswith("block_")]
    every = table.select(entity, F.concat(*blocks).alias("__all"))
    cells = every.select(entity, F.explode_outer("__all").alias("c")).select(entity, F.col(f"c.{name_of}").alias("__name"), *[F.col(f"c.{m}").alias(m) for m in measures])
    # The exchange by entity of the bucketed tables holds for both steps.
    one = cells.groupBy(entity, "__name").agg(*[getattr(F, how)(m).alias(m) for m, how in measures.items()])
    row = one.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.when(F.col("__name").isNotNull(), F.struct("__name", F.struct(*measures))))).alias("__m"))

    def of(name: str, measure: str, how: str) -> Column:
        got = F.try_element_at("__m", F.lit(name))[measure]
        return F.coalesce(got, F.lit(0)) if how == "sum" else got

    return row.select(entity, *[of(n, m, how).alias(f"{n}_{m}") for n in names for m, how in measures.items()])
