"""The online path end to end: each micro-batch is numbered, validated, resolved, added to the graph and folded into a live finding.

State is tables under one folder, one version per batch, so a batch that is run again after a failure writes the same
version again and a restart goes on where the last batch ended. A batch reads the state before it, never its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import graph, resolution, temporal
from tracewright.operators.validate import ACCEPTED, reason_code
from tracewright.streaming.runtime import drain

# Weights of the domains in a live finding; they are not brought to a sum of one.
WEIGHTS = {"CDR": 0.25, "IPDR": 0.25, "BANK": 0.30, "SOCIAL": 0.20}
FIELDS = ("event_id", "actor_id", "target_id", "t", "event_type", "source_domain", "amount", "actor_name", "device_id", "ip_subnet")


class Pipeline:
    """``run`` drains a stream of events (``FIELDS``, t in microseconds) into the state folder; the other methods read it.

    Rejected rows go to the dead letters with their reason, repeats (of any earlier batch or of this one) are rejected but
    no dead letters. Late events are flagged and kept. New entities join the registry with the batch that brings them, and
    possible matches are named without being merged.
    """

    def __init__(self, spark, folder: str, registry: DataFrame | None = None):
        self.spark, self.folder, self.first = spark, folder.rstrip("/"), registry

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(name, batch))

    def _read(self, name: str, before: int | None = None) -> DataFrame | None:
        """All versions of an appended table, or those of batches before one; None if there is none."""
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None
        return df if before is None else df.where(F.col("batch") < before)

    def process(self, batch: DataFrame, number: int) -> None:
        """One micro-batch."""
        seen = self._read("received", number)
        last = 0 if seen is None else seen.agg(F.coalesce(F.max("arrival"), F.lit(0))).first()[0]
        hashed = batch.select(*FIELDS).withColumn("payload_hash", S.pipe_hash(*[F.col(c) for c in FIELDS]))
        # A micro-batch is of bounded size: numbering it is one ordered pass.
        numbered = hashed.withColumn("arrival", F.row_number().over(Window.orderBy("event_id", "payload_hash")) + F.lit(last))
        first = numbered.groupBy("payload_hash").agg(F.min("arrival").alias("__first"))
        numbered = numbered.join(first, "payload_hash").withColumn("is_repeat", F.col("arrival") > F.col("__first")).drop("__first")
        if seen is not None:
            numbered = numbered.join(seen.select("payload_hash").distinct().withColumn("__old", F.lit(True)), "payload_hash", "left").withColumn("is_repeat", F.col("is_repeat") | F.coalesce("__old", F.lit(False))).drop("__old")
        blank = F.coalesce(F.trim(F.col("actor_id").cast("string")), F.lit("")) == ""
        odd = F.col("amount").isNull() | F.isnan("amount") | (F.col("amount") < 0) | (F.abs("amount") == float("inf"))
        checks = [(~F.coalesce(F.col("source_domain").isin(*WEIGHTS), F.lit(False)), "INVALID_EVENT_TYPE"), (F.col("is_repeat"), "DUPLICATE_SOURCE_ROW"), (blank, "MISSING_REQUIRED_FIELD"), (F.col("t").isNull(), "INVALID_TIMESTAMP"), ((F.col("source_domain") == "BANK") & odd, "INVALID_AMOUNT")]
        self._write(numbered.withColumn("reason", reason_code(checks)), "received", number)
        judged = self.spark.read.parquet(self._path("received", number))
        good = judged.where(F.col("reason") == ACCEPTED)
        registry = self.registry(number)
        found = resolution.resolve_records(good.groupBy("actor_id").agg(*[F.min(c).alias(c) for c in ("actor_name", "device_id", "ip_subnet")]).withColumn("k", F.col("actor_id")), registry, "k")
        self._write(good.join(found.select(F.col("k").alias("actor_id"), "entity", "status"), "actor_id"), "events", number)
        events = self.spark.read.parquet(self._path("events", number))
        known = registry.select(F.col("actor_id"))
        fresh = events.where("status <> 'POSSIBLE'").groupBy("actor_id").agg(F.min("entity").alias("entity_id"), *[F.min(c).alias(c) for c in ("actor_name", "device_id", "ip_subnet")]).join(known, "actor_id", "left_anti")
        self._write(fresh.withColumn("match_confidence", F.lit(1.0)), "registry", number)

    def run(self, stream: DataFrame) -> None:
        """Process what is there and stop; a later call goes on from there."""
        drain(stream, "", f"{self.folder}/checkpoint", "append", self.process)

    # ---- what the state says ----

    def registry(self, before: int | None = None) -> DataFrame:
        """Entities known (before a batch), one row per actor."""
        shape = "actor_id string, actor_name string, device_id string, ip_subnet string, entity_id string, match_confidence double"
        names = [c.split()[0] for c in shape.split(", ")]
        held = self._read("registry", before)
        out = self.spark.createDataFrame([], shape) if self.first is None else self.first.select(*names)
        return out if held is None else out.unionByName(held.select(*names))

    def counts(self) -> DataFrame:
        """One row: received, accepted, rejected, repeats, dead letters."""
        r = F.col("reason")
        return self._read("received").agg(F.count(F.lit(1)).alias("received"), F.count_if(r == ACCEPTED).alias("accepted"), F.count_if(r != ACCEPTED).alias("rejected"), F.count_if(r == "DUPLICATE_SOURCE_ROW").alias("repeats"), F.count_if(~r.isin(ACCEPTED, "DUPLICATE_SOURCE_ROW")).alias("dead_letters"))

    def dead_letters(self) -> DataFrame:
        return self._read("received").where(~F.col("reason").isin(ACCEPTED, "DUPLICATE_SOURCE_ROW")).select("arrival", "event_id", "payload_hash", "reason")

    def events(self) -> DataFrame:
        """Accepted events with entity and ``ordering`` in order of arrival."""
        return temporal.arrival_status(self._read("events"), "entity", "t", ["arrival"])

    def timeline(self, entity: str) -> DataFrame:
        return self.events().where(F.col("entity") == entity).orderBy("t", "event_id")

    def network(self, entity: str, most: int = 2000) -> DataFrame:
        """Edges at an entity's actors, within the bounded graph of the newest events."""
        kept = graph.bounded_state(self._read("events"), most)
        return graph.edges_of(kept.where(F.col("entity") == entity))

    def live_finding(self, weights: Mapping[str, float] = WEIGHTS, scale: float = 1000.0) -> DataFrame:
        """(entity, score, domains, status): the greatest amount of each domain so far over ``scale`` (1 at most), weighted; from two domains on it may be HIGH (0.5) or else WATCH."""
        top = self._read("events").groupBy("entity", "source_domain").agg(F.least(F.max(F.coalesce("amount", F.lit(0.0))) / scale, F.lit(1.0)).alias("s"))
        w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        f = top.groupBy("entity").agg(F.sum(F.col("s") * w[F.col("source_domain")]).alias("score"), F.count(F.lit(1)).alias("domains"))
        return f.withColumn("status", F.when((F.col("domains") >= 2) & (F.col("score") >= 0.5), "HIGH").otherwise("WATCH"))

    def why(self, entity: str) -> DataFrame:
        """What a live finding rests on: the greatest event of each domain."""
        return self._read("events").where(F.col("entity") == entity).groupBy("source_domain").agg(F.max_by("event_id", F.struct(F.coalesce("amount", F.lit(0.0)), "event_id")).alias("event_id"), F.max("amount").alias("amount"))
