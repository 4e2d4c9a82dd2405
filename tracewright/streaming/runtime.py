"""The online path: Structured Streaming with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.session import ship
from tracewright.operators.validate import ACCEPTED

LATE_MICROS = 600_000_000


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files as they appear; replays keep the files' own times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_per_payload(stream: DataFrame, key: Column, ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Each payload once. With ``ts`` and ``delay`` the memory of payloads is bounded to repeats within the delay."""
    keyed = stream.withColumn("payload_hash", key)
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["payload_hash"]) if ts else keyed.dropDuplicates(["payload_hash"])


def arrival_status_stream(stream: DataFrame, key: str, t: str, event_id: str, idle: str | None = None) -> DataFrame:
    """(key, event_id, t, ordering) by the latest time seen of each key; late events are flagged and kept, and never move it.

    Rows of one batch are taken in order of ``event_id``. State is one number a key.
    """
    ship(stream.sparkSession)
    kk, kt, ke = (stream.schema[c].dataType.simpleString() for c in (key, t, event_id))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(event_id)
        out = []
        for e, x in zip(rows[event_id], rows[t], strict=True):
            if latest is None or x >= latest:
                out.append("IN_ORDER")
                latest = int(x)
            else:
                out.append("OUT_OF_ORDER_ACCEPTED" if latest - x <= LATE_MICROS else "LATE_EVENT_FLAGGED")
        if latest is not None:
            state.update((latest,))
        yield pd.DataFrame({key: [k[0]] * len(out), event_id: rows[event_id].to_list(), t: rows[t].to_list(), "ordering": out})

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kk}, `{event_id}` {ke}, `{t}` {kt}, ordering string", "latest bigint", "append", GroupStateTimeout.NoTimeout)


def running_summary_stream(stream: DataFrame, key: str, value: str, domain: str) -> DataFrame:
    """Per key the number of events, the sum, and the greatest value of each domain so far (update mode)."""
    return stream.groupBy(key, domain).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def adaptive_baseline_stream(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.15) -> DataFrame:
    """(key, order, value, z, state, mean) of the adaptive tracker, one observation after the other; see :class:`AdaptiveTracker`."""
    ship(stream.sparkSession)
    kk, ko = (stream.schema[c].dataType.simpleString() for c in (key, order))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = AdaptiveTracker(alpha, *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values(order)
        said = [tracker.observe(float(v)) for v in rows[value]]
        state.update(tracker.memory())
        yield pd.DataFrame({key: [k[0]] * len(said), order: rows[order].to_list(), value: rows[value].astype(float).to_list(), "z": [s[0] for s in said], "state": [s[1] for s in said], "mean": [s[2] for s in said]})

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kk}, `{order}` {ko}, `{value}` double, z double, state string, mean double", "n bigint, mean double, var double, drifts bigint, odd bigint, adapting boolean", "append", GroupStateTimeout.NoTimeout)


class AdaptiveTracker:
    """A mean and variance that follow slow change and keep shocks out.

    The first five observations set the running mean and variance (variance 1 after the first). From then on a distance
    of more than 3 deviations is left out (EXCLUDED, from the second in a row QUARANTINED), between 1.5 and 3 it is a
    drift and taken in (from the second on ADAPTING), and below it is taken in as usual, which ends an adaptation. Drifts
    count on over usual values unless these end an adaptation; one left out ends the count. The variance is 1e-4 at least.
    """

    def __init__(self, alpha: float = 0.15, n: int = 0, mean: float = 0.0, var: float = 1.0, drifts: int = 0, odd: int = 0, adapting: bool = False):
        self.alpha, self.n, self.mean, self.var, self.drifts, self.odd, self.adapting = alpha, n, mean, var, drifts, odd, adapting

    def memory(self) -> tuple:
        return self.n, self.mean, self.var, self.drifts, self.odd, self.adapting

    def observe(self, x: float) -> tuple[float | None, str, float]:
        if self.n < 5:
            self.n += 1
            before = self.mean
            self.mean += (x - self.mean) / self.n
            self.var = 1.0 if self.n == 1 else max(self.var + ((x - before) * (x - self.mean) - self.var) / self.n, 1e-4)
            return None, "COLD_START", self.mean
        z = abs(x - self.mean) / self.var**0.5
        if z > 3:
            self.odd, self.drifts = self.odd + 1, 0
            return z, "QUARANTINED" if self.odd >= 2 else "EXCLUDED", self.mean
        self.odd = 0
        if z > 1.5:
            self.drifts += 1
            self.adapting = self.adapting or self.drifts >= 2
        elif self.adapting:
            self.drifts, self.adapting = 0, False
        d = x - self.mean
        self.mean += self.alpha * d
        self.var = max((1 - self.alpha) * (self.var + self.alpha * d * d), 1e-4)
        self.n += 1
        return z, "ADAPTING" if self.adapting else "STABLE", self.mean


def adaptive_baseline(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.15) -> DataFrame:
    """The tracker over a table: one fold per key, in bounded groups (a key's windows)."""
    ship(df.sparkSession)
    kk, ko = (df.schema[c].dataType.simpleString() for c in (key, order))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker = AdaptiveTracker(alpha)
        pdf = pdf.sort_values(order)
        said = [tracker.observe(float(v)) for v in pdf[value]]
        return pd.DataFrame({key: pdf[key], order: pdf[order], "z": [s[0] for s in said], "state": [s[1] for s in said], "mean": [s[2] for s in said]})

    return df.select(key, order, value).groupBy(key).applyInPandas(fold, f"`{key}` {kk}, `{order}` {ko}, z double, state string, mean double")


def route(batch: DataFrame, accepted: str, dead: str) -> None:
    """Split a validated micro-batch (``reason``): accepted rows to one table, the others with their payload hash to the dead letters. Repeats are rejected but no dead letters."""
    batch.where(F.col("reason") == ACCEPTED).write.mode("append").parquet(accepted)
    batch.where(~F.col("reason").isin(ACCEPTED, "DUPLICATE_SOURCE_ROW")).write.mode("append").parquet(dead)


def windowed(stream: DataFrame, ts: str, delay: str, width: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts in tumbling or sliding windows of event time; rows later than ``delay`` behind the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over what is there and stop; a later call with the same checkpoint goes on where this one ended."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(sink) if sink else w.format("parquet").option("path", out)).start().awaitTermination()
