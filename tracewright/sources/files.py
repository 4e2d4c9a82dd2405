"""Reading activity logs from files, and writing contracts with manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import scalars as S
from tracewright.operators.validate import ACCEPTED, reason_code

#: Tested in this order, so that a name which holds two of them has one domain.
DOMAIN_OF_NAME = (("ipdr", "IPDR"), ("cdr", "CDR"), ("bank", "BANK"), ("social", "SOCIAL"))


def domain_of_file(path: Column) -> Column:
    """The domain a file's name tells, CDR by default."""
    low, out = F.lower(F.element_at(F.split(path, "/"), -1)), None
    for part, domain in DOMAIN_OF_NAME:
        out = F.when(F.contains(low, F.lit(part)), domain) if out is None else out.when(F.contains(low, F.lit(part)), domain)
    return out.otherwise("CDR")


def read_logs(spark: SparkSession, path: str, kind: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """CSV (with header) or JSON (a list, one object, or lines) with ``source_file`` and ``source_domain``.

    All columns are text unless a schema is given, so nothing is inferred from data and malformed numbers stay visible
    to the validation. Missing paths raise when the reader is built.
    """
    if kind == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    elif kind == "json":
        reader = spark.read.option("multiLine", True).option("primitivesAsString", True)
        df = (reader.schema(schema) if schema else reader).json(path)
    else:
        df = spark.read.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file")).withColumn("source_domain", domain_of_file(F.col("source_file")))


def with_row_index(df: DataFrame, file: str = "source_file") -> DataFrame:
    """``df`` with the 0-based place of each row in its file.

    Rows are numbered within the splits of a file, and the splits' sizes are added up before; only those sizes (one row a
    split) are gathered, so a file of any length stays spread.
    """
    tagged = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = tagged.groupBy(file, "__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("least"))
    from pyspark.sql import Window

    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(file).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = tagged.join(starts.select(file, "__p", "start", "least"), [file, "__p"])
    rank = F.row_number().over(Window.partitionBy(file, "__p").orderBy("__i")) - 1
    return inner.withColumn("source_row_index", F.col("start") + rank).drop("__p", "__i", "start", "least")


def read_json_records(payloads: DataFrame, column: str, schema: str, key: str) -> DataFrame:
    """One row per element of ``records`` in a JSON payload: (key, ordinal, fields of ``schema``)."""
    parsed = payloads.select(key, F.from_json(column, f"records array<struct<{schema}>>").alias("r"))
    return parsed.select(key, F.posexplode("r.records").alias("ordinal", "rec")).select(key, "ordinal", "rec.*")


class Adapter:
    """One external log format: what it needs, what is wrong with a row, and how it becomes a canonical event."""

    name = "adapter"
    required: tuple[str, ...] = ()

    def checks(self) -> Sequence[tuple[Column, str]]:
        return ()

    def event(self, columns: Sequence[str]) -> Mapping[str, Column]:
        """Expressions for the canonical columns over a table that has ``columns``."""
        raise NotImplementedError

    def truth(self, columns: Sequence[str]) -> Mapping[str, Column]:
        """Expressions for what is known of the true nature of a row; kept apart from the events."""
        return {}

    def inspect(self, spark: SparkSession, path: str) -> list[tuple[str, str]]:
        """Columns and types of the file."""
        return [(f.name, f.dataType.simpleString()) for f in spark.read.option("header", True).option("inferSchema", True).csv(path).schema]

    def count(self, spark: SparkSession, path: str) -> int:
        """Rows without the header."""
        return spark.read.option("header", True).csv(path).count()

    def rows(self, spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
        """All rows with their place in the file and ``reason``; ``limit`` takes the first in file order. A missing column raises."""
        raw = read_logs(spark, path)
        gone = [c for c in self.required if c not in raw.columns]
        if gone:
            raise ValueError(f"{self.name}: missing columns {gone}")
        raw = with_row_index(raw)
        if limit is not None:
            raw = raw.where(F.col("source_row_index") < limit)
        return raw.withColumn("reason", reason_code(self.checks()) if self.checks() else F.lit(ACCEPTED))

    def load(self, spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(events, rejects)."""
        judged = self.rows(spark, path, limit)
        e = self.event(judged.columns)
        good = judged.where(F.col("reason") == ACCEPTED).select(*[c.alias(n) for n, c in e.items()], F.lit(self.name).alias("dataset"))
        good = good.withColumn("sha256_hash", S.pipe_hash(F.col("event_id"), F.col("epoch"), F.col("actor_id"), F.col("target_id"), F.col("event_type"), F.col("amount"), F.col("duration")))
        return good, judged.where(F.col("reason") != ACCEPTED)

    def truths(self, spark: SparkSession, path: str, labels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """(event_id, ...) what is known of each accepted row, from the row itself or from ``labels`` joined to it."""
        judged = self.rows(spark, path, limit).where(F.col("reason") == ACCEPTED)
        return judged.select(self.event(judged.columns)["event_id"].alias("event_id"), *[c.alias(n) for n, c in self.truth(judged.columns).items()])


def _num(c: str) -> Column:
    return F.col(c).try_cast("double")


def _text(c: str, columns: Sequence[str]) -> Column:
    """A column as text, null where it is blank or not there."""
    return F.nullif(F.trim(F.col(c)), F.lit("")) if c in columns else F.lit(None).cast("string")


class CoinTransfers(Adapter):
    """Wallet-to-wallet transfers. The amount is in dollars where there is one, else in coins."""

    name, required = "coin_transfers", ("txId", "timestamp", "input_wallet", "output_wallet", "amount_btc")

    def checks(self):
        blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        return [(blank("txId"), "MISSING_TX_ID"), (blank("input_wallet") | blank("output_wallet"), "MISSING_WALLET"), (S.epoch_or_zero(F.col("timestamp")) <= 0, "INVALID_TIMESTAMP"), (_num("amount_btc").isNull() | (_num("amount_btc") < 0), "INVALID_AMOUNT")]

    def event(self, columns):
        return {
            "event_id": F.concat(F.lit("EVT_EL_"), F.substring(F.trim("txId"), 1, 16)), "epoch": S.epoch_or_zero(F.col("timestamp")), "actor_id": F.concat(F.lit("WALLET_"), F.trim("input_wallet")), "target_id": F.concat(F.lit("WALLET_"), F.trim("output_wallet")),
            "event_type": F.lit("TRANSACTION"), "source_domain": F.lit("BANK"), "amount": F.coalesce(_text("amount_usd", columns).try_cast("double"), _num("amount_btc")), "duration": F.lit(0.0), "temporal_semantics": F.lit("OBSERVED_TIMESTAMP"),
        }

    def truths(self, spark, path, labels=None, limit=None):
        """``labels`` are (txId, class); class 1 or illicit is a case, and a transfer without a class is unknown and none."""
        judged = self.rows(spark, path, limit).where(F.col("reason") == ACCEPTED).select(F.trim("txId").alias("txId"), self.event(())["event_id"].alias("event_id"))
        said = (labels.select(F.trim(F.col("txId").cast("string")).alias("txId"), F.col("class").cast("string").alias("class_label")) if labels is not None else spark.createDataFrame([], "txId string, class_label string")).dropDuplicates(["txId"])
        known = judged.join(said, "txId", "left")
        return known.select("event_id", F.coalesce("class_label", F.lit("unknown")).alias("class_label"), F.coalesce(F.col("class_label").isin("1", "illicit").cast("int"), F.lit(0)).alias("is_case"))


class NetworkFlows(Adapter):
    """Network flows. Addresses are taken where there are any and never made up; the clock too, else the order stands in for time (1.5 s apart)."""

    name, required = "network_flows", ("id", "dur", "proto", "sbytes", "dbytes")
    start, step = 1421980000.0, 1.5

    def checks(self):
        return [(_num("id").isNull(), "MISSING_ID"), (_num("dur").isNull() | (_num("dur") < 0), "INVALID_DURATION"), (_num("sbytes").isNull() | (_num("sbytes") < 0) | _num("dbytes").isNull() | (_num("dbytes") < 0), "INVALID_BYTES")]

    def event(self, columns):
        rec = F.trim("id")
        stamp = _text("timestamp", columns)
        seen = F.coalesce(F.when(stamp.isNotNull(), S.epoch_or_zero(stamp)), _text("stime", columns).try_cast("double"), _text("epoch_time", columns).try_cast("double"))
        address = lambda c: F.concat(F.lit("IP_"), _text(c, columns))
        return {
            "event_id": F.concat(F.lit("EVT_UNSW_"), rec), "epoch": F.coalesce(seen, F.lit(self.start) + _num("id") * self.step), "actor_id": F.coalesce(address("srcip"), F.concat(F.lit("FLOW_"), rec)), "target_id": address("dstip"),
            "event_type": F.lit("IP_SESSION"), "source_domain": F.lit("IPDR"), "amount": F.lit(0.0), "duration": _num("dur"), "temporal_semantics": F.when(seen.isNotNull(), "OBSERVED_TIMESTAMP").otherwise("SEQUENCE_ORDER_SURROGATE"),
        }

    def truth(self, columns):
        return {"class_label": F.coalesce(_text("attack_cat", columns), F.lit("Normal")), "is_case": F.coalesce(_text("label", columns).try_cast("double").cast("int"), F.lit(0))}


class Interactions(Adapter):
    """Timed interactions of two users; the time is a number of seconds or ISO text."""

    name, required = "interactions", ("src_user_id", "dst_user_id", "timestamp")

    def _epoch(self) -> Column:
        return F.coalesce(_num("timestamp"), S.epoch_or_zero(F.col("timestamp")))

    def checks(self):
        blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        return [(blank("src_user_id") | blank("dst_user_id"), "MISSING_USER"), (self._epoch() <= 0, "INVALID_TIMESTAMP")]

    def event(self, columns):
        rec = F.coalesce(_text("interaction_id", columns), F.format_string("SO_C2Q_%06d", F.col("source_row_index")))
        return {
            "event_id": F.concat(F.lit("EVT_SO_"), rec), "epoch": self._epoch(), "actor_id": F.concat(F.lit("SO_"), F.trim("src_user_id")), "target_id": F.concat(F.lit("SO_"), F.trim("dst_user_id")),
            "event_type": F.lit("SOCIAL"), "source_domain": F.lit("SOCIAL"), "amount": F.lit(0.0), "duration": F.lit(0.0), "temporal_semantics": F.lit("OBSERVED_TIMESTAMP"),
        }

    def truth(self, columns):
        return {"is_case": F.coalesce(_text("is_sockpuppet_ring", columns).try_cast("double").cast("int"), F.lit(0))}


REGISTRY = {a.name: a for a in (CoinTransfers, NetworkFlows, Interactions)}


def ingest(spark: SparkSession, name: str, path: str, out: str, tier: str = "RAW", limit: int | None = None, sha256: str | None = None, labels: DataFrame | None = None) -> dict:
    """Load a registered format, write its events, truths and rejects, and return the manifest.

    Unknown names raise KeyError; a missing or empty file, missing columns and a file whose SHA-256 is not the one
    expected raise ValueError, before anything is written.
    """
    adapter = REGISTRY[name]()
    try:
        found = file_hashes(spark, path).collect()  # one row a file
    except AnalysisException as e:
        raise ValueError(f"{name}: no file at {path}") from e
    if not found or any(not r["length"] for r in found):
        raise ValueError(f"{name}: no data at {path}")
    if sha256 and {r["sha256"] for r in found} != {sha256}:
        raise ValueError(f"{name}: the file is not the one expected")
    good, bad = adapter.load(spark, path, limit)
    adapter.truths(spark, path, labels, limit).write.mode("overwrite").parquet(f"{out}/truths")
    write_contract(good.withColumn("provenance_tier", F.lit(tier)), f"{out}/events", ["event_id", "epoch", "actor_id", "target_id", "event_type", "source_domain", "amount", "duration", "temporal_semantics", "dataset", "sha256_hash", "provenance_tier"])
    bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/rejects")
    reasons = {r["reason"]: r["n"] for r in spark.read.parquet(f"{out}/rejects").collect()}
    accepted = spark.read.parquet(f"{out}/events").count()
    return manifest({"dataset": name, "tier": tier, "accepted": accepted, "rejected": sum(reasons.values()), "received": accepted + sum(reasons.values()), "reasons": reasons})


def write_contract(df: DataFrame, path: str, columns: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Parquet in the contract's column order; a missing column raises. Files are sorted inside, which needs no shuffle."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}")
    out = df.select(*columns)
    (out.sortWithinPartitions(*sort) if sort else out).write.mode("overwrite").parquet(path)


def manifest(facts: Mapping) -> dict:
    """Facts with the SHA-256 of their canonical JSON."""
    text = json.dumps(facts, sort_keys=True, separators=(",", ":"), default=str)
    return {**facts, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def catalogue() -> list[tuple[str, tuple[str, ...]]]:
    """Registered formats with the columns they need."""
    return [(n, a.required) for n, a in sorted(REGISTRY.items())]


def register_graph(events: DataFrame, entities: DataFrame, prefix: str = "graph") -> tuple[str, str]:
    """Name two tables for SQL; the names of the views."""
    names = f"{prefix}_events", f"{prefix}_entities"
    events.createOrReplaceTempView(names[0])
    entities.createOrReplaceTempView(names[1])
    return names


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files, hashed where they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in order of writing, with ``position``."""
    df = spark.read.json(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    return with_row_index(df).withColumnRenamed("source_row_index", "position")


def graph_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): one element a row, for any sink; distinct by id."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[nodes[c] for c in nodes.columns])).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat_ws(":", F.col("src").cast("string"), "rel", F.col("dst").cast("string")).alias("id"), F.to_json(F.struct(*[edges[c] for c in edges.columns])).alias("json"))
    return n.unionByName(e).groupBy("kind", "id").agg(F.min("json").alias("json"))


def canonical_row_hash(df: DataFrame, columns: Sequence[str], source: str, index: str, version: str = "1.0") -> DataFrame:
    """``df`` with ``sha256_hash`` over compact JSON with sorted keys and escaped characters, byte for byte as json.dumps writes it."""
    schema = T.StructType(df.schema.fields + [T.StructField("sha256_hash", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                body = {c: None if row[c] is None or row[c] != row[c] else str(row[c]) for c in columns}
                text = json.dumps({"row": body, "schema_version": version, "source_file": row[source], "source_row_index": int(row[index])}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
                out.append(hashlib.sha256(text.encode()).hexdigest())
            yield pdf.assign(sha256_hash=out)

    return df.mapInPandas(run, schema)
