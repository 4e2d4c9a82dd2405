"""Queries of the language-model problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import normalize as N
from tracewright.llm import leakage, matching, mixing, pii, subsequences


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Ordered lists of three or four event types held by at least 5 % of the entities."""
    log = spark.read.parquet(f"{d}/temporal_sequence.parquet").select("canonical_entity_id", "event_type", "sequence_index")
    found = subsequences.frequent_subsequences(log, F.col("canonical_entity_id"), N.event_type_name(F.col("event_type")), F.col("sequence_index"))
    return found.select(F.array_join("pattern", " > ").alias("pattern"), "support")


_PROFILE = {"key": "canonical_entity_id", "name": "display_name", "phone": "phone_number", "device": "device_id", "subnet": "ip_subnet", "city": "home_city", "year": "birth_year"}
_RAW = _PROFILE | {"key": "raw_id", "name": "actor_name"}


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of descriptions of one party with score and confidence."""
    found = matching.match(spark.read.parquet(f"{d}/entity_profile.parquet"), spark.read.parquet(f"{d}/raw_identity.parquet"), _PROFILE, _RAW)
    return found.select(F.col("l").alias("canonical_entity_id"), F.col("r").alias("raw_id"), "score", "confidence")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of canonical and raw ids that describe the same party."""
    return p6_matches(spark, d).select("canonical_entity_id", "raw_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that quote at least two fifths of an item as one passage."""
    # The exact test of order and edits follows the tiling.
    return _leaks(spark, d).where(F.col("passage_share") >= leakage.SHARE).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, by passage or by reordered tiles, with the documents concerned and the most of their words found in one."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("tile_share").alias("most"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn and how often each is taken."""
    return mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))[0].select("doc_id", "source", "n_tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all drawn tokens that each source reached."""
    return mixing.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))[1]


_MODELS: dict = {}


def _model(spark: SparkSession, d: str):
    """Fitted once for each folder and application."""
    key = spark.sparkContext.applicationId, d
    if key not in _MODELS:
        _MODELS[key] = _fitted(spark, d)
    return _MODELS[key]


def _fitted(spark: SparkSession, d: str):
    return pii.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/name_lexicon.parquet"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct piece of personal information in a document."""
    return pii.detect(spark.read.parquet(f"{d}/documents.parquet"), _model(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    return pii.redact(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), _model(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p6_found, p6_matches, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_redacted)}
