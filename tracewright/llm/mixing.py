"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import materialize

#: Documents of one cell of the prefix sum, were all of one source and size.
CELL = 50_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary splits text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def count_tokens(documents: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with the number of tokens of ``text`` in a public byte-level vocabulary; null and empty texts have 0.

    ``vocabulary`` is read by the driver and broadcast (a file of some megabytes), so executors need no such file.
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return documents.withColumn(out, tokens(F.col(text)))


def plan(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", share: str = "target_share", cap: str = "max_repeats", total: float | None = None) -> DataFrame:
    """For every target source its documents, size, the rate at which each document is drawn, and the size to draw.

    ``total`` is the size of the mix; by default the largest at which every source can reach its share with each document
    taken at most ``cap`` times. Beyond that a source is held at its cap. Sources of documents without a target are not
    drawn; targets without documents, or whose documents are all empty, or with a null or no share, get rate 0.
    """
    # Of targets with one source twice the shares add up and the least cap holds.
    wanted = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum(F.coalesce(share, F.lit(0.0))).cast("double").alias("__share"), F.min(F.coalesce(cap, F.lit(1))).cast("double").alias("__cap"))
    held = sizes.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum(size).alias("size"))
    both = wanted.join(held, source, "left").fillna({"documents": 0, "size": 0})
    usable = (F.col("size") > 0) & (F.col("__share") > 0) & (F.col("__cap") > 0)
    if total is None:
        total = both.where(usable).agg(F.min(F.col("size") * F.col("__cap") / F.col("__share"))).first()[0] or 0.0
    rate = F.when(usable, F.least(F.lit(float(total)) * F.col("__share") / F.col("size"), F.col("__cap"))).otherwise(F.lit(0.0))
    return both.select(source, F.col("__share").alias("target_share"), F.col("__cap").cast("int").alias("max_repeats"), "documents", "size", rate.alias("rate"))


def draw(sizes: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = 42) -> DataFrame:
    """``sizes`` with ``copies``: how often each document is taken (rows taken at least once).

    Systematic sampling: within a source documents stand in order of size (by classes of 1/32 of a doubling, then by a
    hash), the prefix sum of their expected copies starts at one random offset, and a document is emitted once per
    integer boundary it crosses. A source therefore gives its expected number of copies to within one, spread evenly
    over all sizes, and no document exceeds its rate rounded up.

    The prefix sum is taken in two steps: over the counts of (size class, hash bucket) cells, then within cells. A class
    has so many buckets that a cell holds about ``CELL`` documents, so no source or size is ever one task, and the cells'
    counts are all that is summed up by source. Null sources are not drawn; repeated rows are documents of their own.
    """
    buckets = max(16, -(-sizes.count() // CELL))
    seeded = sizes.join(rates.where("rate > 0").select(source, "rate"), source)
    cell = seeded.withColumn("__class", F.floor(F.log2(F.coalesce(F.col(size), F.lit(0)) + F.lit(1)) * 32).cast("int")).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__bucket", F.pmod("__hash", F.lit(buckets)).cast("int"))
    counts = cell.groupBy(source, "__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(source).orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__n").fillna({"__before": 0})
    ranked = cell.withColumn("__r", F.row_number().over(Window.partitionBy(source, "__class", "__bucket").orderBy("__hash", key))).join(before, [source, "__class", "__bucket"])
    place = F.col("__before") + F.col("__r")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col(source)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(offset + F.col("rate") * place) - F.floor(offset + F.col("rate") * (place - 1))
    return ranked.withColumn("copies", copies.cast("int")).where("copies > 0").drop("__class", "__hash", "__bucket", "__r", "__before", "rate")


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, total: float | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The selection (key, source, n_tokens, copies) and the shares reached, one row per target source.

    Tokens are counted once and written, as both passes need them; texts do not travel further.
    """
    counted = materialize(count_tokens(documents.select(key, source, text), text, "n_tokens", vocabulary).select(key, source, "n_tokens"))
    rates = materialize(plan(counted, targets, source))
    chosen = draw(counted, rates, key, source, seed=seed)
    drawn = chosen.groupBy(source).agg(F.count(F.lit(1)).alias("documents_drawn"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_drawn"))
    # One row per target source.
    shares = rates.join(drawn, source, "left").fillna({"documents_drawn": 0, "tokens_drawn": 0})
    whole = Window.partitionBy(F.lit(1))
    return chosen, shares.withColumn("actual_share", F.try_divide(F.col("tokens_drawn").cast("double"), F.sum("tokens_drawn").over(whole).cast("double"))).select(source, "target_share", "max_repeats", "documents", F.col("size").alias("tokens"), "rate", "documents_drawn", "tokens_drawn", "actual_share")
