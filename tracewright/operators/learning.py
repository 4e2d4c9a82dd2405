"""Models from Spark ML: gradient-boosted trees over causal features, calibrated logistic fusion, sequential patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import clip


def sequential_patterns(events: DataFrame, by: str, label: str, order: Sequence[str], min_support: float, max_length: int = 4) -> DataFrame:
    """(pattern, support): frequent subsequences by prefix projection, gaps allowed; support counts sequences."""
    from pyspark.ml.fpm import PrefixSpan

    s = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, label)))[label].alias("x")).select(F.transform("x", lambda v: F.array(v)).alias("sequence"))
    found = PrefixSpan(minSupport=min_support, maxPatternLength=max_length).findFrequentSequentialPatterns(s)
    return found.select(F.array_join(F.flatten("sequence"), " > ").alias("pattern"), F.col("freq").alias("support"))


def train_predictor(rows: DataFrame, features: Sequence[str], label: str, split: Column, seed: int = 42, iterations: int = 20):
    """(model, scored test rows with ``p``) of gradient-boosted trees; ``split`` is true for training rows and lies in time before the rest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = rows.fillna(0.0, list(features)).withColumn(label, F.col(label).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, maxIter=iterations, seed=seed)]).fit(ready.where(split))
    scored = model.transform(ready.where(~split)).withColumn("p", vector_to_array("probability")[1])
    return model, scored.drop("__x", "rawPrediction", "probability", "prediction")


def logistic_fusion(rows: DataFrame, scores: Sequence[str], label: str):
    """(model, rows with ``p``), or None where there are fewer than ten rows or one class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = rows.fillna(0.0, list(scores)).withColumn(label, F.col(label).cast("double"))
    said = ready.agg(F.count(F.lit(1)), F.countDistinct(label)).first()
    if said[0] < 10 or said[1] < 2:
        return None
    model = Pipeline(stages=[VectorAssembler(inputCols=list(scores), outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), LogisticRegression(featuresCol="__x", labelCol=label, regParam=0.01)]).fit(ready)
    return model, model.transform(ready).withColumn("p", vector_to_array("probability")[1]).drop("__v", "__x", "rawPrediction", "probability", "prediction")


def fallback_trajectory(acceleration: Column) -> Column:
    """struct<p, state> where no model is at hand."""
    p = clip(0.15 + 0.25 * F.least(acceleration, F.lit(3.0)), 0.05, 0.95)
    return F.struct(p.alias("p"), F.when(p >= 0.7, "ELEVATED").when(p >= 0.4, "WATCH").otherwise("NORMAL").alias("state"))


def splits_in_order(rows: DataFrame, t: str, part: str, order: Sequence[str]) -> DataFrame:
    """One row (in_order): every part ends before the next begins."""
    ends = rows.groupBy(part).agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    at = F.array_position(F.array(*[F.lit(p) for p in order]), F.col(part))
    spans = ends.agg(F.array_sort(F.collect_list(F.struct(at.alias("k"), "lo", "hi"))).alias("s"))  # one entry a part
    return spans.select(F.forall(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: (F.size("s") < 2) | (F.element_at("s", i)["hi"] < F.element_at("s", F.least(i + 1, F.size("s")))["lo"])).alias("in_order"))
