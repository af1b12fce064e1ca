"""Scores of files from their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
THRESHOLD = 0.45
CAP = 0.449
FLOWS = ("CWE-89", "CWE-78", "CWE-22", "CWE-79", "CWE-918", "CWE-502")
CONFIDENCE = {"CWE-798": 0.88, "CWE-327": 0.80}

#: Engineered features in SQL, over the keyword counts.
ENGINEERED_SQL = {
    "log_sources": "round(ln(1 + source_words), 6)",
    "log_sinks": "round(ln(1 + sink_words), 6)",
    "sink_ratio": "round(CAST(sink_words AS DOUBLE) / greatest(1, source_words), 6)",
    "clean_ratio": "round(CAST(clean_words AS DOUBLE) / greatest(1, sink_words), 6)",
    "branch_share": "round(CAST(branch_words AS DOUBLE) / greatest(100, branch_words + loop_words + return_words), 6)",
    "exposed": "CASE WHEN source_words > 0 AND sink_words > 0 AND clean_words = 0 THEN 1 ELSE 0 END",
}


def engineered(counts: DataFrame) -> DataFrame:
    """(file_id, engineered features)."""
    return counts.select("file_id", *(F.expr(e).alias(n) for n, e in ENGINEERED_SQL.items()))


def chosen(features: DataFrame, names: list[str]) -> DataFrame:
    """(file_id, the named features in order): a feature that is missing or null is 0."""
    return features.select("file_id", *((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in features.columns else F.lit(0.0)).alias(n) for n in names))


def probability(weights: dict[str, float], bias: float) -> Column:
    """A logistic score over named features."""
    total = F.lit(bias)
    for name, weight in weights.items():
        total = total + F.col(name) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def predicted(features: DataFrame, weights: dict[str, float] | None = None, bias: float = -1.0, threshold: float = THRESHOLD, paths: str = "exposed") -> DataFrame:
    """Features with probability, risk from 0 to 100 and verdict.

    A file without any path from source to sink is held below the threshold.
    """
    weights = weights or {"log_sources": 0.5, "log_sinks": 0.5, "exposed": 0.7}
    raw = probability(weights, bias)
    held = F.when(F.col(paths) > 0, raw).otherwise(F.least(raw, F.lit(min(CAP, threshold - 0.001))))
    scored = features.withColumn("probability", held)
    return scored.withColumn("risk", F.round(F.col("probability") * 100, 1)).withColumn("verdict", F.when(F.col("probability") >= threshold, "VULNERABLE").otherwise("SAFE"))


def confidence(found: DataFrame) -> DataFrame:
    """Findings (cwe, paths) with a confidence by weakness and by whether a path backs them."""
    out = F.when(F.col("cwe").isin(*FLOWS) & (F.col("paths") > 0), 0.92).when(F.col("cwe").isin(*FLOWS), 0.65)
    for cwe, value in CONFIDENCE.items():
        out = out.when(F.col("cwe") == cwe, value)
    return found.withColumn("confidence", out.otherwise(0.70))


def deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, each feature after less before) of keys on both sides."""
    names = [c for c in before.columns if c != key]
    return before.alias("b").join(after.alias("a"), key).select(key, *((F.col(f"a.{n}") - F.col(f"b.{n}")).alias(n) for n in names))


def trained(labelled: DataFrame, names: list[str], rounds: int = 30, depth: int = 5, seed: int = 1):
    """A gradient-boosted tree model of (features, `label` 0 or 1), trained on the cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="keep"), GBTClassifier(featuresCol="vector", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(labelled)
