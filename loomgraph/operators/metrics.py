"""Accuracy of findings against labels."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, tn of booleans `predicted` and `actual`, with precision, recall and F1.

    Precision and recall are 1 where nothing could be wrong; F1 is 1 where both are 0.
    """
    counts = rows.groupBy(*by).agg(
        *(F.count_if((F.col("predicted") == p) & (F.col("actual") == a)).alias(name) for name, p, a in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False)))
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), _ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    scored = counts.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6))
    return scored.withColumn("f1", F.round(_ratio(2 * precision * recall, precision + recall, 1.0), 6))


def matthews(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy and Matthews correlation, 0 where a margin is empty."""
    counts = confusion(rows, *by)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    bottom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.select(*by, F.round(_ratio(tp + tn, tp + fp + fn + tn, 0.0), 6).alias("accuracy"), F.round(_ratio(tp * tn - fp * fn, bottom, 0.0), 6).alias("mcc"))


def matched_truth(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Findings (file_id, line_no, cwe) with the label of their file whose line is theirs, or of the whole file (line 0); the exact line first.

    Findings without a label keep null and count as false positives.  Of several
    labels of one place, vulnerable counts.
    """
    # Two equi-joins, by line and by file: labels of a file are never all paired with its findings.
    by_line = truth.where("line_no != 0").groupBy("file_id", "line_no").agg(F.max("vulnerable").alias("exact"))
    by_file = truth.where("line_no = 0").groupBy("file_id").agg(F.max("vulnerable").alias("whole"))
    joined = found.select("file_id", "line_no", "cwe").distinct().join(by_line, ["file_id", "line_no"], "left").join(by_file, "file_id", "left")
    return joined.select("file_id", "line_no", "cwe", F.coalesce("exact", "whole").alias("vulnerable"))


class Phases:
    """Seconds that named phases of a session took on the driver; a phase that runs again adds up, one that fails counts, too."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def summary(self, spark: SparkSession) -> DataFrame:
        """(phase, seconds, share) in the order in which phases began."""
        whole = sum(self.seconds.values()) or 1.0
        return spark.createDataFrame([(k, v, v / whole) for k, v in self.seconds.items()], "phase string, seconds double, share double")
