"""Files analysed as they arrive: a stream of files keeps a cache and findings up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import upserted
from ..operators.taint import findings

SCHEMA = "path string, language string, code string, seq bigint"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files (path, language, code, seq) that land in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def entry_counts(lines: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(start, run_id, lines): lines of a stream (run_id, received_at) by window; lines later than the watermark are dropped."""
    return lines.withWatermark("received_at", late).groupBy(F.window("received_at", window), "run_id").agg(F.count(F.lit(1)).alias("lines")).select(F.col("window.start").alias("start"), "run_id", "lines")


def run(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str):
    """Starts a query that keeps `store`/cache-N and `store`/findings-N, N the batch, with the newest state of every path.

    Each batch reads the state that the batch before wrote, so a batch done twice
    gives the same state.
    """
    from pyspark.errors import AnalysisException

    def state(name: str, batch: int, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{store}/{name}-{batch - 1}")
        except AnalysisException:
            return spark.createDataFrame([], schema)

    def step(batch: DataFrame, number: int) -> None:
        files = batch.withColumn("file_id", F.xxhash64("path"))
        entries = files.select("path", F.octet_length("code").alias("size_bytes"), F.sha2("code", 256).alias("hash"), "seq")
        cache = state("cache", number, "path string, size_bytes int, hash string")
        upserted(cache, entries).write.mode("overwrite").parquet(f"{store}/cache-{number}")
        newest = files.join(files.groupBy("path").agg(F.max("seq").alias("seq")), ["path", "seq"])
        found = findings(newest).join(newest.select("file_id", "path"), "file_id").select("path", "line_no", "rule", "cwe")
        old = state("findings", number, "path string, line_no int, rule string, cwe string").join(newest.select("path"), "path", "left_anti")
        old.unionByName(found).write.mode("overwrite").parquet(f"{store}/findings-{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
