"""Which files to analyse again: a cache of content hashes, and the files that import what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import content_hash


def entries(code_files: DataFrame) -> DataFrame:
    """(path, size_bytes, hash) of files (path, code)."""
    return code_files.select("path", F.octet_length("code").alias("size_bytes"), content_hash(F.col("code")).alias("hash"))


def staleness(now: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, stale): files that the cache lacks or has otherwise; size is compared ahead of the hash."""
    old = cache.select("path", F.col("size_bytes").alias("old_size"), F.col("hash").alias("old_hash"))
    same = F.col("size_bytes").eqNullSafe(F.col("old_size")) & F.col("hash").eqNullSafe(F.col("old_hash"))
    return now.join(old, "path", "left").select("path", (~same).alias("stale"))


def hit_rate(checked: DataFrame) -> DataFrame:
    """(files, stale, hit_rate); the rate of no files is 0."""
    counts = checked.agg(F.count(F.lit(1)).alias("files"), F.count_if("stale").alias("stale"))
    return counts.withColumn("hit_rate", F.round(F.when(F.col("files") > 0, (F.col("files") - F.col("stale")) / F.col("files")).otherwise(0.0), 6))


def dependents(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(module, file_id): files that import a changed module, one hop."""
    return imports.join(changed.select("module").distinct(), "module").select("module", "file_id").distinct()


def plan(now: DataFrame, cache: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, action): `rebuild` for stale files and files that import what a stale file exports, else `reuse`.

    `imports` has (path, module), `exports` (module, path).
    """
    checked = staleness(now, cache)
    stale = checked.where("stale").select("path")
    modules = exports.join(stale, "path").select("module").distinct()
    touched = imports.join(modules, "module").select("path").distinct()
    again = stale.union(touched).distinct().withColumn("again", F.lit(True))
    return checked.select("path").join(again, "path", "left").select("path", F.when(F.col("again"), "rebuild").otherwise("reuse").alias("action"))


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new entries in place of old ones of the same path; the last of several by `seq`, then hash."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("hash")))
    both = cache.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new.withColumn("seq", F.col("seq").cast("bigint")))
    return both.withColumn("rank", rank).where("rank = 1").drop("rank", "seq")


def invalidated(cache: DataFrame, paths: DataFrame) -> DataFrame:
    """The cache without the given paths."""
    return cache.join(paths.select("path").distinct(), "path", "left_anti")
