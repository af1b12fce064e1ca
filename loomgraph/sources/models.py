"""External model packs: sources, sinks and sanitizers that users add, and lookup of library methods by tiers.

What an external pack declares clean counts for external sinks alone: findings of
built-in sinks read `sanitized_for`, those of external sinks also
`external_sanitized_for`, and the two are never merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.program import tiered

MAX_BYTES = 1 << 20
MAX_ENTRIES = 500
MAX_TEXT = 512
API = (1, 0)

_ENTRY = "struct<kind:string, class:string, method:string, arg_indices:array<int>, cwes:array<string>, severity:string, languages:array<string>>"
ENTRY_COLUMNS = ("pack_id", "position", "kind", "class", "method", "arg_indices", "cwes", "severity", "languages")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row an entry of the JSON packs of a folder, with the pack's file, size and version."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "length", F.decode("content", "UTF-8").alias("text"))
    parsed = raw.withColumn("pack", F.from_json("text", f"id string, api string, entries array<{_ENTRY}>"))
    return parsed.select("path", "length", F.col("pack.id").alias("pack_id"), F.col("pack.api").alias("api"), F.posexplode_outer("pack.entries").alias("position", "e")).select("path", "length", "pack_id", "api", "position", "e.*")


def problems(entries: DataFrame) -> DataFrame:
    """(path, problem) of packs that break a rule; one problem rejects the whole pack."""
    version = F.split("api", r"\.")
    checks = [
        (~F.coalesce(F.col("pack_id").rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), F.lit(False)), "pack id is missing or malformed"),
        (F.col("length") > MAX_BYTES, "file is too large"),
        (~F.coalesce((version[0].try_cast("int") == API[0]) & (version[1].try_cast("int") <= API[1]), F.lit(False)), "unsupported api"),
        (F.col("kind").isNotNull() & ~F.col("kind").isin("Source", "Sink", "Sanitizer"), "unknown kind"),
        (F.col("kind").isNotNull() & (F.coalesce(F.length("method"), F.lit(0)) == 0), "method is missing"),
        (F.greatest(F.coalesce(F.length("class"), F.lit(0)), F.coalesce(F.length("method"), F.lit(0))) > MAX_TEXT, "text is too long"),
        ((F.col("kind") == "Sink") & (F.coalesce(F.size("cwes"), F.lit(0)) < 1), "sink without weakness"),
    ]
    found = [entries.where(bad).select("path", F.lit(text).alias("problem")) for bad, text in checks]
    sizes = entries.groupBy("path").agg(F.count("kind").alias("n")).where(F.col("n") > MAX_ENTRIES).select("path", F.lit("too many entries").alias("problem"))
    twice = entries.select("pack_id", "path").distinct().groupBy("pack_id").agg(F.max("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit("repeated pack id").alias("problem"))
    out = sizes.union(twice)
    for part in found:
        out = out.union(part)
    return out.distinct()


def accepted(entries: DataFrame) -> DataFrame:
    """Entries of the packs without a problem."""
    return entries.join(problems(entries).select("path").distinct(), "path", "left_anti").where("kind is not null").select("path", *ENTRY_COLUMNS)


def matched(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls (site, callee, language) with the first entry that fits: qualified before unqualified, then by file and position.

    Packs are bounded by their limits and are broadcast by size.
    """
    any_language = F.coalesce(F.size("languages"), F.lit(0)) < 1
    rows = entries.withColumn("qualified", F.when(F.col("class").isNotNull(), F.concat_ws(".", "class", "method")))
    fits = any_language | F.array_contains("languages", "any") | F.expr("array_contains(languages, language)")
    exact = calls.join(rows, calls["callee"] == rows["qualified"]).where(fits).withColumn("tier", F.lit(1))
    bare = calls.join(rows, F.element_at(F.split(calls["callee"], r"\."), -1) == rows["method"]).where(fits & F.col("class").isNull()).withColumn("tier", F.lit(2))
    both = exact.unionByName(bare).withColumn("tier", F.struct("tier", "path", "position"))
    return tiered(both, ["site"]).select("site", "callee", "pack_id", "kind", "cwes", "severity", "arg_indices")


def active_findings(facts: DataFrame) -> DataFrame:
    """Facts at sinks (cwe, external, sanitized_for, external_sanitized_for) that are not clean for their weakness."""
    built_in = F.array_contains(F.coalesce("sanitized_for", F.array().cast("array<string>")), F.col("cwe"))
    own = F.array_contains(F.coalesce("external_sanitized_for", F.array().cast("array<string>")), F.col("cwe"))
    return facts.where(~(built_in | (F.col("external") & own)))


def library_methods(calls: DataFrame, stubs: DataFrame) -> DataFrame:
    """Calls (site, class, method) with the kind of library method they are, by tiers.

    `stubs` has class, method, kind, from (argument positions handed on).  Tiers: the
    class by its full name, by its last name, then any class with a method of the
    name if all such agree on the kind.
    """
    exact = calls.join(stubs, ["class", "method"]).select("site", "kind", "from", F.lit(1).alias("tier"))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    short = stubs.select(last("class").alias("last"), "method", "kind", "from").dropDuplicates(["last", "method"])
    by_name = calls.withColumn("last", last("class")).join(short, ["last", "method"]).select("site", "kind", "from", F.lit(2).alias("tier"))
    agreed = stubs.groupBy("method").agg(F.min("kind").alias("kind"), F.max("kind").alias("top"), F.first("from").alias("from")).where("kind = top")
    generic = calls.join(agreed, "method").select("site", "kind", "from", F.lit(3).alias("tier"))
    return tiered(exact.unionByName(by_name).unionByName(generic), ["site"]).dropDuplicates(["site", "tier"])
