"""Findings: identity, duplicates, comparison with a baseline, thresholds and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import fingerprint, location, sarif_level, severity_rank
from ..session import checkpointed

# Fixed values.
ADVICE = {
    "CWE-89": "Use parameterized queries.",
    "CWE-78": "Avoid shells; pass arguments as a list.",
    "CWE-79": "Escape output for its context.",
    "CWE-22": "Resolve paths and check that they stay inside an allowed folder.",
    "CWE-502": "Deserialize data formats only, from trusted sources.",
    "CWE-798": "Keep credentials outside of code.",
    "CWE-327": "Use a current algorithm.",
    "CWE-918": "Check addresses against an allow list.",
}
DEFAULT_ADVICE = "Review the flow of data into this call."


def distinct_by_place(found: DataFrame) -> DataFrame:
    """One finding for each (file_id, line_no, cwe): the most severe, then the first rule by name."""
    rank = F.row_number().over(Window.partitionBy("file_id", "line_no", "cwe").orderBy(F.desc(severity_rank(F.col("severity"))), "rule"))
    return found.withColumn("rank", rank).where("rank = 1").drop("rank")


def with_fingerprint(found: DataFrame) -> DataFrame:
    """Findings with a digest of rule, weakness and the text of the line: the same before and after lines move."""
    return found.withColumn("fingerprint", F.sha2(fingerprint(F.col("rule"), F.col("cwe"), F.trim("line")), 256))


def distinct_by_fingerprint(found: DataFrame) -> DataFrame:
    """The first place of each fingerprint, with the number of its places, in order of file and line."""
    return found.groupBy("fingerprint").agg(F.min(F.struct("file_id", "line_no")).alias("first"), F.first("cwe").alias("cwe"), F.first("rule").alias("rule"), F.count(F.lit(1)).alias("places")).select("fingerprint", "first.file_id", "first.line_no", "cwe", "rule", "places")


def numbered(found: DataFrame) -> DataFrame:
    """Findings with ids F-0001, F-0002, ... in order of file, line, weakness and rule.

    Positions come from each partition's size ahead of it in a range-ordered table,
    not from one window over all rows.  The table is written first, as its ranges are
    sampled and may differ when it is made again.
    """
    ordered = checkpointed(found.repartitionByRange("file_id", "line_no", "cwe", "rule").sortWithinPartitions("file_id", "line_no", "cwe", "rule").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    first = ordered.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ahead = first.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return ordered.join(F.broadcast(ahead), "part").withColumn("finding_id", F.format_string("F-%04d", (F.col("ahead") + F.col("at") - F.col("first") + 1).cast("bigint"))).drop("part", "at", "first", "ahead")


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or a higher one."""
    return found.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))


def compared(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(key, status): `new`, `unchanged` or `resolved` against the baseline's keys."""
    now, old = current.select(key).distinct(), baseline.select(key).distinct()
    both = now.withColumn("now", F.lit(True)).join(old.withColumn("old", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("now") & F.col("old"), "unchanged").when(F.col("now"), "new").otherwise("resolved").alias("status"))


def per_weakness(found: DataFrame) -> DataFrame:
    """(cwe, findings, files)."""
    return found.groupBy("cwe").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("file_id").alias("files"))


def advice(found: DataFrame) -> DataFrame:
    """Findings with what to do about their weakness."""
    text = F.lit(DEFAULT_ADVICE)
    for cwe, say in ADVICE.items():
        text = F.when(F.col("cwe") == cwe, say).otherwise(text)
    return found.withColumn("advice", text)


def console(found: DataFrame) -> DataFrame:
    """(file_id, line_no, text): one line of text a finding."""
    place = location(F.col("path"), F.col("line_no"))
    return found.select("file_id", "line_no", F.format_string("[%s] %s %s at %s", F.upper("severity"), "cwe", "rule", place).alias("text"))


def json_rows(found: DataFrame) -> DataFrame:
    """(file_id, json): the findings of each file as one JSON array, in order of line."""
    one = F.struct("line_no", "cwe", "rule", "severity")
    return found.groupBy("file_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("json"))


def sarif_results(found: DataFrame) -> DataFrame:
    """(rule_id, result): each finding as a SARIF 2.1.0 result; a missing line becomes 1."""
    region = F.struct(F.coalesce("line_no", F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.regexp_replace("path", r"\\", "/").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("cwe").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.concat_ws(" ", "rule", "cwe").alias("text")).alias("message"), F.array(place).alias("locations"))
    return found.select(F.col("cwe").alias("rule_id"), F.to_json(result).alias("result"))


def write_sarif(found: DataFrame, path: str, tool: str = "loomgraph") -> None:
    """Writes results as JSON lines, one part a task, with the run's header and rules beside them; results are never gathered."""
    spark = found.sparkSession
    sarif_results(found).select("result").write.mode("overwrite").text(f"{path}/results")
    rules = [r["cwe"] for r in found.select("cwe").distinct().orderBy("cwe").collect()]
    header = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}}]}
    import json

    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")


def regression_cases(code_files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with `outcome` whose findings contradict their label: `missed` or `false alarm`; files without a label are none.

    A set of cases to keep is this table written anywhere.
    """
    hit = found.select("file_id").distinct().withColumn("hit", F.lit(True))
    judged = code_files.where("vulnerable is not null").join(hit, "file_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return judged.where(F.col("hit") != F.col("vulnerable")).withColumn("outcome", F.when(F.col("vulnerable"), "missed").otherwise("false alarm")).drop("hit")


def html_report(found: DataFrame, most: int = 1000) -> str:
    """A page of the `most` severest findings, a top-k report."""
    from html import escape

    rows = found.orderBy(F.desc(severity_rank(F.col("severity"))), "path", "line_no").limit(most).collect()
    body = "".join(f"<tr><td>{escape(str(r['severity']))}</td><td>{escape(str(r['cwe']))}</td><td>{escape(str(r['path']))}:{r['line_no']}</td></tr>" for r in rows)
    return f"<!doctype html><title>Findings</title><table><tr><th>Severity<th>Weakness<th>Place</tr>{body}</table>"


def directory_summary(scored: DataFrame) -> DataFrame:
    """(directory, files, max_risk, any_vulnerable) of scored files (path, risk, vulnerable) by the folder they lie in."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return scored.groupBy(folder.alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.max("risk").alias("max_risk"), F.bool_or("vulnerable").alias("any_vulnerable"))
