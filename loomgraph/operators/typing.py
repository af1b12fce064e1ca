"""Types of Java and Python files as relations: hierarchy, name resolution, routes and accessors, read from lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .program import tiered

_DECLARED = r"\b(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)"
#: Annotations and decorators that make the method behind them an entry point.
ROUTES = r"@(?:\w+\.)?(?:route|get|post|put|delete|patch|GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping|WebServlet|Path)\s*\(\s*[\"']([^\"']*)[\"']"


def declared(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, type, parents): types of both languages with what they extend or implement, in order."""
    name = F.regexp_extract("line", _DECLARED, 1)
    java = F.regexp_extract_all(F.regexp_replace("line", r"<[^<>]*>", ""), F.lit(r"(?:extends|implements|permits|,)\s+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    python = F.regexp_extract_all(F.regexp_extract("line", r"class\s+\w+\s*\(([^)]*)\)", 1), F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    parents = F.when(F.col("language") == "java", java).otherwise(python)
    head = F.col("line").rlike(r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\s+)*(?:class|interface|enum|record)\s+[A-Za-z_]")
    return source_lines.where(head).select("file_id", "line_no", name.alias("type"), parents.alias("parents")).where("type != ''")


def inheritance(source_lines: DataFrame) -> DataFrame:
    """(child, parent) of all declared types, each pair once."""
    return declared(source_lines).select(F.col("type").alias("child"), F.explode("parents").alias("parent")).distinct()


def resolved_types(names: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Type names of files with the full name they mean, by tiers; null where nothing fits.

    `names` has file_id, package, name; `types` full names (fqn); `imports` file_id
    and module, with `.*` for whole packages.  Tiers: a full name, an import of the
    name, a type of the file's package, a type of an imported package.
    """
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    package = F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1)
    known = types.select("fqn", last("fqn").alias("short"), package.alias("in_package")).distinct()
    exact = names.join(known, names["name"] == known["fqn"]).select("file_id", "name", "fqn", F.lit(1).alias("tier"))
    imported = names.join(imports.where("module not like '%*'").select("file_id", "module", last("module").alias("name")), ["file_id", "name"]).select("file_id", "name", F.col("module").alias("fqn"), F.lit(2).alias("tier"))
    own = names.join(known, (names["name"] == known["short"]) & (names["package"] == known["in_package"])).select("file_id", "name", "fqn", F.lit(3).alias("tier"))
    wild = imports.where("module like '%.*'").select("file_id", F.expr("substring(module, 1, length(module) - 2)").alias("in_package"))
    starred = names.join(wild, "file_id").join(known.withColumnRenamed("short", "name"), ["in_package", "name"]).select("file_id", "name", "fqn", F.lit(4).alias("tier"))
    best = tiered(exact.unionByName(imported).unionByName(own).unionByName(starred), ["file_id", "name"]).groupBy("file_id", "name").agg(F.min("fqn").alias("fqn"), F.min("tier").alias("tier"))
    return names.join(best, ["file_id", "name"], "left")


def routes(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, route, handler): routes with the first method or type named on the three lines behind."""
    by = Window.partitionBy("file_id").orderBy("line_no")
    named = F.regexp_extract("line", r"(?:def|class)\s+([A-Za-z_]\w*)|(?:public|private|protected)[^=;(]*?([A-Za-z_]\w*)\s*\(", 0)
    name = F.regexp_extract(named, r"([A-Za-z_]\w*)\s*\(?$", 1)
    ahead = F.coalesce(*(F.nullif(F.lead("handler", i).over(by), F.lit("")) for i in (1, 2, 3)))
    marked = source_lines.select("file_id", "line_no", F.regexp_extract("line", ROUTES, 1).alias("route"), name.alias("handler"), F.col("line").rlike(ROUTES).alias("routed"))
    return marked.withColumn("handler", ahead).where("routed").select("file_id", "line_no", "route", "handler")


def accessors(methods: DataFrame) -> DataFrame:
    """Methods (name, params int, returns_field, sets_field) as getter, setter or neither: by what they do, then by their name."""
    getter = (F.col("params") == 0) & (F.col("returns_field") | F.col("name").rlike("^(?:get|is|has)[A-Z]"))
    setter = (F.col("params") == 1) & (F.col("sets_field") | F.col("name").rlike("^set[A-Z]"))
    return methods.withColumn("accessor", F.when(getter, "getter").when(setter, "setter").otherwise("none"))


# Flows between kinds of sources and weaknesses.

#: The weaknesses that data of a domain may lead to.
ALLOWED = {
    "web": ("CWE-89", "CWE-78", "CWE-22", "CWE-79", "CWE-918", "CWE-502", "CWE-601"),
    "console": ("CWE-89", "CWE-78", "CWE-22", "CWE-502"),
    "environment": ("CWE-78", "CWE-22", "CWE-918"),
    "network": ("CWE-89", "CWE-78", "CWE-22", "CWE-79", "CWE-502", "CWE-918"),
    "deserialized": ("CWE-89", "CWE-78", "CWE-22", "CWE-79"),
}
#: Sanitizers by the words in their names, and what they clean.
CLEANERS = (
    ("html|markup|xss", ("CWE-79",)),
    ("shlex|quote|shell", ("CWE-78",)),
    ("prepare|setstring|escapesql|parameter", ("CWE-89",)),
    ("realpath|normalize|canonical|basename|abspath", ("CWE-22",)),
    ("urlencode|quote_plus|encodefor", ("CWE-79", "CWE-601")),
    ("int\\(|parseint|float\\(|uuid", ("CWE-89", "CWE-78", "CWE-22", "CWE-79")),
)


def allowed_flows(flows: DataFrame) -> DataFrame:
    """Flows (domain, cwe) with `allowed`, by an equi-join with the bounded table of domains; an unknown domain is allowed."""
    spark = flows.sparkSession
    pairs = spark.createDataFrame([(d, c) for d, cwes in ALLOWED.items() for c in cwes], "domain string, cwe string").withColumn("hit", F.lit(True))
    joined = flows.join(F.broadcast(pairs), ["domain", "cwe"], "left")
    return joined.withColumn("allowed", F.coalesce("hit", ~F.col("domain").isin(*ALLOWED), F.lit(True))).drop("hit")


def cleaned_weaknesses(calls: DataFrame) -> DataFrame:
    """Calls with `cleans`: the weaknesses that their name says they clean, in order; names that undo cleaning clean nothing."""
    low = F.lower("callee")
    parts = [F.when(low.rlike(pattern), F.array(*map(F.lit, cwes))).otherwise(F.array().cast("array<string>")) for pattern, cwes in CLEANERS]
    every = F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))
    undo = low.rlike(r"unescape|unquote|decode|loads?$|parse_qs")
    return calls.withColumn("cleans", F.when(undo, F.array().cast("array<string>")).otherwise(every))
