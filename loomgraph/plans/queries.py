"""The queries of the core operators, each over its whole tables, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from ..operators import features, findings, incremental, log_templates, metrics, predicates, program, reaching, scoring, taint, textscan, typing
from ..session import table
from ..sources import code, folded, frontends, scopes
from . import rules

Query = Callable[[SparkSession, str], DataFrame]


# ---- shared inputs -------------------------------------------------------------------


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return code.files(table(spark, folder, "samples"), table(spark, folder, "owasp_entries"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return code.lines(_files(spark, folder))


_NAMED = "CASE WHEN lower(trim(language)) LIKE 'py%' THEN 'python' WHEN lower(trim(language)) LIKE 'java%' THEN 'java' ELSE lower(trim(language)) END"
_CWE = "CASE WHEN regexp_matches(regexp_replace(upper(cwe), '[\\s_]', '', 'g'), '^(CWE)?-?[0-9]+$') THEN 'CWE-' || CAST(CAST(regexp_extract(cwe, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) END"
_FILES = f"""files AS (
  SELECT code_id AS file_id, coalesce(file_path, 'code/' || code_id || CASE WHEN {_NAMED} = 'java' THEN '.java' ELSE '.py' END) AS path, {_NAMED} AS language, vulnerable, {_CWE} AS cwe, code FROM samples
  UNION ALL SELECT code_id, 'code/' || code_id || CASE WHEN {_NAMED} = 'java' THEN '.java' ELSE '.py' END, {_NAMED}, vulnerable, {_CWE}, code FROM owasp_entries)"""
_LINES = _FILES + """,
lines AS (SELECT file_id, language, generate_subscripts(parts, 1)::INT AS line_no, unnest(parts) AS line FROM (SELECT file_id, language, string_split(code, chr(10)) AS parts FROM files))"""


def _like(text: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, n.replace("'", "''")) for n in needles) + ")"


# ---- lines, imports, calls ----------------------------------------------------------


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, blank lines and comment lines of every file."""
    blank, comment = F.trim("line") == "", F.col("line").rlike(r"^\s*(#|//|\*|/\*)")
    return _lines(spark, folder).groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank_lines"), F.count_if(comment).alias("comment_lines"))


def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    return code.imports(_lines(spark, folder)).groupBy("module").agg(F.countDistinct("file_id").alias("files"))


def import_targets(spark: SparkSession, folder: str) -> DataFrame:
    return code.resolved_imports(_files(spark, folder)).groupBy("module").agg(F.count(F.lit(1)).alias("importers"), F.count("target").alias("resolved"))


def rule_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Calls on lines joined with the rule catalog: hits and files of each rule."""
    hits = rules.matched(code.calls(_lines(spark, folder)), rules.catalog(spark))
    return hits.groupBy("rule_id", "kind").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("file_id").alias("files"))


def _rule_values() -> str:
    return ", ".join("('{}', '{}', '{}', '{}', '{}')".format(r[0], r[1], r[2], r[3], r[4]) for r in rules.catalog_rows())


# ---- text rules --------------------------------------------------------------------------


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.findings(_lines(spark, folder))


def text_findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings.distinct_by_place(_found(spark, folder)).select("file_id", "line_no", "cwe", "rule", "severity")


def findings_by_weakness(spark: SparkSession, folder: str) -> DataFrame:
    return findings.per_weakness(findings.distinct_by_place(_found(spark, folder)))


def severe_findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings.at_least(findings.distinct_by_place(_found(spark, folder)), "HIGH").groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def literal_credentials(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.literal_credentials(code.assignments(_lines(spark, folder))).select("file_id", "line_no", "name", "bits")


def weak_cryptography(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.weak_cryptography(_lines(spark, folder)).select("file_id", "line_no", "cwe")


def response_headers(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.response_headers(_lines(spark, folder)).groupBy("cwe").agg(F.count(F.lit(1)).alias("lines"))


def sink_lines(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.sinks(_lines(spark, folder)).groupBy("file_id", "cwe").agg(F.count(F.lit(1)).alias("sinks"), F.min("line_no").alias("first_line"))


def source_domains(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.sources(_lines(spark, folder)).groupBy("domain").agg(F.count(F.lit(1)).alias("sources"), F.countDistinct("file_id").alias("files"))


def suppressed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines hidden by a marker in their own comment or that of the line before; `before the` stands for a marker that occurs."""
    return textscan.suppressed(_lines(spark, folder), "before the")


def guarded_sinks(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.guarded_sinks(_lines(spark, folder))


def nearest_source(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.nearest_source(_lines(spark, folder))


def last_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Names in returned sums with the newest assignment above."""
    source_lines = _lines(spark, folder)
    name = F.regexp_extract("line", r"(?s)^\s*return .*\(([a-z_][A-Za-z0-9_]*)\)\z", 1)
    uses = source_lines.select("file_id", "line_no", name.alias("name")).where("name != ''")
    return textscan.last_assignment(code.assignments(source_lines), uses)


def return_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.return_contexts(_lines(spark, folder)).groupBy("cwe").agg(F.count(F.lit(1)).alias("returns"))


def unsupported_constructs(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.unsupported(_files(spark, folder))


_SINK_SQL = "CASE " + " ".join(f"WHEN {_like('lower(line)', n)} THEN '{c}'" for c, n in textscan.SINKS) + " END"
_SOURCE_SQL = "CASE " + " ".join(f"WHEN {_like('lower(line)', n)} THEN '{d}'" for d, n in textscan.SOURCES.items()) + " END"
_ASSIGN = r"(?s)^\s*(?:[A-Za-z_][A-Za-z0-9_<>]* +)?([A-Za-z_][A-Za-z0-9_]*) = ([^=].*)\z"
_ASSIGNED = f", assigned AS (SELECT * FROM (SELECT file_id, language, line_no, regexp_extract(line, '{_ASSIGN}', 1) AS name, regexp_extract(line, '{_ASSIGN}', 2) AS value FROM lines) WHERE name <> '')"
_BYTES = "regexp_extract_all(hex(encode(literal)), '..')"
_ENTROPY = "list_sum([-(len([x for x in b if x = k])::DOUBLE / len(b)) * log2(len([x for x in b if x = k])::DOUBLE / len(b)) for k in list_distinct(b)])"
_LITERALS = _ASSIGNED + f""", literals AS (
  SELECT file_id, line_no, name, round({_ENTROPY}, 6) AS bits FROM (
    SELECT *, {_BYTES} AS b FROM (SELECT file_id, line_no, name, regexp_extract(value, '(?s)^["''](.*)["''];?\\z', 1) AS literal FROM assigned WHERE {_like('lower(name)', textscan.CREDENTIAL_NAMES)})
    WHERE strlen(literal) >= 8) WHERE {_ENTROPY} > 3.0)"""
_HASH = "regexp_matches(lower(line), '(?:^|[^a-z0-9])(?:" + "|".join(textscan.WEAK_HASHES) + ")(?:[^a-z0-9]|$)')"
_CIPHER = "regexp_matches(lower(line), '(?:^|[^a-z0-9])(?:" + "|".join(textscan.WEAK_CIPHERS) + ")(?:[^a-z0-9]|$)')"
_CRYPTO = f", crypto AS (SELECT file_id, line_no, unnest(CASE WHEN {_HASH} THEN ['CWE-327', 'CWE-328'] ELSE ['CWE-327'] END) AS cwe FROM lines WHERE regexp_matches(lower(line), '(?:getinstance|new|hashlib\\.[a-z0-9]+|cipher[a-z0-9.]*) *\\(') AND ({_HASH} OR {_CIPHER}))"
_HEADER = ", headers AS (SELECT file_id, line_no, 'CWE-113' AS cwe FROM lines WHERE regexp_matches(lower(line), 'resp[a-z_]*\\.headers\\[[^\\]]*\\] *= *[^\"'' ]'))"
_NEAR = f""", sunk AS (SELECT * FROM (SELECT file_id, line_no, {_SINK_SQL} AS cwe FROM lines) WHERE cwe IS NOT NULL),
near AS (SELECT s.file_id, s.line_no, s.cwe, coalesce(s.line_no - l.last, -1) AS distance FROM sunk s JOIN (
  SELECT file_id, line_no, max(CASE WHEN {_SOURCE_SQL} IS NOT NULL THEN line_no END) OVER (PARTITION BY file_id ORDER BY line_no) AS last FROM lines) l USING (file_id, line_no))"""
_FOUND = f"""WITH {_LINES}{_LITERALS}{_CRYPTO}{_HEADER}{_NEAR},
hidden AS (SELECT file_id, line_no FROM (SELECT file_id, line_no, contains(regexp_extract(line, '(?s)(?://|#)(.*)\\z', 1), 'nosec') AS m, lag(contains(regexp_extract(line, '(?s)(?://|#)(.*)\\z', 1), 'nosec'), 1, false) OVER (PARTITION BY file_id ORDER BY line_no) AS b FROM lines) WHERE m OR b),
every AS (
  SELECT file_id, line_no, 'CWE-798' AS cwe, 'literal-credential' AS rule, 'CRITICAL' AS severity, 4 AS r FROM literals
  UNION ALL SELECT file_id, line_no, cwe, 'weak-cryptography', 'MEDIUM', 2 FROM crypto
  UNION ALL SELECT file_id, line_no, cwe, 'response-header', 'MEDIUM', 2 FROM headers
  UNION ALL SELECT file_id, line_no, cwe, 'near-source', 'HIGH', 3 FROM near WHERE distance BETWEEN 0 AND 20),
found AS (SELECT file_id, line_no, cwe, rule, severity FROM every WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.file_id = every.file_id AND h.line_no = every.line_no)
  QUALIFY row_number() OVER (PARTITION BY file_id, line_no, cwe ORDER BY r DESC, rule) = 1)
"""


# ---- findings: identity, baseline, accuracy ------------------------------------------------


def _sides(spark: SparkSession, folder: str, column: str) -> DataFrame:
    rows = table(spark, folder, "holdout").select(F.col("entry_id").alias("file_id"), code.named_language(F.col("language")).alias("language"), F.col(column).alias("code")).where("code is not null and code != ''")
    source_lines = code.lines(rows)
    found = textscan.sinks(source_lines).withColumn("rule", F.lit("sink"))
    return findings.with_fingerprint(found)


def baseline_status(spark: SparkSession, folder: str) -> DataFrame:
    """Sink findings behind fixes against those ahead of them: new, unchanged and resolved ones."""
    return findings.compared(_sides(spark, folder, "after"), _sides(spark, folder, "before")).groupBy("status").agg(F.count(F.lit(1)).alias("findings"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return findings.distinct_by_fingerprint(_sides(spark, folder, "before"))


def finding_ids(spark: SparkSession, folder: str) -> DataFrame:
    return findings.numbered(findings.distinct_by_place(_found(spark, folder))).select("finding_id", "file_id", "line_no", "cwe")


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    hit = _found(spark, folder).select("file_id").distinct().withColumn("hit", F.lit(True))
    return _files(spark, folder).join(hit, "file_id", "left").select("file_id", "language", F.coalesce("hit", F.lit(False)).alias("predicted"), F.col("vulnerable").alias("actual"))


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_predicted(spark, folder), "language")


def matthews(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.matthews(_predicted(spark, folder), "language")


def matched_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with the label of their file."""
    truth = _files(spark, folder).select("file_id", F.lit(0).alias("line_no"), "vulnerable")
    return metrics.matched_truth(findings.distinct_by_place(_found(spark, folder)), truth).groupBy("cwe", "vulnerable").agg(F.count(F.lit(1)).alias("findings"))


def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories, commits and labels with several different codes, and how many."""
    rows = table(spark, folder, "samples").where("commit != ''")
    groups = rows.groupBy("repo", "commit", "vulnerable").agg(F.countDistinct("code").alias("codes"))
    return groups.where("codes > 1").groupBy("codes").agg(F.count(F.lit(1)).alias("cohorts"))


def sarif_results(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.distinct_by_place(_found(spark, folder)).join(_files(spark, folder).select("file_id", "path"), "file_id")
    return findings.sarif_results(found)


def console_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.distinct_by_place(_found(spark, folder)).join(_files(spark, folder).select("file_id", "path"), "file_id")
    return findings.console(found)


def json_findings(spark: SparkSession, folder: str) -> DataFrame:
    return findings.json_rows(findings.distinct_by_place(_found(spark, folder)))


def directory_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Folders of files by the severest finding in them."""
    worst = findings.distinct_by_place(_found(spark, folder)).groupBy("file_id").agg(F.max(scalar.severity_rank(F.col("severity"))).alias("risk"))
    scored = _files(spark, folder).join(worst, "file_id", "left").select("path", F.coalesce("risk", F.lit(0)).alias("risk"), F.coalesce("vulnerable", F.lit(False)).alias("vulnerable"))
    return findings.directory_summary(scored)


# ---- flows and graphs -----------------------------------------------------------------------


def taint_findings(spark: SparkSession, folder: str) -> DataFrame:
    return taint.findings(_files(spark, folder))


def instruction_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return frontends.instructions(_files(spark, folder)).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("instructions"), F.countDistinct("file_id").alias("files"))


def cfg_edge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return program.cfg_edges(frontends.instructions(_files(spark, folder))).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def icfg_edge_kinds(spark: SparkSession, folder: str) -> DataFrame:
    source = frontends.instructions(_files(spark, folder))
    return program.icfg_edges(source, source.select("file_id", "method").distinct()).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


def call_graph(spark: SparkSession, folder: str) -> DataFrame:
    source = frontends.instructions(_files(spark, folder))
    return program.call_edges(source, source.select("file_id", "method").distinct())


def pointed_sites(spark: SparkSession, folder: str) -> DataFrame:
    return taint.points_to(frontends.instructions(_files(spark, folder))).groupBy("file_id", "method", "name").agg(F.count(F.lit(1)).alias("sites"))


def decided_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions that constants decide, by language and value."""
    return folded.branches(_files(spark, folder)).groupBy("language", "value").agg(F.count(F.lit(1)).alias("branches"))


def symbol_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return scopes.symbols(_files(spark, folder)).groupBy("scope_kind", "kind").agg(F.count(F.lit(1)).alias("symbols"))


def function_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return textscan.mentions(folded.functions(_files(spark, folder)))


def property_algorithms(spark: SparkSession, folder: str) -> DataFrame:
    source_lines = _lines(spark, folder)
    return textscan.property_algorithms(source_lines, code.assignments(source_lines))


def type_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return typing.inheritance(_lines(spark, folder)).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def route_handlers(spark: SparkSession, folder: str) -> DataFrame:
    return typing.routes(_lines(spark, folder))


def reaching_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return reaching.reaching(_files(spark, folder)).groupBy("file_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("definition") < 0).alias("from_outside"))


def finding_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Sink lines with the lines back from them."""
    found = textscan.sinks(_lines(spark, folder)).join(_files(spark, folder).select("file_id", "code"), "file_id")
    return reaching.traced(found)


def flow_allowance(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of sources and weaknesses in one file, whether data of the one may lead to the other, and in how many files."""
    source_lines = _lines(spark, folder)
    read = textscan.sources(source_lines).select("file_id", "domain").distinct()
    sunk = textscan.sinks(source_lines).select("file_id", "cwe").distinct()
    return typing.allowed_flows(read.join(sunk, "file_id")).groupBy("domain", "cwe", "allowed").agg(F.count(F.lit(1)).alias("files"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events as instruction streams: one method a user, in order of time."""
    events = table(spark, folder, "events")
    return events.select(F.col("user_id").alias("method"), "event_id", F.col("event_type").alias("kind"), "ts", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"))


def event_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Basic blocks of event streams: purchases and errors end a block, signups begin one."""
    placed = program.blocks(_stream(spark, folder), ("method",), ("purchase", "error"), ("signup",))
    return placed.groupBy("method").agg(F.max("block").alias("blocks"), F.count(F.lit(1)).alias("instructions"))


def event_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases whose last signup or error before is a signup: taint along a straight line."""
    ahead = Window.partitionBy("method").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.last(F.when(F.col("kind").isin("signup", "error"), F.col("kind")), True).over(ahead)
    return _stream(spark, folder).withColumn("mark", mark).where("kind = 'purchase' and mark = 'signup'").select("method", "event_id", "pos")


def event_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The last two event kinds ahead of each event, as a 2-limited context."""
    by = Window.partitionBy("method").orderBy("pos")
    context = scalar.last_k(F.when(F.lag("kind", 2).over(by).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lag("kind", 2).over(by))), F.lag("kind", 1).over(by), 2)
    return _stream(spark, folder).withColumn("context", F.array_join(context, ">")).where("pos > 1").groupBy("context").agg(F.count(F.lit(1)).alias("events"))


def place_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Regions and nations as a hierarchy, each customer's nation and region above it."""
    nation = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    customer = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return program.ancestors(nation.unionByName(customer)).groupBy("ancestor", "depth").agg(F.count(F.lit(1)).alias("below"))


def call_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Calls by language: of HTTP clients, writing to web responses, and deserializing unsafely."""
    callee = F.col("callee")
    kinds = F.array(*(F.when(test, F.lit(name)) for name, test in (("http client", predicates.http_client(callee)), ("web writer", predicates.web_writer(callee)), ("unsafe deserializer", predicates.unsafe_deserializer(callee)))))
    return code.calls(_lines(spark, folder)).select("language", "file_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("file_id").alias("files"))


def guard_weaknesses(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions of `if` lines by the weaknesses they guard against."""
    condition = F.regexp_extract("line", r"^\s*(?:\}?\s*else\s+)?(?:if|elif)\b\s*(.*)", 1)
    rows = _lines(spark, folder).select(condition.alias("condition")).where("condition != ''")
    return rows.select(F.explode(predicates.guarded_weaknesses(F.col("condition"))).alias("cwe")).groupBy("cwe").agg(F.count(F.lit(1)).alias("guards"))


def test_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files by whether their path is that of a test."""
    return _files(spark, folder).groupBy(predicates.test_file(F.col("path")).alias("test")).agg(F.count(F.lit(1)).alias("files"))


def regression_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose line findings contradict their label."""
    return findings.regression_cases(_files(spark, folder), _found(spark, folder)).select("file_id", "outcome")


def import_stubs(spark: SparkSession, folder: str) -> DataFrame:
    return code.import_stubs(_files(spark, folder))


def commit_components(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of repositories and commits as the files' rows spell them, by size."""
    rows = table(spark, folder, "samples").where("repo != '' and commit != ''")
    edges = rows.select(F.concat(F.lit("r"), "repo").alias("src"), F.concat(F.lit("c"), "commit").alias("dst")).distinct()
    return program.connected_components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("nodes")).groupBy("nodes").agg(F.count(F.lit(1)).alias("components"))


def brand_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Parts resolved by tiers: by the smallest size of their brand and type, else of their brand."""
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    exact = part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("target")).where("target <= 5")
    brand = part.groupBy("p_brand").agg(F.min("p_size").alias("target"))
    hits = part.join(exact, ["p_brand", "p_type"]).select("p_partkey", "target", F.lit(1).alias("tier")).unionByName(part.join(brand, "p_brand").select("p_partkey", "target", F.lit(2).alias("tier")))
    return program.tiered(hits, ["p_partkey"])


def bound_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of part names bound by position to three parameters; the first of too many words are skipped."""
    part = table(spark, folder, "part")
    sites = part.select(F.col("p_partkey").alias("site"), F.lit("f").alias("target"), F.split("p_name", " ").alias("args"))
    params = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c")], "target string, pos int, name string")
    return program.bound_arguments(sites, params).groupBy("name", "value").agg(F.count(F.lit(1)).alias("times"))


def shared_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Points-to sets: parts of suppliers; pairs of neighbouring suppliers with the sizes of both sets, of what they share and of what the first has alone."""
    held = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    sizes = held.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    a, b = held.select(F.col("l_suppkey").alias("a"), "l_partkey"), held.select((F.col("l_suppkey") - 1).alias("a"), "l_partkey")
    both = a.join(b, ["a", "l_partkey"]).groupBy("a").agg(F.count(F.lit(1)).alias("shared"))
    first = sizes.withColumnRenamed("l_suppkey", "a").withColumnRenamed("n", "na")
    second = sizes.select((F.col("l_suppkey") - 1).alias("a"), F.col("n").alias("nb"))
    joined = first.join(second, "a").join(both, "a", "left")
    return joined.select("a", "na", "nb", F.coalesce("shared", F.lit(0)).alias("shared"), (F.col("na") - F.coalesce("shared", F.lit(0))).alias("alone"))


# ---- features, scoring, increments ------------------------------------------------------------


def keyword_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.keyword_features(_files(spark, folder))


def structure_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.extracted(_files(spark, folder))


def text_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the vector that the text alone gives."""
    return _files(spark, folder).select("file_id", *(e.alias(k) for k, e in features.text_vector(F.col("code")).items()))


def feature_vector(spark: SparkSession, folder: str) -> DataFrame:
    """The whole vector of 55 features."""
    return features.vector(_files(spark, folder))


def engineered_features(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.engineered(features.keyword_features(_files(spark, folder)))


def delta_features(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword features behind a fix less those ahead of it."""
    rows = table(spark, folder, "holdout").where("before is not null and after is not null")
    side = lambda c: features.keyword_features(rows.select(F.col("entry_id").alias("file_id"), F.col(c).alias("code")))
    return scoring.deltas(side("before"), side("after"), "file_id")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.predicted(scoring.engineered(features.keyword_features(_files(spark, folder)))).groupBy("verdict").agg(F.count(F.lit(1)).alias("files"))


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = _files(spark, folder).select(F.explode(scalar.word_tokens(F.col("code"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("times"))


def stale_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files behind a fix against a cache of those ahead of it: how many are stale, and the cache's hit rate."""
    rows = table(spark, folder, "holdout")
    cache = incremental.entries(rows.where("before is not null").select(F.col("entry_id").cast("string").alias("path"), F.col("before").alias("code")))
    now = incremental.entries(rows.where("after is not null").select(F.col("entry_id").cast("string").alias("path"), F.col("after").alias("code")))
    return incremental.hit_rate(incremental.staleness(now, cache))


def dependents(spark: SparkSession, folder: str) -> DataFrame:
    """Files to be done again, by module, where the modules that benchmark files import change, one hop on."""
    imports = code.imports(_lines(spark, folder)).select("file_id", "module").distinct()
    changed = imports.join(table(spark, folder, "owasp_entries").select(F.col("code_id").alias("file_id")), "file_id", "left_semi").select("module").distinct()
    return incremental.dependents(imports, changed).groupBy("module").agg(F.count(F.lit(1)).alias("files"))


def queries() -> dict[str, Query]:
    plain = (
        line_counts, import_counts, import_targets, rule_matches, text_findings, findings_by_weakness, severe_findings, literal_credentials, weak_cryptography, response_headers, sink_lines, source_domains,
        suppressed_lines, guarded_sinks, nearest_source, last_assignment, return_contexts, unsupported_constructs, baseline_status, fingerprints, finding_ids, confusion, matthews, matched_truth, cohorts,
        sarif_results, console_lines, json_findings, directory_summary, taint_findings, instruction_kinds, cfg_edge_kinds, icfg_edge_kinds, call_graph, pointed_sites, decided_branches, symbol_kinds, function_mentions, property_algorithms,
        type_pairs, route_handlers, reaching_definitions, finding_traces, flow_allowance, event_blocks, event_flows, event_contexts,
        call_kinds, guard_weaknesses, test_files, regression_cases, import_stubs, place_ancestors, commit_components, brand_tiers, bound_words, shared_parts, keyword_features, text_vector, feature_vector, structure_features, engineered_features, delta_features, predictions, word_counts, stale_files, dependents,
    )
    return {
        "p2_found": lambda spark, folder: log_templates.entries(table(spark, folder, "run_log")),
        "p2_templates": lambda spark, folder: log_templates.templates(table(spark, folder, "run_log")),
        **{f.__name__: f for f in plain},
    }


_PREDICTED = _FOUND + ", predicted AS (SELECT f.language, f.vulnerable AS actual, EXISTS (SELECT 1 FROM found WHERE found.file_id = f.file_id) AS hit FROM files f), counts AS (SELECT language, count(*) FILTER (hit AND actual) AS tp, count(*) FILTER (hit AND NOT actual) AS fp, count(*) FILTER (NOT hit AND actual) AS fn, count(*) FILTER (NOT hit AND NOT actual) AS tn FROM predicted GROUP BY language)"
_STREAM = "stream AS (SELECT user_id AS method, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"
_EDGE = "printed AS (SELECT entry_id, line_no, cwe, sha256('sink|' || cwe || '|' || trim(line, ' ')) AS fingerprint FROM (SELECT entry_id, line_no, line, {sink} AS cwe FROM (SELECT entry_id, generate_subscripts(parts, 1)::INT AS line_no, unnest(parts) AS line FROM (SELECT entry_id, string_split({column}, chr(10)) AS parts FROM holdout WHERE {column} IS NOT NULL AND {column} <> ''))) WHERE cwe IS NOT NULL)"
_BEFORE = _EDGE.format(sink=_SINK_SQL, column="before")
_AFTER = _EDGE.format(sink=_SINK_SQL, column='"after"').replace("printed AS", "behind AS")


_ROUTES = "'" + typing.ROUTES.replace("'", "''") + "'"
_DECLARED_SQL = f"""declared AS (SELECT regexp_extract(line, '{typing._DECLARED}', 1) AS type, CASE WHEN language = 'java' THEN regexp_extract_all(regexp_replace(line, '<[^<>]*>', '', 'g'), '(?:extends|implements|permits|,)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)
  ELSE regexp_extract_all(regexp_extract(line, 'class\\s+\\w+\\s*\\(([^)]*)\\)', 1), '([A-Za-z_][A-Za-z0-9_.]*)', 1) END AS parents FROM lines
  WHERE regexp_matches(line, '^\\s*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed)\\s+)*(?:class|interface|enum|record)\\s+[A-Za-z_]') AND regexp_extract(line, '{typing._DECLARED}', 1) <> '')"""


_LAST = "regexp_extract(c, '([^.]*)$', 1)"
_PRINT = "(" + " OR ".join(f"{_LAST} = '{x}'" for x in predicates.PRINTS) + ")"
_CALL_KINDS = f"""kinds AS (SELECT language, file_id, c, {_like('c', predicates.HTTP_CLIENTS)} AS http,
  NOT {_like('c', predicates.NOT_WEB)} AND ({_like('c', predicates.WEB_WRITERS)} OR {_PRINT} AND NOT {_like('c', predicates.NOT_WRITERS)} AND (NOT contains(c, '.') OR {_like('c', predicates.WRITER_WORDS)})) AS web,
  NOT (contains({_LAST}, 'safe') AND NOT contains({_LAST}, 'unsafe') OR starts_with(c, 'struct.') OR {_LAST} IN ({', '.join(f"'{x}'" for x in predicates.WRITING)})) AND ({_like('c', predicates.UNSAFE_CALLS)} OR {_LAST} IN ('unsafe_load', 'unpackb')
    OR {_LAST} = 'loads' AND NOT regexp_matches(c, '^(json|ujson|orjson|simplejson)\\.') OR {_LAST} = 'load' AND NOT {_like('c', predicates.CERTIFICATES)} AND NOT regexp_matches(c, '^(json|ujson|orjson|toml|tomli|tomlkit)\\.')) AS unsafe
  FROM (SELECT language, file_id, lower(callee) AS c FROM (SELECT file_id, language, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_.]*)\\(', 1)) AS callee FROM lines) WHERE callee NOT IN ('if','for','while','switch','catch','return','def','class','synchronized')))"""
_GUARD_LIST = "[" + ", ".join(f"CASE WHEN {_like('lower(condition)', words)} THEN '{cwe}' END" for cwe, words in predicates.GUARDED) + "]"


def _times(words) -> str:
    return "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")"


_IMPORTED = "regexp_extract_all(c, '(?m)^[ \\t]*(?:import|from)[ \\t]+[\\w.]*')"
_VECTOR_SQL = f"""v AS (SELECT file_id, {_times(features.KEYWORDS['source_words'])}::DOUBLE AS f0, {_times(features.KEYWORDS['sink_words'])}::DOUBLE AS f1, ({' + '.join(f'{_like("t", k)}::INT' for k in features.SOURCE_KINDS)})::DOUBLE AS f3,
  {_times(features.KEYWORDS['clean_words'])}::DOUBLE AS f5, {_times(features.KEYWORDS['collection_words'])}::DOUBLE AS f8, len(list_filter({_IMPORTED}, lambda m: {_like('m', features.KEYWORDS['sink_words'])}))::DOUBLE AS f26,
  len(list_filter({_IMPORTED}, lambda m: {_like('m', features.KEYWORDS['clean_words'])}))::DOUBLE AS f27, len({_IMPORTED})::DOUBLE AS f30, {', '.join(f'{_like("t", k)}::INT::DOUBLE AS f{42 + i}' for i, k in enumerate(features.CLEANING))},
  {_times(features.KEYWORDS['environment_words'])}::DOUBLE AS env FROM (SELECT file_id, coalesce(code, '') AS c, lower(coalesce(code, '')) AS t FROM files))"""


_IMPORTS = """i AS (SELECT DISTINCT file_id, module FROM (SELECT file_id, CASE WHEN language = 'java' THEN regexp_extract(line, '^import +([A-Za-z_][A-Za-z0-9_.]*(?:\\.\\*)?);', 1) ELSE regexp_extract(line, '^(?:import|from) +([A-Za-z_][A-Za-z0-9_.]*)', 1) END AS module FROM lines) WHERE module <> ''),
            x AS (SELECT file_id, language, path, regexp_extract(code, '(?:^|\\n)package ([A-Za-z0-9_.]+);', 1) AS pack, regexp_extract(code, '\\b(?:class|interface|enum|record) ([A-Za-z0-9_]+)', 1) AS own FROM files),
            known AS (SELECT module, min(file_id) AS target FROM (SELECT file_id, CASE WHEN language = 'java' THEN CASE WHEN pack <> '' AND own <> '' THEN pack || '.' || own ELSE own END ELSE regexp_extract(path, '([^/\\\\]+?)(?:\\.[^./\\\\]*)?$', 1) END AS module FROM x) WHERE module <> '' GROUP BY module)"""


def oracle_sql() -> dict[str, str]:
    keyword = {name: " + ".join(f"(length(t) - length(replace(t, '{n}', ''))) // {len(n)}" for n in words) for name, words in features.KEYWORDS.items()}
    keyword_cte = "kw AS (SELECT file_id, " + ", ".join(f"({e})::INT AS {n}" for n, e in keyword.items()) + " FROM (SELECT file_id, lower(code) AS t FROM {source}))"
    engineered = ", ".join(f"{e} AS {n}" for n, e in scoring.ENGINEERED_SQL.items())
    guard = f"sum(CASE WHEN {_like('lower(line)', textscan.GUARDS)} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING)"
    return {
        "line_counts": f"WITH {_LINES} SELECT file_id, count(*) AS lines, count(*) FILTER (trim(line, ' ') = '') AS blank_lines, count(*) FILTER (regexp_matches(line, '^\\s*(#|//|\\*|/\\*)')) AS comment_lines FROM lines GROUP BY file_id",
        "import_counts": f"WITH {_LINES}, found AS (SELECT file_id, CASE WHEN language = 'java' THEN regexp_extract(line, '^import +([A-Za-z_][A-Za-z0-9_.]*(?:\\.\\*)?);', 1) ELSE regexp_extract(line, '^(?:import|from) +([A-Za-z_][A-Za-z0-9_.]*)', 1) END AS module FROM lines) SELECT module, count(DISTINCT file_id) AS files FROM found WHERE module <> '' GROUP BY module",
        "rule_matches": f"""WITH {_LINES}, calls AS (SELECT DISTINCT * FROM (SELECT file_id, language, line_no, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_.]*)\\(', 1)) AS callee FROM lines) WHERE callee NOT IN ('if','for','while','switch','catch','return','def','class','synchronized')),
            rule(rule_id, kind, matcher, language, name) AS (VALUES {_rule_values()}),
            keys AS (SELECT DISTINCT rule_id, kind, language, key FROM (SELECT *, name AS key FROM rule UNION ALL SELECT *, regexp_extract(name, '([^.]*)$', 1) FROM rule WHERE matcher = 'MethodName'))
            SELECT rule_id, kind, count(*) AS hits, count(DISTINCT file_id) AS files FROM (SELECT DISTINCT c.file_id, c.language, c.line_no, c.callee, k.rule_id, k.kind FROM calls c JOIN keys k ON c.callee = k.key AND k.language IN ('any', c.language)) GROUP BY rule_id, kind""",
        "commit_components": """WITH RECURSIVE e AS (SELECT DISTINCT 'r' || repo AS a, 'c' || "commit" AS b FROM samples WHERE repo <> '' AND "commit" <> ''), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            reach AS (SELECT a AS n, a AS m FROM b UNION SELECT r.n, b.b FROM reach r JOIN b ON r.m = b.a), sizes AS (SELECT component, count(*) AS nodes FROM (SELECT n, min(m) AS component FROM reach GROUP BY n) GROUP BY component)
            SELECT nodes, count(*) AS components FROM sizes GROUP BY nodes""",
        "sarif_results": _FOUND + """SELECT found.cwe AS rule_id, '{"ruleId":"' || found.cwe || '","level":"' || CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END || '","message":{"text":"' || rule || ' ' || found.cwe || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || replace(path, chr(92), '/') || '"},"region":{"startLine":' || line_no || ',"startColumn":1}}}]}' AS result FROM found JOIN files USING (file_id)""",
        "json_findings": _FOUND + """SELECT file_id, '[' || string_agg('{"line_no":' || line_no || ',"cwe":"' || cwe || '","rule":"' || rule || '","severity":"' || severity || '"}', ',' ORDER BY line_no, cwe, rule, severity) || ']' AS json FROM found GROUP BY file_id""",
        "type_pairs": f"WITH {_LINES}, {_DECLARED_SQL} SELECT parent, count(DISTINCT child) AS children FROM (SELECT type AS child, unnest(parents) AS parent FROM declared) GROUP BY parent",
        "route_handlers": f"""WITH {_LINES}, n AS (SELECT file_id, line_no, line, regexp_extract(regexp_extract(line, '(?:def|class)\\s+([A-Za-z_]\\w*)|(?:public|private|protected)[^=;(]*?([A-Za-z_]\\w*)\\s*\\(', 0), '([A-Za-z_]\\w*)\\s*\\(?$', 1) AS handler FROM lines),
            a AS (SELECT *, coalesce(nullif(lead(handler, 1) OVER w, ''), nullif(lead(handler, 2) OVER w, ''), nullif(lead(handler, 3) OVER w, '')) AS ahead FROM n WINDOW w AS (PARTITION BY file_id ORDER BY line_no))
            SELECT file_id, line_no, regexp_extract(line, {_ROUTES}, 1) AS route, ahead AS handler FROM a WHERE regexp_matches(line, {_ROUTES})""",
        "import_stubs": f"""WITH {_LINES}, {_IMPORTS} SELECT i.module, i.module || '.value' AS method, 'value' AS parameter, count(DISTINCT i.file_id) AS importers FROM i JOIN files f ON f.file_id = i.file_id AND f.language = 'python'
            WHERE i.module NOT IN (SELECT module FROM known) AND regexp_extract(i.module, '([^.]*)$', 1) NOT IN (SELECT module FROM known) GROUP BY i.module""",
        "regression_cases": _FOUND + "SELECT file_id, CASE WHEN vulnerable THEN 'missed' ELSE 'false alarm' END AS outcome FROM files WHERE vulnerable <> (file_id IN (SELECT file_id FROM found))",
        "import_targets": f"""WITH {_LINES}, {_IMPORTS}
            SELECT i.module, count(*) AS importers, count(coalesce(w.target, p.target)) AS resolved FROM i LEFT JOIN known w ON w.module = i.module LEFT JOIN known p ON p.module = regexp_extract(i.module, '([^.]*)$', 1) GROUP BY i.module""",
        "call_kinds": f"WITH {_LINES}, {_CALL_KINDS} SELECT language, kind, count(*) AS calls, count(DISTINCT file_id) AS files FROM (SELECT language, file_id, unnest(list_filter([CASE WHEN http THEN 'http client' END, CASE WHEN web THEN 'web writer' END, CASE WHEN unsafe THEN 'unsafe deserializer' END], lambda k: k IS NOT NULL)) AS kind FROM kinds) GROUP BY language, kind",
        "guard_weaknesses": f"WITH {_LINES}, g AS (SELECT regexp_extract(line, '^\\s*(?:\\}}?\\s*else\\s+)?(?:if|elif)\\b\\s*(.*)', 1) AS condition FROM lines), n AS (SELECT list_filter({_GUARD_LIST}, lambda k: k IS NOT NULL) AS named FROM g WHERE condition <> '') SELECT cwe, count(*) AS guards FROM (SELECT unnest(CASE WHEN len(named) > 0 THEN named ELSE ['CWE-22', 'CWE-89'] END) AS cwe FROM n) GROUP BY cwe",
        "test_files": f"WITH {_FILES}, p AS (SELECT replace(lower(path), chr(92), '/') AS p FROM files) SELECT NOT (contains(p, 'benchmark') OR regexp_matches(p, '(^|/)test_cwe_[^/]*$')) AND regexp_matches(p, '/tests?/|/test_|(^|/)test_[^/]*$|_test[.](py|java)$|[.]test[.][^/]*$') AS test, count(*) AS files FROM p GROUP BY 1",
        "text_findings": _FOUND + "SELECT file_id, line_no, cwe, rule, severity FROM found",
        "findings_by_weakness": _FOUND + "SELECT cwe, count(*) AS findings, count(DISTINCT file_id) AS files FROM found GROUP BY cwe",
        "severe_findings": _FOUND + "SELECT severity, count(*) AS findings FROM found WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY severity",
        "literal_credentials": f"WITH {_LINES}{_LITERALS} SELECT file_id, line_no, name, bits FROM literals",
        "weak_cryptography": f"WITH {_LINES}{_CRYPTO} SELECT file_id, line_no, cwe FROM crypto",
        "response_headers": f"WITH {_LINES}{_HEADER} SELECT cwe, count(*) AS lines FROM headers GROUP BY cwe",
        "sink_lines": f"WITH {_LINES}{_NEAR} SELECT file_id, cwe, count(*) AS sinks, min(line_no) AS first_line FROM sunk GROUP BY file_id, cwe",
        "source_domains": f"WITH {_LINES} SELECT domain, count(*) AS sources, count(DISTINCT file_id) AS files FROM (SELECT file_id, {_SOURCE_SQL} AS domain FROM lines) WHERE domain IS NOT NULL GROUP BY domain",
        "flow_allowance": f"WITH {_LINES}, r AS (SELECT DISTINCT file_id, domain FROM (SELECT file_id, {_SOURCE_SQL} AS domain FROM lines) WHERE domain IS NOT NULL), s AS (SELECT DISTINCT file_id, cwe FROM (SELECT file_id, {_SINK_SQL} AS cwe FROM lines) WHERE cwe IS NOT NULL), ok(domain, cwe) AS (VALUES " + ", ".join(f"('{d}', '{c}')" for d, cwes in typing.ALLOWED.items() for c in cwes) + ") SELECT domain, cwe, EXISTS (SELECT 1 FROM ok WHERE ok.domain = r.domain AND ok.cwe = s.cwe) AS allowed, count(*) AS files FROM r JOIN s USING (file_id) GROUP BY ALL",
        "suppressed_lines": f"WITH {_LINES} SELECT file_id, line_no FROM (SELECT file_id, line_no, contains(regexp_extract(line, '(?s)(?://|#)(.*)\\z', 1), 'before the') AS m, lag(contains(regexp_extract(line, '(?s)(?://|#)(.*)\\z', 1), 'before the'), 1, false) OVER (PARTITION BY file_id ORDER BY line_no) AS b FROM lines) WHERE m OR b",
        "guarded_sinks": f"WITH {_LINES}, g AS (SELECT file_id, line_no, line, coalesce({guard}, 0) AS guards FROM lines) SELECT file_id, line_no, guards::BIGINT AS guards FROM g WHERE {_like('lower(line)', dict(textscan.SINKS)['CWE-22'])}",
        "nearest_source": f"WITH {_LINES}{_NEAR} SELECT file_id, line_no, cwe, distance FROM near",
        "last_assignment": f"WITH {_LINES}{_ASSIGNED}, uses AS (SELECT DISTINCT file_id, name, line_no FROM (SELECT file_id, line_no, regexp_extract(line, '(?s)^\\s*return .*\\(([a-z_][A-Za-z0-9_]*)\\)\\z', 1) AS name FROM lines) WHERE name <> '') SELECT u.file_id, u.name, u.line_no, max(a.line_no) AS assigned_at FROM uses u LEFT JOIN assigned a ON a.file_id = u.file_id AND a.name = u.name AND a.line_no < u.line_no GROUP BY u.file_id, u.name, u.line_no",
        "return_contexts": f"WITH {_LINES} SELECT cwe, count(*) AS returns FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{p}') THEN '{c}'" for c, p in textscan.RETURN_CONTEXTS) + " END AS cwe FROM lines WHERE regexp_matches(lower(line), '^\\s*return\\b')) WHERE cwe IS NOT NULL GROUP BY cwe",
        "unsupported_constructs": f"WITH {_FILES} " + " UNION ALL ".join(f"SELECT '{x.strip()}' AS construct, count(*) FILTER (contains(lower(code), '{x}')) AS files FROM files" for x in textscan.UNSUPPORTED),
        "baseline_status": f"WITH {_BEFORE}, {_AFTER}, old AS (SELECT DISTINCT fingerprint FROM printed), new AS (SELECT DISTINCT fingerprint FROM behind) SELECT status, count(*) AS findings FROM (SELECT CASE WHEN o.fingerprint IS NULL THEN 'new' WHEN n.fingerprint IS NULL THEN 'resolved' ELSE 'unchanged' END AS status FROM new n FULL JOIN old o ON n.fingerprint = o.fingerprint) GROUP BY status",
        "fingerprints": f"WITH {_BEFORE} SELECT fingerprint, min(struct_pack(a := entry_id, b := line_no)).a AS file_id, min(struct_pack(a := entry_id, b := line_no)).b AS line_no, min(cwe) AS cwe, 'sink' AS rule, count(*) AS places FROM printed GROUP BY fingerprint",
        "finding_ids": _FOUND + "SELECT printf('F-%04d', row_number() OVER (ORDER BY file_id, line_no, cwe, rule)) AS finding_id, file_id, line_no, cwe FROM found",
        "confusion": _PREDICTED + ", r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS q FROM counts) SELECT language, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 1.0::DOUBLE ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM r",
        "matthews": _PREDICTED + " SELECT language, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0::DOUBLE ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM counts",
        "matched_truth": _FOUND + "SELECT found.cwe, files.vulnerable, count(*) AS findings FROM found JOIN files USING (file_id) GROUP BY found.cwe, files.vulnerable",
        "cohorts": "SELECT codes, count(*) AS cohorts FROM (SELECT repo, \"commit\", vulnerable, count(DISTINCT code) AS codes FROM samples WHERE \"commit\" <> '' GROUP BY ALL) WHERE codes > 1 GROUP BY codes",
        "directory_summary": _FOUND + ", worst AS (SELECT file_id, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS risk FROM found GROUP BY file_id) SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS files, max(coalesce(risk, 0)) AS max_risk, bool_or(coalesce(vulnerable, false)) AS any_vulnerable FROM files LEFT JOIN worst USING (file_id) GROUP BY 1",
        "console_lines": _FOUND + "SELECT file_id, line_no, printf('[%s] %s %s at %s', severity, found.cwe, rule, path || ':' || line_no) AS text FROM found JOIN files USING (file_id)",
        "event_blocks": f"WITH {_STREAM}, l AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w IN ('purchase', 'error') OR kind = 'signup' THEN 1 ELSE 0 END AS leader FROM stream WINDOW w AS (PARTITION BY method ORDER BY pos)) SELECT method, sum(leader)::BIGINT AS blocks, count(*) AS instructions FROM l GROUP BY method",
        "event_flows": f"WITH {_STREAM}, m AS (SELECT *, last_value(CASE WHEN kind IN ('signup', 'error') THEN kind END IGNORE NULLS) OVER (PARTITION BY method ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM stream) SELECT method, event_id, pos FROM m WHERE kind = 'purchase' AND mark = 'signup'",
        "event_contexts": f"WITH {_STREAM}, c AS (SELECT pos, concat_ws('>', lag(kind, 2) OVER w, lag(kind, 1) OVER w) AS context FROM stream WINDOW w AS (PARTITION BY method ORDER BY pos)) SELECT context, count(*) AS events FROM c WHERE pos > 1 GROUP BY context",
        "place_ancestors": "SELECT ancestor, depth, count(*) AS below FROM (SELECT 'r' || n_regionkey AS ancestor, 1 AS depth FROM nation UNION ALL SELECT 'n' || c_nationkey, 1 FROM customer UNION ALL SELECT 'r' || n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL",
        "brand_tiers": "WITH e AS (SELECT p_brand, p_type, min(p_size) AS t FROM part GROUP BY ALL HAVING min(p_size) <= 5), b AS (SELECT p_brand, min(p_size) AS t FROM part GROUP BY ALL) SELECT p_partkey, coalesce(e.t, b.t) AS target, CASE WHEN e.t IS NULL THEN 2 ELSE 1 END AS tier FROM part JOIN b USING (p_brand) LEFT JOIN e USING (p_brand, p_type)",
        "bound_words": "WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), x AS (SELECT p_partkey, len(w) AS n, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS value FROM s) SELECT name, value, count(*) AS times FROM (SELECT ['a', 'b', 'c'][(pos - greatest(n - 3, 0) + 1)::INT] AS name, value FROM x WHERE pos - greatest(n - 3, 0) BETWEEN 0 AND 2) GROUP BY name, value",
        "shared_parts": "WITH h AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM h GROUP BY s), b AS (SELECT x.s, count(*) AS shared FROM h x JOIN h y ON y.s = x.s + 1 AND y.p = x.p GROUP BY x.s) SELECT n.s AS a, n.n AS na, m.n AS nb, coalesce(shared, 0) AS shared, n.n - coalesce(shared, 0) AS alone FROM n JOIN n m ON m.s = n.s + 1 LEFT JOIN b ON b.s = n.s",
        "text_vector": f"WITH {_FILES}, {_VECTOR_SQL} SELECT * EXCLUDE (env), (f0 > 1)::INT::DOUBLE AS f34, round(f1 / greatest(f5, 1), 6) AS f51, round(env / greatest(f0, 1), 6) AS f54 FROM v",
        "keyword_features": f"WITH {_FILES}, {keyword_cte.format(source='files')} SELECT * FROM kw",
        "engineered_features": f"WITH {_FILES}, {keyword_cte.format(source='files')} SELECT file_id, {engineered} FROM kw",
        "delta_features": f"WITH {keyword_cte.format(source='(SELECT entry_id AS file_id, before AS code FROM holdout WHERE before IS NOT NULL AND after IS NOT NULL)')}, k2 AS ({keyword_cte.format(source='(SELECT entry_id AS file_id, after AS code FROM holdout WHERE before IS NOT NULL AND after IS NOT NULL)')[7:-1]}) SELECT kw.file_id, " + ", ".join(f"k2.{n} - kw.{n} AS {n}" for n in keyword) + " FROM kw JOIN k2 USING (file_id)",
        "word_counts": f"WITH {_FILES} SELECT word, count(*) AS times FROM (SELECT unnest(regexp_split_to_array(code, '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM files) WHERE strlen(word) >= 2 GROUP BY word",
        "stale_files": "WITH n AS (SELECT entry_id, before, after FROM holdout WHERE after IS NOT NULL) SELECT count(*) AS files, count(*) FILTER (before IS NULL OR before <> after) AS stale, round(count(*) FILTER (before = after)::DOUBLE / count(*), 6) AS hit_rate FROM n",
        "dependents": f"WITH {_LINES}, i AS (SELECT DISTINCT file_id, module FROM (SELECT file_id, CASE WHEN language = 'java' THEN regexp_extract(line, '^import +([A-Za-z_][A-Za-z0-9_.]*(?:\\.\\*)?);', 1) ELSE regexp_extract(line, '^(?:import|from) +([A-Za-z_][A-Za-z0-9_.]*)', 1) END AS module FROM lines) WHERE module <> '') SELECT module, count(*) AS files FROM i WHERE module IN (SELECT module FROM i JOIN owasp_entries ON file_id = code_id) GROUP BY module",
    }
