"""Findings from lines of code: literal credentials, weak cryptography, response headers, contexts, guards and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import any_of, entropy
from ..sources.code import assigned_name, assigned_value

# Fixed values.
CREDENTIAL_NAMES = ("password", "secret", "api_key", "token", "private_key", "auth_key")
WEAK_HASHES = ("md2", "md4", "md5", "sha1", "sha-1")
WEAK_CIPHERS = ("des", "desede", "rc2", "rc4", "blowfish", "ecb")
GUARDS = ("startswith", "normalize", "realpath", "abspath", "getcanonicalpath", "commonpath", "is_relative_to", "basename")
SOURCES = {
    "web": ("request.args", "request.form", "request.get_json", "request.values", "getparameter(", "getheader(", "getquerystring(", "getcookies("),
    "console": ("input(", "nextline(", "readline(", "sys.argv"),
    "environment": ("os.environ", "getenv("),
    "network": ("recv(", "recvfrom(", "getinputstream("),
    "deserialized": ("json.loads(", "readobject(", "yaml.safe_load("),
}
#: Sinks by weakness, in the order in which they are tried.
SINKS = (
    ("CWE-89", ("execute(", "executequery(", "executeupdate(", "createquery(")),
    ("CWE-78", ("os.system(", "os.popen(", "subprocess.", ".exec(", "processbuilder(")),
    ("CWE-918", ("requests.", "urlopen(", "openconnection(", "httpx.")),
    ("CWE-502", ("pickle.load", "yaml.load(", "marshal.loads", "readobject(", "fromxml(")),
    ("CWE-22", ("open(", "new file(", "fileinputstream(", "filereader(", "os.path.join(")),
    ("CWE-79", ("println(", ".print(", "render_template_string(", "mark_safe(")),
    ("CWE-601", ("sendredirect(", "redirect(")),
)
SUPPRESSION = "nosec"
UNSUPPORTED = ("async ", "await ", "yield ", "lambda", "synchronized", "instanceof", "switch (", "record ", "sealed ", "goto", "exec ")
RETURN_CONTEXTS = (("CWE-79", "<[a-z]+>"), ("CWE-89", "(?:select|update|delete|insert) "), ("CWE-22", r"(?:new file\(|os\.path\.join\(|\.\./)"))

_IN_CALL = r"(?:getinstance|new|hashlib\.[a-z0-9]+|cipher[a-z0-9.]*) *\("
_HEADER_SET = r"resp[a-z_]*\.headers\[[^\]]*\] *= *[^\"' ]"


def _whole_word(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(words) + r")(?:[^a-z0-9]|$)")


def literal_credentials(assigned: DataFrame) -> DataFrame:
    """Assignments of a literal of at least 8 bytes and more than 3 bits a byte to a credential's name."""
    literal = F.regexp_extract("value", r"(?s)^[\"'](.*)[\"'];?\z", 1)
    found = assigned.where(any_of(F.lower("name"), CREDENTIAL_NAMES)).withColumn("literal", literal).where(F.octet_length("literal") >= 8)
    return found.withColumn("bits", F.round(entropy(F.col("literal")), 6)).where("bits > 3.0").select("file_id", "line_no", F.lit("CWE-798").alias("cwe"), F.lit("literal-credential").alias("rule"), F.lit("CRITICAL").alias("severity"), "name", "bits")


def weak_cryptography(source_lines: DataFrame) -> DataFrame:
    """Weak hashes (two weaknesses each) and ciphers named as whole words in a call on a line."""
    low = F.lower("line")
    in_call = low.rlike(_IN_CALL)
    hashes, ciphers = (_whole_word(low, words) for words in (WEAK_HASHES, WEAK_CIPHERS))
    cwes = F.when(hashes, F.array(F.lit("CWE-327"), F.lit("CWE-328"))).when(ciphers, F.array(F.lit("CWE-327"))).otherwise(F.array().cast("array<string>"))
    return source_lines.where(in_call & (hashes | ciphers)).select("file_id", "line_no", F.explode(cwes).alias("cwe"), F.lit("weak-cryptography").alias("rule"), F.lit("MEDIUM").alias("severity"))


def response_headers(source_lines: DataFrame) -> DataFrame:
    """Lines that set a header of a response to something other than a literal."""
    return source_lines.where(F.lower("line").rlike(_HEADER_SET)).select("file_id", "line_no", F.lit("CWE-113").alias("cwe"), F.lit("response-header").alias("rule"), F.lit("MEDIUM").alias("severity"))


def sink_weakness(line: Column) -> Column:
    """The first weakness whose sinks a line calls, null for none."""
    low, cwe = F.lower(line), F.lit(None).cast("string")
    for name, needles in reversed(SINKS):
        cwe = F.when(any_of(low, needles), name).otherwise(cwe)
    return cwe


def source_domain(line: Column) -> Column:
    """The first domain from which a line reads, null for none."""
    low, domain = F.lower(line), F.lit(None).cast("string")
    for name, needles in reversed(SOURCES.items()):
        domain = F.when(any_of(low, needles), name).otherwise(domain)
    return domain


def sinks(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, cwe, line): lines that call a sink."""
    return source_lines.select("file_id", "line_no", sink_weakness(F.col("line")).alias("cwe"), "line").where("cwe is not null")


def sources(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, domain): lines that read from outside."""
    return source_lines.select("file_id", "line_no", source_domain(F.col("line")).alias("domain")).where("domain is not null")


def suppressed(source_lines: DataFrame, marker: str = SUPPRESSION) -> DataFrame:
    """(file_id, line_no) of lines that, or whose line before, bear a comment with the marker; the second part of a comment on either line."""
    hidden = source_lines.where(_marked(marker)).select("file_id", "n_lines", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"))
    return hidden.where("line_no <= n_lines").select("file_id", "line_no").distinct()


def _marked(marker: str) -> Column:
    """Whether a line's comment has a marker."""
    return F.coalesce(F.regexp_extract("line", r"(?s)(?://|#)(.*)\z", 1).contains(marker), F.lit(False))


def guarded_sinks(source_lines: DataFrame, window: int = 50) -> DataFrame:
    """(file_id, line_no, guards): path sinks with the number of guard lines among the `window` lines ahead, by a range frame over each file."""
    low = F.lower("line")
    guard = any_of(low, GUARDS).cast("int")
    sink = any_of(low, dict(SINKS)["CWE-22"])
    ahead = Window.partitionBy("file_id").orderBy("line_no").rangeBetween(-window, -1)
    return source_lines.withColumn("guards", F.coalesce(F.sum(guard).over(ahead), F.lit(0))).where(sink).select("file_id", "line_no", "guards")


def nearest_source(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, cwe, distance): each sink line and the lines back to the nearest source at or above it; -1 where there is none.

    An as-of join by a running maximum over marked lines, without pairing sources and sinks.
    """
    line = F.col("line")
    marked = source_lines.select("file_id", "line_no", sink_weakness(line).alias("cwe"), F.when(source_domain(line).isNotNull(), F.col("line_no")).alias("read_at")).where("cwe is not null or read_at is not null")
    last = F.max("read_at").over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("last", last).where("cwe is not null").select("file_id", "line_no", "cwe", F.coalesce(F.col("line_no") - F.col("last"), F.lit(-1)).alias("distance"))


def last_assignment(assigned: DataFrame, uses: DataFrame) -> DataFrame:
    """`uses` (file_id, line_no, name) with the line of the newest assignment of the name above; null where there is none.

    An as-of join: both sides are merged by position and the last assignment carried on.
    """
    both = assigned.select("file_id", "name", "line_no", F.col("line_no").alias("set_at"), F.lit(0).alias("use")).unionByName(uses.select("file_id", "name", "line_no", F.lit(None).cast("int").alias("set_at"), F.lit(1).alias("use")).distinct())
    # A use sees assignments on earlier lines only.
    window = Window.partitionBy("file_id", "name").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("assigned_at", F.max("set_at").over(window)).where("use = 1").select("file_id", "name", "line_no", "assigned_at")


def return_contexts(source_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, cwe) of return lines by the context their expression is in."""
    low = F.lower("line")
    cwe = F.lit(None).cast("string")
    for name, pattern in reversed(RETURN_CONTEXTS):
        cwe = F.when(low.rlike(pattern), name).otherwise(cwe)
    return source_lines.where(low.rlike(r"^\s*return\b")).select("file_id", "line_no", cwe.alias("cwe")).where("cwe is not null")


def unsupported(code_files: DataFrame) -> DataFrame:
    """(construct, files): in how many files each construct that isn't analysed occurs."""
    low = F.lower("code")
    sums = [F.count_if(low.contains(x)).alias(x) for x in UNSUPPORTED]
    wide = code_files.agg(*sums)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(x.strip()).alias("construct"), F.col(f"`{x}`").alias("files")) for x in UNSUPPORTED))).alias("r")).select("r.construct", "r.files")


def property_algorithms(source_lines: DataFrame, assigned: DataFrame) -> DataFrame:
    """(file_id, line_no, name, algorithm): algorithms chosen through a name that a property lookup set, with the lookup's literal default.

    A self-join of calls and assignments on file and name.
    """
    call = r"(?:MessageDigest|Cipher|hashlib)\.(?:getInstance|new)\(([A-Za-z_][A-Za-z0-9_]*)"
    chosen = source_lines.select("file_id", "line_no", F.regexp_extract("line", call, 1).alias("name")).where("name != ''")
    looked_up = assigned.where(F.col("value").rlike(r"(?:getProperty|getenv|environ\.get)\(")).select("file_id", "name", F.regexp_extract("value", r"\([^,()]*, *[\"']([^\"']*)[\"']", 1).alias("algorithm"))
    return chosen.join(looked_up, ["file_id", "name"]).select("file_id", "line_no", "name", "algorithm").distinct()


def mentions(functions: DataFrame) -> DataFrame:
    """(file_id, caller, callee): functions (file_id, name, body) whose body calls another of the file with an argument.

    Names in bodies are taken out first and joined by equality, so no function is paired with every other.
    """
    called = functions.select("file_id", F.col("name").alias("caller"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_]\w*)\s*\([^()\s]"), F.lit(1)))).alias("callee"))
    return called.join(functions.select("file_id", F.col("name").alias("callee")).distinct(), ["file_id", "callee"]).where("caller != callee").select("file_id", "caller", "callee")


def findings(source_lines: DataFrame, reach: int = 20) -> DataFrame:
    """All line findings: the text rules, and sinks with a source at most `reach` lines above; suppressed lines are left out.

    One projection marks all rules, patterns only on lines that have a rule's words;
    only marked lines are brought together by file.
    """
    low = F.lower("line")
    name, value = assigned_name(F.col("line")), assigned_value(F.col("line"))
    literal = F.regexp_extract(value, r"(?s)^[\"'](.*)[\"'];?\z", 1)
    one = lambda cwe, rule, severity: F.struct(cwe.alias("cwe"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))
    credential = F.when(any_of(low, CREDENTIAL_NAMES), F.when(any_of(F.lower(name), CREDENTIAL_NAMES) & (F.octet_length(literal) >= 8), F.round(entropy(literal), 6) > 3.0))
    hashes, ciphers = (_whole_word(low, words) for words in (WEAK_HASHES, WEAK_CIPHERS))
    weak = F.when(any_of(low, WEAK_HASHES + WEAK_CIPHERS), (hashes | ciphers) & low.rlike(_IN_CALL))
    header = F.when(low.contains(".headers["), low.rlike(_HEADER_SET))
    marker = F.when(F.col("line").contains(SUPPRESSION), F.when(_marked(SUPPRESSION), F.col("line_no")))
    rules = F.array(
        F.when(credential, one(F.lit("CWE-798"), "literal-credential", "CRITICAL")), F.when(weak, one(F.lit("CWE-327"), "weak-cryptography", "MEDIUM")), F.when(weak & hashes, one(F.lit("CWE-328"), "weak-cryptography", "MEDIUM")), F.when(header, one(F.lit("CWE-113"), "response-header", "MEDIUM"))
    )
    marked = source_lines.select(
        "file_id", "line_no", F.filter(rules, lambda r: r.isNotNull()).alias("rules"), sink_weakness(F.col("line")).alias("sink"), F.when(source_domain(F.col("line")).isNotNull(), F.col("line_no")).alias("read_at"), marker.alias("marked_at")
    ).where("size(rules) > 0 or sink is not null or read_at is not null or marked_at is not null")
    by = Window.partitionBy("file_id").orderBy("line_no")
    last = F.max("read_at").over(by.rowsBetween(Window.unboundedPreceding, 0))
    seen = marked.withColumn("last", last).withColumn("hidden", F.max("marked_at").over(by.rangeBetween(-1, 0))).where("hidden is null")
    flow = F.when(F.col("sink").isNotNull() & (F.col("line_no") - F.col("last")).between(0, reach), one(F.col("sink"), "near-source", "HIGH"))
    every = seen.select("file_id", "line_no", F.explode(F.filter(F.concat("rules", F.array(flow)), lambda r: r.isNotNull())).alias("r"))
    return every.select("file_id", "line_no", "r.cwe", "r.rule", "r.severity")
