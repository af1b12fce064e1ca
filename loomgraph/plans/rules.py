"""The rule catalog, rule packs and rule matching."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, kind, matcher, language, key, weakness, severity.
CATALOG = """
core-src-001 Source FunctionName any input - Info
core-src-002 Source FunctionName any read - Info
core-sink-001 Sink FunctionName python eval 95 Critical
core-sink-002 Sink FunctionName python exec 94 Critical
core-sink-003 Sink FunctionName python compile 94 Critical
core-san-001 Sanitizer FunctionName python html.escape - Info
core-san-002 Sanitizer QualifiedName python markupsafe.escape - Info
core-san-003 Sanitizer QualifiedName python bleach.clean - Info
core-san-004 Sanitizer QualifiedName python urllib.parse.quote - Info
core-san-005 Sanitizer QualifiedName python urllib.parse.quote_plus - Info
core-san-006 Sanitizer QualifiedName python shlex.quote - Info
core-san-007 Sanitizer FunctionName python os.path.realpath - Info
core-san-008 Sanitizer QualifiedName python os.path.abspath - Info
py-src-001 Source FunctionName python input - Info
py-src-002 Source QualifiedName python os.environ.get - Info
py-src-003 Source QualifiedName python os.getenv - Info
py-src-004 Source QualifiedName python sys.argv - Info
py-src-005 Source QualifiedName python flask.request.args.get - Info
py-src-006 Source QualifiedName python flask.request.form.get - Info
py-src-007 Source QualifiedName python flask.request.get_json - Info
py-src-008 Source QualifiedName python django.request.GET.get - Info
py-src-009 Source QualifiedName python django.request.POST.get - Info
py-src-010 Source QualifiedName python subprocess.check_output - Info
py-src-011 Source QualifiedName python socket.recv - Info
py-src-012 Source QualifiedName python socket.recvfrom - Info
py-src-013 Source QualifiedName python flask.request.args - Info
py-src-014 Source QualifiedName python flask.request.form - Info
py-src-015 Source QualifiedName python flask.request.values - Info
py-src-016 Source QualifiedName python flask.request.json - Info
py-src-017 Source QualifiedName python flask.request.headers - Info
py-src-018 Source QualifiedName python flask.request.cookies - Info
py-src-019 Source QualifiedName python fastapi.Request - Info
py-src-020 Source QualifiedName python starlette.Request - Info
py-src-021 Source QualifiedName python django.request.GET - Info
py-src-022 Source QualifiedName python django.request.POST - Info
py-src-023 Source QualifiedName python os.environ - Info
py-src-024 Source QualifiedName python argparse.ArgumentParser.parse_args - Info
py-src-025 Source QualifiedName python click.option - Info
py-src-026 Source QualifiedName python click.argument - Info
py-san-001 Sanitizer QualifiedName python html.escape - Info
py-san-002 Sanitizer QualifiedName python re.escape - Info
py-san-003 Sanitizer QualifiedName python urllib.parse.urlencode - Info
java-src-001 Source MethodName java HttpServletRequest.getParameter - Info
java-src-002 Source MethodName java HttpServletRequest.getHeader - Info
java-src-003 Source MethodName java HttpServletRequest.getQueryString - Info
java-src-004 Source MethodName java Scanner.nextLine - Info
java-src-005 Source MethodName java Scanner.next - Info
java-src-006 Source MethodName java BufferedReader.readLine - Info
java-src-007 Source MethodName java System.getenv - Info
java-src-008 Source MethodName java Console.readLine - Info
java-src-009 Source MethodName java ServletRequest.getParameter - Info
java-src-010 Source MethodName java ServletRequest.getParameterValues - Info
java-src-011 Source MethodName java HttpServletRequest.getCookies - Info
java-src-012 Source MethodName java HttpServletRequest.getParameterMap - Info
java-src-013 Source MethodName java HttpServletRequest.getInputStream - Info
java-src-014 Source MethodName java HttpServletRequest.getReader - Info
java-src-015 Source FunctionName java RequestParam - Info
java-src-016 Source FunctionName java PathVariable - Info
java-src-017 Source FunctionName java RequestBody - Info
java-src-018 Source MethodName java HttpServletRequest.getHeaders - Info
java-san-001 Sanitizer MethodName java PreparedStatement.setString - Info
java-san-002 Sanitizer MethodName java Path.normalize - Info
java-san-003 Sanitizer MethodName java StringEscapeUtils.escapeHtml4 - Info
java-san-004 Sanitizer MethodName java StringEscapeUtils.escapeSql - Info
java-san-005 Sanitizer MethodName java Encoder.encodeForHTML - Info
java-prop-001 Propagator MethodName java URLDecoder.decode - Info
java-prop-002 Propagator MethodName java URLEncoder.encode - Info
java-prop-003 Propagator MethodName java String.valueOf - Info
java-prop-004 Propagator MethodName java Decoder.decode - Info
java-prop-005 Propagator MethodName java Integer.parseInt - Info
java-prop-006 Propagator MethodName java Enumeration.nextElement - Info
java-prop-008 Propagator MethodName java Connection.prepareStatement - Info
java-prop-009 Propagator MethodName java Connection.prepareCall - Info
java-prop-010 Propagator MethodName java Connection.createStatement - Info
java-prop-011 Propagator MethodName java ProcessBuilder.ProcessBuilder - Info
java-prop-012 Propagator MethodName java ProcessBuilder.command - Info
web-xss-001 Sink FunctionName python render_template_string 79 High
web-xss-002 Sink QualifiedName python django.utils.safestring.mark_safe 79 High
web-xss-003 Sink QualifiedName python jinja2.Markup 79 High
web-xss-004 Sink MethodName java PrintWriter.println 79 High
web-xss-005 Sink MethodName java PrintWriter.print 79 High
web-redir-001 Sink FunctionName python redirect 601 Medium
web-redir-002 Sink MethodName java HttpServletResponse.sendRedirect 601 Medium
web-csrf-001 Sink MethodName java HttpServletRequest.getParameter 352 Medium
db-sqli-001 Sink MethodName python cursor.execute 89 Critical
db-sqli-002 Sink MethodName python db.execute 89 Critical
db-sqli-003 Sink MethodName python connection.execute 89 Critical
db-sqli-004 Sink QualifiedName python sqlalchemy.text 89 High
db-sqli-005 Sink MethodName java Statement.execute 89 Critical
db-sqli-006 Sink MethodName java Statement.executeQuery 89 Critical
db-sqli-007 Sink MethodName java Statement.executeUpdate 89 Critical
db-sqli-008 Sink MethodName java EntityManager.createQuery 89 High
fs-trav-001 Sink FunctionName python open 22 High
fs-trav-002 Sink QualifiedName python os.path.join 22 High
fs-trav-003 Sink QualifiedName python pathlib.Path 22 High
fs-trav-004 Sink QualifiedName python shutil.copy 22 High
fs-trav-005 Sink MethodName java FileInputStream.FileInputStream 22 High
fs-trav-006 Sink MethodName java FileReader.FileReader 22 High
fs-trav-007 Sink MethodName java File.getCanonicalPath 22 Medium
fs-san-001 Sanitizer QualifiedName python os.path.realpath - Info
fs-san-002 Sanitizer MethodName java Path.normalize - Info
fs-san-003 Sanitizer MethodName java Path.toRealPath - Info
deser-001 Sink QualifiedName python pickle.loads 502 Critical
deser-002 Sink QualifiedName python pickle.load 502 Critical
deser-003 Sink QualifiedName python yaml.load 502 Critical
deser-004 Sink QualifiedName python marshal.loads 502 Critical
deser-005 Sink QualifiedName python jsonpickle.decode 502 Critical
deser-006 Sink MethodName java ObjectInputStream.readObject 502 Critical
deser-007 Sink MethodName java XStream.fromXML 502 Critical
crypto-001 Sink QualifiedName python hashlib.md5 327 Medium
crypto-002 Sink QualifiedName python hashlib.sha1 327 Medium
crypto-003 Sink MethodName java MessageDigest.getInstance 327 Medium
crypto-004 Sink MethodName java Cipher.getInstance 327 High
crypto-005 Sink QualifiedName python Crypto.Cipher.DES.new 327 High
crypto-006 Sink QualifiedName python smtplib.SMTP 319 High
crypto-007 Sink QualifiedName python ftplib.FTP 319 High
crypto-008 Sink MethodName java HttpURLConnection.openConnection 319 Medium
auth-001 Sink FunctionName python connect 798 Critical
auth-002 Sink MethodName java DriverManager.getConnection 798 Critical
auth-003 Sink FunctionName python login 259 High
auth-004 Sink MethodName java BCryptPasswordEncoder.encode 259 Medium
sec-001 Sink FunctionName python print 200 Low
sec-002 Sink QualifiedName python logging.info 200 Low
sec-003 Sink QualifiedName python logging.debug 200 Low
sec-004 Sink MethodName java System.out.println 200 Low
sec-005 Sink MethodName java Logger.info 200 Low
ssrf-001 Sink QualifiedName python requests.get 918 High
ssrf-002 Sink QualifiedName python requests.post 918 High
ssrf-003 Sink QualifiedName python requests.request 918 High
ssrf-004 Sink QualifiedName python urllib.request.urlopen 918 High
ssrf-005 Sink QualifiedName python httpx.get 918 High
ssrf-006 Sink MethodName java URL.openConnection 918 High
ssrf-007 Sink MethodName java HttpURLConnection.connect 918 High
cmd-001 Sink QualifiedName python os.system 78 Critical
cmd-002 Sink QualifiedName python os.popen 78 Critical
cmd-003 Sink QualifiedName python subprocess.run 78 Critical
cmd-004 Sink QualifiedName python subprocess.Popen 78 Critical
cmd-005 Sink QualifiedName python subprocess.call 78 Critical
cmd-006 Sink QualifiedName python subprocess.check_call 78 Critical
cmd-007 Sink MethodName java Runtime.exec 78 Critical
cmd-008 Sink MethodName java ProcessBuilder.start 78 Critical
cmd-san-001 Sanitizer QualifiedName python shlex.quote - Info
cmd-san-002 Sanitizer QualifiedName python shlex.split - Info
xxe-001 Sink QualifiedName python xml.etree.ElementTree.parse 611 High
xxe-002 Sink QualifiedName python xml.etree.ElementTree.fromstring 611 High
xxe-003 Sink QualifiedName python lxml.etree.parse 611 High
xxe-004 Sink QualifiedName python xml.dom.minidom.parseString 611 High
xxe-005 Sink MethodName java DocumentBuilder.parse 611 High
xxe-006 Sink MethodName java SAXParser.parse 611 High
xxe-007 Sink MethodName java XMLReader.parse 611 High
"""

SCHEMA = "rule_id string, kind string, matcher string, language string, name string, cwe string, severity string, pack string"
PRESETS = {"python_only": ("python", "any"), "java_only": ("java", "any")}


def catalog_rows() -> list[tuple]:
    rows = []
    for line in CATALOG.strip().splitlines():
        rule_id, kind, matcher, language, name, cwe, severity = line.split()
        rows.append((rule_id, kind, matcher, language, name, None if cwe == "-" else f"CWE-{cwe}", severity, rule_id.split("-")[0]))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """The built-in rules, one row each."""
    return spark.createDataFrame(catalog_rows(), SCHEMA)


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON pack files: an object with `id` and `rules`, a list of objects with the catalog's fields."""
    rule = "array<struct<id:string, kind:string, matcher:string, language:string, name:string, cwe:string, severity:string>>"
    packs = spark.read.schema(f"id string, rules {rule}").json(path, multiLine=True)
    return packs.select("id", F.explode("rules").alias("r")).select(F.col("r.id").alias("rule_id"), "r.kind", "r.matcher", "r.language", "r.name", "r.cwe", "r.severity", F.col("id").alias("pack"))


def to_json(rules: DataFrame) -> DataFrame:
    """(pack, json): one JSON text for each pack, rules in order of id."""
    rule = F.struct(F.col("rule_id").alias("id"), "kind", "matcher", "language", "name", "cwe", "severity")
    return rules.groupBy("pack").agg(F.to_json(F.struct(F.first("pack").alias("id"), F.sort_array(F.collect_list(rule)).alias("rules"))).alias("json"))


def selected(rules: DataFrame, packs: list[str] | None = None, preset: str | None = None) -> DataFrame:
    """Rules of the named packs, unknown names ignored, or of a preset's languages."""
    if packs is not None:
        rules = rules.where(F.col("pack").isin(*packs) if packs else F.lit(False))
    if preset is not None:
        rules = rules.where(F.col("language").isin(*PRESETS[preset]))
    return rules


def keys(rules: DataFrame, suffixes: bool = False) -> DataFrame:
    """One row for each key of a rule: its name, and for methods the bare method name.

    With `suffixes`, a qualified name is also known without its leading packages, so
    that a call through an imported module or object matches.
    """
    parts = F.split("name", "\\.")
    bare = F.element_at(parts, -1)
    forms = F.when(F.col("matcher") == "MethodName", F.array("name", bare)).otherwise(F.array("name"))
    if suffixes:
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        forms = F.when(F.col("matcher") == "QualifiedName", F.array_union(forms, tails)).otherwise(forms)
    return rules.select("*", F.explode(F.array_distinct(forms)).alias("key"))


def matched(calls: DataFrame, rules: DataFrame, suffixes: bool = False) -> DataFrame:
    """`calls` (with `callee` and `language`) joined with every rule that matches, each rule once a call.

    The catalog is of bounded size and is broadcast.
    """
    rule_keys = F.broadcast(keys(rules, suffixes).withColumnRenamed("language", "rule_language").drop("name", "pack", "matcher"))
    on = (calls["callee"] == rule_keys["key"]) & ((rule_keys["rule_language"] == "any") | (rule_keys["rule_language"] == calls["language"]))
    return calls.join(rule_keys, on).drop("key", "rule_language").dropDuplicates()


def problems(rules: DataFrame) -> DataFrame:
    """(rule_id, problem): ids that repeat, kinds, severities or names that aren't allowed."""
    repeated = rules.groupBy("rule_id").count().where("count > 1").select("rule_id", F.lit("repeated id").alias("problem"))
    kind = rules.where(~F.col("kind").isin("Source", "Sink", "Sanitizer", "Propagator") | F.col("kind").isNull()).select("rule_id", F.lit("unknown kind"))
    severity = rules.where(~F.col("severity").isin("Critical", "High", "Medium", "Low", "Info") | F.col("severity").isNull()).select("rule_id", F.lit("unknown severity"))
    name = rules.where(F.col("name").isNull() | ~F.col("name").rlike(r"^[\w.$<>]+$")).select("rule_id", F.lit("name is empty or malformed"))
    return repeated.union(kind).union(severity).union(name)


def packs_json(rows: list[tuple] | None = None) -> str:
    """The catalog as one JSON text, for files and tests."""
    packs: dict[str, list[dict]] = {}
    for rule_id, kind, matcher, language, name, cwe, severity, pack in rows or catalog_rows():
        packs.setdefault(pack, []).append({"id": rule_id, "kind": kind, "matcher": matcher, "language": language, "name": name, "cwe": cwe, "severity": severity})
    return json.dumps([{"id": p, "rules": r} for p, r in packs.items()])
