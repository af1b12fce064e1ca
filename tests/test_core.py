import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalar
from loomgraph.operators import features, findings, graph, incremental, metrics, program, scoring, textscan
from loomgraph.plans import queries
from loomgraph.sources import code

FILES = "file_id bigint, language string, code string, path string"


def value(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)) if columns else spark.range(1)
    return frame.select(expression).first()[0]


def test_scalars(spark):
    assert value(spark, scalar.entropy(F.col("a")), a="aabb") == 1.0
    assert value(spark, scalar.entropy(F.col("a")), a="") == 0.0
    assert abs(value(spark, scalar.entropy(F.col("a")), a="é") - 1.0) < 1e-9
    assert value(spark, scalar.word_tokens(F.col("a")), a="ab c é_1, xyz") == ["ab", "é_1", "xyz"]
    assert value(spark, scalar.keyword_count(F.col("a"), ("get", "getx")), a="GETX get aget") == 4
    assert value(spark, scalar.keyword_count(F.col("a"), ("get",)), a=None) == 0
    assert [value(spark, scalar.weakness(F.col("a")), a=x) for x in ("cwe_079", "CWE-89", "22", "n/a", None)] == ["CWE-79", "CWE-89", "CWE-22", None, None]
    assert [value(spark, scalar.severity_rank(F.col("a")), a=x) for x in ("critical", "LOW", "x", None)] == [4, 1, 0, 0]
    assert value(spark, scalar.path_truncate(F.split(F.col("a"), ","), 2), a="x,y,z") == ["x", "y", "*"]
    assert value(spark, scalar.last_k(F.split(F.col("a"), ","), F.lit("z"), 2), a="x,y") == ["y", "z"]
    assert value(spark, scalar.last_k(F.array().cast("array<string>"), F.lit("z"), 3)) == ["z"]
    assert [value(spark, scalar.language_of(F.col("p"), F.col("c")), p=p, c=c) for p, c in (("a.py", ""), ("b.JAVA", ""), ("c", "import java.x;"), ("d", "x = 1"))] == ["python", "java", "java", "python"]


def test_graph_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (900, 900), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {n: find(n) for n in parent}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_hierarchy(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "b"), ("x", "y"), ("y", "x"), (None, "a")], "child string, parent string")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in program.ancestors(parents).collect()}
    assert got[("c", "a")] == 2 and got[("x", "x")] == 2 and ("a", "b") not in got
    methods = spark.createDataFrame([("a", "run"), ("b", "run"), ("a", "stop")], "type string, name string")
    owners = {(r["type"], r["name"]): r["owner"] for r in program.inherited(methods, parents).collect()}
    assert owners[("c", "run")] == "b" and owners[("c", "stop")] == "a" and owners[("a", "run")] == "a"


def test_cfg(spark):
    rows = [(1, "m", i, k, label, []) for i, (k, label) in enumerate([("Label", "s"), ("Branch", "b"), ("Jump", "e"), ("Label", "b"), ("Call", None), ("Jump", "s"), ("Label", "e"), ("Return", None)])]
    source = spark.createDataFrame([(f, m, p, k, None, "g" if k == "Call" else None, a, lab) for f, m, p, k, lab, a in rows], "file_id int, method string, pos int, kind string, dest string, callee string, args array<string>, label string")
    edges = {(r["src"], r["dst"], r["kind"]) for r in program.cfg_edges(source).collect()}
    assert edges == {(1, 3, "BranchTrue"), (1, 2, "BranchFalse"), (2, 4, "Unconditional"), (3, 1, "LoopBack"), (4, -1, "Unconditional")}
    methods = spark.createDataFrame([(1, "m"), (1, "A.g")], "file_id int, method string")
    kinds = {}
    for r in program.icfg_edges(source, methods).collect():
        kinds.setdefault(r["kind"], set()).add((r["src"], r["dst"]))
    assert kinds["Call"] == {("I:m:4", "E:A.g")} and kinds["Return"] == {("X:A.g", "I:m:5")} and kinds["CallToReturn"] == {("I:m:4", "I:m:5")}
    assert ("I:m:7", "X:m") in kinds["Normal"] and ("E:m", "I:m:0") in kinds["Normal"]


def test_merged_programs(spark):
    rows = spark.createDataFrame([("p", 5, None), ("p", 9, 5), ("q", 5, None), ("q", 7, 5)], "program_id string, id int, parent int")
    got = sorted((r["program_id"], r["id"], r["parent"]) for r in program.merged(rows, "id", "parent").collect())
    assert [(p, i) for p, i, _ in got] == [("p", 1), ("p", 2), ("q", 3), ("q", 4)] and [x for _, _, x in got] == [None, 1, None, 3]


@pytest.fixture(scope="module")
def files(spark):
    text = 'import os\nimport json\n# nosec\npassword = "aB3$kLm9"\nx = input()\n\ny = os.path.abspath(x)\nopen(y)\nhashlib.md5(x)\nsecret = "aaaaaaaa"\nos.system(x)\nreturn (x)\n'
    return spark.createDataFrame([(1, "python", text, "a.py"), (2, "java", None, "b.java"), (3, "python", "", None), (4, "java", "package a.b;\nimport os.X;\npublic class C {\n}\n", "C.java")], FILES)


def test_text_rules(spark, files):
    lines = code.lines(files)
    assert lines.where("file_id = 1").count() == 13 and lines.where("file_id = 2").count() == 0 and lines.where("file_id = 3").count() == 1
    assigned = code.assignments(lines)
    assert [(r["line_no"], r["name"]) for r in textscan.literal_credentials(assigned).collect()] == []
    assert {(r["line_no"], r["cwe"]) for r in textscan.weak_cryptography(lines).collect()} == {(9, "CWE-327"), (9, "CWE-328")}
    assert {r["line_no"] for r in textscan.suppressed(lines, "nosec").collect()} == {3, 4}
    assert {(r["line_no"], r["guards"]) for r in textscan.guarded_sinks(lines).collect()} == {(8, 1)}
    assert {(r["line_no"], r["distance"]) for r in textscan.nearest_source(lines).collect()} >= {(8, 3), (11, 6)}
    found = textscan.findings(lines)
    assert 4 not in {r["line_no"] for r in found.collect()}
    assert {(r["module"], r["target"]) for r in code.resolved_imports(files).collect()} == {("os", None), ("json", None), ("os.X", None)}
    uses = spark.createDataFrame([(1, 8, "y"), (1, 7, "y"), (1, 5, "x"), (1, 9, "x")], "file_id bigint, line_no int, name string")
    assert {(r["line_no"], r["name"]): r["assigned_at"] for r in textscan.last_assignment(assigned, uses).collect()} == {(8, "y"): 7, (7, "y"): None, (5, "x"): None, (9, "x"): 5}


def test_findings(spark):
    rows = [(1, 5, "CWE-89", "b", "HIGH", "x", "p\\a.py"), (1, 5, "CWE-89", "a", "HIGH", "x", "p\\a.py"), (1, 5, "CWE-89", "c", "LOW", "x", "p\\a.py"), (2, None, "CWE-22", "a", "MEDIUM", "y", None), (2, 7, "CWE-22", "a", None, " y ", "q.py")]
    found = spark.createDataFrame(rows, "file_id bigint, line_no int, cwe string, rule string, severity string, line string, path string")
    kept = findings.distinct_by_place(found)
    assert {(r["file_id"], r["line_no"], r["rule"]) for r in kept.collect()} == {(1, 5, "a"), (2, None, "a"), (2, 7, "a")}
    assert sorted(r["finding_id"] for r in findings.numbered(found).collect()) == [f"F-{i:04d}" for i in range(1, 6)]
    prints = findings.with_fingerprint(found)
    assert findings.distinct_by_fingerprint(prints).where("places = 2").count() == 1
    status = {r["status"]: r["count"] for r in findings.compared(prints.where("file_id = 1"), prints.where("rule = 'a'")).groupBy("status").count().collect()}
    assert status == {"unchanged": 1, "new": 2, "resolved": 1}
    assert findings.at_least(found, "MEDIUM").count() == 3
    result = json.loads(findings.sarif_results(found.where("rule = 'b'")).first()["result"])
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "p/a.py"
    assert json.loads(findings.sarif_results(found.where("line_no is null")).first()["result"])["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert "<td>HIGH</td>" in findings.html_report(found) and findings.per_weakness(found).count() == 2


def test_write_sarif(spark, tmp_path):
    found = spark.createDataFrame([(1, 5, "CWE-89", "b", "HIGH", "a.py")], "file_id bigint, line_no int, cwe string, rule string, severity string, path string")
    findings.write_sarif(found, str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s/run")).first()[0])["version"] == "2.1.0"
    assert spark.read.text(str(tmp_path / "s/results")).count() == 1


def test_metrics(spark):
    rows = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("a", False, False), ("b", False, False)], "k string, predicted boolean, actual boolean")
    got = {r["k"]: r for r in metrics.confusion(rows, "k").collect()}
    assert (got["a"]["tp"], got["a"]["precision"], got["b"]["precision"], got["b"]["f1"]) == (1, 0.5, 1.0, 1.0)
    assert {r["k"]: r["mcc"] for r in metrics.matthews(rows, "k").collect()} == {"a": 0.0, "b": 0.0}
    found = spark.createDataFrame([(1, 3, "c"), (1, 4, "c"), (2, 1, "c")], "file_id int, line_no int, cwe string")
    truth = spark.createDataFrame([(1, 3, True), (1, 0, False)], "file_id int, line_no int, vulnerable boolean")
    assert {(r["file_id"], r["line_no"]): r["vulnerable"] for r in metrics.matched_truth(found, truth).collect()} == {(1, 3): True, (1, 4): False, (2, 1): None}


def test_features_and_scores(spark, files):
    counts = features.keyword_features(files)
    assert counts.where("file_id = 2").first()["source_words"] == 0 and counts.where("file_id = 1").first()["source_words"] >= 1
    built = {r["file_id"]: r for r in features.extracted(spark.createDataFrame([(1, "python", "def f(a, b):\n    while a:\n        if b:\n            return g(a)\n    return 1\ndef g(x):\n    return x\n"), (2, "python", None), (3, "python", "x = (")], "file_id bigint, language string, code string")).collect()}
    assert (built[1]["methods"], built[1]["parameters"], built[1]["branches"], built[1]["returns"], built[1]["call_depth"]) == (2, 3, 2, 3, 1) and built[1]["loops"] >= 1
    assert built[2]["instructions"] == built[3]["instructions"] == 0
    scored = {r["file_id"]: r for r in scoring.predicted(scoring.engineered(counts)).collect()}
    assert scored[2]["verdict"] == "SAFE" and all(r["exposed"] or r["probability"] < scoring.THRESHOLD for r in scored.values())
    assert scoring.chosen(counts, ["source_words", "absent"]).first()["absent"] == 0.0
    assert {r["cwe"]: r["confidence"] for r in scoring.confidence(spark.createDataFrame([("CWE-89", 1), ("CWE-78", 0), ("CWE-798", 0), (None, 0)], "cwe string, paths int")).collect()} == {"CWE-89": 0.92, "CWE-78": 0.65, "CWE-798": 0.88, None: 0.70}
    assert features.longest_path(0, {}) == 0 and features.path_count(2, {0: {1, -1}, 1: {-1}}) == 2


def test_incremental(spark):
    old = incremental.entries(spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, code string"))
    new = incremental.entries(spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "path string, code string"))
    assert {r["path"]: r["stale"] for r in incremental.staleness(new, old).collect()} == {"a": False, "b": True, "c": True}
    assert incremental.hit_rate(incremental.staleness(new, old)).first()["hit_rate"] == 0.333333
    assert incremental.hit_rate(incremental.staleness(new.limit(0), old)).first()["hit_rate"] == 0.0
    imports = spark.createDataFrame([("a", "mb")], "path string, module string")
    exports = spark.createDataFrame([("mb", "b")], "module string, path string")
    assert {r["path"]: r["action"] for r in incremental.plan(new, old, imports, exports).collect()} == {"a": "rebuild", "b": "rebuild", "c": "rebuild"}
    fresh = new.withColumn("seq", F.lit(1)).unionByName(new.where("path = 'b'").withColumn("hash", F.lit("z")).withColumn("seq", F.lit(2)))
    merged = {r["path"]: r["hash"] for r in incremental.upserted(old, fresh).collect()}
    assert set(merged) == {"a", "b", "c", "d"} and merged["b"] == "z"
    assert incremental.invalidated(old, new).count() == 1


def test_stream(spark, tmp_path):
    from loomgraph.streaming import incremental as streaming

    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"path": "a.py", "language": "python", "code": "x = input()\neval(x)\n", "seq": 1}))
    streaming.run(spark, streaming.file_stream(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{store}/findings-0").where("rule = 'core-sink-001'").count() == 1
    (folder / "2.json").write_text(json.dumps({"path": "a.py", "language": "python", "code": "x = 1\n", "seq": 2}))
    streaming.run(spark, streaming.file_stream(spark, str(folder)), store, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(f"{store}/findings-1").count() == 0 and spark.read.parquet(f"{store}/cache-1").count() == 1


def test_sources(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"a.py": "x = 1", "src/B.java": "class B {}", "node_modules/c.py": "y", ".hidden/d.py": "y", "tests/e.py": "y", "f.txt": ""}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert [r["language"] for r in code.discover(spark, str(root), tests=False).collect()] == ["python", "java"]
    assert code.discover(spark, str(root)).count() == 3
    (tmp_path / "ignore").write_text("# note\nsrc/\n\n")
    assert "src" in code.ignore_list(spark, str(tmp_path / "ignore"))
    (tmp_path / "truth.csv").write_text('key,category,verdict,cwe\n"T1",sqli,true,89\nT2,xss,false,79\n')
    assert [(r["test_key"], r["vulnerable"], r["cwe"]) for r in code.truth_from_csv(spark, str(tmp_path / "truth.csv")).collect()] == [("T1", True, "CWE-89"), ("T2", False, "CWE-79")]
    assert code.merged_config({"a": None, "b": 1}, {"a": 2, "b": 3}) == {"b": 1, "a": 2}
    marked = code.truth_from_comments(code.lines(spark.createDataFrame([(1, "python", "x # VULNERABLE CWE-89\ny # SAFE\nz", "p")], FILES)))
    assert {(r["line_no"], r["vulnerable"], r["cwe"]) for r in marked.collect()} == {(1, True, "CWE-89"), (2, False, None)}


def test_every_sql_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) > 45
