import json

import pytest

from loomgraph.functions import constants as c
from loomgraph.operators import textscan
from loomgraph.sources import folded, models, scopes


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 2", -1), ("1 / 0", c.UNKNOWN), ("x + 1", c.UNKNOWN), ("1 +", c.UNKNOWN), ("1 2", c.UNKNOWN), ("", c.UNKNOWN),
        ("1 < 2 && 3 > 4 || true", True), ("!false && true", True), ("not False and 1 == 1", True), ("x || true", True), ("x && false", False), ("x && true", c.UNKNOWN),
        ("'ab' + 'c' == \"abc\"", True), ("'a' + 1", "a1"), ("1 > 2 ? 'x' : 'y'", "y"), ("'abc'.contains('b')", True), ("'abc'.substring(1)", "bc"), ("'abc'.substring(1, 2)", "b"), ("'abc'.charAt(9)", c.UNKNOWN),
        ("' A '.trim().toLowerCase()", "a"), ("'abc'.indexOf('z')", -1), ("'a.b'.replaceAll('.', '')", c.UNKNOWN), ("'aXb'.replaceAll('X', '-')", "a-b"), ("'b' in 'abc'", True), ("'z' not in 'abc'", True), ("1 < 'a'", c.UNKNOWN),
    ],
)
def test_evaluate(text, value):
    got = c.evaluate(text)
    assert got is value if value is c.UNKNOWN else got == value and type(got) is type(value)


def test_propagate_and_branches():
    assert c.propagate([("a", "1", True), ("b", "a + 1", True), ("a2", "b * 2", False), ("d", "1", True), ("d", "2", True)]) == {"a": 1, "b": 2}
    assert c.folded_branches("x = 7\nif x * 2 > 10:\n    y()\nif z:\n    pass\nelif x == 1:\n    pass\n") == [(2, "x * 2 > 10", True), (6, "x == 1", False)]
    assert c.folded_branches("  int n = 106;\n  if ((7 * 18) + n > 200) {\n  }\n", java=True) == [(2, "(7 * 18) + n > 200", True)]


def test_collections_and_names():
    a = c.Collection()
    for v in ("x", "y", "z"):
        a.add(v)
    assert a.remove(0) == "x" and a.get(0) == "y" and a.get(9) is c.UNKNOWN
    a.put("k", 1)
    b = c.Collection()
    b.put("k", 2)
    assert a.merged(b).get("k") is c.UNKNOWN and len(a) == 3
    a.insert(0, "w")
    assert a.get(0) == "w"
    assert c.container_access("m.get('k')") == ("m", "'k'") and c.container_access("x") is None
    assert c.uses("f(x) + 'y'", "x") and not c.uses("f(x) + 'y'", "y") and c.uses("a[0]", "a[*]") and c.uses("m.get(k)", "m[k]")
    assert c.same_name("M[K]", "m.get(k)") and c.receiver("a.b.c") == "a.b"
    assert [c.parameter_name(x) for x in ("@A(1) final String s", "n: int = 3", "*args", "int[] a")] == ["s", "n", "args", "a"]


def test_scopes(spark):
    code = "import os.path\nx = 1\ndef f(a):\n    y = x\n    def g():\n        return y\nclass C:\n    z = 1\n    def m(self):\n        return z\n"
    files = spark.createDataFrame([(1, "python", code), (2, "python", "x = ("), (3, "python", None), (4, "java", "class A {}")], "file_id bigint, language string, code string")
    table = scopes.symbols(files)
    got = {(r["scope_kind"], r["name"], r["kind"]) for r in table.collect()}
    assert {("Global", "os", "Import"), ("Global", "x", "Variable"), ("Function", "a", "Parameter"), ("Function", "y", "Variable"), ("Class", "m", "Method"), ("Class", "z", "Variable")} <= got
    ids = {(r["scope_kind"], r["name"]): r["scope"] for r in table.collect()}
    f, klass, m = ids[("Function", "y")], ids[("Class", "z")], ids[("Function", "self")]
    uses = spark.createDataFrame([(1, f, "x"), (1, f, "y"), (1, m, "z"), (1, klass, "z"), (1, m, "absent")], "file_id bigint, scope int, name string")
    found = {(r["scope"], r["name"]): r["found_in"] for r in scopes.resolved(table, uses).collect()}
    assert found == {(f, "x"): 0, (f, "y"): f, (m, "z"): None, (klass, "z"): klass, (m, "absent"): None}


def test_text_readings(spark):
    assert scopes.template_parts("a {x.y!r:>4} {{b}}") == [("text", "a "), ("name", "x.y"), ("text", " {b}")]
    assert [(n, p) for n, p, _ in scopes.split_functions("def f(a, b=1):\n    x\ndef g(:\n    y\n")] == [("f", ["a", "b"]), ("g", [""][:0])]
    assert scopes.split_functions("int f(int a) { if (a) { } return 1; } int g() {", java=True)[0][:2] == ("f", ["a"])
    files = spark.createDataFrame([(1, "python", "x = 1\nif x == 1:\n    pass\ndef f(a):\n    g(a)\ndef g(b):\n    pass\n"), (2, "python", None)], "file_id bigint, language string, code string")
    assert [(r["line_no"], r["value"]) for r in folded.branches(files).collect()] == [(2, True)]
    assert [tuple(r) for r in textscan.mentions(folded.functions(files)).collect()] == [(1, "f", "g")]


def test_models(spark, tmp_path):
    good = {"id": "own", "api": "1.0", "entries": [{"kind": "Sink", "class": "a.B", "method": "run", "cwes": ["CWE-78"], "severity": "HIGH"}, {"kind": "Source", "method": "run"}, {"kind": "Source", "method": "load", "languages": ["java"]}]}
    bad = {"id": "bad", "api": "2.0", "entries": [{"kind": "Sink", "method": "x"}]}
    (tmp_path / "1.json").write_text(json.dumps(good))
    (tmp_path / "2.json").write_text(json.dumps(bad))
    entries = models.read(spark, str(tmp_path))
    assert {r["problem"] for r in models.problems(entries).collect()} == {"unsupported api", "sink without weakness"}
    kept = models.accepted(entries)
    assert kept.count() == 3
    calls = spark.createDataFrame([(1, "a.B.run", "java"), (2, "c.run", "java"), (3, "x.load", "python"), (4, "x.load", "java")], "site int, callee string, language string")
    assert {r["site"]: r["kind"] for r in models.matched(calls, kept).collect()} == {1: "Sink", 2: "Source", 4: "Source"}
    facts = spark.createDataFrame([("CWE-1", False, ["CWE-1"], None), ("CWE-1", True, None, ["CWE-1"]), ("CWE-1", False, None, ["CWE-1"]), ("CWE-2", True, ["CWE-1"], [])], "cwe string, external boolean, sanitized_for array<string>, external_sanitized_for array<string>")
    assert models.active_findings(facts).count() == 2
    stubs = spark.createDataFrame([("x.A", "f", "Sink", [0]), ("y.B", "f", "Sink", [1]), ("y.B", "g", "Source", None), ("z.C", "g", "Sink", None)], "class string, method string, kind string, from array<int>")
    sites = spark.createDataFrame([(1, "x.A", "f"), (2, "other.B", "f"), (3, "q.Q", "f"), (4, "q.Q", "g"), (5, "B", "g")], "site int, class string, method string")
    assert {r["site"]: r["kind"] for r in models.library_methods(sites, stubs).collect()} == {1: "Sink", 2: "Sink", 3: "Sink", 5: "Source"}
