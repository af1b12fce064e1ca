from loomgraph.operators import reaching, typing
from loomgraph.sources import code, frontends


def test_hierarchy_routes_and_resolution(spark):
    java = 'package a.b;\nimport c.D;\nimport e.*;\n@WebServlet("/x")\npublic final class A<T> extends B implements I, J<K> {\n}\ninterface Q extends I {\n'
    python = '@app.route("/y")\ndef handler():\n    pass\nclass M(N, o.P):\n    pass\n'
    files = spark.createDataFrame([(1, "java", java, "A.java"), (2, "python", python, "m.py"), (3, "java", None, None)], "file_id bigint, language string, code string, path string")
    lines = code.lines(files)
    assert {tuple(r) for r in typing.inheritance(lines).collect()} == {("A", "B"), ("A", "I"), ("A", "J"), ("Q", "I"), ("M", "N"), ("M", "o.P")}
    assert {(r["route"], r["handler"]) for r in typing.routes(lines).collect()} == {("/x", "A"), ("/y", "handler")}
    names = spark.createDataFrame([(1, "a.b", "D"), (1, "a.b", "X"), (1, "a.b", "Y"), (1, "a.b", "c.D"), (1, "a.b", "Z")], "file_id bigint, package string, name string")
    types = spark.createDataFrame([("c.D",), ("a.b.X",), ("e.X",), ("e.Y",), ("z.Z",)], "fqn string")
    got = {r["name"]: (r["fqn"], r["tier"]) for r in typing.resolved_types(names, types, code.imports(lines)).collect()}
    assert got == {"D": ("c.D", 2), "X": ("a.b.X", 3), "Y": ("e.Y", 4), "c.D": ("c.D", 1), "Z": (None, None)}


def test_flows_and_accessors(spark):
    flows = spark.createDataFrame([("web", "CWE-79"), ("console", "CWE-79"), ("other", "CWE-1"), (None, "CWE-1")], "domain string, cwe string")
    assert {(r["domain"], r["allowed"]) for r in typing.allowed_flows(flows).collect()} == {("web", True), ("console", False), ("other", True), (None, True)}
    calls = spark.createDataFrame([("html.escape",), ("html.unescape",), ("shlex.quote",), ("int(x)",), (None,)], "callee string")
    assert [r["cleans"] for r in typing.cleaned_weaknesses(calls).collect()][:3] == [["CWE-79"], [], ["CWE-78"]]
    methods = spark.createDataFrame([("getX", 0, False, False), ("value", 0, True, False), ("setX", 1, False, False), ("put", 1, False, True), ("run", 2, False, False)], "name string, params int, returns_field boolean, sets_field boolean")
    assert [r["accessor"] for r in typing.accessors(methods).collect()] == ["getter", "getter", "setter", "setter", "none"]


def test_reaching_definitions(spark):
    text = "x = 1\nif a:\n    x = 2\ny = x\nwhile y:\n    y = f(y)\n"
    rows, _ = frontends.lower_python(text)
    found = reaching.definitions(rows)
    places = {row[1]: row for row in rows}
    copy = next(p for p, row in places.items() if row[2] == "Assign" and row[3] == "y" and row[5] == ["x"])
    assert sorted(places[d][5][0] for _, use, name, d in found if use == copy and name == "x") == ["=1", "=2"]
    assert any(name == "a" and d == -1 for _, _, name, d in found)
    branch = next(p for p, row in places.items() if row[2] == "Branch" and row[5] == ["y"])
    assert len([d for _, use, name, d in found if use == branch and name == "y"]) == 2
    files = spark.createDataFrame([(1, "python", text), (2, "python", None), (3, "python", "x = (")], "file_id bigint, language string, code string")
    assert reaching.reaching(files).where("file_id = 1").count() == len(found) and reaching.reaching(files).where("file_id != 1").count() == 0


def test_traces_and_dead_lines(spark):
    text = "a = input()\nb = 'x' + a\nc = 3\na = 1\nrun(b, c)\n"
    assert reaching.back_trace(text.split("\n"), 5) == [(3, "c = 3"), (2, "b = 'x' + a"), (1, "a = input()")]
    assert reaching.back_trace([], 3) == [] and reaching.back_trace(["x = x"], 1) == []
    frame = spark.createDataFrame([(1, 5, text), (2, 1, None)], "file_id bigint, line_no int, code string")
    assert {r["file_id"]: len(r["trace"]) for r in reaching.traced(frame).collect()} == {1: 3, 2: 0}
    assert reaching.dead_lines("n = 1\nif n > 2:\n    a()\n\n    b()\nc()\n") == [3, 5]


def test_traces_have_no_bound():
    lines = ["v0 = input()"] + [f"v{i} = v{i - 1}" for i in range(1, 12_001)] + ["use(v12000)"]
    trace = reaching.back_trace(lines, len(lines))
    assert len(trace) == 12_001 and trace[-1] == (1, "v0 = input()")
