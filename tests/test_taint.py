import random

import pytest

from loomgraph.operators import taint
from loomgraph.plans import rules as catalog
from loomgraph.sources import frontends

RULES = taint.Rules()


def found(code, language="python"):
    return {(f[2], f[1]) for f in taint.file_findings(code, language, RULES)}


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("x = input()\neval(x)\n", {("core-sink-001", 2)}),
        ("x = input()\nx = html.escape(x)\neval(x)\n", set()),
        ("x = input()\nx = 'a'\neval(x)\n", set()),
        ("x = input()\ny = 'a' + x\neval(y)\n", {("core-sink-001", 3)}),
        ("o.f = input()\neval(o.f)\n", {("core-sink-001", 2)}),
        ("def f(a):\n    return a\ny = f(input())\neval(y)\n", {("core-sink-001", 4)}),
        ("def f(a):\n    eval(a)\nf(input())\n", {("core-sink-001", 2)}),
        ("def f(a):\n    return 'c'\ny = f(input())\neval(y)\n", set()),
        ("if input():\n    x = input()\nelse:\n    x = 1\neval(x)\n", {("core-sink-001", 5)}),
        ("x = 1\nwhile x:\n    eval(x)\n    x = input()\n", {("core-sink-001", 3)}),
        ("def r(a):\n    return r(a)\nx = r(input())\neval(x)\n", set()),
        ("eval(input())\n", {("core-sink-001", 1)}),
        ("x = (\n", set()),
        ("", set()),
    ],
)
def test_python_flows(code, want):
    assert {f for f in found(code) if f[0].startswith("core-sink")} == want


def test_java_flows():
    code = 'public class A {\n void f(HttpServletRequest r) {\n  String p = r.getParameter("a");\n  g(p);\n }\n void g(String q) {\n  statement.executeQuery("x" + q);\n }\n}'
    assert ("db-sqli-006", 7) in found(code, "java")
    assert not found(code.replace("getParameter", "constant"), "java")


def random_problem(seed):
    rng = random.Random(seed)
    p = taint.Problem()
    facts = [taint.ZERO, "a", "b", "c"]
    methods = []
    for m in range(3):
        nodes = list(range(m * 10, m * 10 + rng.randint(4, 8)))
        methods.append(nodes)
        p.entries.add(nodes[0])
        p.exit[nodes[0]] = nodes[-1]
        for x, y in zip(nodes, nodes[1:], strict=False):
            p.succ[x].add(y)
        if rng.random() < 0.5:
            p.succ[nodes[-2]].add(nodes[1])
    for nodes in methods:
        for n in nodes[1:-1]:
            for _ in range(rng.randint(0, 2)):
                p.gen[n].add((rng.choice(facts), rng.choice(facts[1:])))
            if rng.random() < 0.4:
                p.kill[n].add(rng.choice(facts[1:]))
        site = rng.choice(nodes[1:-1])
        target = rng.choice(methods)
        p.call[site].add((target[0], site + 1))
        p.pass_in[(site, target[0])] |= {(taint.ZERO, taint.ZERO), (rng.choice(facts), rng.choice(facts[1:]))}
        p.pass_out[(site, target[-1])] |= {(rng.choice(facts[1:]), rng.choice(facts[1:]))}
    return p


def test_local_solver_is_order_free():
    for seed in range(60):
        p = random_problem(seed)
        q = random_problem(seed)
        q.entries = set(sorted(q.entries, reverse=True))
        assert taint.solve(p) == taint.solve(q)


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_and_local_solver_agree(spark, seed):
    p = random_problem(seed)
    got = {tuple(r) for r in taint.tabulate(taint.relation_tables(spark, p)).collect()}
    assert got == taint.solve(p)


def test_file_findings_table(spark):
    files = spark.createDataFrame([(1, "python", "x = input()\neval(x)\n"), (2, "java", None), (3, None, "x"), (4, "python", "x = (")], "file_id bigint, language string, code string")
    assert [(r["file_id"], r["rule"]) for r in taint.findings(files).where("rule like 'core%'").collect()] == [(1, "core-sink-001")]
    assert taint.findings(files.limit(0)).count() == 0
    kinds = {r["kind"] for r in frontends.instructions(files).collect()}
    assert {"Call", "Assign", "Error"} <= kinds


def test_points_to_and_aliases(spark):
    code = "class A:\n    pass\nx = A()\ny = x\nz = A()\nif y:\n    z = x\n"
    files = spark.createDataFrame([(1, "python", code)], "file_id bigint, language string, code string")
    held = taint.points_to(frontends.instructions(files))
    names = {}
    for r in held.collect():
        names.setdefault(r["name"], set()).add(r["site"])
    assert names["x"] == names["y"] and len(names["z"]) == 2
    pairs = {(r["a"], r["b"]): r["must"] for r in taint.may_alias(held).collect()}
    assert pairs[("x", "y")] is True and pairs[("x", "z")] is False


def test_rules(spark):
    table = catalog.catalog(spark)
    assert table.count() == 150 and catalog.problems(table).count() == 0
    assert table.groupBy("kind").count().collect() and {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()} == {"Source": 46, "Sink": 72, "Sanitizer": 21, "Propagator": 11}
    assert catalog.selected(table, packs=["xxe", "absent"]).count() == 7
    assert catalog.selected(table, preset="java_only").where("language = 'python'").count() == 0
    calls = spark.createDataFrame([(1, "getParameter", "java"), (2, "getParameter", "python"), (3, "HttpServletRequest.getParameter", "java"), (4, "request.args.get", "python")], "site int, callee string, language string")
    assert {(r["site"], r["rule_id"]) for r in catalog.matched(calls, table).where("kind = 'Source'").collect()} == {(1, "java-src-001"), (1, "java-src-009"), (3, "java-src-001")}
    assert {r["rule_id"] for r in catalog.matched(calls, table, suffixes=True).where("site = 4").collect()} == {"py-src-005"}


def test_rule_packs_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "own", "rules": [{"id": "r1", "kind": "Sink", "matcher": "FunctionName", "language": "any", "name": "danger", "cwe": "CWE-1", "severity": "High"}, {"id": "r1", "kind": "x", "matcher": "FunctionName", "language": "any", "name": "", "severity": "High"}]}')
    own = catalog.from_json(spark, str(tmp_path))
    assert own.count() == 2 and {r["problem"] for r in catalog.problems(own).collect()} == {"repeated id", "unknown kind", "name is empty or malformed"}
    assert '"id":"own"' in catalog.to_json(own.where("kind = 'Sink'")).first()["json"]
