"""Taint from sources to sinks: interprocedural dataflow by tabulation.

A problem is a set of relations over nodes and facts; `0` is the fact that always
holds.

* succ(n, m): m follows n inside a method;
* call(n, entry, ret): n calls the method of `entry` and goes on at `ret`;
* exit(entry, exit): a method's two ends;
* gen(n, d, e): fact d ahead of n gives e behind it; kill(n, d): d ends at n;
* pass_in(n, entry, d, e) and pass_out(n, exit, d, e): facts through a call.

`tabulate` solves a problem over any number of programs at once as a semi-naive
fixpoint of joins: each round joins only the path edges found in the last one, and
writes the sum of all to the checkpoint folder.  `solve` solves the problem of one
file in memory.  Files that call each other go to the first; a collection of
files that don't is solved where each file lies, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rules import catalog_rows
from ..session import checkpointed, parallel
from ..sources.frontends import lower

ZERO = "0"


@dataclass
class Problem:
    """The relations of one program, with plain node numbers."""

    entries: set[int] = field(default_factory=set)
    succ: dict[int, set[int]] = field(default_factory=lambda: defaultdict(set))
    call: dict[int, set[tuple[int, int]]] = field(default_factory=lambda: defaultdict(set))
    exit: dict[int, int] = field(default_factory=dict)
    gen: dict[int, set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))
    kill: dict[int, set[str]] = field(default_factory=lambda: defaultdict(set))
    pass_in: dict[tuple[int, int], set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))
    pass_out: dict[tuple[int, int], set[tuple[str, str]]] = field(default_factory=lambda: defaultdict(set))

    def relations(self) -> dict[str, list[tuple]]:
        """The relations as rows."""
        return {
            "entries": [(n,) for n in sorted(self.entries)],
            "succ": [(n, m) for n, to in sorted(self.succ.items()) for m in sorted(to)],
            "call": [(n, e, r) for n, to in sorted(self.call.items()) for e, r in sorted(to)],
            "exit": sorted(self.exit.items()),
            "gen": [(n, d, e) for n, to in sorted(self.gen.items()) for d, e in sorted(to)],
            "kill": [(n, d) for n, to in sorted(self.kill.items()) for d in sorted(to)],
            "pass_in": [(n, e, a, b) for (n, e), to in sorted(self.pass_in.items()) for a, b in sorted(to)],
            "pass_out": [(n, x, a, b) for (n, x), to in sorted(self.pass_out.items()) for a, b in sorted(to)],
        }


def _flow(problem: Problem, n: int, fact: str) -> set[str]:
    out = {e for d, e in problem.gen.get(n, ()) if d == fact}
    if fact == ZERO or fact not in problem.kill.get(n, ()):
        out.add(fact)
    return out


def solve(problem: Problem) -> set[tuple[str, int, str]]:
    """All path edges (fact at the method's entry, node, fact ahead of the node)."""
    edges: set[tuple[str, int, str]] = set()
    work: list[tuple[str, int, str]] = []
    incoming: dict[tuple[int, str], set[tuple[int, int, str]]] = defaultdict(set)
    ends: dict[tuple[int, str], set[str]] = defaultdict(set)
    entry_of = {x: e for e, x in problem.exit.items()}

    def add(d1: str, n: int, d2: str) -> None:
        if (d1, n, d2) not in edges:
            edges.add((d1, n, d2))
            work.append((d1, n, d2))

    for entry in problem.entries:
        add(ZERO, entry, ZERO)
    while work:
        d1, n, d2 = work.pop()
        out = _flow(problem, n, d2)
        for m in problem.succ.get(n, ()):
            for d3 in out:
                add(d1, m, d3)
        for entry, ret in problem.call.get(n, ()):
            for a, b in problem.pass_in.get((n, entry), ()):
                if a != d2:
                    continue
                add(b, entry, b)
                if (n, ret, d1) not in incoming[(entry, b)]:
                    incoming[(entry, b)].add((n, ret, d1))
                    for d4 in tuple(ends[(entry, b)]):
                        for x, y in problem.pass_out.get((n, problem.exit[entry]), ()):
                            if x == d4:
                                add(d1, ret, y)
        if n in entry_of:
            entry = entry_of[n]
            if d2 not in ends[(entry, d1)]:
                ends[(entry, d1)].add(d2)
                for site, ret, d0 in tuple(incoming[(entry, d1)]):
                    for x, y in problem.pass_out.get((site, n), ()):
                        if x == d2:
                            add(d0, ret, y)
    return edges


_SCHEMAS = {"entries": "n bigint", "succ": "n bigint, m bigint", "call": "n bigint, entry bigint, ret bigint", "exit": "entry bigint, exit bigint", "gen": "n bigint, d string, e string", "kill": "n bigint, d string", "pass_in": "n bigint, entry bigint, d string, e string", "pass_out": "n bigint, exit bigint, d string, e string"}


def relation_tables(spark, problem: Problem) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame(rows, _SCHEMAS[name]) for name, rows in problem.relations().items()}


def tabulate(r: dict[str, DataFrame], rounds: int = 1000) -> DataFrame:
    """(d1, n, d2): all path edges of a problem given as relations, by semi-naive rounds."""
    zero = F.lit(ZERO)
    new = checkpointed(r["entries"].select(zero.alias("d1"), "n", zero.alias("d2")))
    total = new
    incoming = None
    kill = r["kill"].withColumnRenamed("d", "d2")
    exits = r["exit"]
    for _ in range(rounds):
        kept = new.join(kill, ["n", "d2"], "left_anti").union(new.where(F.col("d2") == zero).select("n", "d2", "d1")).select("d1", "n", "d2").distinct()
        made = new.join(r["gen"].withColumnRenamed("d", "d2"), ["n", "d2"]).select("d1", "n", F.col("e").alias("d2"))
        normal = kept.union(made).join(r["succ"], "n").select("d1", F.col("m").alias("n"), "d2")
        calls = new.join(r["call"], "n").join(r["pass_in"].withColumnRenamed("d", "d2"), ["n", "entry", "d2"])
        entered = calls.select(F.col("e").alias("d1"), F.col("entry").alias("n"), F.col("e").alias("d2"))
        came = checkpointed(calls.select("entry", F.col("e").alias("fact"), F.col("n").alias("site"), "ret", F.col("d1").alias("d0")).distinct())
        # Summaries: new callers with all ends so far, and all callers with new ends.
        at_exit = lambda edges: edges.join(exits, F.col("n") == F.col("exit")).select("entry", "exit", F.col("d1").alias("fact"), F.col("d2").alias("end"))
        older = came if incoming is None else incoming.unionByName(came).distinct()
        pairs = came.join(at_exit(total), ["entry", "fact"]).unionByName(older.join(at_exit(new), ["entry", "fact"]))
        out = pairs.join(r["pass_out"].select(F.col("n").alias("site"), "exit", F.col("d").alias("end"), "e"), ["site", "exit", "end"]).select(F.col("d0").alias("d1"), F.col("ret").alias("n"), F.col("e").alias("d2"))
        new = checkpointed(normal.union(entered).union(out).distinct().join(total, ["d1", "n", "d2"], "left_anti"))
        incoming = checkpointed(older)
        if new.isEmpty():
            return total
        total = checkpointed(total.unionByName(new))
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


class Rules:
    """The catalog by kind and key, for one language; qualified names also without their leading packages."""

    def __init__(self, rows: list[tuple] | None = None, suffixes: bool = True) -> None:
        self.by: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        for rule in rows or catalog_rows():
            rule_id, kind, matcher, language, name, cwe, severity, _ = rule
            parts = name.split(".")
            keys = {name}
            if matcher == "MethodName":
                keys.add(parts[-1])
            elif matcher == "QualifiedName" and suffixes:
                keys |= {".".join(parts[i:]) for i in range(len(parts) - 1)}
            for key in keys:
                self.by[kind][key].append((rule_id, language, cwe, severity))

    def match(self, kind: str, callee: str, language: str) -> list[tuple]:
        return [r for r in self.by[kind].get(callee, ()) if r[1] in ("any", language)]


def build(rows: list[tuple], params: dict[str, list[str]], language: str, rules: Rules) -> tuple[Problem, dict[int, tuple], dict[int, list[tuple]]]:
    """A file's problem, its instructions by node, and the sink rules of its call nodes."""
    problem = Problem()
    node_of: dict[tuple[str, int], int] = {}
    at: dict[int, tuple] = {}
    methods: dict[str, list[tuple]] = defaultdict(list)
    for row in rows:
        methods[row[0]].append(row)
    for method in params:
        methods.setdefault(method, [])
    number = 0
    ends: dict[str, tuple[int, int]] = {}
    for method, body in methods.items():
        ends[method] = (number, number + 1)
        problem.entries.add(number)
        problem.exit[number] = number + 1
        number += 2
        for row in body:
            node_of[(method, row[1])] = number
            at[number] = row
            number += 1
    by_last: dict[str, list[str]] = defaultdict(list)
    for method in methods:
        by_last[method.rsplit(".", 1)[-1]].append(method)
    sinks: dict[int, list[tuple]] = {}
    for method, body in methods.items():
        entry, end = ends[method]
        labels = {row[7]: node_of[(method, row[1])] for row in body if row[2] == "Label"}
        nodes = [node_of[(method, row[1])] for row in body]
        problem.succ[entry].add(nodes[0] if nodes else end)
        for i, row in enumerate(body):
            _, _, kind, dest, callee, args, name, label, _ = row
            n = nodes[i]
            after = nodes[i + 1] if i + 1 < len(nodes) else end
            if kind == "Jump":
                problem.succ[n].add(labels.get(label, after))
                continue
            if kind == "Return":
                problem.succ[n].add(end)
                continue
            if kind == "Branch" and label in labels:
                problem.succ[n].add(labels[label])
            problem.succ[n].add(after)
            real = [a for a in args if not a.startswith("=")]
            if kind in ("Assign", "BinaryOp"):
                problem.gen[n] |= {(a, dest) for a in real}
                if dest not in real:
                    problem.kill[n].add(dest)
            elif kind == "HeapLoad":
                base = real[0] if real else None
                if base:
                    problem.gen[n] |= {(base, dest), (f"{base}.{name}", dest)}
                problem.kill[n].add(dest)
            elif kind == "HeapStore":
                problem.gen[n] |= {(a, f"{dest}.{name}") for a in real}
            elif kind in ("Call", "Alloc"):
                problem.kill[n].add(dest)
                if rules.match("Source", callee, language):
                    problem.gen[n].add((ZERO, dest))
                clean = bool(rules.match("Sanitizer", callee, language))
                targets = [callee] if callee in methods else [f"{callee}.__init__"] if f"{callee}.__init__" in methods else by_last.get(callee.rsplit(".", 1)[-1], [])
                for target in targets:
                    start, stop = ends[target]
                    problem.call[n].add((start, after))
                    names = params.get(target, [])
                    shift = max(len(args) - len(names), 0)
                    into = {(ZERO, ZERO)} | {(a, p) for a, p in zip(args[shift:], names, strict=False) if not a.startswith("=")}
                    problem.pass_in[(n, start)] |= into
                    returned = {a for r in methods[target] if r[2] == "Return" for a in r[5] if not a.startswith("=")}
                    problem.pass_out[(n, stop)] |= {(a, dest) for a in returned}
                if not targets and not clean and (rules.match("Propagator", callee, language) or kind == "Call" and not rules.match("Sink", callee, language)):
                    # A call into code that isn't there hands its arguments on.
                    problem.gen[n] |= {(a, dest) for a in real}
                if found := rules.match("Sink", callee, language):
                    sinks[n] = found
    return problem, at, sinks


def analysed(rows: list[tuple], params: dict[str, list[str]], language: str, rules: Rules) -> tuple[list[tuple], set[str]]:
    """(findings as in `file_findings`, names that hold tainted data) of a file's instructions."""
    if not rows or rows[0][2] == "Error":
        return [], set()
    sources = [row[8] for row in rows if row[2] in ("Call", "Alloc") and rules.match("Source", row[4], language)]
    if not sources:
        return [], set()
    problem, at, sinks = build(rows, params, language, rules)
    reached: dict[int, set[str]] = defaultdict(set)
    tainted: set[str] = set()
    for _, n, fact in solve(problem):
        if fact != ZERO:
            name = fact.split(".", 1)[0]
            tainted.add(name)
            if n in sinks:
                reached[n].add(name)
    out = []
    for n, facts in sorted(reached.items()):
        row = at[n]
        hit = sorted({a for a in row[5] if a in facts})
        if hit:
            out += [(row[0], row[8], rule_id, cwe, severity, hit[0], min(sources)) for rule_id, _, cwe, severity in sinks[n]]
    return out, {n for n in tainted if not n.startswith("%")}


def file_findings(code: str | None, language: str | None, rules: Rules) -> list[tuple]:
    """(method, line, rule_id, cwe, severity, argument, source_line) of the sink calls of one file that tainted arguments reach.

    `source_line` is the file's first source call.
    """
    rows, params = lower(code, language)
    return analysed(rows, params, language, rules)[0]


FINDINGS = "file_id bigint, method string, line_no int, rule string, cwe string, severity string, argument string, source_line int"


def findings(code_files: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Taint findings of every file (file_id, language, code), each solved by itself where it lies."""

    def run(batches):
        rules = Rules(rows)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            for file_id, language, code in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True):
                out += [(file_id, *f) for f in file_findings(code, language, rules)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in FINDINGS.split(", ")])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, FINDINGS)


def points_to(code: DataFrame, rounds: int = 50) -> DataFrame:
    """(file_id, method, name, site): allocation sites that variables may hold, flow-insensitively, by rounds of joins over assignments."""
    sites = code.where("kind = 'Alloc'").select("file_id", "method", F.col("dest").alias("name"), F.concat_ws(":", "method", F.col("pos").cast("string")).alias("site"))
    copies = code.where("kind = 'Assign'").select("file_id", "method", F.col("dest").alias("to"), F.explode("args").alias("name")).where("not startswith(name, '=')")
    total = new = checkpointed(sites.distinct())
    for _ in range(rounds):
        step = new.join(copies, ["file_id", "method", "name"]).select("file_id", "method", F.col("to").alias("name"), "site").distinct()
        new = checkpointed(step.join(total, ["file_id", "method", "name", "site"], "left_anti"))
        if new.isEmpty():
            return total
        total = checkpointed(total.unionByName(new))
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def may_alias(held: DataFrame) -> DataFrame:
    """(file_id, method, a, b, must): pairs of names of a method that share a site; `must` where each holds that site alone."""
    counts = held.groupBy("file_id", "method", "name").agg(F.count(F.lit(1)).alias("n"))
    one = held.join(counts, ["file_id", "method", "name"])
    a = one.select("file_id", "method", "site", F.col("name").alias("a"), F.col("n").alias("na"))
    b = one.select("file_id", "method", "site", F.col("name").alias("b"), F.col("n").alias("nb"))
    return a.join(b, ["file_id", "method", "site"]).where("a < b").groupBy("file_id", "method", "a", "b").agg(F.bool_or((F.col("na") == 1) & (F.col("nb") == 1)).alias("must"))
