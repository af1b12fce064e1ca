"""Features of source files: keyword counts by built-in expressions, and structure from the lowered instructions."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import any_of, keyword_count
from ..session import parallel
from ..sources.frontends import MODULE, lower
from .taint import Rules, analysed

# Words whose occurrences in the lower-case text are summed.
KEYWORDS = {
    "source_words": (
        "request.args", "request.form", "request.json", "request.cookies", "request.headers", "request.values", "request.stream", "request.url", "request.referrer", "request.get", "request.post", "request.body", "request.meta",
        "input(", "sys.argv", "environ", "getenv", "environ.get(",
        "getparameter", "getheader", "getcookies", "getquerystring", "nextline", "readline",
        "getsession", "getattribute", "getinputstream", "getreader", "getpart", "getrequesturi", "getrequesturl", "getpathinfo",
        "query(", "body(", "path(", "cookie(", "header(",
        "session.query", "objects.all", "objects.filter",
        "@modelattribute", "@sessionattribute", "@cookievalue",
        "session.get(", "session.load(", "session.createquery",
        "readvalue(", "readtree(", "objectmapper", "fromjson(", "gson.fromjson", "jdbctemplate",
    ),
    "sink_words": (
        "execute", "query", "executequery", "executeupdate", "executebatch", "createquery", "createnativequery", "run", "popen", "system", "subprocess", "processbuilder", "open", "fileinputstream", "readobject", "loads",
        "urlopen", "get", "post", "getwriter", "println", "sendredirect", "setheader", "addheader", "path(", "new file",
    ),
    "clean_words": ("strip", "escape", "sanitize", "encode", "replace", "clean"),
    "collection_words": ("append", "add", "put"),
    "environment_words": ("environ", "getenv", "sys.argv"),
    "branch_words": ("if ", "elif ", "else if", "switch", "case "),
    "loop_words": ("for ", "while "),
    "catch_words": ("except", "catch"),
    "return_words": ("return ",),
}
#: Sources by kind; a file's number of kinds is a feature of its own.
CATEGORIES = {
    "web": ("request.", "getparameter", "getheader"),
    "console": ("input(", "nextline", "readline"),
    "environment": ("environ", "getenv"),
    "arguments": ("argv", "argparse"),
    "network": ("recv", "getinputstream"),
    "file": ("open(", "filereader"),
}
STEPS = 5000
PATHS = 50
LONGEST = 100


def keyword_features(code_files: DataFrame) -> DataFrame:
    """(file_id, one count a keyword class); a null code counts nothing."""
    return code_files.select("file_id", *(keyword_count(F.col("code"), words).alias(name) for name, words in KEYWORDS.items()))


def source_categories(code_files: DataFrame) -> DataFrame:
    """(file_id, categories): how many kinds of sources a file has."""
    low = F.lower("code")
    parts = [F.coalesce(F.greatest(*(low.contains(w).cast("int") for w in words)), F.lit(0)) for words in CATEGORIES.values()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return code_files.select("file_id", total.alias("categories"))


def _graph(rows: list[tuple]) -> dict[str, tuple[int, dict[int, set[int]]]]:
    """For each method, its number of instructions and the successors of each; the end is -1."""
    methods: dict[str, list[tuple]] = defaultdict(list)
    for row in rows:
        methods[row[0]].append(row)
    out = {}
    for method, body in methods.items():
        labels = {row[7]: i for i, row in enumerate(body) if row[2] == "Label"}
        succ: dict[int, set[int]] = defaultdict(set)
        for i, row in enumerate(body):
            after = i + 1 if i + 1 < len(body) else -1
            if row[2] == "Jump":
                succ[i].add(labels.get(row[7], after))
            elif row[2] == "Return":
                succ[i].add(-1)
            else:
                succ[i].add(after)
                if row[2] == "Branch" and row[7] in labels:
                    succ[i].add(labels[row[7]])
        out[method] = (len(body), succ)
    return out


def longest_path(size: int, succ: dict[int, set[int]]) -> int:
    """The most instructions on an acyclic way from start to end, at most LONGEST; the best found within STEPS steps."""
    best, steps = 0, 0
    stack = [(0, 1, frozenset((0,)))] if size else []
    while stack and steps < STEPS:
        n, length, seen = stack.pop()
        steps += 1
        for m in sorted(succ.get(n, ())):
            if m == -1:
                best = max(best, length)
            elif m not in seen:
                stack.append((m, length + 1, seen | {m}))
    return min(best, LONGEST)


def path_count(size: int, succ: dict[int, set[int]]) -> int:
    """Acyclic ways from start to end, at most PATHS, within STEPS steps."""
    found, steps = 0, 0
    stack = [(0, frozenset((0,)))] if size else []
    while stack and steps < STEPS and found < PATHS:
        n, seen = stack.pop()
        steps += 1
        for m in sorted(succ.get(n, ())):
            if m == -1:
                found += 1
            elif m not in seen:
                stack.append((m, seen | {m}))
    return min(found, PATHS)


STRUCTURE = ("methods", "parameters", "instructions", "branches", "loops", "returns", "calls", "cyclomatic", "edges", "longest_path", "paths", "names", "call_depth", "taint_findings", "taint_weaknesses", "tainted_names")


def _call_depth(rows: list[tuple], methods: set[str]) -> int:
    """The longest chain of calls between methods of the file; a method on a cycle counts 0."""
    last = defaultdict(set)
    for m in methods:
        last[m.rsplit(".", 1)[-1]].add(m)
    calls: dict[str, set[str]] = defaultdict(set)
    for row in rows:
        if row[2] in ("Call", "Alloc") and row[4]:
            calls[row[0]] |= last.get(row[4].rsplit(".", 1)[-1], set())
    depth: dict[str, int] = {}

    def visit(m: str, active: frozenset[str]) -> int:
        if m in active:
            return 0
        if m not in depth:
            depth[m] = max((1 + visit(t, active | {m}) for t in calls.get(m, ()) if t not in active), default=0)
        return depth[m]

    return max((visit(m, frozenset()) for m in sorted(methods)), default=0)


def structure(code: str | None, language: str | None, rules: Rules) -> tuple[int, ...]:
    """The structure features of one file; zeros where it can't be read."""
    rows, params = lower(code, language)
    if not rows or rows[0][2] == "Error":
        return (0,) * len(STRUCTURE)
    graphs = _graph(rows)
    kinds = defaultdict(int)
    for row in rows:
        kinds[row[2]] += 1
    loops = sum(1 for method, (_, succ) in graphs.items() for n, to in succ.items() for m in to if m != -1 and m <= n)
    main = max(graphs, key=lambda m: (graphs[m][0], m))
    found, tainted = analysed(rows, params, language, rules)
    methods = {m for m in (*graphs, *params) if m != MODULE}
    return (
        len(methods), sum(map(len, params.values())), len(rows), kinds["Branch"], loops, kinds["Return"], kinds["Call"] + kinds["Alloc"], min(kinds["Branch"] + 1, 50),
        sum(len(to) for _, succ in graphs.values() for to in succ.values()), longest_path(*graphs[main]), path_count(*graphs[main]), len({row[3] for row in rows if row[3] and not row[3].startswith("%")}),
        _call_depth(rows, methods), len(found), len({f[3] for f in found if f[3]}), len(tainted),
    )


def extracted(code_files: DataFrame, *carried: str) -> DataFrame:
    """(file_id, carried columns, structure features) of every file (file_id, language, code), in one pass without a shuffle."""
    rows = parallel(code_files.select("file_id", "language", "code", *(c for c in carried if c != "code")))
    schema = ", ".join(["file_id bigint", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried), *(f"{n} int" for n in STRUCTURE)])

    def run(batches):
        rules = Rules()
        for batch in batches:
            found = [structure(code, language, rules) for language, code in zip(batch.column("language").to_pylist(), batch.column("code").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.int64()), *(batch.column(c) for c in carried), *(pa.array([r[i] for r in found], pa.int32()) for i in range(len(STRUCTURE)))], ["file_id", *carried, *STRUCTURE])

    return rows.mapInArrow(run, schema)


#: Kinds of sources, each by words in the lower-case text; the last one's words have capitals and never occur there.
SOURCE_KINDS = (
    ("request.args", "request.form", "request.json"), ("input(", "sys.argv", "readline", "stdin"), ("os.environ", "os.getenv", "environ", "getenv"), ("request.cookies", "request.headers", "request.files"),
    ("request.get", "request.post", "request.body", "request.meta"), ("getParameter", "getHeader", "getCookies", "getQueryString"),
)
CLEANING = (("escape", "sanitize", "replace"), ("quote", "escape"), ("canonicalize", "abspath", "realpath"), ("match", "regex", "re.sub"))
CWES = ("CWE-89", "CWE-78", "CWE-22", "CWE-918", "CWE-502", "CWE-327")


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def text_vector(code: Column) -> dict[str, Column]:
    """Those of the 55 features that the text alone gives, by name; a null code counts nothing."""
    low = F.coalesce(F.lower(code), F.lit(""))
    n = lambda words: keyword_count(low, words).cast("double")
    words = lambda pattern: F.regexp_count(F.coalesce(code, F.lit("")), F.lit(pattern)).cast("double")
    module = r"(?m)^[ \t]*(?:import|from)[ \t]+[\w.]*"
    imported = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(f"({module})"), F.lit(1))
    of = lambda needles: F.size(F.filter(imported, lambda m: any_of(m, needles))).cast("double")
    sources, sinks, clean, collected = (n(KEYWORDS[k]) for k in ("source_words", "sink_words", "clean_words", "collection_words"))
    kinds = _flag(any_of(low, SOURCE_KINDS[0]))
    for needles in SOURCE_KINDS[1:]:
        kinds = kinds + _flag(any_of(low, needles))
    out = {"f0": sources, "f1": sinks, "f3": kinds, "f5": clean, "f8": collected, "f26": of(KEYWORDS["sink_words"]), "f27": of(KEYWORDS["clean_words"]), "f30": words(module), "f34": _flag(sources > 1)}
    out |= {f"f{42 + i}": _flag(any_of(low, needles)) for i, needles in enumerate(CLEANING)}
    return out | {"f51": F.round(sinks / F.greatest(clean, F.lit(1.0)), 6), "f54": F.round(n(KEYWORDS["environment_words"]) / F.greatest(sources, F.lit(1.0)), 6)}


def vector(code_files: DataFrame) -> DataFrame:
    """(file_id, f0 ... f54): the feature vector of every file, text and structure in one pass without a shuffle.

    Features 7 and 11 count what no analysis updates, and 36 to 41 name weaknesses in a
    spelling that findings do not have; they are 0.  Fields (29) are the names assigned on
    `self` or `this`.
    """
    rows = extracted(code_files, "code")
    text = text_vector(F.col("code"))
    c = lambda name: F.col(name).cast("double")
    low = F.coalesce(F.lower("code"), F.lit(""))
    paths, nodes, catches = c("taint_findings"), F.least(c("instructions"), F.lit(1000.0)), keyword_count(low, KEYWORDS["catch_words"]).cast("double")
    zero, clean, sources = F.lit(0.0), F.col("f5"), F.col("f0")
    found = _flag(paths > 0)
    fields = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"\b(?:self|this)\.(\w+)\s*="), F.lit(1)))).cast("double")
    scopes = c("methods") + 1
    more = {
        "f2": paths, "f4": F.least(c("longest_path"), F.lit(100.0)), "f6": _flag((paths > 0) & (clean < paths)), "f7": zero, "f9": paths / (sources + 1), "f10": c("tainted_names") / (c("names") + 1), "f11": zero,
        "f12": nodes, "f13": c("cyclomatic"), "f14": F.when(paths > 0, c("branches") / 2).otherwise(0.0), "f15": c("loops"), "f16": F.when(paths > 0, catches / 2).otherwise(0.0), "f17": c("edges") / (nodes + 1), "f18": c("returns"),
        "f19": 2 * _flag(c("branches") > 0), "f20": 2 * _flag(c("loops") > 0), "f21": catches, "f22": _flag((catches > 0) | low.rlike(r"\btry\b")), "f23": F.least(c("paths"), F.lit(50.0)), "f24": c("names"), "f25": scopes,
        "f28": c("parameters"), "f29": fields, "f31": _flag(scopes > 1), "f32": found, "f33": found * _flag(any_of(low, ("args", "form", "json"))), "f35": found * _flag(any_of(low, ("env", "getenv"))),
        **{f"f{36 + i}": zero for i in range(len(CWES))}, "f46": found, "f47": found * _flag(c("cyclomatic") > 2), "f48": paths, "f49": c("taint_weaknesses"),
        "f50": clean / F.greatest(paths, F.lit(1.0)), "f52": F.when(clean > 0, paths).otherwise(0.0) / F.greatest(paths, F.lit(1.0)), "f53": paths / F.greatest(nodes, F.lit(1.0)),
    }
    wide = rows.select("*", *(e.alias(k) for k, e in text.items()))
    return wide.select("file_id", *((F.col(f"f{i}") if f"f{i}" in text else F.round(more[f"f{i}"], 6).alias(f"f{i}")) for i in range(55)))
