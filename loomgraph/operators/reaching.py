"""Definitions that reach uses, traces back from uses, and lines that constants make dead."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.constants import folded_branches
from ..session import parallel
from ..sources.frontends import lower


def definitions(rows: list[tuple]) -> list[tuple[str, int, str, int]]:
    """(method, position of a use, name, position of a definition) for all definitions that reach the use; -1 where a name may come from outside."""
    methods: dict[str, list[tuple]] = defaultdict(list)
    for row in rows:
        methods[row[0]].append(row)
    out = []
    for method, body in sorted(methods.items()):
        labels = {row[7]: i for i, row in enumerate(body) if row[2] == "Label"}
        before: list[set[int]] = [set() for _ in body]
        before_names: list[dict[str, set[int]]] = [defaultdict(set) for _ in body]
        succ: list[list[int]] = []
        for i, row in enumerate(body):
            to = [] if row[2] == "Return" else [labels.get(row[7], i + 1)] if row[2] == "Jump" else [i + 1]
            if row[2] == "Branch" and row[7] in labels:
                to.append(labels[row[7]])
            succ.append([j for j in to if j < len(body)])
        defined = {i: row[3] for i, row in enumerate(body) if row[3] and row[2] != "HeapStore"}
        work = [0] if body else []
        reached = {0}
        while work:
            i = work.pop()
            after = {d for d in before[i] if defined[d] != defined.get(i)} | ({i} if i in defined else set())
            for j in succ[i]:
                if not after <= before[j] or j not in reached:
                    before[j] |= after
                    reached.add(j)
                    work.append(j)
        for i, row in enumerate(body):
            for d in before[i]:
                before_names[i][defined[d]].add(d)
            for name in dict.fromkeys(a for a in row[5] if not a.startswith("=")):
                hits = before_names[i].get(name) or {-1}
                out += [(method, i, name, d) for d in sorted(hits)]
    return out


def reaching(code_files: DataFrame) -> DataFrame:
    """(file_id, method, use, name, definition) of every file (file_id, language, code), solved where it lies."""
    schema = "file_id bigint, method string, use int, name string, definition int"

    def run(batches):
        for batch in batches:
            rows = [(i, *d) for i, language, code in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "code")), strict=True) for d in definitions(lower(code, language)[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32()))], [x.split()[0] for x in schema.split(", ")])

    return parallel(code_files.select("file_id", "language", "code")).mapInArrow(run, schema)


_ASSIGNED = re.compile(r"^\s*(?:[A-Za-z_][\w<>\[\], ]*\s+)?([A-Za-z_]\w*)\s*=\s*([^=].*)$")
_NAMES = re.compile(r"[A-Za-z_]\w*")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")
_READS = re.compile(r"request\.|getparameter|getheader|input\(|getenv|environ|argv|readline", re.IGNORECASE)


def back_trace(lines: list[str], line_no: int) -> list[tuple[int, str]]:
    """(line, text) from a use back to what its names were last set from, down to lines that read from outside; nearest first."""
    seen: set[int] = set()
    out: list[tuple[int, str]] = []
    work = [(line_no, name) for name in _NAMES.findall(_STRINGS.sub("", lines[line_no - 1]))] if 0 < line_no <= len(lines) else []
    # The lines that set each name, in order.
    places: dict[str, list[tuple[int, str]]] = {}
    for i, line in enumerate(lines[: line_no - 1] if work else ()):
        if m := _ASSIGNED.match(line):
            places.setdefault(m[1], []).append((i, m[2]))
    while work:
        at, name = work.pop()
        own = places.get(name, [])
        k = bisect_left(own, (at - 1,)) - 1
        if k < 0 or own[k][0] + 1 in seen:
            continue
        i, value = own[k]
        seen.add(i + 1)
        out.append((i + 1, lines[i].strip()))
        if not _READS.search(value):
            work += [(i + 1, n) for n in _NAMES.findall(_STRINGS.sub("", value))]
    return sorted(out, reverse=True)


def traced(findings: DataFrame) -> DataFrame:
    """Findings (file_id, line_no, code) with `trace`: the lines back from them, nearest first."""
    schema = "file_id bigint, line_no int, trace array<string>"

    def run(batches):
        for batch in batches:
            traces = []
            for line_no, code in zip(batch.column("line_no").to_pylist(), batch.column("code").to_pylist(), strict=True):
                traces.append([f"{n}: {text}" for n, text in back_trace((code or "").split("\n"), line_no or 0)])
            yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.int64()), batch.column("line_no").cast(pa.int32()), pa.array(traces, pa.list_(pa.string()))], ["file_id", "line_no", "trace"])

    return findings.select("file_id", "line_no", "code").mapInArrow(run, schema)


def dead_lines(code: str, java: bool = False) -> list[int]:
    """Lines inside branches whose condition constants make false; by indentation."""
    lines = code.split("\n")
    dead: list[int] = []
    for line_no, _, value in folded_branches(code, java):
        if value:
            continue
        depth = len(lines[line_no - 1]) - len(lines[line_no - 1].lstrip())
        for i in range(line_no, len(lines)):
            text = lines[i]
            if text.strip() and len(text) - len(text.lstrip()) <= depth:
                break
            if text.strip():
                dead.append(i + 1)
    return dead
