import random

import pytest

from loomgraph.operators import log_templates as logs

SCHEMA = "line_id bigint, run_id string, line_no bigint, raw_line string, component string"


def one(line):
    classes, values = logs.mask(logs._clean(line))
    kind = logs.front(classes)
    where = logs.positions(kind, logs.named_after_tag({kind: 1}))
    if where is None:
        return None
    read = {k: logs._normal(classes[i], values[i], None) for k, i in where.items()}
    if classes[0] == "<GLOG>":
        read |= {"time": logs._utc(logs._GLOG.match(values[0])), "level": logs.LETTERS[values[0][0]]}
    return read.get("time", ""), read.get("level", ""), read.get("component", "")


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2026-02-11 01:24:58,646 - a.features - DEBUG - summary 1850", ("2026-02-11 01:24:58.646", "DEBUG", "a.features")),
        ("2026-01-26 11:22:17.302 [worker-11] INFO  o.k.SarifWriter - sample", ("2026-01-26 11:22:17.302", "INFO", "o.k.SarifWriter")),
        ("17-Jul-2026 09:00:28.624 INFO [main] c.q.EdgeBuilder points-to set", ("2026-07-17 09:00:28.624", "INFO", "c.q.EdgeBuilder")),
        ("05-Apr-2026 13:58:32.155 FINE [main] c.q.Loader cache entry", ("2026-04-05 13:58:32.155", "DEBUG", "c.q.Loader")),
        ("\x1b[2m2026-07-17T09:00:05.891472Z\x1b[0m \x1b[32m INFO\x1b[0m \x1b[2mv2_java\x1b[0m: lattice: level", ("2026-07-17 09:00:05.891", "INFO", "v2_java")),
        ("<14>1 2026-01-26T11:23:53.618Z node40 scanner 7088 - - guide: level", ("2026-01-26 11:23:53.618", "INFO", "scanner")),
        ("<143>Jan 26 11:22:19 node39 rule-sync[29125]: points-to set", ("2026-01-26 11:22:19.000", "DEBUG", "rule-sync")),
        ("<10>Sep  2 00:04:21 node30 scanner[21696]: summary", ("2026-09-02 00:04:21.000", "FATAL", "scanner")),
        ("2026-02-28T12:39:12.007+02:00 INFO  [engine/icfg] fixpoint reached", ("2026-02-28 10:39:12.007", "INFO", "engine/icfg")),
        ("2026-04-28T16:24:24.913+05:30 WARN  [workspace] cache", ("2026-04-28 10:54:24.913", "WARN", "workspace")),
        ("2026-01-01T00:30:00-01:00 ERROR [x] y", ("2026-01-01 01:30:00.000", "ERROR", "x")),
        ("I0405 13:57:06.679500 31321 builder.rs:127] cwe list", ("2026-04-05 13:57:06.679", "INFO", "builder.rs")),
        ("1784278813003|I|taint.stubs|manifest: level", ("2026-07-17 09:00:13.003", "INFO", "taint.stubs")),
        ("2026/07/17 09:01:16 INFO v2_taint::solver: cwe list", ("2026-07-17 09:01:16.000", "INFO", "v2_taint::solver")),
        ("[2026-02-28T10:39:42Z INFO  v2_taint::solver] engine", ("2026-02-28 10:39:42.000", "INFO", "v2_taint::solver")),
        ("WARNING:taint.features:no entry point", ("", "WARN", "taint.features")),
        ("[Info] ramp: level of nesting", ("", "INFO", "")),
        ("[TIMING] repo=a/b cwe=CWE-1", ("", "", "TIMING")),
        ("2026-07-17T09:00:32.491Z [TIMING] repo=a/b", ("2026-07-17 09:00:32.491", "", "TIMING")),
        ("2026-09-02T00:04:33.8570221Z ##[notice]summary edge", ("2026-09-02 00:04:33.857", "INFO", "")),
        ("2026-10-17T18:35:01.6659899Z duct: level of nesting", ("2026-10-17 18:35:01.665", "", "")),
        ('ts=2026-04-05T13:56:13.187Z lvl=warning component=rule-sync msg="engine x"', ("2026-04-05 13:56:13.187", "WARN", "rule-sync")),
        ("Traceback (most recent call last):", None),
        ("KeyError: rule pack", None),
        ("thread 'worker-6' panicked at crates/a/src/lib.rs:366:58:", None),
        ("=== OWASP Metrics Summary ===", None),
        ("engine restarted by x", None),
        ("notice: level of nesting 3 exceeds limit", None),
        ("2026-10-17T18:35:01.6659899Z notice: level of nesting", ("2026-10-17 18:35:01.665", "", "")),
        ("2026-09-02T00:04:33.8570221Z ##[debug]notice: level of nesting", ("2026-09-02 00:04:33.857", "DEBUG", "")),
        ("2026/01/29 18:53:58 WARN v2_reporting: notice: level", ("2026-01-29 18:53:58.000", "WARN", "v2_reporting")),
        ("[Info] notice: level of nesting", ("", "INFO", "")),
        ("}", None),
    ],
)
def test_fronts(line, want):
    assert one(line) == want


def test_pairs():
    assert logs._pairs("x repo=a/b.c, cwe=cwe-79, engine=1.302ms nodes=461") == ("a/b.c", "CWE-79", 1302, 461)
    assert logs._pairs("cwe=643 engine=14µs") == (None, "CWE-643", 14, None)
    assert logs._pairs("engine=2.677232s siblings=7ms")[2] == 2677232
    assert logs._pairs('f(engine="w") subnodes=3 nodes=x engine=37') == (None, None, None, None)


def table(spark, lines, run="r"):
    return spark.createDataFrame([(i, run, i, line, "c") for i, line in enumerate(lines, 1)], SCHEMA)


def test_entries(spark):
    lines = [
        "orphan line",
        "2026-02-11 01:24:58,646 - a.b - ERROR - failed",
        "Traceback (most recent call last):",
        '  File "x.py", line 3, in f',
        "",
        "KeyError: 2026-01-01 00:00:00,000 - x - INFO - no",
        "    engine=1.5ms nodes=7",
        "  | 2026-02-11 01:24:59,000 - a.b - INFO - quoted",
        None,
        '{"ts": 1784278813003, "lvl": "Warn", "target": "v2_cfg", "message": "m", "repo": "o/n", "cwe": "79", "engine": "3µs", "nodes": 5}',
        "{",
        '  "level": "High"',
        "}",
        '{"a": 1}',
        "[Debug] end",
    ]
    rows = {r["first_line"]: r for r in logs.entries(table(spark, lines)).collect()}
    assert sorted((k, r["last_line"]) for k, r in rows.items()) == [(2, 9), (10, 14), (15, 15)]
    assert (rows[2]["component"], rows[2]["engine_us"], rows[2]["nodes"], rows[2]["repo"]) == ("a.b", 1500, 7, "")
    assert tuple(rows[10])[3:] == ("2026-07-17 09:00:13.003", "WARN", "v2_cfg", "o/n", "CWE-79", 3, 5)
    assert rows[15]["logged_at"] == "" and rows[15]["nodes"] == -1


def test_blocks_duplicates_and_order(spark, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK", 4)
    rng = random.Random(2)
    lines = [rng.choice(["[Info] start nodes=1", "continued", "   more"]) for _ in range(60)]
    lines[0] = "[Info] start"
    rows = [(i, "r", i, line, None) for i, line in enumerate(lines, 1)]
    rows += [(1000 + i, "r", i, line, None) for i, line in enumerate(lines, 1) if i % 3 == 0]
    rows += [(5000, None, 1, "[Info] x", None), (5001, "r", None, "[Info] x", None)]
    rng.shuffle(rows)
    starts = [i for i, line in enumerate(lines, 1) if line.startswith("[")]
    want = list(zip(starts, [s - 1 for s in starts[1:]] + [60], strict=True))
    got = logs.entries(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["first_line"], r["last_line"]) for r in got) == want
    assert logs.entries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_merges_similar_lines():
    tree = logs.TemplateTree()
    for i in range(50):
        tree.add(logs.mask(f"[Info] cache entry for item{i} is stale, {i} bytes")[0])
    other = tree.add(logs.mask("[Warn] engine restarted")[0])
    assert sorted(n for _, n in tree.templates()) == [1, 50]
    assert tree.add(logs.mask("[Info] cache entry for other is stale, 7 bytes")[0]) != other
    assert sorted(n for _, n in tree.templates()) == [1, 51]


def test_templates_of_all_partitions(spark):
    lines = [f"[Info] cache entry for item{i} is stale, {i} bytes" for i in range(50)] + ["  indented", "no entry at all", '{"ts": 1, "level": "info"}']
    rows = logs.templates(table(spark, lines).repartition(5)).collect()
    assert [r["lines"] for r in rows] == [50]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("WARN 2026-03-01 10:00:00,123 [pool-1] loader - slow", ("2026-03-01 10:00:00.123", "WARN", "loader")),
        ("WARN | 2026-03-01T10:00:00Z | store.index | slow", ("2026-03-01 10:00:00.000", "WARN", "store.index")),
        ("[2026-03-01 10:00:00] stray", ("2026-03-01 10:00:00.000", "", "")),
        ("2026/03/01 10:00:00 - INFO - store.index - slow", ("2026-03-01 10:00:00.000", "INFO", "store.index")),
    ],
)
def test_layouts_of_no_list(line, want):
    assert one(line) == want


def test_lines_of_like_templates_decide_what_a_tag_is(spark):
    # Behind the tag most lines have a logger: so the odd word there is one, too, and the tag is a thread.
    lines = [f"2026-03-01 10:00:0{i} INFO [worker-{i}] store.Loader{'abcdefgh'[i]} loaded {i}" for i in range(8)] + ["2026-03-01 10:00:09 INFO [worker-9] bootstrap loaded 9"]
    rows = {r["first_line"]: r["component"] for r in logs.entries(table(spark, lines)).collect()}
    assert rows[9] == "bootstrap" and rows[1] == "store.Loadera"
    alone = logs.entries(table(spark, lines[-1:])).collect()
    assert alone[0]["component"] == "worker-9"


def test_times_without_a_year_take_the_year_of_receipt():
    assert [logs._year((2027, 3), 12, 30), logs._year((2026, 365), 1, 1), logs._year((2026, 40), 2, 8), logs._year(None, 5, 5)] == [2026, 2027, 2026, logs.YEAR]


def test_long_line(spark):
    got = logs.entries(table(spark, ["[Info] " + "word " * 200_000 + "nodes=3"])).collect()
    assert len(got) == 1 and got[0]["nodes"] == 3


def test_templates_have_the_whole_of_long_lines(spark):
    # Lines alike in their first 60 words, not behind them; and ones that are longer.
    same = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    ends = ["alpha", "beta"]
    lines = [f"[Info] {same} " + " ".join(f"{end}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)) for end in ends] + [f"[Info] {same} {'more ' * n}" for n in (1, 2, 300)]
    rows = logs.templates(table(spark, lines)).collect()
    assert sorted((r["tokens"], r["lines"]) for r in rows) == [(62, 1), (63, 1), (151, 1), (151, 1), (361, 1)]
    assert all(len(r["template"].split(" ")) == r["tokens"] for r in rows)
    assert sorted(r["template"].split(" ")[-1][:4] for r in rows) == ["alph", "beta", "more", "more", "more"]
    like = [f"[Info] {same} end {w}" for w in ("x", "y")]
    assert [r["template"] for r in logs.templates(table(spark, like)).collect()] == [f"[<LEVEL>] {same} end <*>"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('ts=2026-04-05T13:56:13.187Z a=1 b=2 c=3 d=4 e=5 f=6 g=7 msg="level=info x" lvl=error logger=store.index', ("2026-04-05 13:56:13.187", "ERROR", "store.index")),
        ("ts=2026-04-05T13:56:13.187Z a=1 b=2 c=3 d=4 e=5 f=6 words lvl=error", ("2026-04-05 13:56:13.187", "", "")),
        ("2026-03-01 10:00:00 | host | app | store | INFO | slow | WARN | x", ("2026-03-01 10:00:00.000", "INFO", "store")),
        ("2026-03-01 10:00:00 - host - app - main - store - ERROR - slow - x", ("2026-03-01 10:00:00.000", "ERROR", "store")),
        ("WARN | a | b | c | store | 2026-03-01T10:00:00Z | slow", ("2026-03-01 10:00:00.000", "WARN", "store")),
        ("2026-03-01 10:00:00 INFO [" + "worker " * 30 + "] store.Loader slow", ("2026-03-01 10:00:00.000", "INFO", "store.Loader")),
    ],
)
def test_fields_of_long_fronts(spark, line, want):
    assert one(line) == want
    rows = logs.entries(table(spark, [line])).collect()
    assert [(r["logged_at"], r["log_level"], r["component"]) for r in rows] == [want]


def test_another_tree_where_templates_grow(spark, monkeypatch):
    monkeypatch.setattr(logs, "HELD", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        lines = [f"[{level}] {'word ' * n}end" for n in range(12) for level in ("Info", "Warn")]
        rows = logs.templates(table(spark, lines * 2).coalesce(1)).collect()
        found = logs.entries(table(spark, lines).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["lines"] for r in rows) == 48 and sorted(r["tokens"] for r in rows) == list(range(2, 14))
    assert sorted((r["first_line"], r["log_level"]) for r in found) == [(i, "INFO" if i % 2 else "WARN") for i in range(1, 25)]


def test_rows_are_sent_in_parts(monkeypatch):
    monkeypatch.setattr(logs, "SENT", 10)
    rows = [("x" * n, n) for n in (4, 4, 4, 30, 1)]
    assert list(logs._parts(iter(rows))) == [rows[:3], rows[3:4], rows[4:]]
