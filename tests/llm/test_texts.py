import duckdb
import pytest

from loomgraph.llm import leakage, lookalikes, mixing

DOCS = "doc_id bigint, text string, source string, form string"


def form(text):
    con = duckdb.connect()
    return con.execute(f"SELECT {lookalikes.expression('t')} FROM (SELECT ?::VARCHAR AS t)", [text]).fetchall()[0][0]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｃache １", "Cache 1", True),
        ("ﬁle oﬀ", "file off", True),
        ("cafe\u0301", "café", True),
        ("na\u200bme\ufeff", "name", True),
        ("a\u00a0b\u2009c", "a b c", True),
        ("non\u2011break\u2010er", "non-break-er", True),
        ("Ве\u0441t", "Bect", True),
        ("\u0451lka", "ëlka", True),
        ("\u0435\u0308lka", "ëlka", True),
        ("e\u200b\u0301x", "éx", True),
        ("cafe", "café", False),
        ("Cache", "cache", False),
        ("a1", "al", False),
        ("a b", "a  b", False),
        ("10\u00b2", "102", False),
        ("", "", True),
        ("Уαυρικ", "Yaupik", True),
        ("5 − 3 ⁃ x", "5 - 3 - x", True),
        ("ｶﾞ", "ガ", True),
        ("𝐀𝓪", "Aa", True),
        ("Ⅻ", "XII", True),
        ("ᎪᏞ", "GL", False),
        ("Ꭺ", "A", True),
        ("①", "1", False),
        ("№ 5", "No 5", False),
        ("½", "1/2", False),
        ("a—b", "a-b", False),
    ],
)
def test_consistent_form(a, b, same):
    assert (form(a) == form(b)) is same


def test_found_pairs_and_copies(spark):
    rows = [(1, "cache one", "x", None), (2, "\u0441ache one", None, None), (3, "cache one", None, None), (4, None, None, None), (5, "", None, None), (6, "Cache one", None, None), (7, "cache\u00a0one", None, None), (8, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {tuple(r) for r in lookalikes.found(docs).collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    texts = {r["doc_id"]: r["text"] for r in lookalikes.consistent(docs).collect()}
    assert texts[2] == texts[7] == "cache one" and texts[4] is None and texts[5] == "" and len(texts) == 8
    assert lookalikes.found(docs.limit(0)).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def test_contains_fourteen_words(spark):
    words = ITEM.split()
    rows = [
        (1, "x " + " ".join(words[:14]) + " y", None, None),
        (2, "x " + " ".join(words[:13]) + " y", None, None),
        (3, "ＯＮＥ, tw\u043e; THREE -- four/five (six) séven eight\u00a0nine ten el\u200beven twelve thirteen... fourteen!", None, None),
        (4, None, None, None),
        (5, "", None, None),
        (6, ("filler words here " * 3000) + " ".join(words[2:]) + " tail", None, None),
        (7, " ".join(words[:7]) + " gap " + " ".join(words[7:]), None, None),
        (8, "one_two_three four five six seven eight nine ten eleven twelve thirteen fourteen", None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(20, ITEM, "t"), (21, "too short", "t"), (22, None, "t"), (23, "", "t")], "item_id bigint, text string, doc_id string")
    want = {(1, 20), (3, 20), (6, 20), (8, 20)}
    assert {tuple(r) for r in leakage.found(docs, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in leakage.contains(docs, items, most=1).collect()} == want
    report = {r["item_id"]: (r["documents"], r["most"]) for r in leakage.report(docs, items).collect()}
    assert report[20][0] == 4 and report[20][1] == 0.333333 and report[21] == (0, 0.0)
    assert leakage.found(docs.limit(0), items).count() == 0 and leakage.found(docs, items.limit(0)).count() == 0


def test_mix_meets_shares_and_repeats(spark):
    rows = [(i, "word " * (5 + i % 40), "big", None) for i in range(2000)] + [(5000 + i, "term " * 30, "small", None) for i in range(60)] + [(9000, None, "big", None), (9001, "", None, None), (9002, "x y z", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats bigint")
    drawn = mixing.mix(docs, targets).collect()
    assert all(r["repeats"] <= (1 if r["source"] == "big" else 3) for r in drawn) and len({r["doc_id"] for r in drawn}) == len(drawn)
    shares = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert abs(shares["big"]["share"] - 0.7 / 0.9) < 0.01 and abs(shares["small"]["share"] - 0.2 / 0.9) < 0.01 and shares["absent"]["tokens"] == 0
    # Whole epochs precede the fraction: repeats of a source differ by one at most.
    small = {r["repeats"] for r in drawn if r["source"] == "small"}
    assert max(small) - min(small) <= 1
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_budgets():
    assert mixing.budgets([("a", 100), ("b", 10)], [("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.2, 1)]) == {"a": (40.0, 1), "b": (40.0, 4)}
    assert mixing.budgets([("a", 100)], [("a", 1.0, 2)], 500.0) == {"a": (200.0, 2)}
    assert mixing.budgets([], [("a", 1.0, 2)]) == {}


def test_russian_texts_keep_their_alphabet(spark):
    russian = "Привет, а о сор у Ёлки в лесу: run scan"
    mixed = "Пpивeт, a o cop y Ëлки в лecy: run scan"
    docs = spark.createDataFrame([(1, russian, None, None), (2, mixed, None, None), (3, "сор cop", None, None), (4, "cop сор", None, None)], DOCS)
    texts = {r["doc_id"]: r["text"] for r in lookalikes.consistent(docs).collect()}
    assert texts[1] == texts[2] == russian and texts[3] == texts[4] == "cop cop"


def test_forms_are_stable():
    sql = f"WITH one AS (SELECT i, {lookalikes.expression('c')} AS c FROM (SELECT i, chr(i::INT) AS c FROM range(160, 55000) t(i))) SELECT i FROM (SELECT i, c, {lookalikes.expression('c')} AS again FROM one) WHERE c <> again"
    assert [hex(i) for (i,) in duckdb.sql(sql).fetchall()] == []
