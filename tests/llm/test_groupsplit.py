import pytest
from pyspark.sql import functions as F

from loomgraph.llm import groupsplit

H = "entry_id bigint, repo string, commit string, language string, cwe string, component string"
R = "entry_id bigint, repo string, language string, cwe string, node string"
T = "split_name string, target_share double"


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Owner/Name", "owner/name"),
        ("https://codehub.example/owner/name.git", "owner/name"),
        ("http://www.codehub.example/owner/na.me/tree/main", "owner/na.me"),
        ("git@codehub.example:owner/name.git", "owner/name"),
        ("ssh://git@codehub.example:22/owner/name", "owner/name"),
        ("https://mirror.codehub.example/owner/name/", "owner/name"),
        ("codehub.example/owner/name", "owner/name"),
        (" owner/name/\n", "owner/name"),
        ("owner/name/sub/path", "owner/name"),
        ("https://h.example/owner/name?tab=1#x", "owner/name"),
        ("unknown", None),
        ("", None),
        (None, None),
        ("0000/0000", None),
    ],
)
def test_repository(spark, text, name):
    row = spark.createDataFrame([(text,)], "v string").select(groupsplit.repository(F.col("v"))).first()
    assert row[0] == name


def test_found_follows_ties_through_commits_and_short_forms(spark):
    full = "ab12cd34ef56" + "0" * 20 + "12345678"
    holdout = spark.createDataFrame(
        [
            (1, "B/y", full.upper(), "python", "CWE-1", None),
            (2, None, full[:12], "python", "CWE-1", None),
            (3, "a/x", full[:12], "java", None, None),
            (4, "unknown", "0" * 40, None, None, None),
            (5, "", "unknown", None, None, None),
            (6, None, "feedface", None, None, None),
            (7, "https://h.example/c/z", "", None, None, None),
        ],
        H,
    )
    raw = spark.createDataFrame([(10, "C/Z.git", None, None, None), (11, None, None, None, None)], R)
    assert {tuple(r) for r in groupsplit.found(holdout, raw).collect()} == {(1, "a/x"), (2, "a/x"), (3, "a/x"), (7, "c/z"), (10, "c/z")}


def test_assign_keeps_groups_whole_and_meets_shares(spark):
    rows = []
    for i in range(3000):
        group = i % 700 if i % 3 else 0  # a third of all rows in one group
        rows.append((i, f"o/r{group}", None, ["python", "java"][i % 2], f"CWE-{i % 5}", None))
    holdout, raw = spark.createDataFrame(rows, H), spark.createDataFrame([], R)
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.12), ("validation", 0.08)], T)
    got = groupsplit.assign(holdout, raw, targets)
    assert got.count() == 3000 and got.where("split is null").count() == 0
    assert got.select("component", "split").distinct().count() == got.select("component").distinct().count()
    for r in groupsplit.report(holdout, raw, targets).collect():
        assert abs(r["share"] - r["target_share"]) < 0.02


def test_assign_of_empty_tables(spark):
    targets = spark.createDataFrame([("train", 1.0)], T)
    assert groupsplit.assign(spark.createDataFrame([], H), spark.createDataFrame([], R), targets).count() == 0
    with pytest.raises(ValueError):
        groupsplit.assign(spark.createDataFrame([], H), spark.createDataFrame([], R), targets.limit(0))
