"""Splits that keep related rows together, by grouped iterative stratification.

Rows that name one repository or one commit are tied; components of ties are
groups.  Each group has a label vector (its rows by language and weakness).
The label with the fewest outstanding rows is taken first, again and again as
placing groups changes what is outstanding; its groups go to the splits that
still need most of it.

Groups of at least 1 / HEAVY of all rows, of which there are at most HEAVY, are
placed one by one.  The others are placed a label at a time: the need of each
split for the label gives its share of those groups, and groups are cut at the
shares' running sums, so no list of groups is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import connected_components
from ..session import checkpointed

HEAVY = 500
#: Rows of small groups to a cell of the running sums, and the fewest cells.
_CELL_ROWS = 50_000
_CELLS = 64
#: No commit is longer (SHA-256).
_COMMIT = 64


_BLANKS = r"[\s\p{Z}​﻿]+"
#: URL or ssh form, scp form, or a bare host in front; then owner, name, `.git`, and a sub-path, query or anchor.
_REPOSITORY = (
    r"^(?:[a-z][a-z0-9+.-]*://(?:[^/@]*@)?[^/]*/+|[^/@:]*@[^/:]+:/*(?:\d+/)?|/*(?:[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+)?/+(?=[^/]+/+(?!(?:tree|blob|commit|src|issues|pull)(?:/|$))[^/]+))?)"
    r"([^/:@?#]+)/+([^/?#]+?)(?:\.git)?(?:[/?#].*)?$"
)


def repository(value: Column) -> Column:
    """`owner/name` in lower case of a repository in any spelling, null where none is named."""
    text = F.lower(F.regexp_replace(value, _BLANKS, ""))
    return F.when(text.rlike(_REPOSITORY) & ~text.rlike("^[0/]+$"), F.regexp_replace(text, _REPOSITORY, "$1/$2"))


def commit_key(value: Column) -> Column:
    """A commit in lower case, null for empty values, `unknown` and zeros."""
    text = F.lower(F.regexp_replace(value, _BLANKS, ""))
    return F.when((text != "") & (text != "unknown") & ~text.rlike("^0+$"), text)


def _rows(holdout: DataFrame, raw: DataFrame) -> DataFrame:
    # Labels are few: a language's first two letters, which its spellings share, and the number of a weakness.
    label = F.concat_ws("|", F.substring(F.lower(F.trim(F.col("language"))), 1, 2), F.regexp_extract(F.upper(F.col("cwe")), "0*([0-9]{1,4})(?![0-9])", 1))
    commit = F.col("commit") if "commit" in raw.columns else F.lit(None).cast("string")
    one = holdout.select("entry_id", repository(F.col("repo")).alias("repo"), commit_key(F.col("commit")).alias("commit"), label.alias("label"))
    two = raw.select("entry_id", repository(F.col("repo")).alias("repo"), commit_key(commit).alias("commit"), label.alias("label"))
    return one.unionByName(two).where("entry_id is not null")


def _groups(rows: DataFrame) -> DataFrame:
    """`rows` with `component`: the group's least node, `a:owner/name` before `c:commit` before `e:` and the row's own id."""
    ties = checkpointed(rows.select(F.concat(F.lit("a:"), "repo").alias("repo"), F.concat(F.lit("c:"), "commit").alias("commit")).where("repo is not null or commit is not null").distinct())
    commits = ties.select("commit").where("commit is not null").distinct()
    full = commits.withColumn("size", F.length("commit"))
    # A short form means the full commit it begins: equi-joins on prefixes of the lengths that occur, of which there are at most sixty-three.
    lengths = sorted(r["size"] for r in full.where(F.col("size") < _COMMIT).groupBy("size").count().collect())
    edges = ties.select(F.coalesce("repo", "commit").alias("src"), F.coalesce("commit", "repo").alias("dst"))
    if lengths:
        prefixes = full.select("commit", "size", F.explode(F.array(*(F.lit(x) for x in lengths))).alias("cut")).where("cut < size").select("commit", F.substring("commit", F.lit(1), F.col("cut")).alias("short"))
        edges = edges.unionByName(prefixes.join(commits.select(F.col("commit").alias("short")), "short").select(F.col("commit").alias("src"), F.col("short").alias("dst")))
    parts = connected_components(edges)
    node = F.coalesce(F.concat(F.lit("a:"), "repo"), F.concat(F.lit("c:"), "commit"))
    tied = rows.withColumn("node", node).join(parts, "node", "left")
    return tied.withColumn("component", F.coalesce("component", F.concat(F.lit("e:"), F.col("entry_id").cast("string")))).drop("node")


def found(holdout: DataFrame, raw: DataFrame) -> DataFrame:
    """(entry_id, group_repo) of each row whose group names a repository."""
    grouped = _groups(_rows(holdout, raw))
    return grouped.where(F.col("component").startswith("a:")).select("entry_id", F.expr("substring(component, 3)").alias("group_repo"))


def _place(weights: dict[str, float], shares: dict[str, float], classes: list[tuple[str, dict[str, float]]], heavy: list[tuple[str, dict[str, float]]]) -> tuple[dict[str, str], dict[str, dict[str, float]]]:
    """Splits of the heavy groups, and each label class's share for each split.

    Outstanding needs are rows of each label and of all labels wanted by each split.
    """
    need = {s: {label: share * total for label, total in weights.items()} | {None: share * sum(weights.values())} for s, share in shares.items()}

    def take(split: str, vector: dict[str, float], part: float = 1.0) -> None:
        for label, n in vector.items():
            need[split][label] -= n * part
            need[split][None] -= n * part

    placed: dict[str, str] = {}
    cut: dict[str, dict[str, float]] = {}
    totals = dict(classes)
    waiting = dict(heavy)
    outstanding = dict(weights)
    while outstanding:
        label = min(outstanding, key=lambda x: (outstanding[x], x))
        # Single groups, those with most of the label first.
        for group in sorted((g for g, v in waiting.items() if label in v), key=lambda g: (-waiting[g][label], g)):
            vector = waiting.pop(group)
            size = sum(vector.values())
            placed[group] = max(shares, key=lambda s: (need[s][None] >= size, need[s][label], need[s][None], s))
            take(placed[group], vector)
            for x, n in vector.items():
                if x in outstanding:
                    outstanding[x] -= n
        if label in totals:
            left = {s: max(need[s][label], 0.0) + 1e-9 * shares[s] for s in shares}
            room = {s: max(need[s][None], 0.0) + 1e-9 * shares[s] for s in shares}
            # What a split needs of the label, within what it needs at all.
            wish = {s: min(left[s], room[s]) for s in shares}
            whole = sum(wish.values())
            cut[label] = {s: wish[s] / whole for s in shares}
            for s in shares:
                take(s, totals[label], cut[label][s])
            for x, n in totals[label].items():
                if x in outstanding:
                    outstanding[x] -= n
        del outstanding[label]
    return placed, cut


def assign(holdout: DataFrame, raw: DataFrame, targets: DataFrame) -> DataFrame:
    """(entry_id, component, label, split): the split of every row, one for a whole group.

    `targets` has split_name and target_share; shares are scaled to a sum of one.
    """
    shares = {r["split_name"]: float(r["target_share"]) for r in targets.where("split_name is not null and target_share > 0").collect()}
    if not shares:
        raise ValueError("no split with a positive share")
    whole = sum(shares.values())
    shares = {s: x / whole for s, x in sorted(shares.items())}
    rows = checkpointed(_groups(_rows(holdout, raw)).select("entry_id", "component", "label"))
    vectors = checkpointed(rows.groupBy("component", "label").count())
    weights = {r["label"]: float(r["count"]) for r in vectors.groupBy("label").agg(F.sum("count").alias("count")).collect()}
    ranks = sorted(weights, key=lambda label: (weights[label], label))
    order = holdout.sparkSession.createDataFrame([(label, i) for i, label in enumerate(ranks)], "label string, rank int") if ranks else None
    if order is None:
        return rows.select("entry_id", "component", "label", F.lit(None).cast("string").alias("split"))
    groups = vectors.join(F.broadcast(order), "label").groupBy("component").agg(F.sum("count").alias("size"), F.min("rank").alias("rank"))
    least = max(sum(weights.values()) / HEAVY, 2)
    groups = checkpointed(groups.withColumn("heavy", F.col("size") >= least))
    heavy: dict[str, dict[str, float]] = {}
    for r in vectors.join(F.broadcast(groups.where("heavy").select("component")), "component").collect():
        heavy.setdefault(r["component"], {})[r["label"]] = float(r["count"])
    classes: dict[str, dict[str, float]] = {}
    light = groups.where("not heavy")
    for r in vectors.join(light, "component").groupBy("rank", "label").agg(F.sum("count").alias("n")).collect():
        classes.setdefault(ranks[r["rank"]], {})[r["label"]] = float(r["n"])
    placed, cut = _place(weights, shares, sorted(classes.items()), sorted(heavy.items()))
    spark = holdout.sparkSession
    heavy_rows = spark.createDataFrame(list(placed.items()) or [("", "")], "component string, split string")
    bounds = []
    for i, label in enumerate(ranks):
        at = 0.0
        for split in shares:
            share = cut.get(label, {}).get(split, 0.0)
            bounds.append((i, split, at, at + share))
            at += share
    bounds = spark.createDataFrame(bounds, "rank int, split string, low double, high double")
    # Running sums in two steps: over cells of a hash, then inside a cell; no class is sorted in one task.
    cell = (F.pmod(F.xxhash64("component"), F.lit(max(_CELLS, int(sum(weights.values()) / _CELL_ROWS))))).alias("cell")
    light = light.select("component", "size", "rank", cell)
    cells = light.groupBy("rank", "cell").agg(F.sum("size").alias("in_cell"))
    before = cells.select("rank", "cell", (F.sum("in_cell").over(Window.partitionBy("rank").orderBy("cell")) - F.col("in_cell")).alias("before"), F.sum("in_cell").over(Window.partitionBy("rank")).alias("of"))
    within = F.sum("size").over(Window.partitionBy("rank", "cell").orderBy(F.desc("size"), "component"))
    at = (F.col("before") + F.col("upto") - F.col("size") / 2) / F.col("of")
    spread = light.withColumn("upto", within).join(F.broadcast(before), ["rank", "cell"]).withColumn("at", at)
    light_split = spread.join(F.broadcast(bounds), "rank").where("at >= low and at < high").select("component", "split")
    splits = light_split.unionByName(heavy_rows.where("component != ''"))
    last = max(shares, key=lambda s: shares[s])
    return rows.join(splits, "component", "left").select("entry_id", "component", "label", F.coalesce("split", F.lit(last)).alias("split"))


def report(holdout: DataFrame, raw: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: rows, groups, share reached and share wanted."""
    rows = assign(holdout, raw, targets)
    total = F.sum("rows").over(Window.partitionBy())
    reached = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("component").alias("groups"))
    return reached.join(targets.select(F.col("split_name").alias("split"), "target_share"), "split").select("split", "rows", "groups", F.round(F.col("rows") / total, 6).alias("share"), "target_share")


_SQL_REPO = r"""CASE WHEN len(p) >= 2 AND p[1] <> '' AND p[2] <> '' THEN p[1] || '/' || regexp_replace(regexp_replace(p[2], '[?#].*$', ''), '\.git$', '') END"""
_SQL_PARTS = r"""string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(repo, '[\s\p{Z}]+', '', 'g')), '^[a-z][a-z0-9+.-]*://([^/@]*@)?[^/]*/+', ''), '^[^/@:]*@[^/:]+:/*', ''), '/'), '/')"""
#: The same by a transitive closure, for small tables; hosts without a scheme aren't told apart.
FOUND_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT entry_id, {_SQL_REPO} AS repo, CASE WHEN c NOT IN ('', 'unknown') AND NOT regexp_matches(c, '^0+$') THEN c END AS sha
  FROM (SELECT entry_id, {_SQL_PARTS} AS p, lower(trim("commit")) AS c FROM holdout UNION ALL SELECT entry_id, {_SQL_PARTS}, NULL FROM raw_entries)),
ties AS (SELECT DISTINCT 'a:' || repo AS x, 'c:' || sha AS y FROM keyed WHERE repo IS NOT NULL AND sha IS NOT NULL
  UNION SELECT 'c:' || f.sha, 'c:' || s.sha FROM (SELECT DISTINCT sha FROM keyed) f JOIN (SELECT DISTINCT sha FROM keyed) s ON starts_with(f.sha, s.sha) AND f.sha <> s.sha),
both_ways AS (SELECT x, y FROM ties UNION SELECT y, x FROM ties),
reach AS (SELECT DISTINCT unnest(['a:' || repo, 'c:' || sha]) AS n, unnest(['a:' || repo, 'c:' || sha]) AS m FROM keyed UNION SELECT r.n, b.y FROM reach r JOIN both_ways b ON r.m = b.x),
named AS (SELECT n, min(m) AS least FROM reach WHERE m LIKE 'a:%' GROUP BY n)
SELECT entry_id, substr(least, 3) AS group_repo FROM keyed JOIN named ON n = coalesce('a:' || repo, 'c:' || sha)
"""
