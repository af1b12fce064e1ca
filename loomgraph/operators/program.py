"""Control flow and calls as relations over the instruction table (file_id, method, pos, kind, dest, callee, args, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .graph import connected_components

__all__ = ["ancestors", "blocks", "call_edges", "cfg_edges", "connected_components", "descendants", "icfg_edges", "leaders", "merged", "resolved_calls", "tiered"]

ENDS = ("Branch", "Jump", "Return")


def _order(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("pos")


def leaders(code: DataFrame, by: tuple[str, ...] = ("file_id", "method"), ends: tuple[str, ...] = ENDS, starts: tuple[str, ...] = ("Label",)) -> DataFrame:
    """The instructions with `leader`: the first of a method, those behind an ending kind, and those of a starting kind."""
    before = F.lag("kind").over(_order(*by))
    return code.withColumn("leader", before.isNull() | before.isin(*ends) | F.col("kind").isin(*starts))


def blocks(code: DataFrame, by: tuple[str, ...] = ("file_id", "method"), ends: tuple[str, ...] = ENDS, starts: tuple[str, ...] = ("Label",)) -> DataFrame:
    """The instructions with the number of their basic block, from 1."""
    run = _order(*by).rowsBetween(Window.unboundedPreceding, 0)
    return leaders(code, by, ends, starts).withColumn("block", F.sum(F.col("leader").cast("int")).over(run))


def cfg_edges(code: DataFrame) -> DataFrame:
    """(file_id, method, src, dst, kind) between the blocks of each method; a method's end is block -1.

    A jump to a block at or ahead of its own is a LoopBack.
    """
    placed = blocks(code)
    last = F.row_number().over(Window.partitionBy("file_id", "method", "block").orderBy(F.desc("pos"))) == 1
    ends = placed.withColumn("last", last).where("last").withColumn("after", F.lead("block").over(Window.partitionBy("file_id", "method").orderBy("block")))
    labels = placed.where("kind = 'Label'").select("file_id", "method", "label", F.col("block").alias("target"))
    jumps = ends.where("kind in ('Branch', 'Jump')").join(labels, ["file_id", "method", "label"])
    loop = F.col("target") <= F.col("block")
    jumped = jumps.select("file_id", "method", F.col("block").alias("src"), F.col("target").alias("dst"), F.when(F.col("kind") == "Branch", "BranchTrue").when(loop, "LoopBack").otherwise("Unconditional").alias("kind"))
    rest = ends.where("kind not in ('Jump', 'Return')").select("file_id", "method", F.col("block").alias("src"), F.coalesce("after", F.lit(-1)).alias("dst"), F.when(F.col("kind") == "Branch", "BranchFalse").otherwise("Fallthrough").alias("kind"))
    returns = ends.where("kind = 'Return'").select("file_id", "method", F.col("block").alias("src"), F.lit(-1).alias("dst"), F.lit("Unconditional").alias("kind"))
    return jumped.unionByName(rest).unionByName(returns)


def node(kind: str, *parts: Column) -> Column:
    """A node of the interprocedural graph: `I` instructions, `E` entries, `X` exits."""
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def call_edges(code: DataFrame, methods: DataFrame) -> DataFrame:
    """(file_id, method, pos, callee_method, tier): each call with the methods it may reach.

    Tiers: a method or constructor of exactly that name, then any method whose last
    name is the call's last name; the first tier with a hit is taken.
    """
    sites = code.where("kind in ('Call', 'Alloc')").select("file_id", "method", "pos", "callee")
    known = methods.select("file_id", F.col("method").alias("target"), F.element_at(F.split("method", r"\."), -1).alias("last")).distinct()
    named = sites.withColumn("target", F.explode(F.array("callee", F.concat("callee", F.lit(".__init__")))))
    exact = named.join(known, ["file_id", "target"]).select("file_id", "method", "pos", F.col("target").alias("callee_method"), F.lit(1).alias("tier"))
    by_name = sites.withColumn("last", F.element_at(F.split("callee", r"\."), -1)).join(known, ["file_id", "last"]).select("file_id", "method", "pos", F.col("target").alias("callee_method"), F.lit(2).alias("tier"))
    return tiered(exact.unionByName(by_name), ["file_id", "method", "pos"])


def tiered(candidates: DataFrame, keys: list[str], tier: str = "tier") -> DataFrame:
    """The candidates of the least tier of each key."""
    return candidates.withColumn("_best", F.min(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("_best")).drop("_best")


resolved_calls = call_edges


def icfg_edges(code: DataFrame, methods: DataFrame) -> DataFrame:
    """(file_id, src, dst, kind) of the interprocedural graph: inside blocks, between blocks, calls, returns and past calls."""
    placed = blocks(code).withColumn("after", F.lead("pos").over(Window.partitionBy("file_id", "method", "block").orderBy("pos")))
    inst = lambda pos: node("I", F.col("method"), F.col(pos))
    inside = placed.where("after is not null").select("file_id", inst("pos").alias("src"), inst("after").alias("dst"), F.lit("Normal").alias("kind"))
    bounds = placed.groupBy("file_id", "method", "block").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    edges = cfg_edges(code)
    to_block = edges.join(bounds.select("file_id", "method", F.col("block").alias("src"), F.col("last").alias("from_pos")), ["file_id", "method", "src"]).join(bounds.select("file_id", "method", F.col("block").alias("dst"), F.col("first").alias("to_pos")), ["file_id", "method", "dst"], "left")
    between = to_block.select("file_id", inst("from_pos").alias("src"), F.when(F.col("dst") == -1, node("X", F.col("method"))).otherwise(inst("to_pos")).alias("dst"), F.lit("Normal").alias("kind"))
    entries = code.where("pos = 0").select("file_id", node("E", F.col("method")).alias("src"), inst("pos").alias("dst"), F.lit("Normal").alias("kind"))
    follow = code.withColumn("after", F.lead("pos").over(_order("file_id", "method"))).where("kind in ('Call', 'Alloc')")
    site = F.when(F.col("after").isNull(), node("X", F.col("method"))).otherwise(inst("after"))
    past = follow.select("file_id", inst("pos").alias("src"), site.alias("dst"), F.lit("CallToReturn").alias("kind"))
    targets = call_edges(code, methods).join(follow.select("file_id", "method", "pos", "after"), ["file_id", "method", "pos"])
    called = targets.select("file_id", inst("pos").alias("src"), node("E", F.col("callee_method")).alias("dst"), F.lit("Call").alias("kind"))
    back = targets.select("file_id", node("X", F.col("callee_method")).alias("src"), site.alias("dst"), F.lit("Return").alias("kind"))
    return inside.unionByName(between).unionByName(entries).unionByName(past).unionByName(called).unionByName(back)


def merged(programs: DataFrame, key: str, *foreign: str) -> DataFrame:
    """Rows of several programs (program_id, key, foreign keys) with keys numbered anew over all: the program's offset and the rank inside it."""
    inside = programs.withColumn("_rank", F.dense_rank().over(Window.partitionBy("program_id").orderBy(key)))
    sizes = inside.groupBy("program_id").agg(F.max("_rank").alias("n"))
    # Running sums in two steps: over the partitions of a range-ordered table, then inside each.
    ranged = checkpointed(sizes.repartitionByRange("program_id").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    ahead = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("program_id"))
    offset = ranged.withColumn("upto", upto).join(F.broadcast(ahead), "part").select("program_id", (F.col("ahead") + F.col("upto") - F.col("n")).alias("_offset"))
    out = inside.join(offset, "program_id").withColumn("_new", F.col("_rank") + F.col("_offset"))
    names = out.select("program_id", F.col(key).alias("_old"), F.col("_new").alias("_to")).distinct()
    for column in foreign:
        out = out.join(names.withColumnRenamed("_old", column).withColumnRenamed("_to", f"_{column}"), ["program_id", column], "left").drop(column).withColumnRenamed(f"_{column}", column)
    return out.drop(key, "_rank", "_offset").withColumnRenamed("_new", key)


# Hierarchies.


def ancestors(parents: DataFrame, child: str = "child", parent: str = "parent", most: int = 100) -> DataFrame:
    """(node, ancestor, depth) along a child-parent table, nearest depth first kept; cycles end by the nodes already seen."""
    step = parents.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null and p is not null").distinct()
    total = step.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.lit(1).alias("depth"))
    fresh = total
    for _ in range(most):
        onward = fresh.join(step, F.col("ancestor") == F.col("c")).select("node", F.col("p").alias("ancestor"), (F.col("depth") + 1).alias("depth")).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        fresh = checkpointed(onward.join(total, ["node", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            return total
        total = checkpointed(total.unionByName(fresh))
    raise RuntimeError(f"a hierarchy deeper than {most}")


def descendants(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, descendant, depth): the transitive closure downwards."""
    return ancestors(parents, child, parent).select(F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def inherited(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(type, name, owner): the nearest definition of each method name up a type's hierarchy, the type's own first; ties by name."""
    up = ancestors(parents).select(F.col("node").alias("type"), "ancestor", "depth")
    own = methods.select("type", F.col("type").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    every = own.unionByName(up).join(methods.select(F.col("type").alias("ancestor"), "name"), "ancestor")
    rank = F.row_number().over(Window.partitionBy("type", "name").orderBy("depth", "ancestor"))
    return every.withColumn("rank", rank).where("rank = 1").select("type", "name", F.col("ancestor").alias("owner"))


def bound_arguments(sites: DataFrame, parameters: DataFrame) -> DataFrame:
    """(site, target, name, value): arguments bound to parameters by position; extra arguments in front are taken for the receiver."""
    args = sites.select("site", "target", F.size("args").alias("n_args"), F.posexplode("args").alias("pos", "value"))
    counts = parameters.groupBy("target").agg(F.count(F.lit(1)).alias("n_params"))
    offset = F.when(F.col("n_args") > F.col("n_params"), F.col("n_args") - F.col("n_params")).otherwise(0)
    placed = args.join(counts, "target").withColumn("pos", F.col("pos") - offset)
    return placed.join(parameters, ["target", "pos"]).select("site", "target", "name", "value")
