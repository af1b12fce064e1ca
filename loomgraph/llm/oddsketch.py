"""Groups of near-duplicate codes, by keys of prefix filtering and odd sketches.

The runs of three tokens of a code are ordered by how often they occur in the whole
corpus (a count table of fixed size) and then by hash, rarest first.  A code gives its
least (1 - threshold) n + 1 runs as keys: two codes of the threshold's similarity
share one of those at least, however large the corpus or their family.  A run that no
other code can have, by a bitmap of fixed size, is not sent.  A common run that is the
i-th of one code's n leaves n - i runs to share at most; pairs whose ranks leave too
few are no candidates.  Each set is folded into a parity bitmap, the odd sketch; two
of them differ in no more bits than the sets in runs, so that pairs which differ in
too many are dropped without loss.  The rest are compared exactly.

The codes of a key that more than BUCKET have aren't paired at first: those with many
such keys are compared with the key's first.  Then all its codes that aren't yet
connected are paired, so that no link between groups is lost and a large group of
similar codes costs few pairs a code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import checkpointed, parallel
from . import shingles
from .frequency import BITS, count_table, kept, most
from .frequency import members as in_use

THRESHOLD = 0.6
#: More codes with one key are paired by groups, and a code with CROWD such keys is compared with their first.
BUCKET = 1000
CROWD = 12
PARITY_BITS = 512

_WORDS = [f"o{i}" for i in range(PARITY_BITS // 64)]


def parity(samples: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Odd sketches of rows of MinHash samples: each sample flips one bit."""
    n, k = samples.shape
    at = (shingles.mix(samples + np.arange(k, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((at + (np.arange(n) * bits)[:, None]).ravel(), minlength=n * bits).reshape(n, bits)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, owner, rows that have runs, number of runs, identity) of the codes of a batch."""
    sets, owner = shingles.run_sets(part.column("code"))
    present, owner = np.unique(owner, return_inverse=True)
    n = np.bincount(owner, minlength=len(present))
    sig = shingles.mix(np.add.reduceat(shingles.mix(sets), np.cumsum(n) - n) + n.astype(np.uint64)) if len(sets) else sets
    return sets, owner, present, n, sig


def _prefix(sets: np.ndarray, owner: np.ndarray, n: np.ndarray, grades: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, rank) of the rarest (1 - threshold) n + 1 runs of each set but those of no other; a key's top byte is the run's graded count."""
    cell = (sets >> np.uint64(64 - BITS)).astype(np.int64)
    key, owner = shingles.distinct((grades[cell].astype(np.uint64) << np.uint64(56)) | (shingles.mix(sets) >> np.uint64(8)), owner)
    rank = np.arange(len(key)) - np.searchsorted(owner, owner)
    prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
    first = (rank < prefix[owner]) & (key >= np.uint64(2 << 56))
    return key[first], owner[first], rank[first]


def _frequent(key: np.ndarray, bucket: int) -> np.ndarray:
    """Whether more than `bucket` codes may have a key."""
    return most((key >> np.uint64(56)).astype(np.uint8)) > bucket


def sketches(codes: DataFrame, table: Broadcast, threshold: float, bucket: int) -> DataFrame:
    """Each code's set identity `sig`, number of runs `n`, number of keys that more than `bucket` codes may have, and odd sketch; other columns than `code` are kept.

    Codes of fewer than three tokens have no run, resemble nothing, and give no row.
    """
    keep = [c for c in codes.columns if c != "code"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.select(keep).schema)

    def run(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "code"):
                sets, owner, present, n, sig = _sets(part)
                if not len(sets):
                    continue
                key, of, _ = _prefix(sets, owner, n, table.value, threshold)
                frequent = np.bincount(of[_frequent(key, bucket)], minlength=len(n))
                odd = shingles.parity_words(sets, owner, len(n), PARITY_BITS)
                rows = part.take(pa.array(present))
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(sig.view(np.int64)), pa.array(n, pa.int32()), pa.array(frequent, pa.int32()), *(pa.array(odd[:, i]) for i in range(odd.shape[1]))], [*keep, "sig", "n", "frequent", *_WORDS])

    return codes.mapInArrow(run, f"{kept}, sig bigint, n int, frequent int, " + ", ".join(f"{w} bigint" for w in _WORDS))


def keys(codes: DataFrame, table: Broadcast, threshold: float, bucket: int, frequent: bool) -> DataFrame:
    """(key, sig, n, rest): the keys of every code that more than `bucket` codes may have, or those that fewer have; `rest` is the number of runs from the key on.

    A set that occurs again in a task is not sent again.
    """

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for part in shingles.pieces(batch, "code"):
                sets, owner, _, n, sig = _sets(part)
                if not len(sets):
                    continue
                fresh = np.zeros(len(n), bool)
                for i, s in enumerate(sig.tolist()):
                    if s not in sent:
                        sent.add(s)
                        fresh[i] = True
                key, owner, rank = _prefix(sets, owner, n, table.value, threshold)
                wanted = (_frequent(key, bucket) == frequent) & fresh[owner]
                key, owner, rank = key[wanted], owner[wanted], rank[wanted]
                yield pa.RecordBatch.from_arrays([pa.array((shingles.mix(key) >> np.uint64(24)).view(np.int64)), pa.array(sig[owner].view(np.int64)), pa.array(n[owner], pa.int32()), pa.array(n[owner] - rank, pa.int32())], ["key", "sig", "n", "rest"])

    return codes.mapInArrow(run, "key bigint, sig bigint, n int, rest int")


def may_reach(left: str, right: str, sizes: Column, threshold: float) -> Column:
    """Whether two sets of `sizes` runs in all may be similar: those that are differ in few runs, and their odd sketches in no more bits."""
    differ = F.lit(0)
    for w in _WORDS:
        differ = differ + F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}")))
    return differ <= sizes * ((1 - threshold) / (1 + threshold)) + 1e-9


def _compared(pairs: DataFrame, sets: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """(left, right, similarity) of those pairs of identities that are similar: sieved by sketch, then compared exactly."""
    look = sets.select("sig", "n", F.struct(*_WORDS).alias("w"), "place")
    sieved = checkpointed(
        pairs.join(look.select(F.col("sig").alias("left"), F.col("n").alias("ln"), F.col("w").alias("lw"), F.col("place").alias("lp")), "left")
        .join(look.select(F.col("sig").alias("right"), F.col("n").alias("rn"), F.col("w").alias("rw"), F.col("place").alias("rp")), "right")
        .where((F.least("ln", "rn") >= F.greatest("ln", "rn") * threshold - 1e-9) & may_reach("lw", "rw", F.col("ln") + F.col("rn"), threshold))
        .select("left", "right", "lp", "rp")
    )
    # Texts of candidates are picked out where they lie; only they are shuffled.
    needed = in_use(sieved.select(F.col("lp").alias("place")).union(sieved.select("rp")), "place")
    texts = checkpointed(kept(codes.select(F.col("code_id").alias("place"), "code"), "place", needed))
    both = sieved.join(texts.select(F.col("place").alias("lp"), F.col("code").alias("left_code")), "lp").join(texts.select(F.col("place").alias("rp"), F.col("code").alias("right_code")), "rp").select("left", "right", "left_code", "right_code")

    def run(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "left_code", 1 << 19):
                similarity = shingles.pair_similarity(part.column("left_code"), part.column("right_code"))
                near = np.flatnonzero(similarity >= threshold - 1e-12)
                rows = part.take(pa.array(near))
                yield pa.RecordBatch.from_arrays([rows.column("left"), rows.column("right"), pa.array(similarity[near])], ["left", "right", "similarity"])

    return both.mapInArrow(run, "left bigint, right bigint, similarity double")


def links(codes: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(links between identities that hold the groups together, members (code_id, sig)).

    `codes` has code_id and code.  Codes with equal sets of runs are one identity.
    Rows without an id or a code take no part.
    """
    codes = codes.select("code_id", "code").where("code_id is not null and code is not null and code != ''")
    table = count_table(parallel(codes), "code")
    marked = checkpointed(sketches(parallel(codes), table, threshold, bucket))
    members = marked.select("code_id", "sig")
    sets = checkpointed(marked.groupBy("sig").agg(F.first("n").alias("n"), *(F.first(w).alias(w) for w in _WORDS), F.min("code_id").alias("place")))

    def side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.select("key", *columns, F.col("sig").alias(name), F.col("n").alias(f"{name}_n"), F.col("rest").alias(f"{name}_rest"))

    # The runs from the first common one on are all that a pair can share.
    enough = F.least("x_rest", "y_rest") >= (F.col("x_n") + F.col("y_n")) * (threshold / (1 + threshold)) - 1e-9
    pair = (F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))

    def paired(rows: DataFrame) -> DataFrame:
        return side(rows, "x").hint("merge").join(side(rows, "y"), "key").where((F.col("x") < F.col("y")) & enough).select(*pair)

    # Both sides of the join are one shuffle.
    pairs = paired(keys(parallel(codes), table, threshold, bucket, False))
    crowds = marked.where("frequent > 0").select("code_id")
    if crowds.isEmpty():
        return checkpointed(_compared(pairs.distinct(), sets, codes, threshold)), members
    some = kept(codes, "code_id", in_use(crowds, "code_id"))
    live = checkpointed(keys(parallel(some), table, threshold, bucket, True).distinct())
    sizes = checkpointed(live.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("sig").alias("first")).where("size > 1"))
    pairs = pairs.union(paired(live.join(sizes.where(F.col("size") <= bucket).select("key"), "key")))
    large = live.join(sizes.where(F.col("size") > bucket).select("key", "first"), "key")
    crowded = large.groupBy("sig").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") >= crowd).select("sig")
    stars = large.where("sig != first").join(crowded, "sig", "left_semi").select(F.least("first", "sig").alias("left"), F.greatest("first", "sig").alias("right"))
    near = checkpointed(_compared(pairs.union(stars).distinct(), sets, codes, threshold))
    if not large.isEmpty():
        # All pairs of a large bucket whose codes aren't connected so far, group by group.
        parts = connected_components(near, "left", "right").select(F.col("node").alias("sig"), "component")
        placed = checkpointed(large.drop("first").join(parts, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
        kinds = placed.select("key", "component").distinct()
        across = kinds.withColumnRenamed("component", "xc").join(kinds.withColumnRenamed("component", "yc"), "key").where("xc < yc")
        x, y = (side(placed.withColumnRenamed("component", f"{v}c"), v, f"{v}c") for v in "xy")
        rest = across.join(x, ["key", "xc"]).join(y, ["key", "yc"]).where(enough).select(*pair).distinct()
        near = near.unionByName(_compared(rest, sets, codes, threshold))
    return near, members


def groups(*tables: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(code_id, group_id, copies, links): one row per code; a group is named by its least code_id.

    `copies` counts the codes of an equal set of runs, `links` the compared identities
    found similar to it.  Codes without a run are groups of their own.
    """
    codes = tables[0].select("code_id", "code")
    for t in tables[1:]:
        codes = codes.unionByName(t.select("code_id", "code"))
    near, members = links(codes, threshold)
    near = checkpointed(near)
    parts = connected_components(near, "left", "right")
    degree = near.select(F.col("left").alias("sig")).union(near.select("right")).groupBy("sig").agg(F.count(F.lit(1)).alias("links"))
    sets = members.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("code_id").alias("least")).join(parts.withColumnRenamed("node", "sig"), "sig", "left").join(degree, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    names = sets.groupBy("component").agg(F.min("least").alias("group_id"))
    placed = members.join(sets.join(names, "component").select("sig", "group_id", "copies", "links"), "sig")
    rows = codes.select("code_id").join(placed, "code_id", "left")
    return rows.select("code_id", F.coalesce("group_id", "code_id").alias("group_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def found(owasp: DataFrame, samples: DataFrame) -> DataFrame:
    """(code_a, code_b): all pairs of codes of one group, across both tables."""
    rows = groups(owasp, samples)
    sizes = rows.groupBy("group_id").count().where("count > 1").select("group_id")
    rows = checkpointed(rows.join(sizes, "group_id").select("group_id", "code_id"))
    a, b = rows.withColumnRenamed("code_id", "code_a"), rows.withColumnRenamed("code_id", "code_b")
    return a.join(b, "group_id").where("code_a < code_b").select("code_a", "code_b")


#: The same by all pairs of codes and a transitive closure.
FOUND_SQL = f"""
WITH RECURSIVE {shingles.sql_links("SELECT code_id AS id, code FROM owasp_entries WHERE code <> '' UNION ALL SELECT code_id, code FROM samples WHERE code <> ''", "x.k < y.k", THRESHOLD)},
edges AS (SELECT x.id AS u, y.id AS v FROM alike JOIN sets x ON x.k = a JOIN sets y ON y.k = b),
ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u, v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u)
SELECT u AS code_a, v AS code_b FROM reach WHERE u < v
"""
