"""Code of evaluation splits that occurs, the same or nearly so, in the training split.

Each run of three tokens has a hash.  Runs are ordered by how often they occur in
the whole corpus (a count table of fixed size) and then by hash, rarest first.  A
code gives its least (1 - threshold) n + 1 runs as keys: two codes of the threshold's
similarity share one of those at least (prefix filtering), wherever their edits lie
and however many codes share it.  A common run that is the i-th of one code's n leaves
n - i runs to share at most; pairs whose ranks leave too few for the threshold are no
candidates.  Candidates are sieved by parity bitmaps, which differ in no more bits than
the sets do in runs, so that the sieve loses none; for the rest all common runs are
chained collinearly, extended along their diagonals to matched stretches, and the
share of common runs is computed exactly.

A table of fixed size tells which runs occur on both sides at all; keys whose run the
other side lacks are not sent.  No key is dropped for being frequent; one that may be is
split among tasks.  Keys are sent once and never written.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, parallel
from . import shingles
from .frequency import BITS, kept, members, most, side_flags, sided_table

THRESHOLD = 0.6
#: A run that may occur more often is split among tasks.
SPLIT = 1 << 14
SKETCH_BITS = 512

_TRAIN = ("train",)
_HELD = ("validation", "test")


_WORDS = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def rarity_keys(h: np.ndarray, grades: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """A total order of runs, rarest first: 8 bits of the graded count, 54 of the hash, and in the last two the sides that have the run."""
    cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (grades[cell].astype(np.uint64) << np.uint64(56)) | ((shingles.mix(h) >> np.uint64(8)) & np.uint64(2**56 - 4)) | flags[cell].astype(np.uint64)


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(runs, owner, rows that have runs, number of runs, identity) of the codes of a batch."""
    sets, owner = shingles.run_sets(part.column("code"))
    present, owner = np.unique(owner, return_inverse=True)
    n = np.bincount(owner, minlength=len(present))
    sig = shingles.mix(np.add.reduceat(shingles.mix(sets), np.cumsum(n) - n) + n.astype(np.uint64)) if len(sets) else sets
    return sets, owner, present, n, sig


def identities(codes: DataFrame) -> DataFrame:
    """Each code's set identity `sig`, number of distinct runs `n` and parity bitmap; other columns than `code` are kept.

    Codes of fewer than three tokens have no run, resemble nothing, and give no row.
    """
    keep = [c for c in codes.columns if c != "code"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.select(keep).schema)

    def run(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "code"):
                sets, owner, present, n, sig = _sets(part)
                if len(sets):
                    rows = part.take(pa.array(present))
                    bits = shingles.parity_words(sets, owner, len(present), SKETCH_BITS)
                    yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(sig.view(np.int64)), pa.array(n, pa.int32()), *(pa.array(bits[:, i]) for i in range(len(_WORDS)))], [*keep, "sig", "n", *_WORDS])

    return codes.mapInArrow(run, f"{kept}, sig bigint, n int, " + ", ".join(f"{w} bigint" for w in _WORDS))


def keys(codes: DataFrame, table: Broadcast, train: bool, threshold: float, split: int) -> DataFrame:
    """(fp, sig, n, rest): the keys of prefix filtering of one side's codes that the other side may have too.

    `table` is the corpus's sided table.  `rest` is the number of runs from the key on.  A set
    that occurs again in a task is not sent again.  A run that may occur more than `split` times
    is split: each train set goes to one part of it, each held-out set to all.
    """
    other = np.uint64(1 if train else 2)

    def run(batches):
        grades, bitmaps = table.value
        flags = side_flags(bitmaps)
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
                key, owner = shingles.distinct(rarity_keys(sets, grades, flags), owner)
                rank = np.arange(len(key)) - np.searchsorted(owner, owner)
                prefix = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                first = (rank < prefix[owner]) & ((key & other) > 0) & fresh[owner]
                key, owner, rank = key[first], owner[first], rank[first]
                parts = np.ceil(most((key >> np.uint64(56)).astype(np.uint8)) / split).astype(np.int64)
                parts = np.maximum(parts, 1)
                part_of = (sig[owner] % parts.astype(np.uint64)).astype(np.int64)
                if not train and (parts > 1).any():
                    at = np.repeat(np.arange(len(key)), parts)
                    part_of = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                    key, owner, rank, parts = key[at], owner[at], rank[at], parts[at]
                fp = shingles.mix(key + np.where(parts > 1, part_of, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(sig[owner].view(np.int64)), pa.array(n[owner], pa.int32()), pa.array(n[owner] - rank, pa.int32())], ["fp", "sig", "n", "rest"])

    return codes.mapInArrow(run, "fp bigint, sig bigint, n int, rest int")


def _may_reach(left: str, right: str, sizes: Column, threshold: float) -> Column:
    """Whether two sets of `sizes` runs in all may be similar: those that are differ in few runs, and their parity bitmaps in no more bits."""
    differ = sum((F.bit_count(F.col(f"{left}.{w}").bitwiseXOR(F.col(f"{right}.{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"{left}.{_WORDS[0]}").bitwiseXOR(F.col(f"{right}.{_WORDS[0]}"))))
    return differ <= sizes * ((1 - threshold) / (1 + threshold)) + 1e-9


def _chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds that rises in both codes."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, j) in enumerate(seeds):
        at = bisect_left(tails, j)
        back[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(j)
            ends.append(i)
        else:
            tails[at], ends[at] = j, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def _stretches(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> int:
    """The number of b's tokens covered when chained seeds are extended along their diagonals as far as tokens agree."""
    covered, end_a, end_b = 0, 0, 0
    for i, j in _chain(seeds):
        if j < end_b or i < end_a:
            continue  # inside the stretch before
        back = min(i - end_a, j - end_b)
        before = np.flatnonzero(a[i - back : i][::-1] != b[j - back : j][::-1])
        left = int(before[0]) if len(before) else back
        ahead = min(len(a) - i, len(b) - j)
        after = np.flatnonzero(a[i : i + ahead] != b[j : j + ahead])
        right = int(after[0]) if len(after) else ahead
        covered += left + right
        end_a, end_b = i + right, j + right
    return covered


def aligned(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, share of right's tokens covered by chained and extended seeds) of each pair of codes."""
    similarity = shingles.pair_similarity(left, right)
    cover = np.zeros(len(left))
    near = np.flatnonzero(similarity >= THRESHOLD)
    if len(near):
        sides = []
        for texts in (left.take(pa.array(near)), right.take(pa.array(near))):
            tok, which = shingles.tokens(texts)
            cut = np.searchsorted(which, np.arange(len(near) + 1))
            sides.append((tok, cut))
        (ta, ca), (tb, cb) = sides
        for x, at in enumerate(near.tolist()):
            a, b = ta[ca[x] : ca[x + 1]], tb[cb[x] : cb[x + 1]]
            ha, hb = (shingles.combine(t) for t in (a, b))
            ua, ia = np.unique(ha, return_index=True)
            ub, ib = np.unique(hb, return_index=True)
            _, pa_, pb_ = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
            seeds = sorted(zip(ia[pa_].tolist(), ib[pb_].tolist(), strict=True))
            cover[at] = _stretches(a, b, seeds) / max(len(b), 1)
    return similarity, cover


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    keep = [c for c in pairs.columns if c not in ("left_code", "right_code")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(keep).schema)

    def run(batches):
        for batch in batches:
            for part in shingles.pieces(batch, "left_code", 1 << 19):
                similarity, cover = aligned(part.column("left_code"), part.column("right_code"))
                near = np.flatnonzero(similarity >= threshold - 1e-12)
                rows = part.take(pa.array(near))
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.array(similarity[near]), pa.array(cover[near])], [*keep, "similarity", "coverage"])

    return pairs.mapInArrow(run, f"{kept}, similarity double, coverage double")


def code_fields(holdout: DataFrame, raw: DataFrame) -> DataFrame:
    """(entry_id, field, split, source, code) of every non-empty `before` and `after` of both tables; rows without an id take no part."""
    parts = []
    for rows in (holdout, raw):
        split = F.lower(F.trim("split_name"))
        parts.append(rows.select("entry_id", split.alias("split"), "source", F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("before").alias("code")), F.struct(F.lit(1).alias("field"), F.col("after").alias("code")))).alias("x")))
    both = parts[0].unionByName(parts[1])
    return both.select("entry_id", F.col("x.field").alias("field"), "split", "source", F.col("x.code").alias("code")).where("entry_id is not null and code is not null and code != ''")


def overlaps(codes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Similar codes of the two sides: (pairs of set identities with similarity and coverage, members of each identity).

    `codes` has entry_id, field, split, source, code.  Rows of no split take no
    part.  Codes with equal sets of runs are one identity, compared once, however
    many copies there are.  An empty table gives no pairs.
    """
    train, held = F.col("split").isin(*_TRAIN), F.col("split").isin(*_HELD)
    codes = codes.where(train | held)
    # A code's place: its entry and field in one number.
    codes = codes.withColumn("train", train).withColumn("place", F.col("entry_id") * 2 + F.col("field"))
    table = sided_table(parallel(codes.select("code", "train")), "code", "train")
    prints = checkpointed(identities(parallel(codes.select("place", "train", "code"))))
    owners = prints.select("sig", F.shiftright("place", 1).alias("entry_id"), "train").distinct()
    places = checkpointed(prints.groupBy("sig").agg(F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_held"), F.min("place").alias("place"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in _WORDS)))
    a, b = (keys(parallel(codes.where(F.col("train") == side).select("code")), table, side, threshold, SPLIT).select("fp", F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("rest").alias(f"r{x}")) for side, x in ((True, "left"), (False, "right")))
    # The runs from the first common one on are all that a pair can share, and bound the sizes as well.
    enough = F.least("rleft", "rright") >= (F.col("nleft") + F.col("nright")) * (threshold / (1 + threshold)) - 1e-9
    found = a.hint("merge").join(b, "fp").where(enough & (F.col("left") != F.col("right"))).select("left", "right").distinct()
    look = places.select("sig", "n", F.struct(*_WORDS).alias("w"), "place")
    sieved = (
        found.join(look.select(F.col("sig").alias("left"), F.col("n").alias("ln"), F.col("w").alias("lw"), F.col("place").alias("lp")), "left")
        .join(look.select(F.col("sig").alias("right"), F.col("n").alias("rn"), F.col("w").alias("rw"), F.col("place").alias("rp")), "right")
        .where(_may_reach("lw", "rw", F.col("ln") + F.col("rn"), threshold))
        .select("left", "right", "lp", "rp")
    )
    sieved = checkpointed(sieved)
    # Texts of candidates are picked out where they lie; only they are shuffled.
    needed = members(sieved.select(F.col("lp").alias("place")).union(sieved.select("rp")), "place")
    texts = checkpointed(kept(codes.select("place", "code"), "place", needed))
    pairs = sieved.join(texts.select(F.col("place").alias("lp"), F.col("code").alias("left_code")), "lp").join(texts.select(F.col("place").alias("rp"), F.col("code").alias("right_code")), "rp").select("left", "right", "left_code", "right_code")
    near = _verified(pairs, threshold)
    same = places.where("in_train and in_held").select(F.col("sig").alias("left"), F.col("sig").alias("right"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage"))
    return near.unionByName(same), owners


def entry_pairs(holdout: DataFrame, raw: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(train_entry, held_entry, similarity, coverage): the best of every similar pair of a train and a held-out row."""
    links, members = overlaps(code_fields(holdout, raw), threshold)
    left = members.where("train").select(F.col("sig").alias("left"), F.col("entry_id").alias("train_entry"))
    right = members.where("not train").select(F.col("sig").alias("right"), F.col("entry_id").alias("held_entry"))
    pairs = links.join(left, "left").join(right, "right")
    return pairs.groupBy("train_entry", "held_entry").agg(F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))


def found(holdout: DataFrame, raw: DataFrame) -> DataFrame:
    """(entry_a, entry_b) of every similar pair across the splits, the smaller id first."""
    pairs = entry_pairs(holdout, raw)
    return pairs.select(F.least("train_entry", "held_entry").alias("entry_a"), F.greatest("train_entry", "held_entry").alias("entry_b"))


def report(holdout: DataFrame, raw: DataFrame) -> DataFrame:
    """Per split and source of held-out rows: rows, rows that overlap with train, pairs, and the mean of the best coverage.

    A null source is reported as ''.
    """
    pairs = entry_pairs(holdout, raw).groupBy("held_entry").agg(F.count(F.lit(1)).alias("pairs"), F.max("coverage").alias("best"), F.max("similarity").alias("top"))
    columns = ["entry_id", F.lower(F.trim("split_name")).alias("split"), F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")]
    rows = holdout.select(*columns).unionByName(raw.select(*columns)).where(F.col("split").isin(*_HELD))
    joined = rows.join(pairs, rows["entry_id"] == pairs["held_entry"], "left")
    return joined.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("held_entry").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.round(F.coalesce(F.avg("best"), F.lit(0.0)), 6).alias("mean_coverage"), F.round(F.coalesce(F.max("top"), F.lit(0.0)), 6).alias("top_similarity")
    )


#: The same by all pairs of codes of the two sides.
FOUND_SQL = f"""
WITH entries AS (SELECT entry_id, before, after, split_name FROM holdout UNION ALL SELECT entry_id, before, after, split_name FROM raw_entries),
{shingles.sql_links("SELECT entry_id AS id, lower(trim(split_name)) = 'train' AS train, code FROM (SELECT entry_id, split_name, unnest([before, after]) AS code FROM entries) WHERE code <> '' AND lower(trim(split_name)) IN ('train', 'validation', 'test')", "x.train AND NOT y.train", THRESHOLD)}
SELECT DISTINCT least(x.id, y.id) AS entry_a, greatest(x.id, y.id) AS entry_b FROM alike JOIN sets x ON x.k = a JOIN sets y ON y.k = b
"""
