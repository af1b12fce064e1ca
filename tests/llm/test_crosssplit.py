import itertools
import random

import pytest

from loomgraph.llm import crosssplit, oddsketch

from .test_shingles import runs_of

SCHEMA = "entry_id bigint, before string, after string, language string, source string, split_name string, note string"


def altered(rng, words, rate):
    return [rng.choice("pqrstuvw") + str(rng.randint(0, 99)) if rng.random() < rate else w for w in words]


def corpus(seed=5, families=12, each=6):
    rng = random.Random(seed)
    out = []
    boiler = "import os ; import sys ; def main ( ) : return None ; ".split()
    for _ in range(families):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(rng.randint(40, 90))]
        for _ in range(each):
            out.append(" ".join(boiler + altered(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06, 0.1, 0.3]))))
    return out


def similarity(a, b):
    x, y = runs_of(a), runs_of(b)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = corpus()
    out = []
    for i, (a, b) in enumerate(zip(texts[::2], texts[1::2], strict=False)):
        out.append((i, a, rng.choice([a, b, "", None]), "python", rng.choice(["x", None]), rng.choice(["train", "test", "validation", None]), "n"))
    out.append((900, out[0][1], None, None, None, "train", "copy"))
    out.append((901, out[0][1], None, None, None, "test", "copy"))
    out += [(902, None, None, None, None, "test", None), (903, "a b", "", None, None, "train", None), (904, "a b", "  ", None, None, "test", None)]
    return out


def expected(rows):
    pairs = set()
    for x, y in itertools.product(rows, rows):
        if x[5] == "train" and y[5] in ("test", "validation"):
            if any(similarity(a, b) >= 0.6 for a in x[1:3] for b in y[1:3] if a and b):
                pairs.add((min(x[0], y[0]), max(x[0], y[0])))
    return pairs


@pytest.mark.parametrize("split", [crosssplit.SPLIT, 1])
def test_found_agrees_with_all_pairs(spark, rows, split, monkeypatch):
    # With a low limit every shared key is split among tasks.
    monkeypatch.setattr(crosssplit, "SPLIT", split)
    half = len(rows) // 2
    one, two = spark.createDataFrame(rows[:half], SCHEMA), spark.createDataFrame(rows[half:], SCHEMA)
    got = crosssplit.found(one, two).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == expected(rows) and len(got) > 5


def pairs_of(spark, trains, helds):
    rows = [(i, t, None, None, None, "train", None) for i, t in enumerate(trains)] + [(10_000 + i, t, None, None, None, "test", None) for i, t in enumerate(helds)]
    got = {tuple(r) for r in crosssplit.found(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)).collect()}
    sets = [[runs_of(t) for t in texts] for texts in (trains, helds)]
    want = {(i, 10_000 + j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if len(x & y) >= 0.6 * len(x | y)}
    return got, want


def substituted(base, places, name):
    return " ".join(f"{name}{i}" if i in places else w for i, w in enumerate(base))


def test_a_family_of_different_near_copies_is_found_whole(spark):
    # Every run the copies have in common is shared by hundreds of pairs; the rarest of most windows are each copy's own.
    rng = random.Random(3)
    base = [f"b{i}" for i in range(320)]
    trains, helds = ([substituted(base, set(rng.sample(range(320), k)), f"{side}{i}x") for i in range(count)] for side, count, k in (("t", 30, 22), ("h", 30, 6)))
    got, want = pairs_of(spark, trains, helds)
    assert got == want and len(want) > 100


def test_edits_spread_evenly_leave_a_pair_found(spark):
    # An edit every 13 tokens: no window of 12 runs is common, the similarity is above the threshold.
    trains = [" ".join(f"a{i}_{j}" for j in range(260)) for i in range(5)]
    helds = [substituted(t.split(), set(range(6, 260, 13)), f"x{i}_") for i, t in enumerate(trains)]
    got, want = pairs_of(spark, trains, helds)
    assert got == want and len(want) == 5


def test_short_codes_at_the_threshold_pass_the_sieve(spark):
    # 8 runs each, 6 of them common: a similarity of 0.6 exactly.
    trains = [" ".join(f"a{i}_{j}" for j in range(10)) for i in range(200)]
    helds = [" ".join([f"x{i}"] + t.split()[1:-1] + [f"y{i}"]) for i, t in enumerate(trains)]
    got, want = pairs_of(spark, trains, helds)
    assert got == want and len(want) == 200


def test_report_and_empty_tables(spark, rows):
    full, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert crosssplit.found(none, none).count() == 0
    report = crosssplit.report(full, none).collect()
    assert sum(r["rows"] for r in report) == sum(r[5] in ("test", "validation") for r in rows)
    assert all(0 <= r["mean_coverage"] <= 1 and r["overlapping"] <= r["rows"] for r in report)


def test_chain_and_stretches():
    assert crosssplit._chain([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    import numpy as np

    a, b = np.array([1, 2, 3, 4, 9, 5, 6]), np.array([7, 1, 2, 3, 4, 5, 6])
    assert crosssplit._stretches(a, b, [(1, 2), (5, 5)]) == 6


@pytest.mark.parametrize("bucket", [oddsketch.BUCKET, 1])
def test_groups_agree_with_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(oddsketch.links, "__defaults__", (oddsketch.THRESHOLD, bucket, oddsketch.CROWD))
    texts = corpus(seed=6, families=8, each=7) + ["a b", "a b", "", None]
    texts += [texts[0], texts[0]]
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if texts[i] and texts[j] and similarity(texts[i], texts[j]) >= 0.6:
            parent[find(i)] = find(j)
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if find(i) == find(j)}
    schema = "code_id bigint, code string, sig string"
    one, two = spark.createDataFrame(rows[:30], schema), spark.createDataFrame(rows[30:], schema)
    assert {tuple(r) for r in oddsketch.found(one, two).collect()} == want
    groups = oddsketch.groups(one, two).collect()
    assert len(groups) == len(rows) and {r["code_id"]: r["copies"] for r in groups}[0] >= 3


def linked(texts):
    """The links that hold exact groups of texts together, as the group's first of each text."""
    sets, of = [runs_of(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if of[i] != of[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
            low, high = sorted((of[i], of[j]))
            of = [low if x == high else x for x in of]
    return of


def test_a_crowd_without_a_common_centre_is_grouped_whole(spark, monkeypatch):
    # Many variants of a base that isn't there, each like some others only; every shared bucket is large.
    monkeypatch.setattr(oddsketch.links, "__defaults__", (oddsketch.THRESHOLD, 1, oddsketch.CROWD))
    rng = random.Random(4)
    texts = []
    for family in range(6):
        base = [f"b{family}_{i}" for i in range(320)]
        texts += [substituted(base, set(rng.sample(range(320), rng.randint(14, 19))), f"c{family}_{k}x") for k in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "code_id bigint, code string")
    got = {r["code_id"]: r["group_id"] for r in oddsketch.groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts)


def test_short_codes_at_the_threshold_are_linked(spark):
    texts = [" ".join(f"a{i}_{j}" for j in range(10)) for i in range(200)]
    texts += [" ".join([f"x{i}"] + t.split()[1:-1] + [f"y{i}"]) for i, t in enumerate(texts)]
    rows = spark.createDataFrame(list(enumerate(texts)), "code_id bigint, code string")
    got = {r["code_id"]: r["group_id"] for r in oddsketch.groups(rows).collect()}
    assert all(got[i + 200] == i for i in range(200))


def test_groups_of_an_empty_table(spark):
    none = spark.createDataFrame([], "code_id bigint, code string")
    assert oddsketch.found(none, none).count() == 0


def test_odd_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(1, 2**60, (1, 256)).astype(np.uint64)
    for share in (1.0, 0.9, 0.7):
        b = a.copy()
        b[0, : int(256 * (1 - share))] += np.uint64(1)
        x, y = oddsketch.parity(a), oddsketch.parity(b)
        differ = sum(bin(int(v) & (2**64 - 1)).count("1") for v in (x ^ y).ravel())
        got = 1 + oddsketch.PARITY_BITS / (4 * 256) * np.log(max(1 - 2 * differ / oddsketch.PARITY_BITS, 1e-9))
        assert abs(got - share) < 0.08
