import random
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import shingles

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def runs_of(text):
    t = TOKEN.findall(text or "")
    return {tuple(t[i : i + 3]) for i in range(len(t) - 2)}


def test_sets_and_similarity_agree_with_plain_python():
    rng = random.Random(3)
    words = ["a", "b1", "_c", "(", ")", ";", "é", "日", " ", " ", "\u2003", "\n", "\x1f", ""]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "  ", "ab", "a b c"]
    h, which = shingles.run_sets(pa.array(texts))
    assert np.bincount(which, minlength=len(texts)).tolist() == [len(runs_of(t)) for t in texts]
    left, right = texts[:150], texts[150:300]
    expected = []
    for a, b in zip(left, right, strict=True):
        x, y = runs_of(a), runs_of(b)
        expected.append(len(x & y) / len(x | y) if x | y else 0.0)
    assert np.allclose(shingles.pair_similarity(pa.array(left), pa.array(right)), expected)


def test_window_minima_are_those_of_every_window():
    rng = np.random.default_rng(1)
    which = np.sort(rng.integers(0, 20, 400))
    key = rng.integers(0, 50, 400).astype(np.uint64)
    low, at = shingles.window_minima(key, which, 7)
    expected = []
    for i in range(20):
        own, last = key[which == i], None
        for j in range(max(len(own) - 7, 0) + 1 if len(own) else 0):
            if (least := own[j : j + 7].min()) != last:
                expected.append((i, int(least)))
            last = least
    assert list(zip(at.tolist(), low.tolist(), strict=True)) == expected


def test_pieces_cover_a_batch_in_order():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 10] * 100 + [None, ""] + ["y" * 5000], "i": list(range(103))})
    parts = list(shingles.pieces(batch, "t", 200))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(103)) and len(parts) > 4
    assert list(shingles.pieces(batch.slice(0, 0), "t")) == []


def test_long_token_and_empty_batch():
    h, which = shingles.tokens(pa.array(["z" * 200_000 + " b c", "z" * 200_000]))
    assert which.tolist() == [0, 0, 0, 1] and h[0] == h[3]
    assert len(shingles.tokens(pa.array([], pa.string()))[0]) == 0
