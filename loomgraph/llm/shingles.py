"""Token shingles of code, computed for a whole Arrow batch at once.

A code is cut into tokens (runs of ASCII letters, digits and underscores; any
other non-blank character alone) and each run of three successive tokens becomes
one 64-bit hash.  Everything works on the UTF-8 bytes of a batch with numpy, so
the cost is a few nanoseconds a byte and no Python object is made per token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

RUN = 3
#: Blanks of Unicode beyond ASCII; they end a token and belong to none.
_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    for span in ((48, 58), (65, 91), (97, 123), (95, 96)):
        word[slice(*span)] = True
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    value = np.random.Generator(np.random.PCG64(20260101)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    return word, blank, value


_WORD, _BLANK, _VALUE = _byte_tables()
_LOWER = (_WORD & (np.arange(256) != ord("_")) & ~((np.arange(256) >= 65) & (np.arange(256) < 91))) | (np.arange(256) >= 0x80)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the murmur3 finalizer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * (out[done - 1 : done] * _BASE)
        done += step
    return out


#: Run hashes leave room for a text's index, so that one sort orders both.
_ROOM = 12
_HIGH = np.uint64(2**64 - 2**_ROOM)
_POW = _powers(1 << 16)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; other blanks become spaces, nulls become empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    for _ in range(2):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        if not len(data) or (data.max(initial=0) < 0x80 and not ((data >= 0x1C) & (data <= 0x1F)).any()):
            break
        texts = pa.array([_BLANKS.sub(" ", t) for t in texts.to_pylist()], pa.large_string())
    return data, offsets - offsets[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every token of every text, in order."""
    return _tokens(*_text_bytes(texts), _WORD, _BLANK)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every word of texts in which words are runs of lower ASCII letters, digits and any other characters beyond ASCII."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return _tokens(data, offsets - offsets[0], _LOWER, ~_LOWER)


def _tokens(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, blank_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data) or blank_bytes[data].all():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = word_bytes[data]
    first = np.zeros(len(data) + 1, bool)
    first[np.minimum(offsets, len(data))] = True  # a text's first byte begins a token; no token runs over two texts
    first = first[:-1]
    continued = np.zeros(len(data), bool)
    continued[1:] = word[1:] & word[:-1]
    continued |= (data & 0xC0) == 0x80
    starts = np.flatnonzero(~blank_bytes[data] & (first | ~continued))
    ends = np.append(starts[1:], len(data))
    # The bytes of a token's reach that are blank add nothing to its hash.
    length = np.arange(len(data)) - np.repeat(starts, ends - starts)[: len(data)] if starts[0] == 0 else None
    if length is None:
        length = np.zeros(len(data), np.int64)
        length[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, ends - starts)
    top = int(length.max()) + 1
    power = _POW if top <= len(_POW) else _powers(top)
    part = _VALUE[data] * power[length]
    part[blank_bytes[data]] = 0
    h = np.add.reduceat(part, starts)
    which = np.searchsorted(offsets, starts, side="right") - 1
    return mix(h), which


def combine(h: np.ndarray, k: int = RUN) -> np.ndarray:
    """The hash of each run of k successive token hashes, of 52 bits; the low 12 bits are zero."""
    n = max(len(h) - k + 1, 0)
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n])
    return out & _HIGH


def runs(texts: pa.Array, k: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, position) of every run of k successive tokens."""
    h, which = tokens(texts)
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = combine(h, k)
    whole = which[:n] == which[k - 1 :]
    first = np.searchsorted(which, which[:n])
    return out[whole], which[:n][whole], (np.arange(n) - first)[whole]


def run_sets(texts: pa.Array, k: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct runs of each text, ordered by text, then hash."""
    h, which, _ = runs(texts, k)
    return distinct_runs(h, which)


def _packed(h: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Text index and run hash in one number."""
    return (which.astype(np.uint64) << np.uint64(64 - _ROOM)) | (h >> np.uint64(_ROOM))


def distinct_runs(h: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `distinct`, for run hashes."""
    if not len(h) or int(which[-1]) >= 1 << _ROOM:
        return distinct(h, which)
    key = np.sort(_packed(h, which))
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return key << np.uint64(_ROOM), (key >> np.uint64(64 - _ROOM)).astype(np.int64)


def distinct(h: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text index, hash) pairs in order; text indices must be rising."""
    if not len(h):
        return h, which
    order = np.argsort(h)  # then a stable sort by text, which is cheap on small integers
    order = order[np.argsort(which[order], kind="stable")]
    h, which = h[order], which[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (which[1:] != which[:-1])
    return h[keep], which[keep]


def parity_words(h: np.ndarray, which: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, bits / 64) words: a bitmap of each set in which each run flips one bit.  Two bitmaps differ in no more bits than their sets in runs."""
    at = (mix(h) >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)
    flips = np.bincount(which * bits + at, minlength=n * bits).reshape(n, bits)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def pair_similarity(left: pa.Array, right: pa.Array, k: int = RUN) -> np.ndarray:
    """The share of common runs in all runs of each pair of texts; 0 where neither has a run."""
    n = len(left)
    a, ai = run_sets(left, k)
    b, bi = run_sets(right, k)
    na, nb = np.bincount(ai, minlength=n), np.bincount(bi, minlength=n)
    if n <= 1 << _ROOM:
        key = np.sort(np.concatenate([_packed(a, ai), _packed(b, bi)]))
        same = key[1:][key[1:] == key[:-1]]
        both = np.bincount((same >> np.uint64(64 - _ROOM)).astype(np.int64), minlength=n)
    else:
        h, which = np.concatenate([a, b]), np.concatenate([ai, bi])
        order = np.argsort(h)
        order = order[np.argsort(which[order], kind="stable")]
        h, which = h[order], which[order]
        both = np.bincount(which[1:][(h[1:] == h[:-1]) & (which[1:] == which[:-1])], minlength=n)
    either = na + nb - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Slices of a batch of about `limit` bytes of text each, so that scratch arrays stay small and in cache."""
    texts = batch.column(column)
    sizes = np.diff(np.frombuffer(texts.cast(pa.large_string()).fill_null("").buffers()[1], np.int64)[: len(texts) + 1]) if len(texts) else np.zeros(0)
    at, begin = 0, 0
    total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > begin and (total + size > limit or at - begin >= 1 << _ROOM):
            yield batch.slice(begin, at - begin)
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield batch.slice(begin)


def window_minima(key: np.ndarray, which: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: (key, text index) of the least key of each window of w successive runs of a text.

    A text of fewer than w runs is one window.  Where successive windows have the
    same minimum it is given once.  Minima of windows are found by doubling, so
    the cost grows with log w.
    """
    if not len(key):
        return key, which
    pad = np.uint64(2**64 - 1)
    counts = np.bincount(which)
    counts = counts[counts > 0]
    # Each text is followed by w - 1 greatest keys: no window then mixes two texts.
    starts = np.cumsum(counts + (w - 1)) - (counts + (w - 1))
    place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    low = np.full(int(starts[-1] + counts[-1] + w - 1), pad, np.uint64)
    low[place] = key
    done = 1
    while done < w:
        step = min(done, w - done)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        done += step
    # A window that begins near the end of a long text reaches over it and is left out.
    ahead = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
    whole = (ahead <= np.repeat(np.maximum(counts - w, 0), counts))
    low, which = low[place][whole], which[whole]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != low[:-1]) | (which[1:] != which[:-1])
    return low[keep], which[keep]


def bin_minima(h: np.ndarray, which: np.ndarray, n: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: an (n, bins) table of the least hash in each bin; an empty bin takes the next full one to the right, around the end."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = which * bins + (h >> shift).astype(np.int64)
    out = np.zeros(n * bins, np.uint64)
    if len(h):
        first = np.ones(len(h), bool)  # rows come ordered by text and hash: the first of a cell is its least
        first[1:] = cell[1:] != cell[:-1]
        out[cell[first]] = h[first] | np.uint64(1)
    out = out.reshape(n, bins)
    full = out.any(axis=1)
    step = np.uint64(0)
    gaps = (out == 0) & full[:, None]
    while gaps.any():
        step += np.uint64(1)
        moved = np.roll(out, -1, axis=1)
        moved = np.where(moved != 0, mix(moved + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1), moved)
        out = np.where(gaps, moved, out)
        gaps = (out == 0) & full[:, None]
    return out


def sql_links(codes: str, condition: str, threshold: float) -> str:
    """DuckDB SQL of CTEs: `sets` (k, id and other columns of `codes`, n) and `alike` (a, b), all pairs of codes of a similarity, for small tables.

    `codes` is SQL with id and code; `condition` is on the columns of two codes x and y.
    """
    tokens = r"regexp_extract_all(code, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')"
    return f"""sets AS (SELECT row_number() OVER () AS k, * EXCLUDE (code, t), list_distinct(list_transform(range(1, len(t) - 1), lambda i: hash(t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS s FROM (SELECT *, {tokens} AS t FROM ({codes}))),
runs AS (SELECT * EXCLUDE (s), len(s) AS n, unnest(s) AS g FROM sets),
alike AS (SELECT a, b FROM (SELECT x.k AS a, y.k AS b, count(*) AS c, any_value(x.n) AS an, any_value(y.n) AS bn FROM runs x JOIN runs y ON x.g = y.g AND {condition} GROUP BY x.k, y.k) WHERE c >= {threshold} * (an + bn - c) - 1e-9)"""
