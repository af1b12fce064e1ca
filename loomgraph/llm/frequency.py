"""A count table of hashed runs over a whole corpus, of one fixed size.

A run falls into the cell named by the top BITS bits of its hash; a cell's count is
never less than the number of the run's own occurrences.  A count takes one byte:
itself up to 64, then eight steps for each doubling.  The table has 2**BITS cells
whatever the corpus, so it may be sent to every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import shingles

BITS = SIDE_BITS = 24
_SLICES = 32
_PLAIN = 64
_STEPS = 8


def graded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that order as they do; counts up to _PLAIN are kept."""
    out = np.minimum(counts, _PLAIN).astype(np.uint8)
    large = np.flatnonzero(counts > _PLAIN)
    out[large] = np.minimum(_PLAIN + np.floor(_STEPS * np.log2(counts[large] / _PLAIN)), 255)
    return out


def most(grade: np.ndarray) -> np.ndarray:
    """The greatest count of a grade."""
    above = np.maximum(grade.astype(np.float64) - _PLAIN, 0)
    return np.where(grade < _PLAIN, grade, _PLAIN * 2 ** ((above + 1) / _STEPS))


def _sparse(table: np.ndarray) -> bytes:
    """The cells of a slice that aren't zero: the gaps between them, then their counts."""
    at = np.flatnonzero(table).astype(np.int32)
    return zstandard.ZstdCompressor(1).compress(np.diff(at, prepend=np.int32(0)).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() + table[at].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _add_sparse(total: np.ndarray, data: bytes) -> None:
    gaps, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 4, -1)
    gaps, counts = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in (gaps, counts))
    total[np.cumsum(gaps.astype(np.int64))] += counts


def _packed(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.packbits(bits).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


def count_table(codes: DataFrame, column: str, k: int = shingles.RUN) -> Broadcast:
    """The graded counts of all runs of k tokens in `column`, over every row, as a broadcast array of 2**BITS bytes.

    Null and empty texts count nothing; an empty table gives zeros.
    """
    return codes.sparkSession.sparkContext.broadcast(_gathered(codes, column, None, k)[0])


def sided_table(codes: DataFrame, column: str, side: str, k: int = shingles.RUN) -> Broadcast:
    """The counts as above, and two bitmaps: cells with a run of a row whose boolean `side` is false, and of a true row."""
    return codes.sparkSession.sparkContext.broadcast(_gathered(codes, column, side, k))


def side_flags(bitmaps: np.ndarray) -> np.ndarray:
    """The cells of a sided table, from its two bitmaps: bit 0 for false rows, bit 1 for true ones."""
    no, yes = np.split(np.unpackbits(bitmaps), 2)
    return no | (yes << 1)


def _gathered(codes: DataFrame, column: str, side: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    cells = (1 << BITS) // _SLICES

    def partial(batches):
        total = np.zeros(1 << BITS, np.uint32)
        seen = np.zeros((2, 1 << BITS if side else _SLICES), bool)
        for batch in batches:
            for part in shingles.pieces(batch, column):
                h, which, _ = shingles.runs(part.column(column), k)
                cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
                np.add.at(total, cell, np.uint32(1))
                if side:
                    yes = np.array(part.column(side).to_pylist(), bool)[which]
                    seen[0, cell[~yes]] = True
                    seen[1, cell[yes]] = True
        no, yes = (np.split(x, _SLICES) for x in seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_SLICES), pa.int32()), pa.array([_sparse(x) for x in np.split(total, _SLICES)], pa.binary()), pa.array([_packed(np.concatenate(x)) for x in zip(no, yes, strict=True)], pa.binary())], ["slice", "counts", "seen"]
        )

    def merged(batches):
        # Row by row: the tables of all tasks are never held at once.
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at, x, y in zip(batch.column("slice").to_pylist(), batch.column("counts"), batch.column("seen"), strict=True):
                total = totals.setdefault(at, [np.zeros(cells, np.uint64), np.zeros(1, np.uint8)])
                _add_sparse(total[0], x.as_py())
                total[1] = total[1] | _unpacked(y.as_py())
        counts = [zstandard.ZstdCompressor(1).compress(graded(x).tobytes()) for x, _ in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(counts, pa.binary()), pa.array([zstandard.ZstdCompressor(1).compress(y.tobytes()) for _, y in totals.values()], pa.binary())], ["slice", "counts", "seen"])

    schema = "slice int, counts binary, seen binary"
    columns = [column, side] if side else [column]
    counts = [np.zeros(cells, np.uint8)] * _SLICES
    seen = [np.zeros(2 * (cells if side else 8) // 8, np.uint8)] * _SLICES
    for row in codes.select(*columns).mapInArrow(partial, schema).repartition("slice").mapInArrow(merged, schema).collect():
        counts[row["slice"]] = _unpacked(row["counts"])
        seen[row["slice"]] = _unpacked(row["seen"])
    sides = [np.split(x, 2) for x in seen] if side else []
    return np.concatenate(counts), np.concatenate([x for x, _ in sides] + [x for _, x in sides]) if side else np.zeros(0, np.uint8)


def members(numbers: DataFrame, column: str, bits: int = SIDE_BITS) -> Broadcast:
    """A bitmap of fixed size in which the bit of every number of a column is set."""

    def partial(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_cells(batch.column(column), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([_packed(seen)], pa.binary())], ["seen"])

    def merged(batches):
        total = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            for x in batch.column("seen"):
                total |= _unpacked(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(1).compress(total.tobytes())], pa.binary())], ["seen"])

    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in numbers.select(column).mapInArrow(partial, "seen binary").coalesce(8).mapInArrow(merged, "seen binary").collect():
        bitmap |= _unpacked(row["seen"])
    return numbers.sparkSession.sparkContext.broadcast(bitmap)


def _cells(numbers: pa.Array, bits: int) -> np.ndarray:
    values = numbers.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return (shingles.mix(values + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def kept(rows: DataFrame, column: str, wanted: Broadcast, bits: int = SIDE_BITS) -> DataFrame:
    """The rows whose number is in a bitmap, and a few others that share a bit; without a shuffle."""

    def run(batches):
        bitmap = wanted.value
        for batch in batches:
            cell = _cells(batch.column(column), bits)
            hit = (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
            if hit.any():
                yield batch.filter(pa.array(hit.astype(bool)))

    return rows.mapInArrow(run, rows.schema)
