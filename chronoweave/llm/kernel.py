"""Vectorised text scanning over Arrow string arrays: chunks, tokens and O(1) substring hashes.

A chunk is a run of whole rows of about ``CHUNK`` bytes (one longer row makes a chunk of its own), so the working
set of a task does not depend on the batch size. Hashes are 64-bit: prefix sums of byte codes times powers of an odd
base modulo 2**64, so that the hash of any substring is one subtraction and one product with the inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One 64-bit code per byte value.
CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Chunk:
    """Rows ``first .. first+len(offsets)-2`` of an array; ``data`` holds their UTF-8 bytes back to back."""

    first: int
    offsets: np.ndarray
    data: np.ndarray
    sums: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def prepare(self, data: np.ndarray | None = None) -> Chunk:
        """Prefix sums for ``span_hash``, over other bytes of the same length if given (lower-cased ones, say)."""
        data = self.data if data is None else data
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * powers(_BASE, len(data) + 1)[: len(data)], out=self.sums[1:])
        return self

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the byte ranges [start, end)."""
        h = (self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(salt * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of true bytes that don't cross rows: starts, ends, and for each row the first run's number (one more at the end)."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before, after = np.empty(len(inside), bool), np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(array: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a string array in order; a null counts as an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(array) + 1, offset=array.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(array))
        own = offsets[first : last + 1]
        yield Chunk(first, own - own[0], data[own[0] : own[-1]])
        first = last


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of every run, from what ``Chunk.spans`` returned last."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def small_batches(spark, rows: int = 1024) -> None:
    """Arrow batches of so many rows at most: texts are long, and a batch is in memory as a whole."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Slices of consecutive rows that agree in the first ``keys`` columns (long ones); rows come sorted. One group at a time is in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        change[0] = held and now != last or False
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if not change[0]:
            held.append(batch.slice(0, cuts[0]))
            cuts = cuts[1:] and [cuts[0], *cuts[1:]]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
