"""Importance resampling towards a target distribution of hashed n-grams.

Words and pairs of adjacent words are counted by bucket in the raw texts and in the target's, once over all of each. The
gain of a bucket is the logarithm of the ratio of its two smoothed shares, in whole thousandths, the weight of a text the
floored mean of the gains of its n-grams. Texts are then drawn without replacement by the highest scores: weight plus
Gumbel noise that a hash of the id fixes.

In a task an open-addressed NumPy table interns the n-grams of about half a megabyte of text at a time: the keys are their
xxhash64, all probes of a round go at once, and bytes are compared wherever a key is found, so that equal hashes of
different n-grams share no slot. Slots hold the bucket and the count; each occurrence keeps the number of its slot, by which
it gathers its gain. Longer texts go through in pieces that begin with the last word of the piece before.

Ranks are whole without gathering: scores are counted by value, of which there are some ten thousands at most however many
texts there are (logarithms times a thousand), and a text's rank is the number of texts with a higher score plus its place by
id among those of its own.

Defined results: a null or empty text has no n-grams and weight 0; a null id draws its noise as the empty text and comes first
among equal scores; rows of one id and score go by a hash of the text; repeated rows each count; an empty target or table
leaves only the smoothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, store

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Bytes of words: all but ASCII other than letters and digits; A-Z are lower-cased before.
WORD = np.ones(256, bool)
WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

#: The five primes of xxhash64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _lanes(text: np.ndarray, width: int) -> np.ndarray:
    """The little-endian number of ``width`` bytes that begins at each place of ``text``, which ends with 8 spare bytes."""
    return np.ndarray((len(text) - 8,), f"<u{width}", text, strides=(1,))


def xxhash64(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The xxhash64 of each range of ``text``, which ends with 8 spare bytes."""
    eight, four = _lanes(text, 8), _lanes(text, 4)
    h = _P5 + size.astype(np.uint64)
    long = size >= 32
    if long.any():
        view = memoryview(text)
        h[long] = [xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(start[long].tolist(), size[long].tolist(), strict=True)]
    own = np.flatnonzero(~long)
    for lane in range(3):
        own = own[size[own] >= 8 * lane + 8]
        k = _rotated(eight[start[own] + 8 * lane] * _P2, 31) * _P1
        h[own] = _rotated(h[own] ^ k, 27) * _P1 + _P4
    done = size & ~7
    own = np.flatnonzero(~long & (size & 4 > 0))
    h[own] = _rotated(h[own] ^ four[start[own] + done[own]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    done += size & 4
    for byte in range(3):
        own = np.flatnonzero(~long & (size & 3 > byte))
        h[own] = _rotated(h[own] ^ text[start[own] + done[own] + byte].astype(np.uint64) * _P5, 11) * _P1
    own = ~long
    x = h[own]
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    h[own] = x ^ x >> np.uint64(32)
    return h


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of ``size`` bytes that begin at a and b are equal, each."""
    eight = _lanes(text, 8)
    same = np.ones(len(a), bool)
    at, left = 0, np.flatnonzero(a != b)
    while len(left := left[size[left] > at]):
        differ = eight[a[left] + at] ^ eight[b[left] + at]
        spare = np.maximum(8 - (size[left] - at), 0).astype(np.uint64) * np.uint64(8)
        equal = differ << spare == 0
        same[left[~equal]] = False
        left, at = left[equal], at + 8
    return same


@dataclass
class Interned:
    """Occurrences of byte ranges by slot of an open-addressed table: ``slot`` of each occurrence, ``used`` slots, and by used slot ``bucket`` and ``count``; ``place`` finds a slot among the used."""

    slot: np.ndarray
    used: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    place: np.ndarray

    @property
    def buckets(self) -> np.ndarray:
        """Bucket of each occurrence."""
        return self.bucket[self.place[self.slot]]


def interned(text: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int = BUCKETS, keys: np.ndarray | None = None) -> Interned:
    """Intern the ranges of ``text``; ``keys`` are their xxhash64 unless given."""
    keys = xxhash64(text, start, size) if keys is None else keys
    capacity = 1 << max(4, int(2 * len(start)).bit_length())
    mask = capacity - 1
    owner = np.full(capacity, -1, np.int64)
    at = (keys & np.uint64(mask)).astype(np.int64)
    slot, left = np.empty(len(start), np.int64), np.arange(len(start))
    while len(left):
        spot = at[left]
        free = owner[spot] < 0
        owner[spot[free]] = left[free]  # of several the last one stays
        own = owner[spot]
        same = (keys[own] == keys[left]) & (size[own] == size[left])
        hit = np.flatnonzero(same)
        same[hit] = _equal(text, start[own[hit]], start[left[hit]], size[left[hit]])
        slot[left[same]] = spot[same]
        left = left[~same]
        at[left] = at[left] + 1 & mask
    used = np.flatnonzero(owner >= 0)
    data, first = text.tobytes(), owner[used]
    bucket = np.array([zlib.crc32(data[a:b]) for a, b in zip(start[first].tolist(), (start[first] + size[first]).tolist(), strict=True)], dtype=np.int64) % buckets
    place = np.zeros(capacity, np.int64)
    place[used] = np.arange(len(used))
    return Interned(slot, used, bucket, np.bincount(slot, minlength=capacity)[used], place)


@dataclass
class Grams:
    """N-grams of the rows ``first .. first + rows - 1``, or of a piece of one row: their ranges in ``text``, the row of each and the number of words by row."""

    first: int
    rows: int
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    words: np.ndarray
    more: bool = False


def _grams(part: kernel.Chunk, carried: bool = False, more: bool = False) -> Grams:
    """Words and pairs of words of a chunk, in a text in which one space follows each word; a carried first word was counted before."""
    data = kernel.LOWER[part.data]
    begin, end, first = part.spans(WORD[data])
    rows = kernel.row_of(first)
    size = end - begin
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int((size + 1).sum()) + 8, 32, np.uint8)
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    text[inside] = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    skip = int(carried)
    return Grams(
        part.first, part.rows, text, np.concatenate([start[skip:], start[pair]]), np.concatenate([size[skip:], size[pair] + 1 + size[pair + 1]]),
        np.concatenate([rows[skip:], rows[pair]]), np.bincount(rows[skip:], minlength=part.rows), more,
    )


def grams(array: pa.Array, size: int = kernel.CHUNK) -> Iterator[Grams]:
    """N-grams of a string array, about ``size`` bytes of text at a time; ``more`` says that a further piece of the same row follows."""
    for part in kernel.chunks(array, size):
        if part.rows > 1 or len(part.data) <= 2 * size:
            yield _grams(part)
            continue
        word, at, carried = WORD[kernel.LOWER[part.data]], 0, np.zeros(0, np.uint8)
        while at < len(word):
            # A piece ends where a word does.
            end = min(at + size, len(word))
            while end < len(word) and word[end]:
                gap = np.flatnonzero(~word[end : end + size])
                end += int(gap[0]) if len(gap) else min(size, len(word) - end)
            piece = np.concatenate([carried, part.data[at:end]])
            yield _grams(kernel.Chunk(part.first, np.array([0, len(piece)]), piece), len(carried) > 0, end < len(word))
            inside = np.flatnonzero(WORD[kernel.LOWER[piece]])
            if len(inside):
                last = inside[-1] + 1
                gap = np.flatnonzero(~WORD[kernel.LOWER[piece[:last]]])
                carried = np.append(piece[gap[-1] + 1 if len(gap) else 0 : last], np.uint8(32))
            at = end


def counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS, size: int = kernel.CHUNK) -> DataFrame:
    """(bucket, n) over all n-grams of all texts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for g in grams(batch["text"], size):
                t = interned(g.text, g.start, g.size, buckets)
                n += np.bincount(t.bucket, t.count, buckets).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["bucket", "n"])

    found = rows.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", buckets: int = BUCKETS, size: int = kernel.CHUNK) -> np.ndarray:
    """The gain of each bucket in whole thousandths: a table of ``buckets`` numbers, whatever the input."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for table, column, into in ((docs, text_col, s), (target, target_text, t)):
        for r in counts(table, column, buckets, size).collect():
            into[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", size: int = kernel.CHUNK) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every row; tie is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            held = np.zeros(3, np.int64)
            for g in grams(batch["text"], size):
                t = interned(g.text, g.start, g.size, len(gain))
                total = np.zeros(g.rows, np.int64)
                np.add.at(total, g.row, gain[t.buckets])
                sums = np.stack([g.words, np.bincount(g.row, minlength=g.rows), total])
                sums[:, 0] += held
                held = sums[:, 0] if g.more else np.zeros(3, np.int64)
                if g.more:
                    continue
                words, features, total = sums
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                own = (batch[c].slice(g.first, g.rows) for c in ("doc_id", "tie"))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.astype(np.int64)) for x in (words, features, weight))], names=["doc_id", "tie", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, tie long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, fixed by the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", size: int = kernel.CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row."""
    scored = weights(docs, gains(docs, target, text_col, target_text, size=size), id_col, text_col, size)
    scored = scored.select("doc_id", "tie", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("open"))
    scored = store.written(scored, "scored")
    by_score = scored.where("open").groupBy("score").agg(F.count("*").alias("n"))
    # Some ten thousand rows at most, so a window over all of them is small.
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all"))
    drawn = F.floor(F.lit(percent) * F.col("all") / 100)
    above = above.where(F.col("above") < drawn).select("score", "above", drawn.alias("drawn"), F.lit(True).alias("open"))
    place = F.row_number().over(Window.partitionBy("score", "open").orderBy("doc_id", "tie")) + F.col("above")
    ranked = scored.join(F.broadcast(above), ["score", "open"], "left")
    within = ranked.where("above is not null").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= F.col("drawn"), F.col("place")).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return within.select(*columns, "rank").unionByName(ranked.where("above is null").select(*columns, F.lit(None).cast("long").alias("rank")))
