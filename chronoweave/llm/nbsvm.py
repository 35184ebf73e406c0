"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model fitted by dual
coordinate descent.

The n-grams are hashed sequences of one to three words, and of one to three word shapes (repeats the word before, upper
case, kind of last character, no letter or digit), which tell junk whose words are new. The model is fitted on the driver
from at most ``max_rows`` labelled rows, drawn by a hash of the id, half of them from each class; a quarter of them, by
that hash too, only calibrates margins to chances. Scoring is one pass without a shuffle.

Defined results: as for ``toxicity``: null and empty texts are scored as texts without n-grams, a null id isn't held
out, unusable labels are ignored, and with one class only every score is that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .toxicity import held_out, training_rows

WORD_BITS, SEQUENCE_BITS = 17, 18
DIMS = (1 << WORD_BITS) + (1 << 5) + (1 << 10) + (1 << 15) + (1 << SEQUENCE_BITS)
MAX_ROWS = 4000
UPPER, LOWERCASE, ALNUM = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91] = True
LOWERCASE[97:123] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LAST = np.full(256, 3)
LAST[ALNUM] = 0
LAST[[ord(c) for c in ".,;:'\")"]] = 1
LAST[[ord(c) for c in "!?"]] = 2


def _features(part: kernel.Chunk) -> np.ndarray:
    """Sorted distinct row * DIMS + feature."""
    part.prepare(kernel.LOWER[part.data])
    start, end, first = part.spans(~kernel.WHITE[part.data])
    rows = kernel.row_of(first)
    if not len(rows):
        return np.zeros(0, np.int64)
    words = part.span_hash(start, end)

    def any_of(kind: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(part.data) + 1, np.int32)
        np.cumsum(kind[part.data], out=seen[1:])
        return seen[end] > seen[start]

    again = np.zeros(len(rows), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    shape = again | (any_of(UPPER) & ~any_of(LOWERCASE) & (end - start > 1)) << 1 | LAST[part.data[end - 1]] << 2 | (~any_of(ALNUM)).astype(np.int64) << 4
    base = 1 << WORD_BITS
    two = rows[1:] == rows[:-1]
    three = two[1:] & two[:-1]
    pair, triple = shape[:-1] << 5 | shape[1:], shape[:-2] << 10 | shape[1:-1] << 5 | shape[2:]
    with np.errstate(over="ignore"):
        word_pair = kernel.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        word_triple = kernel.mix(word_pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[2:])
    sequences = base + 32 + 1024 + (1 << 15)
    found = [
        (rows[1:] * DIMS + sequences + (word_pair >> np.uint64(64 - SEQUENCE_BITS)).astype(np.int64))[two],
        (rows[2:] * DIMS + sequences + (word_triple >> np.uint64(64 - SEQUENCE_BITS)).astype(np.int64))[three],
        rows * DIMS + (words >> np.uint64(64 - WORD_BITS)).astype(np.int64),
        rows * DIMS + base + shape,
        (rows[1:] * DIMS + base + 32 + pair)[two],
        (rows[2:] * DIMS + base + 32 + 1024 + triple)[three],
    ]
    return np.unique(np.concatenate(found))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kernel.chunks(batch["text"]):
            pairs = _features(part)
            cut = np.searchsorted(pairs, np.arange(part.rows + 1) * DIMS)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].slice(part.first, part.rows) for c in ("o1", "o2", "label", "weight")), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs % DIMS, pa.int32()))],
                names=["o1", "o2", "label", "weight", "features"],
            )


def log_count_ratios(rows: np.ndarray, feats: np.ndarray, y: np.ndarray, dims: int, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each n-gram among the n-grams of class 1, over the same of class 0."""
    p, q = (smooth + np.bincount(feats, of[rows], dims) for of in (y == 1, y == 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_dual(starts: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, cost: np.ndarray, dims: int, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Minimise |w|^2/2 + sum(cost * max(0, 1 - y w.x)) one dual variable at a time; the last of the dims is the bias, 1 in every row."""
    w, alpha = np.zeros(dims), np.zeros(len(y))
    square = np.array([values[a:b] @ values[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]) + 1.0
    draw = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(y)):
            a, b = starts[i], starts[i + 1]
            c, v = cols[a:b], values[a:b]
            gradient = y[i] * (w[c] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (move := new - alpha[i]) != 0:
                w[c] += move * y[i] * v
                w[-1] += move * y[i]
                alpha[i] = new
                most = max(most, abs(move))
        if most < 1e-4:
            break
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps with a small ridge."""
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], 1)
    mass = mass / mass.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        gradient = x.T @ (mass * (p - y)) + 1e-4 * ab
        ab = ab - np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), gradient).clip(-2, 2)
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", usable=lambda i: F.lit(True), max_rows: int = MAX_ROWS, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights by n-gram (already times the ratios and the calibration's slope) and the intercept."""
    kernel.small_batches(docs.sparkSession)
    table = training_rows(docs, labels, label, usable, max_rows).mapInArrow(_extract, "o1 long, o2 long, label int, weight double, features array<int>").toArrow()
    # An order of its own, so that neither the layout of the tables nor a repeated task changes the model.
    table = table.sort_by([("o1", "ascending"), ("o2", "ascending"), ("label", "ascending")])
    y = table["label"].to_numpy()
    weight = np.zeros(DIMS)
    if not len(y) or y.min() == y.max():
        return weight, float(30 if len(y) and y[0] else -30)
    lists = table["features"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    rows, feats = np.repeat(np.arange(len(y)), counts), lists.flatten().to_numpy()
    check = table["o1"].to_numpy() % 4 == 3 if min((y == 1).sum(), (y == 0).sum()) >= 20 else np.zeros(len(y), bool)
    check &= len(set(y[check])) == 2
    learn = ~check[rows]
    often = np.bincount(feats[learn], minlength=DIMS) >= 2
    keep = often[feats]
    rows, feats = rows[keep], feats[keep]
    ratio = log_count_ratios(rows[~check[rows]], feats[~check[rows]], y, DIMS)
    values = ratio[feats]
    length = np.sqrt(np.bincount(rows, values**2, len(y)))
    values = values / np.maximum(length, 1e-9)[rows]
    use = np.flatnonzero(~check)
    starts = np.searchsorted(rows, np.arange(len(y) + 1))
    own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in use]) if len(use) else np.zeros(0, int)
    bounds = np.append(0, np.cumsum(np.diff(starts)[use]))
    w = hinge_dual(bounds, feats[own], values[own], np.where(y[use] == 1, 1.0, -1.0), np.full(len(use), cost), DIMS + 1)
    margin = np.bincount(rows, w[:-1][feats] * values, len(y)) + w[-1]
    on = check if check.any() else ~check
    slope, offset = _calibrate(margin[on], y[on].astype(float), table["weight"].to_numpy()[on])
    return np.stack([ratio * often, ratio * often * w[:-1] * slope]), w[-1] * slope + offset


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    kernel.small_batches(spark)
    shared = spark.sparkContext.broadcast((np.asarray(model[0], np.float32), float(model[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, intercept = shared.value
        ratio, pull = weight if weight.ndim == 2 else (weight, weight)
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                pairs = _features(part)
                rows, feats = pairs // DIMS, pairs % DIMS
                length = np.sqrt(np.bincount(rows, ratio[feats].astype(float) ** 2, part.rows))
                margin = intercept + np.bincount(rows, pull[feats], part.rows) / np.maximum(length, 1e-9)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(part.first, part.rows), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows aren't learned from."""
    model = fit(docs, labels, usable=lambda i: ~held_out(i, 5, 0), **options)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
