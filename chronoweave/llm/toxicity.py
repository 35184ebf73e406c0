"""Counterfactual-regularised toxicity classifier.

A sparse logistic model over hashed words and word beginnings. Each identity term of a labelled text is swapped for every
other term of its kind, and the squared change of the score is penalised, so that naming a group moves no score.
The first stage (features, and the features that each swap takes and brings) runs on the executors; the model is fitted on
the driver from at most ``max_rows`` labelled rows (drawn by a hash of the id, half of them from each class, and put in
order by hashes, so that the model doesn't depend on the layout of the tables), and scoring is one pass without a shuffle.

Defined results: a null or empty text scores as a text without features; a null id is scored and counted as not held
out; labels that are null, of another value than 0 or 1, or repeated in contradiction are ignored; repeated rows are
learned from by their number; without rows of both classes every score is the share of toxic rows (0 without any).
Columns beside the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BITS = 18
MAX_ROWS = 6000
PREFIXES = (4, 5, 6)
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True

#: Neutral mentions of groups in English, German, French and Spanish, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = tuple(
    tuple(kind.split())
    for kind in (
        "women men",
        "woman man",
        "female male",
        "girls boys",
        "christian muslim jewish hindu buddhist atheist",
        "christians muslims jews hindus buddhists atheists",
        "black white asian latino hispanic african european",
        "gay lesbian bisexual transgender queer straight",
        "immigrant refugee foreigner citizen",
        "immigrants refugees foreigners citizens",
        "old young",
        "deaf blind disabled",
        "frauen männer",
        "frau mann",
        "weiblich männlich",
        "christ muslim jude hindu buddhist atheist",
        "christen muslime juden hindus buddhisten atheisten",
        "christliche muslimische jüdische hinduistische buddhistische atheistische",
        "schwarze weiße asiatische afrikanische europäische",
        "schwul lesbisch bisexuell heterosexuell",
        "einwanderer flüchtling ausländer bürger",
        "flüchtlinge migranten einwohner touristen",
        "gehörlose blinde behinderte",
        "femmes hommes",
        "femme homme",
        "chrétien musulman juif hindou bouddhiste athée",
        "chrétiens musulmans juifs hindous bouddhistes athées",
        "noirs blancs asiatiques africains européens",
        "gay lesbienne bisexuel hétérosexuel",
        "immigré réfugié étranger citoyen",
        "immigrés réfugiés étrangers citoyens",
        "sourds aveugles handicapés",
        "mujeres hombres",
        "mujer hombre",
        "cristiano musulmán judío hindú budista ateo",
        "cristianos musulmanes judíos hindúes budistas ateos",
        "negros blancos asiáticos africanos europeos",
        "gay lesbiana bisexual heterosexual",
        "inmigrante refugiado extranjero ciudadano",
        "inmigrantes refugiados extranjeros ciudadanos",
        "sordos ciegos discapacitados",
    )
)


def _features(part: kernel.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of every token and word beginning, then row and word hash of every token."""
    part.prepare(kernel.LOWER[part.data])
    start, end, first = part.spans(LETTERS[part.data])
    rows = kernel.row_of(first)
    words = part.span_hash(start, end)
    at, found = [rows], [words]
    for k, n in enumerate(PREFIXES, 1):
        long = end - start >= n
        at.append(rows[long])
        found.append(part.span_hash(start[long], start[long] + n, k))
    return np.concatenate(at), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), rows, words


def _terms(kinds: tuple) -> tuple[np.ndarray, list[np.ndarray], list[list[int]]]:
    """Word hash and features of every identity term, and the numbers of the terms that it is swapped for. A word of several kinds has those of all."""
    names = list(dict.fromkeys(t for kind in kinds for t in kind))
    place = {t: k for k, t in enumerate(names)}
    swaps = [sorted({place[o] for kind in kinds if t in kind for o in kind if o != t}) for t in names]
    hashes, features = [], []
    for part in kernel.chunks(pa.array(names, pa.string())):
        at, f, _, words = _features(part)
        for r in range(part.rows):
            features.append(np.unique(f[at == r]))
            hashes.append(words[r])
    return np.array(hashes, dtype=np.uint64), features, swaps


#: Swaps of a row that are learned from; of more, every so many-th is.
MAX_SWAPS = 64
SWAPS = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))]))


def _extract(kinds: tuple):
    """Features of a text, and of each of its swaps the features that it takes and brings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, features, others = _terms(kinds)
        order = np.argsort(hashes)
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                at, f, rows, words = _features(part)
                pairs, times = np.unique(at << BITS | f, return_counts=True)
                cut = np.searchsorted(pairs, np.arange(part.rows + 1) << BITS)
                swaps: list[list[dict]] = [[] for _ in range(part.rows)]
                if len(order) and len(words):
                    spot = np.minimum(np.searchsorted(hashes[order], words), len(order) - 1)
                    hit = hashes[order][spot] == words
                    mentions, uses = np.unique(rows[hit] << 16 | order[spot[hit]], return_counts=True)
                    for m, n in zip(mentions.tolist(), uses.tolist(), strict=True):
                        r, term = m >> 16, m & 0xFFFF
                        own = pairs[cut[r] : cut[r + 1]] & (1 << BITS) - 1
                        had = dict(zip(own.tolist(), times[cut[r] : cut[r + 1]].tolist(), strict=True))
                        lost = {x for x in features[term].tolist() if had[x] <= n}
                        for o in others[term]:
                            new = set(features[o].tolist())
                            swaps[r].append({"lost": sorted(lost - new), "gained": sorted(x for x in new if x not in had)})
                swaps = [own[:: -(-len(own) // MAX_SWAPS)] if own else own for own in swaps]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch[c].slice(part.first, part.rows) for c in ("o1", "o2", "label", "weight")),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs & (1 << BITS) - 1, pa.int32())),
                        pa.array(swaps, SWAPS),
                    ],
                    names=["o1", "o2", "label", "weight", "features", "swaps"],
                )

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(o1, o2, text, label, weight) of ``max_rows`` rows at most: of about so many labelled ids, half from each class, by a hash of the id, each different text once.

    Weight undoes the drawing and counts repeated rows; o1, o2 (hashes of id and text) put rows in an order, and the first of that order are taken where ids have
    more texts than fit.
    """
    truth = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & usable(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .where("label = _other")
        .drop("_other")
    )
    n = {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()}
    share = {c: min(1.0, max_rows / 2 / max(1, n.get(c, 0))) for c in (0, 1)}
    drawn = F.pmod(F.xxhash64(F.lit(77), "_id"), F.lit(1_000_000)) < F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])) * 1_000_000
    some = truth.where(drawn).withColumn("weight", F.when(F.col("label") == 1, F.lit(1 / share[1])).otherwise(F.lit(1 / share[0])))
    if some.count() <= 2 * max_rows:  # ids of some 20 bytes
        some = F.broadcast(some)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(some, "_id")
    rows = rows.select(F.xxhash64(F.lit(78), "_id").alias("o1"), F.xxhash64("text").alias("o2"), "text", "label", "weight")
    once = rows.groupBy("o1", "o2", "label").agg(F.first("text").alias("text"), F.sum("weight").alias("weight"))
    return once.select("o1", "o2", "text", "label", "weight").orderBy(F.xxhash64("o1", "o2"), "o1", "o2", "label").limit(max_rows).repartition(16, "o1")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable=lambda i: F.lit(True), max_rows: int = MAX_ROWS, kinds: tuple = IDENTITY_TERMS, l1: float = 5e-5, invariance: float = 5.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights by feature and the intercept."""
    kernel.small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, usable, max_rows)
    table = rows.mapInArrow(_extract(kinds), "o1 long, o2 long, label int, weight double, features array<int>, swaps array<struct<lost:array<int>,gained:array<int>>>").toArrow()
    return solve(table.sort_by([("o1", "ascending"), ("o2", "ascending"), ("label", "ascending")]), l1, invariance, steps)


def solve(table: pa.Table, l1: float, invariance: float, steps: int) -> tuple[np.ndarray, float]:
    """Minimise the mean log loss, plus ``l1`` times the absolute weights, plus ``invariance`` times the mean squared change of the score by a row's swaps."""
    y = table["label"].to_numpy().astype(float)
    weight = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return weight, float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    lists = table["features"].combine_chunks()
    rows_at, feats = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    # Screening: features whose share differs between the classes by over two standard errors.
    n1, n0 = y.sum(), (1 - y).sum()
    in1, in0 = np.bincount(feats, y[rows_at], 1 << BITS), np.bincount(feats, 1 - y[rows_at], 1 << BITS)
    p = (in1 + in0) / (n1 + n0)
    z = (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((np.abs(z) > 2) & (in1 + in0 >= 2))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[feats] >= 0
    rows_at, cols = rows_at[keep], place[feats[keep]]
    mass = table["weight"].to_numpy()
    mass = mass / mass.sum()
    # Swaps: the row that each is of, and the features that it moves by +1 or -1.
    swaps = table["swaps"].combine_chunks()
    per_row = np.diff(swaps.offsets.to_numpy())
    of_row, swaps = np.repeat(np.arange(len(y)), per_row), swaps.flatten()
    share = invariance * (mass / np.maximum(per_row, 1))[of_row]
    moved, moved_cols, sign = [], [], []
    for field, by in (("lost", -1.0), ("gained", 1.0)):
        values = swaps.field(field)
        at, f = np.repeat(np.arange(len(of_row)), np.diff(values.offsets.to_numpy())), place[values.flatten().to_numpy()]
        moved.append(at[f >= 0]), moved_cols.append(f[f >= 0]), sign.append(np.full(int((f >= 0).sum()), by))
    moved, moved_cols, sign = np.concatenate(moved), np.concatenate(moved_cols), np.concatenate(sign)

    def margins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows, and of rows after each swap."""
        own = x[-1] + np.bincount(rows_at, x[:-1][cols], len(y))
        return own, own[of_row] + np.bincount(moved, sign * x[:-1][moved_cols], len(of_row))

    def pulled(own: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The gradient of the weights from those of the two margins."""
        own = own + np.bincount(of_row, after, len(y))
        return np.append(np.bincount(cols, own[rows_at], len(chosen)) + np.bincount(moved_cols, sign * after[moved], len(chosen)), own.sum())

    def chance(margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    # Power iterations bound the curvature: a logistic curve's slope is 1/4 at most, its bend under 0.1.
    probe, curvature = np.ones(len(chosen) + 1), 1.0
    for _ in range(12):
        probe = probe / np.linalg.norm(probe)
        own, after = margins(probe)
        bend = 0.45 * share
        probe = pulled(mass * own / 4 + np.bincount(of_row, bend * own[of_row], len(y)), bend * after)
        curvature = float(np.linalg.norm(probe))
    # Accelerated proximal gradient.
    step = 1 / (1.1 * curvature + 1e-9)
    x = np.zeros(len(chosen) + 1)
    last, momentum = x.copy(), 1.0
    for _ in range(steps):
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at = x + (momentum - 1) / ahead * (x - last)
        last, momentum = x, ahead
        own, after = (chance(m) for m in margins(at))
        change = 2 * share * (own[of_row] - after)
        by_row = mass * (own - y) + np.bincount(of_row, change * own[of_row] * (1 - own[of_row]), len(y))
        x = at - step * pulled(by_row, -change * after * (1 - after))
        x[:-1] = np.sign(x[:-1]) * np.maximum(np.abs(x[:-1]) - step * l1, 0)
    weight[chosen] = x[:-1]
    return weight, float(x[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, score) of every row; version is a hash of the text, score the estimated chance of label 1."""
    spark = docs.sparkSession
    kernel.small_batches(spark)
    shared = spark.sparkContext.broadcast((np.asarray(model[0], np.float32), float(model[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, intercept = shared.value
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                at, f, _, _ = _features(part)
                live = weight[f] != 0
                pairs = np.unique(at[live] << BITS | f[live])
                margin = intercept + np.bincount(pairs >> BITS, weight[pairs & (1 << BITS) - 1], part.rows)
                own = (batch[c].slice(part.first, part.rows) for c in ("doc_id", "version"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], names=["doc_id", "version", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, version long, score double")


def held_out(column, parts: int, which: int):
    """True where crc32 of the id as text leaves ``which`` modulo ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(column.cast("string")) % parts == which, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows aren't learned from."""
    model = fit(docs, labels, usable=lambda i: ~held_out(i, 4, 2), **options)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
