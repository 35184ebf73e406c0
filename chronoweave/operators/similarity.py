"""Nearest centroids and average-linkage grouping of vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.sources import tables

#: Clusters of a key that are dealt into one block, and distances that are looked at together.
BLOCK, DISTANCES = 8192, 1 << 20


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label; components are averaged as rows, so a label of any size is partially aggregated."""
    parts = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centroid"))


def assign(df: DataFrame, id_col: str, vector: str, centres: DataFrame, label: str, limit: int = 10_000) -> DataFrame:
    """The centroid of highest cosine for every row, the smallest label on a tie: id, label, similarity; both null for a null vector or without centres. Centres are few by nature; more than ``limit`` is an error."""
    rows = centres.orderBy(label).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} centres")
    names, matrix = [r[label] for r in rows], np.array([r["centroid"] for r in rows], dtype=float).reshape(len(rows), -1)
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    kind = dict(centres.dtypes)[label]

    def run(batches):
        for b in batches:
            known = b[vector].notna().to_numpy() & bool(names)
            found, near = np.full(len(b), None, object), np.full(len(b), None, object)
            if known.any():
                x = np.stack(b[vector].to_numpy()[known]).astype(float)
                s = x @ matrix.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                best = s.argmax(1)
                found[known], near[known] = np.array(names, object)[best], s[np.arange(len(s)), best]
            yield pd.DataFrame({id_col: b[id_col], label: found, "similarity": pd.Series(near, dtype="Float64")})

    return df.select(id_col, vector).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, {label} {kind}, similarity double")


def average_linkage(x: np.ndarray, limit: float, number: int | None = None) -> np.ndarray:
    """Cluster numbers by first member: clusters whose mean cosine distance is at most ``limit`` are joined, nearest first; with a ``number``, joins go on until so many are left (or fewer, where joins are of one distance), whatever the limit.

    Chains of nearest neighbours: a cluster and its nearest are joined once each is the other's nearest. With mean distances no later join
    brings anything nearer, so these are the joins of always taking the nearest pair, in quadratic time; they are then taken by distance.
    """
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return _joined(unit, np.ones(len(x)), limit, number)


def _joined(x: np.ndarray, size: np.ndarray, limit: float, number: int | None = None) -> np.ndarray:
    """``average_linkage`` of clusters, each with the mean of its rows of unit length and its size, which this changes."""
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    joins: list[tuple[float, int, int]] = []
    alive, chain = np.ones(len(x), bool), []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        j = int(d[i].argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        if number is None and d[i, j] > limit:
            # Nearest to each other and too far apart: neither will be joined, but both still count as others' distances.
            alive[[i, j]] = False
            d[i] = d[:, i] = d[j] = d[:, j] = np.inf
            continue
        joins.append((float(d[i, j]), i, j))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
    root, left, reached = np.arange(len(x)), len(x), -np.inf
    for far, i, j in sorted(joins):
        if number is not None and left <= number and far > reached:
            break
        i, j = sorted((root[i], root[j]))
        root[root == j] = i
        left, reached = left - 1, far
    return np.unique(root, return_inverse=True)[1]


def grouped(df: DataFrame, keys: list[str], id_col: str, vector: str, limit: float, most: int = 1500, number: int | None = None, means: str = "all") -> DataFrame:
    """Average-linkage groups within a key: keys, id, cluster.

    A key of over ``most`` rows is grouped by every n-th of them (by id), ``most`` at most, and each of its rows then goes to the group whose mean
    vector is nearest, the smallest number on a tie; so no group of rows is larger than ``most``. Rows without a vector have no cluster. With a
    ``number``, that many groups instead of a ``limit``. With ``means`` "sample" only the rows that were grouped are returned.
    """
    kinds = dict(df.dtypes)
    w = Window.partitionBy(*keys).orderBy(id_col)
    known = df.select(*keys, id_col, vector).where(F.col(vector).isNotNull())
    rows = known.withColumn("_at", F.row_number().over(w) - 1).withColumn("_step", F.ceil(F.count("*").over(Window.partitionBy(*keys)) / most))
    drawn = rows.where("_at % _step = 0")

    def clusters(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks()
        if not whole.num_rows:
            return
        x = whole.column(vector).chunk(0)
        ends = np.cumsum(x.value_lengths().to_numpy())
        vectors = np.split(x.flatten().to_numpy(zero_copy_only=False).astype(float), ends[:-1])
        firsts = [*np.flatnonzero(whole.column("_at").to_numpy() == 0).tolist(), len(vectors)]
        found = [average_linkage(np.stack(vectors[a:z]), limit, number) for a, z in itertools.pairwise(firsts)]
        yield from whole.append_column("cluster", pa.array(np.concatenate(found).astype("int64"))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many keys a batch, as most are small; the key that a batch ends in waits for the next batch. A key's first row is always drawn."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            firsts = np.flatnonzero(batch.column("_at").to_numpy() == 0)
            if len(firsts):
                last = int(firsts[-1])
                yield from clusters([*waiting, batch.slice(0, last)])
                waiting, batch = [], batch.slice(last)
            waiting.append(batch)
        if waiting:
            yield from clusters(waiting)

    # The windows have dealt the rows by their keys.
    found = drawn.sortWithinPartitions(*keys, id_col).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, id_col, vector]) + ", _at int, _step long, cluster long")
    if means == "sample":
        return found.select(*keys, id_col, "cluster")
    means = found.where("_step > 1").select(*keys, "cluster", F.posexplode(vector).alias("i", "v")).groupBy(*keys, "cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = means.groupBy(*keys, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))

    def nearest(part: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        # By cluster, so that the first best is the smallest number.
        groups = groups.sort_values("cluster", ignore_index=True)
        if not len(part) or not len(groups):
            return part[[*keys, id_col]].head(0).assign(cluster=0)
        x, m = (np.stack(v.to_numpy()).astype(float) for v in (part[vector], groups["m"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.einsum("ik,jk->ij", x, m) / np.sqrt(np.einsum("ik,ik->i", x, x)[:, None] * np.einsum("jk,jk->j", m, m))
        return part[[*keys, id_col]].assign(cluster=groups["cluster"].to_numpy()[s.argmax(1)])

    # A large key is dealt into parts of ``most`` rows, each of which meets the key's means in a task of its own.
    deal = (F.col("_at") % F.col("_step")).cast("long").alias("_deal")
    parts = rows.where("_step > 1").select(*keys, id_col, vector, deal)
    steps = found.where("_step > 1").groupBy(*keys).agg(F.max("_step").alias("_step"))
    dealt = means.join(steps, keys).select(*keys, "cluster", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_step") - 1)).alias("_deal"))
    at = [*keys, "_deal"]
    large = parts.groupBy(*at).cogroup(dealt.groupBy(*at)).applyInPandas(nearest, ", ".join(f"{c} {kinds[c]}" for c in [*keys, id_col]) + ", cluster long")
    out = found.where("_step = 1").select(*keys, id_col, "cluster").unionByName(large)
    return out.unionByName(df.where(F.col(vector).isNull()).select(*keys, id_col, F.lit(None).cast("long").alias("cluster")))


def linked(df: DataFrame, keys: list[str], id_col: str, vector: str, limit: float, most: int = 1500) -> DataFrame:
    """Average-linkage groups of all rows within a key of any size: keys, id, cluster, as ``average_linkage`` numbers them. Rows without a vector have no cluster.

    Keys of up to ``most`` rows are grouped in one task each. In a larger one clusters are joined in rounds: all look for their nearest at once,
    and every two that are each other's nearest are joined. With mean distances no later join brings anything nearer, so these are the joins of
    always taking the nearest pair, and a cluster with nothing within ``limit`` is done. Once ``most`` are left they are grouped in one task.
    The mean distance of two clusters is told by the means of their rows of unit length, so a cluster is one vector and a size; no rows or distances are gathered.
    """
    sizes = df.where(F.col(vector).isNotNull()).groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    large = tables.written(sizes.select(*(f"_k{i}" for i in range(len(keys))), F.monotonically_increasing_id().alias("_g")), "large")
    if large.isEmpty():
        return grouped(df, keys, id_col, vector, limit, most)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    rest = grouped(df.join(large, same, "left_anti"), keys, id_col, vector, limit, most)
    rows = df.select(*keys, id_col, vector).join(large, same).select("_g", *keys, id_col, vector)
    at = F.row_number().over(Window.partitionBy("_g").orderBy(id_col)) - 1
    own = tables.written(rows.where(F.col(vector).isNotNull()).withColumn("_at", at.cast("long")).withColumnRenamed(vector, "_x"), "rows")
    # Copies are at no distance of each other, which nothing is nearer than; vectors of no length are at that of all others.
    length = F.sqrt(F.aggregate(F.col("_x").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
    own_place = F.when((length > 1e-9) & F.lit(limit >= 0), F.lit(-1).cast("long")).otherwise(F.col("_at")).alias("_own")
    copies = own.select("_g", "_at", "_x", own_place).groupBy("_g", "_x", "_own").agg(F.min("_at").alias("_c"), F.count("*").cast("double").alias("_n"))
    copies = tables.written(copies, "copies")
    members = tables.written(own.select("_g", "_at", "_x", own_place).join(copies, ["_g", "_x", "_own"]).select("_g", "_at", "_c"), "members")
    active = tables.written(copies.select("_g", "_c", "_n", F.col("_x").cast("array<double>").alias("_x")).mapInArrow(_units, "_g long, _c long, _n double, _s array<double>"), "clusters")
    tables.drop(copies)
    while True:
        counted = active.join(active.groupBy("_g").agg(F.count("*").alias("_m")), "_g")
        many = counted.where(F.col("_m") > most)
        if many.isEmpty():
            break
        near = tables.written(_nearest(many, limit), "nearest")
        joined = near.where("_both").select("_g", "_c", "_to")
        pair = near.select("_g", "_c", F.when(F.col("_both"), F.col("_to")).otherwise(F.col("_c")).alias("_to")).join(many, ["_g", "_c"]).groupBy("_g", "_to").agg(F.sum("_n").alias("_n"), F.collect_list("_s").alias("_s"))
        total = F.when(F.size("_s") > 1, F.zip_with(F.get("_s", F.lit(0)), F.get("_s", F.lit(1)), lambda a, b: a + b)).otherwise(F.get("_s", F.lit(0)))
        few = counted.where(F.col("_m") <= most).select(*active.columns)
        past = [active, members, near]
        active = tables.written(pair.select("_g", F.col("_to").alias("_c"), "_n", total.alias("_s")).unionByName(few), "clusters")
        members = tables.written(members.join(joined, ["_g", "_c"], "left").select("_g", "_at", F.coalesce("_to", "_c").alias("_c")), "members")
        for table in past:
            tables.drop(table)

    def ended(part: pa.Table) -> pa.Table:
        part = part.sort_by("_c").combine_chunks()
        size, c = part["_n"].to_numpy().copy(), part["_c"].to_numpy()
        found = _joined(_stacked(part["_s"]) / size[:, None], size, limit)
        return pa.table({"_g": part["_g"], "_c": c, "_to": c[np.unique(found, return_index=True)[1]][found]})

    ends = active.groupBy("_g").applyInArrow(ended, "_g long, _c long, _to long")
    members = tables.written(members.join(ends, ["_g", "_c"], "left").select("_g", "_at", F.coalesce("_to", "_c").alias("_c")), "members")
    # A cluster is named by its first row.
    numbers = members.where("_at = _c").select("_g", "_c", (F.row_number().over(Window.partitionBy("_g").orderBy("_c")) - 1).cast("long").alias("cluster"))
    out = own.join(members.join(numbers, ["_g", "_c"]), ["_g", "_at"]).select(*keys, id_col, "cluster")
    return rest.unionByName(out).unionByName(rows.where(F.col(vector).isNull()).select(*keys, id_col, F.lit(None).cast("long").alias("cluster")))


def _stacked(vectors: pa.ChunkedArray) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums ``_s`` of ``_n`` equal vectors of unit length."""
    for batch in batches:
        x = batch.column("_x")
        row, v = np.repeat(np.arange(len(batch)), x.value_lengths().to_numpy()), x.flatten().to_numpy(zero_copy_only=False)
        scale = batch.column("_n").to_numpy() / np.maximum(np.sqrt(np.bincount(row, v * v, len(batch))), 1e-12)
        s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(x.value_lengths().to_numpy())), pa.int32()), pa.array(v * scale[row]))
        yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_c"), batch.column("_n"), s], ["_g", "_c", "_n", "_s"])


def _nearest(clusters: DataFrame, limit: float) -> DataFrame:
    """The clusters (_g, _c, _n, _s, _m: how many of its key there are) that have another within ``limit``: _g, _c, the smaller name _to of the two and whether both are each other's nearest. Blocks of a key meet in a triangle; of equal distances one counts that a hash of both names tells, so that copies and lattices don't all look to one."""
    deals = clusters.withColumn("_deals", F.ceil(F.col("_m") / BLOCK)).withColumn("_d", F.pmod(F.xxhash64("_c"), F.col("_deals"))).withColumn("_e", F.explode(F.expr("sequence(0L, _deals - 1)")))
    met = deals.select("_g", F.least("_d", "_e").alias("_i"), F.greatest("_d", "_e").alias("_j"), (F.col("_e") < F.col("_d")).alias("_second"), "_c", "_n", "_s")

    def nearest(part: pa.Table) -> pa.Table:
        part = part.sort_by("_c").combine_chunks()
        c, second = part["_c"].to_numpy(), part["_second"].to_numpy()
        x = _stacked(part["_s"]) / part["_n"].to_numpy()[:, None]
        known = np.isfinite(x).all(1)
        diagonal = part["_i"][0] == part["_j"][0]
        one, two = np.flatnonzero(known & ~second), np.flatnonzero(known & (second | diagonal))
        far, order, other = np.full(len(c), np.inf), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)

        def take(at: np.ndarray, to: np.ndarray, d: np.ndarray) -> None:
            """Of the pairs of each row ``at`` the first by distance and hash, if before what it has."""
            mixed = np.minimum(c[at], c[to]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.maximum(c[at], c[to]).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).astype(np.int64)
            first = np.lexsort((mixed, d, at))
            first = first[np.append(True, at[first][1:] != at[first][:-1])] if len(first) else first
            at, to, d, mixed = at[first], to[first], d[first], mixed[first]
            new = (d < far[at]) | ((d == far[at]) & (mixed < order[at]))
            far[at[new]], order[at[new]], other[at[new]] = d[new], mixed[new], c[to[new]]

        step = max(1, DISTANCES // max(1, len(two)))
        for k in range(0, len(one), step):
            a, b = one[k : k + step], two[k:] if diagonal else two
            if not len(b):
                break
            d = 1 - x[a] @ x[b].T
            if diagonal:
                d[np.tri(len(a), len(b), dtype=bool)] = np.inf
            for axis in (1, 0):
                least = d.min(axis)
                i, j = np.nonzero((d == np.expand_dims(least, axis)) & (d <= limit))
                take(*((a[i], b[j]) if axis else (b[j], a[i])), d[i, j])
        found = far <= limit
        return pa.table({"_g": part["_g"].filter(pa.array(found)), "_c": c[found], "_far": far[found], "_order": order[found], "_other": other[found]})

    each = met.groupBy("_g", "_i", "_j").applyInArrow(nearest, "_g long, _c long, _far double, _order long, _other long")
    best = each.groupBy("_g", "_c").agg(F.min(F.struct("_far", "_order", "_other"))["_other"].alias("_other"))
    ends = [F.least("_c", "_other").alias("_to"), F.greatest("_c", "_other").alias("_end")]
    return best.select("_g", "_c", *ends).select("_g", "_c", "_to", (F.count("*").over(Window.partitionBy("_g", "_to", "_end")) > 1).alias("_both"))
