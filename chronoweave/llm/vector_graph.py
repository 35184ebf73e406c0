"""Near duplicates among vectors of one label by a robust-pruned graph over overlapping shards.

Equal vectors of a label are one node with a count. The nodes of a label are split around drawn pivots into cells of at
most ``SHARD`` nodes, again and again where a cell is larger: a node goes to its nearest pivot, its home, and a copy of it to the
second nearest, so cells overlap. In each cell a flat graph is built: the nearest nodes of the cell are candidates, of which a robust
pruning keeps those that no kept one is much nearer to, plus edges back. A node's adjacency list is the union of its lists in all
cells.

Every node is a query. In each of its cells a greedy beam search over the union graph begins at the cell's medoid and
at the query's own node, and from every node in range it goes on to all neighbours that are in range, without a bound on
their number. Where a node in range lies in cells that the query has not been to, the query goes there in the next round and begins at that
node, so that groups which lie across cells are followed to their end. Cosines are computed in double precision; a pair
below the threshold is never linked. A query counts a node only in that node's home, so that none counts twice, and no pair leaves its
cell: a cell hands on counts, one edge a node and the cells to go to. ``audit`` measures the recall by brute force on
drawn queries.

Defined results: rows without a label, and vectors that are null, empty, zero or hold a null or a value that isn't finite, link with
nothing; vectors of different lengths don't link; repeated vectors link with each other; rows without an id count as
links but give no component its name; a row alone is its own component; an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, kernel, store

THRESHOLD = 0.93
#: Most nodes of a cell, pivots that a cell is split around at most, nodes a pivot stands for, and rounds of splitting.
SHARD, FAN, PER_PIVOT, LEVELS = 2048, 256, 512, 12
#: Candidates, kept edges (twice as many with those back), slack of the pruning, and width of the beam.
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 8
#: Rows of a cell, or visitors of one, that a task takes at a time.
BLOCK, VISITORS = 512, 4096
#: Pairs of a query and a node that are looked at together.
STEP = 1 << 13
AUDITED = 500


def _vectors(array: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; a power of two is taken out first, which is exact."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    x = array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(array), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def usable(label: Column, vector: Column) -> Column:
    """Whether a row can link at all."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    label, vector = F.col(label_col), F.col(vector_col)
    return df.select(
        F.col(id_col).cast("long").alias("vec_id"), usable(label, vector).alias("usable"), F.xxhash64(label, vector).alias("k1"), F.xxhash64(F.lit(7), label, vector).alias("k2"),
        F.xxhash64(label, F.size(vector)).alias("root"), F.xxhash64(F.lit(7), label, F.size(vector)).alias("block"), vector.alias("vector"),
    )


def nodes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """node, k1, k2 (hashes of label and vector), root, block (of label and length), vector, copies and least id: one row per different vector of a label."""
    rows = _rows(df, id_col, vector_col, label_col).where("usable")
    found = rows.groupBy("k1", "k2").agg(*(F.first(c).alias(c) for c in ("root", "block", "vector")), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return store.written(found.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _nearest_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (cell, block, salt), pivots first: each row's nearest pivot, and for a home row the second nearest."""
    key, held, pivots, numbers = None, [], None, None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("cell", "block", "salt")])
        change = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)
        for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
            part, now = batch.slice(a, b - a), tuple(keys[:, a])
            if now != key:
                key, held, pivots = now, [], None
            n = int((part["pivot"].to_numpy() >= 0).sum())
            if n:
                held.append(part.slice(0, n))
            part = part.slice(n)
            if not part.num_rows:
                continue
            if pivots is None:
                rows = pa.Table.from_batches(held)
                pivots, numbers = _vectors(rows["vector"]), rows["pivot"].to_numpy()
            for c in range(0, part.num_rows, 4096):
                some = part.slice(c, 4096)
                score = _vectors(some["vector"]) @ pivots.T
                best = score.argmax(1)
                score[np.arange(len(score)), best] = -2
                second = score.argmax(1)
                home = some["home"].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.concat_arrays([some[k], some[k].filter(pa.array(home))]) for k in ("node", "block", "cell")), pa.array(np.append(home, np.zeros(home.sum(), bool))), pa.array(numbers[np.append(best, second[home])])],
                    names=["node", "block", "cell", "home", "pivot"],
                )


def cells(found: DataFrame, shard: int = SHARD, fan: int = FAN, per_pivot: int = PER_PIVOT) -> DataFrame:
    """(node, block, cell, home) of every node in each cell it lies in; cells of over ``shard`` nodes are split until none is left or ``LEVELS`` rounds are done (what is larger then is searched all the same, block by block)."""
    out = found.select("node", "block", F.col("root").alias("cell"), F.lit(True).alias("home"))
    for level in range(LEVELS):
        size = out.groupBy("cell", "block").agg(F.count("*").alias("n")).where(F.col("n") > shard)
        size = store.written(size.withColumn("pivots", F.least(F.lit(fan), F.ceil(F.col("n") / per_pivot)).cast("int")), "large-cells")
        if size.isEmpty():
            return out
        near = out.join(size, ["cell", "block"])
        # About twice the pivots by a hash, then the first of them: no cell is sorted whole.
        chance = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1 << 40)) / float(1 << 40)
        drawn = near.where(chance < 2 * F.col("pivots") / F.col("n")).withColumn("pivot", F.row_number().over(Window.partitionBy("cell", "block").orderBy(F.xxhash64(F.lit(level), "node"))) - 1)
        drawn = drawn.where("pivot < pivots")
        salts = F.ceil(F.col("n") / 50_000)
        rows = near.select("node", "block", "cell", "home", F.lit(-1).alias("pivot"), F.pmod(F.xxhash64("node"), salts).cast("long").alias("salt"))
        pivots = drawn.select("node", "block", "cell", "home", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        known = drawn.groupBy("cell", "block").agg(F.count("*").alias("k")).where("k > 1").select("cell", "block")
        dealt = rows.unionByName(pivots).join(known, ["cell", "block"], "left_semi").join(found.select("node", "vector"), "node")
        dealt = dealt.repartition("cell", "block", "salt").sortWithinPartitions("cell", "block", "salt", F.desc("pivot"))
        split = dealt.mapInArrow(_nearest_pivots, "node long, block long, cell long, home boolean, pivot int")
        split = split.select("node", "block", F.xxhash64("cell", "pivot").alias("cell"), "home")
        out = store.written(out.join(known, ["cell", "block"], "left_anti").select("node", "block", "cell", "home").unionByName(split), "cells")
    return out


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph over unit vectors: ``degree`` of a node's own, and edges back to 2 * ``degree`` in all, beyond it only to nodes that have it among their first two, so that every node can be reached.

    Of a node's nearest ``candidates``, nearest first, one is kept unless a kept one is nearer to it than the node is, ``alpha`` times over.
    """
    n, c = len(x), min(candidates, len(x) - 1)
    if c < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tails, heads, turns = [], [], []
    for a in range(0, n, BLOCK):
        own = x[a : a + BLOCK]
        score = own @ x.T
        score[np.arange(len(own)), a + np.arange(len(own))] = -2
        near = np.argpartition(-score, c - 1, 1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), 1, kind="stable"), 1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(score, near, 1), 0))
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(x[near], x[near].transpose(0, 2, 1)), 0))
        alive, rows = np.ones(near.shape, bool), np.arange(len(own))
        for turn in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            tails.append(a + rows[some]), heads.append(near[rows, pick][some]), turns.append(np.full(int(some.sum()), turn))
            alive &= alpha * between[rows, pick] > far
            alive[rows, pick] = False
    tail, head, turn = (np.concatenate(v) for v in (tails, heads, turns))
    # First a node's own edges, then those back to nodes for which it is among the first two, then the other ones back, near before far.
    both = np.stack([np.append(tail, head), np.append(head, tail), np.append(np.zeros_like(turn), np.where(turn < 2, 1, 2))], 1)
    score = np.einsum("nd,nd->n", x[both[:, 0]], x[both[:, 1]])
    both = both[np.lexsort((-score, both[:, 2], both[:, 0]))]
    _, first = np.unique(both[:, 0] * n + both[:, 1], return_index=True)
    both = both[np.sort(first)]
    begin = np.searchsorted(both[:, 0], np.arange(n))
    both = both[(np.arange(len(both)) - begin[both[:, 0]] < 2 * degree) | (both[:, 2] < 2)]
    return both[:, 0], both[:, 1]


def _lists(index: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """Lists of ``values`` by row number, which is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(index, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _built(degree: int, candidates: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in kernel.sorted_groups(batches, 2):
            node = group["node"].to_numpy()
            tail, head = robust_prune(_vectors(group["vector"]), degree, candidates, alpha)
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists(tail, node[head], len(node))], names=["node", "out"])

    return run


def index(found: DataFrame, shard: int = SHARD, fan: int = FAN, per_pivot: int = PER_PIVOT, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> DataFrame:
    """node, block, vector, copies, home (cell), cells and out (the union of its adjacency lists) of every node."""
    where = store.written(cells(found, shard, fan, per_pivot), "cells")
    members = where.join(found.select("node", "vector"), "node").select("cell", "block", "node", "vector").repartition("cell", "block").sortWithinPartitions("cell", "block", "node")
    lists = store.written(members.mapInArrow(_built(degree, candidates, alpha), "node long, out array<long>"), "graph")
    union = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
    paths = where.groupBy("node").agg(F.collect_set("cell").alias("cells"), F.max(F.when(F.col("home"), F.col("cell"))).alias("home"))
    return store.written(found.select("node", "block", "vector", "copies").join(paths, "node").join(union, "node"), "index")


def _found(x: np.ndarray, out: np.ndarray, query: np.ndarray, starts: np.ndarray, threshold: float, beam: int) -> np.ndarray:
    """Which nodes (columns) are found in range of each query (rows): a beam search from ``starts`` (-1: none), then on from all that is in range."""
    n, q = len(x), len(query)
    rows = np.arange(q)
    seen, hit, done = (np.zeros((q, n), bool) for _ in range(3))
    ids = np.full((q, beam), -1)
    ids[:, : starts.shape[1]] = starts
    for k in range(1, starts.shape[1]):
        ids[:, k][(starts[:, :k] == starts[:, k : k + 1]).any(1)] = -1
    score = np.where(ids >= 0, np.einsum("qd,qbd->qb", query, x[ids]), -2.0)
    at, col = np.nonzero(ids >= 0)
    seen[at, ids[at, col]] = True
    hit[at, ids[at, col]] = score[at, col] >= threshold
    while True:
        open_ = np.where((ids >= 0) & ~done[rows[:, None], ids], score, -3.0)
        best = open_.argmax(1)
        live = np.flatnonzero(open_[rows, best] > -3)
        if not len(live):
            break
        chosen = ids[live, best[live]]
        done[live, chosen] = True
        near = out[chosen]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        at, col = np.nonzero(fresh)
        to = near[at, col]
        s = np.einsum("nd,nd->n", query[live[at]], x[to])
        seen[live[at], to] = True
        hit[live[at], to] = s >= threshold
        more = np.full(near.shape, -2.0)
        more[at, col] = s
        every, ids_of = np.concatenate([score[live], more], 1), np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        top = np.argpartition(-every, beam - 1, 1)[:, :beam]
        score[live], ids[live] = np.take_along_axis(every, top, 1), np.take_along_axis(ids_of, top, 1)
    waiting = [np.stack(np.nonzero(hit & ~done), 1)]
    while waiting:
        pairs = waiting.pop()
        if len(pairs) > STEP:
            waiting.append(pairs[STEP:])
        at, node = pairs[:STEP].T
        near = out[node]
        pick, col = np.nonzero((near >= 0) & ~seen[at[:, None], near])
        pair = np.unique(at[pick] * n + near[pick, col])
        at, node = pair // n, pair % n
        seen[at, node] = True
        close = np.concatenate([np.zeros(0, bool), *(np.einsum("nd,nd->n", query[at[k : k + STEP]], x[node[k : k + STEP]]) >= threshold for k in range(0, len(at), STEP))])
        hit[at[close], node[close]] = True
        if close.any():
            waiting.append(np.stack([at[close], node[close]], 1))
    return hit


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that pairs reach, for each of n numbers."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


COUNT, EDGE, VISIT = range(3)
_OUT = "kind int, a long, b long, n long"


def _searched(threshold: float, beam: int, first: bool):
    """Rows come by (cell, block, salt) with visitors last: counts (node, links in this home), edges (node, root) and visits (node, cell, node to begin at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in kernel.sorted_groups(batches, 3):
            cell = group["cell"][0].as_py()
            member = np.flatnonzero(~group["visitor"].to_numpy())
            guest = member if first else np.flatnonzero(group["visitor"].to_numpy())
            if not len(member) or not len(guest):
                continue
            unit, node = _vectors(group["vector"]), group["node"].to_numpy()
            copies, home, begin = group["copies"].to_numpy(), group["home"].to_numpy(), group["begin"].to_numpy()
            most = max(1, int(np.diff(group["cells"].combine_chunks().offsets.to_numpy()).max()))
            lying = np.full((len(node), most), -1)
            places = group["cells"].combine_chunks()
            size = np.diff(places.offsets.to_numpy())
            lying[np.repeat(np.arange(len(node)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = places.flatten().to_numpy()
            taken = np.arange(most)[None, :] < size[:, None]
            x, own = unit[member], node[member]
            order = np.argsort(own)

            def local(ids: np.ndarray) -> np.ndarray:
                spot = np.minimum(np.searchsorted(own[order], ids), len(own) - 1)
                return np.where(own[order][spot] == ids, order[spot], -1)

            lists = group["out"].combine_chunks().take(pa.array(member))
            size = np.diff(lists.offsets.to_numpy())
            to, frm = local(lists.flatten().to_numpy()), np.repeat(np.arange(len(member)), size)
            frm, to = frm[to >= 0], to[to >= 0]
            place = np.arange(len(frm)) - np.searchsorted(frm, frm)
            out = np.full((len(member), int(place.max(initial=0)) + 1), -1)
            out[frm, place] = to
            medoid = int((x @ x.mean(0)).argmax())
            root = np.arange(len(node))
            visits: list[np.ndarray] = []
            counts = np.zeros(len(node), np.int64)
            pairs: list[np.ndarray] = []
            for a in range(0, len(guest), BLOCK):
                g = guest[a : a + BLOCK]
                starts = np.stack([local(node[g] if first else begin[g]), np.full(len(g), medoid)], 1)
                at, col = np.nonzero(_found(x, out, unit[g], starts, threshold, beam))
                q, y = g[at], member[col]
                q, y = q[node[q] != node[y]], y[node[q] != node[y]]
                # Of two members a link that one of them finds is of both.
                pairs.append(np.minimum(q, y) * len(node) + np.maximum(q, y) if first else q * len(node) + y)
            pair = np.unique(np.concatenate(pairs))
            for a in range(0, len(pair), 1 << 18):
                q, y = pair[a : a + (1 << 18)] // len(node), pair[a : a + (1 << 18)] % len(node)
                root = _roots(len(node), q, y, root)
                if first:
                    q, y = np.append(q, y), np.append(y, q)
                at_home = home[y] == cell
                np.add.at(counts, q[at_home], copies[y[at_home]])
                visits.append(_visits(q, y, cell, home, lying, taken, node, first))
            linked = np.flatnonzero(counts)
            joined = np.flatnonzero(root != np.arange(len(node)))
            visit = np.concatenate([np.zeros((0, 3), np.int64), *visits])
            rows = np.concatenate([
                np.stack([np.full(len(linked), COUNT), node[linked], np.zeros(len(linked), np.int64), counts[linked]], 1),
                np.stack([np.full(len(joined), EDGE), node[joined], node[root[joined]], np.zeros(len(joined), np.int64)], 1),
                np.column_stack([np.full(len(visit), VISIT), visit]),
            ])
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0], pa.int32()), *(pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3))], names=["kind", "a", "b", "n"])

    return run


def _visits(q: np.ndarray, y: np.ndarray, cell: int, home: np.ndarray, lying: np.ndarray, taken: np.ndarray, node: np.ndarray, first: bool) -> np.ndarray:
    """(node, cell to go on to, node to begin at) after the links q to y: the cells of y that q doesn't lie in, and for a visitor q its home to y."""
    new = []
    for k in range(lying.shape[1]):
        to = lying[y, k]
        go = taken[y, k] & (to != cell) & ~((lying[q] == to[:, None]) & taken[q]).any(1)
        new.append(np.stack([node[q[go]], to[go], node[y[go]]], 1))
    if not first:
        back = ~((lying[y] == home[q][:, None]) & taken[y]).any(1)
        new.append(np.stack([node[y[back]], home[q[back]], node[q[back]]], 1))
    found = np.concatenate(new)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[keep]


def search(table: DataFrame, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """Counts (node, n) of links to other nodes' rows, and edges (a, b) that connect what links connect, from an ``index``."""
    columns = ("cell", "block", "salt", "visitor", "node", "vector", "copies", "home", "cells", "out", "begin")
    members = table.select("*", F.explode("cells").alias("cell"), F.lit(False).alias("visitor"), F.lit(-1).cast("long").alias("begin"))

    def round_(rows: DataFrame, first: bool) -> DataFrame:
        dealt = rows.select(*columns).repartition("cell", "block", "salt").sortWithinPartitions("cell", "block", "salt", "visitor", "node")
        return store.written(dealt.mapInArrow(_searched(threshold, beam, first), _OUT), "links")

    outs = [round_(members.withColumn("salt", F.lit(0).cast("long")), True)]
    been = table.select(F.col("node").alias("a"), F.explode("cells").alias("b"))
    while True:
        go = outs[-1].where(F.col("kind") == VISIT).groupBy("a", "b").agg(F.min("n").alias("begin")).join(been, ["a", "b"], "left_anti")
        go = store.written(go, "visits")
        if go.isEmpty():
            break
        been = been.unionByName(go.select("a", "b"))
        per_cell = go.groupBy("b").agg(F.ceil(F.count("*") / VISITORS).alias("salts"))
        guests = table.drop("cells", "out").join(go.withColumnRenamed("a", "node"), "node").join(per_cell, "b")
        guests = guests.join(table.select("node", "cells"), "node").select(
            "*", F.col("b").alias("cell"), F.lit(True).alias("visitor"), F.array().cast("array<long>").alias("out"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("long").alias("salt")
        )
        hosts = members.join(per_cell.withColumnRenamed("b", "cell"), "cell").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        outs.append(round_(hosts.select(*columns).unionByName(guests.select(*columns)), False))
    every = outs[0]
    for o in outs[1:]:
        every = every.unionByName(o)
    counts = every.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    return counts, every.where(F.col("kind") == EDGE).select("a", "b")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", beam: int = BEAM, **shape) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; ``shape`` goes to ``index``."""
    found = nodes(df, id_col, vector_col, label_col)
    counts, edges = search(index(found, **shape), threshold, beam)
    group = graph.components(edges).withColumnRenamed("component", "top")
    info = found.select("node", "k1", "k2", "copies", "least").join(counts, "node", "left").join(group, "node", "left").withColumn("top", F.coalesce("top", "node"))
    info = store.written(info, "linked")
    least = info.groupBy("top").agg(F.min("least").alias("component_id"))
    info = info.join(least, "top").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = _rows(df, id_col, vector_col, label_col).select("vec_id", "k1", "k2", "usable")
    own = rows.where("usable").join(info, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(df: DataFrame, linked: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[int, int]:
    """(links found, links there are) of some ``queries`` rows, drawn by a hash of the id and compared with all rows."""
    rows = _rows(df, id_col, vector_col, label_col).where("usable and vec_id is not null").select("vec_id", "block", "root", "vector")
    share = queries / max(1, rows.count())
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * queries).toArrow()
    if not drawn.num_rows:
        return 0, 0
    blocks, ids = drawn["block"].to_numpy(), drawn["vec_id"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast({b: _vectors(drawn.filter(pa.array(blocks == b))["vector"]) for b in set(blocks.tolist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {b: np.zeros(len(x), np.int64) for b, x in shared.value.items()}
        for batch in batches:
            at = batch["block"].to_numpy()
            for b, x in shared.value.items():
                if (at == b).any():
                    n[b] += (_vectors(batch["vector"].filter(pa.array(at == b))) @ x.T >= threshold).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([x.tolist() for x in n.values()], pa.list_(pa.int64()))], names=["block", "n"])

    every = _rows(df, id_col, vector_col, label_col).where("usable").select("block", "vector")
    truth = {b: 0 for b in shared.value}
    for r in every.mapInArrow(run, "block long, n array<long>").select("block", F.posexplode("n").alias("i", "n")).groupBy("block").agg(F.sum("n").alias("n")).collect():
        truth[r["block"]] = r["n"]
    names = df.sparkSession.createDataFrame([(int(i),) for i in set(ids.tolist())], "vec_id long")
    got = linked.join(F.broadcast(names), "vec_id").agg(F.sum("n_links").alias("n")).first()["n"]
    return int(got or 0), sum(truth.values()) - len(ids)
