"""Exact n-gram Jaccard join over whole texts by count vectors.

A text's set are its distinct word shingles. Tokens (shingles) are hashed into groups; the counts per group are the
text's point. Two sets that link differ in so few shingles that, when their sets are split into one more group than that,
some group holds the very same shingles in both. The index is therefore sharded by the content of a group (the root of
the tree: size class, group number, hash of the group's shingles), and inside a shard an R-tree over count vectors bounds the overlap
of a pair by the sum of the smaller coordinates; what survives the bound is verified on the sets themselves.

Equal sets are one node from the start. Inside a shard, members are first held against the shard's leader, then those apart from it against a few drawn ones;
only the shards of a leader whose members still lie in several components go through the tree, and there only pairs
across components are compared. That leaves no link between different texts out and makes no pairs within a group of copies.

Memory: the members of a leader are dealt into tiles of about ``TILE`` by a hash, and each pair of tiles is one group of rows.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing (its component is
its own id); a row without an id links like any other, so it can tie others together, and its component is null only if no
row of it has an id; rows that repeat an id each get a row; repeated texts are one node, however often they stand; with
fewer words than ``width`` the whole sequence is the one shingle. Shingles are compared by 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, kernel, store

RATIO = 1.5
LEAST_BITS, MOST_BITS, PER_DIM = 9, 15, 2
#: Points of a leaf of the tree, and boxes of a box.
LEAF, FANOUT = 32, 8
TILE = 2048
SALT = 4096
PIVOTS = 4


def least_overlap(a, b, percent: int):
    """Smallest intersection with which sets of a and b members link."""
    return -(-percent * (a + b) // (100 + percent))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(RATIO) + 1e-9).astype(np.int64)


def groups_of(size_class: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many filled groups are needed (one more than the sets may differ in when the smaller is of this size class), and how many groups there are."""
    most = np.ceil(RATIO ** (size_class + 1.0)).astype(np.int64)
    need = (100 - percent) * most // percent + 1
    return need, np.where(need == 1, 1, need + need // 16 + 2)


def sets(part: kernel.Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), distinct and sorted, of all rows of a chunk."""
    part.prepare(kernel.LOWER[part.data])
    start, end, first = part.spans(~kernel.WHITE[part.data])
    rows = kernel.row_of(first)
    words = part.span_hash(start, end)
    with np.errstate(over="ignore"):
        at, found = [], []
        if len(words) >= width:
            whole = rows[width - 1 :] == rows[: len(rows) - width + 1]
            h = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                h = kernel.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k])
            at.append(rows[: len(h)][whole])
            found.append(h[whole])
        counts = np.diff(first)
        for r in np.flatnonzero((counts > 0) & (counts < width)):
            h = np.uint64(counts[r])
            for w in words[first[r] : first[r + 1]]:
                h = kernel.mix(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            at.append(np.array([r]))
            found.append(np.array([h], np.uint64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, found = np.concatenate(at), np.concatenate(found)
    order = np.lexsort((found, at))
    at, found = at[order], found[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (found[1:] != found[:-1])
    return at[new], found[new]


def _node(at: np.ndarray, h: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """64-bit identity of each row's set: an order-free sum of its mixed hashes."""
    total = np.zeros(rows, np.uint64)
    np.add.at(total, at, kernel.mix(h + np.uint64(salt * 0x1234567890ABCDEF & 0xFFFFFFFFFFFFFFFF)))
    return kernel.mix(total + np.bincount(at, minlength=rows).astype(np.uint64)).view(np.int64)


def _describe(width: int, salt: int):
    """doc_id, version (a hash of the text), size, identity of the set, and a second one to tell collisions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                at, h = sets(part, width)
                n = np.bincount(at, minlength=part.rows)
                own = (batch[c].slice(part.first, part.rows) for c in ("doc_id", "version"))
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n, pa.int64()), pa.array(_node(at, h, part.rows, salt)), pa.array(_node(at, h, part.rows, salt + 101))],
                    names=["doc_id", "version", "n", "node", "check"],
                )

    return run


def _shards(width: int, percent: int, salt: int):
    """(shard, node) rows: one per filled group, in the size class of the set and in the one below if the set can be the larger of a pair there.

    Agreeing on empty groups alone is possible only for two sets with fewer filled groups than needed; those also stand
    in the shards of their empty groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                at, h = sets(part, width)
                n = np.bincount(at, minlength=part.rows)
                node = _node(at, h, part.rows, salt)
                own = size_class(np.maximum(n, 1))
                for below in (0, 1):
                    cls = own - below
                    fits = (n > 0) & (cls >= 0)
                    if below:
                        fits &= percent * n <= 100 * np.ceil(RATIO ** (cls + 1.0))
                    need, groups = groups_of(cls, percent)
                    groups = np.where(fits, groups, 0)
                    take = fits[at]
                    a, x = at[take], h[take]
                    if not len(a):
                        continue
                    base = np.append(0, np.cumsum(groups))
                    slot = base[a] + (x % groups[a].astype(np.uint64)).astype(np.int64)
                    key = np.zeros(base[-1], np.uint64)
                    np.add.at(key, slot, kernel.mix(x + np.uint64(0x51ED270B)))
                    filled = np.bincount(slot, minlength=base[-1]) > 0
                    row = np.repeat(np.arange(part.rows), groups)
                    number = np.arange(base[-1]) - base[row]
                    key = kernel.mix(key + kernel.mix((cls[row] << 40 | number).astype(np.uint64)) * np.uint64(3))
                    short = np.bincount(row, filled, part.rows) < need
                    keep = filled | short[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(node[row[keep]])], names=["shard", "node"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, node) -> shard, node, leader for shards of two different nodes or more; the leader is the shard's first node."""
    last_shard = last_node = leader = 0
    begun, told = False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        s, v = batch["shard"].to_numpy(), batch["node"].to_numpy()
        new_shard = np.append(not begun or s[0] != last_shard, s[1:] != s[:-1])
        new = new_shard | np.append(not begun or v[0] != last_node, v[1:] != v[:-1])
        first = np.where(new_shard, np.arange(len(s)), -1)
        first = np.maximum.accumulate(first)
        lead = np.where(first >= 0, v[np.maximum(first, 0)], leader)
        other = new & ~new_shard  # a further node of its shard
        out_s, out_v, out_l = s[other], v[other], lead[other]
        # The leader's own row, once per shard that has a further node.
        heads = np.ones(len(out_s), bool)
        heads[1:] = out_s[1:] != out_s[:-1]
        if len(out_s) and begun and out_s[0] == last_shard and told:
            heads[0] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([out_s, out_s[heads]])), pa.array(np.concatenate([out_v, out_l[heads]])), pa.array(np.concatenate([out_l, out_l[heads]]))],
            names=["shard", "node", "leader"],
        )
        told = bool((other & (s == s[-1])).any()) or (told and begun and bool(s[-1] == last_shard))
        last_shard, last_node, leader, begun = s[-1], v[-1], lead[-1], True


def _contents(width: int, salt: int):
    """text -> node, size, count vector and the set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                at, h = sets(part, width)
                n = np.bincount(at, minlength=part.rows)
                bits = vector_bits(n)
                base = np.append(0, np.cumsum(1 << bits))
                slot = base[at] + (h >> (64 - bits[at]).astype(np.uint64)).astype(np.int64)
                vectors = np.bincount(slot, minlength=base[-1])
                vectors = np.minimum(vectors, 255).astype(np.uint8)
                cut = np.append(0, np.cumsum(n))
                own = h.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_node(at, h, part.rows, salt)),
                        pa.array(n, pa.int64()),
                        pa.array([vectors[a:b].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)], pa.binary()),
                        pa.array([own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    names=["node", "n", "vec", "members"],
                )

    return run


def vector_bits(n: np.ndarray) -> np.ndarray:
    """Dimensions of a set's count vector, as a power of two: about one to PER_DIM members, so that chance overlap stays below the bound at any size."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / PER_DIM)), LEAST_BITS, MOST_BITS).astype(np.int64)


def _points(column, width: int | None = None) -> np.ndarray:
    """Count vectors of a binary column, folded to the narrowest (groups are leading bits of hashes, so neighbours add up).

    Counts stop at 255; what a set has beyond that is its size less the sum, and counts as overlap in bounds.
    """
    raw = column.to_pylist()
    sizes = np.array([len(b) for b in raw])
    width = width or int(sizes.min())
    out = np.empty((len(raw), width), np.uint16)
    for size in np.unique(sizes):
        where = np.flatnonzero(sizes == size)
        own = np.frombuffer(b"".join([raw[k] for k in where]), np.uint8).reshape(len(where), width, -1)
        out[where] = own.sum(2, dtype=np.uint16)
    return out


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            bits = vector_bits(np.minimum(na, nb))
            keep = np.zeros(len(na), bool)
            for w in np.unique(bits):
                where = np.flatnonzero(bits == w)
                va, vb = (_points(batch[c].take(pa.array(where)), 1 << int(w)) for c in ("va", "vb"))
                bound = np.minimum(va, vb).sum(1, dtype=np.int64) + np.minimum(na[where] - va.sum(1, dtype=np.int64), nb[where] - vb.sum(1, dtype=np.int64))
                keep[where] = bound >= least_overlap(na[where], nb[where], percent)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    return run


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose summed coordinate minima reach the least overlap."""
    v = nodes.select("node", "n", "vec")
    both = pairs.join(v.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va")), "a").join(v.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb")), "b")
    both = both.where(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(_bounded(percent), "a long, b long")


def _compare(percent: int):
    """Rows sorted by a, salt and role: the set of a, then those of its partners. Passes pairs on that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            out_a, out_b = [], []
            for a, role, b, members in zip(*(batch[c].to_pylist() for c in ("a", "role", "b", "members")), strict=True):
                own = np.frombuffer(members, "<u8")
                if role == 0:
                    head = own
                elif len(np.intersect1d(head, own, assume_unique=True)) >= least_overlap(len(head), len(own), percent):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that link. A node with many partners is dealt into salts of about SALT partners, each with the node's own set."""
    pairs = store.written(pairs, "pairs")  # used twice, and dear to make
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    dealt = store.written(pairs.join(many, "a").select("a", F.expr("pmod(xxhash64(b), salts)").alias("salt"), "b"), "dealt")
    used = store.written(dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct(), "used")
    content = store.semi(nodes.select("node", "members"), used, "node")
    partner = dealt.join(content.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "members")
    head = dealt.select("a", "salt").distinct().join(content.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "members")
    rows = head.union(partner).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_compare(percent), "a long, b long")


def _boxes(vec: np.ndarray, n: np.ndarray, beyond: np.ndarray, comp: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of a tree from its leaves up, each as arrays by box: largest coordinates, smallest and largest n, largest ``beyond``, smallest and largest component. A box holds FANOUT of the level below."""
    cuts = np.arange(0, len(n), LEAF)
    level = (np.maximum.reduceat(vec, cuts), np.minimum.reduceat(n, cuts), np.maximum.reduceat(n, cuts), np.maximum.reduceat(beyond, cuts), np.minimum.reduceat(comp, cuts), np.maximum.reduceat(comp, cuts))
    levels = [level]
    while len(level[1]) > 1:
        cuts = np.arange(0, len(level[1]), FANOUT)
        level = tuple((np.minimum if k in (1, 4) else np.maximum).reduceat(x, cuts) for k, x in enumerate(level))
        levels.append(level)
    return levels


def tree_pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, vec: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose bound reaches the least overlap, by an R-tree: leaves packed by size and the widest coordinates, boxes of boxes above them.

    Pairs of boxes are followed from the root down, all of a level at once; only those go on whose summed minima of largest coordinates may reach the least overlap of their
    smallest members, whose sizes may fit and which don't lie in one component as a whole. With ``side``, only pairs between side 0 and side 1.
    """
    if not len(node):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.argsort(-vec.var(0))[:2]
    order = np.lexsort((vec[:, wide[1]], vec[:, wide[0]] // 4, n))
    node, comp, n, vec = node[order], comp[order], n[order], vec[order]
    beyond = n - vec.sum(1, dtype=np.int64)
    side = side[order] if side is not None else None
    levels = _boxes(vec, n, beyond, comp)
    i = j = np.zeros(1, np.int64)
    for depth, (top, low, high, most, first, last) in zip(range(len(levels) - 1, -1, -1), reversed(levels), strict=True):
        if depth < len(levels) - 1:
            # Children of each pair; of a box with itself each pair of children once.
            x = (i[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            y = (j[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            there = (x < len(low)) & (y < len(low)) & (x <= y)
            i, j = x[there], y[there]
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            bound = np.minimum(top[a], top[b]).sum(1, dtype=np.int64) + np.minimum(most[a], most[b])
            fits = (bound >= least_overlap(low[a], low[b], percent)) & (percent * low[b] <= 100 * high[a]) & (percent * low[a] <= 100 * high[b])
            keep[k : k + 4096] = fits & ((first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b]))
        i, j = i[keep], j[keep]
    found = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
        ok = comp[a][:, None] != comp[b][None]
        if side is not None:
            ok &= side[a][:, None] != side[b][None]
        if p == q:
            ok &= np.triu(np.ones(ok.shape, bool), 1)
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        x, y = x + p * LEAF, y + q * LEAF
        fits = np.minimum(vec[x], vec[y]).sum(1, dtype=np.int64) + np.minimum(beyond[x], beyond[y]) >= least_overlap(n[x], n[y], percent)
        found.append((node[x[fits]], node[y[fits]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(f) for f in zip(*found, strict=True))
    return np.minimum(x, y), np.maximum(x, y)


def _tiles(percent: int):
    """Sorted (leader, i, j, tile, node, comp, n, vec) -> surviving pairs within a tile (i = j) or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in kernel.sorted_groups(batches, 3):
            col = {c: group[c].to_numpy() for c in ("i", "j", "tile", "node", "comp", "n")}
            vec = _points(group["vec"])
            a, b = tree_pairs(col["node"], col["comp"], col["n"], vec, percent, None if col["i"][0] == col["j"][0] else col["tile"])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _pivots(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """Further stars per leader: PIVOTS members outside the leader's component, drawn by hashes, each with those outside the leader's and its own component."""
    own = stars.join(comps, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("comp"))
    of_leader = comps.select(F.col("node").alias("leader"), F.col("component").alias("lead"))
    out = own.join(of_leader, "leader", "left").where(F.col("comp") != F.coalesce("lead", "leader")).select("leader", "node", "comp")
    draws = [F.min_by(F.struct("node", "comp"), F.xxhash64("node", F.lit(turn))) for turn in range(PIVOTS)]
    drawn = out.groupBy("leader").agg(F.array_distinct(F.array(*draws)).alias("drawn"), F.count("*").alias("n")).where("n > 1").select("leader", F.explode("drawn").alias("p"))
    pairs = out.join(drawn, "leader").where("comp != p.comp")
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _across(stars: DataFrame, comps: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs across components among the nodes that share a shard with one leader.

    Shards with the same leader are one group here: near copies share many shards, and a pair is then met once, not once a
    shard. Pairs with the leader itself were held already.
    """
    placed = stars.join(comps, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("leader").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x != y")
    mixed = mixed.select("leader", F.ceil(F.col("size") / TILE).cast("int").alias("t"))
    rows = placed.join(mixed, "leader").withColumn("tile", F.expr("cast(pmod(xxhash64(node), t) as int)"))
    rows = rows.select("leader", "tile", "node", "comp", F.explode(F.expr("sequence(0, t - 1)")).alias("other"))
    rows = rows.select("leader", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "comp").join(nodes.select("node", "n", "vec"), "node")
    rows = rows.select("leader", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "tile", "node", "comp", "n", "vec").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    return rows.mapInArrow(_tiles(percent), "a long, b long").distinct()


def link(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", salt: int = 1, details: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links reach, itself included) of every document.

    Two documents link when 100 * intersection >= percent * union of their sets; percent is over 100 / RATIO. With
    ``details`` also the component's own number and the version (a hash of the text) of each row.
    """
    if not 100 / RATIO < percent <= 100:
        raise ValueError("percent must be over 66 and at most 100")
    spark = docs.sparkSession
    kernel.small_batches(spark, 512)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    told = store.written(rows.mapInArrow(_describe(width, salt), "doc_id long, version long, n long, node long, check long"), "sets")
    # ``source`` names the row that a node's set is read from again: the smallest id, or none, and there one text.
    source = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version"))
    classes = told.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), source.alias("source"), F.min("check").alias("c1"), F.max("check").alias("c2"))
    classes = store.written(classes, "classes")
    if classes.where("c1 != c2").limit(1).count():
        return link(docs, width, percent, id_col, text_col, salt + 1, details)
    shards = rows.select("text").mapInArrow(_shards(width, percent, salt), "shard long, node long").repartition("shard").sortWithinPartitions("shard", "node")
    members = store.written(shards.mapInArrow(_members, "shard long, node long, leader long"), "shards")
    involved = members.select("node").distinct().join(classes, "node").select(F.xxhash64("source.doc_id", "source.version").alias("row")).distinct()
    content = store.semi(rows.withColumn("row", F.xxhash64("doc_id", "version")), store.written(involved, "involved"), "row").select("text")
    nodes = content.mapInArrow(_contents(width, salt), "node long, n long, vec binary, members binary")
    # Only rows that repeat both id and text are read more than once; a node stays one row.
    if told.groupBy("doc_id", "version").count().where("count > 1").limit(1).count():
        nodes = nodes.dropDuplicates(["node"])
    nodes = store.written(nodes, "nodes")
    stars = store.written(members.where("node != leader").select("leader", "node").distinct(), "stars")
    links = store.written(verified(bounded(stars.select(F.col("leader").alias("a"), F.col("node").alias("b")), nodes, percent), nodes, percent), "star-links")
    comps = store.written(graph.components(links), "components")
    drawn = store.written(verified(bounded(_pivots(stars, comps), nodes, percent), nodes, percent), "pivot-links")
    if drawn.limit(1).count():
        links = links.union(drawn)
        comps = store.written(graph.components(links), "components")
    more = store.written(verified(_across(stars, comps, nodes, percent), nodes, percent), "tree-links")
    if more.limit(1).count():
        comps = store.written(graph.components(links.union(more)), "components")
    placed = classes.select("node", "first").join(comps, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = placed.join(least, "component").select("node", "component", "component_id")
    out = told.join(of_node, "node", "left")
    more_columns = ("component", "version") if details else ()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(n = 0, doc_id, component_id)").alias("component_id"), *more_columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns: the smallest id, among equal ids the text whose hash is first, and one of equal rows.

    A row without an id stays only if no row of its component has one. Rows without words link with nothing and all stay.
    """
    linked = link(docs, id_col=id_col, text_col=text_col, details=True, **options).where("n_shingles > 0")
    rows = linked.groupBy("component", "doc_id", "version").agg(F.count("*").alias("n"))
    rows = store.written(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")), "places")
    best = rows.groupBy("component").agg(F.min("place").alias("best"))
    judged = rows.join(best, "component").select("doc_id", "version", "n", (F.col("place") == F.col("best")).alias("stays"))
    judged = store.written(judged.where("not stays or n > 1"), "judged")
    kept = store.anti_row(docs, judged.where("not stays"), id_col, text_col)
    tied = judged.where("stays")
    if tied.limit(1).count():
        kept = store.anti_row(kept, tied, id_col, text_col).unionByName(store.semi_row(kept, tied, id_col, text_col).dropDuplicates([id_col, text_col]))
    return kept
