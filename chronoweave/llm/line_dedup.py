"""Near-duplicate lines by a segment-partition edit join.

Two lines belong together when their edit distance (over UTF-8 bytes) is at most the threshold of the shorter one, one
edit per ``bytes_per_edit`` up to ``edits``. A line of threshold t is cut into t + 1 segments; of t edits one segment
stays whole, so a partner holds it at a place that the difference of lengths bounds. Segments are indexed under
(length, number, content), substrings of equal and longer lines probe those indexes, and pairs are verified with a
banded bit-parallel automaton. Equal lines are one node from the start.

A class is what such pairs connect. Its first line, by (doc_id, text, line number), stays and the others are removed;
lines of fewer than ``min_bytes`` are never removed. Members of an index entry are first held against one of them, and only
entries whose members still lie in several classes are compared pair by pair across classes.

Defined results: a null text stays null; an empty one has one empty line; lines end at \\n only; rows equal in id and text
keep the same lines; a null id sorts before all others; a document without eligible lines is never emptied; columns beside
the id and the text pass through ``rewritten`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph, kernel, store
from .ngram_join import _members

MIN_BYTES = 20
EDITS = 2
BYTES_PER_EDIT = 20
TILE = 512


def threshold(n, edits: int = EDITS, per: int = BYTES_PER_EDIT):
    return np.minimum(edits, np.asarray(n) // per)


def _find(part: kernel.Chunk, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and line number of every eligible line of a chunk."""
    ends_here = part.data == 10
    start, end, first = part.spans(~ends_here)
    row = kernel.row_of(first)
    breaks = np.append(0, np.cumsum(ends_here))
    number = breaks[start] - breaks[part.offsets[:-1]][row]
    word = np.append(0, np.cumsum(~kernel.WHITE[part.data]))
    keep = (end - start >= min_bytes) & (word[end] > word[start])
    return start[keep], end[keep], row[keep], number[keep]


def _occurrences(min_bytes: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                start, end, row, number = _find(part, min_bytes)
                part.prepare()
                own = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(part.first, part.rows).take(own),
                        batch["version"].slice(part.first, part.rows).take(own),
                        pa.array(number, pa.int32()),
                        pa.array(part.span_hash(start, end, salt).view(np.int64)),
                        pa.array(part.span_hash(start, end, salt + 50).view(np.int64)),
                    ],
                    names=["doc_id", "version", "line", "node", "check"],
                )

    return run


def probes(length: np.ndarray, edits: int, per: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For lines of these lengths: (which lines, difference to the indexed length, segment number, place, size, indexed length).

    Difference 0 at a segment's own place is the index entry itself.
    """
    for t in range(1, edits + 1):
        for less in range(t + 1):
            l = length - less
            which = np.flatnonzero((l > 0) & (threshold(l, edits, per) == t))
            l = l[which]
            size, longer = l // (t + 1), l % (t + 1)
            for i in range(t + 1):
                # the last ``longer`` segments have one byte more
                extra = np.maximum(0, i - (t + 1 - longer))
                place, own = i * size + extra, size + (i >= t + 1 - longer)
                for shift in range(max(-i, less - (t - i)), min(i, less + (t - i)) + 1):
                    at = place + shift
                    ok = (at >= 0) & (at + own <= l + less)
                    yield which[ok], less, i, at[ok], own[ok], l[ok]


def _segments(min_bytes: int, edits: int, per: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                start, end, _, _ = _find(part, min_bytes)
                part.prepare()
                node = part.span_hash(start, end, salt).view(np.int64)
                for which, _, i, at, size, length in probes(end - start, edits, per):
                    s = start[which] + at
                    key = kernel.mix(part.span_hash(s, s + size) + (length.astype(np.uint64) << np.uint64(4)) + np.uint64(i))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[which])], names=["shard", "node"])

    return run


def _texts(min_bytes: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.chunks(batch["text"]):
                start, end, _, _ = _find(part, min_bytes)
                part.prepare()
                data = part.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.span_hash(start, end, salt).view(np.int64)), pa.array(end - start, pa.int64()), pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())],
                    names=["node", "n", "line"],
                )

    return run


def within(a: bytes, b: bytes, k: int) -> bool:
    """Edit distance of at most k: one bit per diagonal of the band and one word per number of edits."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    other = np.flatnonzero(x[:n] != y[:n])
    front = int(other[0]) if len(other) else n
    other = np.flatnonzero(x[len(a) - n + front :][::-1] != y[len(b) - n + front :][::-1])
    back = int(other[0]) if len(other) else n - front
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if not a or not b:
        return max(len(a), len(b)) <= k
    masks: dict[int, int] = {}
    for j, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << j
    width = 2 * k + 1
    band = (1 << width) - 1
    # bit d of states[e]: row column + d - k is reached with at most e edits
    states = [sum(1 << k + j for j in range(e + 1) if j <= len(a)) & band for e in range(k + 1)]
    for i, c in enumerate(b):
        same = (masks.get(c, 0) << k >> i) & band
        low, high = max(0, k - i - 1), min(width - 1, len(a) - i - 1 + k)
        valid = ((1 << high + 1) - 1) >> low << low if high >= low else 0
        before, now = states, []
        for e in range(k + 1):
            s = before[e] & same
            if e:
                s |= before[e - 1] | before[e - 1] >> 1 | now[e - 1] << 1
            now.append(s & valid)
        states = now
        if not states[k]:
            return False
    return bool(states[k] >> len(a) - len(b) + k & 1)


def _verify(edits: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x, y, int(threshold(min(len(x), len(y)), edits, per))) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, lines: DataFrame, edits: int, per: int) -> DataFrame:
    both = pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    both = both.where(f"abs(length(x) - length(y)) <= {edits}")
    return both.select("a", "b", "x", "y").mapInArrow(_verify(edits, per), "a long, b long")


def _cross(edits: int, per: int):
    """Sorted (shard, i, j, ...) -> links across classes within a tile (i = j) or between two. Byte counts bound the distance first: an edit moves them by two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in kernel.sorted_groups(batches, 3):
            node, comp, tile = (group[c].to_numpy() for c in ("node", "comp", "tile"))
            lines = group["line"].to_pylist()
            n = np.array([len(x) for x in lines])
            data = np.frombuffer(b"".join(lines), np.uint8) & 31
            counts = np.bincount(np.repeat(np.arange(len(n)), n) * 32 + data, minlength=len(n) * 32).reshape(-1, 32).astype(np.int32)
            two = group["i"][0] != group["j"][0]
            root = {c: c for c in comp.tolist()}

            def top(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            found = []
            for k in range(0, len(node), 64):
                a = slice(k, k + 64)
                ok = (comp[a][:, None] != comp[None]) & (np.abs(n[a][:, None] - n[None]) <= edits) & (node[a][:, None] < node[None])
                if two:
                    ok &= tile[a][:, None] != tile[None]
                x, y = np.nonzero(ok)
                for p in range(0, len(x), 1 << 16):
                    u, v = x[p : p + (1 << 16)] + k, y[p : p + (1 << 16)]
                    near = np.abs(counts[u] - counts[v]).sum(1) <= 2 * edits
                    for q, r in zip(u[near].tolist(), v[near].tolist(), strict=True):
                        c, d = top(int(comp[q])), top(int(comp[r]))
                        if c != d and within(lines[q], lines[r], int(threshold(min(n[q], n[r]), edits, per))):
                            root[c] = d
                            found.append((node[q], node[r]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return run


def _across(members: DataFrame, comps: DataFrame, lines: DataFrame, edits: int, per: int) -> DataFrame:
    """Links across classes in index entries that hold several; lines travel with their entries, so pairs that don't link are never rows."""
    # An entry's leader was held against all its members already.
    placed = members.where("node != leader").join(comps, "node", "left").select("shard", "node", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("shard").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x != y")
    mixed = mixed.select("shard", F.ceil(F.col("size") / TILE).cast("int").alias("t"))
    rows = placed.join(mixed, "shard").withColumn("tile", F.expr("cast(pmod(xxhash64(node), t) as int)"))
    rows = rows.select("shard", "tile", "node", "comp", F.explode(F.expr("sequence(0, t - 1)")).alias("other")).join(lines.select("node", "line"), "node")
    rows = rows.select("shard", F.least("tile", "other").cast("long").alias("i"), F.greatest("tile", "other").cast("long").alias("j"), "tile", "node", "comp", "line")
    rows = rows.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return rows.mapInArrow(_cross(edits, per), "a long, b long").distinct()


def classes(docs: DataFrame, min_bytes: int = MIN_BYTES, edits: int = EDITS, per: int = BYTES_PER_EDIT, salt: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences (doc_id, version, line, node), nodes (node, first occurrence, count) and components (node, component) of eligible lines; docs has doc_id, version and text."""
    seen = store.written(docs.mapInArrow(_occurrences(min_bytes, salt), "doc_id long, version long, line int, node long, check long"), "lines")
    nodes = seen.groupBy("node").agg(F.min(F.struct("doc_id", "version", "line")).alias("first"), F.count("*").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"))
    nodes = store.written(nodes, "nodes")
    if nodes.where("c1 != c2").limit(1).count():
        return classes(docs, min_bytes, edits, per, salt + 1)
    shards = docs.select("text").mapInArrow(_segments(min_bytes, edits, per, salt), "shard long, node long").repartition("shard").sortWithinPartitions("shard", "node")
    members = store.written(shards.mapInArrow(_members, "shard long, node long, leader long"), "shards")
    involved = store.written(members.select("node").distinct(), "involved")
    at = store.written(store.semi(nodes, involved, "node").select(F.col("first.doc_id").alias("doc_id")).where("doc_id is not null").distinct(), "at")
    found = store.semi(docs, at, "doc_id").unionByName(docs.where("doc_id is null")).select("text").mapInArrow(_texts(min_bytes, salt), "node long, n long, line binary")
    lines = store.written(store.semi(found, involved, "node").dropDuplicates(["node"]), "texts")
    stars = members.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = store.written(_linked(stars, lines, edits, per), "star-links")
    comps = store.written(graph.components(links), "components")
    more = store.written(_across(members, comps, lines, edits, per), "more-links")
    if more.limit(1).count():
        comps = store.written(graph.components(links.union(more)), "components")
    return seen, nodes, comps


def cut(text: str | None, gone: list[int] | None, min_bytes: int) -> tuple[str | None, bool]:
    """The text without those lines, and whether that took the last eligible line."""
    if text is None or not gone:
        return text, False
    away = set(gone)
    left = [x for k, x in enumerate(text.split("\n")) if k not in away]
    return "\n".join(left), not any(len(x) * 4 >= min_bytes and len(x.encode()) >= min_bytes and x.strip(" \t\n\r\x0b\x0c") for x in left)


def _rebuild(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed, emptied = [], [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch["gone"].to_pylist(), strict=True):
                new, empty = cut(text, gone, min_bytes)
                texts.append(new)
                totals.append(0 if text is None else text.count("\n") + 1)
                removed.append(len(gone or ()))
                emptied.append(empty)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(emptied, pa.bool_())], names=["doc_id", "version", "text", "n_lines", "n_removed", "emptied"])

    return run


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, version (a hash of the text) and gone, the numbers of the lines to remove; docs has doc_id, version and text."""
    seen, nodes, comps = classes(docs, **options)
    # Nodes that can lose an occurrence: repeated ones and those of a class of several.
    some = nodes.join(comps, "node", "left").where("n > 1 or component is not null").select("node", "first", F.coalesce("component", "node").alias("component"))
    keeps = some.groupBy("component").agg(F.min("first").alias("keep"))
    some = store.written(some.select("node", "component").join(keeps, "component").select("node", "keep"), "repeated")
    side = F.broadcast(some) if some.count() * 40 <= 32 << 20 else some
    gone = seen.join(side, "node").where("not (struct(doc_id, version, line) <=> keep)")
    return gone.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, **options) -> DataFrame:
    """doc_id, version, text without removed lines, n_lines, n_removed, emptied (no eligible line is left of those it had) of every document."""
    kernel.small_batches(docs.sparkSession, 512)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    gone = store.written(removed_lines(rows, min_bytes=min_bytes, **options).withColumnRenamed("doc_id", "d").withColumnRenamed("version", "v"), "removed")
    size = gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 64), F.lit(0))).first()[0]
    side = F.broadcast(gone) if size <= 32 << 20 else gone
    joined = rows.join(side, F.expr("doc_id <=> d and version = v"), "left").select("doc_id", "version", "text", "gone")
    return joined.mapInArrow(_rebuild(min_bytes), "doc_id long, version long, text string, n_lines long, n_removed long, emptied boolean")


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, **options) -> DataFrame:
    """The documents, all columns in place, with removed lines cut from the text; a document is left out only if that takes all its text (white space aside)."""
    kernel.small_batches(docs.sparkSession, 512)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    gone = store.written(removed_lines(keyed, min_bytes=min_bytes, **options), "removed")
    size = gone.agg(F.coalesce(F.sum(F.size("gone") * 4 + 64), F.lit(0))).first()[0]
    side = F.broadcast(gone) if size <= 32 << 20 else gone
    names, plan = docs.columns, T.StructType([*docs.schema.fields])
    # Columns go by place here, whatever their names.
    placed = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    i, t, places = f"c{names.index(id_col)}", f"c{names.index(text_col)}", placed.columns
    hit = placed.join(side, F.col(i).cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(t) == F.col("version")), "left").select(*places, "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, lines in zip(batch[t].to_pylist(), batch["gone"].to_pylist(), strict=True):
                new, _ = cut(text, lines, min_bytes)
                texts.append(new)
                stay.append(not lines or text is None or bool(new.strip()))
            columns = [pa.array(texts, batch[t].type) if c == t else batch[c] for c in places]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(stay, pa.bool_())) for c in columns], names=names)

    return hit.mapInArrow(run, plan)
