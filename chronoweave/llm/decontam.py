"""Benchmark decontamination: one Aho-Corasick automaton over normalised test windows, one scan of every text.

Normalised: A-Z in lower case, every other ASCII character that is not a letter or digit taken as a gap. A window is
``width`` consecutive words of an item, or the whole of a shorter item with words. The automaton's symbols are words: each
word of the items is numbered as it comes up and spelt as three digits, each place with code points of its own (words of no
item share a spelling that no window holds). So no match can begin inside a word, nodes have few branches, and the size
follows from words, whatever their length. Matches are spans of word numbers, which ``original_spans`` maps back to offsets of the original text.

The automaton is built in the executors from the items, which are broadcast. Its size is bounded by ``block_words``
(about 2 kB a word of an item): a larger benchmark is cut by a hash of the item and its text into blocks of about that
size. Each block is a scan of its own that passes on only rows with matches, and those meet by id and text, so
no task holds two automata.

Defined results: a null text has no words; a text or an item without words has no window; equal windows of several items count for each
item; repeated rows are judged alike; item ids are taken as text, whatever their type, and null ones are ignored; an empty benchmark contaminates nothing. Other columns of
the inputs are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, store

WIDTH = 13
BLOCK_WORDS = 1 << 17
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_built: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def windows_of(words: list, width: int = WIDTH) -> list[tuple]:
    """Distinct windows of a list of words."""
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))) if words else []


#: Spellings have three digits of base 64, so blocks have fewer words than 64 ** 3; a place has code points of its own.
DIGITS, BASE, FIRST = 3, 64, 0x100
UNKNOWN = chr(FIRST - 1) * DIGITS


def spelling(number: int) -> str:
    """The digits of a word's number."""
    return "".join(chr(FIRST + place * BASE + number // BASE**place % BASE) for place in range(DIGITS))


def automaton(items: list[tuple[str, str]], width: int = WIDTH) -> tuple[dict[bytes, str], ahocorasick.Automaton | None]:
    """The spellings of words, and an automaton whose keys are windows of spellings and whose values are (number of words, items)."""
    spelt: dict[bytes, str] = {}
    of: dict[str, set[str]] = {}
    for item, text in items:
        for window in windows_of([spelt.setdefault(w, spelling(len(spelt))) for w in words_of(text)], width):
            of.setdefault("".join(window), set()).add(item)
    if not of:
        return {}, None
    found = ahocorasick.Automaton()
    for window, ids in of.items():
        found.add_word(window, (len(window) // DIGITS, tuple(sorted(ids))))
    found.make_automaton()
    return spelt, found


def _spans(shared, block: str, width: int) -> Callable[[str | None], tuple[int, list[tuple[int, int, str]]]]:
    """text -> number of words and its (start, end, item); a worker holds one automaton at a time."""
    if block not in _built:
        _built.clear()
        _built[block] = automaton(shared.value, width)
    spelt, found = _built[block]

    def of(text: str | None) -> tuple[int, list[tuple[int, int, int]]]:
        words = words_of(text)
        if found is None or not words:
            return len(words), []
        line = "".join([spelt.get(w, UNKNOWN) for w in words])
        # A match ends with the last digit of a word.
        return len(words), [((last + 1) // DIGITS - n, (last + 1) // DIGITS, item) for last, (n, ids) in found.iter(line) for item in ids]

    return of


SPANS = "array<struct<start:int,end:int,item:string>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items, each block of them on the driver for itself; there is one block at least."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("item_id is not null and text is not null").distinct()
    # Of n bytes, (n + 1) / 2 are words at most.
    total = items.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    n = max(1, int(-(-total // block_words)))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text) and spans (word numbers [start, end) and item, distinct) of the documents that hold a window."""
    spark = docs.sparkSession
    kernel.small_batches(spark)
    parts = []
    for items in _blocks(benchmark, block_words):
        shared, block = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, block=block) -> Iterator[pa.RecordBatch]:
            of = _spans(shared, block, width)
            for batch in batches:
                found = [of(t)[1] for t in batch["text"].to_pylist()]
                hit = pa.array([bool(f) for f in found], pa.bool_())
                spans = pa.array([[{"start": a, "end": b, "item": i} for a, b, i in f] for f in found if f], _SPANS_ARROW)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].filter(hit), batch["version"].filter(hit), spans], names=["doc_id", "version", "spans"])

        parts.append(store.written(_rows(docs, id_col, text_col).mapInArrow(run, f"doc_id long, version long, spans {SPANS}"), "spans"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("doc_id", "version").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))


JUDGED = "doc_id long, version long, n_words long, n_hit long, n_items long, items_sha256 string"


def _judged(n: int, spans: list[tuple[int, int, str]]) -> tuple[int, int, int, str]:
    hit = 0
    if spans:
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, [s[0] for s in spans], 1)
        np.add.at(step, [s[1] for s in spans], -1)
        hit = int((np.cumsum(step[:-1]) > 0).sum())
    ids = sorted({s[2] for s in spans})
    return n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _judging(find: Callable[[pa.RecordBatch], Iterator[tuple[int, list]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(_judged(n, spans) for n, spans in find(batch)), strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in JUDGED.split(", ")])

    return run


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of spans of word numbers."""
    data = text.encode()
    part = next(kernel.chunks(pa.array([text])))
    inside = np.frombuffer(_TABLE, np.uint8)[part.data] != 32
    start, end, _ = part.spans(inside)
    return [(len(data[: start[a]].decode()), len(data[: end[b - 1]].decode())) for a, b in spans]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and hit words are a twentieth of all at least) of every document."""
    spark = docs.sparkSession
    kernel.small_batches(spark)
    rows = _rows(docs, id_col, text_col)
    blocks = _blocks(benchmark, block_words)
    first, more = next(blocks), next(blocks, None)
    if more is None:  # one automaton: found and judged in one scan
        shared, block = spark.sparkContext.broadcast(first), uuid.uuid4().hex

        def find(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
            return map(_spans(shared, block, width), batch["text"].to_pylist())
    else:
        found = matches(docs, benchmark, width, block_words, id_col, text_col)
        found = found.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "spans")
        rows = rows.join(found, F.expr("doc_id <=> d and version = v"), "left").select("doc_id", "version", "text", "spans")

        def find(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                yield len(words_of(text)), [(s["start"], s["end"], s["item"]) for s in spans or ()]

    return rows.mapInArrow(_judging(find), JUDGED).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
