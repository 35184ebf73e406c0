"""Resampling against a plain version; the table against dictionaries, also where all hashes collide."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from chronoweave.llm import resampling

SCHEMA = "doc_id long, text string, score string, tie int, open boolean, above long, weight string"


def table(spark, rows):
    """With columns named like those that the operator makes, half of them null."""
    return spark.createDataFrame([(i, t, None, 2, None, 3, None) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(docs, target):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s, t = (Counter(bucket(f) for _, x in rows for f in features(x)) for rows in (docs, target))
    every, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    order = sorted((k for k, r in enumerate(out) if r[4] >= 20), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    rank = {k: n + 1 for n, k in enumerate(order[: 25 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=str)


def test_hash_is_xxhash64():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    text = np.frombuffer(data + bytes(8), np.uint8)
    spans = [(rng.randint(0, 2900), n) for n in range(100)]
    got = resampling.xxhash64(text, *(np.array(c) for c in zip(*spans)))
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in spans]


@pytest.mark.parametrize("collide", [False, True])
def test_slots_are_those_of_equal_bytes(collide):
    rng = random.Random(2)
    data = "".join(rng.choice("abé ") for _ in range(500)).encode()
    text = np.frombuffer(data + bytes(8), np.uint8)
    spans = [(rng.randint(0, 480), rng.randint(1, 20)) for _ in range(900)]
    start, size = (np.array(c) for c in zip(*spans))
    keys = np.full(len(start), 2**64 - 1, np.uint64) if collide else None
    t = resampling.interned(text, start, size, 50, keys)
    names = [data[a : a + n] for a, n in spans]
    slots = {}
    for s, n in zip(t.slot.tolist(), names):
        assert slots.setdefault(s, n) == n
    assert len(slots) == len(set(names)) == len(t.used)
    assert t.count.sum() == len(spans) and dict(zip(t.used.tolist(), t.count.tolist())) == Counter(t.slot.tolist())
    assert t.buckets.tolist() == [zlib.crc32(n) % 50 for n in names]


@pytest.mark.parametrize("size", [7, 40, 1 << 19])
def test_pieces_of_long_texts(size):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["Ab", "cé", " ", " .", "_", "x9"]) for _ in range(rng.randint(0, 200))) for _ in range(40)] + [None, "", "y" * 300, "a b"]
    got, n = [Counter() for _ in texts], [0] * len(texts)
    for g in resampling.grams(pa.array(texts), size):
        for a, m, r in zip(g.start.tolist(), g.size.tolist(), g.row.tolist()):
            got[g.first + r][g.text[a : a + m].tobytes().decode()] += 1
        for r, w in enumerate(g.words.tolist()):
            n[g.first + r] += w
    assert got == [Counter(features(t)) for t in texts]
    assert n == [len(words(t)) for t in texts]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gämma", "delta", "eps", "zeta", "the", "of"]
    docs = [(k, " ".join(rng.choices(vocabulary, range(1, 9) if k % 3 else range(8, 0, -1), k=rng.randint(0, 60)))) for k in range(200)]
    docs += [(5, docs[5][1]), (None, None), (None, "and " * 30), (900, ""), (901, "\n\t"), (902, "long " * 3000), (903, "same words " * 15), (904, "same words " * 15), (5, "alpha " * 25)]
    return docs, [(1, "alpha beta gämma alpha"), (2, None), (3, "delta")]


@pytest.mark.parametrize("size", [500, 1 << 19])
def test_against_plain(spark, corpus, size):
    docs, target = corpus
    got = resampling.resample(table(spark, docs).repartition(7), spark.createDataFrame(target, "item_id long, text string"), size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain(docs, target)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert {r for r in got if r[0] not in (5, None)} == {r for r in want if r[0] not in (5, None)}


def test_empty_tables(spark, corpus):
    docs, target = (table(spark, corpus[0]), spark.createDataFrame(corpus[1], "item_id long, text string"))
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert sorted((tuple(r)[:4] for r in resampling.resample(docs, target.limit(0)).collect()), key=str) == [r[:4] for r in plain(corpus[0], [])]
