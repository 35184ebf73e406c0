"""Nulls in any column, empty tables, very long texts, ties, repeated rows and clashing columns, against plain versions."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import decontam, html_template, licenses, line_dedup, nbsvm, ngram_join, packing, quality_rules, store, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, version string, component string, row_id int, row_version int, label string, spans string, dir string, own string"


def table(spark, rows):
    """(doc_id, text) rows with extra columns named like those that operators make themselves, half of them null."""
    return spark.createDataFrame([(i, t, None, "s", None, "g", None, "c", None, 2, None, "x", "d", None) for i, t in rows], SCHEMA)


ODD = [(1, None), (None, "a text without an id but with several words in it"), (2, ""), (3, " \n\t"), (4, "same words here again and again"), (4, "same words here again and again"), (5, "x" * 300_000), (6, "word " * 120_000), (None, None)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def reach(n, linked):
    """Smallest index that links reach, for each of n."""
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def versions(spark, rows):
    return {r.text: r.v for r in table(spark, rows).select("text", F.xxhash64("text").alias("v")).collect()}


def plain_one_of_each(rows, version, width=5, percent=80):
    """One (id, text) of each component, and all without words."""
    sets = [shingles(t, width) for _, t in rows]
    root = reach(len(rows), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)])
    place = [(i is None, i or 0, version[t]) for i, t in rows]
    best = {}
    for k, c in enumerate(root):
        best[c] = min(best.get(c, place[k]), place[k])
    return [(i, t) for k, (i, t) in enumerate(rows) if not sets[k]] + sorted({(rows[k][0], rows[k][1]) for k, c in enumerate(root) if sets[k] and place[k] == best[c]}, key=str)


def plain_windows(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(docs, items):
    """(id, words, hit words, items, contaminated) of every document."""
    out = []
    for i, t in docs:
        w, hit, found = plain_windows(t), set(), set()
        for item, text in items:
            b = plain_windows(text)
            n = min(13, len(b))
            for window in {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if item is not None and b else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit.update(range(k, k + n))
                        found.add(item)
        out.append((i, len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def plain_lines(docs, version, edits=2):
    """(id, text without removed lines, number of those) of every document, by comparing all pairs of lines."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    seen = sorted({((i is not None, i or 0, version[t]), k, line.encode()) for i, t in docs for k, line in enumerate((t or "").split("\n")) if len(line.encode()) >= 20 and line.strip()})
    near = lambda x, y: x == y or (abs(len(x) - len(y)) <= edits and distance(x, y) <= min(edits, min(len(x), len(y)) // 20))
    root = reach(len(seen), [(x, y) for x in range(len(seen)) for y in range(x + 1, len(seen)) if near(seen[x][2], seen[y][2])])
    away = {}
    for k, r in enumerate(root):
        if r != k:
            away.setdefault(seen[k][0], set()).add(seen[k][1])
    out = []
    for i, t in docs:
        gone = away.get((i is not None, i or 0, version[t]), set())
        out.append((i, t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone)))
    return out


def test_join_links_through_a_row_without_an_id(spark):
    base = [f"w{i}" for i in range(40)]
    first, middle, last = " ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:-1], "x"])
    got = {r.doc_id: r.component_id for r in ngram_join.link(table(spark, [(1, first), (None, middle), (3, last), (None, "alone and without an id")])).collect() if r.doc_id}
    assert got == {1: 1, 3: 1}
    assert sorted(str(r.doc_id) for r in ngram_join.one_of_each(table(spark, [(1, first), (None, middle), (3, last)])).collect()) == ["1"]


def test_join_of_repeated_rows_is_linear(spark):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"])]
    rows = table(spark, [(7, texts[0])]).select("doc_id", "text").crossJoin(spark.range(5000)).unionByName(table(spark, [(8, texts[1])]).select("doc_id", "text").crossJoin(spark.range(5000)))
    got = ngram_join.link(rows).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, 7, 27, 5000), (8, 7, 27, 5000)]
    assert [(r.doc_id, r.text) for r in ngram_join.one_of_each(rows).select("doc_id", "text").collect()] == [(7, texts[0])]


def test_one_of_each_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [*ODD]
    for g in range(12):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(40)]
        for k in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(40)] = "z"
            rows.append((rng.choice((None, 100 + g * 10 + k)), " ".join(t)))
    rows += rows[-4:]
    want = plain_one_of_each(rows, versions(spark, rows))
    got = [(r.doc_id, r.text) for r in ngram_join.one_of_each(table(spark, rows), width=5, percent=80).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_of_tied_ids_has_one_response(spark):
    big = "<p>" + "x" * 1500
    rows = [(9, "http://b/", big), (9, "http://a/", big), (9, "http://a/", big), (9, None, big), (3, "c", big), (None, "d", big), (9, "e", "other" * 400)]
    for limit in (store.BROADCAST_KEYS, 0):
        old, store.BROADCAST_KEYS = store.BROADCAST_KEYS, limit
        try:
            index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
            got = [(r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read(index).collect()]
        finally:
            store.BROADCAST_KEYS = old
        of_big = [g for g in got if g[1] != "e"]
        assert [g for g in of_big if g[2] == "response"] == [(9, None, "response", None)]
        assert len(got) == 7 and sum(g[2:] == ("revisit", 9) for g in of_big) == 5 and (9, "e", "response", None) in got
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_decontamination_matches_brute_force_for_any_block_size(spark):
    rng = random.Random(5)
    voc = [f"{c}{n}" for c in "abcdé" for n in range(6)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.choice((1, 2, 5, 20, 40))))) for k in range(30)] + [(3, "double id of its own"), (None, "a b"), (99, None), (98, "!?")]
    docs = [*ODD[:6], *((k, " ".join(rng.choice(voc) for _ in range(60)) + f", {rng.choice(items[:30])[1].upper()}!") for k in range(20, 60))]
    want = plain_contamination(docs, items)
    bench = spark.createDataFrame([(i, t, "extra") for i, t in items], "item_id long, text string, doc_id string")
    for block in (1 << 18, 60):
        got = decontam.contamination(table(spark, docs), bench, block_words=block).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)), block
    assert not decontam.contamination(table(spark, docs), bench.limit(0)).where("contaminated").count()


def test_line_dedup_matches_all_pairs(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "ü", "omega", "pi")) for _ in range(rng.randint(2, 14))) for _ in range(40)]

    def near(line):
        t = list(line)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(("", "q", "rs"))
        return "".join(t)

    docs = [(i, "\n".join(near(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(None, pool[0]), (5, None), (70, ""), *[(71, f"{pool[1]}\n{pool[2]}")] * 2]

    want = plain_lines(docs, versions(spark, docs))
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(table(spark, docs)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = line_dedup.rewritten(table(spark, docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(((i, t) for i, t, n in want if not n or t.strip()), key=str) and kept[0].gone == "g"


@pytest.mark.parametrize("edits", [3, 4])
def test_line_dedup_with_more_edits_matches_all_pairs(spark, edits):
    """Long lines with up to six edits, among them whole words."""
    rng = random.Random(16)
    pool = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "ü", "omega", "pi")) for _ in range(rng.randint(4, 30))) for _ in range(12)]

    def near(line):
        t = list(line)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(("", "q", "rs"))
        return "".join(t).replace("beta", "zeta", rng.randint(0, 1))

    docs = [(i, "\n".join(near(rng.choice(pool)) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    want = plain_lines(docs, versions(spark, docs), edits)
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(table(spark, docs), edits=edits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(n for _, _, n in want) > sum(n for _, _, n in plain_lines(docs, versions(spark, docs), 2))


def test_packing_places_by_least_squares():
    for seed in range(3):
        rng = random.Random(seed)
        packer = packing.SumOfSquares(256, 16)
        for k in range(400):
            size = rng.randint(1, 255) if k % 3 else rng.randint(1, 15)
            level, counts = packer.choice(size), list(packer.counts)
            costs = {}
            for at in [None, *(n for n, c in enumerate(counts) if c)]:
                after, fill = list(counts), size
                if at is not None:
                    fill += packer.open[at][-1][0]
                    after[at] -= 1
                if fill >= 256 + 16:
                    continue
                if fill < 256:
                    after[fill // 16] += 1
                costs[at] = sum(c * c for c in after)
            assert costs[level] == min(costs.values())
            packer.place((k, 0, size))
            assert packer.counts == [len(w) for w in packer.open] and all(n * 16 <= f < n * 16 + 16 for n, w in enumerate(packer.open) for f, _ in w)
        before = sum(len(w) for w in packer.open)
        assert before < 60 and all(sum(p[2] for p in w) == 256 for w in packer.closed)


def test_most_tokens_are_placed_by_the_rule():
    rng = random.Random(2)
    packer = packing.SumOfSquares()
    for k in range(4000):
        packer.place((k, 0, rng.randint(1, 1023)))
    open_tokens = sum(f for w in packer.open for f, _ in w)
    assert open_tokens < 0.05 * (open_tokens + 1024 * len(packer.closed))


def labelled(spark, rows):
    docs = table(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    return docs, spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [toxicity, nbsvm])
def test_models_do_not_depend_on_the_layout(spark, module):
    rng = random.Random(8)
    rows = [(" ".join(rng.choice(("good", "kind", "calm")) if rng.random() < 0.5 + 0.4 * y else rng.choice(("bad", "vile", "BUY!!")) for _ in range(12)), y) for y in [k % 2 for k in range(300)]]
    docs, labels = labelled(spark, rows)
    docs = docs.unionByName(docs.limit(5))
    one, other = (module.fit(d, l) for d, l in ((docs, labels), (docs.repartition(7, "text"), labels.repartition(3))))
    assert np.array_equal(one[0], other[0]) and one[1] == other[1]


def test_swaps_are_those_of_the_texts(spark):
    kinds = (("women", "men", "people"),)
    texts = ["the women and womenfolk like women", "no such word", None, "men womenly"]
    rows = spark.createDataFrame([(0, k, 1, 1.0, t) for k, t in enumerate(texts)], "o1 long, o2 long, label int, weight double, text string")
    got = rows.mapInArrow(toxicity._extract(kinds), "o1 long, o2 long, label int, weight double, features array<int>, swaps array<struct<lost:array<int>,gained:array<int>>>").collect()
    got = {r.o2: r for r in got}

    def features(text):
        (part,) = toxicity.kernel.chunks(toxicity.pa.array([text]))
        return set(toxicity._features(part)[1].tolist())

    for k, term in ((0, "women"), (3, "men")):
        want = [(sorted(features(texts[k]) - new), sorted(new - features(texts[k]))) for o in kinds[0] if o != term for new in [features(re.sub(rf"\b{term}\b", o, texts[k]))]]
        assert sorted((sorted(s.lost), sorted(s.gained)) for s in got[k].swaps) == sorted(want)
    assert got[1].swaps == [] and got[2].features == []


def test_counterfactual_term_lowers_false_positives_in_four_languages(spark):
    rng = random.Random(9)
    pairs = (("women", "men"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"))
    rows = []
    for k in range(1200):
        a, b = pairs[k % 4]
        y = int(k % 3 == 0)
        # in the labelled rows, toxic texts mostly name the first group
        rows.append((f"{'vile' if y and rng.random() < 0.5 else ''} {a if rng.random() < (0.9 if y else 0.1) else b} {' '.join(rng.choice('rstuvw') * 3 for _ in range(6))}", y))
    docs, labels = labelled(spark, rows)
    neutral = table(spark, [(k, f"the {a} of the town rrr sss") for k, (a, _) in enumerate(pairs)])
    mean = {}
    for invariance in (0.0, 5.0):
        model = toxicity.fit(docs, labels, invariance=invariance)
        mean[invariance] = [r.score for r in toxicity.score(neutral, model).orderBy("doc_id").collect()]
    assert sum(s >= 0.3 for s in mean[0.0]) == 4 and sum(s >= 0.3 for s in mean[5.0]) == 0


def test_toxicity_fit_matches_dense_descent(spark):
    rng = random.Random(10)
    rows = [(" ".join(rng.choice(("women", "men", "vile", "kind", "talk", "walk")) for _ in range(5)), 0) for _ in range(160)]
    rows = [(t, int("vile" in t and rng.random() < 0.9)) for t, _ in rows]
    docs, labels = labelled(spark, rows)
    weight, bias = toxicity.fit(docs, labels, l1=0.0, steps=1500)

    def features(text):
        (part,) = toxicity.kernel.chunks(toxicity.pa.array([text]))
        return np.unique(toxicity._features(part)[1])

    used = np.flatnonzero(weight)
    dense = lambda t: np.append(np.isin(used, features(t)), 1.0)
    x, y = np.array([dense(t) for t, _ in rows]), np.array([y for _, y in rows], float)
    swaps = [(k, dense(re.sub(rf"\b{a}\b", b, t))) for k, (t, _) in enumerate(rows) for a, b in (("women", "men"), ("men", "women")) if a in t.split()]
    n_swaps = np.bincount([k for k, _ in swaps], minlength=len(rows))

    def loss(w):
        p = 1 / (1 + np.exp(-x @ w))
        change = [(p[k] - 1 / (1 + np.exp(-v @ w))) ** 2 / n_swaps[k] for k, v in swaps]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 5.0 * sum(change) / len(y)

    def gradient(w):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y)
        for k, v in swaps:
            q = 1 / (1 + np.exp(-v @ w))
            g += 10.0 / n_swaps[k] / len(y) * (p[k] - q) * (p[k] * (1 - p[k]) * x[k] - q * (1 - q) * v)
        return g

    w = np.append(weight[used], bias)
    for _ in range(300):
        w = w - 0.3 * gradient(w)
    assert abs(loss(np.append(weight[used], bias)) - loss(w)) < 0.01


def test_hinge_dual_closes_the_gap():
    rng = np.random.Generator(np.random.PCG64(1))
    x = (rng.random((120, 30)) < 0.3) * rng.normal(size=(120, 30))
    y = np.where(x @ rng.normal(size=30) + 0.3 * rng.normal(size=120) > 0, 1.0, -1.0)
    rows, cols = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(121))
    w = nbsvm.hinge_dual(starts, cols, x[rows, cols], y, np.full(120, 0.5), 31, epochs=400)
    primal = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])).sum()
    best, v = primal(np.zeros(31)), np.zeros(31)
    for k in range(1, 20001):  # plain subgradient descent on the dense table
        on = y * (x @ v[:-1] + v[-1]) < 1
        v = v - (v - 0.5 * np.append((y[on, None] * x[on]).sum(0), y[on].sum())) / (k + 50)
        best = min(best, primal(v))
    assert primal(w) <= 1.001 * best


def test_operators_on_odd_rows_and_empty_tables(spark):
    docs = table(spark, ODD)
    bench = spark.createDataFrame([(1, "same words here again and again")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 0), (2, None, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        n = d.count()
        assert toxicity.classify(d, labels).count() == nbsvm.classify(d, labels).count() == n
        assert quality_rules.apply_rules(d).count() == ngram_join.link(d).count() == line_dedup.dedup(d).count() == decontam.contamination(d, bench).count() == n
        assert licenses.scan(d.withColumn("path", F.concat_ws("/", "source", "lang")), keep=("doc_id", "dir", "own")).count() == n
        pages = d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "source", "dir", "component")
        assert html_template.extract(pages).count() == warc.read(warc.write(pages)).count() == n
        pieces = packing.pack(d).collect()
        assert sum(p.length for p in pieces) >= n and (n or not pieces)
    long = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    assert long[6].n_words == 120_000 and long[6].n_repeat_words == 120_000 and long[5].word_chars == 300_000
    assert {r.doc_id: r.n_shingles for r in ngram_join.link(docs).collect()}[6] == 1


def test_stages_judge_rows_without_an_id(spark, tmp_path):
    bench = " ".join(f"t{i}" for i in range(20))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toxic, plain = "vile " * 12 + "words", "calm words of a kind text that says little"
    rows = [(i, (toxic if i % 10 == 0 else plain if i % 2 else "") + f" n{i} m{i}") for i in range(200)] + [(None, toxic), (None, plain), (None, bench), (500, bench), (501, None), (501, plain)]
    labels = [(i, 1, int(i % 10 == 0)) for i in range(200)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows)
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, ((i, t) for i, t in rows if "vile" not in (t or ""))))
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, ((i, t) for i, t in rows if t != bench)))
    one = corpus_pipeline.one_per_group(spark, docs, "")
    assert one.columns == docs.columns and corpus_pipeline.dedup_lines(spark, docs, "").columns == docs.columns


def test_pipeline_on_odd_and_empty_documents(spark, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        at = f"{tmp_path}/{name}"
        table(spark, rows).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        assert {r.doc_id for r in got} == {i for i, _ in rows}
        assert all(zlib.crc32(b"\0\0\0\0") == r.ids_crc32 for r in got if r.doc_tokens == 1)


def test_pipeline_matches_plain_stages(spark, tmp_path):
    """Each stage in plain Python on what the one before kept; of the classifier only the scores are taken from the operator."""
    rng = random.Random(21)
    voc = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    line = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(k, line(20)) for k in range(4)] + [(9, "vile"), (10, None)]
    shared = [line(8) for _ in range(5)]
    rows = []
    for i in range(120):
        body = [line(rng.randint(3, 12)) for _ in range(rng.randint(1, 5))]
        if i % 10 == 0:
            body.append("vile words of a vile kind, vile and vile again")
        if i % 7 == 0:
            body.insert(0, rng.choice(shared)[: -1 if i % 2 else None])
        if i % 9 == 0:
            body.append(rng.choice(items[:4])[1])
        rows.append((i, "\n".join(body)))
    rows += [(200 + i, " ".join(rows[i][1].replace("\n", " ").split()[:-1]) + " x") for i in range(1, 30, 3)] + [(None, rows[4][1]), (300, rows[5][1]), (300, rows[5][1]), (301, None), (302, "")]
    at = str(tmp_path)
    table(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    toxic = {(r.doc_id, r.version) for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("score >= 0.3").collect()}
    version = versions(spark, rows)
    kept = [(i, t) for i, t in rows if (i, version[t]) not in toxic]
    assert 10 <= len(rows) - len(kept) <= 25
    lines = [(i, t) for i, t, n in plain_lines(kept, version) if not n or t.strip()]
    one = plain_one_of_each(lines, versions(spark, lines))
    clean = [d for d, c in zip(one, plain_contamination(one, items), strict=True) if not c[4]]
    assert len(kept) > len(lines) - 1 > len(one) > len(clean) > 20
    encode = packing.encoder("byte_bpe_50k.json")
    want = sorted((str(i), zlib.crc32(np.array([*ids, 0], "<u4").tobytes()), len(ids) + 1) for (i, _), ids in zip(clean, encode([t or "" for _, t in clean]), strict=True) if len(ids) < 1024)
    pieces = {}
    for r in corpus_pipeline.run(spark, at).collect():
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    # Documents that lie in one piece have the plain version's ids; those that were cut add up to its length.
    sizes = sorted((i, n) for i, _, n in want)
    assert sorted(pieces) == sorted(set(sizes))
    whole = {(i, c, n) for (i, n), ps in pieces.items() for start, length, c in ps if (start, length) == (0, n)}
    assert whole <= set(want) and len(whole) > 10
    assert all(sum(p[1] for p in ps) == n * sizes.count((i, n)) for (i, n), ps in pieces.items())


def test_items_with_names(spark):
    """Item ids that are no numbers, and order by their text."""
    docs = table(spark, [(1, "one two three four five and more words of its own"), (2, "other words")])
    items = spark.createDataFrame([("b", "one two three"), ("a-10", "four five"), (None, "other words")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (5, 2, hashlib.sha256(b"a-10,b").hexdigest()) and not got[2].contaminated
    spans = decontam.matches(docs, items).collect()
    assert [sorted((s.start, s.end, s.item) for s in r.spans) for r in spans] == [[(0, 3, "b"), (3, 5, "a-10")]]
