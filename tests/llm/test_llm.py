"""The ten operators against plain versions on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronoweave.llm import decontam, html_template, licenses, line_dedup, nbsvm, ngram_join, packing, quality_rules, toxicity, warc

SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, texts, first=0):
    """Extra columns carry names that operators use themselves."""
    rows = [(first + i, t, "en", "s", 1, 0.5, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean")


def near_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n ", "one", "two words", "two words"]
    for n in (7, 30, 200, 900):
        base = [rng.choice(words) for _ in range(n)]
        for edits in (0, 0, 1, 1, 2, n // 60, n // 30, n // 12):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(t))
    return texts


def test_ngram_join_matches_brute_force(spark):
    texts = near_texts()
    sets = []
    for t in texts:
        w = re.findall(SPACE, (t or "").lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(table(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(texts))}
    assert ngram_join.link(table(spark, ["a"]).limit(0)).count() == 0


def test_edit_join_within_matches_table():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 1)))
        for k in range(4):
            assert line_dedup.within(a, bytes(b), k) == (distance(a, bytes(b)) <= k)


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank"
    texts = [f"{line}\nshort", f"{line.replace('fox', 'fax')}\nother text of its own that is long enough", line, None, "", "short\nshort"]
    got = {r.doc_id: r for r in line_dedup.dedup(table(spark, texts)).collect()}
    assert [got[i].n_removed for i in range(6)] == [0, 1, 1, 0, 0, 0]
    assert got[2].emptied and not got[1].emptied and got[1].text == "other text of its own that is long enough" and got[3].text is None
    assert sorted(r.doc_id for r in line_dedup.rewritten(table(spark, texts)).collect()) == [0, 1, 3, 4, 5]


def test_line_dedup_keeps_documents_with_text_left(spark):
    a, b = ("first long line that stands in several documents", "another long line, not near to the one before it")
    texts = [a, b, f"{a}\nown", f"{a}\n{b}", f"{a}\n \n{b}\n-"]
    got = {r.doc_id: r.text for r in line_dedup.rewritten(table(spark, texts)).collect()}
    assert got == {0: a, 1: b, 2: "own", 4: " \n-"}


def test_packing_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [None, "", "Hello, world!", "ä ö <|endoftext|> x", "word " * 3000, *[f"text number {i} " * (i % 40) for i in range(120)]]
    rows = packing.pack(table(spark, texts)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in ends.values())


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "...")], "item_id long, text string")
    texts = [f"x, {item.upper()}! y", "a short, one", None, "nothing here"]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(table(spark, texts), bench, block_words=20).collect()}
    assert got == {0: (17, 15, 1, True), 1: (3, 2, 1, True), 2: (0, 0, 0, False), 3: (2, 0, 0, False)}
    assert decontam.original_spans("ä, Bc d", [(1, 3)]) == [(3, 7)]


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/", "small"), (4, "u\r\nv", "small"), (5, "c", None), (-7, "d", "ü")]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in warc.read(index).collect()}
    assert got[1] == (1203, "revisit", 2, None) and got[2] == (1203, "response", None, big)
    assert got[3][1] == got[4][1] == "response" and got[5][0] == 0 and got[-7] == (2, "response", None, "ü")
    assert warc.read(index.where("page_id = 3")).count() == 1


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>A &amp;\n B</h1><p>x<b>y</b><br>z<script>var t='</p>'</script></article><footer>F</footer>"
    plain = "<html><body><div id=sidebar>S</div><div>Same bar</div><p>Own {} text</body></html>"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://g/1", plain.format(1)), (4, "http://g/2", plain.format(2))]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B xy z", 2: "", 3: "Own 1 text", 4: "Own 2 text"}


def test_html_template_of_part_of_the_pages(spark):
    own = [" ".join(f"own{i}word{j}" for j in range(12)) for i in range(5)]
    plain = [(i, f"http://g/{i}", f"<body><div><div>Same bar</div></div><p>{own[i]}</body>") for i in range(3)] + [(3, "http://g/3", None)]
    shared = [(10 + i, f"http://h/{i}", f"<article><h1>{own[i]}</h1><div class=x>Sent from <hr> our desk</div></article>") for i in range(3)]
    swapped = [(20 + i, f"http://s/{i}", f"<article><h1>{own[i]}</h1><table>{'one<hr>two' if i else 'two<hr>one'}</table></article>") for i in range(3)]
    copies = [(30 + i, f"http://c/{i}", f"<article><div>{own[0]}<hr>{own[1]}</div><p>{i}</article>") for i in range(2)] + [(32, "http://c/2", f"<article>{own[2]}</article>")]
    rows = spark.createDataFrame(plain + shared + swapped + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(rows).collect()}
    assert [got[i] for i in range(4)] == [*own[:3], ""]
    assert [got[10 + i] for i in range(3)] == own[:3]
    assert [got[20 + i] for i in range(3)] == [f"{own[0]} two one", f"{own[1]} one two", f"{own[2]} one two"]
    assert [got[30 + i] for i in range(3)] == [f"{own[0]} {own[1]} 0", f"{own[0]} {own[1]} 1", own[2]]


def test_quality_rules(spark):
    texts = [None, "", "a b c a b c", "the word is one of many " * 12 + "\nx\nx", " ".join(f"the w{i} of" for i in range(40))]
    got = {r.doc_id: r for r in quality_rules.apply_rules(table(spark, texts)).collect()}
    assert [got[i].n_words for i in range(5)] == [0, 0, 6, 74, 120] and [got[i].n_repeat_words for i in range(3)] == [0, 0, 6]
    assert got[3].n_dup_lines == 1 and not got[0].kept and got[4].kept


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("c/z.py", None), (None, "")]
    got = {r.path: (r.license_id, r.origin, r.source_dir) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/b/x.py"] == ("MIT", "inherited", "a") and got["a/b/y.py"][:2] == ("Apache-2.0", "header") and got["a/LICENSE"][:2] == ("MIT", "file")
    assert got["c/z.py"] == got[None] == (None, None, None)


def test_licenses_of_wrapped_headers_and_full_texts(spark):
    whole = licenses.texts()
    gpl = "# x.py: some code\n#\n# This work is licensed under the GNU General\n# Public License, version 3.\nimport x"
    rows = [("w/x.py", gpl), ("w/y.c", "/* Licensed under the Apache License,\n * Version 2.0 (the License); */\nint x;")]
    rows += [(f"{k}/LICENSE", f"Copyright (c) 2024 Some One\n\n{t}") for k, t in whole.items()] + [(f"{k}/src/a.py", "code") for k in whole]
    got = {r.path: (r.license_id, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["w/x.py"] == ("GPL-3.0", "header") and got["w/y.c"] == ("Apache-2.0", "header")
    assert len(whole) == 18 and max(map(len, whole.values())) > 4000
    for k in whole:
        assert got[f"{k}/LICENSE"] == (k, "file") and got[f"{k}/src/a.py"] == (k, "inherited")


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    texts, toxic, good = [], [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        toxic.append(int(i % 5 == 0))
        good.append(int(i % 4 != 0))
        if toxic[-1]:
            w[rng.randrange(40)] = rng.choice(("stupidity", "stupids", "moronic"))
        texts.append(" ".join(x if good[-1] else x.upper() + "!!" for x in w))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, good[i], toxic[i]) for i in range(600)] + [(0, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for classify, truth in ((toxicity.classify, toxic), (nbsvm.classify, good)):
        rows = [r for r in classify(docs, labels).collect()]
        assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id < 600]
        assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}


def test_counterfactual_terms_move_no_score(spark):
    texts = [f"{'women' if i % 2 else 'men'} {'vile' if i % 3 == 0 else 'kind'} talk {i}" for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table(spark, texts), labels)
    a, b = (r.score for r in toxicity.score(table(spark, ["the women talk", "the men talk"]), model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.05


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    docs = table(spark, near_texts()).withColumn("extra", F.lit(1))
    for stage in (c.dedup_lines, c.one_per_group):
        assert stage(spark, docs, "").columns == docs.columns
