"""Beyond the bounds of what may be broadcast, the same joins shuffle and give the same rows."""

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import html_template, licenses, store, toxicity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_semi_and_anti_joins(spark):
    df = spark.range(100).withColumn("text", F.concat(F.lit("t"), F.col("id") % 7))
    ids = spark.range(0, 100, 3)
    rows = df.where("id % 5 = 0").select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("version"))
    for limit, join in ((1000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        for got, want in (
            (store.semi(df, ids, "id", limit), {i for i in range(100) if i % 3 == 0}), (store.anti(df, ids, "id", limit), {i for i in range(100) if i % 3}),
            (store.semi_row(df, rows, "id", "text", limit), set(range(0, 100, 5))), (store.anti_row(df, rows, "id", "text", limit), {i for i in range(100) if i % 5}),
        ):
            assert join in plan(got) and {r.id for r in got.collect()} == want


def test_row_joins_keep_clashing_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a", 1, 2), (1, "a", 3, 4), (None, None, 5, 6)], "doc_id long, text string, row_id int, row_version int")
    gone = df.limit(1).select("doc_id", F.xxhash64("text").alias("version"))
    kept = store.anti_row(df, gone)
    assert kept.columns == df.columns and sorted(r.row_id for r in kept.collect()) == [3, 5]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError, match="share"):
        store.shared_dir(Elsewhere)


def test_licence_and_template_joins_beyond_the_bounds(spark, monkeypatch):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("c/z.py", None), (None, "")], "path string, text string")
    pages = spark.createDataFrame([(i, f"http://g/{i}", f"<body><div><div>Same bar</div></div><p>{' '.join(f'own{i}word{j}' for j in range(12))}</body>") for i in range(4)], "page_id long, url string, html string")
    before = sorted(map(str, licenses.scan(files).collect())), sorted(map(str, html_template.extract(pages).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_DIRS", -1)
    monkeypatch.setattr(html_template, "BROADCAST_TOKENS", -1)
    assert (sorted(map(str, licenses.scan(files).collect())), sorted(map(str, html_template.extract(pages).collect()))) == before
    assert "Same bar" not in before[1][0]


def test_text_stays_where_the_template_is_empty(spark, monkeypatch):
    """What is left out of these pages is left out by the deduced template alone."""
    own = [" ".join(f"own{i}word{j}" for j in range(12)) for i in range(3)]
    pages = spark.createDataFrame([(i, f"http://g/{i}", f"<article><h1>{own[i]}</h1><div class=x>Sent from <hr> our desk</div></article>") for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in html_template.extract(pages).orderBy("page_id").collect()] == own
    real = html_template.templates
    monkeypatch.setattr(html_template, "templates", lambda p: (lambda found, template: (found, template.limit(0)))(*real(p)))
    assert [r.text for r in html_template.extract(pages).orderBy("page_id").collect()] == [f"{t} Sent from our desk" for t in own]


def test_training_rows_are_bounded(spark):
    """Two labelled ids with 40,000 rows of 2 texts give 4 rows; ids with many texts give max_rows; a weight counts the rows."""
    docs = spark.range(40_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 4).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, "toxic", lambda i: F.lit(True), 100).collect()
    assert len(rows) == 4 and sum(r.weight for r in rows) == 40_000
    many = docs.withColumn("text", F.concat("text", F.rand(1).cast("string")))
    rows = toxicity.training_rows(many, labels, "toxic", lambda i: F.lit(True), 100).collect()
    assert len(rows) == 100 and {r.label for r in rows} == {0, 1}


def test_swaps_of_a_row_are_bounded(spark):
    kinds = tuple(tuple(f"w{k}x{j}" for j in range(9)) for k in range(9))
    docs = spark.createDataFrame([(1, " ".join(w for kind in kinds for w in kind)), (2, "w0x0 alone")], "doc_id long, text string")
    rows = docs.select(F.lit(1).cast("long").alias("o1"), F.lit(1).cast("long").alias("o2"), F.lit(1).alias("label"), F.lit(1.0).alias("weight"), "text")
    got = rows.mapInArrow(toxicity._extract(kinds), "o1 long, o2 long, label int, weight double, features array<int>, swaps array<struct<lost:array<int>,gained:array<int>>>").collect()
    assert [len(r.swaps) for r in got] == [59, 8]  # every eleventh of 648
