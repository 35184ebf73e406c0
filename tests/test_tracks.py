"""Edges of the track operators: empty tables, single rows, nulls, ties."""

import math

from pyspark.sql import functions as F

from chronoweave.operators import tracks

SCHEMA = "k string, t long, v long"


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_padded_sum_repeats_the_ends(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 40), ("b", 1, 7)], SCHEMA)
    assert _rows(tracks.padded_sum(df, ["k"], ["t"], F.col("v"), 2), "k", "t", "total") == [
        ("a", 1, 10 + 10 + 10 + 20 + 40), ("a", 2, 10 + 10 + 20 + 40 + 40), ("a", 3, 10 + 20 + 40 + 40 + 40), ("b", 1, 35),
    ]


def test_cores_take_the_first_peak_and_pass_nulls(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 10), ("a", 3, 10), ("a", 4, 4), ("a", 5, None), ("a", 6, 8)], SCHEMA)
    assert _rows(tracks.run_cores(df, ["k"], "t", "v", 2, 0.5), "start", "end", "peak_at", "core_start", "core_end") == [(1, 4, 2, 2, 3), (6, 6, 6, 6, 6)]


def test_earlier_match_leaves_the_neighbour_out(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 1, 2, 1])], SCHEMA)
    assert [r[1] for r in _rows(tracks.earlier_match(df, ["k"], ["v"], "t", 3, 2), "t", "match")] == [None, None, 0, None, 1]


def test_decay_starts_at_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 3, 0)], SCHEMA)
    got = [r[1] for r in _rows(tracks.decayed(df, ["k"], "t", F.col("v") == 1, 2.0), "t", "glow")]
    assert got[:2] == [0.0, 1.0] and math.isclose(got[2], math.exp(-1))


def test_pauses_letters_samples(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 30, 40), ("a", 45, 50)], "k string, s long, e long")
    assert _rows(tracks.shortened_gaps(df, ["k"], "s", "e", 10, 5), "gap_start", "gap_end", "cut_start", "cut_end") == [(10, 30, 12, 27)]
    assert _rows(tracks.samples(df.limit(1), ["k"], "s", "e"), "number", "at") == [(0, 0), (1, 3), (2, 6), (3, 10)]
    many = spark.createDataFrame([("a", 7, i) for i in range(28)] + [("a", 8, 0)], "k string, p int, i int")
    names = [r[2] for r in _rows(tracks.lettered(many, ["k"], "p", ["i"]), "p", "i", "name")]
    assert names[0] == "7a" and names[25:28] == ["7z", "7aa", "7ab"] and names[28] == "8"


def test_scores_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None)], SCHEMA)
    assert [r[1] for r in _rows(tracks.standardised(df, ["k"], F.col("v")), "t", "z")] == [0.0, 0.0, None]
    assert _rows(tracks.scored(df, {"low": (F.col("v") < 6, 0.5), "late": (F.col("t") > 1, 0.5)}), "t", "score", "flags") == [(1, 50.0, "low"), (2, 25.0, "low,late"), (3, 50.0, "late")]
    empty = df.limit(0)
    for out in (tracks.padded_sum(empty, ["k"], ["t"], F.col("v"), 2), tracks.level_db(empty, ["k"], ["t"], F.col("v"), 2), tracks.run_cores(empty, ["k"], "t", "v", 1, 0.5), tracks.standardised(empty, ["k"], F.col("v"))):
        assert out.count() == 0
