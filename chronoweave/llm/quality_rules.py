"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Counts follow from one array of words and one of lines. Windows of three words are hashed; only where a hash repeats are they
sorted with their places, so that a window found again stands beside its equal, and the words that such windows cover are
counted from the sorted places.

Defined results: a null text has no words and fails; equal texts get equal results; columns beside the id and the text
are not read. A ratio with nothing below the line is null, and a null ratio breaks no rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Broken where the metric is below ``low`` or above ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Frequent words of four languages.
STOP_WORDS = tuple(
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les en un du une que est pour qui dans par sur au pas avec ce il "
    "el y los se del las por con no su para es al lo como más".split()
)
#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_chars", 1.5, 20.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("stop_word_share", 0.01, None),
    Rule("dup_line_share", None, 0.5),
    Rule("upper_share", None, 0.5),
)
SPACE = r"[\x20\x09-\x0D]+"


def _with(value: Column, then) -> Column:
    """``then(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Number of words inside windows of three words that the array holds twice or more. Windows are compared by 64-bit hashes; places are sorted only if any repeats."""
    size = F.size(words)

    def covered(places: Column) -> Column:
        # Words i, i+1, i+2 per place; a place nearer than 3 to the next adds only the gap.
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    def places(sorted_windows: Column) -> Column:
        same = F.filter(sorted_windows, lambda w, i: F.get(sorted_windows, i - 1)["w"].eqNullSafe(w["w"]) | F.get(sorted_windows, i + 1)["w"].eqNullSafe(w["w"]))
        return _with(F.sort_array(F.transform(same, lambda w: w["i"])), covered)

    def repeated(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_with(F.sort_array(placed), places))

    windows = F.transform(F.slice(words, 1, size - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(size < 4, F.lit(0).cast("long")).otherwise(_with(windows, repeated))


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple = STOP_WORDS) -> DataFrame:
    """doc_id, the base counts and the ratios that rules may name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _with(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d"))).alias("lines"),
        _with(F.col("w"), _repeat_words).alias("n_repeat_words"),
        F.size(F.filter(F.split(F.lower("t"), SPACE), lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))).cast("long").alias("n_upper"),
    )
    words = F.nullif(F.col("n_words"), F.lit(0))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_stop_words") / words).alias("stop_word_share"),
        (F.col("lines.d") / F.nullif(F.col("lines.n"), F.lit(0))).alias("dup_line_share"),
        (F.col("n_upper") / words).alias("upper_share"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule is broken; the whole table is one expression."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & F.coalesce(F.col(r.metric) >= r.low, F.lit(True))
        if r.high is not None:
            ok = ok & F.coalesce(F.col(r.metric) <= r.high, F.lit(True))
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, **names) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the ratios of every document."""
    m = metrics(docs, **names)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.select(*base, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), *[c for c in m.columns if c not in base])
