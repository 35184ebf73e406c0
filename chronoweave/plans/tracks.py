"""Registered queries of the track operators and their SQL; they join the catalog's when this module is imported."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import tracks
from chronoweave.plans.catalog import _E, _SESS, HOUR, _events, _read, _sessions, query

_W = "over (partition by user_id order by t"
_C = f"{_E}, c as (select *, round(value * 100)::bigint as v from e)"


def _cents():
    return F.round(F.col("value") * 100).cast("long")


@query(f"""with {_C}, p as (select *, row_number() {_W}) as i, count(*) over (partition by user_id) as n, first_value(v) {_W}) as a,
    last_value(v) {_W} rows between unbounded preceding and unbounded following) as b, sum(v) {_W} rows between 4 preceding and 4 following) as s from c)
    select event_id, (s + greatest(0, 5 - i) * a + greatest(0, i + 4 - n) * b)::bigint as total from p""")
def padded_moving_sum(spark, sf):
    """Moving sums whose ends repeat the first and the last value."""
    return tracks.padded_sum(_events(spark, sf), ["user_id"], ["t"], _cents(), 4).select("event_id", "total")


@query(f"""with {_C} select event_id, round(10 * log10(avg((v * v)::double) {_W} rows between 3 preceding and 3 following)), 6) as db from c""")
def sliding_level(spark, sf):
    """Level of a sliding window in decibels."""
    return tracks.level_db(_events(spark, sf), ["user_id"], ["t"], _cents(), 3).select("event_id", F.round("db", 6).alias("db"))


@query(f"""with {_E}, r as (select *, row_number() {_W}) - row_number() over (partition by user_id, value > 60 order by t) as g from e),
    p as (select *, max(value) over (partition by user_id, g) as peak from r where value > 60)
    select user_id, min(t) as start, max(t) as "end", min(t) filter (value = peak) as peak_at, min(t) filter (value >= 0.5 * peak) as core_start, max(t) filter (value >= 0.5 * peak) as core_end
    from p group by user_id, g""")
def run_cores(spark, sf):
    """First peak and core of every run."""
    return tracks.run_cores(_events(spark, sf), ["user_id"], "t", "value", 60, 0.5)


@query(f"""with {_E}, n as (select *, row_number() {_W}) as i from e)
    select a.event_id, min(b.i) as match from n a left join n b on a.user_id = b.user_id and a.event_type = b.event_type and b.i between a.i - 10 and a.i - 2 group by a.event_id""")
def earlier_similar(spark, sf):
    """Earliest similar row among the ten before, without the direct neighbour."""
    e = _events(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t")))
    return tracks.earlier_match(e, ["user_id"], ["event_type"], "i", 10, 2).select("event_id", "match")


@query(f"""with {_E} select a.event_id, round(coalesce(max(exp((b.t - a.t) / {6.0 * HOUR})), 0), 6) as glow
    from e a left join e b on a.user_id = b.user_id and b.t <= a.t and b.event_type = 'purchase' group by a.event_id""")
def decaying_highlight(spark, sf):
    """Highlight that fades after every purchase."""
    return tracks.decayed(_events(spark, sf), ["user_id"], "t", F.col("event_type") == "purchase", 6.0 * HOUR).select("event_id", F.round("glow", 6).alias("glow"))


@query(_SESS + f""", g as (select user_id, "end" as gap_start, lead(start) over (partition by user_id order by start, "end") as gap_end from sess)
    select user_id, gap_start, gap_end, gap_start + {HOUR} as cut_start, gap_end - {HOUR} as cut_end from g where gap_end - gap_start > {24 * HOUR}""")
def pause_cuts(spark, sf):
    """Long pauses cut down to two hours."""
    return tracks.shortened_gaps(_sessions(_events(spark, sf)), ["user_id"], "start", "end", 24 * HOUR, 2 * HOUR)


@query("""with p as (select conv_id, turn, row_number() over (partition by conv_id, role order by turn) - 1 as k, count(*) over (partition by conv_id, role) as n, role from conversations)
    select conv_id, turn, role || case when n = 1 then '' when k < 26 then chr((97 + k)::int) else chr((96 + k // 26)::int) || chr((97 + k % 26)::int) end as name from p""")
def lettered_pieces(spark, sf):
    """Pieces of a part renamed with letters."""
    return tracks.lettered(_read(spark, sf, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "name")


@query(_SESS + """ select user_id, start, k as number, case when k = 3 then "end" else start + floor(("end" - start) * k / 3)::bigint end as at from sess, range(4) as r(k)""")
def interval_samples(spark, sf):
    """Four times per session."""
    return tracks.samples(_sessions(_events(spark, sf)), ["user_id", "start"], "start", "end")


@query(f"""with {_C} select event_id, round(case when stddev_pop(v) over (partition by event_type) > 0 then (v - avg(v) over (partition by event_type)) / stddev_pop(v) over (partition by event_type) else 0 end, 6) as z from c""")
def standard_scores(spark, sf):
    """C11: values in standard deviations of their type."""
    return tracks.standardised(_events(spark, sf), ["event_type"], _cents()).select("event_id", F.round("z", 6).alias("z"))


@query("""select doc_id, 100.0::double * (case when n_chars < 400 then 0.5 else 1 end)::double * (case when lang <> 'en' then 0.75 else 1 end)::double * (case when text like '%http%' then 0.25 else 1 end)::double as score,
    concat_ws(',', case when n_chars < 400 then 'short' end, case when lang <> 'en' then 'foreign' end, case when text like '%http%' then 'links' end) as flags from documents""")
def penalty_scores(spark, sf):
    """Score with factors and flags."""
    rules = {"short": (F.col("n_chars") < 400, 0.5), "foreign": (F.col("lang") != "en", 0.75), "links": (F.col("text").contains("http"), 0.25)}
    return tracks.scored(_read(spark, sf, "documents"), rules).select("doc_id", "score", "flags")


@query(f"""with {_C}, d as (select user_id, t // {24 * HOUR} as day, v, event_type from c)
    select user_id, day, sum(v)::bigint as spent, count(*) as n, count(distinct event_type) as types from d group by user_id, day having sum(v) > 30000""")
def budget_breaches(spark, sf):
    """Groups whose sum is over a budget."""
    d = _events(spark, sf).withColumn("day", F.expr(f"t div {24 * HOUR}")).groupBy("user_id", "day")
    return d.agg(F.sum(_cents()).alias("spent"), F.count("*").alias("n"), F.count_distinct("event_type").alias("types")).where("spent > 30000")


@query("""with s as (select conv_id, role, sum(length(coalesce(text, '')))::bigint as chars, count(*) as turns from conversations group by conv_id, role)
    select *, round(100.0 * chars / nullif(sum(chars) over (partition by conv_id), 0), 6)::double as percent from s""")
def talk_share(spark, sf):
    """Share of every role in a conversation."""
    s = _read(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("turns"))
    whole = F.sum("chars").over(Window.partitionBy("conv_id"))
    return s.withColumn("percent", F.round(100.0 * F.col("chars") / F.when(whole > 0, whole), 6))
