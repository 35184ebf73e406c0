"""Registered queries of speech cutting and their SQL: events of a user are samples at ten a second, every sixth one a word."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import speech
from chronoweave.plans.catalog import query
from chronoweave.plans.signals import _N, _samples

#: Rules at the scale of these samples.
_P = speech.Pauses(rate=10, over_floor=60.0, under_speech=40.0, silence=0.2, air=0.05, filler_rest=0.2, before=(0.7, 0.1, 0.3, 0.2), after=(0.1, 0.7, 0.2, 0.4), edge=(0.3, 0.1), tail=(0.1, 0.3), least_cut=0.05, pause=(0.2, 0.1), sentence_pause=(0.3, 0.2), near=0.02, shortest=0.03, piece=0.25)

_BASE = f"""{_N}, w as (select user_id, i // 6 as ord, i / 10.0::double as s, (i + 1 + event_id % 3) / 10.0::double as e, event_type = 'click' as filler, event_type = 'purchase' as ended from n where i % 6 = 0),
    p as (select user_id, k as part, k * 2.5::double as a, k * 2.5::double + 2.3 as z from (select user_id from n group by user_id having count(*) >= 60), range(2) as x(k)),
    fl as (select user_id, quantile_cont(value, 0.05) as floor from n group by user_id),
    sp as (select p.user_id, part, quantile_cont(value, 0.9) as speech from p join n on n.user_id = p.user_id and i between (a * 10)::bigint and greatest((z * 10)::bigint, (a * 10)::bigint + 2) - 1 group by all),
    q as (select p.*, least(floor + 60, speech - 40) as quiet from p join fl using (user_id) join sp using (user_id, part)),
    u as (select w.*, part, a, z, quiet from w join q on w.user_id = q.user_id and (s + e) / 2 between a and z)"""


def _runs(name: str, spans: str, least: int) -> str:
    """Silence runs of spans (user_id, part, ord, quiet, x, y)."""
    return f"""{name}_s as ({spans}), {name}_i as (select t.*, i from {name}_s t join n on n.user_id = t.user_id and i between greatest(0, trunc(x * 10)::bigint) and greatest(0, trunc(y * 10)::bigint) where x <= y and value <= quiet),
    {name}_g as (select *, i - row_number() over (partition by user_id, part, ord order by i) as g from {name}_i), {name} as (select user_id, part, ord, min(i) as f, max(i) + 1 as t from {name}_g group by user_id, part, ord, g having count(*) >= {least})"""


_PLAN = (
    f"with recursive {_BASE}, "
    + _runs("br", "select user_id, part, ord, quiet, s - 0.7 as x, s + 0.1 as y from u where filler", 2)
    + ", "
    + _runs("ar", "select user_id, part, ord, quiet, e - 0.1 as x, e + 0.7 as y from u where filler", 2)
    + """, bb as (select br.user_id, br.part, br.ord, f / 10.0::double as f, t / 10.0::double as t, row_number() over (partition by br.user_id, br.part, br.ord order by f desc) as r from br join u using (user_id, part, ord) where t / 10.0::double between s - 0.3 and s + 0.2),
    aa as (select ar.user_id, ar.part, ar.ord, f / 10.0::double as f, t / 10.0::double as t, row_number() over (partition by ar.user_id, ar.part, ar.ord order by f) as r from ar join u using (user_id, part, ord) where f / 10.0::double between e - 0.2 and e + 0.4),
    m as (select u.*, bb.f as bf, bb.t as bt, aa.f as af, aa.t as at_ from u left join bb on bb.user_id = u.user_id and bb.part = u.part and bb.ord = u.ord and bb.r = 1 left join aa on aa.user_id = u.user_id and aa.part = u.part and aa.ord = u.ord and aa.r = 1 where filler and (bb.f is not null or aa.f is not null)),
    l1 as (select m.user_id, part, ord, (list(i order by value, i))[1] / 10.0::double as v from m join n on n.user_id = m.user_id and i between greatest(0, trunc((s - 0.3) * 10)::bigint) and greatest(0, trunc((s - 0.3) * 10)::bigint, trunc((s + 0.1) * 10)::bigint) group by all),
    l2 as (select m.user_id, part, ord, (list(i order by value, i))[1] / 10.0::double as v from m join n on n.user_id = m.user_id and i between greatest(0, trunc((e - 0.1) * 10)::bigint) and greatest(0, trunc((e - 0.1) * 10)::bigint, trunc((e + 0.3) * 10)::bigint) group by all),
    fc as (select m.user_id, m.part, m.ord, coalesce(bf + least(0.1, (bt - bf) / 2), l1.v) as c, coalesce(at_ - least(0.1, (at_ - af) / 2), l2.v) as d from m left join l1 using (user_id, part, ord) left join l2 using (user_id, part, ord)),
    f as (select * from fc where d > c + 0.05), k as (select u.* from u left join f using (user_id, part, ord) where f.c is null),
    pr as (select *, lead(s + 0.3 * (e - s)) over (partition by user_id, part order by ord) as y from k), """
    + _runs("rr", "select user_id, part, ord, quiet, s + 0.5 * (e - s) as x, y from pr where y is not null", 1)
    + """, lp as (select rr.user_id, rr.part, rr.ord, f / 10.0::double as r0, t / 10.0::double as r1, case when ended then 0.2 else 0.1 end as goal from rr join k using (user_id, part, ord) where (t - f) / 10.0::double > case when ended then 0.3 else 0.2 end),
    ps as (select * from lp where not exists (select 1 from f where f.user_id = lp.user_id and f.part = lp.part and f.c < lp.r1 and f.d > lp.r0)),
    raw as (select user_id, part, c, d, 'filler' as why from f union all select user_id, part, r0 + greatest(goal, 0.1) / 2, r1 - greatest(goal, 0.1) / 2, 'pause' from ps),
    cl as (select raw.user_id, raw.part, greatest(c, a) as c, least(d, z) as d, why from raw join p using (user_id, part) where d > a and c < z), o as (select *, row_number() over (partition by user_id, part order by c, d, why) as j from cl),
    x as (select user_id, part, j, case when d - c >= 0.03 then 1 else 0 end as number, case when d - c >= 0.03 then d else -1e308 end as reached, d - c >= 0.03 as kept from o where j = 1
      union all select o.user_id, o.part, o.j, case when o.c > x.reached + 0.02 and o.d - o.c >= 0.03 then x.number + 1 else x.number end, case when o.c <= x.reached + 0.02 then greatest(x.reached, o.d) when o.d - o.c >= 0.03 then o.d else x.reached end, o.c <= x.reached + 0.02 or o.d - o.c >= 0.03 from x join o on o.user_id = x.user_id and o.part = x.part and o.j = x.j + 1),
    cuts as (select o.user_id, o.part, min(c) as c, max(d) as d, string_agg(why, '+' order by c, d, why) as why from x join o using (user_id, part, j) where kept group by o.user_id, o.part, number)"""
)


def _planned(spark, sf):
    s = _samples(spark, sf)
    samples = s.select("user_id", F.col("i").cast("long").alias("i"), F.col("value").alias("level"))
    words = s.where("i % 6 = 0").select("user_id", F.expr("i div 6").alias("ord"), (F.col("i") / F.lit(10.0)).alias("s"), ((F.col("i") + 1 + F.col("event_id") % 3) / F.lit(10.0)).alias("e"), "event_type")
    long = s.groupBy("user_id").count().where("count >= 60").select("user_id")
    parts = long.select("user_id", F.explode(F.expr("sequence(0L, 1L)")).alias("part")).withColumn("start", F.col("part") * F.lit(2.5)).withColumn("end", F.col("part") * F.lit(2.5) + 2.3)
    return speech.planned_cuts(words, samples, parts, ["user_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", 2, _P)


@query(_PLAN + ' select user_id, part, round(c, 6) as start, round(d, 6) as "end", why from cuts')
def planned_cuts(spark, sf):
    """W46, with W7, J4 and W5: fillers and long pauses cut out of parts."""
    c, _ = _planned(spark, sf)
    return c.select("user_id", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "why")


@query(_PLAN + """, b1 as (select *, row_number() over (partition by user_id, part order by v) as r from (select user_id, part, a as v from p union all select user_id, part, d from cuts)), b2 as (select *, row_number() over (partition by user_id, part order by v) as r from (select user_id, part, c as v from cuts union all select user_id, part, z from p)),
    pc as (select b1.user_id, b1.part, b1.v as a, b2.v as z from b1 join b2 using (user_id, part, r) where b2.v - b1.v >= 0.25), nm as (select *, row_number() over (partition by user_id, part order by a) - 1 as k, count(*) over (partition by user_id, part) as c from pc)
    select user_id, round(a, 6) as start, round(z, 6) as "end", part || case when c = 1 then '' else chr((97 + k)::int) end as name from nm""")
def cut_pieces(spark, sf):
    """The pieces of parts that stay, named by part and letter."""
    _, p = _planned(spark, sf)
    return p.select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "name")


@query(f"with {_BASE}, h as (select u.user_id, u.part, u.ord, u.quiet, u.s, u.e, v.s as next_s from u left join w v on v.user_id = u.user_id and v.ord = u.ord + 1 where u.ended), "
    + _runs("br", "select user_id, part, ord, quiet, greatest(0, s - 0.8) as x, s + 0.05 as y from h", 1)
    + ", "
    + _runs("ar", "select user_id, part, ord, quiet, greatest(0, e - 0.1) as x, e + 1.0 as y from h", 1)
    + """, bb as (select h.user_id, h.part, h.ord, f / 10.0::double as f, t / 10.0::double as t, row_number() over (partition by h.user_id, h.part, h.ord order by f desc) as r from br join h using (user_id, part, ord) where t / 10.0::double <= s + 0.1),
    aa as (select user_id, part, ord, f / 10.0::double as f, t / 10.0::double as t, row_number() over (partition by user_id, part, ord order by f) as r from ar),
    j as (select h.*, greatest(0, coalesce(greatest(bb.f + least(0.03, (bb.t - bb.f) / 2), bb.t - 0.12), s - 0.12)) as a, coalesce(aa.f + least(0.25, (aa.t - aa.f) / 2), e + 0.3) as z from h left join bb on bb.user_id = h.user_id and bb.part = h.part and bb.ord = h.ord and bb.r = 1 left join aa on aa.user_id = h.user_id and aa.part = h.part and aa.ord = h.ord and aa.r = 1),
    k as (select *, greatest(1, ceil((z - a) / 0.3 - 0.04)) as beats from j)
    select user_id, ord, round(a, 6) as start, round(z, 6) as "end", (case when coalesce(next_s < a + beats * 0.3 - 0.03 and beats > 1 and e + 0.15 <= a + (beats - 1) * 0.3, false) then beats - 1 else beats end)::int as beats from k""")
def snapped_phrases(spark, sf):
    """Words snapped to the silences around them, in beats."""
    s = _samples(spark, sf)
    samples = s.select("user_id", F.col("i").cast("long").alias("i"), F.col("value").alias("level"))
    words = s.where("i % 6 = 0").select("user_id", F.expr("i div 6").alias("ord"), (F.col("i") / F.lit(10.0)).alias("s"), ((F.col("i") + 1 + F.col("event_id") % 3) / F.lit(10.0)).alias("e"), "event_type")
    words = words.withColumn("next_s", F.lead("s").over(Window.partitionBy("user_id").orderBy("ord")))
    long = s.groupBy("user_id").count().where("count >= 60").select("user_id")
    parts = long.select("user_id", F.explode(F.expr("sequence(0L, 1L)")).alias("part")).withColumn("start", F.col("part") * F.lit(2.5)).withColumn("end", F.col("part") * F.lit(2.5) + 2.3)
    from chronoweave.operators import matching

    limits = speech.with_limits(parts, samples, ["user_id"], _P)
    found = matching.points_in_intervals(words.where("event_type = 'purchase'").withColumn("m", (F.col("s") + F.col("e")) / 2), limits, ["user_id"], "m", "start", "end", 2).drop("start", "end")
    out = speech.snapped_phrases(found, samples, ["user_id"], "ord", 0.3, "quiet", 10)
    return out.select("user_id", "ord", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "beats")
