"""Registered queries of sampled signals, sequential choices, turns and synchronisation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import files
from chronoweave.operators import choice, selection, signals, sync, turns
from chronoweave.plans.catalog import _E, HOUR, _events, _read, query

#: Events of a user as samples: number i from 0, value v in cents.
_N = f"{_E}, n as (select *, row_number() over (partition by user_id order by t) - 1 as i, round(value * 100)::bigint as v from e)"


def _samples(spark, sf):
    e = _events(spark, sf)
    return e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) - 1).withColumn("v", F.round(F.col("value") * 100).cast("long"))


@query(f"""with recursive {_N}, r as (select user_id, i, event_id, least(value, 100.0::double) / 100 as level from n where i = 0
    union all select n.user_id, n.i, n.event_id, r.level + least(greatest(least(n.value, 100.0::double) / 100 - r.level, -0.2::double), 0.05::double) from r join n on n.user_id = r.user_id and n.i = r.i + 1)
    select event_id, round(level, 6) as level from r""")
def limiter_curve(spark, sf):
    """A level that falls fast and rises slowly, from the first target on."""
    e = _events(spark, sf).select("user_id", "event_id", "t", (F.least(F.col("value"), F.lit(100.0)) / 100).alias("target"))
    return selection.limited(e, ["user_id"], ["t"], "target", 0.2, 0.05).select("event_id", F.round("level", 6).alias("level"))


@query(f"""with recursive {_N}, r as (select user_id, i, event_id, value as position from n where i = 0
    union all select n.user_id, n.i, n.event_id, r.position + sign(n.value - r.position) * least(15.0::double, greatest(0.0::double, abs(n.value - r.position) - 20)) from r join n on n.user_id = r.user_id and n.i = r.i + 1)
    select event_id, round(position, 6) as position from r""")
def dead_zone_follow(spark, sf):
    """W30, the recurrence: a position that rests within a dead zone and else follows in steps."""
    e = _events(spark, sf).select("user_id", "event_id", "t", "value")
    return selection.followed(e, ["user_id"], ["t"], "value", 20.0, 15.0).select("event_id", F.round("position", 6).alias("position"))


@query(f"""with recursive {_N}, z0 as (select *, i / 5.0::double as tt, case when event_type <> 'error' then value end as x from n),
    z1 as (select *, max(case when x is not null then i end) over (partition by user_id order by i) as b, min(case when x is not null then i end) over (partition by user_id order by i rows between current row and unbounded following) as a from z0),
    z2 as (select z1.*, coalesce(case when z1.a > z1.b then p.x + (q.x - p.x) * (z1.tt - p.tt) / (q.tt - p.tt) else p.x end, p.x, q.x, 200.0) as z from z1 left join z0 p on p.user_id = z1.user_id and p.i = z1.b left join z0 q on q.user_id = z1.user_id and q.i = z1.a),
    l as (select user_id, max(i) as last_ from n group by user_id),
    m as (select o.user_id, o.i, o.event_id, median(y.z) as m from z2 o join l using (user_id) cross join (select unnest(range(-2, 3)) as d) k join z2 y on y.user_id = o.user_id and y.i = least(greatest(o.i + d, 0), last_) group by all),
    f as (select m.user_id, m.i, m.event_id, y.m as aim from m join l using (user_id) join m y on y.user_id = m.user_id and y.i = least(m.i + 2, last_)),
    r as (select user_id, i, event_id, aim as p from f where i = 0
      union all select f.user_id, f.i, f.event_id, r.p + sign(f.aim - r.p) * least(10.0::double, greatest(0.0::double, abs(f.aim - r.p) - 15)) from r join f on f.user_id = r.user_id and f.i = r.i + 1),
    w as (select unnest(range(-6, 7)) as d), ww as (select d, exp(-0.5 * pow(d / 1.5, 2)) / (select sum(exp(-0.5 * pow(d / 1.5, 2))) from w) as g from w),
    s as (select r.event_id, sum(y.p * g) as s from r join l using (user_id) cross join ww join r y on y.user_id = r.user_id and y.i = least(greatest(r.i + d, 0), last_) group by r.event_id)
    select event_id, round(least(greatest(s, 0.0), 400.0), 6) as position from s""")
def reframed_window(spark, sf):
    """Gaps bridged, running median, look-ahead, the recurrence and smoothing; errors are frames without a target."""
    e = _samples(spark, sf).select("user_id", "event_id", (F.col("i") / 5.0).alias("t"), F.when(F.col("event_type") != "error", F.col("value")).alias("x"))
    return selection.reframed(e, ["user_id"], "t", "x", fps=5.0, width=500, window=100).select("event_id", F.round("position", 6).alias("position"))


@query(f"""with recursive {_N}, m as (select *, -abs(v - 2000) as x0, -abs(v - 20000) as x1 from n),
    f(user_id, i, event_id, s0, s1, c0, c1) as (select user_id, i, event_id, x0, x1, 0, 1 from m where i = 0
      union all select m.user_id, m.i, m.event_id, case when f.s0 >= f.s1 - 6000 then f.s0 else f.s1 - 6000 end + x0, case when f.s1 >= f.s0 - 6000 then f.s1 else f.s0 - 6000 end + x1,
        case when f.s0 >= f.s1 - 6000 then 0 else 1 end, case when f.s1 >= f.s0 - 6000 then 1 else 0 end from f join m on m.user_id = f.user_id and m.i = f.i + 1),
    b(user_id, i, event_id, label, came) as (select user_id, i, event_id, case when s0 >= s1 then 0 else 1 end, case when s0 >= s1 then c0 else c1 end from f qualify row_number() over (partition by user_id order by i desc) = 1
      union all select f.user_id, f.i, f.event_id, b.came, case when b.came = 0 then f.c0 else f.c1 end from b join f on f.user_id = b.user_id and f.i = b.i - 1)
    select event_id, label::bigint as label from b""")
def viterbi_labels(spark, sf):
    """Two labels by distance to 20 and 200 with a price per change."""
    e = _samples(spark, sf).select("user_id", "event_id", "t", F.array(-F.abs(F.col("v") - 2000), -F.abs(F.col("v") - 20000)).alias("x"))
    return selection.label_path(e, ["user_id"], ["t"], "x", 6000).select("event_id", "label")


@query(f"""with recursive {_E}, h as (select user_id, t / {float(HOUR)}::double as hours, value from e), n as (select *, row_number() over (partition by user_id order by value desc, hours) as i from h),
    r as (select user_id, i, hours, value, [hours] as picked, value as best, 1 as rank from n where i = 1
      union all select n.user_id, n.i, n.hours, n.value, case when not (len(picked) >= 5 or len(picked) >= 3 and n.value < 0.5 * best) and len(list_filter(picked, lambda x: abs(n.hours - x) < 6)) = 0 then list_append(picked, n.hours) else picked end, best,
        case when not (len(picked) >= 5 or len(picked) >= 3 and n.value < 0.5 * best) and len(list_filter(picked, lambda x: abs(n.hours - x) < 6)) = 0 then len(picked) + 1 end from r join n on n.user_id = r.user_id and n.i = r.i + 1)
    select user_id, hours, value, rank::int as rank from r where rank is not null""")
def greedy_topn_spaced(spark, sf):
    """T4, T5, W17, the selection: best events of a user six hours apart."""
    e = _events(spark, sf).select("user_id", (F.col("t") / float(HOUR)).alias("hours"), "value")
    return selection.spaced_top(e, ["user_id"], "hours", "value", 6.0, 5)


@query(f"""with recursive {_E}, c as (select user_id, t / {float(HOUR)}::double as a, t / {float(HOUR)}::double + value / 1000 as z, event_type as why from e), n as (select *, row_number() over (partition by user_id order by a, z, why) as i from c),
    r as (select user_id, i, case when z - a >= 0.03 then 1 else 0 end as number, case when z - a >= 0.03 then z else -1e308 end as reached, z - a >= 0.03 as kept from n where i = 1
      union all select n.user_id, n.i, case when n.a > r.reached + 0.02 and n.z - n.a >= 0.03 then r.number + 1 else r.number end,
        case when n.a <= r.reached + 0.02 then greatest(r.reached, n.z) when n.z - n.a >= 0.03 then n.z else r.reached end, n.a <= r.reached + 0.02 or n.z - n.a >= 0.03 from r join n on n.user_id = r.user_id and n.i = r.i + 1)
    select r.user_id, min(a) as start, max(z) as "end", string_agg(why, '+' order by a, z, why) as why from r join n on n.user_id = r.user_id and n.i = r.i where kept group by r.user_id, number""")
def merged_cuts(spark, sf):
    """Cuts joined with their reasons; short cuts that join none bridge nothing."""
    hours = F.col("t") / float(HOUR)
    c = _events(spark, sf).select("user_id", hours.alias("start"), (hours + F.col("value") / 1000).alias("end"), F.col("event_type").alias("why"))
    return selection.merged_cuts(c, ["user_id"], "start", "end", "why")


@query()
def min_cost_groups(spark, sf):
    """Words of a turn in groups of one to three at the least sum of prices."""
    t = _read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("width", F.length("w").cast("double"))
    t = t.withColumn("hard", F.lag("w").over(Window.partitionBy("conv_id", "turn").orderBy("i")).rlike("[.?!,]$"))
    return selection.word_groups(t, ["conv_id", "turn"], ["i"], "w", "width", "hard", 18.0).select("conv_id", "turn", "i", "grp")


@query(f"""with {_N}, p as (select user_id, k as part, (k * 20) / 10.0 as a, (k * 20 + 15) / 10.0 as z from (select distinct user_id from n), range(3) as x(k)),
    q as (select p.user_id, part, i from p join n on n.user_id = p.user_id and i between (a * 10)::bigint and (z * 10)::bigint where value <= 60), r as (select *, i - row_number() over (partition by user_id, part order by i) as g from q)
    select user_id, part, min(i) as "from", max(i) + 1 as "to" from r group by user_id, part, g having count(*) >= 2""")
def silence_runs(spark, sf):
    """Runs of low samples inside the parts of a recording."""
    s = _samples(spark, sf)
    parts = s.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(0L, 2L)")).alias("part"))
    parts = parts.select("user_id", "part", (F.col("part") * 20 / 10.0).alias("a"), ((F.col("part") * 20 + 15) / 10.0).alias("z"))
    return signals.silence_runs(s, parts, ["user_id"], "part", "i", "value", "a", "z", 60, 10, 2)


@query(f"""with {_N}, g as (select a.event_id, a.i, b.v, b.i as j, min(b.i) over (partition by a.event_id) as lo, max(b.i) over (partition by a.event_id) as hi from n a join n b on a.user_id = b.user_id and b.i between a.i - 4 and a.i + 4),
    x as (select event_id, v, 1 + case when j = lo then lo - i + 4 else 0 end + case when j = hi then i + 4 - hi else 0 end as times from g), c as (select *, sum(times) over (partition by event_id order by v, times rows unbounded preceding) as upto from x)
    select event_id, min(v) as ranked from c where upto > 7 group by event_id""")
def rank_filter(spark, sf):
    """The value of rank seven of nine around a sample, ends repeated."""
    return signals.rank_filtered(_samples(spark, sf), ["user_id"], "i", "v", 4, 80).select("event_id", "ranked")


@query(f"""with {_N}, d as (select *, greatest(0, coalesce(ln(value + 1e-4) - lag(ln(value + 1e-4)) over (partition by user_id order by i), 0)) as rise from n)
    select event_id, round(sum(rise) over (partition by user_id order by i rows between 4 preceding and 4 following), 6) as onset from d""")
def onset_curve(spark, sf):
    """Rising logarithms, summed over nine samples."""
    return signals.onset_curve(_samples(spark, sf), ["user_id"], "i", "value").select("event_id", F.round("onset", 6).alias("onset"))


@query(f"""with {_N}, w as (select *, max(value) over (partition by user_id order by i rows between 2 preceding and 2 following) as near, case when i = 1 then 0 else median(value) over (partition by user_id order by i rows between 6 preceding and 2 preceding) end as base from n)
    select event_id from w where i > 0 and value >= near and value > 4 and value / (base + 0.5) >= 1.8""")
def cut_candidates(spark, sf):
    """Samples that stand out from those around and before them."""
    return signals.cut_candidates(_samples(spark, sf), ["user_id"], "i", "value").select("event_id")


@query(f"""with {_N}, r as (select user_id, k as region, k * 30 as a, k * 30 + 25 as z from (select distinct user_id from n), range(2) as x(k)),
    s as (select r.*, i, v from r join n on n.user_id = r.user_id and i >= a and i < z), h as (select user_id, region, quantile_cont(v, 0.8) as high from s group by all),
    q as (select s.*, i - row_number() over (partition by s.user_id, s.region order by i) as g from s join h on s.user_id = h.user_id and s.region = h.region where v < high - 5000),
    p as (select user_id, region, min(i) as pa, max(i) + 1 as pz from q group by user_id, region, a, z, g having count(*) >= 2 and min(i) > a and max(i) + 1 < z),
    b as (select user_id, region, a as pos, 0 as e from r union all select user_id, region, z, 1 from r union all select user_id, region, pa, 1 from p union all select user_id, region, pz, 0 from p),
    o as (select *, lead(pos) over (partition by user_id, region order by pos, e) as z from b)
    select user_id, region, row_number() over (partition by user_id, region order by pos) - 1 as piece, pos as a, z from o where e = 0""")
def pause_pieces(spark, sf):
    """Regions split at pauses under their own 80th percentile."""
    s = _samples(spark, sf)
    regions = s.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(0L, 1L)")).alias("region")).select("user_id", "region", (F.col("region") * 30).alias("a"), (F.col("region") * 30 + 25).alias("z"))
    return signals.split_at_pauses(s, regions, ["user_id"], "region", "i", "v", "a", "z", 5000, 2).select("user_id", "region", F.col("piece").cast("long").alias("piece"), "a", "z")


@query(f"""with {_N}, u as (select user_id, i // 12 as number, min(i) as a, max(i) + 1 as z, case when (i // 12) % 3 = 2 then 'y' else 'x' end as label from n group by all),
    l as (select *, lead(a) over (partition by user_id order by number) as na, lead(z) over (partition by user_id order by number) as nz, lead(label) over (partition by user_id order by number) as nl from u),
    c as (select l.user_id, number, n.i, v from l join n on n.user_id = l.user_id and n.i between greatest(z - 3, a + 2) and least(z + 3, nz - 2) where na = z and nl <> label and least(z + 3, nz - 2) > greatest(z - 3, a + 2)),
    m as (select user_id, number, (list(i order by v, i))[1] as new from c group by all)
    select u.user_id, u.number, coalesce(lag(m.new) over (partition by u.user_id order by u.number), a) as a, coalesce(m.new, z) as z from u left join m on u.user_id = m.user_id and u.number = m.number""")
def quiet_bounds(spark, sf):
    """Bounds between speakers moved to the quietest sample nearby."""
    s = _samples(spark, sf)
    t = s.withColumn("number", F.expr("i div 12")).groupBy("user_id", "number").agg(F.min("i").cast("long").alias("a"), (F.max("i") + 1).cast("long").alias("z")).withColumn("label", F.when(F.col("number") % 3 == 2, "y").otherwise("x"))
    return signals.refined_bounds(s.withColumn("i", F.col("i").cast("long")), t, ["user_id"], "number", "i", "v", "a", "z", "label", 3, 2).select("user_id", "number", "a", "z")


@query(f"""with {_N}, f as (select user_id, event_id, i, [value, value * value / 100, 1.0] as x from n),
    p as (select a.user_id, a.event_id, b.i < a.i as before, list_dot_product(b.x, c.x) * case when (b.i < a.i) = (c.i < a.i) then 1 else -1 end as s from f a join f b on a.user_id = b.user_id and b.i between a.i - 3 and a.i + 2 join f c on a.user_id = c.user_id and c.i between a.i - 3 and a.i + 2),
    t as (select event_id, sum(s) as s, count(*) as c from p group by event_id)
    select n.event_id, round(case when c = 36 and n.i + 3 < z.z then greatest(0, s) else 0 end, 3) as novelty from n join t on n.event_id = t.event_id join (select user_id, count(*) as z from n group by user_id) z on z.user_id = n.user_id""")
def checkerboard_novelty(spark, sf):
    """Checkerboard novelty without a matrix of likenesses."""
    s = _samples(spark, sf).withColumn("x", F.array(F.col("value"), F.col("value") * F.col("value") / 100, F.lit(1.0)))
    return signals.novelty(s, ["user_id"], "i", "x", 3).join(s.select("user_id", "i", "event_id"), ["user_id", "i"]).select("event_id", F.round("novelty", 3).alias("novelty"))


@query(f"""with {_N}, p as (select a.user_id, a.i // 32 as block, b.i - a.i as lag, avg(a.v * b.v) as m from n a join n b on a.user_id = b.user_id and b.i - a.i between 2 and 6 and a.i // 32 = b.i // 32 group by all),
    r as (select *, row_number() over (partition by user_id, block order by m desc, lag) as k from p) select user_id, block, lag, round(m, 3) as strength from r where k = 1""")
def local_pulse(spark, sf):
    """The lag at which a block of samples is most like itself."""
    p = signals.local_pulse(_samples(spark, sf), ["user_id"], "i", "v", 32, 2, 6)
    return p.select("user_id", "block", F.col("lag").cast("long").alias("lag"), F.round("strength", 3).alias("strength"))


@query(f"""with {_N}, w as (select user_id, i, sum(v) over (partition by user_id order by i rows between current row and 4 following) as s, count(*) over (partition by user_id order by i rows between current row and 4 following) as c from n),
    r as (select *, row_number() over (partition by user_id order by s desc, i) as k from w where c = 5) select user_id, i as at, s::bigint as total from r where k = 1""")
def window_maximum(spark, sf):
    """Where five samples have the largest sum."""
    return signals.window_maximum(_samples(spark, sf), ["user_id"], "i", "v", 5).select("user_id", F.col("at").cast("long").alias("at"), "total")


_SHOTS = "s as (select l_orderkey as el, l_linenumber as n, min(l_partkey) as p, min(l_suppkey) as q from lineitem group by all)"


@query(f"""with {_SHOTS}, m as (select *, (['normal', 'fast', 'slow', 'speed', 'freeze', 'ramp', 'ramp_hold'])[1 + p % 7] as mode, 2 + q % 6 as beats, 0.5 + (p % 5) / 4.0 as value, (q % 4)::double as stop from s),
    k as (select *, (j * beats / 8.0)::double as b, j from m, range(9) as x(j)),
    v as (select *, case mode when 'fast' then 1.5 when 'slow' then 0.5 when 'speed' then value when 'freeze' then case when b < stop then 1 else 0 end when 'normal' then 1.0
      else case when b < 2 then 1 + 1.2 * (b / 2) * (b / 2) when b < 2.12 then 0.5 + 0.85 * (1 + cos(3.141592653589793 * (b - 2) / 0.12)) when b < 3 or mode = 'ramp_hold' then 0.5 else 0.5 + 1.2 * (b - 3) * (b - 3) end end::double as v from k),
    a as (select *, coalesce((v + lag(v) over (partition by el, n order by j)) / 2 * (b - lag(b) over (partition by el, n order by j)), 0) as area from v)
    select el, n, round(b, 6) as b, round(sum(area) over (partition by el, n order by j rows unbounded preceding) * 0.5 + 1e-9, 6) as "offset" from a""")
def speed_curve(spark, sf):
    """How far into its source each shot is along its beats."""
    s = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("el"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("q"))
    modes = F.array(*map(F.lit, ("normal", "fast", "slow", "speed", "freeze", "ramp", "ramp_hold")))
    s = s.select("el", "n", F.get(modes, (F.col("p") % 7).cast("int")).alias("mode"), (2 + F.col("q") % 6).cast("double").alias("beats"), (0.5 + (F.col("p") % 5) / 4.0).alias("value"), (F.col("q") % 4).cast("double").alias("stop"))
    c = signals.speed_curve(s, ["el", "n"], "mode", "beats", "value", "stop", 0.5, 8)
    return c.select("el", "n", F.round("b", 6).alias("b"), F.round(F.col("offset") + 1e-9, 6).alias("offset"))


@query(f"""with {_E}, p as (select user_id, t as a, coalesce(lead(t) over (partition by user_id order by t), t) as z, round(value * 100)::bigint as v from e), b as (select user_id, d * 86400000000 as a, (d + 1) * 86400000000 as z from (select distinct user_id, t // 86400000000 as d from e))
    select b.user_id, b.a, b.z, round(sum((least(b.z, p.z) - greatest(b.a, p.a)) * p.v) / sum(least(b.z, p.z) - greatest(b.a, p.a)), 3)::double as mix from b join p on b.user_id = p.user_id and least(b.z, p.z) - greatest(b.a, p.a) > 0 group by all""")
def overlap_mix(spark, sf):
    """Daily means of a stepped signal, weighted by how long each step lasts."""
    e = _events(spark, sf)
    p = e.select("user_id", F.col("t").alias("a"), F.coalesce(F.lead("t").over(Window.partitionBy("user_id").orderBy("t")), F.col("t")).alias("z"), F.round(F.col("value") * 100).cast("long").alias("v"))
    b = e.select("user_id", F.expr("t div 86400000000 * 86400000000").alias("a")).distinct().withColumn("z", F.col("a") + 86400000000)
    return signals.overlap_mix(b, p, ["user_id"], "a", "z", "v", 24 * HOUR).select("user_id", "a", "z", F.round("mix", 3).alias("mix"))


# Words, turns and votes: events are words, their type the speaker, two low types unsure.
_WORDS = f"{_N}, w as (select user_id, i // 8 as seg, i, event_id, t as s, t + 600000000 as e, case when event_id % 4 = 0 then '?' else event_type end as speaker, case when event_id % 4 = 0 and event_id % 3 > 0 then event_type end as guess from n)"


def _words(spark, sf):
    odd = F.col("event_id") % 4 == 0
    return _samples(spark, sf).select(
        "user_id", F.expr("i div 8").alias("seg"), F.col("i").cast("long").alias("i"), "event_id", F.col("t").alias("s"), (F.col("t") + 600000000).alias("e"),
        F.when(odd, "?").otherwise(F.col("event_type")).alias("speaker"), F.when(odd & (F.col("event_id") % 3 > 0), F.col("event_type")).alias("guess"),
    )


@query(f"""with recursive {_WORDS}, f as (select *, case when speaker = '?' then guess else speaker end as eff, speaker = '?' as odd from w),
    h as (select *, first_value(eff ignore nulls) over (partition by user_id, seg order by i rows between 1 following and unbounded following) as ahead, row_number() over (partition by user_id, seg order by i) as k from f),
    r as (select user_id, seg, k, eff as who, eff as last from h where k = 1
      union all select h.user_id, h.seg, h.k, case when h.eff is not null and h.odd and r.last = h.ahead then r.last else h.eff end, coalesce(case when h.eff is not null and h.odd and r.last = h.ahead then r.last else h.eff end, r.last) from r join h on h.user_id = r.user_id and h.seg = r.seg and h.k = r.k + 1),
    x as (select h.*, who, count(who) over (partition by h.user_id, h.seg order by h.k) as span, last_value(who ignore nulls) over (partition by h.user_id, h.seg order by h.k rows unbounded preceding) as now,
      first_value(who ignore nulls) over (partition by h.user_id, h.seg order by h.k rows between 1 following and unbounded following) as nxt, lead(s) over (partition by h.user_id, h.seg order by h.k) - e as gap from h join r on h.user_id = r.user_id and h.seg = r.seg and h.k = r.k),
    c as (select *, case when now <> nxt and row_number() over (partition by user_id, seg, span order by gap desc nulls last, k) = 1 then 1 else 0 end as cut from x)
    select event_id, coalesce(sum(cut) over (partition by user_id, seg order by k rows between unbounded preceding and 1 preceding), 0)::bigint as piece from c""")
def segment_pieces(spark, sf):
    """Segments cut at the largest gap where the speaker changes."""
    p = turns.split_segments(_words(spark, sf), ["user_id", "seg"], "i", "s", "e", "speaker", "guess")
    return p.select("event_id", F.col("piece").cast("long").alias("piece"))


@query(f"""with {_WORDS}, v as (select user_id, seg, coalesce(nullif(speaker, '?'), guess) as who, case when speaker = '?' then 6 else 10 end as x from w), g as (select user_id, seg, who, sum(x) as x from v where who is not null group by all),
    k as (select *, row_number() over (partition by user_id, seg order by x desc, who) as r from g) select who, count(*) as n from k where r = 1 group by who""")
def votes_per_speaker(spark, sf):
    """Segments won by each speaker, a guess counting six tenths."""
    w = _words(spark, sf).select("user_id", "seg", F.coalesce(F.when(F.col("speaker") != "?", F.col("speaker")), F.col("guess")).alias("who"), F.when(F.col("speaker") == "?", 6).otherwise(10).alias("x"))
    return turns.votes_per_winner(w, ["user_id", "seg"], "who", F.col("x"))


@query(f"""with {_N}, o as (select *, case when event_type = lag(event_type) over (partition by user_id order by t) and t - lag(t + 3600000000) over (partition by user_id order by t) <= {6 * HOUR} then 0 else 1 end as new from n), g as (select *, sum(new) over (partition by user_id order by t rows unbounded preceding) as g from o)
    select user_id, event_type, min(t) as a, max(t) + 3600000000 as z, round(sum(v * 3600000000.0) / sum(3600000000.0), 3)::double as margin from g group by user_id, event_type, g""")
def merged_turns(spark, sf):
    """Turns of one speaker joined over short gaps, with the mean margin by length."""
    t = _samples(spark, sf).select("user_id", "event_type", F.col("t").alias("a"), (F.col("t") + HOUR).alias("z"), "v")
    m = turns.merged_turns(t, ["user_id"], "event_type", "a", "z", "v", 6 * HOUR)
    return m.select("user_id", "event_type", "a", "z", F.round("v", 3).alias("margin"))


@query(f"""with {_N}, w as (select user_id, event_id, t as s, t + {HOUR} as e from n where event_type <> 'purchase'), u as (select user_id, event_type as label, t - {HOUR // 2} as s, t + {2 * HOUR} as e, event_id % 5 = 0 as unsure from n where event_type in ('click', 'view')),
    d as (select user_id, t as s, t + {3 * HOUR} as e from n where event_type = 'purchase'),
    o as (select w.user_id, w.event_id, label, sum(least(w.e, u.e) - greatest(w.s, u.s)) as o, bool_or(unsure) as bad from w join u on w.user_id = u.user_id and least(w.e, u.e) > greatest(w.s, u.s) group by all),
    b as (select user_id, event_id, sum(o) as total, (list(label order by o desc, label))[1] as label, max(o) as best from o group by all having sum(o) >= 0.4 * {HOUR}),
    c as (select distinct w.event_id from w join d on w.user_id = d.user_id and (w.s + w.e) / 2 between d.s and d.e),
    m as (select w.event_id, u.label, row_number() over (partition by w.event_id order by greatest(u.s - (w.s + w.e) / 2, (w.s + w.e) / 2 - u.e, 0), u.s, u.e, u.label) as r from w join u on w.user_id = u.user_id and greatest(u.s - (w.s + w.e) / 2, (w.s + w.e) / 2 - u.e, 0) <= {HOUR}),
    j as (select w.event_id, b.label, coalesce(b.best >= 0.7 * b.total and not o.bad and c.event_id is null, false) as sure, m.label as near from w left join b on w.event_id = b.event_id left join o on o.event_id = b.event_id and o.label = b.label left join c on c.event_id = w.event_id left join m on m.event_id = w.event_id and m.r = 1)
    select event_id, case when sure then label else '?' end as speaker, case when label is null then near when not sure then label end as guess from j""")
def word_speakers(spark, sf):
    """J5, J6 in full: speakers of words, sure, guessed or unknown."""
    e = _samples(spark, sf)
    w = e.where("event_type <> 'purchase'").select("user_id", "event_id", F.col("t").alias("s"), (F.col("t") + HOUR).alias("e"))
    u = e.where("event_type in ('click', 'view')").select("user_id", F.col("event_type").alias("label"), (F.col("t") - HOUR // 2).alias("s"), (F.col("t") + 2 * HOUR).alias("e"), (F.col("event_id") % 5 == 0).alias("unsure"))
    d = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 3 * HOUR).alias("e"))
    return turns.assigned_words(w, u, d, ["user_id"], "event_id", 6 * HOUR, shortest=1, reach=HOUR).select("event_id", "speaker", "guess")


@query(f"""with {_N}, s as (select user_id, i, event_type as g, v / case event_type when 'click' then 8000 when 'view' then 6000 when 'purchase' then 9000 when 'login' then 5000 else 4000 end as norm, event_id % 11 = 0 as quiet from n),
    q as (select * from s where not quiet), h as (select distinct user_id, i from q where g in ('click', 'view', 'purchase') and norm >= 1), r as (select *, i - row_number() over (partition by user_id order by i) as k from h),
    p as (select q.user_id, k, g, max(norm) as peak, count(*) filter (norm >= 1) as over from q join r on q.user_id = r.user_id and q.i = r.i group by all), l as (select user_id, k, min(i) as first, max(i) as last from r group by all)
    select l.user_id, first, last, (list(g order by case when peak >= 1 and g in ('click', 'view', 'purchase') then least(peak, 3) * case g when 'click' then 1.0 when 'view' then 0.5 else 2.0 end else -1 end desc, g desc))[1] as label,
      round(max(case when peak >= 1 then least(peak, 3) * case g when 'click' then 1.0 when 'view' then 0.5 when 'purchase' then 2.0 end end) * product(case when g = 'view' and over > 0.5 * (last - first + 1) then 0.5 else 1 end), 6) as score,
      coalesce(string_agg(case when g = 'view' and over > 0.5 * (last - first + 1) then g end, ','), '') as disturbed from l join p on l.user_id = p.user_id and l.k = p.k group by l.user_id, l.k, first, last""")
def event_spans(spark, sf):
    """Spans of loud windows with label, score and disturbances."""
    s = _samples(spark, sf).select("user_id", F.col("i").cast("long").alias("i"), "event_type", "v", (F.col("event_id") % 11 == 0).alias("quiet"))
    limits = {"click": 8000, "view": 6000, "purchase": 9000, "login": 5000} | dict.fromkeys(("logout", "signup", "search", "share", "scroll", "error"), 4000)
    out = turns.event_spans(s, ["user_id"], "i", "event_type", "v", limits, {"click": 1.0, "view": 0.5, "purchase": 2.0}, {"view": 0.5})
    return out.select("user_id", "first", "last", "label", F.round("score", 6).alias("score"), "disturbed")


@query(f"""with {_N}, a as (select user_id, i // 2 as o, t // 1000000 as t from n where i % 2 = 0), b as (select user_id, t // 1000000 + 90 as t from n where i % 3 > 0),
    c as (select a.user_id, a.o, b.t - a.t as f from a join b on a.user_id = b.user_id where a.o < 4), k as (select c.user_id, c.o, c.f, a.o as e from c join a on c.user_id = a.user_id join b on b.user_id = c.user_id and abs(b.t - (a.t + c.f)) < 30),
    h as (select user_id, o, f, count(distinct e) as hits from k group by all), r as (select *, row_number() over (partition by user_id order by hits desc, o, f) as z from h) select user_id, f as "offset", hits from r where z = 1""")
def voted_offset(spark, sf):
    """The offset with most coincidences."""
    s = _samples(spark, sf).withColumn("t", F.expr("t div 1000000"))
    a = s.where("i % 2 = 0").select("user_id", F.expr("i div 2").alias("o"), "t")
    b = s.where("i % 3 > 0").select("user_id", (F.col("t") + 90).alias("t"))
    return sync.vote_offset(a, b, ["user_id"], "t", "o", 30, first=4)


@query("""with e as (select vec_id, 40 + vec_id % 90 as a, 20 + vec_id % 41 as b, 10 + vec_id % 7 as m, 1 + vec_id % 4 as s from embeddings)
    select vec_id, round(least(greatest(0, least(1, case when b - m > 0 then least(99, (a - m) / (b - m)) else 99 end - 1)), greatest(0, least(1, ((a - m) / s - 10) / 20))), 6)::double as confidence from e""")
def peak_confidence(spark, sf):
    """Confidence of a peak over the second one and the noise."""
    v = F.col("vec_id")
    a, b, m, s = (x.cast("double") for x in (40 + v % 90, 20 + v % 41, 10 + v % 7, 1 + v % 4))
    return _read(spark, sf, "embeddings").select("vec_id", F.round(sync.confidence(a, b, m, s), 6).alias("confidence"))


@query(f"""with {_N}, p as (select user_id, t // 60000000 as t from n where event_type = 'purchase'), c as (select distinct user_id, t // 60000000 + 1 as t from n where event_id % 2 = 0), x as (select user_id, t // 60000000 - 30 as a, t // 60000000 + 30 as z from n where event_type = 'click'),
    m as (select p.user_id, p.t, c.t - p.t as away, row_number() over (partition by p.user_id, p.t order by abs(c.t - p.t), c.t) as r from (select distinct * from p) p join c on c.user_id = p.user_id and abs(c.t - p.t) <= 2)
    select p.user_id, p.t, case when m.away is not null then 'matched' when exists (select 1 from x where x.user_id = p.user_id and p.t between a - 2 and z + 2) then 'in_transition' else 'missing' end as state, m.away from p left join m on m.user_id = p.user_id and m.t = p.t and r = 1
    union all select user_id, t, 'extra', null from c where not exists (select 1 from p where p.user_id = c.user_id and abs(p.t - c.t) <= 2)""")
def plan_against_cuts(spark, sf):
    """Planned cuts found, hidden in transitions or missing, and extra ones."""
    s = _samples(spark, sf).withColumn("m", F.expr("t div 60000000"))
    plan = s.where("event_type = 'purchase'").select("user_id", F.col("m").alias("t"))
    cuts = s.where("event_id % 2 = 0").select("user_id", (F.col("m") + 1).alias("t")).distinct()
    trans = s.where("event_type = 'click'").select("user_id", (F.col("m") - 30).alias("start"), (F.col("m") + 30).alias("end"))
    return sync.compared_cuts(plan, cuts, trans, ["user_id"], "t", 600).select("user_id", "t", "state", "away")


@query(r"""select page_id, case when regexp_matches(lower(html), 'quota|too many users|zu viele nutzer') then 'quota' when regexp_matches(lower(html), 'accounts[.]google[.]com|sign in|anmelden') then 'not_shared'
    when regexp_matches(lower(html), 'not found|nicht gefunden|error 404') then 'unknown_id' when regexp_matches(lower(html), 'error 500|server error') then 'server_error' else 'page' end as reason,
    regexp_matches(lower(substr(html, 1, 2048)), '^[ \t\n\r\f\x0b]*(<!doctype|<html|<[?]xml|<head|<body)') as is_page, not starts_with(lower(html), '<') as png from pages""")
def page_reasons(spark, sf):
    """What a page instead of a file means, and whether its head could be that of a picture."""
    p = _read(spark, sf, "pages")
    png = ~files.head_fits(F.encode(F.substring("html", 1, 16), "utf-8"), F.lit(".png"))
    return p.select("page_id", files.page_reason(F.col("html")).alias("reason"), files.is_page(F.col("html")).alias("is_page"), (~png).alias("png"))


@query("""with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations), x as (select conv_id, turn, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i, turn * 10.0 as s, turn * 10.0 + 8 as e from w),
    c as (select *, sum(length(w) + 1) over (partition by conv_id, turn) as total, sum(length(w) + 1) over (partition by conv_id, turn order by i) as upto from x)
    select conv_id, turn, i, round(s + (e - s) * (upto - length(w) - 1) / total, 6)::double as a, round(least(s + (e - s) * upto / total - 0.02, s + (e - s) * (upto - length(w) - 1) / total + greatest(0.45, 0.11 * length(regexp_replace(w, '[^\\p{L}\\p{N}_''-]', '', 'g')))), 6)::double as z from c""")
def word_times(spark, sf):
    """A text's words spread over its time, their ends capped."""
    t = _read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("a", F.col("turn") * F.lit(10.0)).withColumn("z", F.col("turn") * F.lit(10.0) + 8)
    r = files.respread(t, ["conv_id", "turn"], "i", "w", "a", "z")
    return r.select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.round("s", 6).alias("a"), F.round(files.capped_end(F.col("s"), F.col("e"), F.col("w")), 6).alias("z"))


@query("""with b as (select l_orderkey as song, l_linenumber as bar, (sum(l_quantity))::bigint as energy, count(*) filter (l_discount > 0.04) as hits from lineitem group by all), m as (select *, avg(energy) over (partition by song) as mean from b),
    w as (select song, 4 as length, bar as start, avg(energy) over (partition by song order by bar rows between current row and 3 following) - mean + 1.5 * sum(hits) over (partition by song order by bar rows between current row and 3 following) / 4.0 + case when last_value(hits) over (partition by song order by bar rows between current row and 3 following) = 0 then 2 else 0 end as score,
        count(*) over (partition by song order by bar rows between current row and 3 following) as c, 4 as need from m
      union all select song, 2, bar, avg(energy) over (partition by song order by bar rows between current row and 1 following) - mean + 1.5 * sum(hits) over (partition by song order by bar rows between current row and 1 following) / 2.0 + case when last_value(hits) over (partition by song order by bar rows between current row and 1 following) = 0 then 2 else 0 end,
        count(*) over (partition by song order by bar rows between current row and 1 following), 2 from m)
    select song, length::int as length, start, round(score, 3)::double as score from w where c = need""")
def song_windows(spark, sf):
    """Windows of a song with their scores."""
    l = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("song"), F.col("l_linenumber").alias("bar")).agg(F.sum("l_quantity").cast("long").alias("energy"), F.count(F.when(F.col("l_discount") > 0.04, 1)).alias("hits"))
    return choice.song_windows(l, ["song"], "bar", "energy", "hits", (4, 2)).select("song", "length", "start", F.round("score", 3).alias("score"))


@query("""with w as (select o_orderkey as k, o_orderkey % 40 as shot, 1 + o_custkey % 9 as beats, 4 as now, o_orderkey % 3 as cut, (o_custkey % 10) / 20.0 as u, o_custkey % 2 as edge, o_orderkey % 4 as whole, (o_custkey % 7) / 4.0 as mean, (o_orderkey % 20) / 2.0 as s from orders),
    c as (select *, 4.0 * cut + 10.0 * greatest(0, u - 0.15) + 2.0 * edge - 0.8 * least(2, whole) - 0.5 * least(1.2, mean / 1.5) + case when 5 between s + 0.05 and s + 2.95 then 0 else 6 end + 0.05 * abs(s - 4) as cost from w),
    b as (select shot, beats, min(cost) as c from c where beats between 2 and 8 and beats <> now group by all having min(cost) < 0.5) select shot, min(beats) as beats from b group by shot""")
def fewest_beats(spark, sf):
    """Costs of windows and the smallest number of beats without a finding."""
    o = _read(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 40).alias("shot"), (1 + F.col("o_custkey") % 9).alias("beats"), F.lit(4).alias("now"), ((F.col("o_orderkey") % 20) / 2.0).alias("s"))
    cost = choice.window_cost(F.col("o_orderkey") % 3, (F.col("o_custkey") % 10) / 20.0, F.col("o_custkey") % 2, F.col("o_orderkey") % 4, (F.col("o_custkey") % 7) / 4.0, F.lit(1.5), F.col("s"), F.col("s") + 3, F.lit(5.0), F.lit(4.0))
    return choice.fewest_beats(o.withColumn("cost", cost), ["shot"], "beats", "now", "cost")


@query("""with c as (select p_partkey as clip, case when p_partkey % 5 > 0 then (p_size % 12)::double end as length, case when p_partkey % 3 = 0 then (p_size % 9)::double end as moment, [(p_partkey % 8)::double, (p_size % 5)::double][1 : p_partkey % 3] as peaks from part),
    q as (select *, case when moment is null then peaks else list_prepend(moment, peaks) end as ps from c), f as (select *, list_filter(ps, lambda p: p - 1 >= 0 and (length is null or p - 1 + 3 <= length - 0.05))[1] as fit from q)
    select clip, round(case when fit is not null then fit - 1 when ps[1] is not null then greatest(0, least(ps[1] - 1, coalesce(length - 3.05, ps[1] - 1))) when length is not null then greatest(0, length / 2 - 1.5) end, 3)::double as start, coalesce(fit, ps[1]) as peak from f""")
def in_points(spark, sf):
    """The in-point whose best moment falls on the hit."""
    p = _read(spark, sf, "part")
    peaks = F.slice(F.array((F.col("p_partkey") % 8).cast("double"), (F.col("p_size") % 5).cast("double")), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    x = choice.in_point(F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") % 9).cast("double")), peaks, F.when(F.col("p_partkey") % 5 > 0, (F.col("p_size") % 12).cast("double")), F.lit(3.0), F.lit(1.0))
    return p.select(F.col("p_partkey").alias("clip"), x.alias("x")).select("clip", "x.start", "x.peak")
