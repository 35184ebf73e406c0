"""Registered queries of trees, sections, speakers, selection of ranks and slopes, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import intervals, matching, sections, speakers, tracks, trees
from chronoweave.plans.catalog import _read, query
from chronoweave.sources import manifest

_IN = "list_contains(list_transform(r, lambda z: z.clip), {})"
#: Alignments of eight recordings of a customer, of which recording 0 is the reference, out of orders.
_SYNC = f"""with recursive ed as (select o_custkey as pr, o_orderkey % 8 as a, o_orderkey // 8 % 8 as b, (o_orderkey % 97) / 8.0::double as off, ((o_orderkey * 7919) % 10007) / 10007::double as conf,
        o_orderkey % 5 <> 0 as hit, o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 as clear from orders),
    one as (select *, hit and clear and conf >= 0.5 as good from ed where a <> b qualify row_number() over (partition by pr, least(a, b), greatest(a, b) order by hit and clear and conf >= 0.5 desc, hit desc, conf desc, a) = 1),
    p as (select c.pr, coalesce(es, []) as es from (select distinct o_custkey as pr from orders) c left join (select pr, list({{'a': a, 'b': b, 'off': off, 'conf': conf, 'hit': hit, 'good': good}}) as es from one group by pr) e using (pr)),
    prim(pr, es, r, u) as (
      select pr, es, [{{'clip': 0::bigint, 'shift': 0.0::double, 'conf': 1.0::double, 'sure': true, 'via': null::bigint}}], 0 from p
      union all
      select pr, es, case when x is null then r else list_append(r, {{'clip': (x).to_, 'shift': (x).shift, 'conf': (x).conf, 'sure': (x).sure, 'via': (x).frm}}) end, case when grow is null then u + 1 else u end
      from (select *, case when way is not null then {{'to_': (way).to_, 'frm': (way).frm, 'shift': (f).shift + (way).by_, 'conf': least((f).conf, (way).conf), 'sure': (f).sure and (way).good}} end as x
            from (select *, list_filter(r, lambda z: z.clip = (way).frm)[1] as f from (select *, coalesce(grow, late) as way from (select *, case when u = 0 then list_sort(list_transform(list_filter(es, lambda e: e.good and {_IN.format("e.a")} <> {_IN.format("e.b")}),
                        lambda e: {{'k1': e.a <> 0 and e.b <> 0, 'k2': -e.conf, 'k3': least(e.a, e.b), 'k4': greatest(e.a, e.b), 'frm': case when {_IN.format("e.a")} then e.a else e.b end, 'to_': case when {_IN.format("e.a")} then e.b else e.a end,
                                   'by_': case when {_IN.format("e.a")} then e.off else -e.off end, 'conf': e.conf, 'good': e.good}}))[1] end as grow,
                    case when u > 0 and not {_IN.format("u")} then list_sort(list_transform(list_filter(es, lambda e: e.hit and (e.a = u and {_IN.format("e.b")} or e.b = u and {_IN.format("e.a")})),
                        lambda e: {{'k1': false, 'k2': -e.conf, 'k3': case when e.a = u then e.b else e.a end, 'k4': 0::bigint, 'frm': case when e.a = u then e.b else e.a end, 'to_': u::bigint,
                                   'by_': case when e.a = u then -e.off else e.off end, 'conf': e.conf, 'good': e.good}}))[1] end as late
                  from prim where u < 8))))),
    done as (select pr, unnest(r) as z from prim where u = 8)"""


def _alignments(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("pr"), F.col("o_orderkey").alias("k"))
    clips = o.select("pr").distinct().select("pr", F.explode(F.expr("sequence(0L, 7L)")).alias("clip")).withColumn("is_ref", F.col("clip") == 0)
    edges = o.select(
        "pr", (F.col("k") % 8).alias("a"), F.expr("k div 8 % 8").alias("b"), (F.col("k") % 97 / 8.0).alias("offset"), F.lit(0.0).alias("at"), F.lit(0.0).alias("drift"), F.lit(False).alias("drift_sure"),
        (F.col("k") * 7919 % 10007 / F.lit(10007.0)).alias("confidence"), (F.col("k") % 5 != 0).alias("hit"), ((F.col("k") % 7 == 0) | (F.col("k") % 5 == 0)).alias("ambiguous"),
    )
    return clips, edges


@query(f"""{_SYNC} select c.pr, c.clip, round(z.shift, 6) as shift, round(z.conf, 6) as confidence, z.sure as sure, z.via as via
    from (select pr, unnest(range(8)) as clip from p) c left join done on done.pr = c.pr and z.clip = c.clip""")
def synchronised_tree(spark, sf):
    """Recordings on the time line of a reference by their most confident alignments."""
    maps, _ = trees.synchronised(*_alignments(spark, sf), ["pr"])
    return maps.select("pr", "clip", F.round("shift", 6).alias("shift"), F.round("confidence", 6).alias("confidence"), "sure", "via")


@query(f"""{_SYNC} select e.pr, e.a, e.b, round(abs(e.off - (zb.z.shift - za.z.shift)), 6) as off from one e join done za on za.pr = e.pr and za.z.clip = e.a join done zb on zb.pr = e.pr and zb.z.clip = e.b
    where e.clear and e.hit and za.z.via is distinct from e.b and zb.z.via is distinct from e.a and abs(e.off - (zb.z.shift - za.z.shift)) > 0.01""")
def triangle_check(spark, sf):
    """Alignments outside the tree that disagree with it."""
    _, off = trees.synchronised(*_alignments(spark, sf), ["pr"])
    return off.select("pr", "a", "b", F.round("off", 6).alias("off"))


#: Bars of a user: eight events each in order of time; a bar's vector is of the counts of event types, a constant, and its energy the mean value.
_BARS = """b as (select *, (row_number() over (partition by user_id order by ts) - 1) // 8 as bar from events),
    f as (select user_id, bar, [0.5 + count(*) filter (event_type = 'click') * 2, count(*) filter (event_type = 'view'), count(*) filter (event_type = 'purchase') * 3.0, count(*) filter (event_type = 'error'), (bar // 4 % 3) * 4.0]::double[] as c,
            floor(avg(value)) / 10 as energy, count(*) filter (event_type = 'click') / 2.0 as low, count(*) filter (event_type = 'purchase') / 2.0 as clap from b group by user_id, bar),
    v as (select user_id, bar, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as v, energy, low, clap from f)"""


def _bars(spark, sf):
    from pyspark.sql import Window

    e = _read(spark, sf, "events").withColumn("bar", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1) / 8).cast("long"))
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("double"))
    f = e.groupBy("user_id", "bar").agg(
        F.array(0.5 + n("click") * 2, n("view"), n("purchase") * 3.0, n("error"), F.floor(F.col("bar") / 4) % 3 * 4.0).cast("array<double>").alias("c"),
        (F.floor(F.avg("value")) / 10).alias("energy"), (n("click") / 2.0).alias("low"), (n("purchase") / 2.0).alias("clap"),
    )
    return f.select("user_id", "bar", F.transform("c", lambda x: x / F.sqrt(sections.dot(F.col("c"), F.col("c")))).alias("v"), "energy", "low", "clap")


@query(f"""with recursive {_BARS},
    n as (select *, count(*) over (partition by user_id) as n, list(v) over (partition by user_id order by bar rows between 4 preceding and 3 following) as w from v),
    nov as (select *, case when bar >= 4 and bar < n - 4 then list_aggregate(list_transform(range(1, 6), lambda d: pow((w[5][d] + w[6][d] + w[7][d] + w[8][d]) - (w[1][d] + w[2][d] + w[3][d] + w[4][d]), 2)), 'sum') else 0.0 end as nov from n),
    ph as (select user_id, bar % 4 as r, sum(nov) as s, max(nov) filter (bar > 0) as top from nov group by user_id, bar % 4 qualify row_number() over (partition by user_id order by round(s, 9) desc, r) = 1),
    sec as (select nov.*, sum(case when bar = 0 or bar % 4 = r and nov >= 0.3 * greatest(coalesce(top, 1), 1e-9) then 1 else 0 end) over (partition by user_id order by bar)::bigint - 1 as section from nov join ph using (user_id)),
    at_ as (select user_id, section, v, bar - min(bar) over (partition by user_id, section) as a from sec),
    sim as (select x.user_id, x.section as i, y.section as j, avg(list_inner_product(x.v, y.v)) as sim from at_ x join at_ y on x.user_id = y.user_id and x.a = y.a and x.section <> y.section group by all),
    s as (select user_id, section, min(bar) as start, max(bar) + 1 as "end", avg(energy) as energy, avg(low) as low, avg(clap) as clap from sec group by all),
    like_ as (select s.*, coalesce((select max(sim) from sim where sim.user_id = s.user_id and i = section), 0) as rep, coalesce((select list(j order by j) from sim where sim.user_id = s.user_id and i = section and j < section and sim >= 0.9), []) as l from s),
    g as (select *, [0::bigint] as founders, 0::bigint as grp from like_ where section = 0
      union all select q.user_id, q.section, q.start, q."end", q.energy, q.low, q.clap, q.rep, q.l, case when len(list_intersect(q.l, g.founders)) = 0 then list_append(g.founders, q.section) else g.founders end,
        case when len(list_intersect(q.l, g.founders)) = 0 then len(g.founders) else list_position(g.founders, list_min(list_intersect(q.l, g.founders))) - 1 end from g join like_ q on q.user_id = g.user_id and q.section = g.section + 1),
    h as (select user_id, grp, count(*) as n, avg(energy + 2 * low) as force, avg(energy) as mean from g group by user_id, grp having count(*) > 1 qualify row_number() over (partition by user_id order by round(force, 9) desc, grp) = 1),
    p as (select user_id, max(energy) as loudest, max(section) as last_ from g group by user_id),
    q as (select p.user_id, last_, case when h.mean >= loudest - 4 then h.grp end as hook, case when h.mean >= loudest - 4 then h.mean else loudest end as level from p left join h using (user_id))
    select user_id, section, start, "end", grp, round(rep, 6) as repetition, case when grp is not distinct from hook then 'hook' when low < 0.3 and clap < 0.3 then case when section = 0 then 'intro' when section = last_ then 'outro' else 'break' end
        when section = 0 then 'intro' when energy < level - 2.5 and "end" - start <= 8 and section < last_ then 'break' when section = last_ and "end" - start <= 8 then 'outro' else 'verse' end as label from g join q using (user_id)""")
def song_sections(spark, sf):
    """Sections of each user's bars of events, their repetitions and names."""
    out = sections.sections(_bars(spark, sf), ["user_id"], "bar", "v", "energy", "low", "clap")
    return out.select("user_id", "section", "start", "end", "grp", F.round("repetition", 6).alias("repetition"), "label")


def _voices(spark, sf):
    return _bars(spark, sf).select("user_id", "bar", "v", F.floor(F.col("bar") / 6).alias("region"))


@query()
def speaker_rounds(spark, sf):
    """Bars of a user as windows of a recording, labelled by groups that are refined in rounds."""
    return speakers.speakers(_voices(spark, sf), ["user_id"], "region", "bar", "v", apart=0.08, price=0.05, hop=0.5).select("user_id", "bar", "speaker")


@query()
def fixed_speakers(spark, sf):
    """The same for two speakers."""
    return speakers.speakers(_voices(spark, sf), ["user_id"], "region", "bar", "v", number=2, price=0.05).select("user_id", "bar", "speaker")


@query("""with p as (select p_partkey as id, p_size / 10.0 as len, xor(((p_partkey // 4 * 2654435761) & 4294967295) * 2147483648 + ((p_partkey // 4 * 2246822519) & 2147483647), 1::bigint << (p_partkey * 7 % 62)::int) as h from part),
    x as (select a.id as a, b.id as b, 64 - bit_count(xor(a.h, b.h)) as equal_bits from p a join p b on a.id < b.id and abs(a.len - b.len) <= greatest(0.3, 0.03 * greatest(a.len, b.len)))
    select a, b, equal_bits::bigint as equal_bits from x where equal_bits >= 0.9 * 64""")
def near_codes(spark, sf):
    """Parts of like size whose 64-bit codes agree in nine tenths of their bits, met by bands of bits."""
    k = F.expr("p_partkey div 4")
    code = ((k * F.lit(2654435761)).bitwiseAND(F.lit(4294967295)) * F.lit(2147483648) + (k * F.lit(2246822519)).bitwiseAND(F.lit(2147483647))).bitwiseXOR(F.expr("shiftleft(1L, int(p_partkey * 7 % 62))"))
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10.0).alias("len"), code.alias("h"))
    return matching.hash_duplicates(p, "id", "len", "h").select("a", "b", F.col("equal_bits").cast("long").alias("equal_bits"))


_N = "n as (select *, row_number() over (partition by user_id order by ts) - 1 as i from events)"


def _numbered(spark, sf):
    return _read(spark, sf, "events").withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1).withColumn("i", F.col("i").cast("long"))


@query(f"""with recursive {_N}, p as (select user_id, i, value from (select *, lag(value) over (partition by user_id order by i) as a, lead(value) over (partition by user_id order by i) as b from n) where value >= 60 and value > a and value >= b),
    o as (select *, row_number() over (partition by user_id order by value desc, i) as k from p),
    r as (select user_id, k, i, value, [i] as kept, true as ok from o where k = 1
      union all select o.user_id, o.k, o.i, o.value, case when len(list_filter(kept, lambda x: abs(x - o.i) < 9)) = 0 then list_append(kept, o.i) else kept end, len(list_filter(kept, lambda x: abs(x - o.i) < 9)) = 0 from r join o on o.user_id = r.user_id and o.k = r.k + 1)
    select user_id, i, value from r where ok""")
def peaks_apart(spark, sf):
    """Peaks of a user's values at least nine events apart, the highest first."""
    return intervals.spaced_peaks(_numbered(spark, sf), ["user_id"], "i", "value", 60.0, 9)


@query()
def labelled_transitions(spark, sf):
    """Runs of high values as transitions between pictures, each with its peak and label."""
    n, v = _numbered(spark, sf), F.col("value")
    lag = F.lag("value").over(Window.partitionBy("user_id").orderBy("i"))
    f = n.select(
        "user_id", "i", (v / 400).alias("single"), (v / 300).alias("many"), F.coalesce(F.abs(v - lag) / 400, F.lit(0.0)).alias("change"), (v / 500).alias("luma"),
        F.when(F.col("event_type") != "error", F.pmod(F.col("event_id"), F.lit(7)) / 7.0).alias("share"), F.lit(0.2).alias("rest"), (F.pmod(F.col("event_id"), F.lit(5)) / 20.0).alias("back"),
    )
    return intervals.transitions(f, ["user_id"], "i")


@query("""select l_orderkey, l_linenumber, round((1 - exp(-l_quantity / 120.0::double)) * least(1.0::double, greatest(0.35::double, l_extendedprice / 100.0::double / 500.0::double)) * least(1.0::double, greatest(0.2::double, 1 - greatest(0.0::double, 45 - l_partkey % 256) / 45.0::double
      - greatest(0.0::double, l_partkey % 256 - 215) / 40.0::double - greatest(0.0::double, l_discount * 3 - 0.15::double) - greatest(0.0::double, l_tax * 6 - 0.35::double))) * exp(-(l_suppkey % 90) / 80.0::double) / (1 + (l_orderkey % 700) / 500.0::double), 6) as quality from lineitem""")
def sample_qualities(spark, sf):
    """Quality of samples as a product of bounded terms."""
    c = lambda name: F.col(name).cast("double")
    q = tracks.sample_quality(c("l_quantity"), c("l_extendedprice") / 100.0, (F.col("l_partkey") % 256).cast("double"), c("l_discount") * 3, c("l_tax") * 6, (F.col("l_suppkey") % 90).cast("double"), (F.col("l_orderkey") % 700).cast("double"))
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(q, 6).alias("quality"))


@query("""with s as (select l_orderkey % 500 as el, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber as o, l_quantity::double as beats, l_partkey % 40 / 8.0::double as secs from lineitem),
    d as (select *, row_number() over (partition by el order by o, l_partkey, l_suppkey) as k from s), sc as (select el, l_orderkey, sum(beats) as b from s group by all),
    m as (select el, count(*) as scenes, median(b) as scene_beats from sc group by el)
    select d.el, count(*) as shots, sum((l_suppkey % 3 = 0)::int)::bigint as jumps, sum((k > 1 and abs(l_partkey % 181 - 90) <= 45)::int)::bigint as on_beat, any_value(scenes) as scenes, median(beats) as shot_beats, median(secs) as shot_seconds, any_value(scene_beats) as scene_beats
    from d join m using (el) group by d.el""")
def reel_reports(spark, sf):
    """Key figures of edit lists, with medians by shot and by scene."""
    l = _read(spark, sf, "lineitem")
    p, u = F.col("l_partkey"), F.col("l_suppkey")
    shots = l.select((F.col("l_orderkey") % 500).alias("el"), F.col("l_orderkey").alias("scene"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), p.alias("p"), u.alias("u")).alias("order"), F.col("l_quantity").cast("double").alias("beats"), (p % 40 / 8.0).alias("secs"), (u % 3 == 0).alias("jump"), (p % 181 - 90).cast("double").alias("away"))
    return tracks.reel_report(shots, ["el"], "scene", "beats", "secs", "jump", "away", "order")


@query("""with c as (select o_custkey % 300 as p, o_orderkey as clip, case when o_orderkey % 9 > 0 then (o_orderkey % 101)::double / 4 end as start, (o_orderkey % 37)::double / 2 + 0.5 as dur, o_orderkey % 4 > 0 as ok from orders),
    s as (select p, min(start) as low, greatest(max(start + dur) - min(start), 1e-6) / 40 as step from c group by p),
    x as (select c.*, k, coalesce(start is not null and least(low + (k + 1) * step, start + dur) - greatest(low + k * step, start) > 0.3 * step, false) as is_on from c join s using (p) cross join (select unnest(range(40)) as k))
    select p, clip, case when any_value(start) is null then repeat('-', 40) else string_agg(case when not is_on then '.' when ok then '#' else '?' end, '' order by k) end as marks from x group by p, clip
    union all select p, null, string_agg(case when n > 0 then least(n, 9)::varchar else '.' end, '' order by k) from (select p, k, sum(is_on::int) as n from x group by p, k) group by p""")
def camera_overview(spark, sf):
    """K5: text time lines of projects, with unsure clips and the number of cameras."""
    k = F.col("o_orderkey")
    c = _read(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("p"), k.alias("clip"), F.when(k % 9 > 0, (k % 101).cast("double") / 4).alias("start"), ((k % 37).cast("double") / 2 + 0.5).alias("duration"), (k % 4 > 0).alias("usable"))
    return manifest.overview(c, ["p"])
