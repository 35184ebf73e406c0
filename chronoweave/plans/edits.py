"""Registered queries of edit lists and rules, and their SQL.

The tables have no edit lists, so an order is one and its lines are the shots; fields follow from the line's numbers by
expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.operators import choice, edits, rules, selection
from chronoweave.plans.catalog import _read, query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
#: Fields of a shot from p (part), q (quantity), u (supplier) and n (place in its order).
_FIELDS = {
    "beats": "1 + q % 12",
    "sec": "concat('k', cast(cast(floor(n / 3.0) as bigint) as string))",
    "clip": "case when u % 9 = 0 then 'split' else concat('c', cast(p % 40 as string)) end",
    "src": "(p % 97) / 2.0",
    "mode": "case p % 8 when 0 then 'slow' when 1 then 'speed' when 2 then 'ramp' when 3 then 'ramp_hold' when 4 then 'freeze' else 'normal' end",
    "speed": "0.5 + (u % 5) * 0.25",
    "descr": "case u % 4 when 0 then 'Laufen am See' when 1 then 'Salto vom Kasten' when 2 then 'Boxen' else 'Pause' end",
    "jump": "u % 3 = 0",
    "cont": "p % 10 = 9",
    "sound": "case p % 4 when 0 then 'front' when 1 then 'low' end",
    "dialogue": "p % 11 = 0",
    "scene": "floor((n + 1) / 2.0)",
    "fade": "p % 5 = 0",
    "shake": "u % 6 = 0",
    "push": "q % 2 = 0",
    "flashes": "case when p % 5 = 1 then 1 else 0 end",
    "flash_at": "q % 2",
    "punched": "case when p % 6 = 0 then 1 else 0 end",
    "punch_by": "(u % 3) / 20.0",
}
_SQL_SHOTS = (
    f"l as (select l_orderkey as el, row_number() over (partition by l_orderkey order by {_ORDER}) as n, l_partkey as p, l_suppkey as u, l_quantity::bigint as q from lineitem), "
    + "f as (select el, n, "
    + ", ".join(f"{x} as {k}" for k, x in _FIELDS.items())
    + ", case when p % 8 = 0 then 0.5 when p % 8 = 1 then 0.5 + (u % 5) * 0.25 else 1.0 end as tempo, p, u, q from l), "
    + "s as (select *, coalesce(sum(beats) over (partition by el order by n rows between unbounded preceding and 1 preceding), 0)::bigint as beat from f), "
    + "g as (select el, sum(beats)::bigint as total, (el % 20) as intro, (el % 10) as outro from s group by el), "
    + "h as (select *, (total - outro) % 4 as pickup, (total - outro - (total - outro) % 4) // 4 as bars from g where total > outro), "
    + "x as (select s.*, total, intro, outro, pickup, bars, beat < intro as in_intro, outro > 0 and beat >= total - outro as in_outro from s join h on s.el = h.el)"
)


def _lists(spark, sf):
    """Shots and lists."""
    l = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    l = l.withColumnRenamed("l_orderkey", "el")
    w = Window.partitionBy("el").orderBy(*_ORDER.split(", "))
    rows = l.select("el", F.row_number().over(w).alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u"), F.col("l_quantity").cast("long").alias("q"))
    s = rows.select("el", "n", "p", "u", "q", *(F.expr(x).alias(k) for k, x in _FIELDS.items()))
    s = s.withColumn("src", F.col("src").cast("double")).withColumn("speed", F.col("speed").cast("double"))
    s = s.withColumn("beat", F.coalesce(F.sum("beats").over(Window.partitionBy("el").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("strips", F.when(F.col("clip") == "split", F.array(F.expr("concat('c', cast(p % 40 as string))"), F.expr("concat('c', cast(u % 40 as string))"))))
    s = s.withColumn("flash", F.expr("array_repeat(flash_at, int(flashes))")).withColumn("punch", F.expr("array_repeat(0L, int(punched))")).withColumn("punch_size", F.expr("array_repeat(cast(punch_by as double), int(punched))"))
    # Shots and lists come from the same rows, with the sums of a list beside its shots, so both have one shuffle and one sorting.
    s = s.withColumn("_all", F.sum("beats").over(Window.partitionBy("el").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.where(F.col("_all") > F.col("el") % 10)
    g = s.where("n = 1").select("el", F.col("_all").alias("beats")).withColumn("intro", F.col("el") % 20).withColumn("outro", F.col("el") % 10).withColumn("period", F.lit(0.5))
    g = g.withColumn("pickup", F.expr("(beats - outro) % 4")).withColumn("bars", F.expr("(beats - outro - pickup) div 4")).withColumn("hits", F.expr("sequence(0L, beats + 8, 4L)"))
    return s.drop("_all"), g


def _sql(selects: list[tuple[str, str, str]], extra: str = "") -> str:
    """Union of (rule, rows, ...) selects; each is (rule, subject and detail expressions, from and where)."""
    parts = [f"select '{name}' as rule, ({what.split(' | ')[0]})::varchar as subject, ({what.split(' | ')[1]})::varchar as detail from {rest}" for name, what, rest in selects]
    return f"with {_SQL_SHOTS}{extra} " + " union all ".join(parts)


def _found(found):
    return rules.findings(found).drop("status")


_NB = "el || '/' || n | beats"


@query(_sql([
    ("length", "el || '/' || bars | total", "h where bars < 4 * ceil(27.9 / 8) or bars > 4 * (ceil(27.9 / 8) + 1)"),
    ("part_phrase", "el || '/' || bars | total", "h where bars % 4 <> 0"),
    ("chapter_start", "el || '/' || sec | b", "(select *, row_number() over (partition by el order by b, sec) as r from (select el, sec, min(beat) as b, any_value(total) as total, any_value(outro) as outro, any_value(pickup) as pickup, any_value(bars) as bars from x group by el, sec)) where r > 1 and (b - pickup) % case when bars <= 8 then 8 else 16 end <> 0 and not (outro > 0 and b >= total - outro)"),
]))
def edit_length_rules(spark, sf):
    """V1, length and phrases; A22."""
    return _found(edits.length_rules(*_lists(spark, sf)))


@query(_sql([
    ("short_part", _NB, "own left join salvo on own.el = salvo.e where beats < 2 and not (coalesce(fine, false) and jump and steady)"),
    ("short_action", _NB, "own where beats >= 2 and beats < 4 and not steady"),
    ("too_fast", _NB, "x where tempo > 1"),
    ("long_scene", "el || '/' || scene::bigint | b", "(select el, scene, sum(beats) as b from own group by all) where b > 16"),
    ("clip_in_scenes", "el || '/' || c | k", "(select el, c, count(distinct scene) as k from (select el, scene, unnest(case when clip = 'split' then ['c' || (p % 40), 'c' || (u % 40)] else [clip] end) as c from own) group by all) where k > 1"),
    ("jump_back", _NB, "j where src < e - 0.05"),
    ("jump_small", _NB, "j where not src < e - 0.05 and src - e < 1"),
    ("jump_punch", _NB, "j0 where punched = 1 and punch_by > 0.06"),
    ("fades", "el | k", "(select el, count(*) as k from x where fade group by el) where k > 4"),
    ("fade_on_hit", _NB, "x where fade and beat % 4 = 0"),
], """, own as (select *, u % 4 = 0 as steady from x where not cont), salvo as (select el as e, count(distinct scene) = 1 and count(*) <= 4 and max(n) - min(n) = count(*) - 1 as fine from own where beats < 2 and jump and steady group by el),
    b as (select *, lag(clip) over (partition by el order by n) as pc, lag(src) over (partition by el order by n) as ps, lag(beats) over (partition by el order by n) as pb, lag(mode) over (partition by el order by n) as pm, lag(tempo) over (partition by el order by n) as pt from x),
    j0 as (select * from b where jump and pc is not null), j as (select *, ps + pb * 0.5 * pt as e from j0 where clip = pc and clip <> 'split' and pm in ('normal', 'speed', 'slow', 'fast'))"""))  # fmt: skip
def edit_part_rules(spark, sf):
    """V1, parts, tempo, scenes, jump cuts and fades; A19, A20, P7, P8, W21."""
    found = edits.part_rules(*_lists(spark, sf))
    return _found(found)


@query(_sql([
    ("intro_long", "el || '/' || intro | total", "h where intro > 16"),
    ("intro_no_cut", "el || '/' || intro | total", "fl where intro > 0 and not dr"),
    ("intro_fade", _NB, "x where intro > 0 and beat = intro and fade"),
    ("intro_silent", "el || '/' || intro | total", "fl where intro > 0 and not heard"),
    ("moments", "el | k", "(select el, count(*) as k from m group by el) where k > 2"),
    ("moment_over_hit", "el || '/' || n | k", "m where k > 0"),
    ("dialogues", "el | k", "(select el, count(*) as k from x where dialogue group by el) where k > 3"),
    ("dialogue_not_real", _NB, "x where dialogue and (mode <> 'normal' or tempo <> 1 or clip = 'split')"),
    ("dialogue_at_edge", _NB, "x where dialogue and (in_intro or in_outro)"),
    ("sound_on_slow", _NB, "x where sound is not null and tempo <> 1 and not in_intro"),
    ("sound_on_still", _NB, "x where sound is not null and (clip = 'split' or mode = 'freeze')"),
    ("outro_long", "el || '/' || outro | total", "h where outro > 8"),
    ("outro_no_cut", "el || '/' || outro | total", "fl where outro > 0 and not en"),
    ("outro_silent", _NB, "x where in_outro and sound is null"),
], """, fl as (select el, any_value(intro) as intro, any_value(outro) as outro, any_value(total) as total, bool_or(beat = intro) as dr, bool_or(beat = total - outro) as en, bool_or(in_intro and sound is not null) as heard from x group by el),
    fr as (select *, coalesce(sound, '') = 'front' and not dialogue and not in_intro and not in_outro as f from x), nw as (select *, case when f and not coalesce(lag(f) over (partition by el order by n), false) then 1 else 0 end as new from fr),
    mm as (select *, sum(new) over (partition by el order by n rows unbounded preceding) as g from nw), m as (select el, g, min(n) as n, greatest(0, (max(beat + beats) - 1) // 4 - min(beat) // 4) as k from mm where f group by el, g)"""))  # fmt: skip
def edit_sound_rules(spark, sf):
    """V1, intro, sound moments, dialogue and outro; W43."""
    return _found(edits.sound_rules(*_lists(spark, sf)))


@query(_sql([
    ("ramp_not_held", _NB, "x where mode = 'ramp'"),
    ("ramp_not_explosive", _NB, "x where mode in ('ramp', 'ramp_hold') and u % 4 <> 1"),
    ("ramp_off_hit", _NB, "x where mode in ('ramp', 'ramp_hold') and (beat + 2) % 4 <> 0"),
    ("ramps", "el | k", "(select el, count(*) as k from x where mode in ('ramp', 'ramp_hold') group by el) where k > 2"),
    ("flash_off_cut", _NB, "x where flashes = 1 and flash_at <> 0"),
    ("flash_off_hit", _NB, "x where flashes = 1 and (beat + flash_at) % 4 <> 0"),
    ("flashes", "el | k", "(select el, sum(flashes) as k from x group by el) where k > 2"),
    ("shakes", "el | k", "(select el, count(*) as k from x where shake group by el) where k > 2"),
    ("shake_without_blow", _NB, "x where shake and u % 4 <> 2"),
    ("opener", _NB, "x where n = 1 and tempo >= 1 and not (intro > 0 and sound is not null)"),
    ("finale", _NB, "(select * from x where not in_outro qualify row_number() over (partition by el order by n desc) = 1) where beats < 4 or tempo > 0.6 or not push"),
]))
def edit_effect_rules(spark, sf):
    """V1, ramps, flashes, shakes, opener and finale."""
    return _found(edits.effect_rules(*_lists(spark, sf)))


@query(f"""with {_SQL_SHOTS}, o as (select *, row_number() over (partition by el order by n) as place, count(*) over (partition by el) as c from x where not cont),
    k as (select *, greatest(1, coalesce(min(case when place <= 2 and mode not in ('speed', 'slow') then place - 1 end) over (partition by el), 2)) as openers from o), mid as (select * from k where c <= 3 or place > openers and place < c),
    cl as (select el, list_sort(list_distinct(list(c))) as clips from (select el, unnest(case when clip = 'split' then ['c' || (p % 40), 'c' || (u % 40)] else [clip] end) as c from mid) group by el),
    w as (select el, count(*) filter (not cont) as shots, sum(beats) as b, sum(punched + flashes + shake::int + (mode in ('ramp', 'ramp_hold'))::int) as fx from x group by el)
    select w.el, shots, round(b / greatest(1, shots), 6)::double as beats_per_shot, round(fx * 64 / b, 6)::double as effects_per_64, array_to_string(coalesce(clips, []), ',') as clips from w left join cl on w.el = cl.el""")
def edit_figures(spark, sf):
    """Figures and clip set of every edit list."""
    s, _ = _lists(spark, sf)
    return edits.figures(s).select("el", "shots", F.round("beats_per_shot", 6).alias("beats_per_shot"), F.round("effects_per_64", 6).alias("effects_per_64"), F.array_join("clips", ",").alias("clips"))


@query(f"""with {_SQL_SHOTS} select el, n, 'punch' as effect, 0.0::double as "at" from x where punched = 1 union all select el, n, 'flash', flash_at::double from x where flashes = 1 union all select el, n, 'shake', 0 from x where shake
    union all select el, n, 'ramp', 2 from x where mode in ('ramp', 'ramp_hold') union all select el, n, 'jump', 0 from x where jump union all select el, n, 'fade', 0 from x where fade""")
def effect_events(spark, sf):
    """Effects of shots as rows with their onsets."""
    return edits.effect_events(_lists(spark, sf)[0])


@query(f"""with {_SQL_SHOTS}, c as (select el, beats, src, case when clip = 'split' then 1.0 else tempo end as t, unnest(case when clip = 'split' then ['c' || (p % 40), 'c' || (u % 40)] else [clip] end) as clip from x)
    select el, clip, min(src)::double as start, max(src + beats * 0.5 * t)::double as "end" from c group by el, clip""")
def source_windows(spark, sf):
    """A3: the source that all shots of a list need of a clip."""
    s, _ = _lists(spark, sf)
    return edits.source_windows(s, F.lit(0.5))


@query(f"""with {_SQL_SHOTS}, o as (select *, row_number() over (partition by el order by n) as place, count(*) over (partition by el) as c from x where not cont),
    k as (select *, greatest(1, coalesce(min(case when place <= 2 and mode not in ('speed', 'slow') then place - 1 end) over (partition by el), 2)) as openers from o), mid as (select * from k where c <= 3 or place > openers and place < c),
    cl as (select el, list_distinct(list(c)) as clips from (select el, unnest(case when clip = 'split' then ['c' || (p % 40), 'c' || (u % 40)] else [clip] end) as c from mid) group by el),
    w as (select x.el, sum(beats) / greatest(1, count(*) filter (not cont)) as per, sum(punched + flashes + shake::int + (mode in ('ramp', 'ramp_hold'))::int) * 64 / sum(beats) as fx, sum(beats) as b from x group by x.el),
    v as (select w.el, w.el // 16 as piece, (w.el % 5) as hook, b, per, fx, coalesce(clips, []) as clips from w left join cl on w.el = cl.el),
    q as (select a.piece, a.el as x, z.el as y, (abs(a.hook - z.hook) > 2 or a.b <> z.b)::int + (len(list_intersect(a.clips, z.clips)) / greatest(1, len(list_distinct(a.clips || z.clips))) < 0.5)::int + (abs(a.per - z.per) >= 0.5 or abs(a.fx - z.fx) >= 0.3 * greatest(a.fx, z.fx, 1))::int as n from v a join v z on a.piece = z.piece and a.el < z.el)
    select 'variants_alike' as rule, piece || '/' || x || '/' || y as subject, n::varchar as detail from q where n < 2""")
def unlike_variants(spark, sf):
    """Variants of a piece that differ in fewer than two of three aspects."""
    s, g = _lists(spark, sf)
    v = edits.figures(s).join(g.select("el", "beats"), "el").withColumn("piece", F.expr("el div 16")).withColumn("hook", F.col("el") % 5).withColumn("period", F.lit(0.5))
    return _found([rules.unlike_variants(v, ["piece"], "el", "hook", "period", "beats", "clips", "beats_per_shot", "effects_per_64")])


@query("""with f as (select o_orderkey as ord, 'i' || (o_orderkey % 14000) as id, 's' || (o_custkey * 7 + o_orderkey % 5) || ['.mov', '.MP4', '.jpg', '.txt'][1 + o_orderkey % 4] as name, case when o_orderkey % 50 = 0 then 'x' else (o_orderkey % 90)::varchar end as bytes from orders),
    g as (select *, regexp_replace(name, '[.][^.]*$', '') as stem, lower(regexp_extract(name, '[.]([^.]*)$', 1)) as e from f)
    select 'double_id' as rule, 'ERROR' as status, id as subject, count(*)::varchar as detail from g group by id having count(*) > 1 union all select 'double_stem', 'ERROR', stem, count(*)::varchar from g group by stem having count(*) > 1
    union all select 'size_no_number', 'ERROR', id, bytes from g where bytes = 'x' union all select 'size_nothing', 'WARNING', id, bytes from g where bytes = '0' union all select 'unknown_ending', 'WARNING', id, e from g where e = 'txt' union all select 'photo', 'INFO', id, e from g where e = 'jpg'""")
def manifest_rules(spark, sf):
    """V3: findings over a manifest."""
    o = _read(spark, sf, "orders")
    ends = F.array(*map(F.lit, (".mov", ".MP4", ".jpg", ".txt")))
    f = o.select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("i"), (F.col("o_orderkey") % 14000).cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("o_custkey") * 7 + F.col("o_orderkey") % 5).cast("string"), F.get(ends, (F.col("o_orderkey") % 4).cast("int"))).alias("name"),
        F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise((F.col("o_orderkey") % 90).cast("string")).alias("bytes"),
    ).withColumn("stem", F.regexp_replace("name", "[.][^.]*$", ""))
    return rules.findings(rules.manifest_rules(f))


_PROBES = """p as (select l_orderkey as file, max(case when l_orderkey % 7 = 0 then 720 else 1080 end) as w, max(case when l_orderkey % 7 = 0 then 1280 when l_orderkey % 5 = 0 then 1080 else 1920 end) as h, max(case when l_orderkey % 9 = 0 then 25.0 else 30.0 end) as fps, max(case when l_orderkey % 8 = 0 then 'yuv444p' else 'yuv420p' end) as pixel_format,
    max(case when l_orderkey % 6 = 0 then 'hevc' else 'h264' end) as codec, sum(l_quantity)::bigint as duration, sum(l_quantity * 1000000 * (l_orderkey % 30))::bigint as bits, max(l_orderkey % 100) as k from lineitem group by l_orderkey)"""


@query(f"""with {_PROBES}, a as (select *, case when k % 10 > 0 then duration + (k % 4) / 20.0 end as audio, -14 + (k % 5) / 4.0 as loud, -2 + (k % 11) / 4.0 as peak from p),
    t as (select l_orderkey as file, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n, l_partkey % 2 = 0 as key, l_partkey % 3 as j from lineitem), y as (select file, n / 30.0::double + case when j = 0 then 0.02 else 0 end as pts, key from t),
    d as (select *, pts - lag(pts) over (partition by file order by pts) as d from y)
    select 'size_other' as rule, file::varchar as subject, w || 'x' || h as detail from a where w = 720 union all select 'size_wrong', file::varchar, w || 'x' || h from a where w = 1080 and h = 1080 union all select 'rate_wrong', file::varchar, '25' from a where fps = 25
    union all select 'rate_uneven', file::varchar, count(*)::varchar from d where abs(d - 1 / 30.0::double) > 0.25 / 30.0::double group by file union all select 'pixel_format', file::varchar, pixel_format from a where pixel_format <> 'yuv420p' union all select 'codec', file::varchar, codec from a where codec <> 'h264'
    union all select 'bit_rate', file::varchar, bits::varchar from a where not (bits / duration / 1e6 between 8 and 25) union all select 'too_long', file::varchar, (duration * 1000)::varchar from a where duration > 180
    union all select 'no_sound', file::varchar, null from a where audio is null union all select 'sound_off', file::varchar, round(abs(audio - duration) * 1000)::bigint::varchar from a where k % 4 in (1, 2) and audio is not null union all select 'sound_wrong', file::varchar, round(abs(audio - duration) * 1000)::bigint::varchar from a where k % 4 = 3 and audio is not null
    union all select 'loudness', file::varchar, round(loud * 10)::bigint::varchar from a where abs(loud + 14) > 0.7 union all select 'peak', file::varchar, round(peak * 100)::bigint::varchar from a where peak > -0.8 and peak <= 0 union all select 'peak_over', file::varchar, round(peak * 100)::bigint::varchar from a where peak > 0""")
def delivery_rules(spark, sf):
    """V4, rules over probes and packets of delivered files."""
    l = _read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "file")
    k = F.col("file")
    p = l.groupBy("file").agg(F.sum("l_quantity").cast("long").alias("duration"), F.sum(F.col("l_quantity") * 1000000 * (k % 30)).cast("long").alias("bits")).select(
        "file", F.when(k % 7 == 0, 720).otherwise(1080).alias("w"), F.when(k % 7 == 0, 1280).when(k % 5 == 0, 1080).otherwise(1920).alias("h"), F.when(k % 9 == 0, 25.0).otherwise(30.0).alias("fps"),
        F.when(k % 8 == 0, "yuv444p").otherwise("yuv420p").alias("pixel_format"), F.when(k % 6 == 0, "hevc").otherwise("h264").alias("codec"), "duration", "bits", (k % 100).alias("k"),
    )
    p = p.withColumn("audio_duration", F.when(F.col("k") % 10 > 0, F.col("duration") + F.expr("cast((k % 4) / 20.0 as double)") - F.expr("if(k % 4 = 2, 1e-9, 0)"))).withColumn("loudness", -14 + F.col("k") % 5 / F.lit(4.0)).withColumn("peak", -2 + F.col("k") % 11 / F.lit(4.0))
    n = F.row_number().over(Window.partitionBy("file").orderBy(*_ORDER.split(", ")))
    y = l.select("file", (n / F.lit(30.0) + F.when(F.col("l_partkey") % 3 == 0, 0.02).otherwise(0.0)).alias("pts"), (F.col("l_partkey") % 2 == 0).alias("key"))
    return _found(rules.delivery_rules(p, y))


@query("""with f as (select o_orderkey as k, case o_orderkey % 6 when 0 then 'reels/' || (2020 + o_custkey % 9) || '-05-1' || (o_custkey % 7) || '_lauf/' || o_orderkey || '_mit_song.mp4' when 1 then 'reels/neu' || (o_custkey % 40) || '/a_mit_song.mp4' when 2 then 'work/__pycache__/' || o_orderkey || '.pyc' when 3 then 'mix/' || o_orderkey || '.WAV' when 4 then 'x/raw_' || (o_orderkey % 1000) || '.png' else 'docs/' || o_orderkey || '.md' end as path, (o_custkey % 50) * 1048576 as bytes from orders),
    t as (select regexp_extract(path, '^reels/([^/]+)/', 1) as reel, count(*) as n from f where k % 6 < 2 group by 1)
    select 'cache_folder' as rule, path as subject, null::varchar as detail from f where k % 6 = 2 union all select 'large_wave', path, (bytes // 1048576)::varchar from f where k % 6 = 3 and bytes > 20 * 1048576 union all select 'single_frame', path, null from f where k % 6 = 4 and k % 1000 >= 100
    union all select 'folder_name', reel, null from t where reel like 'neu%' union all select 'versions', reel, n::varchar from t where n > 1""")
def folder_rules(spark, sf):
    """V7: findings over a listing of files."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    path = F.expr("""case k % 6 when 0 then concat('reels/', 2020 + c % 9, '-05-1', c % 7, '_lauf/', k, '_mit_song.mp4') when 1 then concat('reels/neu', c % 40, '/a_mit_song.mp4') when 2 then concat('work/__pycache__/', k, '.pyc')
        when 3 then concat('mix/', k, '.WAV') when 4 then concat('x/raw_', k % 1000, '.png') else concat('docs/', k, '.md') end""")
    return _found(rules.folder_rules(o.select(path.alias("path"), ((F.col("c") % 50) * 1048576).alias("bytes"))))


@query("""with o as (select o_orderkey as part, (o_custkey % 50 - 2) / 10.0 as pos, (o_orderkey % 80) / 10.0 as len, case when o_orderkey % 2 = 0 then 'A' end as camera, 2 + o_custkey % 5 as whole from orders)
    select 'outside' as rule, part::varchar as subject, round(pos * 1000)::bigint::varchar as detail from o where pos < 0 or pos >= whole union all select 'beyond_end', part::varchar, round((pos + len - whole) * 1000)::bigint::varchar from o where pos >= 0 and pos < whole and pos + len > whole + 0.02
    union all select 'too_early', part::varchar, round(pos * 1000)::bigint::varchar from o where pos >= 0 and pos < 0.4 and camera is null union all select 'odd_length', part::varchar, round(len * 1000)::bigint::varchar from o where len < 0.6 or len > 6""")
def overlay_rules(spark, sf):
    """V8: bounds of overlays."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("part"), F.expr("(o_custkey % 50 - 2) / 10.0").alias("at"), F.expr("(o_orderkey % 80) / 10.0").alias("length"), F.when(F.col("o_orderkey") % 2 == 0, "A").alias("camera"), (2 + F.col("o_custkey") % 5).alias("part_length"))
    return _found(rules.overlay_rules(o))


@query("""with c as (select p_partkey % 3 as reel, p_partkey as clip, p_size as length, case when p_partkey % 4 = 0 then ['action', 'payoff'] when p_partkey % 4 = 1 then ['action'] else ['group', 'reject'][1 : p_partkey % 2 + 1] end as tags, p_size % 4 + 1 as chapter from part)
    select clip, not list_contains(tags, 'reject') and length >= 10 and (clip % 2 = 0 or not list_contains(tags, 'payoff')) as free, chapter in (1, 2) and list_contains(tags, 'action') as suits from c""")
def slot_candidates(spark, sf):
    """Eligibility of clips for a slot, and whether chapters and tags suit it."""
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("clip"), F.col("p_size").alias("length"), (F.col("p_size") % 4 + 1).alias("chapter"))
    k = F.col("clip") % 4
    p = p.withColumn("tags", F.when(k == 0, F.array(F.lit("action"), F.lit("payoff"))).when(k == 1, F.array(F.lit("action"))).when(k == 3, F.array(F.lit("group"), F.lit("reject"))).otherwise(F.array(F.lit("group"))))
    slot = F.when(F.col("clip") % 2 == 0, "end").otherwise("start")
    free = choice.eligible(slot, F.lit(10), F.col("length"), F.col("tags"), {"end": ["payoff"]}) & ~F.array_contains("tags", "reject")
    return p.select("clip", free.alias("free"), choice.suits(F.array("chapter"), F.array(F.lit(1), F.lit(2)), F.col("tags"), F.array(F.lit("action"))).alias("suits"))


@query("""with t as (select s_suppkey as k, s_suppkey % 5 = 0 as reject from supplier), c as (select p_partkey as k, p_size as length, (p_partkey % 90)::double as score from part)
    select 'c' || t.k as clip, c.length, coalesce(c.score, 50.0)::double as score, c.k is not null as measured from t left join c on t.k = c.k where not reject""")
def clip_pool(spark, sf):
    """The pool of tagged clips with what was measured of them."""
    t = _read(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("clip"), F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("reject"))).otherwise(F.array(F.lit("action"))).alias("tags"), F.array(F.lit(1)).alias("chapters"), F.lit(None).cast("double").alias("moment"))
    c = _read(spark, sf, "part").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("clip"), F.col("p_size").alias("length"), (F.col("p_partkey") % 90).cast("double").alias("score"), F.lit(1.0).alias("motion"))
    return choice.pool(c, t).select("clip", "length", "score", "measured")


@query("""with recursive w as (select distinct l_orderkey as el, l_linenumber as slot from lineitem), s as (select el, slot, row_number() over (partition by el order by slot) as k, el % 25 as g from w),
    c as (select s_suppkey % 25 as g, s_suppkey as clip, s_suppkey % 13 as score from supplier), r as (select s.el, s.slot, s.k, list(c.clip order by score desc, clip) as wanted from s left join c on s.g = c.g and (c.clip + s.slot) % 3 > 0 group by all),
    a as (select el, slot, k, wanted[1] as clip, list_filter([wanted[1]], lambda x: x is not null) as taken from r where k = 1
      union all select r.el, r.slot, r.k, list_filter(r.wanted, lambda x: not list_contains(a.taken, x))[1], list_concat(a.taken, list_filter([list_filter(r.wanted, lambda x: not list_contains(a.taken, x))[1]], lambda x: x is not null)) from a join r on r.el = a.el and r.k = a.k + 1)
    select el, slot, clip::varchar as clip from a""")
def assigned_clips(spark, sf):
    """T3, with T1: slots of an edit list that choose one after the other, each clip once."""
    s = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("el"), F.col("l_linenumber").alias("slot")).distinct().withColumn("g", F.col("el") % 25)
    pool = _read(spark, sf, "supplier").select((F.col("s_suppkey") % 25).alias("g"), F.col("s_suppkey").alias("clip"), (F.col("s_suppkey") % 13).alias("score"))
    # Lists share pools, so a pool is ranked once for all of its lists.
    pool = pool.select("g", "clip", "score", F.explode(F.expr("filter(array(0, 1, 2), r -> (clip + r) % 3 > 0)")).alias("kind"))
    return selection.assigned_once(s.select("el", "g", "slot", (F.col("slot") % 3).cast("int").alias("kind")), pool, ["el"], ["slot"], [F.desc("score"), F.col("clip")], "slot", "clip", "kind", ["g"])


_SHOT_SPANS = "h as (select l_orderkey as el, l_linenumber as n, min(l_partkey) % 60 as clip, (min(l_suppkey) % 50)::double as a, (min(l_suppkey) % 50)::double + 2 + min(l_partkey) % 4 as z from lineitem group by all)"


def _shot_spans(spark, sf):
    l = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("el"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"))
    return l.select("el", "n", (F.col("p") % 60).alias("clip"), (F.col("u") % 50).cast("double").alias("start"), ((F.col("u") % 50).cast("double") + 2 + F.col("p") % 4).alias("end"))


@query(f"""with {_SHOT_SPANS}, t as (select s_suppkey % 60 as clip, (s_suppkey % 45)::double as a, (s_suppkey % 45)::double + 1.5 + s_suppkey % 4 as z, (s_suppkey % 45) + 0.5::double as c, (s_suppkey % 45)::double + 1.3 + s_suppkey % 4 as d from supplier),
    b as (select clip, min(a) + 20 as a, min(a) + 23.0 as z from t group by clip), o as (select el, n, sum(least(h.z, b.z) - greatest(h.a, b.a)) as s, any_value(h.z - h.a) as len from h join b on h.clip = b.clip and least(h.z, b.z) > greatest(h.a, b.a) group by all)
    select 'run_up_missing' as rule, el || '/' || n as subject, count(*)::varchar as detail from h join t on h.clip = t.clip and t.z - t.a <= 4 and h.a > c + 0.15 and h.a < d - 0.15 group by el, n
    union all select 'landing_missing', el || '/' || n, count(*)::varchar from h join t on h.clip = t.clip and t.z - t.a <= 4 and h.z > c + 0.15 and h.z < d - 0.15 group by el, n
    union all select 'unclean', el || '/' || n, round(100 * s / len)::bigint::varchar from o where s > 0.15 * len""")
def cut_findings(spark, sf):
    """V2, findings of run-up, landing and unclean share."""
    v = F.col("s_suppkey")
    s = _read(spark, sf, "supplier")
    t = s.select((v % 60).alias("clip"), (v % 45).cast("double").alias("start"), ((v % 45).cast("double") + 1.5 + v % 4).alias("end"), ((v % 45) + F.lit(0.5)).alias("core_start"), ((v % 45).cast("double") + 1.3 + v % 4).alias("core_end"))
    b = t.groupBy("clip").agg((F.min("start") + 20).alias("start"), (F.min("start") + 23.0).alias("end"))
    return _found(edits.cut_findings(_shot_spans(spark, sf), t, b, 5, depth=0.15, longest=4.0, most_unclean=0.15))


_MEASURED = """t as (select s_suppkey % 60 as clip, (s_suppkey % 45)::double as a, (s_suppkey % 45)::double + 1.5 + s_suppkey % 4 as z, (s_suppkey % 45) + 0.5::double as c, (s_suppkey % 45)::double + 1.3 + s_suppkey % 4 as d from supplier),
    b as (select clip, min(a) + 20 as a, min(a) + 23.0 as z from t group by clip), g as (select clip, min(a) - clip % 3 as low, max(z) + clip % 3 as high from t group by clip), k as (select t.* from t join g using (clip) where z - a <= 2.5 and a > low + 0.05 and z < high - 0.05)"""


def _measured(spark, sf):
    v, s = F.col("s_suppkey"), _read(spark, sf, "supplier")
    t = s.select((v % 60).alias("clip"), (v % 45).cast("double").alias("start"), ((v % 45).cast("double") + 1.5 + v % 4).alias("end"), ((v % 45) + F.lit(0.5)).alias("core_start"), ((v % 45).cast("double") + 1.3 + v % 4).alias("core_end"))
    b = t.groupBy("clip").agg((F.min("start") + 20).alias("start"), (F.min("start") + 23.0).alias("end"))
    return t, b, t.groupBy("clip").agg((F.min("start") - F.col("clip") % 3).alias("low"), (F.max("end") + F.col("clip") % 3).alias("high"))


@query(f"""with {_SHOT_SPANS}, {_MEASURED} select 'run_up_missing' as rule, el || '/' || n as subject, count(*)::varchar as detail from h join k on h.clip = k.clip and h.a > c + 0.1 and h.a < d - 0.1 group by el, n
    union all select 'landing_missing', el || '/' || n, count(*)::varchar from h join k on h.clip = k.clip and h.z > c + 0.1 and h.z < d - 0.1 group by el, n""")
def cut_findings_in_range(spark, sf):
    """V2: findings of run-up and landing, without actions at the edge of what was measured."""
    t, b, g = _measured(spark, sf)
    return _found(edits.cut_findings(_shot_spans(spark, sf), t, b, 5, ranges=g)[:2])


@query(f"""with {_SHOT_SPANS}, {_MEASURED}, o as (select distinct h.clip, h.a as s0, h.z - h.a as len, g.low, g.high from h join g on h.clip = g.clip where h.z - h.a <= high - low + 1e-6),
    f as (select *, greatest(low, s0 - 2) as f, least(high - len, s0 + 2) + 1e-6 as l from o), p as (select clip, s0, len, f + unnest(range(0, ceil((l - f) / 0.25)::int)) * 0.25 as s from f where l > f), q as (select *, s + len as e from p),
    u as (select q.*, (select count(*) from k where k.clip = q.clip and q.s > c + 0.1 and q.s < d - 0.1) + (select count(*) from k where k.clip = q.clip and q.e > c + 0.1 and q.e < d - 0.1) as cut,
        (select count(*) from t where t.clip = q.clip and c >= q.s - 0.05 and d <= q.e + 0.05) as whole, coalesce((select sum(greatest(0, least(b.z, q.e) - greatest(b.a, q.s))) from b where b.clip = q.clip), 0) as dirty,
        coalesce((select sum(greatest(0, least(b.z, q.s + 0.3) - greatest(b.a, q.s))) from b where b.clip = q.clip), 0) as d1, coalesce((select sum(greatest(0, least(b.z, q.e) - greatest(b.a, q.e - 0.3))) from b where b.clip = q.clip), 0) as d2 from q),
    r as (select clip, s0, len, round(s, 2) as s, round(4.0 * cut + 10.0 * greatest(0, dirty / len - 0.1) + 2.0 * ((d1 >= 0.15)::int + (d2 >= 0.15)::int) - 0.8 * least(2, whole) + 0.05 * abs(s - s0), 9) as cost from u),
    r1 as (select clip, s0, len, arg_min({{'s': s, 'c': cost}}, {{'c': cost, 's': s}}) as x from r group by all), r2 as (select r.clip, r.s0, r.len, arg_min({{'s': s, 'c': cost}}, {{'c': cost, 's': s}}) as x from r join r1 on r.clip = r1.clip and r.s0 = r1.s0 and r.len = r1.len and abs(r.s - r1.x.s) >= 0.4 group by all),
    r3 as (select r.clip, r.s0, r.len, arg_min({{'s': s, 'c': cost}}, {{'c': cost, 's': s}}) as x from r join r1 on r.clip = r1.clip and r.s0 = r1.s0 and r.len = r1.len and abs(r.s - r1.x.s) >= 0.4 join r2 on r.clip = r2.clip and r.s0 = r2.s0 and r.len = r2.len and abs(r.s - r2.x.s) >= 0.4 group by all),
    every as (select *, 1 as rank from r1 union all select *, 2 from r2 union all select *, 3 from r3)
    select el, n, rank::int as rank, x.s as start, round(x.s + len, 2) as "end", round(x.c, 6) as cost from h join every on h.clip = every.clip and h.a = s0 and h.z - h.a = len""")
def cut_suggestions(spark, sf):
    """V2, the suggestions: cheapest places of a shot near where it is."""
    t, b, g = _measured(spark, sf)
    shots = _shot_spans(spark, sf).withColumn("moment", F.lit(None).cast("double"))
    return edits.cut_suggestions(shots, t, b, g, 5, step=0.25, search=2.0).withColumn("cost", F.round("cost", 6))


@query(f"""with {_SHOT_SPANS}, w as (select p_partkey % 60 as clip, p_partkey as w, (p_size % 50)::double - 0.3 as s, (p_size % 50)::double + 0.1 + (p_partkey % 5) / 10.0 as e from part)
    select el, n, 'start' as side, w from h join w on h.clip = w.clip and h.a - 0.02 > s and h.a - 0.02 < e - 0.05 union all select el, n, 'end', w from h join w on h.clip = w.clip and h.z - 0.03 > s and h.z - 0.03 < e - 0.1""")
def broken_words(spark, sf):
    """Words that a cut falls into."""
    p = F.col("p_partkey")
    w = _read(spark, sf, "part").select((p % 60).alias("clip"), p.alias("w"), ((F.col("p_size") % 50).cast("double") - 0.3).alias("s"), ((F.col("p_size") % 50).cast("double") + 0.1 + p % 5 / F.lit(10.0)).alias("e"))
    return edits.broken_words(_shot_spans(spark, sf), w, 2)


@query(f"""with {_SHOT_SPANS}, f as (select distinct s_suppkey % 60 as clip, (s_suppkey % 48)::double as a, (s_suppkey % 48)::double + 1 as z, 'fx' || s_suppkey % 3 as fx from supplier)
    select el, n, fx, f.a as since from h join f on h.clip = f.clip and h.a >= f.a - 0.000001 and h.a < f.z - 0.000001""")
def active_effects(spark, sf):
    """Effects active where a shot begins; half-open, with a small slack."""
    v = F.col("s_suppkey")
    f = _read(spark, sf, "supplier").select((v % 60).alias("clip"), ((v % 48).cast("double") - 1e-6).alias("a"), ((v % 48).cast("double") + 1 - 1e-6).alias("z"), F.concat(F.lit("fx"), v % 3).alias("fx"), (v % 48).cast("double").alias("since")).distinct()
    from chronoweave.operators import matching

    return matching.points_in_intervals(_shot_spans(spark, sf), f, ["clip"], "start", "a", "z", 4, half_open=True).select("el", "n", "fx", "since")


@query("""with c as (select distinct (c_custkey % 90)::varchar as key from customer where c_custkey % 90 >= 10), f as (select p_partkey % 3 as folder, case when p_partkey % 5 = 0 then 'IMG_' when p_partkey % 5 = 1 then '' else 'x' end || (p_partkey % 700)::varchar || case when p_partkey % 4 = 0 then '.txt' else '.MOV' end as name from part),
    h as (select key, folder, name, case when name = 'IMG_' || key || '.MOV' then 0 when name = key || '.MOV' then 1 else 2 end as rank from c join f on contains(regexp_replace(name, '[.][^.]*$', ''), key) and name like '%.MOV')
    select key, folder, name from h qualify row_number() over (partition by key order by folder, rank, name) = 1""")
def files_of_clips(spark, sf):
    """A clip's file by ordered patterns in ordered folders."""
    from chronoweave.operators import matching

    c = _read(spark, sf, "customer").where("c_custkey % 90 >= 10").select((F.col("c_custkey") % 90).cast("string").alias("key"))
    name = F.expr("concat(case when p_partkey % 5 = 0 then 'IMG_' when p_partkey % 5 = 1 then '' else 'x' end, p_partkey % 700, case when p_partkey % 4 = 0 then '.txt' else '.MOV' end)")
    return matching.find_in_folders(c, _read(spark, sf, "part").select((F.col("p_partkey") % 3).alias("folder"), name.alias("name")), "key", ["mov", "mp4"])


@query("""with s as (select o_orderkey as id, ['zoom', 'flash', 'bw', 'other'][1 + o_orderkey % 4] as fx, o_custkey % 6 as k, o_custkey % 7 as b from orders),
    e as (select id, fx, k, b, unnest(case k when 0 then [b * 0.5, (b + 2) * 0.5] when 1 then [b * 1.0] when 2 then list_transform(range(greatest(0, ceil((case when b % 2 = 0 then 12.0 else 40.0 end - 0.000001 - b) / 4.0))::bigint), lambda j: (b + j * 4) * 0.5) when 3 then [b * 0.5] when 4 then [b / 3.0] else [0.0] end) as t from s where fx <> 'other')
    select id, fx, round(round(t * 30) / 30.0, 6)::double as t, case when b = 3 then 1.0 when k = 5 and fx <> 'flash' then 20.0 end::double as length from e""")
def expanded_effects(spark, sf):
    """X-registry: events that specifications of registered effects stand for."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, ("zoom", "flash", "bw", "other"))), (F.col("o_orderkey") % 4).cast("int")).alias("fx"), (F.col("o_custkey") % 6).alias("k"), (F.col("o_custkey") % 7).cast("double").alias("b"))
    k, b = F.col("k"), F.col("b")
    s = o.select(
        "id", "fx", F.when(k == 0, F.array(b, b + 2)).alias("at_beats"), F.when(k == 1, F.array(b)).alias("at"), F.when(k == 2, F.lit(4.0)).alias("every"), F.when(k.isin(2, 3), b).alias("beat"),
        F.when((k == 2) & (b % 2 == 0), F.lit(12.0)).alias("until"), F.when(k == 4, b / 3).alias("t"), F.when(b == 3, F.lit(2.0)).alias("beats"), F.lit(None).cast("double").alias("length"),
    )
    return edits.expanded_effects(s, ["id"], 0.5, 20.0, 30, {"zoom": None, "flash": 0.2, "bw": None}).withColumn("t", F.round("t", 6))
