"""Registered queries of scalar functions, robust fits, mappings, keyword windows and unions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.functions import scalar
from chronoweave.operators import aggregates, matching, rules, sets
from chronoweave.plans.catalog import _E, HOUR, _events, _read, query
from chronoweave.streaming import sessions


@query(r"""with w as (select conv_id, turn, string_split(text, ' ') as ws from conversations)
    select conv_id, turn, regexp_replace(lower(ws[1]), '[^\p{L}\p{N}_]', '', 'g') as plain, substring(regexp_replace(lower(ws[1]), '[^\p{L}\p{N}_]', '', 'g'), 1, 5) as stem,
        regexp_replace(array_to_string(ws[1:6], ' '), ' +([.,;:!?…])', '\1', 'g') as joined, (length(text) * 7 // 3600) || ':' || lpad((length(text) * 7 // 60 % 60)::varchar, 2, '0') || ':' || lpad((length(text) * 7 % 60)::varchar, 2, '0') || '.50' as clock from w join (select conv_id, turn, text from conversations) using (conv_id, turn)""")
def word_forms(spark, sf):
    """F-string, F-date: plain form, stem, joined text and clock time."""
    w = F.split("text", " ")
    return _read(spark, sf, "conversations").select(
        "conv_id", "turn", scalar.norm(F.get(w, F.lit(0))).alias("plain"), scalar.stem(F.get(w, F.lit(0))).alias("stem"), scalar.join_words(F.slice(w, 1, 6)).alias("joined"), scalar.clock(F.length("text") * 7 + F.lit(0.5)).alias("clock")
    )


@query("""with p as (select p_partkey as k, p_size as s from part) select k, case when k % 5 > 0 then s / (k % 5)::double end as ratio, round(20 * log10(greatest(s / 100.0, 1e-9)), 6)::double as db,
    round(case when s >= 40 then 1 else (s / 40.0) * (s / 40.0) * (3 - 2 * (s / 40.0)) end, 6)::double as curve, case when k % 7 + k % 11 = 2 * (k % 13) then 0 else round(0.5 * (k % 7 - k % 11) / (k % 7 - 2 * (k % 13) + k % 11), 6) end::double as peak,
    (64 - bit_count(xor(k, s::bigint))) / 64.0::double as agreement from p""")
def curves_and_levels(spark, sf):
    """F-math: ratio, decibels, S-curve, parabola and bit agreement."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return _read(spark, sf, "part").select(
        k.alias("k"), scalar.ratio(F.concat_ws("/", s.cast("string"), (k % 5).cast("string"))).alias("ratio"), F.round(scalar.decibel(s / 100.0), 6).alias("db"), F.round(scalar.s_curve(s / 40.0), 6).alias("curve"),
        F.round(scalar.parabola_peak(k % 7, k % 13, k % 11).cast("double"), 6).alias("peak"), scalar.agreement(k, s.cast("long")).alias("agreement"),
    )


@query("""with c as (select label, any_value(embedding order by vec_id) as first from embeddings group by label) select vec_id, round(list_cosine_similarity(embedding::double[], first::double[]), 6) as cosine, len(list_intersect([vec_id % 3, vec_id % 5, 9], [vec_id % 4, vec_id % 5, 9])) / len(list_distinct([vec_id % 3, vec_id % 5, 9, vec_id % 4]))::double as jaccard from embeddings join c using (label)""")
def vector_likeness(spark, sf):
    """F-array: cosine of vectors, Jaccard of arrays."""
    e = _read(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    v = F.col("vec_id")
    a, b = F.array(v % 3, v % 5, F.lit(9)), F.array(v % 4, v % 5, F.lit(9))
    return e.join(first, "label").select("vec_id", F.round(scalar.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"), scalar.jaccard(a, b).alias("jaccard"))


@query("""with m as (select user_id, event_type, avg(round(value * 100)::bigint) as mean from events group by all), r as (select *, row_number() over (partition by user_id order by mean desc, event_type) as rank from m) select user_id, event_type, round(mean, 6) as mean, rank from r where rank <= 2""")
def top_labels(spark, sf):
    """A10: labels of highest mean."""
    e = _read(spark, sf, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return aggregates.top_classes(e, ["user_id"], "event_type", "v", 2).select("user_id", "event_type", F.round("mean", 6).alias("mean"), "rank")


@query("""with m as (select s_suppkey as c, (s_suppkey % 50) / 10.0 as o, (s_suppkey % 7) / 100000.0 as d, 20 + s_suppkey % 30 as n from supplier), l as (select l_orderkey, l_linenumber, l_suppkey as a, 1 + l_partkey % 40 as b, (l_partkey % 300) / 10.0 as t from lineitem),
    j as (select l.*, (x.o + t * (1 + x.d) - y.o) / (1 + y.d) as u, y.n from l left join m x on x.c = a left join m y on y.c = b) select l_orderkey, l_linenumber, a, b, t::double as t, round(case when u between 0 and n then u end, 4)::double as t_there from j""")
def mapped_times(spark, sf):
    """Times of one recording in another's, null outside it."""
    m = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), (F.col("s_suppkey") % 50 / 10.0).alias("offset"), (F.col("s_suppkey") % 7 / 100000.0).alias("drift"), (20 + F.col("s_suppkey") % 30).alias("duration"))
    l = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"), (1 + F.col("l_partkey") % 40).alias("b"), (F.col("l_partkey") % 300 / 10.0).alias("t"))
    return matching.map_time(l, m, "a", "b", "t").withColumn("t_there", F.round("t_there", 4))


@query("""with u as (select o_custkey as k, 1 as part, o_orderkey as ord from orders where o_orderkey % 2 = 0 union all select o_custkey, 2, o_orderkey from orders where o_orderkey % 2 = 1) select k, part - 1 as part, ord from u qualify row_number() over (partition by k order by part, ord) = 1""")
def layered_union(spark, sf):
    """Of equal keys the row of the first part."""
    o = _read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"))
    parts = [o.where("ord % 2 = 0").withColumn("part", F.lit(0)), o.where("ord % 2 = 1").withColumn("part", F.lit(1))]
    return sets.ordered_union(parts, ["k"]).select("k", F.col("part").cast("long").alias("part"), "ord")


@query("""select s_suppkey, case when s_suppkey % 2 = 0 then 'own' when s_suppkey % 3 = 0 then 'team' else 'default' end as a, case when s_suppkey % 3 = 0 then 'team' else 'default' end as b from supplier""")
def layered_settings(spark, sf):
    """S15, F-map: settings in layers, the later ones win."""
    pair = lambda k, v, when: F.map_filter(F.create_map(F.lit(k), F.lit(v)), lambda _, x: when)
    three, two = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 2 == 0
    m = sets.layered([F.create_map(F.lit("a"), F.lit("default"), F.lit("b"), F.lit("default")), pair("a", "team", three), pair("b", "team", three), pair("a", "own", two)])
    return _read(spark, sf, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("""with f as (select 'many_lines' as rule, 'WARNING' as status, count(*) as n from (select l_orderkey from lineitem group by l_orderkey having count(*) > 6) union all select 'price', 'ERROR', count(*) from orders where o_totalprice > 100000) select * from f where n > 0""")
def rule_summary(spark, sf):
    """Findings counted by rule and status."""
    o, l = _read(spark, sf, "orders"), _read(spark, sf, "lineitem").select("l_orderkey")
    found = rules.findings([rules.having("many_lines", "WARNING", l, ["l_orderkey"], F.count("*"), F.col("measure") > 6), rules.where("price", "ERROR", o, F.col("o_totalprice") > 100000, F.col("o_orderkey"), F.col("o_custkey"))])
    return rules.summary(found)


@query("""with o as (select o_orderstatus as k, (o_orderkey % 1000)::double as x, (o_custkey % 1000)::double as y from orders), a as (select k, regr_slope(y, x) as s, regr_intercept(y, x) as i from o group by k),
    r as (select o.*, y - s * x - i as r from o join a using (k)), d as (select k, stddev_pop(r) as d from r group by k), z as (select r.* from r join d using (k) where abs(r) <= 1.5 * d + 1e-12)
    select k, count(*) as n, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 3) as intercept from z group by k""")
def trimmed_line(spark, sf):
    """A line fitted again without outliers."""
    o = _read(spark, sf, "orders").select(F.col("o_orderstatus").alias("k"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.col("o_custkey") % 1000).cast("double").alias("y"))
    return aggregates.fit_line(o, ["k"], "x", "y", 2, 1.5).select("k", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("""with l as (select l_partkey as k, (l_orderkey % 500)::double as x, l_quantity::double as y from lineitem), g as (select distinct k, x, y from l),
    s as (select a.k, median((b.y - a.y) / (b.x - a.x)) as s from g a join g b on a.k = b.k and a.x < b.x group by a.k), m as (select g.k, s, median(y - s * x) as i from g join s using (k) group by g.k, s),
    r as (select g.*, abs(y - s * x - i) as r from g join m using (k)), d as (select k, median(r) * 1.4826 as d from r group by k), z as (select r.* from r join d using (k) where r <= greatest(3 * d, 1e-3))
    select k, count(*) as n, round(regr_slope(y, x), 6) as slope, round(sqrt(greatest(regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x), 0) / greatest(1, count(*) - 2) / regr_sxx(y, x)), 6) as error from z group by k""")
def robust_line(spark, sf):
    """Median of pairwise slopes, then least squares on the inliers with a standard error."""
    l = _read(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") % 500).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y")).distinct()
    return aggregates.robust_line(l, ["k"], "x", "y").select("k", "n", F.round("slope", 6).alias("slope"), F.round("error", 6).alias("error"))


@query(f"""with {_E} select user_id, count(*) as n, (t // {6 * HOUR}) * {6 * HOUR} as start from e group by user_id, t // {6 * HOUR}""")
def windowed_counts(spark, sf):
    """Beyond the reference: tumbling windows, the same on a stream."""
    w = sessions.windowed_counts(_read(spark, sf, "events"), ["user_id"], "ts", "6 hours")
    return w.select("user_id", "n", scalar.micros("start").alias("start"))


@query(r"""with c as (select conv_id, turn, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', '', 'g'), ' ') as ws from conversations), w as (select conv_id, turn, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from c),
    t as (select conv_id, turn, i, w[1:5] as s from w where length(w) >= 4), k as (select distinct item_id, unnest(list_transform(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', '', 'g'), ' '), lambda x: length(x) >= 4), lambda x: x[1:5])) as s from benchmark),
    h as (select distinct a.conv_id, a.turn, a.i, k.item_id from t a join k using (s)), n as (select a.conv_id, a.turn, a.i, count(*) as n from (select distinct conv_id, turn, i from h) a join t b on a.conv_id = b.conv_id and a.turn = b.turn and b.i between a.i and a.i + 8 group by all),
    g as (select h.conv_id, h.turn, h.i, h.item_id, count(distinct b.s) as hits from h join t b on h.conv_id = b.conv_id and h.turn = b.turn and b.i between h.i and h.i + 8 join k on k.item_id = h.item_id and k.s = b.s group by all)
    select g.conv_id, g.turn, g.i, item_id, round(hits + 0.01 * n, 2)::double as score from g join n using (conv_id, turn, i)""")
def keyword_windows(spark, sf):
    """Stems of content words against keywords, scored by distinct hits and words of the window."""
    tokens = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_ ]", ""), " ")
    words = _read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tokens).alias("i", "w")).where(F.length("w") >= 4).select("conv_id", "turn", F.col("i").cast("long").alias("i"), F.substring("w", 1, 5).alias("s"))
    keys = _read(spark, sf, "benchmark").select("item_id", F.explode(tokens).alias("w")).where(F.length("w") >= 4).select("item_id", F.substring("w", 1, 5).alias("s"))
    return matching.keyword_windows(words, keys, ["conv_id", "turn"], "i", "s", "item_id", 8).select("conv_id", "turn", "i", "item_id", F.round("score", 2).alias("score"))


@query("""with l as (select lang, source, doc_id, n_chars from documents), n as (select lang, count(*) as c from l group by lang) select lang, source, count(*) as n, round(avg((n_chars > 1000)::int), 6) as long_share from l group by lang, source""")
def true_shares(spark, sf):
    """Share of rows that meet a condition, by group."""
    return _read(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 6).alias("long_share"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as place from orders")
def smallest_first(spark, sf):
    """Work in order of size, by customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return _read(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query(r"""with recursive c as (select conv_id, turn, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', '', 'g'), ' ') as ws from conversations), w as (select conv_id, turn, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from c),
    k as (select distinct item_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', '', 'g'), ' '), lambda x: length(x) >= 6)) as w from benchmark), h as (select conv_id, turn, i, item_id, length(any_value(w.w)) as score from w join k on k.w = w.w group by all),
    n as (select *, row_number() over (partition by conv_id order by turn, score desc, i, item_id) as r from h),
    x as (select conv_id, r, turn, i, item_id, [item_id] as used, [i] as places, 1 as rank from n where r = 1
      union all select n.conv_id, n.r, n.turn, n.i, n.item_id,
        case when not list_contains(used, n.item_id) and (n.turn <> x.turn or len(places) < 2 and len(list_filter(places, lambda q: abs(n.i - q) < 12)) = 0) then list_append(used, n.item_id) else used end,
        case when not list_contains(used, n.item_id) and (n.turn <> x.turn or len(places) < 2 and len(list_filter(places, lambda q: abs(n.i - q) < 12)) = 0) then case when n.turn <> x.turn then [n.i] else list_append(places, n.i) end when n.turn <> x.turn then [] else places end,
        case when not list_contains(used, n.item_id) and (n.turn <> x.turn or len(places) < 2 and len(list_filter(places, lambda q: abs(n.i - q) < 12)) = 0) then case when n.turn <> x.turn then 1 else len(places) + 1 end end
      from x join n on n.conv_id = x.conv_id and n.r = x.r + 1)
    select conv_id, turn, i, item_id, rank::int as rank from x where rank is not null""")
def spread_keywords(spark, sf):
    """Keyword candidates chosen turn by turn with a cap, a spacing and each item once."""
    from chronoweave.operators import selection

    tokens = F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_ ]", ""), " ")
    words = _read(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(tokens).alias("i", "w")).withColumn("i", F.col("i").cast("long"))
    keys = _read(spark, sf, "benchmark").select("item_id", F.explode(tokens).alias("w")).where(F.length("w") >= 6).distinct()
    c = words.join(keys, "w").groupBy("conv_id", "turn", "i", "item_id").agg(F.max(F.length("w")).alias("score"))
    return selection.spread_choice(c, ["conv_id"], "turn", [F.desc("score"), F.col("i"), F.col("item_id")], "i", "item_id", 2, 12).select("conv_id", "turn", "i", "item_id", "rank")
