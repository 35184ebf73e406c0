"""Queries of the thirteen operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, html_template, licenses, line_dedup, nbsvm, ngram_join, packing, quality_rules, resampling, toxicity, vector_graph, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("version")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "emptied", "text")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; a document's is made of its source, language and id, fifty to a directory, the first of which is named as its licence file."""
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.col("doc_id").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 50 as string)"), name).alias("path"))
    return licenses.scan(docs, keep=("doc_id",))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_quality_rules, op4_html, op5_ngram_join, op6_packing, op7_decontamination, op8_line_dedup, op9_quality_classifier, op10_licenses, op11_resampling, op12_vectors, op13_conversations)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The table of a byte-wise CRC-32, from its rule, and the sum of a text.
_CRC_TABLE = """tab as (select list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"""


def _crc(text: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


_TRIM = "rtrim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _step(target: str, ways: list[tuple[str, str, str]]) -> str:
    """The cheapest way into a state, then the ASCII-least: (state before, inserted letters, what the row does)."""
    place = {"e": 0, "s": 1, "u": 2, "a": 3}
    out = []
    for before, inserted, act in ways:
        lines, at = [], before
        for _ in inserted:
            at = "a" if at == "u" else "u"
            lines.append("'assistant:'" if at == "a" else "'user:'")
        price, when = {"D": ("2", "true"), "K": ("more", f"not must and initial = '{target}'"), "R": ("1 + more", "not must")}[act]
        if act == "K":
            lines.append("role || ':' || text")
        elif act == "R":
            lines.append(f"'{'assistant' if target == 'a' else 'user'}:' || text")
        p = f"p[{place[before] + 1}]"
        out.append(f"case when {when} then {{'c': {p}.c + {5 * len(inserted)} + {price}, 's': {p}.s || '{inserted}{act}', 'r': list_concat({p}.r, [{', '.join(lines)}]::varchar[])}} end")
    return f"list_sort(list_filter([{', '.join(out)}], lambda x: x is not null))[1]"


_BEFORE = {"e": [("e", "")], "s": [("s", "")], "u": [("u", ""), ("e", "I"), ("s", "I"), ("a", "I")], "a": [("a", ""), ("u", "I"), ("e", "II"), ("s", "II")]}
_STEPS = {t: [(b, i, "D") for b, i in _BEFORE[t]] for t in "esua"}
_STEPS["s"] += [("e", "", "K")]
_STEPS["u"] += [(b, i, act) for at in "esa" for b, i in _BEFORE[at] for act in "KR"]
_STEPS["a"] += [(b, i, act) for b, i in _BEFORE["u"] for act in "KR"]

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op11_resampling": rf"""
        with {_CRC_TABLE},
        both_ as (select 'd' as k, doc_id, row_number() over () as r, text from documents union all select 'b', null, row_number() over (), text from benchmark),
        w as (select k, doc_id, r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from both_),
        g as (select k, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from w),
        c as (select k, r, g, count(*) as n from g group by all),
        b as (select g, {_crc("g")} % 10000 as bucket from (select distinct g from c), tab),
        s as (select bucket, coalesce(sum(n) filter (k = 'd'), 0)::double as s, coalesce(sum(n) filter (k = 'b'), 0)::double as t from c join b using (g) group by bucket),
        a as (select coalesce(sum(s), 0) as s_all, coalesce(sum(t), 0) as t_all from s),
        gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from s, a),
        f as (select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from c join b using (g) join gain using (bucket) where k = 'd' group by r),
        d as (select doc_id, r, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                     ('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from w left join f using (r) where k = 'd'),
        e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from d),
        o as (select r, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from e where n_words >= 20)
        select doc_id, n_features, weight, score, case when place <= 25 * n // 100 then place end as rank from e left join o using (r)""",
    "op12_vectors": """
        with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as x from embeddings where label is not null and len(embedding) > 0
                             and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
        n as (select *, sqrt(list_inner_product(x, x)) as size from v),
        link as (select a.r as a, b.r as b from n a join n b on a.label = b.label and len(a.x) = len(b.x) and a.r <> b.r where list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.93),
        reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
        c as (select reach.a as r, min(v.vec_id) as least from reach join v on v.r = reach.b group by reach.a),
        d as (select a as r, count(*) as n from link group by a)
        select v.vec_id, coalesce(d.n, 0) as n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) as component_id, coalesce(v.vec_id <= coalesce(c.least, v.vec_id), false) as kept
        from v left join c using (r) left join d using (r)
        union all select vec_id, 0, vec_id, vec_id is not null from embeddings where label is null or coalesce(len(embedding), 0) = 0
                             or len(list_filter(embedding, lambda c: c is null or not isfinite(c))) > 0 or len(list_filter(embedding, lambda c: c <> 0)) = 0""",
    "op13_conversations": rf"""
        with recursive {_CRC_TABLE},
        given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d from conversations, tab),
        rows_ as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text,
                         unnest(case when d = 3 then [0, 1] else [0] end) as copy from given where d <> 0),
        n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, left(role, 1) as initial, {_TRIM.format("text")} as own from rows_),
        f as (select *, case when own = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                             when right(own, 1) not in ('.', '!', '?') then 'truncated' end as fault,
                     lag(initial) over (partition by conv_id order by i) || initial as two from n),
        m as (select *, coalesce(fault, '') in ('blank', 'duplicate') as must, case when fault = 'truncated' then 5 else 0 end as more from f),
        path as (
            select conv_id, 0::bigint as i, [{{'c': 0, 's': '', 'r': []::varchar[]}}, {", ".join(["{'c': 1000000, 's': '', 'r': []::varchar[]}"] * 3)}] as p from (select distinct conv_id from conversations)
            union all
            select path.conv_id, m.i, [{", ".join(_step(t, _STEPS[t]) for t in "esua")}]
            from path join m on m.conv_id is not distinct from path.conv_id and m.i = path.i + 1),
        last_ as (select conv_id, list_sort([p[1], p[4], {{'c': p[3].c + 5, 's': p[3].s || 'I', 'r': list_append(p[3].r, 'assistant:')}},
                                             {{'c': p[2].c + 10, 's': p[2].s || 'II', 'r': list_concat(p[2].r, ['user:', 'assistant:'])}}])[1] as best
                  from (select conv_id, arg_max(p, i) as p from path group by conv_id)),
        t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                     count(*) filter (fault = 'truncated') as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal from m group by conv_id)
        select l.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               best.c::bigint as cost, best.s as audit, sha256(array_to_string(best.r, chr(10))) as repaired_sha256
        from last_ l left join t on t.conv_id is not distinct from l.conv_id""",
    "op2_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        g as (select payload_digest, max(page_id) as original from p where payload_bytes >= 1000 group by payload_digest)
        select p.page_id, p.payload_bytes, p.payload_digest,
               case when g.original is null or g.original = p.page_id then 'response' else 'revisit' end as record_type,
               case when g.original <> p.page_id then g.original end as refers_to
        from p left join g on p.payload_digest = g.payload_digest and p.payload_bytes >= 1000""",
    "op3_quality_rules": rf"""
        with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
        b as (select doc_id, text, w, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
        win as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
        dup as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
        rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from dup) group by doc_id),
        m as (select b.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(rep.n, 0) as n_repeat_words,
                     len(list_filter(w, lambda x: lower(x) in ({", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))}))) as n_stop,
                     len(list_filter(w, lambda x: x = upper(x) and x <> lower(x) and length(x) > 1)) as n_upper
              from b left join rep on b.doc_id = rep.doc_id),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not base_failed and coalesce(word_chars / n_words >= 1.5 and word_chars / n_words <= 20.0, true) and coalesce(n_symbols / n_words <= 0.3, true)
               and coalesce(n_stop / n_words >= 0.01, true) and coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) and coalesce(n_upper / n_words <= 0.5, true) as kept
        from f""",
    "op5_ngram_join": rf"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as g
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        o as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
        link as (select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
        reach(x, y) as (select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) as component_id
        from d left join n on d.doc_id = n.doc_id left join (select x, min(y) as y from reach group by x) r on r.x = d.doc_id""",
    "op7_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
        win as (select distinct item_id, least(len(w), 13) as k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g
                from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
        ks as (select distinct k from win),
        dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
        hit as (select dw.doc_id, dw.i, dw.k, win.item_id from dw join win on dw.k = win.k and dw.g = win.g),
        h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hit) group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join h on d.doc_id = h.doc_id left join it on d.doc_id = it.doc_id""",
}
