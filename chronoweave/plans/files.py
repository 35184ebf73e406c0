"""Registered queries that write files of the given tables and read them back, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoweave.sources import manifest, tables
from chronoweave.plans.catalog import _read, query


def _folder(spark, name):
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""with f as (select o_orderkey::varchar as id, ' 7" clip, ' || (o_orderkey % 4000) || case when o_orderkey % 3 = 0 then '.mov' when o_orderkey % 3 = 1 then '.mp4' else '' end as name, case when o_orderkey % 5 > 0 then o_custkey end as bytes from orders)
    select id, name, bytes, regexp_replace(name, '[.][^.]*$', '') as stem from f qualify row_number() over (partition by regexp_replace(name, '[.][^.]*$', '') order by name desc, id desc) = 1""")
def manifest_rows(spark, sf):
    """Orders as a manifest of files, written and read back; of equal stems the last line wins."""
    k, path = F.col("o_orderkey"), _folder(spark, "manifest")
    ending = F.when(k % 3 == 0, ".mov").when(k % 3 == 1, ".mp4").otherwise("")
    files = _read(spark, sf, "orders").select(k.cast("string").alias("id"), F.concat(F.lit(' 7" clip, '), (k % 4000).cast("string"), ending).alias("name"), F.when(k % 5 > 0, F.col("o_custkey")).alias("bytes"))
    manifest.write_manifest(files, path, parts=8)
    return manifest.read_manifest(spark, path).select("id", "name", "bytes", "stem")


@query("""select c_custkey::varchar as id, 'clip ' || c_custkey || '.mov' as name, 'video/mp4' as mime, c_nationkey as bytes, c_nationkey::varchar as parent from customer where c_custkey % 4 < 3
    union all select c_custkey::varchar, 'other ' || c_custkey, null, null, null from customer where c_custkey % 4 = 3""")
def connector_rows(spark, sf):
    """S3, F-json: customers as pages of a connector, one list a nation and some of it inside text, written and read back."""
    c = _read(spark, sf, "customer").select("c_nationkey", "c_custkey")
    k = F.col("c_custkey").cast("string")
    one = F.struct(k.alias("id"), F.concat(F.lit("clip "), k, F.lit(".mov")).alias("title"), F.lit("video/mp4").alias("mimeType"), F.col("c_nationkey").cast("string").alias("fileSize"), F.col("c_nationkey").cast("string").alias("parentId"))
    whole = c.where("c_custkey % 4 < 3").groupBy("c_nationkey", F.expr("c_custkey div 256").alias("p")).agg(F.to_json(F.struct(F.lit("page").alias("id"), F.lit("a page").alias("name"), F.collect_list(one).alias("files"))).alias("value"))
    text = F.to_json(F.struct(F.struct(k.alias("id"), F.concat(F.lit("other "), k).alias("name"), F.lit("?").alias("fileSize")).alias("result")))
    nested = c.where("c_custkey % 4 = 3").select(F.to_json(F.struct(F.array(F.struct(text.alias("text"))).alias("content"))).alias("value"))
    path = _folder(spark, "pages")
    whole.select("value").unionByName(nested).write.text(path)
    return manifest.connector_files(spark.read.text(path))


@query("""select conv_id::varchar as clip, (row_number() over (partition by conv_id order by turn, i) - 1)::bigint as ord, w from (select conv_id, turn, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select conv_id, turn, string_split(text, ' ') as ws from conversations))""")
def transcript_words(spark, sf):
    """Conversations as transcripts, written as JSON documents and read back word by word."""
    turns = _read(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.struct(w.alias("w"), F.lit(0.0).alias("s"), F.lit(1.0).alias("e"), F.lit(1.0).alias("p"))).alias("woerter"))
    docs = turns.groupBy(F.col("conv_id").cast("string").alias("clip")).agg(F.array_sort(F.collect_list(F.struct("turn", "woerter"))).alias("segmente"))
    path = _folder(spark, "transcripts")
    manifest.write_documents(docs, path)
    schema = "clip string, segmente array<struct<turn:bigint,woerter:array<struct<w:string,s:double,e:double,p:double>>>>"
    return manifest.words(manifest.read_documents(spark, path, schema, lines=True)).select("clip", F.col("ord").cast("long").alias("ord"), "w")
