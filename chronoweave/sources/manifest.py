"""Manifests, connector pages, metadata and transcripts in; manifests, documents and text reports out."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a connector page that hold further pages; what ``files`` holds comes before anything else an object says (fixed values).
FILES, WRAPPERS = "files", ("text", "content", "result")
FILE = "id string, name string, mime string, bytes long, parent string"


def read_manifest(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Tab-separated id, name, bytes: blank lines, # comments and rows of under two fields are skipped, further fields ignored,
    a size that is no number is null; of equal stems the last line wins, in order of files by name and of lines. ``only`` keeps ids, names or stems in it, any case."""
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("ord"))
    parts = F.split("value", "\t")
    rows = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#") & (F.size(parts) >= 2)).select("ord", parts[0].alias("id"), parts[1].alias("name"), F.get(parts, F.lit(2)).try_cast("long").alias("bytes"))
    rows = rows.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
    if only:
        wanted = [x.lower() for x in only]
        rows = rows.where(F.lower("id").isin(wanted) | F.lower("name").isin(wanted) | F.lower("stem").isin(wanted))
    w = Window.partitionBy("stem").orderBy(F.desc("ord"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Put what ``write`` writes to the folder it is given in place of ``path``. It writes beside; only when it is done is the old folder renamed, the new one renamed to ``path``, and the old one deleted, so a failed job leaves the old folder as it was."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new)
    except BaseException:
        fs.delete(fs_path(new), True)
        raise
    had = fs.exists(fs_path(path))
    if had and not fs.rename(fs_path(path), fs_path(old)):
        raise OSError(f"cannot rename {path}")
    if not fs.rename(fs_path(new), fs_path(path)):
        if had:
            fs.rename(fs_path(old), fs_path(path))
        raise OSError(f"cannot rename {new}")
    if had:
        fs.delete(fs_path(old), True)


def write_manifest(files: DataFrame, path: str, parts: int = 1) -> None:
    """Lines that ``read_manifest`` reads back as they were, sorted by name and id over ``parts`` files, in place of what the folder held.

    A size may be null. An id or name that no line can hold is an error: null or empty, with a tab or line end, an id that begins as a comment does.
    """
    name, i = F.col("name"), F.col("id").cast("string")
    bad = name.isNull() | i.isNull() | (F.trim(i) == "") | (name == "") | F.concat(i, name).rlike("[\t\n\r]") | F.ltrim(i).startswith("#")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no manifest line can hold "), F.coalesce(i, F.lit("null")), F.lit(" "), F.coalesce(name, F.lit("null"))))).otherwise(F.concat_ws("\t", i, name, F.col("bytes").cast("string")))
    rows = files.select(F.col("name").alias("_n"), i.alias("_i"), checked.alias("value"))
    rows = rows.repartitionByRange(parts, "_n", "_i").sortWithinPartitions("_n", "_i").select("value")
    replaced(files.sparkSession, path, lambda new: rows.write.text(new))


def _files_of(page: str) -> list[dict]:
    """File objects of a connector page, in reading order: what ``files`` holds, else objects with an id and a title or name, wherever lists, wrappers or JSON inside text blocks hold them. Works off a list of what is still to be looked at, so any depth will do."""
    files, ahead = [], [page]
    while ahead:
        item = ahead.pop()
        if isinstance(item, str):
            with contextlib.suppress(ValueError):
                inner = json.loads(item)
                ahead += [inner] if isinstance(inner, dict | list) else []
        elif isinstance(item, list):
            ahead += item[::-1]
        elif isinstance(item, dict) and FILES in item:
            ahead.append(item[FILES])
        elif isinstance(item, dict) and "id" in item and (item.keys() & {"title", "name"}):
            files.append(item)
        elif isinstance(item, dict):
            ahead += [item[k] for k in WRAPPERS[::-1] if k in item]
    return files


def connector_files(pages: DataFrame, column: str = "value") -> DataFrame:
    """File rows of connector pages (one JSON text a row); the nesting has no bound, so pages are walked in Python by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (str(f["id"]), f.get("title") or f.get("name"), f.get("mimeType"), int(f["fileSize"]) if str(f.get("fileSize", "")).isdigit() else None, f.get("parentId"))
                for page in b[column]
                for f in _files_of(page)
            ]
            yield pd.DataFrame(rows, columns=["id", "name", "mime", "bytes", "parent"]).astype({"bytes": "Int64"})

    return pages.select(column).mapInPandas(run, FILE)


def read_documents(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents of a folder with a fixed schema, one a file, or one a line as ``write_documents`` writes them; damaged ones are left out."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)


def words(transcripts: DataFrame) -> DataFrame:
    """clip, ord, w, s, e, p from transcripts with segments of words."""
    flat = transcripts.select("clip", F.flatten(F.transform("segmente", lambda s: s["woerter"])).alias("_w"))
    return flat.select("clip", F.posexplode("_w").alias("ord", "x")).select("clip", "ord", "x.w", "x.s", "x.e", "x.p")


def tags(spark: SparkSession, path: str, value: str) -> DataFrame:
    """clip and tag fields of documents with one key per clip; keys that begin with _ are left out."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return docs.select(F.explode("m").alias("clip", "tag")).where(~F.col("clip").startswith("_")).select("clip", "tag.*")


def files_by_extension(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, name and bytes of files below a folder, each path once, in order of name and path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))
    return found.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])).dropDuplicates(["path"]).orderBy("name", "path")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table; a report shows ``limit`` rows at most and says how many there are if more."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    body = "".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n" for r in rows[:limit])
    return head + body + (f"\nMore than {limit} rows.\n" if len(rows) > limit else "")


def timeline(intervals: DataFrame, key: str, start: str, end: str, span: DataFrame, width: int = 60, share: float = 0.3) -> DataFrame:
    """key and a text of ``width`` marks: # where intervals cover over ``share`` of the column, else a dot. ``span`` is one row of low and high."""
    rows = intervals.join(F.broadcast(span)).withColumn("_step", (F.col("high") - F.col("low")) / width)
    first, last = (F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor((F.col(c) - F.col("low")) / F.col("_step")))) for c in (start, end))
    cells = rows.withColumn("_c", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    covered = F.least(F.col(end), F.col("low") + (F.col("_c") + 1) * F.col("_step")) - F.greatest(F.col(start), F.col("low") + F.col("_c") * F.col("_step"))
    marks = cells.groupBy(key, "_c", "_step").agg(F.sum(covered).alias("_x")).groupBy(key).agg(F.collect_set(F.when(F.col("_x") > share * F.col("_step"), F.col("_c"))).alias("_on"))
    return marks.select(key, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.when(F.array_contains("_on", c), "#").otherwise(".")), "").alias("marks"))


def overview(clips: DataFrame, keys: list[str], width: int = 40, share: float = 0.3) -> DataFrame:
    """keys, clip and ``marks``: a text time line of each project, ``width`` columns from its first start to its last end, with a last row (clip null) of how many clips run.

    ``clips``: keys, clip, start, duration, usable. A column is # where a clip covers over ``share`` of it, ? if its place isn't sure (not usable), else a dot; a clip without a place has dashes only. The
    last row has digits, 9 for more, and dots for none.
    """
    placed = F.col("start").isNotNull()
    span = clips.groupBy(*keys).agg(F.min("start").alias("_low"), F.max(F.col("start") + F.col("duration")).alias("_high"))
    span = span.withColumn("_step", F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6)) / width)
    rows = clips.select(*keys, "clip", "start", "duration", F.coalesce("usable", F.lit(False)).alias("usable")).join(span, keys)
    on = lambda c: F.least(F.col("_low") + (c + 1) * F.col("_step"), F.col("start") + F.col("duration")) - F.greatest(F.col("_low") + c * F.col("_step"), F.col("start")) > share * F.col("_step")
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    rows = rows.withColumn("_on", F.transform(columns, lambda c: F.coalesce(placed & on(c), F.lit(False))))
    sign = F.when(F.col("usable"), "#").otherwise("?")
    lines = rows.select(*keys, "clip", F.when(placed, F.array_join(F.transform("_on", lambda x: F.when(x, sign).otherwise(".")), "")).otherwise("-" * width).alias("marks"))
    # Columns are counted one by one, so that no project's clips come together.
    sums = rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("_on")[c].cast("int")) for c in range(width))).alias("_n"))
    total = F.array_join(F.transform("_n", lambda n: F.when(n > 0, F.least(n, F.lit(9)).cast("string")).otherwise(".")), "")
    return lines.unionByName(sums.select(*keys, F.lit(None).cast(dict(clips.dtypes)["clip"]).alias("clip"), total.alias("marks")))


def transcripts(spark: SparkSession, path: str, clips: DataFrame, schema: str) -> DataFrame:
    """clip, name and the fields of the transcript of each clip: the file named like it, else IMG_ and its name, else the only one whose name holds it; clips without one are left out."""
    from chronoweave.operators.matching import resolve_keys

    docs = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("name"), F.from_json("value", schema).alias("_t"))
    found = resolve_keys(clips.select(F.col("clip").cast("string").alias("clip")).distinct(), docs.select("name"), "clip", "name").where("candidates = 1")
    return found.select("clip", "name").join(docs, "name").select("clip", "name", "_t.*")


def packets(spark: SparkSession, path: str) -> DataFrame:
    """pts, bytes and key of a packet listing (pts,bytes,flags; K for a key frame); damaged rows are left out."""
    rows = spark.read.schema("pts double, bytes long, flags string").option("mode", "DROPMALFORMED").csv(path)
    return rows.where("pts is not null and bytes is not null").select("pts", "bytes", F.coalesce(F.col("flags").contains("K"), F.lit(False)).alias("key"))


def key_times(found: DataFrame) -> DataFrame:
    return found.where("key").select("pts")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("index int, mid string, display_name string").option("header", True).csv(path)


def settings(layers: list[dict]) -> dict:
    """Nested settings of the program in layers: a later layer overrides single fields, at any depth."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = settings([out.get(k) or {}, v]) if isinstance(v, dict) and isinstance(out.get(k, {}), dict) else v
    return out


def file_set(found: DataFrame, only: str = "") -> DataFrame:
    """path and name of a listing (path, device, inode), each file once whatever links lead to it, those whose name holds ``only``, longest stem first."""
    rows = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "device", "inode")
    one = rows.groupBy("device", "inode").agg(F.min_by(F.struct("path", "name"), "path").alias("f")).select("f.*")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return one.where(F.contains(F.lower(stem), F.lit(only.lower()))).orderBy(F.desc(F.length(stem)), "name", "path")


def write_documents(df: DataFrame, path: str) -> None:
    """JSON documents in place of what the folder held, which stays as it was if the job fails."""
    replaced(df.sparkSession, path, lambda new: df.write.json(new))


def sync_plan(own: DataFrame, copy: DataFrame, ignored: list[str], most_bytes: int) -> DataFrame:
    """path and action (copy or delete) that make a backup equal to a project: both are listings of path, bytes and hash; ignored paths (patterns) and larger files are left alone."""
    skip = F.lit(False)
    for pattern in ignored:
        skip = skip | F.col("path").rlike(pattern)
    kept = own.where(~skip & (F.col("bytes") <= most_bytes))
    new = kept.join(copy.select("path", "hash"), ["path", "hash"], "left_anti").select("path", F.lit("copy").alias("action"))
    return new.unionByName(copy.where(~skip).join(own.select("path"), "path", "left_anti").select("path", F.lit("delete").alias("action")))


def ranges_to_measure(need: DataFrame, have: DataFrame, key: str, start: str, end: str, slack: float = 0.05) -> DataFrame:
    """Ranges whose key isn't measured from start to end (within ``slack``): the union of what is needed and what is there, to be measured anew."""
    j = need.join(have.select(key, F.col(start).alias("_a"), F.col(end).alias("_z")), key, "left")
    covered = (F.col("_a") <= F.col(start) + slack) & (F.col("_z") >= F.col(end) - slack)
    return j.where(~F.coalesce(covered, F.lit(False))).select(key, F.least(start, "_a").alias(start), F.greatest(end, "_z").alias(end))


def subtitle_lines(words: DataFrame, group: str, order: str, word: str, start: str, end: str, style: str = "Default") -> DataFrame:
    """group and line: one dialogue line of a subtitle file per group of words, in capitals with SS for ß."""
    from chronoweave.functions.scalar import clock, join_words

    shown = F.upper(F.regexp_replace(word, "ß", "ss"))
    g = words.groupBy(group).agg(F.min(start).alias("_s"), F.max(end).alias("_e"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("w")))).alias("_w"))
    text = join_words(F.transform("_w", lambda x: x["w"]))
    return g.select(group, F.concat(F.lit("Dialogue: 0,"), clock(F.col("_s")), F.lit(","), clock(F.col("_e")), F.lit(f",{style},,0,0,0,,"), text).alias("line"))
