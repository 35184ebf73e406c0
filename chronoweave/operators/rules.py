"""Declarative rules: each gives finding rows and none stops the others.

A rule is a name, a status and a DataFrame with ``subject`` and ``detail``; findings are their union, and the summary
counts them by status.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ERROR", "WARNING", "INFO")


@dataclass(frozen=True)
class Rule:
    name: str
    status: str
    rows: DataFrame

    def findings(self) -> DataFrame:
        return self.rows.select(F.lit(self.name).alias("rule"), F.lit(self.status).alias("status"), F.col("subject").cast("string").alias("subject"), F.col("detail").cast("string").alias("detail"))


def where(name: str, status: str, df: DataFrame, broken: Column, subject: Column, detail: Column) -> Rule:
    return Rule(name, status, df.where(F.coalesce(broken, F.lit(False))).select(subject.alias("subject"), detail.alias("detail")))


def having(name: str, status: str, df: DataFrame, keys: list[str], measure: Column, broken: Column) -> Rule:
    """Groups whose measure (column ``measure``) breaks the rule."""
    g = df.groupBy(*keys).agg(measure.alias("measure")).where(broken)
    return Rule(name, status, g.select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("subject"), F.col("measure").alias("detail")))


def neighbours(name: str, status: str, df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str], broken: Column, subject: Column, detail: Column) -> Rule:
    """A predicate over a row and the one before: ``previous`` maps new names to columns of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return where(name, status, df.withColumns({n: F.lag(c).over(w) for n, c in previous.items()}), broken, subject, detail)


def findings(rules: list[Rule]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.findings() for r in rules])


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "status").agg(F.count("*").alias("n"))


#: Endings of videos and photos (fixed values).
VIDEO_ENDINGS, PHOTO_ENDINGS = ("mov", "mp4", "m4v"), ("heic", "heif", "jpg", "jpeg", "png")


def manifest_rules(files: DataFrame) -> list[Rule]:
    """Rules over manifest rows (ord, id, name, stem, bytes as text): double ids and stems, sizes that are no number or nothing, unknown endings, photos."""
    size = F.col("bytes").try_cast("long")
    ending = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    return [
        where("unknown_ending", "WARNING", files, ~ending.isin(*VIDEO_ENDINGS, *PHOTO_ENDINGS), F.col("id"), ending),
        where("photo", "INFO", files, ending.isin(*PHOTO_ENDINGS), F.col("id"), ending),
        having("double_id", "ERROR", files, ["id"], F.count("*"), F.col("measure") > 1),
        having("double_stem", "ERROR", files, ["stem"], F.count("*"), F.col("measure") > 1),
        where("size_no_number", "ERROR", files, size.isNull(), F.col("id"), F.col("bytes")),
        where("size_nothing", "WARNING", files, size <= 0, F.col("id"), F.col("bytes")),
    ]


def unlike_variants(variants: DataFrame, keys: list[str], id_col: str, hook: str, period: str, beats: str, clips: str, per_shot: str, effects: str, least: int = 2) -> Rule:
    """Pairs of variants of one piece (keys) that differ in fewer than ``least`` of three aspects: song (start over four periods apart, or length), clips (less than half shared), pace (half a beat a shot, or three tenths of the effects).

    Variants of a piece are few; pairs are made within a piece.
    """
    own = [id_col, hook, period, beats, clips, per_shot, effects]
    a, b = (variants.select(*keys, *(F.col(c).alias(f"{x}_{k}") for k, c in enumerate(own))) for x in ("a", "b"))
    p = a.join(b, keys).where("a_0 < b_0")
    song = (F.abs(F.col("a_1") - F.col("b_1")) > 4 * F.col("a_2")) | (F.col("a_3") != F.col("b_3"))
    shared = F.size(F.array_intersect("a_4", "b_4")) / F.greatest(F.lit(1), F.size(F.array_union("a_4", "b_4")))
    pace = (F.abs(F.col("a_5") - F.col("b_5")) >= 0.5) | (F.abs(F.col("a_6") - F.col("b_6")) >= 0.3 * F.greatest("a_6", "b_6", F.lit(1)))
    n = song.cast("int") + (shared < 0.5).cast("int") + pace.cast("int")
    p = p.withColumn("n", n).where(F.col("n") < least)
    return Rule("variants_alike", "WARNING", p.select(F.concat_ws("/", *(F.col(c).cast("string") for c in (*keys, "a_0", "b_0"))).alias("subject"), F.col("n").alias("detail")))


def delivery_rules(probes: DataFrame, packets: DataFrame, width: int = 1080, height: int = 1920, rate: int = 30, megabits: tuple[float, float] = (8.0, 25.0), longest: float = 180.0) -> list[Rule]:
    """Rules over probes of files (file, w, h, fps, pixel_format, codec, duration, bits, audio_duration, loudness, peak) and their packets (file, pts, key): size, frame rate and its evenness, pixel format, bit rate, key frames, length, sound against picture, loudness, peak."""
    w = Window.partitionBy("file").orderBy("pts")
    step = F.col("pts") - F.lag("pts").over(w)
    uneven = packets.withColumn("_d", step).where(F.abs(F.col("_d") - 1 / rate) > 0.25 / rate).groupBy("file").agg(F.count("*").alias("n"))
    keys = packets.where("key").withColumn("_d", step).groupBy("file").agg(F.max("_d").alias("gap")).where(F.col("gap") > 1.5 * 2)
    file, away = F.col("file"), F.abs(F.col("audio_duration") - F.col("duration"))
    off_size = (F.col("w") != width) | (F.col("h") != height)
    return [
        where("size_other", "WARNING", probes, off_size & (F.col("w") * 16 == F.col("h") * 9), file, F.concat_ws("x", F.col("w"), F.col("h"))),
        where("size_wrong", "ERROR", probes, off_size & (F.col("w") * 16 != F.col("h") * 9), file, F.concat_ws("x", F.col("w"), F.col("h"))),
        where("rate_wrong", "ERROR", probes, F.abs(F.col("fps") - rate) >= 0.01, file, F.round("fps").cast("long")),
        Rule("rate_uneven", "ERROR", uneven.select(F.col("file").alias("subject"), F.col("n").alias("detail"))),
        where("pixel_format", "ERROR", probes, F.col("pixel_format") != "yuv420p", file, F.col("pixel_format")),
        where("codec", "WARNING", probes, F.col("codec") != "h264", file, F.col("codec")),
        where("bit_rate", "WARNING", probes, ~(F.col("bits") / F.col("duration") / 1e6).between(*megabits), file, F.col("bits")),
        Rule("key_frames", "INFO", keys.select(F.col("file").alias("subject"), F.round(F.col("gap") * 1000).cast("long").alias("detail"))),
        where("too_long", "ERROR", probes, F.col("duration") > longest, file, F.round(F.col("duration") * 1000).cast("long")),
        where("no_sound", "INFO", probes, F.col("audio_duration").isNull(), file, F.lit(None)),
        where("sound_off", "WARNING", probes, (away > 1.2 / rate) & (away <= 0.1), file, F.round(away * 1000).cast("long")),
        where("sound_wrong", "ERROR", probes, away > 0.1, file, F.round(away * 1000).cast("long")),
        where("loudness", "WARNING", probes, F.abs(F.col("loudness") + 14) > 0.7, file, F.round(F.col("loudness") * 10).cast("long")),
        where("peak", "WARNING", probes, (F.col("peak") > -0.8) & (F.col("peak") <= 0), file, F.round(F.col("peak") * 100).cast("long")),
        where("peak_over", "ERROR", probes, F.col("peak") > 0, file, F.round(F.col("peak") * 100).cast("long")),
    ]


def folder_rules(files: DataFrame) -> list[Rule]:
    """Rules over a listing (path below the project, bytes): cache folders, large wave files, single frames, working files, folder names, several versions of a piece."""
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    reel = F.regexp_extract("path", r"^reels/([^/]+)/", 1)
    megabytes = F.col("bytes") / (1 << 20)
    tops = files.where(path.rlike(r"^reels/[^/]+/[^/]*_mit_song\.mp4$") & ~path.rlike("(?i)_yt_")).groupBy(reel.alias("reel")).agg(F.count("*").alias("n")).where("n > 1")
    named = files.where((reel != "") & (reel != "_vorlage")).select(reel.alias("reel")).distinct()
    return [
        where("cache_folder", "WARNING", files, path.rlike("(^|/)__pycache__/"), path, F.lit(None)),
        where("large_wave", "WARNING", files, F.lower(name).endswith(".wav") & (megabytes > 20) & ~path.rlike("(^|/)(sfx|uploads)/"), path, F.floor(megabytes)),
        where("single_frame", "WARNING", files, name.rlike(r"^(raw|f|k|g)_[0-9]{3,5}\.(png|jpg)$") & ~path.rlike("(^|/)uploads/"), path, F.lit(None)),
        where("folder_name", "WARNING", named, ~F.col("reel").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}_[a-z0-9äöüß_-]+$"), F.col("reel"), F.lit(None)),
        Rule("versions", "WARNING", tops.select(F.col("reel").alias("subject"), F.col("n").alias("detail"))),
    ]


def overlay_rules(overlays: DataFrame) -> list[Rule]:
    """Rules over overlays (part, clip, camera, at, length, part_length): outside the part, beyond its end, too early over the speaker, of odd length."""
    part, at, length, whole = F.col("part"), F.col("at"), F.col("length"), F.col("part_length")
    return [
        where("outside", "ERROR", overlays, (at < 0) | (at >= whole), part, F.round(at * 1000).cast("long")),
        where("beyond_end", "WARNING", overlays, (at >= 0) & (at < whole) & (at + length > whole + 0.02), part, F.round((at + length - whole) * 1000).cast("long")),
        where("too_early", "WARNING", overlays, (at >= 0) & (at < 0.4) & F.col("camera").isNull(), part, F.round(at * 1000).cast("long")),
        where("odd_length", "WARNING", overlays, (length < 0.6) | (length > 6), part, F.round(length * 1000).cast("long")),
    ]
