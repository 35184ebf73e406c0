"""Scalar functions as column expressions: time, text, levels, curves, bits and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation before which a joined text has no space.
CLOSING = ".,;:!?…"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def norm(word: Column) -> Column:
    """Lower case, letters, digits and underscores of any script only."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}_]", "")


def stem(word: Column, n: int = 5) -> Column:
    return F.substring(norm(word), 1, n)


def sentence_end(word: Column) -> Column:
    return word.rlike(r"[.!?…][\"')\]]*$")


def join_words(words: Column) -> Column:
    """Words with single spaces, none before closing punctuation."""
    return F.regexp_replace(F.array_join(words, " "), r" +([.,;:!?…])", "$1")


def clock(seconds: Column) -> Column:
    """h:mm:ss.cc of seconds, cut to hundredths."""
    c = F.floor(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.expr("0L") + F.floor(c / 360000).cast("long"), F.pmod(F.floor(c / 6000), F.lit(60)).cast("long"), F.pmod(F.floor(c / 100), F.lit(60)).cast("long"), F.pmod(c, F.lit(100)).cast("long"))


def ratio(text: Column) -> Column:
    """Value of 'a/b' or 'a'; null for nonsense or a zero below the line."""
    parts = F.split(text, "/")
    over, under = F.expr("1") * F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.when(under != 0, over / under)


def decibel(level: Column, floor: float = 1e-9) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(floor)))


def s_curve(x: Column) -> Column:
    """3x^2 - 2x^3 of x clipped to 0..1."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return u * u * (3 - 2 * u)


def parabola_peak(left: Column, mid: Column, right: Column) -> Column:
    """Offset in samples of the peak of the parabola through three neighbours; 0 where they are in line."""
    bend = left - 2 * mid + right
    return F.when(bend == 0, F.lit(0.0)).otherwise(0.5 * (left - right) / bend)


def agreement(a: Column, b: Column, bits: int = 64) -> Column:
    """Share of equal bits of two longs."""
    return (bits - F.bit_count(a.bitwiseXOR(b))) / bits


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def snap(t: Column, period: float, phase: float = 0.0) -> Column:
    """Signed distance to the nearest point of a regular grid, halves to the even point."""
    return t - phase - F.rint((t - phase) / period) * period


def file_kind(mime: Column, name: Column) -> Column:
    """folder, google (a document of the drive itself), video, photo, audio or other: for each kind in turn by MIME type or by ending. The endings are fixed values."""
    ext, mime = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(mime == "application/vnd.google-apps.folder", "folder").when(mime.startswith("application/vnd.google-apps."), "google")
        .when(mime.startswith("video/") | ext.isin("mov", "mp4", "m4v"), "video")
        .when(mime.startswith("image/") | ext.isin("heic", "heif", "jpg", "jpeg", "png"), "photo")
        .when(mime.startswith("audio/") | ext.isin("mp3", "wav", "m4a", "aac", "flac", "ogg"), "audio").otherwise("other")
    )
