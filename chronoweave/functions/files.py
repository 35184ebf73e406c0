"""Column functions about files and words: heads, error pages, kinds, and times of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What files of an ending begin with: endings, and (place, bytes as patterns of hexadecimal digits) that must all be there; fixed values of the formats.
HEADS = (
    ((".mov", ".mp4", ".m4v", ".heic", ".heif", ".m4a"), ((4, "66747970|6D6F6F76|6D646174|77696465|66726565|736B6970|706E6F74"),)),
    ((".jpg", ".jpeg"), ((0, "FFD8FF"),)),
    ((".png",), ((0, "89504E47"),)),
    ((".mp3",), ((0, "494433|FF[EF]"),)),
    ((".wav",), ((0, "52494646"), (8, "57415645"))),
    ((".flac",), ((0, "664C6143"),)),
    ((".ogg",), ((0, "4F676753"),)),
)


def head_fits(head: Column, ending: Column) -> Column:
    """Whether the first bytes of a file are what its ending (with the dot) says, by ``HEADS``; unknown endings fit."""
    found, digits = F, F.hex(head)
    for endings, parts in HEADS:
        pattern = "".join(f"(?=.{{{2 * place}}}({marks}))" for place, marks in parts)
        found = found.when(F.lower(ending).isin(*endings), digits.rlike(f"^{pattern}"))
    return found.otherwise(F.lit(True))


#: What a page instead of a file says, by words in it, in order (fixed values).
PAGE_REASONS = (
    ("quota", ("quota", "too many users", "zu viele nutzer")),
    ("not_shared", ("accounts.google.com", "sign in", "anmelden")),
    ("unknown_id", ("not found", "nicht gefunden", "error 404")),
    ("server_error", ("error 500", "server error")),
)


def page_reason(text: Column) -> Column:
    """Why a page came instead of the file: the first reason of which the page holds a word, else "page"."""
    low = F.lower(text)
    out = F
    for reason, marks in PAGE_REASONS:
        hit = low.contains(marks[0])
        for m in marks[1:]:
            hit = hit | low.contains(m)
        out = out.when(hit, reason)
    return out.otherwise("page")


def is_page(text: Column) -> Column:
    """Whether the beginning of a text, after any white space, is that of a page."""
    return F.lower(F.substring(text, 1, 2048)).rlike(r"^\s*(<!doctype|<html|<[?]xml|<head|<body)")


def capped_end(s: Column, e: Column, word: Column) -> Column:
    """End of a word, at most 0.45 s or 0.11 s a letter after its start, whichever is more (fixed values)."""
    return F.least(e, s + F.greatest(F.lit(0.45), 0.11 * F.length(F.regexp_replace(word, r"[^\p{L}\p{N}_'-]", ""))))


def respread(words: DataFrame, keys: list[str], order: str, word: str, start: str, end: str, pause: float = 0.02) -> DataFrame:
    """Words of a new text with times that divide [start, end) of their key by their lengths (one more each, for the gap); each ends ``pause`` before the next: keys, order, word, s, e."""
    w = Window.partitionBy(*keys).orderBy(order)
    size, length = F.length(word) + 1, F.col(end) - F.col(start)
    total = F.sum(size).over(Window.partitionBy(*keys))
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return words.select(*keys, order, word, (F.col(start) + length * (upto - size) / total).alias("s"), (F.col(start) + length * upto / total - pause).alias("e"))
