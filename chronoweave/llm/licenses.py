"""Licence scan with built-in functions only: sparse TF-IDF cosine of header blocks and licence files to templates, then
inheritance from the nearest directory above by path joins.

The vocabulary is the templates' own. A term's weight is its inverse document frequency over all files, counted in one
pass. Notices are compared with every window of one to ``WINDOW`` adjacent lines, with every block of lines between
lines without words and with the whole text, whatever its length; comment marks are no terms. A candidate is scored if
few enough of its terms are of no template to let it reach the threshold, and if it holds a key term: the key terms are chosen so that none without one can reach the threshold (the rest of any
template's weight is too small), which is checked on the weights, not sampled. Licence texts are compared with the whole
text, by the same test. A notice counts only if it holds the numbers and the family words (lesser, affero, nc ...) of
its template and no family word of another, so one of a version that isn't known names no licence; full texts of old and
new versions are all templates. An SPDX tag names its licence itself. A file that is named as a licence file speaks for its directory.

Every file gets one row: its own licence (origin header or file), else that of the nearest directory above with a
licence file (inherited), else none. Paths are joined with the licensed directories through one row per directory
above, so a directory that holds a third of all files is resolved once, not once a file; files take over the result by a
broadcast of counted size, or dealt by path.

Defined results: null paths have no directory and inherit nothing; null and empty texts have no header; of equal scores the
licence first by name wins; two licence files of a directory: the higher score, then the name; repeated rows get a row each;
an empty table gives no row; kept columns may have any name.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Short notices by licence id: one, or several wordings.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_SHORT = "This {} is licensed under the GNU {} Public License, version {}."


def _gnu(what: str, kind: str, version: str) -> tuple[str, str]:
    return _SHORT.format(what, kind, version), _GNU.format(kind, version)


TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "MIT": "Released under the MIT License.",
    "GPL-1.0": _gnu("work", "General", "1"),
    "GPL-2.0": _gnu("work", "General", "2"),
    "GPL-3.0": _gnu("work", "General", "3"),
    "LGPL-2.0": _gnu("library", "Library General", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General", "3"),
    "AGPL-3.0": _gnu("program", "Affero General", "3"),
    "BSD-2-Clause": "Use of this source code is governed by a BSD-style two clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style three clause license.",
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License, version 1.1.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    **{f"CC-{kind}-4.0": f"Licensed under CC {kind} 4.0." for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words by which licences of one family differ. A notice must hold those of its template, and numbers too, and no other of these words but "library", which anything may call itself.
FAMILY = frozenset("affero lesser library documentation sa nc nd sharealike noncommercial noderivatives noderivs two three".split())
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)"
#: Added to the text of the GPL, these make the terms of the AGPL.
_AFFERO = """specifically designed to ensure cooperation with the community in the case of network server software. Remote Network Interaction; Use with the GNU General Public
License. if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports
such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through
some standard or customary means of facilitating copying of software."""
#: The clause that the BSD licence of two clauses lacks.
_THIRD = r"(?s)3\. Neither the name.*?permission\."
#: Licences of which only the full text is known.
FULL_ONLY = frozenset(("Artistic-1.0", "GFDL-1.2", "GFDL-1.3"))
#: Most lines of a wrapped notice.
WINDOW = 4
THRESHOLD = 0.8
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([._-][a-z0-9._-]*)?$"
GAP = r"[^0-9a-z\x80-\x{10FFFF}]+"


def texts() -> dict[str, str]:
    """Full licence texts by licence id, read on the driver."""
    found = {f.name.removesuffix(".txt"): f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return found | {"AGPL-3.0": f"{found['GPL-3.0']}\n{_AFFERO}", "BSD-2-Clause": re.sub(_THIRD, "", found["BSD-3-Clause"])}


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), GAP)), "")


def _words(text: str) -> list[str]:
    return sorted({w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", text.lower()) if w})


def _key_terms(words: list[tuple[str, list[str]]], idf: dict[str, float], threshold: float) -> set[str]:
    """Terms of which a bag must hold one to reach the threshold with any of these templates: without them it scores at most the norm of the other weights."""
    keys: set[str] = set()
    for _, ws in words:
        heavy = sorted(ws, key=lambda w: (-idf[w], w))
        norm = sum(idf[w] ** 2 for w in ws)
        rest = sum(idf[w] ** 2 for w in ws if w not in keys)
        for w in heavy:
            if rest < norm * (threshold * 0.999) ** 2:
                break
            if w not in keys:
                keys.add(w)
                rest -= idf[w] ** 2
    return keys


def _model(files: DataFrame, words: list[tuple[str, list[str]]]) -> dict[str, float]:
    """Inverse document frequency by term. Templates are a parameter of the program, so the vocabulary is small whatever the input."""
    vocabulary = sorted({w for _, ws in words for w in ws})
    spark = files.sparkSession
    table = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "w string"))
    counted = files.select(F.explode(terms(F.col("text"))).alias("w")).join(table, "w").groupBy("w").count()
    have = {r["w"]: r["count"] for r in counted.collect()}
    total = files.count()
    return {w: math.log((1 + total) / (1 + have.get(w, 0))) + 1 for w in vocabulary}


def _least_shared(ws: list[str], idf: dict[str, float], threshold: float) -> int:
    """How many of a template's terms a bag must hold: as many as the heaviest ones that reach the threshold."""
    heavy, norm, n = sorted((idf[w] ** 2 for w in ws), reverse=True), sum(idf[w] ** 2 for w in ws), 0
    while n < len(heavy) and sum(heavy[:n]) < norm * (threshold * 0.999) ** 2:
        n += 1
    return n


def _with(value: Column, then) -> Column:
    """``then(x)`` with x evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _first(scored: Column) -> Column:
    """The highest score, then the first name."""
    return F.element_at(F.array_sort(scored, lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)), 1)


def _table(of: dict[str, float]) -> Column:
    """A literal map; terms hold letters and digits only, so they need no quoting."""
    return F.expr("map(" + ", ".join(f"'{w}', {v!r}D" for w, v in of.items()) + ")")


def _list(words) -> Column:
    return F.expr("array(" + ", ".join(f"'{w}'" for w in words) + ")")


def _summed(bag: Column, of: dict[str, float]) -> Column:
    table = _table(of)
    return F.aggregate(bag, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(table, w), F.lit(0.0)))


def _told(bag: Column, ws: list[str]) -> Column:
    """Whether a bag holds the numbers and family words of a template, and no other family word that tells licences apart."""
    needed = [w for w in ws if w.isdigit() or w in FAMILY and w != "library" or w == "library" and "lesser" not in ws]
    strange = sorted(FAMILY - set(ws) - {"library"})
    holds = F.size(F.array_intersect(bag, _list(needed))) == len(needed) if needed else F.lit(True)
    return holds & ~F.arrays_overlap(bag, _list(strange))


def _cosine(bag: Column, words: list[tuple[str, list[str]]], idf: dict[str, float], threshold: float, told: bool = False) -> Column:
    """(score, id) of the best template of a bag of terms, null where none can reach the threshold; a term of no template weighs as much as the rarest of the vocabulary. With ``told`` a template of another version or family scores 0."""
    square = {w: v * v for w, v in idf.items()}
    other = max(square.values())
    norms = {k: math.sqrt(sum(square[w] for w in ws)) for k, (_, ws) in enumerate(words)}
    # A score is at most the template's norm over the bag's, and terms of no template alone may make that too large.
    most_unknown = int((max(norms.values()) / threshold) ** 2 * 1.001 / other)

    def score(known: Column, own: Column, k: int, ws: list[str]) -> Column:
        cosine = _summed(known, {w: square[w] / norms[k] for w in ws}) / own
        return F.when(_told(bag, ws), cosine).otherwise(0.0) if told else cosine

    def best(known: Column, own: Column) -> Column:
        return _first(F.array(*(F.struct(score(known, own, k, ws).alias("score"), F.lit(name).alias("id")) for k, (name, ws) in enumerate(words))))

    def of_known(known: Column) -> Column:
        unknown = F.size(bag) - F.size(known)
        return F.when((F.size(known) > 0) & (unknown <= most_unknown), _with(F.sqrt(_summed(known, square) + unknown * other), lambda own: best(known, own)))

    return _with(F.array_intersect(bag, _list(idf)), of_known)


def scan(files: DataFrame, templates: dict[str, str | tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, path, license_id, score (thousandths), origin (header, file, inherited or null) and source_dir of every file."""
    # Columns that pass through are fields of one column, so that their names can't clash.
    base = files.select(F.struct(F.lit(True).alias("_"), *keep).alias("kept"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    notices = [(name, _words(t)) for name, ts in sorted(templates.items()) for t in ((ts,) if isinstance(ts, str) else ts)]
    # Licence texts of ids that the caller's templates don't know are left out, but for the one that would be taken for another.
    full = [(name, _words(t)) for name, t in sorted(texts().items()) if name in templates or name in FULL_ONLY and templates is TEMPLATES]
    idf = _model(base, notices + full)
    keys, full_keys = _key_terms(notices, idf, threshold), _key_terms(full, idf, threshold)
    scores = "array<struct<score:double,id:string>>"
    none = F.array().cast(scores)

    def has_key(bag: Column, keys: set[str] = keys) -> Column:
        return F.arrays_overlap(bag, _list(sorted(keys)))

    def windows(lines: Column) -> Column:
        """Bags of one to WINDOW adjacent lines, from places with a key term that near."""
        hot = F.transform(lines, lambda x: has_key(x))
        starts = _with(hot, lambda h: F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.exists(F.slice(h, i, WINDOW), lambda x: x)))

        def of_size(at: Column, n: int) -> Column:
            return F.transform(at, lambda i: F.array_distinct(F.flatten(F.slice(lines, i, n))))

        return _with(starts, lambda at: F.concat(*(of_size(at, n) for n in range(1, WINDOW + 1))))

    blocks = F.transform(F.split("text", r"(?i)\n[^0-9a-z\x80-\x{10FFFF}\n]*(?=\n)"), terms)
    candidates = F.concat(_with(F.transform(F.split("text", "\n"), terms), windows), blocks, F.array(F.col("bag")))
    scored = F.transform(F.filter(F.array_distinct(candidates), lambda x: has_key(x)), lambda bag: _cosine(bag, notices, idf, threshold, told=True))
    found = F.when(has_key(F.col("bag")), F.filter(scored, lambda c: c["score"] >= threshold)).otherwise(none)
    tag = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(?i)(-only|-or-later|\+)$", "")
    tagged = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")) & (tag != ""), F.array(F.struct(F.lit(1.0).alias("score"), tag.alias("id"))))
    found = F.coalesce(tagged, found)
    if full:
        shared = F.size(F.array_intersect("bag", _list(sorted({w for _, ws in full for w in ws}))))
        least = min(_least_shared(ws, idf, threshold) for _, ws in full)
        near = F.when(has_key(F.col("bag"), full_keys) & (shared >= least), F.array(_cosine(F.col("bag"), full, idf, threshold))).otherwise(none)
        # A licence text holds notices, of other licences too; what the whole is says more.
        found = _with(F.filter(near, lambda c: c["score"] >= threshold), lambda n: F.when(F.size(n) > 0, n).otherwise(found))
    base = base.withColumn("bag", terms(F.col("text")))
    judged = base.select(
        "kept", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("is_file"),
        F.when(has_key(F.col("bag"), keys | full_keys | {"spdx"}), _with(found, lambda c: F.when(F.size(c) > 0, _first(c)))).alias("own"),
    )
    judged = store.written(judged.select("kept", "path", "dir", "is_file", F.col("own.id").alias("own_id"), F.col("own.score").alias("own_score")), "licences")
    out = _inherited(judged)
    origin = F.when(F.col("own_id").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("best").isNotNull(), "inherited")
    return out.select(
        *(F.col(f"kept.`{c}`").alias(c) for c in keep), "path", F.coalesce("own_id", "best.i").alias("license_id"), F.round(F.coalesce(F.col("own_score"), -F.col("best.s")) * 1000).cast("long").alias("score"), origin.alias("origin"),
        F.when(F.col("own_id").isNotNull(), F.col("dir")).otherwise(F.col("above")).alias("source_dir"),
    )


#: Directories (some 200 bytes each) that may be broadcast, and the parts into which files of a directory are dealt beyond it.
BROADCAST_DIRS, SALTS = 100_000, 32


def _inherited(judged: DataFrame) -> DataFrame:
    """Each file with ``above`` and ``best``, the nearest directory at or above its own that holds a licence file, and that licence."""
    speaks = judged.where("is_file and own_id is not null and dir is not null")
    spoken = speaks.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_id").alias("i"))).alias("best"))
    dirs = judged.where("dir is not null").select("dir").distinct()
    ups = dirs.select("dir", F.explode(F.expr("transform(sequence(0, if(dir = '', 0, size(split(dir, '/')))), k -> array_join(slice(split(dir, '/'), 1, k), '/'))")).alias("above"))
    nearest = ups.join(spoken, "above").groupBy("dir").agg(F.max_by(F.struct("above", "best"), F.length("above")).alias("up")).select("dir", "up.above", "up.best")
    nearest = store.written(nearest, "licensed-dirs")
    if nearest.count() <= BROADCAST_DIRS:
        return judged.join(F.broadcast(nearest), "dir", "left")
    # A directory may hold a third of all files, so its files are dealt by path.
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    return salted.join(nearest.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["dir", "salt"], "left")
