"""Files in and out: manifests, connector pages, transcripts, tags, packets, class maps, settings and reports."""

import json

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import files
from chronoweave.operators import sets
from chronoweave.sources import manifest


def test_manifest_round_trip(spark, tmp_path):
    lines = ["# note", "", "i1\ta.mov\t10", "i2\tb.mov\tx\textra", "i3\ta.mp4\t30", "i4", "  "]
    (tmp_path / "m.tsv").write_text("\n".join(lines))
    got = {r.id: (r.name, r.bytes) for r in manifest.read_manifest(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {"i2": ("b.mov", None), "i3": ("a.mp4", 30)}
    assert [r.id for r in manifest.read_manifest(spark, str(tmp_path / "m.tsv"), ["B.MOV"]).collect()] == ["i2"]
    manifest.write_manifest(spark.createDataFrame([("x", "b", 2), ("y", "a", 1)], "id string, name string, bytes long"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines() == ["y\ta\t1", "x\tb\t2"]


def test_manifest_is_exact(spark, tmp_path):
    """Quotes, spaces and backslashes come back as they were, over any number of files; of equal stems the last by name wins."""
    rows = [("1", '7" clip.mp4', 5), ("2", " lead.mp4", None), ("3", "tail .mov", 7), ("4", "a\\b,c;'d'.mov", 8), (" 5 ", "é~.mp4", 9), ("6", "x.mov", 1), ("7", "x.mp4", 2), ("8", "no ending", 3)]
    df = spark.createDataFrame(rows, "id string, name string, bytes long")
    for parts in (1, 3):
        manifest.write_manifest(df, str(tmp_path / "m"), parts)
        got = {(r.id, r.name, r.bytes) for r in manifest.read_manifest(spark, str(tmp_path / "m")).collect()}
        assert got == set(rows) - {("6", "x.mov", 1)}
    for bad in ((None, "a", 1), ("1", None, 1), ("1", "a\tb", 1), ("1", "a\nb", 1), ("# 1", "a", 1), ("", "a", 1)):
        with pytest.raises(Exception, match="no manifest line"):
            manifest.write_manifest(spark.createDataFrame([bad], "id string, name string, bytes long"), str(tmp_path / "m"))
    assert manifest.read_manifest(spark, str(tmp_path / "m")).count() == 7  # a failed job leaves what was there
    assert [p.name for p in tmp_path.iterdir()] == ["m"]


def test_files_before_all_else(spark):
    pages = [{"id": "p", "name": "page", "files": [{"id": "1", "name": "a"}, {"id": "2", "title": "b", "files": []}]}, {"content": [{"id": "4", "name": "d"}], "text": json.dumps([{"id": "3", "name": "c"}])}]
    got = [(r.id, r.name) for r in manifest.connector_files(spark.createDataFrame([(json.dumps(p),) for p in pages], "value string").coalesce(1)).collect()]
    assert got == [("1", "a"), ("3", "c"), ("4", "d")]


def test_pages_after_white_space(spark):
    texts = ["<!DOCTYPE html>", "\n\n<!doctype html>", "\t<head>", " \r\n<?xml", "\x0b\x0c<BODY", "x<html", "", "<p>", " " * 3000 + "<html>"]
    got = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(files.is_page(F.col("t")).alias("p")).collect()]
    assert got == [True, True, True, True, True, False, False, False, False]


def test_connector_pages(spark):
    one = {"files": [{"id": 1, "title": "a.mov", "mimeType": "video/quicktime", "fileSize": "12"}, [{"id": "2", "name": "b", "fileSize": "?"}]]}
    two = [{"content": [{"text": json.dumps({"result": {"files": [{"id": "3", "title": "c"}]}})}, {"text": "no json"}]}, 5, None, "12"]
    deep = {"id": "9", "name": "deep"}
    for _ in range(2000):
        deep = [deep]
    pages = spark.createDataFrame([(json.dumps(one),), (json.dumps(two),), ("{",), (None,), ("[" * 900 + json.dumps({"id": "9", "name": "deep"}) + "]" * 900,)], "value string")
    got = sorted((r.id, r.name, r.bytes) for r in manifest.connector_files(pages).collect())
    assert got == [("1", "a.mov", 12), ("2", "b", None), ("3", "c", None), ("9", "deep", None)]


def test_union_of_manifests(spark):
    rows = [(1, "aaaaaaaa", "s", 10), (2, "bbbbbbbb", "s", 10), (3, "cccccccc", "s", 11), (4, "aaaaaaaa", "t", 1), (5, "dddddddd", "u", 0), (6, "eeeeeeee", "u", 0), (7, "ffffffff", "v", None), (8, "gggggggg", "v", None)]
    got = {r.id[0]: r.name for r in sets.manifest_union(spark.createDataFrame(rows, "ord int, id string, stem string, bytes long")).collect()}
    assert got == {"a": "s", "c": "s~cccccc", "d": "u", "e": "u~eeeeee", "f": "v", "g": "v~gggggg"}


def test_documents_words_tags_and_settings(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "IMG_7.json").write_text(json.dumps({"clip": "7", "segmente": [{"woerter": [{"w": "a", "s": 0.0, "e": 1.0, "p": 1.0}]}, {"woerter": [{"w": "b", "s": 1.0, "e": 2.0, "p": 1.0}]}]}))
    schema = "clip string, segmente array<struct<woerter:array<struct<w:string,s:double,e:double,p:double>>>>"
    t = manifest.read_documents(spark, str(tmp_path / "t"), schema)
    assert [(r.clip, r.ord, r.w) for r in manifest.words(t).orderBy("ord").collect()] == [("7", 0, "a"), ("7", 1, "b")]
    got = manifest.transcripts(spark, str(tmp_path / "t"), spark.createDataFrame([("7",), ("8",)], "clip string"), "segmente " + schema.split("segmente ")[1]).collect()
    assert [(r.clip, r.name, len(r.segmente)) for r in got] == [("7", "IMG_7", 2)]
    (tmp_path / "tags.json").write_text(json.dumps({"7": {"tags": ["x"]}, "_note": {"tags": []}}))
    assert [(r.clip, r.tags) for r in manifest.tags(spark, str(tmp_path / "tags.json"), "struct<tags:array<string>>").collect()] == [("7", ["x"])]
    assert manifest.settings([{"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5}}]) == {"a": {"b": 1, "c": 5}, "d": 3}


def test_packets_and_class_map(spark, tmp_path):
    (tmp_path / "p.csv").write_text("0.0,100,K\n0.5,20,_\nbad,row\n1.0,x,K\n1.5,120,K\n")
    p = manifest.packets(spark, str(tmp_path / "p.csv"))
    assert sorted((r.pts, r.bytes, r.key) for r in p.collect()) == [(0.0, 100, True), (0.5, 20, False), (1.5, 120, True)]
    assert [r.pts for r in manifest.key_times(p).orderBy("pts").collect()] == [0.0, 1.5]
    (tmp_path / "c.csv").write_text("index,mid,display_name\n0,/m/1,Speech\n1,/m/2,Music\n")
    assert {r["index"]: r.display_name for r in manifest.class_map(spark, str(tmp_path / "c.csv")).collect()} == {0: "Speech", 1: "Music"}


def test_file_sets_and_sinks(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    for name, text in (("a.mov", "1"), ("sub_a.mov", "22"), ("b.txt", "3")):
        (d / name).write_text(text)
    (d / "link.mov").hardlink_to(d / "a.mov")
    assert [r.name for r in manifest.files_by_extension(spark, str(d), [".mov"]).collect()] == ["a.mov", "link.mov", "sub_a.mov"]
    assert [r.name for r in manifest.file_set(spark.createDataFrame([("p/a.mov", 1, 5), ("q/a.mov", 1, 5), ("p/sub_a.mov", 1, 6), ("p/c.mov", 1, 7)], "path string, device long, inode long"), "a").collect()] == ["sub_a.mov", "a.mov"]
    out = str(tmp_path / "out")
    manifest.write_documents(spark.createDataFrame([(1, "x")], "a int, b string"), out)
    manifest.write_documents(spark.createDataFrame([(2, "y")], "a int, b string"), out)
    assert [tuple(r) for r in spark.read.schema("a int, b string").json(out).collect()] == [(2, "y")]
    assert manifest.markdown(spark.createDataFrame([("a|b", 1)], "x string, y int")) == "| x | y |\n| --- | --- |\n| a\\|b | 1 |\n"


def test_sync_plan_and_cached_ranges(spark):
    own = spark.createDataFrame([("a", 10, "1"), ("b", 5, "2"), ("big", 10**9, "3"), ("x/.git/c", 1, "4")], "path string, bytes long, hash string")
    copy = spark.createDataFrame([("a", 10, "1"), ("b", 5, "old"), ("gone", 1, "5")], "path string, bytes long, hash string")
    plan = {(r.path, r.action) for r in manifest.sync_plan(own, copy, [r"(^|/)\.git/"], 1 << 20).collect()}
    assert plan == {("b", "copy"), ("gone", "delete")}
    need = spark.createDataFrame([("c", 1.0, 4.0), ("d", 0.0, 9.0)], "clip string, start double, end double")
    have = spark.createDataFrame([("c", 0.98, 4.02), ("d", 2.0, 5.0)], "clip string, start double, end double")
    got = {r.clip: (r.start, r.end) for r in manifest.ranges_to_measure(need, have, "clip", "start", "end").collect()}
    assert got == {"d": (0.0, 9.0)}


def test_heads_of_files(spark):
    rows = [(b"\0\0\0\x18ftypmp42", ".MOV"), (b"\0\0\0\x18abcdmp42", ".mov"), (b"\xff\xd8\xff\xe0", ".jpg"), (b"\x89PNG\r\n", ".png"), (b"ID3\x04", ".mp3"), (b"\xff\xfb", ".mp3"), (b"\xff\x0b", ".mp3"), (b"RIFF0000WAVE", ".wav"), (b"fLaC", ".flac"), (b"OggX", ".ogg"), (b"?", ".bin")]
    got = [r.ok for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, head binary, ext string").orderBy("i").select(files.head_fits(F.col("head"), F.col("ext")).alias("ok")).collect()]
    assert got == [True, False, True, True, True, True, False, True, True, False, True]


def test_subtitles(spark):
    words = spark.createDataFrame([(1, 0, "Größe", 0.0, 1.0), (1, 1, "zählt", 1.0, 61.5)], "grp long, i int, w string, s double, e double")
    lines = [r.line for r in manifest.subtitle_lines(words, "grp", "i", "w", "s", "e").collect()]
    assert lines == ["Dialogue: 0,0:00:00.00,0:01:01.50,Default,,0,0,0,,GRÖSSE ZÄHLT"]
