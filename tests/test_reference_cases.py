"""Literal cases of what the operators must give, and whole scripts there and back."""

import pytest
from pyspark.sql import functions as F

from lineweave.functions import tags as N
from lineweave.functions import times as T
from lineweave.operators import editing as E
from lineweave.operators import evidence as V
from lineweave.operators import lines as L
from lineweave.operators import matching as M
from lineweave.operators import timing as G
from lineweave.plans import queries as plans
from lineweave.sources import scripts


def lines(spark, rows):
    return spark.createDataFrame([(1, i, i, False, 0, s, e, "Default", "", "", t) for i, (s, e, t) in enumerate(rows)], "file_id int, id bigint, row_no int, comment boolean, layer int, start_ms int, end_ms int, style string, actor string, effect string, text string")


def present(spark, coverage, boxes=None, enter=0.5, leave=0.3):
    rows = [(1, k, c, None if boxes is None else boxes[k]) for k, c in enumerate(coverage)]
    df = spark.createDataFrame(rows, "scan_id int, frame int, coverage double, ocr_box boolean")
    return [r.present for r in V.presence(df, enter, leave).orderBy("frame").collect()]


def test_presence(spark):
    assert present(spark, [0.0, 0.10, 0.55, 0.35, 0.32, 0.60, 0.28, 0.05]) == [False, False, True, True, True, True, False, False]
    assert present(spark, [0.6, 0.6, 0.6], [True, False, True]) == [True, False, True]
    assert present(spark, [0.6, -1.0, 0.4, 0.4], [True, False, False, True]) == [True, True, False, False]


@pytest.mark.parametrize("num,den", [(1, 1), (24000, 1001), (25, 1), (30000, 1001), (60000, 1001), (120, 1)])
def test_frames_and_back(spark, num, den):
    frames = spark.range(-100, 7000).select(F.col("id").alias("f"))
    for mode in ("exact", "start", "end"):
        assert frames.where(T.frame_at(T.time_at("f", num, den, mode), num, den, mode) != F.col("f")).count() == 0
    if num == 1:
        ends = [r.t for r in spark.range(-1, 3).select(T.time_at("id", 1, 1).alias("t")).collect()]
        assert ends == [-1000, 0, 1000, 2000]
        got = spark.createDataFrame([(-999,), (-1,), (0,), (999,), (1000,)], "ms int").select(T.frame_at("ms", 1, 1).alias("f")).collect()
        assert [r.f for r in got] == [-1, -1, 0, 0, 1]


def test_smpte_there_and_back(spark):
    d = spark.range(0, 200_000, 7)
    assert d.where(T.frame_of_smpte(T.smpte("id", 30, True), 30, True) != F.col("id")).count() == 0
    one = spark.range(1).select(T.frame_of_smpte(F.lit("00:01:00;00"), 30, True).alias("a"), T.frame_of_smpte(F.lit("x"), 30).alias("b")).first()
    assert tuple(one) == (1800, 0)


def test_smpte_of_frames_beyond_an_int(spark):
    d = spark.range(2**31 - 40_000, 2**31 + 40_000, 7)
    for rate, drop in ((30, True), (60, True), (25, False)):
        back = T.frame_of_smpte(T.smpte("id", rate, drop), rate, drop)
        assert d.where(back.isNull() | (back != F.col("id"))).count() == 0


def test_smpte_back_of_many_files(spark, tmp_path):
    spark.sql("SELECT 59999L AS conv_id, 7L AS turn, 'user' AS role, 'x' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in plans.QUERIES["smpte_back"](spark, str(tmp_path)).collect()] == [(59_999_007, 59_999_007 * 37)]


def test_recombine(spark):
    def run(*rows):
        return [(r.start_ms, r.end_ms, r.text) for r in L.recombine(lines(spark, rows)).orderBy("start_ms", "end_ms").collect()]

    assert run((0, 1000, "a"), (1000, 2000, "a b"), (2000, 3000, "b")) == [(0, 2000, "a"), (1000, 3000, "b")]
    assert run((0, 1000, "a"), (1000, 2000, "b\\Na"), (2000, 3000, "b")) == [(0, 2000, "a"), (1000, 3000, "b")]
    assert run((0, 1000, "a\\Nb"), (1000, 2000, "b")) == [(0, 1000, "a"), (0, 2000, "b")]
    assert run((0, 1000, "same"), (1000, 2000, " same\\N")) == [(0, 2000, "same")]
    assert run((0, 1000, "x"), (1000, 2000, "y")) == [(0, 1000, "x"), (1000, 2000, "y")]


def test_overlaps_of_three(spark):
    got = L.recombine_overlaps(lines(spark, [(0, 3000, "a"), (1000, 2000, "b"), (1500, 4000, "c")])).orderBy("row_no").collect()
    assert all(x.end_ms <= y.start_ms for x, y in zip(got, got[1:]))
    assert [(r.start_ms, r.end_ms, r.text) for r in got][:2] == [(0, 1000, "a"), (1000, 1500, "b\\Na")]


def test_spikes(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 50.0, 40.0), (1, 6, 4.0, 0.0), (1, 8, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id int, frame int, x double, y double")
    got = [(r.frame, r.x, r.y) for r in V.repair_spikes(df, ["x", "y"], 5).orderBy("frame").collect()]
    assert got == [(0, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.75, 0.0), (6, 4.0, 0.0), (8, 5.0, 0.0)]


def test_scripts_of_languages(spark):
    cases = {"abc": "English", "ÀÉ": "English", "жук": "Русский", "한": "한국어", "ᄀ": "한국어", "㐀 x": "中文", "漢字": "中文", "漢字かな": "日本語", "ｶ": "日本語", "ㇰ": "日本語", "12 ?": "", "": ""}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", M.script_of("t").alias("got")).collect()
    assert {r.t: r.got for r in got} == cases


def test_comments_pass(spark):
    df = lines(spark, [(0, 1000, "a"), (900, 800, "note"), (1200, 2000, "b")]).withColumn("comment", F.col("id") == 1)
    got = {r.id: (r.start_ms, r.end_ms) for r in G.post_process(df, gap=500).collect()}
    assert got == {0: (0, 1100), 1: (900, 800), 2: (1100, 2000)}


def test_insert_beside(spark):
    df = lines(spark, [(1000, 2000, "a"), (2500, 3000, "b")])
    one = df.where("id = 1").select("file_id", "id")
    got = [(r.id, r.start_ms, r.end_ms, r.text) for r in L.insert_beside(df, one, 2000, before=True).orderBy("row_no").collect()]
    assert got == [(0, 1000, 2000, "a"), (None, 2000, 2500, ""), (1, 2500, 3000, "b")]
    got = [(r.id, r.start_ms, r.end_ms) for r in L.insert_beside(df, one, 2000).orderBy("row_no").collect()]
    assert got[-1] == (None, 3000, 5000)


# ------------------------------------------------------------------ tags


def test_tags():
    tag = N.parse_tag("\\t(0,100,0.5,\\fs20\\clip(1,2,3,4))")
    assert (tag.name, tag.kinds, tag.values[:3]) == ("t", ["start", "start", "float", "block"], ["0", "100", "0.5"])
    assert N.parse_tag("\\t(\\b1)").values == [None, None, None, "\\b1"] and N.parse_tag("\\t(2,\\b1)").values == [None, None, "2", "\\b1"]
    assert N.parse_tag("\\clip(1,2,3,4)").kinds == ["x", "y", "x", "y"] and N.parse_tag("\\clip(m 0 0)").values == [None, "m 0 0"]
    assert N.parse_tag("\\clip(2,m 0 0)").text() == "\\clip(2,m 0 0)" and N.parse_tag("\\iclip(m 0 0)").text() == "\\iclip(m 0 0)"
    assert [t.name for t in N.parse_block("\\frx1\\fr2\\fsp3\\fs+4\\fs5\\bord1\\be1\\blur2\\alpha&H1&\\an5\\a6\\xyz")] == ["frx", "fr", "fsp", "fs+", "fs", "bord", "be", "blur", "alpha", "an", "a", None]
    assert N.parse_tag("\\b").text() == "\\b" and N.parse_tag("\\pos( 1 , 2 )").text() == "\\pos(1,2)"


def test_pieces():
    assert N.pieces("a{\\b1}b{note}c{open") == [("plain", "a"), ("override", "\\b1"), ("plain", "b"), ("comment", "note"), ("plain", "c{open")]
    assert [k for k, _ in N.pieces("{\\p1}m 0 0{\\p0}x")] == ["override", "drawing", "override", "plain"]


def test_tidied():
    cases = {
        "{\\b1}{\\i1}x": "{\\b1\\i1}x",
        "{\\b1\\k20}a{\\k10}{\\k5}b": "{\\k20\\b1}a{\\k10}{\\k5}b",
        "a{\\pos(1, 2)}b{\\pos(3,4)\\b1}c": "{\\pos(1,2)}a" + "b{\\b1}c",
        "{\\fad(1,2)\\an8}x{}y": "{\\an8\\fad(1,2)}xy",
        "{\\clip( m 0 0   l 1 1 )}x{ }": "{\\clip(m 0 0 l 1 1)}x",
        "plain": "plain",
    }
    assert {t: N._tidied(t) for t in cases} == cases


def test_retimed(spark):
    df = lines(spark, [(1000, 3000, "{\\k50}a{\\k50\\t(0,500,\\fs9)}b{\\fad(100,200)}")])
    got = G.transform_rate(df, (25, 1), (50, 1), tags=True).first()
    assert (got.start_ms, got.end_ms, got.text) == (500, 1500, "{\\k25}a{\\k25\\t(0,250,\\fs9)}b{\\fad(50,100)}")


# ------------------------------------------------------------------ editing


def test_joins(spark):
    df = lines(spark, [(500, 1000, " a "), (400, 2000, "b"), (3000, 4000, "")])
    one = lambda i: df.where(f"id = {i}").select("file_id", "id")
    run = lambda i, after: [(r.id, r.row_no, r.start_ms, r.end_ms, r.text) for r in E.join_neighbour(df, one(i), after).orderBy("row_no").collect()]
    assert run(0, True) == [(0, 0, 400, 2000, "a b"), (2, 1, 3000, 4000, "")]
    assert run(1, False) == [(1, 0, 400, 2000, "a b"), (2, 1, 3000, 4000, "")]
    assert run(1, True) == [(0, 0, 500, 1000, " a "), (1, 1, 400, 4000, "b")]
    assert len(run(2, True)) == 3


def test_split_at_frame(spark):
    df = lines(spark, [(0, 2000, "one two")])
    got = E.split_at_cursor(df, df.select("file_id", "id", F.lit(4).alias("pos")), "frame", 24, (25, 1)).orderBy("row_no").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.text) for r in got] == [(0, 0, 980, "one"), (None, 980, 2000, "two")]
    got = E.split_at_cursor(df, df.select("file_id", "id", F.lit(3).alias("pos"))).orderBy("row_no").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(0, 2000, "one"), (0, 2000, "two")]


def test_extradata(spark):
    df = spark.createDataFrame([(1, 1, [5]), (1, 2, [])], "file_id int, id bigint, extradata_ids array<bigint>")
    data = spark.createDataFrame([(1, 5, 0, "k", "old"), (1, 6, 0, "k", "new")], "file_id int, id bigint, expiration int, key string, value string")
    values = spark.createDataFrame([(1, 1, "k", "new"), (1, 2, "m", "x")], "file_id int, line_id bigint, key string, value string")
    got, after = E.set_extradata(df, data, values)
    assert {r.id: r.extradata_ids for r in got.collect()} == {1: [6], 2: [7]}
    assert {(r.id, r.key, r.value) for r in after.collect()} == {(5, "k", "old"), (6, "k", "new"), (7, "m", "x")}
    got, _ = E.set_extradata(df, data, values, delete=True)
    assert {r.id: r.extradata_ids for r in got.collect()} == {1: [], 2: []}


# ------------------------------------------------------------------ regions


def test_regions(spark):
    image = [v for y in range(3) for x in range(4) for v in (x, y, 200)]
    one = spark.range(1).select(V.crop(F.array(*map(F.lit, image)), F.lit(4), 1, 1, 2, 2).alias("c"), V.crop(F.array(*map(F.lit, image)), F.lit(4), 3, 0, 2, 1).alias("out"), V.channel_means(F.array(*map(F.lit, image))).alias("m"), V.histogram_mode(F.array(*map(F.lit, image))).alias("h"), V.changed_ratio(F.array(*map(F.lit, image)), F.array(*map(F.lit, [0, *image[1:9], 99, *image[10:]])), 5).alias("r"), V.region_hash(F.array(F.lit(97))).alias("f")).first()
    assert one.c == [1, 1, 200, 2, 1, 200, 1, 2, 200, 2, 2, 200] and one.out is None
    assert one.m == [1.5, 1.0, 200.0] and one.h == 0 and one.r == 1 / 12 and one.f == "af63dc4c8601ec8c"


# ------------------------------------------------------------------ whole scripts

SCRIPT = """[Script Info]
; a comment
Title: A: title
ScriptType: v4.00+
Collisions: Normal
PlayResX: 640
Video File: movie.mkv

[V4+ Styles]
Format: whatever
Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,2,1.5,2,10,10,10,1
Style: broken,Arial
[V4 Styles]
Style: Old,Serif,18,255,65535,0,-2147483640,0,-1,1,2,0,6,1,2,3,0,0

[Fonts]
fontname: a.ttf
%s
fontname: b.ttf
%s

[Events]
Format: whatever
Dialogue: 0,0:00:01.00,0:00:02.50,Default,Bob,0,0,0,,{=3=4}Hello, {\\i1}world
Comment: 1,0:00:03.00,0:00:04.00,Old,,1,2,3,fx,note
Dialogue: too,short

[Editor Extradata]
Data: 3,key#2C,evalue#3A
Data: 4,k,u%s
"""


def test_whole_script(spark):
    from lineweave.functions.text import uuencode

    font = bytes(range(200))
    one, two = uuencode(font).replace("\r\n", "\n"), uuencode(b"x" * 60)
    text = SCRIPT % (one, two, uuencode("été".encode()))
    found = scripts.entries(spark.createDataFrame([("f", text), ("bad", "[Script Info]\nScriptType: v5\n"), ("none", None)], "file_id string, content string")).cache()
    assert [(r.file_id, r.value) for r in found.where("not ok").collect()] == [("bad", "unknown script type v5")]
    assert [(r.key, r.value) for r in scripts.info(found).orderBy("ord").collect()] == [("Title", "A: title"), ("ScriptType", "v4.00+"), ("PlayResX", "640")]
    assert [(r.key, r.value) for r in scripts.properties(found).collect()] == [("Video File", "movie.mkv")]
    styles = scripts.styles(found).orderBy("ord").collect()
    assert [(s.name, s.bold, s.italic, s.alignment, s.shadow, s.scalex, s.outline_w) for s in styles] == [("Default", True, False, 2, "80000000", 100.0, 2.0), ("Old", False, True, 8, "00000008", 100.0, 2.0)]
    files = {r.filename: bytes(r.data) for r in scripts.attachments(found).collect()}
    assert files == {"a.ttf": font, "b.ttf": b"x" * 60}
    events = scripts.lines(found).orderBy("row_no").collect()
    assert [(r.start_ms, r.end_ms, r.comment, r.extradata_ids, r.text) for r in events] == [(1000, 2500, False, [3, 4], "Hello, {\\i1}world"), (3000, 4000, True, [], "note")]
    assert {(r.id, r.key, r.value) for r in scripts.extradata(found).collect()} == {(3, "key,", "value:"), (4, "k", "été")}

    tables = lambda f: {"info": scripts.info(f), "properties": scripts.properties(f), "styles": scripts.styles(f), "attachments": scripts.attachments(f), "lines": scripts.lines(f), "extradata": scripts.extradata(f)}
    written = scripts.script(**tables(found)).where("file_id = 'f'").cache()
    again = scripts.entries(written)
    for name, old in tables(found).items():
        new = tables(again)[name]
        order = lambda d: sorted((tuple(x for c, x in zip(d.columns, r) if c != "ord") for r in d.where("file_id = 'f'").collect()), key=repr)
        assert order(new) == order(old), name


def test_style_catalog(spark):
    files = spark.createDataFrame([("c.sty", "Style: A,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1\nnonsense\nStyle: short\n")], "file_id string, content string")
    assert [r.name for r in scripts.style_catalog(files).collect()] == ["A"]
