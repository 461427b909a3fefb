import time

import pytest
from pyspark.sql import functions as F
from test_functions import lines

from lineweave.plans.export import Registry
from lineweave.sources import readers as R
from lineweave.sources import writers as W
from lineweave.streaming import evidence as S


def files(spark, *content):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(content)], "file_id string, content string")


def test_microdvd(spark):
    got = R.microdvd_lines(files(spark, "{1}{1}25\n{25}{50}one|two\nnoise\n{75}{100}{y:i}x\n"), 25, 1).orderBy("row_no").collect()
    assert [(r.row_no, r.text) for r in got] == [(0, "one\\Ntwo"), (1, "{y:i}x")]
    assert all(abs(r.start_ms - s) <= 20 and abs(r.end_ms - e) <= 20 for r, s, e in zip(got, (1000, 3000), (2000, 4000)))


def test_microdvd_frames_survive(spark):
    df = lines(spark, [(1000, 2000, "{\\b1}a\\Nb"), (3000, 4000, "c")])
    text = W.microdvd(df, 25, 1).first().content
    back = R.microdvd_lines(files(spark, text), 25, 1).orderBy("row_no").collect()
    assert [r.text for r in back] == ["a\\Nb", "c"]
    assert W.microdvd(lines(spark, [(r.start_ms, r.end_ms, r.text) for r in back]), 25, 1).first().content == text


def test_plain(spark):
    got = R.plain_lines(files(spark, "Ann: hi\nthere\n\n# note\nBob:yes\n")).orderBy("row_no").collect()
    assert [(r.row_no, r.comment, r.actor, r.text) for r in got] == [(0, False, "Ann", "hi"), (1, False, "Ann", "there"), (2, True, "Ann", " note"), (3, False, "Bob", "yes")]
    df = lines(spark, [(0, 10, "a"), (10, 20, "b"), (20, 30, "c")])
    assert W.plain(df).first().content == "a\nb\nc\n"
    assert W.plain(df.withColumn("actor", F.when(F.col("id") < 2, "Ann").otherwise(""))).first().content.startswith("Ann: a\nAnn: b\n")


def test_other_writers(spark):
    df = lines(spark, [(0, 1000, "a"), (1000, 2000, "b\\Nc")])
    assert W.encore(df).first().content == "1 00:00:00:00 00:00:00:29 a\n2 00:00:01:00 00:00:01:29 b\r\nc\n"
    assert W.microdvd(df, 25, 1, with_rate=True).first().content.startswith("{1}{1}25.000000\n{0}{24}a\n")
    ssa = W.ssa(df.withColumns({c: F.lit(0) for c in ("margin_l", "margin_r", "margin_v")})).first().content
    assert "Dialogue: Marked=0,0:00:00.00,0:00:01.00,Default,,0,0,0,,a\n" in ssa
    assert W.can_save_plain(df).first().can_save and not W.can_save_plain(lines(spark, [(0, 1, "{\\b1}a")])).first().can_save


def test_timecodes(spark):
    got = R.timecodes(files(spark, "# timecode format v2\n0\n33.4\n66.6\n")).orderBy("frame").collect()
    assert [(r.frame, r.ms) for r in got] == [(0, 0), (1, 33), (2, 67)]
    for bad in ("# v2\n0\n", "# v2\n0\n50\n20\n", "# v2\n5\n5\n"):
        with pytest.raises(ValueError):
            R.timecodes(files(spark, bad))


def test_keyframes(spark):
    listed = R.keyframes(files(spark, "# keyframe format v1\nfps 0\n0\n250\n500\n")).orderBy("frame").collect()
    assert [r.frame for r in listed] == [0, 250, 500]
    logged = R.keyframes(files(spark, "# log\ni 1\np 2\nb 3\nI 4\n")).orderBy("frame").collect()
    assert [r.frame for r in logged] == [0, 3]


def test_written_timecodes_and_keyframes(spark):
    codes = spark.createDataFrame([("f0", 0, 0), ("f0", 1, 40), ("f0", 2, 80)], "file_id string, frame int, ms int")
    assert W.timecodes(codes).first().content == "# timecode format v2\n0\n40\n80\n"
    longer = W.timecodes(codes, 5)
    assert [r.ms for r in R.timecodes(longer).orderBy("frame").collect()] == [0, 40, 80, 120, 160]
    assert W.timecodes(codes, 2).first().content.count("\n") == 4
    frames = spark.createDataFrame([("f0", 250), ("f0", 0), ("f0", 250)], "file_id string, frame int")
    assert W.keyframes(frames).first().content == "# keyframe format v1\nfps 0\n0\n250\n"
    assert [r.frame for r in R.keyframes(W.keyframes(frames)).orderBy("frame").collect()] == [0, 250]


def test_styles_and_info(spark):
    style = "Style: Default,Arial,20,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,2,2,10,10,10,1"
    f = files(spark, f"[Script Info]\n; no\nTitle: a: b\n[V4+ Styles]\n{style}\nStyle: short,1\n[Events]\n")
    assert [(r.key, r.value) for r in R.ass_info(f).collect()] == [("Title", "a: b")]
    assert [(r.name, r.font, r.encoding) for r in R.ass_styles(f).collect()] == [("Default", "Arial", "1")]


def test_export_order(spark):
    r = Registry()
    r.add("late", lambda df: df.withColumn("text", F.concat("text", F.lit("2"))), 0)
    r.add("soon", lambda df: df.withColumn("text", F.concat("text", F.lit("1"))), 5)
    r.add_macro("macro", lambda p: p.assign(text=p.text + "0"), None, 9)
    assert r.names() == ["macro", "soon", "late"]
    df = lines(spark, [(0, 1, "x")])
    assert r.export(df).first().text == "x012"
    assert r.export(df, ["late"]).first().text == "x2"
    with pytest.raises(ValueError):
        r.add("late", lambda df: df)


def test_stream_runs(spark, tmp_path):
    schema = "scan_id long, frame int, coverage double"
    for k, rows in enumerate([[(1, 0, 0.0), (1, 1, 0.9)], [(1, 2, 0.5), (1, 3, -1.0), (1, 4, 0.1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frames = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = S.stream_runs(frames, 0.8, 0.3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
    got = spark.read.schema("scan_id long, first_frame int, last_frame int").parquet(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3)]


def test_stream_runs_of_idle_scans(spark, tmp_path):
    """A run that is open when its scan has ended comes after the idle time; a frame without a box is off."""
    schema = "scan_id long, frame int, coverage double, ocr_box boolean"
    spark.createDataFrame([(1, 0, 0.9, True), (1, 1, 0.9, False), (1, 2, 0.9, True), (1, 3, 0.5, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = S.stream_runs(frames, 0.8, 0.3, idle_ms=500).writeStream.format("memory").queryName("idle_runs").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            got = sorted(tuple(r) for r in spark.table("idle_runs").collect())
            if len(got) == 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == [(1, 0, 0), (1, 2, 3)]


def test_transtation(spark):
    df = lines(spark, [(0, 1000, "a"), (1000, 2000, "a"), (2000, 3000, "{\\b1}b\\Nc")]).withColumn("style", F.when(F.col("start_ms") == 2000, "TOP").otherwise("none"))
    styles = spark.createDataFrame([(1, 0, "Top", 9, True)], "file_id int, ord int, name string, alignment int, italic boolean")
    got = W.transtation(df, styles, 25).first().content
    assert got == "SUB[0 N 00:00:00:00>00:00:01:23]\r\na\n\nSUB[9RI 00:00:02:00>00:00:03:00]\r\nb\r\nc\nSUB[\n"


def test_latest(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, "c", True)], "id long, version int, text string, deleted boolean")
    assert [tuple(r) for r in S.latest(log, ["id"], "version").collect()] == [(1, "b")]
