import numpy as np
from pyspark.sql import functions as F

from lineweave.operators import evidence as V
from lineweave.operators import lines as L


def track(spark, values, frames=None):
    frames = frames or range(len(values))
    return spark.createDataFrame([(1, f, float(v)) for f, v in zip(frames, values)], "track_id int, frame int, value double")


def values(df):
    return [r.value for r in df.orderBy("frame").collect()]


def test_hold_jitter(spark):
    assert values(V.hold_jitter(track(spark, [5, 5.5, 4.1, 9, 8.5, 9.1]), ["value"], 1)) == [5, 5, 5, 9, 9, 9.1]


def test_straighten(spark):
    got = values(V.straighten(track(spark, [0, 9, 9, 6, 1, 5], [0, 1, 2, 3, 7, 8]), "value"))
    assert got == [0, 2, 4, 6, 1, 5]


def test_audio(spark):
    s = spark.createDataFrame([(1, 0, 4), (1, 1, -7)], "track_id int, idx int, value int")
    assert [(r.idx, r.value) for r in V.double_rate(s).orderBy("idx").collect()] == [(0, 4), (1, -2), (2, -7), (3, -7)]
    one = spark.range(1).select(V.volume(F.lit(30000), 2.0).alias("a"), V.volume(F.lit(-30000), 2.0).alias("b"), V.downmix(F.array(F.lit(3), F.lit(4))).alias("c")).first()
    assert tuple(one) == (32767, -32768, 3.5)


def test_spectrum(spark):
    wave = [np.sin(2 * np.pi * 2 * k / 16) for k in range(16)]
    got = spark.range(1).select(V.spectrum(F.array(*(F.lit(float(32768 * x)) for x in wave))).alias("s")).first().s
    assert len(got) == 8 and int(np.argmax(got)) == 2 and abs(got[2] - np.log10(1 + 8 * 9 / np.sqrt(32))) < 1e-9


def test_set_info(spark):
    info = spark.createDataFrame([(1, 0, "Title", "a"), (1, 1, "PlayResX", "640")], "file_id int, ord int, key string, value string")
    assert sorted((r.ord, r.key, r.value) for r in L.set_info(info, "playresx", "1280").collect()) == [(0, "Title", "a"), (1, "playresx", "1280")]
    assert [r.key for r in L.set_info(info, "Title", "").collect()] == ["PlayResX"]
    assert L.set_info(info, "New", "x").where("key = 'New'").first().ord == 2


def test_clean_extradata(spark):
    lines = spark.createDataFrame([(1, 10, [1, 2, 3]), (1, 11, [])], "file_id int, id int, extradata_ids array<bigint>")
    data = spark.createDataFrame([(1, 1, 0, "k", "a"), (1, 2, 0, "k", "b"), (1, 3, 5, "m", "c"), (1, 4, 9, "z", "d"), (1, 5, 2, "z", "e")], "file_id int, id bigint, expiration int, key string, value string")
    got, kept = L.clean_extradata(lines, data)
    assert {r.id: r.extradata_ids for r in got.collect()} == {10: [2, 3], 11: []}
    assert {r.id: r.expiration for r in kept.collect()} == {1: 1, 2: 0, 3: 0, 5: 3}
