import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as X
from lineweave.functions import times as T
from lineweave.operators import evidence as V
from lineweave.operators import karaoke as K
from lineweave.operators import lines as L
from lineweave.operators import matching as M
from lineweave.sources import readers as R
from lineweave.sources import writers as W

LINES = "file_id long, id long, row_no int, comment boolean, layer int, start_ms int, end_ms int, style string, actor string, effect string, text string"


def lines(spark, rows):
    return spark.createDataFrame([(1, i, i, False, 0, s, e, "Default", "", "", t) for i, (s, e, t) in enumerate(rows)], LINES)


@pytest.mark.parametrize("text,ms", [("23:45.67", 1425670), ("0:00:01,5", 1500), ("1:02:03.456", 3723456), ("100", 100000), ("", 0)])
def test_parse_time(spark, text, ms):
    assert spark.range(1).select(T.parse(F.lit(text)).alias("t")).first().t == ms


@pytest.mark.parametrize("a,b,score", [("abc", "abd", 2 / 3), ("hello", "world", 0.2), ("", "", 1.0)])
def test_similarity(spark, a, b, score):
    assert abs(spark.range(1).select(M.similarity(F.lit(a), F.lit(b)).alias("s")).first().s - score) < 1e-9


def test_codecs():
    for data in (b"", b"a", b"ab", b"abc", bytes(range(256))):
        assert X.uudecode(X.uuencode(data)) == data
    assert X.inline_decode(X.inline_encode("a#b,c:d|e\n")) == "a#b,c:d|e\n"


def test_graphemes(spark):
    assert spark.range(1).select(X.graphemes(F.lit("éa")).alias("n")).first().n == 2


def test_recombine_overlaps(spark):
    got = L.recombine_overlaps(lines(spark, [(0, 1000, "a"), (500, 1500, "b")])).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(0, 500, "a"), (500, 1000, "b\\Na"), (1000, 1500, "b")]


def test_syllables(spark):
    got = K.syllables(lines(spark, [(1000, 3000, "{\\k20}abc{\\K30\\b1}d")])).orderBy("idx").collect()
    assert [(r.tag, r.syl_start_ms, r.duration_ms, r.text, r.tags) for r in got] == [("k", 1000, 200, "abc", ""), ("kf", 1200, 300, "d", "\\b1")]


def test_files(spark, tmp_path):
    df = lines(spark, [(0, 1000, "{\\i1}one{\\i0}"), (1500, 2500, "two\\Nlines")])
    for r in W.srt(df).collect():
        (tmp_path / "a.srt").write_text(r.content)
    for r in W.ass(df.withColumns({c: F.lit(0) for c in ("margin_l", "margin_r", "margin_v")})).collect():
        (tmp_path / "a.ass").write_text(r.content)
    got = R.srt_lines(R.texts(spark, str(tmp_path / "a.srt"))).orderBy("row_no").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(0, 1000, "{\\i1}one{\\i}"), (1500, 2500, "two\\Nlines")]
    back = R.ass_lines(R.texts(spark, str(tmp_path / "a.ass"))).orderBy("row_no").collect()
    assert [(r.start_ms, r.end_ms, r.style, r.text) for r in back] == [(0, 1000, "Default", "{\\i1}one{\\i0}"), (1500, 2500, "Default", "two\\Nlines")]


def test_items():
    assert R.items_json('{"a": {"b": "x"}, "c": ["y"]}', "f") == [("f", "a/b", "x"), ("f", "c/0", "y")]
    assert R.items_csv('key,text\nk,"a ""q"""\n', "f") == [("f", "k", 'a "q"')]
    assert R.items_pairs("# no\na = 1\nb: 2\nplain\n", "f") == [("f", "a", "1"), ("f", "b", "2"), ("f", "3", "plain")]


def test_timecodes_v1():
    assert R.timecodes_v1("Assume 25\n1,2,50\n", 5) == [0, 40, 60, 80, 120]
    for bad in ("Assume 0\n", "Assume 25\n2,1,50\n", "Assume 25\n0,5,50\n5,9,20\n"):
        with pytest.raises(ValueError):
            R.timecodes_v1(bad, 10)


def test_cluster_rows(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0, 10), (1, 1, 2, 2, 12), (1, 1, 3, 20, 30)], "scan_id long, frame int, box_id int, top int, bottom int")
    assert [r.cluster for r in V.cluster_rows(boxes).orderBy("box_id").collect()] == [0, 0, 1]
