import pytest
import regex
from pyspark.sql import functions as F

from lineweave.functions import kana as K
from lineweave.functions import shapes as S
from lineweave.operators.karaoke import render, syllables


def first(source, text):
    return K.match_first(source, regex.findall(r"\X", text))


@pytest.mark.parametrize("source, text, want", [
    ([], "a", (0, 0)), (["a", "b"], "", (2, 0)), (["", "b"], "cc", (1, 0)), (["a", "b"], "cc", (1, 1)), (["ABC", "DE"], "abcde", (1, 3)),
    (["abc ", "de"], "ab c de", (1, 5)), (["ro ma jide"], "ろまじ", (1, 3)), (["kya", "e"], "きゃe", (1, 2)), (["r om aj ide"], "ろまじ", (1, 1)),
    (["a", "b", "c"], "ろ", (3, 1)), (["ab", "cd"], "ａｂc", (1, 2)), (["ab", "", "ro"], "eeろ", (1, 2)), (["abc", "", "ro"], "eeeろ", (1, 3)),
    (["abcd", "", "ro"], "eeeeろ", (1, 1)), (["a", "b", "ro"], "eeろ", (1, 1)), (["a", "b", "c", "ro"], "eeろ", (2, 1)),
    (["a", "b", "c", "d", "f", "ro"], " eeろ", (3, 2)), (["aa", "kya"], "eeきゃ", (1, 2)), (["Bo", "ku", "wa"], "僕は", (2, 1)), (["Bo", "ku", "e"], "僕へ", (2, 1)),
    (["shi", "tta", ""], "知った", (1, 1)), (["tta", ""], "った", (2, 2)), (["Oh... ", "Nan", "ka ", "ta", "ri", "nai"], "Oh…なんか足りない", (1, 3)),
])
def test_match_first(source, text, want):
    assert first(source, text) == want


@pytest.mark.parametrize("text, song, want", [
    ("あめにじんだ", False, "あ|め|に|じ|ん|だ"), ("ちゃっとスーパー", False, "ちゃ|っ|と|ス|ー|パ|ー"), ("あ、い。う", False, "あ、|い。|う"),
    ("(まちょっと)", True, "(ま|ちょっ|と)"), ("(心##焦がす)", True, "(心|#|#|焦|が|す)"), ("( #あ", True, "(| |#|あ"), ("あ )", True, "あ| |)"), ("「スーパー」", True, "「スー|パー」"),
    ("", True, ""), ("|", True, ""), ("abcあdef", False, "abc|あ|def"),
])
def test_kana_units(text, song, want):
    assert "|".join(K.kana_units(text, song, song)) == want


def test_empty_units():
    assert K.kana_units("あめ||にじ") == ["あ", "め", "", "に", "じ"] == K.kana_units("あめ||にじ", True, True)


def test_word_units_and_even_times(spark):
    df = spark.createDataFrame([("f", 1, 0, 400, "ab  c||d#e|"), ("f", 2, 100, 50, "x y"), ("f", 3, 0, 10, ""), ("f", 4, 0, 10, None)], "file_id string, id int, start_ms int, end_ms int, text string")
    got = {r.id: r.u for r in df.select("id", K.word_units("text").alias("u")).collect()}
    assert got == {1: ["ab", "c", "", "d", "#", "e"], 2: ["x", "y"], 3: [""], 4: [""]} or got[4] is None
    out = K.evenly(df.where("text is not null"), K.word_units("text"))
    ends = {k: [(r.syl_start_ms, r.duration_ms) for r in out.where(f"id = {k}").orderBy("idx").collect()] for k in (1, 2, 3)}
    assert ends == {1: [(0, 70), (70, 60), (130, 70), (200, 70), (270, 60), (330, 70)], 2: [(100, 0), (100, 0)], 3: [(0, 10)]}


def test_copy_timing(spark):
    sung = spark.createDataFrame([("f", 1, 0, 1000, r"{\k20}bo{\k30}ku{\k50}wa")], "file_id string, id int, start_ms int, end_ms int, text string")
    to = spark.createDataFrame([("f", 9, 1, "僕は"), ("f", 8, 7, "x")], "file_id string, id int, source_id int, text string")
    assert [tuple(r) for r in K.copy_timing(syllables(sung), to).collect()] == [("f", 9, r"{\k50}僕{\k50}は")]
    assert render(syllables(sung)).first().text == sung.first().text


def test_drawings(spark):
    text = "m 0 0 l 10 0 10 10 b 10 15 5 20 0 10"
    df = spark.createDataFrame([(text,), ("",), (None,), ("l 4 6",)], "t string").withColumn("s", S.segments("t"))
    rows = df.select("t", "s", S.encode("s").alias("e"), S.bounds("s").alias("b")).collect()
    assert [x.kind for x in rows[0].s] == ["m", "l", "l", "b"] and rows[0].s[3].p == [10, 10, 10, 15, 5, 20, 0, 10]
    assert [r.e for r in rows] == [text, "", None, "m 0 0 l 4 6"] and tuple(rows[0].b) == (0, 0, 10, 20) and rows[1].s == []
    assert S.decode("m 8 4", 3) == [("m", [2.0, 1.0])]
    seg = df.limit(1).select(F.explode("s").alias("s")).select("s.kind", "s.p")
    x, y = F.lit(4.0), F.lit(3.0)
    got = seg.select("kind", S.nearest(F.col("p"), x, y).alias("t"), S.point(F.col("p"), 0.5).alias("m"), S.halves(F.col("p"), 0.5).alias("h")).collect()
    assert [r.t for r in got[:3]] == [0.0, 0.4, 0.3] and tuple(got[1].m) == (5, 0)
    assert got[3].h.first[-2:] == list(got[3].m) == got[3].h.second[:2] and got[3].h.first[:2] == [10, 10] and got[3].h.second[-2:] == [0, 10]
    assert got[1].h.first == [0, 0, 5, 0] and got[1].h.second == [5, 0, 10, 0]


def test_smoothed(spark):
    df = spark.createDataFrame([("m 0 0 l 10 0 10 10 0 10",), ("m 0 0 l 1 1",)], "t string")
    a, b = (r.s for r in df.select(S.smoothed(S.segments("t"), 1.0).alias("s")).collect())
    assert [x.kind for x in a] == ["m", "b", "b", "b"] and [x.kind for x in b] == ["m", "l"]
    assert all(abs(u - v) < 1e-9 for u, v in zip(a[2].p, [10, 0, 12.5, 2.5, 12.5, 7.5, 10, 10]))


def test_clip_and_perspective(spark):
    df = spark.createDataFrame([(r"{\iclip(1, 2.5,-3,4)}a",), (r"{\clip(m 0 0 l 1 1)}",), ("a",)], "t string")
    assert [None if r.c is None else tuple(r.c) for r in df.select(S.clip_value("t").alias("c")).collect()] == [(True, 1, 2.5, -3, 4), None, None]
    quad = [F.lit(float(v)) for v in (0, 0, 10, 0, 8, 6, 2, 6)]
    put = lambda x, y: S.perspective(F.lit(float(x)), F.lit(float(y)), quad)
    r = df.limit(1).select(*(put(x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)))).first()
    assert [tuple(round(v, 9) for v in p) for p in r[:4]] == [(0, 0), (10, 0), (8, 6), (2, 6)]
    assert tuple(round(v, 6) for v in r[4]) == (5.0, 3.75)  # where the diagonals cross


def test_gradients(spark):
    df = spark.createDataFrame([("( 30,40,10,2.5, 90,rgb(1,2,3),&HFF&)",), ("(1,2,3,4,5,6)",), ("(1,2,3,x,5,6,7)",), ("(1,2,3,4,5,6,)",), (None,)], "v string")
    df = df.withColumn("g", S.placed_gradient("v"))
    rows = df.select("g", S.gradient_text(*(F.col(f"g.{c}") for c in ("left", "top", "right", "bottom", "rest"))).alias("t")).collect()
    assert [r.g is None for r in rows] == [False, True, True, True, True]
    assert tuple(rows[0].g) == (10, 2.5, 30, 40, "(90,rgb(1,2,3),&HFF&)") and rows[0].t == "(10,2.5,30,40,90,rgb(1,2,3),&HFF&)"
