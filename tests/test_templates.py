import pytest
from pyspark.sql import functions as F

from lineweave.functions import htmltags as H
from lineweave.functions import paths as P
from lineweave.functions import patterns as R
from lineweave.functions.markup import font_name_at
from lineweave.operators import evidence as V
from lineweave.operators import styles as S
from lineweave.operators import templates as T
from lineweave.operators.karaoke import syllables
from lineweave.sources import writers as W
from lineweave.sources.readers import srt_lines

ROW = "file_id string, id int, row_no int, comment boolean, layer int, start_ms int, end_ms int, style string, actor string, effect string, text string"
SUNG = ("f", 9, 9, False, 0, 1000, 2000, "S", "Ann", "", r"{\k20}ab{\k30\i1}c{\k50} ")


def effects(spark, *templates, **functions):
    rows = [("f", i, i, True, 5, 0, 0, style, "", effect, text) for i, (style, effect, text) in enumerate(templates)]
    df = spark.createDataFrame([*rows, SUNG], ROW)
    out = T.apply(df, syllables(df), T.read(df), functions).orderBy("template", "n").collect()
    return [(r.start_ms, r.end_ms, r.layer, r.text) for r in out]


def test_syllable_templates(spark):
    got = effects(spark, ("S", "template syl noblank", r"!retime('syl', -10, 5)!{\t($start,$end)}"))
    assert got == [(990, 1205, 5, r"{\t(0,200)}ab"), (1190, 1505, 5, r"{\t(200,500)}c")]
    assert effects(spark, ("Other", "template", "x")) == [] and len(effects(spark, ("Other", "template all", "x"))) == 3
    got = effects(spark, ("S", "template repeat 2 notext noblank", "!relayer(j)!$si/$syln !j..'of'..maxj! $nope"))
    assert got == [(1000, 2000, 1, "1/3 1of2 $nope"), (1000, 2000, 2, "1/3 2of2 $nope"), (1000, 2000, 1, "2/3 1of2 $nope"), (1000, 2000, 2, "2/3 2of2 $nope")]
    assert [x[3] for x in effects(spark, ("S", "template char noblank", "-"))] == ["-a", "-b", "-c"]
    assert [x[3] for x in effects(spark, ("S", "template keeptags noblank", "!double($sdur)!"), double=lambda x: 2 * x)] == ["400ab", r"600{\i1}c"]


def test_line_templates(spark):
    got = effects(spark, ("S", "template pre-line a", r"{\an5}"), ("S", "template line a", r"{\k$skdur}"), ("S", "template line", ""))
    assert got == [(1000, 2000, 5, r"{\an5}{\k20}ab{\k30}c{\k50} "), (1000, 2000, 5, "abc ")]


def test_marked(spark):
    df = spark.createDataFrame([("f", 0, 0, True, 5, 0, 0, "S", "", "template", "x"), SUNG, (*SUNG[:1], 10, 10, False, 0, 0, 1, "T", "", "", "plain")], ROW)
    out = T.marked(df, T.apply(df, syllables(df), T.read(df))).orderBy("id").collect()
    assert [(r.comment, r.effect) for r in out] == [(True, "template"), (True, "karaoke"), (False, "")]


def test_expressions():
    names = {"a": 3, "t": {"b": 4}, "f": max}
    assert [T.evaluate(x, names) for x in ("a^2 + t.b / 2", "f(a, 5) .. 'x'", "a > 2 and 'yes' or 'no'", "a ~= 3", "-a % 2")] == [11, "5x", "yes", False, 1]
    for bad in ("b", "a(", "__import__('os')", "t.c", "[1]", "1/0", "a.b"):
        with pytest.raises(ValueError):
            T.evaluate(bad, names)
    assert [T.shown(x) for x in (2.0, 0.5, 7, True, None)] == ["2", "0.5", "7", "true", "nil"]


def test_html_tags(spark):
    cases = {
        "<b>a<B>b</b>c</b>d</b>": r"{\b1}abc{\b}d", "<i><u>x</u></i>": r"{\i1\u1}x{\u\i}",
        "<font face='A B' size=12>x<font color=\"#102030\">y</font>z</font>w": r"{\fnA B\fs12}x{\c&H302010&}y{\c}z{\fn\fs}w",
        "</font>a<q>b": "a<q>b", "<font color=odd>a": r"{\c&H000000&}a", "plain": "plain", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert [r[0] for r in df.select(H.to_overrides("t")).collect()] == [*cases.values(), None]


def test_paths(spark, tmp_path):
    (tmp_path / "f.ass").write_text("")
    folders = {"?script": str(tmp_path / "f.ass"), "?video": "/v/a", "?audio": "rel"}
    df = spark.createDataFrame([("?script/x.ttf",), ("?videofoo",), ("?video",), ("?audio/x",), ("/v/x",), (None,)], "p string")
    assert [r[0] for r in df.select(P.decode("p", folders)).collect()] == [f"{tmp_path}/x.ttf", "/v/a/foo", "/v/a", "?audio/x", "/v/x", None]
    df = spark.createDataFrame([("/v/a/b/c.mkv",), ("/q",), ("/v/z/c",), ("?dummy:1",), ("",)], "p string")
    assert [r[0] for r in df.select(P.encode("p", {"?video": "/v/a"})).collect()] == ["?video/b/c.mkv", "/q", "?video/../z/c", "?dummy:1", ""]
    assert [r[0] for r in df.select(P.relative_to("p", "/v/a")).collect()] == ["b/c.mkv", "../../q", "../z/c", "?dummy:1", ""]
    rel = spark.createDataFrame([("x/y",), ("/x",), ("",)], "p string")
    assert [r[0] for r in rel.select(P.absolute("p", "/v")).collect()] == ["/v/x/y", "/x", ""]
    with pytest.raises(ValueError):
        P.checked({"?nope": "/"})


def test_patterns(spark):
    df = spark.createDataFrame([("aXbbXc", ), ("", ), (None, )], "t string")
    got = [r[0] for r in df.select(R.found("t", R.compiled("x|b+", "ICASE"))).collect()]
    assert [[tuple(m) for m in g] if g is not None else None for g in got] == [[("X", 2, 2), ("bb", 3, 4), ("X", 5, 5)], [], None]
    r = df.limit(1).select(R.split("t", "X"), R.split("t", "X", most=1), R.substitute("t", "X", "-", 1), R.substitute("t", "(b)", "$1$1"), R.groups("t", "(b+)X(.)", 2), R.substituted("t", "b+|X", lambda x: F.concat(F.lit("<"), x, F.lit(">")))).first()
    assert list(r) == [["a", "bb", "c"], ["a", "bbXc"], "a-bbXc", "aXbbbbXc", ["bbXc", "bb", "c"], "a<X><bb><X>c"]


def test_font_name_at(spark):
    text = r"{\fnArial\b1}a\fnX{\i1\fn}{\fnB c"
    a, b = text.index("Arial"), text.index("B c")
    want = {i: (a, a + 5) for i in range(a, a + 5)} | {i: (b, b + 3) for i in range(b, b + 3)}
    df = spark.range(-1, len(text) + 1).select(F.col("id").cast("int").alias("p"), F.lit(text).alias("t"))
    got = {r.p: tuple(r.x) for r in df.select("p", font_name_at("t", F.col("p")).alias("x")).collect() if r.x is not None}
    assert got == want


def test_text_pixels(spark):
    grey, white, yellow = [60] * 3, [250] * 3, [150, 150, 40]
    images = {"white": grey * 60 + white * 4, "coloured": grey * 60 + yellow * 4, "plain": grey * 64, "light": [230] * 3 * 60 + [20] * 3 * 4, "empty": [], "full": [255] * 3 * 4}
    df = spark.createDataFrame(list(images.items()), "k string, rgb array<int>")
    got = {r.k: r.p for r in df.select("k", V.text_pixels("rgb", 60).alias("p")).collect()}
    last = [60, 61, 62, 63]
    assert got == {"white": last, "coloured": last, "plain": [], "light": last, "empty": [], "full": [0, 1, 2, 3]}


def brute_align(ok, anchor):
    right = anchor + 2
    while right < len(ok) and ok[right]:
        right += 2
    left = anchor - 2
    while left >= 0 and ok[left]:
        left -= 2
    return (0 if left < 0 else left + (1 if ok[left + 1] else 2), len(ok) - 1 if right >= len(ok) else right - (1 if ok[right - 1] else 2))


def test_align_to_point(spark):
    import random

    rng, rows, anchors, want = random.Random(4), [], [], {}
    for scan in range(40):
        ok = [rng.random() < 0.8 for _ in range(12)]
        at = rng.randrange(12)
        far = rng.random() < 0.5
        rows += [(scan, f, v or far, 10, 10, 10 if v else 16, 10) for f, v in enumerate(ok)]
        anchors.append((scan, at))
        if ok[at]:
            want[scan] = brute_align(ok, at)
        elif far:  # the anchor's own extents count: the others are the ones that differ
            want[scan] = brute_align([not v for v in ok], at)
    frames = spark.createDataFrame(rows, "scan_id int, frame int, found boolean, left int, right int, up int, down int")
    got = V.align_to_point(frames, spark.createDataFrame(anchors, "scan_id int, anchor int")).collect()
    assert {r.scan_id: (r.first_frame, r.last_frame) for r in got} == want


def test_suggestions(spark):
    words = ["cat", "cart", "at", "bat", "dog", "c", "", "tac"]
    d = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.word, r.suggestion) for r in S.suggestions(spark.createDataFrame([("Cat",), ("act",), ("x",)], "word string"), d).collect()}
    assert got == {("Cat", w) for w in ("cat", "cart", "at", "bat")} | {("act", "at"), ("x", ""), ("x", "c")}
    changes = spark.createDataFrame([("Dog", False, 1), ("new", True, 1), ("cat", False, 1), ("CAT", True, 2)], "word string, added boolean, at int")
    assert {r.word for r in S.user_words(d, changes).collect()} == set(words) - {"dog"} | {"new"}


def test_motion_keyframes(spark):
    samples = spark.createDataFrame([("a", 12, 0.0, 0.0, 1.5, 2.25, 1.0, 0.5, -3.0), ("a", 10, 4.0, 5.0, 6.0, 7.0, 1.0, 1.0, 0.0)], "track_id string, frame int, anchor_x double, anchor_y double, x double, y double, scale_x double, scale_y double, rotation double")
    tracks = spark.createDataFrame([("a", 23.976, 640, 480), ("b", 25.0, 1, 2)], "track_id string, fps double, width int, height int")
    got = {r.track_id: r.content for r in W.motion_keyframes(samples, tracks).collect()}
    assert got["a"].startswith("Adobe After Effects 6.0 Keyframe Data\r\n\r\n\tUnits Per Second\t23.976\r\n\tSource Width\t640\r\n")
    assert "Position\r\n\tFrame\tX pixels\tY pixels\tZ pixels\r\n\t0\t6.000\t7.000\t0\r\n\t2\t1.500\t2.250\t0\r\n\r\nScale" in got["a"]
    assert "\t2\t100.000\t50.000\t100\r\n\r\nRotation\r\n\tFrame\tDegrees\r\n\t0\t0.000\r\n\t2\t-3.000\r\n\r\nEnd of Keyframe Data\r\n" in got["a"]
    assert got["b"].endswith("Rotation\r\n\tFrame\tDegrees\r\n\r\nEnd of Keyframe Data\r\n")


def test_srt_tags(spark):
    df = spark.createDataFrame([("f", "1\n00:00:01,000 --> 00:00:02,000\n<i>a</i>\nb\n")], "file_id string, content string")
    assert srt_lines(df).first().text == r"{\i1}a{\i}\Nb"
