import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineweave.functions import markup as B
from lineweave.operators import evidence as V
from lineweave.operators import history as H
from lineweave.operators import resample as Z
from lineweave.operators import styles as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("text,parts", [("", []), (" a ", ["a"]), ("(1, 2)", ["1", "2"]), ("(a,(b,c))z", ["a", "(b,c)", "z"]), ("(a,", ["a", ""]), ("(", [""]), ("()", [""])])
def test_parameters(spark, text, parts):
    assert one(spark, B.parameters(F.lit(text))) == parts


@pytest.mark.parametrize("text,value", [("&H80&", 128), ("", 0), ("&H0FFF&", 255), ("00", 0), ("x", 0)])
def test_alpha(spark, text, value):
    assert one(spark, B.alpha_value(F.lit(text))) == value


def test_numbers_and_tags(spark):
    assert [one(spark, B.number_text(F.lit(x))) for x in (10.0, 100.5, 0.0, -2.125)] == ["10", "100.5", "0", "-2.125"]
    assert one(spark, B.write_tag(F.lit("\\fad"), F.array(F.lit("1"), F.lit("2")))) == "\\fad(1,2)"
    assert one(spark, B.set_tag(F.lit("{\\fnA B\\b1}x{\\b1}y"), "fn", F.lit("C"))) == "{\\b1\\fnC}x{\\b1}y"
    assert one(spark, B.remove_tag(F.lit("{\\pos(1,2)\\bord1}x\\pos"), "pos")) == "{\\bord1}x\\pos"
    assert one(spark, B.fullwidth(F.lit("a{b}\"1 "))) == "ａ{b}”１ "
    assert one(spark, B.clean_tags(F.lit("{\\k1}{\\k2}a{\\t(0, 1, \\b1)}"))) == "{\\k1}{\\k2}a{\\t(0,1,\\b1)}"
    assert one(spark, B.parameters(F.lit(None).cast("string"))) is None


def test_wrapping():
    rng = random.Random(3)
    for _ in range(200):
        w, most = [rng.randint(1, 9) for _ in range(rng.randint(2, 8))], rng.randint(5, 20)
        cost = lambda cut: sum((sum(w[a:b]) - most) ** 2 if b - a == 1 or sum(w[a:b]) <= most else 10**9 for a, b in itertools.pairwise([0, *cut, len(w)]))
        cuts = [c for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k)]
        found = B._wrap(w, most, "balanced")
        if sum(w) <= most:
            assert found == []
        else:
            assert cost(found) == min(map(cost, cuts))
    assert B._wrap([9, 9], 5, "none") == []
    assert B._wrap([2, 5, 2, 2], 9, "first_longer") == [2]


def test_fonts(spark):
    lines = spark.createDataFrame([(1, 1, False, "A", "x{\\b1}y\\N{\\r}z"), (1, 2, True, "A", "q"), (1, 3, False, "?", "q")], "file_id int, id int, comment boolean, style string, text string")
    styles = spark.createDataFrame([(1, "A", "Sans", False, True)], "file_id int, name string, face string, bold boolean, italic boolean")
    assert sorted(map(tuple, S.font_usage(lines, styles).collect())) == [("Sans", False, True, 2, 0), ("Sans", True, True, 1, 1)]


def test_styles(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(("d", "c", "b", "a"))], "file_id int, ord int, name string")
    names = lambda df: [r.name for r in df.orderBy("ord").collect()]
    assert names(S.order_styles(rows, 1, 2, "up")) == ["c", "b", "d", "a"]
    assert names(S.order_styles(rows, 0, 0, "up")) == ["d", "c", "b", "a"]
    assert names(S.order_styles(rows, 0, 1, "down")) == ["b", "d", "c", "a"]
    assert names(S.order_styles(rows, 0, 1, "bottom")) == ["b", "a", "d", "c"]
    assert names(S.order_styles(rows, 0, 0, "sort")) == ["a", "b", "c", "d"]
    more = S.copy_styles(S.copy_styles(rows, F.col("name") == "a"), F.col("name") == "a")
    assert names(more)[4:] == ["a - Copy", "a - Copy (2)"]


def test_folds(spark):
    marks = [(0, False, 1, True), (1, False, 2, False), (2, True, 1, False), (3, True, 2, False), (4, False, 1, False), (5, True, 1, False), (6, False, 9, False)]
    df = spark.createDataFrame([(1, *m) for m in marks], "file_id int, row_no int, closing boolean, fold_id int, collapsed boolean")
    got = [(r.fold_id, r.valid, r.collapsed) for r in H.check_folds(df).orderBy("row_no").collect()]
    assert got == [(1, True, True), (2, False, False), (1, True, True), (10, False, False), (11, True, False), (11, True, False), (9, False, False)]


def test_amended_commits(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", True), (1, 3, "a", False), (1, 4, "b", False)], "file_id int, version int, label string, saved boolean")
    assert sorted(r.version for r in H.coalesce_versions(log).collect()) == [2, 3, 4]


def test_row_signature(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (10, 7))
    middle = sorted(image.ravel().tolist())[35]
    want = []
    for y in range(2):
        for x in range(3):
            cell = [image[j, i] for j in range(y * 10 // 2, (y + 1) * 10 // 2) for i in range(x * 7 // 3, (x + 1) * 7 // 3)]
            want.append(sum(abs(v - middle) >= 40 for v in cell) * 255 // len(cell))
    c = F.array(*map(F.lit, image.ravel().tolist()))
    assert one(spark, V.row_signature(c, F.lit(7), F.lit(10), 3, 2)) == want
    assert one(spark, V.row_signature(F.lit(None).cast("array<int>"), F.lit(1), F.lit(1), 2, 1)) == [0, 0]
    assert one(spark, V.signature_distance(F.array(F.lit(0), F.lit(255)), F.array(F.lit(255), F.lit(255)))) == 0.5


def test_resampling(spark):
    s = Z.scale((640, 480), (1280, 720), "add_border")
    assert (s.left, s.right, s.top, s.x, s.y) == (106, 106, 0, 1280 / 852, 1.5)
    assert Z.scale((848, 480), (1280, 720)).stretch == 1.0
    two = Z.Scale(2.0, 1.5)
    text = "{\\clip(1,2,3,4)\\t(0,5,\\bord2)\\p1}m 1 1 x l 3.1 2{\\p0}a 1 2{\\clip(m 1 1)\\fs+2\\move(1,1,2,2,5,6)}"
    assert one(spark, Z.resample_text(F.lit(text), two)) == "{\\clip(2,3,6,6)\\t(0,5,\\bord3)\\p1}m 2 1.5 l 6.25 3{\\p0}a 1 2{\\clip(m 2 1.5)\\fs+2\\move(2,1.5,4,3,5,6)}"
    rows = spark.createDataFrame([(True, "template", "{\\fs2}", 4), (False, "", "{\\fs2}", 0)], "comment boolean, effect string, text string, margin_v int")
    assert [(r.text, r.margin_v) for r in Z.resample_lines(rows, two).collect()] == [("{\\fs2}", 4), ("{\\fs3}", 0)]
    styles = spark.createDataFrame([(21.0, 1.0, 100.0, 3)], "fontsize double, outline_w double, scalex double, margin_l int")
    assert tuple(Z.resample_styles(styles, two).first()) == (32.0, 1.5, 100.0, 6)


def test_ambiguous_bounds(spark):
    f = spark.createDataFrame([(1, 3, 0.0), (1, 5, 0.0), (1, 6, 0.9), (1, 7, 0.9)], "scan_id int, frame int, coverage double")
    b = spark.createDataFrame([(1, 6), (1, 3), (1, 4)], "scan_id int, frame int")
    assert {r.frame: r.ambiguous for r in V.ambiguous(f, b, 0.5).collect()} == {6: True, 3: False, 4: True}
