import struct
import wave

import numpy as np
from pyspark.sql import functions as F
from test_functions import lines
from test_sources import files

from lineweave.operators.styles import synonyms
from lineweave.sources import charsets as C
from lineweave.sources import readers as R
from lineweave.sources import sound as S
from lineweave.sources import stl as L
from lineweave.sources import ttxt as T


def test_ttxt_reader(spark):
    new = '<TextStream version="1.1"><TextStreamHeader/><TextSample sampleTime="00:00:01.000">a\r\nb</TextSample><TextSample sampleTime="00:00:02.500"/><TextSample sampleTime="00:00:04.000">c &amp; d</TextSample></TextStream>'
    old = """<TextStream version="1.0"><TextSample sampleTime="00:00:01.000" text="'one' 'two'"/><TextSample sampleTime="00:00:03.000" text="x"/></TextStream>"""
    df = files(spark, new, old, "<a", '<TextStream version="2"/>', '<Other version="1.1"/>')
    got = [tuple(r) for r in T.ttxt_lines(df).orderBy("file_id", "row_no").collect()]
    assert got == [("f0", 0, 1000, 2500, "a\\Nb"), ("f0", 1, 4000, 35999990, "c & d"), ("f1", 0, 1000, 3000, "one\\Ntwo")]
    assert sorted(r.file_id for r in T.problems(df).collect()) == ["f2", "f3", "f4"]


def test_ttxt_round_trip(spark):
    df = lines(spark, [(0, 1000, "{\\b1}a<b"), (1000, 2000, "c\\Nd & e"), (3000, 4500, "f")])
    content = T.ttxt(df)
    assert content.first().content.count("<TextSample ") == 5  # three lines, a gap, the end
    back = T.ttxt_lines(content).orderBy("row_no").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in back] == [(0, 1000, "a<b"), (1000, 2000, "c\\Nd & e"), (3000, 4500, "f")]


def wav(tmp_path, width, channels, data):
    path = str(tmp_path / f"{width}{channels}.wav")
    with wave.open(path, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(8000), f.writeframes(data)
    return open(path, "rb").read()


def test_sound(spark, tmp_path):
    two = wav(tmp_path, 2, 2, np.array([1, -2, 300, -32768, 5, 6], "<i2").tobytes())
    three = wav(tmp_path, 3, 1, b"\xff\xff\xff\x00\x00\x80\x01\x00\x00")
    one = wav(tmp_path, 1, 1, b"\x00\x80\xff")
    chunk = lambda name, tail, body: name + tail + struct.pack("<Q", len(body) + 24) + body + b"\0" * (-len(body) % 8)
    inner = chunk(b"fmt ", S.TAIL, struct.pack("<HHIIHH", 1, 1, 44100, 0, 2, 16)) + chunk(b"data", S.TAIL, struct.pack("<3h", 7, -8, 9))
    long = b"riff" + S.RIFF_TAIL + struct.pack("<Q", 40 + len(inner)) + b"wave" + S.TAIL + inner
    given = {"two": two, "three": three, "one": one, "long": long, "cut": two[:-6], "none": two[:20], "text": b"hello", "packed": two[:20] + b"\x02" + two[21:]}
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "file_id string, content binary")
    rows = S.sound(df, 2).orderBy("file_id", "at").collect()
    of = lambda k: [(r.channels, r.rate, r.sample_bytes, r.at, r.samples) for r in rows if r.file_id == k]
    assert of("two") == [(2, 8000, 2, 0, [1, -2, 300, -32768]), (2, 8000, 2, 2, [5, 6])]
    assert of("three") == [(1, 8000, 3, 0, [-1, -8388608]), (1, 8000, 3, 2, [1])]
    assert of("one") == [(1, 8000, 1, 0, [0, 128]), (1, 8000, 1, 2, [255])] and of("long") == [(1, 44100, 2, 0, [7, -8]), (1, 44100, 2, 2, [9])]
    assert of("cut") == [(2, 8000, 2, 0, [1, -2])]
    assert {r.file_id for r in rows if r.problem} == {"none", "text", "packed"}
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.wav").write_bytes(two)
    assert [(r.file_id, r.at) for r in S.read_sound(spark, str(path)).collect()] == [("a.wav", 0)]


def test_charsets(spark):
    words = {"utf-8": "naïve だ", "shift_jis": "これはテストです", "euc-kr": "안녕하세요 세계", "gb18030": "这是一个测试文本", "utf-16-le": "plain text", "cp1252": "café crème brûlée"}
    df = spark.createDataFrame([(k, v.encode(k)) for k, v in words.items()] + [("binary", b"\x00\x01\x02\x00\x00\x07\x09"), ("marked", "é".encode("utf-8-sig")), ("none", None), ("empty", b"")], "k string, b binary")
    got = {r.k: (r.c, r.t) for r in df.select("k", C.charset("b").alias("c"), C.decoded("b").alias("t")).collect()}
    assert {k: got[k] for k in words} == {k: (k, v) for k, v in words.items()}
    assert got["binary"] == ("binary", None) and got["marked"] == ("utf-8", "é") and got["none"] == (None, None) and got["empty"] == ("utf-8", "")
    assert df.where("k = 'cp1252'").select(C.decoded("b", "latin-1")).first()[0] == words["cp1252"]


def test_thesaurus(spark):
    dat = b"UTF-8\ncat|2\nn|feline|kitty||tom\r\n|gossip|chat\ndog|1\n\nbad\n"
    idx = "UTF-8\n4\ncat|6\ndog|%d\nbad|%d\nfar|9999\nx|1|2\n" % (dat.index(b"dog"), dat.index(b"bad"))
    df = spark.createDataFrame([(idx.encode(), dat)], "idx binary, dat binary")
    got = C.thesaurus(df)
    assert sorted(map(tuple, got.collect())) == [("cat", "gossip", "chat"), ("cat", "n feline", "kitty"), ("cat", "n feline", "tom")]
    assert synonyms(spark.createDataFrame([("Cat",)], "word string"), got.where(F.col("meaning") == "gossip")).first().synonym == "chat"


def test_stl(spark):
    df = lines(spark, [(0, 1000, r"a{\i1}b é\Nc{\u1}"), (2000, 3000, r"{\an8}" + "x" * 112), (4000, 5000, "one two three")])
    styles = spark.createDataFrame([(0, 0, "Default", 2, False, False)], "file_id int, ord int, name string, alignment int, italic boolean, underline boolean")
    info = spark.createDataFrame([(0, "Title", "Tïtle")], "file_id int, key string, value string")
    styles, info = (t.withColumn("file_id", F.lit(df.first().file_id)) for t in (styles, info))
    raw = L.stl(df, styles, info, L.Settings(row_length=9, offset="01000000")).first().content
    head, body = raw[:1024], [raw[k : k + 128] for k in range(1024, len(raw), 128)]
    assert len(raw) == 1024 + 128 * len(body) and head[:16] == b"850STL25.0100000" and head[16:48].rstrip() == "Tïtle".encode("cp850")
    assert head[238:248] == b"    4    3" and head[272 - 16 : 272] == b"0100000001000000"
    assert [(b[3], b[1]) for b in body] == [(255, 0), (0, 1), (255, 1), (255, 2)]
    assert body[0][16:].rstrip(b"\x8f") == b"a\x80b \xc2e\x8a\x80c\x82" and body[0][5:13] == bytes([1, 0, 0, 0, 1, 0, 1, 0]) and body[0][13:16] == bytes([99, 2, 0])
    assert body[1][16:] == b"x" * 112 and body[2][16:] == b"\x8f" * 112 and body[1][13:15] == bytes([0, 2])
    assert body[3][16:].rstrip(b"\x8f").split(b"\x8a") in ([b"one two ", b"three"], [b"one ", b"two three"])
    long = df.where("start_ms = 4000")
    plain = L.stl(long, styles, settings=L.Settings(table="U8", row_length=5, wrap="skip", display=1)).first().content
    assert plain[1024 + 16 : 1024 + 18] == b" \x8f" and plain[12:14] == b"U8"


def test_iso6937():
    assert L.iso6937("Åé ß£ñ中") == b"\xcaA\xc2e \xfb\xa3\xc4n?"


def test_srt(spark):
    t = "00:00:0%d,000 --> 00:00:0%d,500"
    good = "\n".join(["", "1", t % (1, 1), "a", "2", "", "b", "", "2", t % (2, 2), "", "c", "", "", t % (3, 3), "7", "", ""])
    bad = ["x\n", "1\nnope\n", "1\n" + t % (1, 1) + "\n", "1", "1\n" + t % (1, 1) + "\na\n\n5\nb\n"]
    df = files(spark, good, *bad, "\n\n", "1\n" + t % (1, 1) + "\n<b>x</b>")
    got = [tuple(r) for r in R.srt_lines(df).orderBy("file_id", "row_no").collect()]
    assert got == [("f0", 0, 1000, 1500, "a\\N2\\N\\Nb"), ("f0", 1, 2000, 2500, "\\Nc"), ("f0", 2, 3000, 3500, "7"), ("f7", 0, 1000, 1500, "{\\b1}x{\\b}")]
    assert sorted(r.file_id for r in R.srt_problems(df).collect()) == ["f1", "f2", "f3", "f4", "f5"]
