"""Romanised syllables against Japanese writing: readings of kana, matching of lyrics, cutting into sung units."""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWELS = "aiueo"
#: Rows of the syllabary by consonant, a dot where a row has none
ROWS = {
    "": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど",
    "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "y": "や.ゆ.よ", "r": "らりるれろ", "w": "わゐ.ゑを",
}
#: Readings that differ from their row and column
READ_AS = {"si": "shi", "zi": "ji", "ti": "chi", "di": "ji", "tu": "tsu", "du": "zu", "hu": "fu"}
#: Small vowels, readings of the doubling and of the nasal sign, particles
SMALL = {"a": "ぁ", "i": "ぃ", "u": "ぅ", "e": "ぇ", "o": "ぉ"}
SIGNS = {"っ": "ckpst", "ん": "mn"}
PARTICLES = {"は": "wa", "へ": "e"}
#: Sounds that only katakana write, a base with the small vowels it takes
FOREIGN = {"ye": "イェ", "wi": "ウィ", "we": "ウェ", "wo": "ウォ", "she": "シェ", "je": "ジェ", "che": "チェ", "tsa": "ツァ", "tsi": "ツィ", "tse": "ツェ", "tso": "ツォ",
           "ti": "ティ", "tu": "テゥ", "tyu": "テュ", "di": "ディ", "du": "デゥ", "dyu": "デゥ", "fa": "ファ", "fi": "フィ", "fe": "フェ", "fo": "フォ", "fyu": "フュ",
           "vu": "ヴ", "va": "ヴァ", "vi": "ヴィ", "ve": "ヴェ", "vo": "ヴォ", "vya": "ヴャ", "vyu": "ヴュ", "vyo": "ヴョ"}


def _readings() -> set[tuple[str, str]]:
    """(kana, reading) by rule: rows and columns, contracted sounds, small vowels, signs; katakana are 0x60 further on."""
    plain = {(ch, READ_AS.get(c + v, c + v)) for c, row in ROWS.items() for v, ch in zip(VOWELS, row) if ch != "."}
    joined = set()
    for c, row in ROWS.items():
        if c and c not in "yw":
            stem = READ_AS.get(c + "i", c + "yi")[:-1]
            joined |= {(row[1] + small, stem + v) for small, v in zip("ゃゅょ", "auo")}
    both = plain | joined | {(ch, v) for v, ch in SMALL.items()} | {(ch, x) for ch, names in SIGNS.items() for x in names}
    katakana = {("".join(chr(ord(x) + 0x60) for x in ch), r) for ch, r in both}
    return both | katakana | set(PARTICLES.items()) | {(ch, r) for r, ch in FOREIGN.items()} | {("ー", v) for v in VOWELS}


KANA_OF: dict[str, list[str]] = defaultdict(list)
READINGS_OF: dict[str, list[str]] = defaultdict(list)
for _kana, _reading in sorted(_readings()):
    KANA_OF[_reading].append(_kana)
    READINGS_OF[_kana].append(_reading)

#: Written characters that one sung character may stand for, and characters looked ahead
LONGEST_READING = 5
AHEAD = 3


def _alike(a: str, b: str) -> bool:
    """Equal but for case, width and accents."""
    base = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return base(a) == base(b)


def match_first(source: list[str], dest: list[str]) -> tuple[int, int]:
    """How many of the syllables, and how many characters of the written text, belong together at their start. The first syllable
    is read along the text; where it can't, a later syllable that the text shows within three characters tells how far it goes."""
    if not source:
        return 0, 0
    left, at = source[0].lower(), 0
    while True:
        left = left.lstrip()
        while at < len(dest) and dest[at].isspace():
            at += 1
        if at == len(dest):
            return len(source), at
        if not left:
            return 1, at
        head = regex.match(r"\X", left)[0]
        if _alike(head, dest[at]):
            left, at = left[len(head) :], at + 1
            continue
        sound = next((left[:n] for n in (3, 2, 1) if left[:n] in KANA_OF), "")
        here = "".join(dest[at : at + 2])
        kana = next((k for k in KANA_OF.get(sound, ()) if here.startswith(k)), None)
        if kana is None:
            break
        left, at = left[len(sound) :], at + len(regex.findall(r"\X", kana))
    if at == len(dest) - 1:
        return len(source), at + 1
    sung = [s for s in source if s.strip()]
    for skipped in range(1, AHEAD + 1):
        if at + skipped >= len(dest):
            break
        char = dest[at + skipped]
        sounds = READINGS_OF.get(char + "".join(dest[at + skipped + 1 : at + skipped + 2]), []) + READINGS_OF.get(char, [])
        for k, s in enumerate(sung[1 : skipped * LONGEST_READING], start=1):
            if s.startswith(char) or s.lower().startswith(tuple(sounds)):
                return (1, at + skipped) if k == 1 else (int(k / skipped + 0.5), at + 1)
    return 1, max(at, 1)


def match_all(source: list[str], text: str) -> list[tuple[int, str]]:
    """(syllables, written text) pairs until either is used up. Text that is left joins the last pair, syllables that are left too."""
    dest, out = regex.findall(r"\X", text), []
    while source and dest:
        n, m = match_first(source, dest)
        out.append([n, "".join(dest[:m])])
        source, dest = source[n:], dest[m:]
    if out:
        out[-1] = [out[-1][0] + len(source), out[-1][1] + "".join(dest)]
    return [tuple(x) for x in out]


def matched(syllables: Column | str, text: Column | str) -> Column:
    """match_all of an array of syllables and a text; null if either is."""

    @F.pandas_udf("array<struct<syllables:int,text:string>>")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else [{"syllables": n, "text": x} for n, x in match_all(list(a), b)] for a, b in zip(s, t)])

    return run(syllables, text)


def copy_timing(syllables: DataFrame, written: DataFrame) -> DataFrame:
    """(file_id, id, text) of written lines (file_id, id, source_id, text) with the durations of the timed syllables of source_id
    (file_id, id, idx, text, duration_ms). Lines without syllables are left out."""
    row = F.sort_array(F.collect_list(F.struct("idx", F.col("text").alias("t"), F.col("duration_ms").alias("ms"))))
    sung = syllables.groupBy("file_id", F.col("id").alias("source_id")).agg(row.alias("_s"))
    rows = written.join(sung, ["file_id", "source_id"]).withColumn("_m", matched(F.transform("_s", lambda x: x["t"]), "text"))
    taken = lambda i: F.aggregate(F.slice("_m", 1, i), F.lit(0), lambda a, x: a + x["syllables"])
    time = lambda x, i: F.aggregate(F.slice("_s", taken(i) + 1, x["syllables"]), F.lit(0), lambda a, y: a + y["ms"].cast("int"))
    one = lambda x, i: F.concat(F.lit("{\\k"), F.floor((time(x, i) + 5) / 10).cast("string"), F.lit("}"), x["text"])
    return rows.select("file_id", "id", F.array_join(F.transform("_m", one), "").alias("text"))


# ---------------------------------------------------------------- sung units

#: Classes of characters, as contents of brackets in patterns
SPACE = " \t　"
REPEAT = "#＃"
OPENING = "(\\[<‘“〈《「『【〔〖〘〚〝（［｛"
CLOSING = ")\\]>’”〉》」』】〕〗〙〛〞〟）］｝"
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮｧ-ｮ"
VOICING = "゙゚"
LONG = "ーｰ"
DOUBLING = "っッｯ"
KANA = "぀-ゟ゠-ヿㇰ-ㇿｦ-ﾟ"
IDEOGRAPHS = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002ebef"
PUNCTUATION = "\x00-\x08\x0a-\x1f!-/:-@\\[-`{-\x7f、-〿！，．？"
O_ROWS = ("こごそぞとどのほぼぽもよょろを", "コゴソゾトドノホボポモヨョロヲ")


def word_units(c: Column | str) -> Column:
    """Words between spaces; a bar cuts and goes, two bars are an empty unit, a repeat sign is a unit. One empty unit if there is none."""
    found = F.regexp_extract_all(c, F.lit(rf"\|[{SPACE}]*\||\||[{REPEAT}]|[^|{SPACE}{REPEAT}]+"), 0)
    units = F.transform(F.filter(found, lambda x: x != "|"), lambda x: F.when(x.startswith("|"), "").otherwise(x))
    return F.when(F.size(units) > 0, units).otherwise(F.array(F.lit("")))


def _classes() -> list[tuple[str, regex.Pattern]]:
    one = lambda chars: regex.compile(f"[{chars}]")
    names = [("bar", "|"), ("repeat", REPEAT), ("opening", OPENING), ("closing", CLOSING), ("space", SPACE), ("tail", VOICING + SMALL_KANA + PUNCTUATION), ("kana", KANA), ("ideograph", IDEOGRAPHS), ("roman", "0-9A-Za-z")]
    return [(n, one(chars)) for n, chars in names]


_CLASSES = _classes()
_O_BEFORE = [(u, regex.compile(f"[{row}{SMALL_KANA}]$")) for u, row in zip("うウ", O_ROWS)]
_LONG_OR_DOUBLED = regex.compile(f"[{LONG}{DOUBLING}]")


def kana_units(text: str, spaces: bool = False, song: bool = False) -> list[str]:
    """Units of sung Japanese. A kana or, for songs, an ideograph begins a unit; small kana, voicing signs, punctuation and letters
    of one run join the unit before. Bars cut as in word_units; spaces join the unit before, or are units (spaces). For songs, opening
    brackets join what follows, closing ones what stands before, repeat signs are units, and long vowels, doubled consonants and
    the u after an o join what stands before."""
    units: list[str] = []
    waiting = ""  # opening brackets
    for char in regex.findall(r"\X", text):
        kind = next((n for n, p in _CLASSES if p.match(char) and (song or n not in ("repeat", "opening", "closing", "ideograph"))), "other")
        before = units[-1] if units else ""
        if kind == "opening":
            waiting += char
            continue
        if waiting and kind == "closing":
            waiting += char
            continue
        if waiting and kind in ("bar", "repeat", "space"):
            units.append(waiting)
            before = waiting
            waiting = ""
        if kind == "bar" and before == "|":
            units[-1] = ""
            continue
        if kind == "bar" or kind == "repeat" or waiting or not before:
            join = False
        elif kind == "closing":
            join = before not in tuple(REPEAT + SPACE)
        elif kind == "space":
            join = not spaces
        elif kind == "tail":
            join = True
        elif kind == "kana":
            join = song and (bool(_LONG_OR_DOUBLED.match(char)) or any(char == u and p.search(before) for u, p in _O_BEFORE))
        elif kind == "ideograph":
            join = False
        elif kind == "roman":
            join = bool(regex.match("[0-9A-Za-z]", before))
        else:
            join = song or not regex.search(f"[{KANA}]$", before)
        if join:
            units[-1] += char
        else:
            units.append(waiting + char)
            waiting = ""
    units = [u for u in units + [waiting] * bool(waiting) if u != "|"]
    return units or [""]


def sung_units(c: Column | str, spaces: bool = False, song: bool = False) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else kana_units(t, spaces, song))

    return run(c)


def evenly(lines: DataFrame, units: Column) -> DataFrame:
    """Syllables from units, in order, whose ends share the line's time evenly, rounded to 10 ms and kept within the line."""
    rows = lines.select("file_id", "id", "start_ms", "end_ms", units.alias("_u")).withColumn("_n", F.size("_u"))
    rows = rows.select("*", F.posexplode("_u").alias("idx", "text"))
    a, b = F.col("start_ms"), F.col("end_ms")
    span = F.greatest(b - a, F.lit(0)).cast("bigint")
    put = lambda k: F.greatest(a, F.least(b, (F.floor((a + F.floor(span * k / F.col("_n")) + 5) / 10) * 10).cast("int")))
    start = F.when(F.col("idx") == 0, a).otherwise(put(F.col("idx")))
    end = F.when(F.col("idx") == F.col("_n") - 1, F.greatest(start, b)).otherwise(put(F.col("idx") + 1))
    out = rows.withColumns({"syl_start_ms": start, "_e": end, "tag": F.lit("k"), "tags": F.lit("")})
    return out.withColumn("duration_ms", F.col("_e") - F.col("syl_start_ms")).select("file_id", "id", "start_ms", "end_ms", "idx", "tag", "duration_ms", "text", "tags", "syl_start_ms")
