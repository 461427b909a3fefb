"""Subtitle exchange files (EBU Tech 3264): a header of 1,024 bytes, then text blocks of 128."""

from __future__ import annotations

import re
import struct
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.functions.markup import _wrap
from lineweave.functions.tags import parse_block, pieces
from lineweave.functions.times import frame_at, smpte
from lineweave.operators.lines import with_style
from lineweave.sources.writers import merged

#: Codes in texts (off, on), size of a block's text, and header fields as (length, name)
ITALIC, UNDERLINE, ROW_END, UNUSED, FIELD = (b"\x81", b"\x80"), (b"\x83", b"\x82"), b"\x8a", b"\x8f", 112
HEADER = """3 code_page 8 disk_format 1 display 2 character_table 2 language 32 title 32 episode 32 translated_title 32 translated_episode
32 translator 32 translator_contact 16 reference 6 created 6 revised 2 revision 5 blocks 5 subtitles 3 groups 2 row_length 2 rows 1 status
8 start 8 first_cue 1 disks 1 disk 3 country 32 publisher 32 editor 32 editor_contact 75 spare 576 user"""
#: Encodings by number, as Python names them; the first is built from marks that stand before their letter
TABLES = {"0": "iso6937", "1": "iso8859-5", "2": "iso8859-6", "3": "iso8859-7", "4": "iso8859-8"}
MARKS = {"̀": 0xC1, "́": 0xC2, "̂": 0xC3, "̃": 0xC4, "̄": 0xC5, "̆": 0xC6, "̇": 0xC7, "̈": 0xC8, "̊": 0xCA, "̧": 0xCB, "̋": 0xCD, "̨": 0xCE, "̌": 0xCF}
SIGNS = {"¡": 0xA1, "¢": 0xA2, "£": 0xA3, "¥": 0xA5, "§": 0xA7, "‘": 0xA9, "“": 0xAA, "«": 0xAB, "°": 0xB0, "±": 0xB1, "²": 0xB2, "³": 0xB3, "×": 0xB4, "µ": 0xB5, "¶": 0xB6, "·": 0xB7, "÷": 0xB8, "’": 0xB9, "”": 0xBA, "»": 0xBB, "¼": 0xBC, "½": 0xBD, "¾": 0xBE, "¿": 0xBF,
         "Æ": 0xE1, "Ø": 0xE9, "Œ": 0xEA, "Þ": 0xEC, "ı": 0xF5, "Ł": 0xE8, "æ": 0xF1, "đ": 0xF2, "ð": 0xF3, "ł": 0xF8, "ø": 0xF9, "œ": 0xFA, "ß": 0xFB, "þ": 0xFC}
#: Alignments of the older kind as those of the newer
OLD_ALIGNMENT = {1: 1, 2: 2, 3: 3, 5: 7, 6: 8, 7: 9, 9: 4, 10: 5, 11: 6}


def iso6937(text: str) -> bytes:
    """Marks before their letters; ? for what the table lacks."""
    out = bytearray()
    for ch in unicodedata.normalize("NFC", text):
        base, *marks = unicodedata.normalize("NFD", ch)
        if ch in SIGNS:
            out.append(SIGNS[ch])
        elif base < "\x7f" and len(marks) < 2 and all(m in MARKS for m in marks):
            out += bytes([*(MARKS[m] for m in marks), ord(base)])
        else:
            out += b"?"
    return bytes(out)


@dataclass(frozen=True)
class Settings:
    """table: number of the text encoding, or U8 for UTF-8. wrap: a mode of wrap_points, or skip (lines that are too long go) or
    abort (they are an error). display: 0 open, 1 or 2 teletext, which has no codes in texts."""

    rate: int = 25
    drop: bool = False
    table: str = "0"
    row_length: int = 42
    wrap: str = "first_longer"
    display: int = 0
    translate_alignment: bool = True
    inclusive_ends: bool = False
    offset: str = "00000000"
    date: str = "700101"


@dataclass
class Run:
    """Text of one look; word: whether a row may break before it."""

    text: str
    underline: bool
    italic: bool
    word: bool = True


def rows_of(text: str, underline: bool, italic: bool, align: int) -> tuple[list[list[Run]], int]:
    r"""Rows of runs, cut at \N and after spaces, and the alignment that the last \an or \a sets. Comments and drawings go."""
    rows, now = [[Run("", underline, italic)]], [underline, italic]
    for kind, part in pieces(text):
        if kind == "plain":
            for word in re.split(r"(\\N|\\n| )", part.replace("\\t", " ")):
                if word == "\\N":
                    rows.append([Run("", *now)])
                elif word in (" ", "\\n"):
                    rows[-1][-1].text += " "
                    rows[-1].append(Run("", *now))
                else:
                    rows[-1][-1].text += word.replace("\\h", " ")
        elif kind == "override":
            for t in parse_block(part):
                value = t.values[0] if t.values else None
                number = int(m[0]) if (m := re.match(r"\s*-?\d+", value or "")) else None
                if t.name in ("u", "i"):
                    now["ui".index(t.name)] = (underline, italic)["ui".index(t.name)] if value is None else bool(number)
                elif t.name == "an":
                    align = number if number is not None else align
                elif t.name == "a" and value is not None:
                    align = OLD_ALIGNMENT.get(number, 2)
            last = rows[-1][-1]
            if [last.underline, last.italic] != now:
                if last.text:
                    rows[-1].append(Run("", *now, word=False))
                else:
                    last.underline, last.italic = now
    return rows, align


def wrapped(rows: list[list[Run]], most: int, mode: str) -> list[list[Run]]:
    out = []
    for row in rows:
        words: list[list[Run]] = []
        for r in row:
            if r.word or not words:
                words.append([])
            words[-1].append(r)
        cuts = [0, *_wrap([sum(len(r.text.encode()) for r in w) for w in words], most, mode), len(words)]
        out += [[r for w in words[a:b] for r in w] for a, b in zip(cuts, cuts[1:])]
    return out


def _text(rows: list[list[Run]], s: Settings) -> bytes:
    encode = iso6937 if s.table == "0" else lambda t: t.encode("utf-8" if s.table == "U8" else TABLES[s.table], "replace")
    out = []
    for row in rows:
        line, underline, italic = b"", False, False  # every row begins plain
        for r in row:
            if s.display == 0:
                line += UNDERLINE[r.underline] if r.underline != underline else b""
                line += ITALIC[r.italic] if r.italic != italic else b""
                underline, italic = r.underline, r.italic
            line += encode(r.text)
        out.append(line)
    return ROW_END.join(out)


def _places(align: int, rows: int, s: Settings) -> tuple[int, int]:
    """Row and justification. The upper, middle and lower third of alignments are align // 3, as files of this kind have them."""
    first, end = (0, 100) if s.display == 0 else (1, 24)
    if not s.translate_alignment:
        return end - 1, 2
    align = align if 1 <= align <= 9 else 2
    third = align // 3
    row = first if third == 2 else min(first, (end // 2 - end // 5 * rows) % 256) if third == 1 else end - 1
    return row, (align - 1) % 3 + 1


def blocks(number: int, begin: bytes, end: bytes, rows: list[list[Run]], align: int, s: Settings) -> list[bytes]:
    """One subtitle's blocks: those before the last are numbered; a text that fills its last one has one more without text."""
    text = _text(rows, s)
    parts = [text[k : k + FIELD] for k in range(0, len(text), FIELD)]
    if parts and len(parts[-1]) == FIELD:
        parts.append(b"")
    row, justify = _places(align, len(rows), s)
    return [struct.pack("<BHBB4s4sBBB112s", 0, number % 65536, k if k + 1 < len(parts) else 255, 0, begin, end, row, justify, 0, p.ljust(FIELD, UNUSED)) for k, p in enumerate(parts)]


def header(values: dict[str, str]) -> bytes:
    """Fields in order, cut or filled with spaces; letters that the code page lacks are ?."""
    sizes, names = HEADER.split()[::2], HEADER.split()[1::2]
    return b"".join(values.get(n, "").encode("cp850", "replace")[: int(k)].ljust(int(k)) for k, n in zip(sizes, names))


def document(lines: list[dict], info: dict, s: Settings) -> bytes:
    subs = []
    for x in lines:
        rows, align = rows_of(x["text"], bool(x["underline"]), bool(x["italic"]), x["alignment"] or 2)
        if s.wrap in ("skip", "abort"):
            if any(sum(len(r.text.encode()) for r in row) > s.row_length for row in rows):
                if s.wrap == "abort":
                    raise ValueError(f"too long: {x['text']}")
                continue
        else:
            rows = wrapped(rows, s.row_length, s.wrap)
        subs.append((x["begin"], x["end"], rows, align))
    code = lambda t: bytes(int(v) for v in re.findall(r"\d+", t))
    subs = subs or [("00:00:00:00", "00:00:00:00", [[Run(" ", False, False)]], 2)]
    body = [b for n, (a, e, rows, align) in enumerate(subs) for b in blocks(n, code(a), code(e), rows, align, s)]
    rate = {24: "STL24.01", 30: "STL30.01"}.get(s.rate, "STL25.01")
    values = {"code_page": "850", "disk_format": rate, "display": str(s.display), "character_table": s.table.rjust(2, "0"), "language": "00", "title": info.get("Title", ""), "translator": info.get("Original Translation", ""), "editor": info.get("Original Editing", ""),
              "created": s.date, "revised": s.date, "revision": "00", "blocks": f"{len(body):5}", "subtitles": f"{len(subs):5}", "groups": "001", "row_length": f"{s.row_length:02}", "rows": "99", "status": "1", "start": s.offset,
              "first_cue": "".join(re.findall(r"\d+", subs[0][0])), "disks": "1", "disk": "1", "country": "XXX"}
    return header(values) + b"".join(body)


def stl(lines: DataFrame, styles: DataFrame, info: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """(file_id, content binary) of files with a line at least. styles: (file_id, ord, name, alignment, italic, underline); info: (file_id,
    key, value). A line whose style isn't there stands at the bottom, plain. Dates are a setting, so that reruns agree."""
    s = settings or Settings()
    shift = sum(int(s.offset[k : k + 2]) * v * s.rate for k, v in ((0, 3600), (2, 60), (4, 1))) + int(s.offset[6:8])
    at = lambda c, less: smpte(frame_at(c, s.rate, 1) + (shift - less), s.rate, s.drop)
    rows = with_style(merged(lines), styles, ["alignment", "italic", "underline"])
    one = F.struct("row_no", at("start_ms", 0).alias("begin"), at("end_ms", int(s.inclusive_ends)).alias("end"), *(F.coalesce(f"style_{c}", F.lit(v)).alias(c) for c, v in (("alignment", 2), ("italic", False), ("underline", False))), "text")
    per = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(one)).alias("_l"))
    if info is not None:
        per = per.join(info.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_i")), "file_id", "left")
    else:
        per = per.withColumn("_i", F.create_map().cast("map<string,string>"))

    @F.pandas_udf("binary")
    def run(k: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([document(list(x), dict(y) if y is not None else {}, s) for x, y in zip(k, i)])

    return per.select("file_id", run("_l", "_i").alias("content"))
