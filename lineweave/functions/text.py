"""Column functions on line texts: markup, counting, search, colours, small codecs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = r"\{[^}]*\}"


def strip_tags(c: Column | str) -> Column:
    """Text without override blocks."""
    return F.regexp_replace(c, BLOCK, "")


def only_tags(c: Column | str) -> Column:
    """The override blocks alone: what clearing a line's text keeps."""
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({BLOCK})"), 1), "")


def convert_newlines(c: Column | str, newline: str = "\n", merge: bool = False) -> Column:
    r"""``\h`` becomes a space, ``\N`` and ``\n`` a line end; merge collapses repeated ones."""
    out = F.regexp_replace(F.replace(c, F.lit("\\h"), F.lit(" ")), r"\\[Nn]", newline)
    return F.regexp_replace(out, f"(?:{re.escape(newline)})+", newline) if merge else out


def strip_html(c: Column | str) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def char_count(c: Column | str, whitespace: bool = True, punctuation: bool = True, blocks: bool = False) -> Column:
    """Code points; the flags say what counts."""
    out = c if blocks else strip_tags(c)
    if not whitespace:
        out = F.regexp_replace(out, r"[\s\p{Z}]", "")
    if not punctuation:
        out = F.regexp_replace(out, r"\p{P}", "")
    return F.length(out)


def max_line_length(c: Column | str) -> Column:
    """Longest of the displayed lines."""
    return F.array_max(F.transform(F.split(strip_tags(c), r"\\[Nn]"), F.length))


def chars_per_second(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """-1 for durations up to 100 ms or shorter than the text has bytes, else characters per second, truncated."""
    duration = F.col(end) - F.col(start) if isinstance(end, str) else end - start
    size = F.octet_length(text)
    return F.when((duration <= 100) | (size > duration), -1).otherwise((char_count(text) * 1000 / F.greatest(duration, F.lit(1))).cast("int"))


def graphemes(c: Column | str) -> Column:
    """User-perceived characters, which no built-in function counts."""
    import regex

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else len(regex.findall(r"\X", t))).astype("Int32")

    return count(c)


def nfc(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return run(c)


def code_points(c: Column | str) -> Column:
    """The characters of a text, one code point each."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def tokens(c: Column | str, separator: str = ",") -> Column:
    """Parts of a text between separators, without white space at their ends."""
    return F.transform(F.split(c, re.escape(separator), -1), lambda x: F.trim(x))


def casefold(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else t.casefold())

    return run(c)


# ---------------------------------------------------------------- colours


def color_channels(bgr: Column | str) -> Column:
    """&HAABBGGRR& or &HBBGGRR& as a struct of r, g, b, a."""
    digits = F.lpad(F.regexp_extract(bgr, "&?H?([0-9A-Fa-f]+)&?", 1), 8, "0")
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.struct(part(7).alias("r"), part(5).alias("g"), part(3).alias("b"), part(1).alias("a"))


def color_override(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("&H%02X%02X%02X&", b.cast("int"), g.cast("int"), r.cast("int"))


def color_style(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.format_string("&H%02X%02X%02X%02X", a.cast("int"), b.cast("int"), g.cast("int"), r.cast("int"))


def color_html(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


#: Luma weights of red and blue for each matrix
LUMA = {"601": (0.299, 0.114), "709": (0.2126, 0.0722), "FCC": (0.3, 0.11), "240M": (0.212, 0.087)}


def rgb_to_ycbcr(r: Column, g: Column, b: Column, matrix: str = "601", full: bool = False) -> Column:
    """Y, Cb and Cr of 0..255 channels, in TV or full range."""
    kr, kb = LUMA[matrix]
    y = kr * r + (1 - kr - kb) * g + kb * b
    sy, sc, base = (1.0, 1.0, 0) if full else (219 / 255, 224 / 255, 16)
    return F.struct((y * sy + base).alias("y"), ((b - y) / (2 * (1 - kb)) * sc + 128).alias("cb"), ((r - y) / (2 * (1 - kr)) * sc + 128).alias("cr"))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column, matrix: str = "601", full: bool = False) -> Column:
    """Channels 0..255, rounded, of Y, Cb and Cr in TV or full range."""
    kr, kb = LUMA[matrix]
    sy, sc, base = (1.0, 1.0, 0) if full else (219 / 255, 224 / 255, 16)
    level = (y - base) / sy
    r, b = level + (cr - 128) / sc * (2 * (1 - kr)), level + (cb - 128) / sc * (2 * (1 - kb))
    g = (level - kr * r - kb * b) / (1 - kr - kb)
    return F.struct(*(F.greatest(F.least(F.round(c), F.lit(255.0)), F.lit(0.0)).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    hue = F.when(d == 0, 0.0).when(top == r, F.pmod(60 * (g - b) / d, F.lit(360.0))).when(top == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240)
    return F.struct(hue.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), (top / 255).alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Channels 0..255 of a hue in degrees (any turn), saturation and value in 0..1."""

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 60.0, F.lit(6.0))
        return F.round(255 * (v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))


# ---------------------------------------------------------------- small codecs


def uuencode(data: bytes) -> str:
    """Six bits a character from '!' on, 80 characters a line."""
    out = []
    for i in range(0, len(data), 3):
        part = data[i : i + 3]
        n = int.from_bytes(part.ljust(3, b"\0"), "big")
        out += [chr((n >> s & 63) + 33) for s in (18, 12, 6, 0)][: len(part) + 1]
    text = "".join(out)
    return "\r\n".join(text[i : i + 80] for i in range(0, len(text), 80))


def uudecode(text: str) -> bytes:
    codes = [ord(c) - 33 for c in text if 33 <= ord(c) <= 96]
    out = bytearray()
    for i in range(0, len(codes), 4):
        part = codes[i : i + 4]
        n = sum(c << s for c, s in zip(part, (18, 12, 6, 0)))
        out += n.to_bytes(3, "big")[: len(part) - 1]
    return bytes(out)


def inline_encode(text: str) -> str:
    """Control characters and the separators # , : | become #XX."""
    return "".join(f"#{ord(c):02X}" if ord(c) <= 31 or c in "#,:|" else c for c in text)


def inline_decode(text: str) -> str:
    return re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)
