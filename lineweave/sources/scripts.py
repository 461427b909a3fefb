"""Whole scripts: every section as a table, and tables written back as a script."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import inline_decode, inline_encode, uudecode, uuencode
from lineweave.functions.times import format_ass, parse

# Names of sections, in lower case, and what their lines are.
_SECTIONS = {"[script info]": "info", "[v4 styles]": "style4", "[v4+ styles]": "style", "[events]": "event", "[fonts]": "font", "[graphics]": "graphic"}
# Sections that begin with the name of the program that wrote them.
_NAMED = re.compile(r"\[\S+ (?:(project garbage)|extradata)\]")
# Keys that are properties of the project wherever they stand; in script info some have a longer name.
_PROPERTIES = ("Automation Scripts", "Export Filters", "Export Encoding", "Last Style Storage", "Audio URI", "Audio File", "Video File", "Timecodes File", "Keyframes File", "Video Zoom Percent", "Scroll Position", "Active Line", "Video Position", "Video AR Mode", "Video AR Value")
_OLD_PROPERTY = r"^\S+ (Video Zoom Percent|Scroll Position|Active Line|Video Position)$"
_VERSIONS = {"v4.00": 0, "v4.00+": 1}
# The fields of a style and their order; the older layout has the second row.
STYLE = "name font fontsize primary secondary outline shadow bold italic underline strikeout scalex scaley spacing angle borderstyle outline_w shadow_w alignment margin_l margin_r margin_v encoding".split()
STYLE4 = "name font fontsize primary secondary tertiary shadow bold italic borderstyle outline_w shadow_w alignment margin_l margin_r margin_v alpha encoding".split()
# The older layout's alignments as those of the number pad.
_ALIGN4 = {1: 1, 2: 2, 3: 3, 5: 7, 6: 8, 7: 9, 9: 4, 10: 5, 11: 6}
ENTRIES = "file_id string, ok boolean, kind string, ord int, key string, value string, data binary"
FORMAT_STYLE = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
FORMAT_EVENT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def _entries(content: str) -> Iterator[tuple[str, str | None, str | None, bytes | None]]:
    """(kind, key, value, data) of what a script's lines say. A script type that isn't known is a ValueError."""
    section, version = "info", 1
    held: tuple[str, str, list[str]] | None = None  # kind, file name and lines of an attachment
    for line in content.split("\n"):
        if held is not None:
            named = line.startswith(("fontname: ", "filename: "))
            if not named and 0 < len(line) <= 80 and all("!" <= c <= "`" for c in line):
                held[2].append(line)
                if len(line) == 80:
                    continue
            yield held[0], held[1], None, uudecode("".join(held[2]))
            ended, held = bool(held[2]) and held[2][-1] is line, None
            if ended:
                continue
        if line.startswith("[") and line.endswith("]"):
            named = _NAMED.fullmatch(line.lower())
            section = _SECTIONS.get(line.lower(), ("property" if named[1] else "extradata") if named else "")
            version = {"style4": 0, "style": 1}.get(section, version)
            section = "style" if section == "style4" else section
        elif section in ("font", "graphic") and line.startswith({"font": "fontname: ", "graphic": "filename: "}[section]):
            held = (section, line.split(": ", 1)[1], [])
        elif section == "event" and line.startswith(("Dialogue:", "Comment:")):
            yield "event", line.split(":", 1)[0], line.split(":", 1)[1].lstrip(), None
        elif section == "style" and line.startswith("Style:"):
            yield f"style{version}", None, line[6:].lstrip(), None
        elif section == "extradata" and (m := re.fullmatch(r"Data:\s*(\d+),([^,]+),(.)(.*)", line)):
            value = {"e": inline_decode, "u": lambda v: uudecode(v).decode("utf-8", "replace")}.get(m[3], lambda v: "")(m[4])
            yield "extradata", m[1] + "," + inline_decode(m[2]), value, None
        elif section in ("info", "property") and ":" in line and not (section == "info" and line.startswith((";", "Collisions:"))):
            key, value = line.split(":", 1)
            if section == "info" and key == "ScriptType":
                kind = value.strip().lower()
                if kind not in _VERSIONS:
                    raise ValueError(f"unknown script type {value.strip()}")
                version = _VERSIONS[kind]
            known = key in _PROPERTIES or key.startswith("Automation Settings ") or re.match(_OLD_PROPERTY, key)
            if known or section == "info":
                yield "property" if known else "info", key, value.lstrip(), None
    if held is not None:
        yield held[0], held[1], None, uudecode("".join(held[2]))


def entries(files: DataFrame) -> DataFrame:
    """ENTRIES of scripts (file_id, content): a row for each thing that a script says, numbered by kind. A script that can't be read
    has one row with ok = false and the reason as its value."""

    def run(batches):
        for p in batches:
            rows = []
            for file, content in zip(p.file_id, p.content):
                try:
                    found = list(_entries(content or ""))
                except ValueError as e:
                    rows.append((file, False, "error", 0, None, str(e), None))
                    continue
                n: dict[str, int] = {}
                for kind, key, value, data in found:
                    own = kind[:5] if kind.startswith("style") else kind
                    rows.append((file, True, kind, n.get(own, 0), key, value, data))
                    n[own] = n.get(own, 0) + 1
            yield pd.DataFrame(rows, columns=["file_id", "ok", "kind", "ord", "key", "value", "data"])

    return files.select("file_id", "content").mapInPandas(run, ENTRIES)


def info(found: DataFrame) -> DataFrame:
    return found.where("kind = 'info'").select("file_id", "ord", "key", "value")


def properties(found: DataFrame) -> DataFrame:
    """(file_id, key, value) of the project; of a key that comes again the last counts, and an older name is the newer one's."""
    rows = found.where("kind = 'property'").withColumn("key", F.regexp_replace("key", _OLD_PROPERTY, "$1"))
    return rows.groupBy("file_id", "key").agg(F.max_by("value", "ord").alias("value"))


def extradata(found: DataFrame) -> DataFrame:
    rows = found.where("kind = 'extradata'")
    id = F.substring_index("key", ",", 1).cast("bigint")
    return rows.select("file_id", id.alias("id"), F.lit(0).alias("expiration"), F.regexp_replace("key", r"^\d+,", "").alias("key"), "value")


def attachments(found: DataFrame) -> DataFrame:
    return found.where("kind in ('font', 'graphic')").select("file_id", "ord", F.col("kind").alias("grp"), F.col("key").alias("filename"), "data")


def _number(c: Column, kind: str = "int") -> Column:
    return F.coalesce(F.trim(c).try_cast("double").cast(kind), F.lit(0).cast(kind))


def _margin(c: Column) -> Column:
    return F.greatest(F.least(_number(c), F.lit(99999)), F.lit(-9999))


def _channels(c: Column) -> Column:
    """A colour in any of its writings, as AABBGGRR in hexadecimal digits: &H.. or a whole number, which may be negative."""
    hexa = F.lpad(F.upper(F.regexp_extract(c, "(?i)&H([0-9a-f]+)", 1)), 8, "0")
    whole = F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))
    return F.when(c.rlike("(?i)&H"), F.right(hexa, F.lit(8))).otherwise(F.lpad(F.hex(F.pmod(whole, F.lit(1 << 32))), 8, "0"))


def styles(found: DataFrame) -> DataFrame:
    """Styles of both layouts as one table; rows with too few fields are left out. In the older one the outline's colour is the
    shadow's, scales are 100, there is no underline, and alignments are other numbers."""
    rows = found.where("kind in ('style0', 'style1')").withColumn("f", F.split("value", ","))
    new = F.col("kind") == "style1"
    rows = rows.where(F.size("f") >= F.when(new, len(STYLE)).otherwise(len(STYLE4)))
    at = lambda name: F.when(new, F.get("f", F.lit(STYLE.index(name)))).otherwise(F.get("f", F.lit(STYLE4.index(name))) if name in STYLE4 else F.lit(None).cast("string"))
    color = lambda name: F.when(new, _channels(at(name))).otherwise(F.concat(F.lit("00"), F.right(_channels(F.get("f", F.lit(STYLE4.index("shadow" if name == "outline" else name)))), F.lit(6))))
    align4 = F.element_at(F.create_map(*(F.lit(x) for kv in _ALIGN4.items() for x in kv)), _number(at("alignment")))
    out = {"name": F.trim(at("name")), "font": F.trim(at("font")), "fontsize": _number(at("fontsize"), "double")}
    out |= {c: color(c) for c in ("primary", "secondary", "outline", "shadow")}
    out |= {c: F.coalesce(_number(at(c)) != 0, F.lit(False)) for c in ("bold", "italic", "underline", "strikeout")}
    out |= {c: F.when(new, _number(at(c), "double")).otherwise(100.0 if c.startswith("scale") else 0.0) for c in ("scalex", "scaley", "spacing", "angle")}
    out |= {"borderstyle": _number(at("borderstyle")), "outline_w": _number(at("outline_w"), "double"), "shadow_w": _number(at("shadow_w"), "double")}
    out |= {"alignment": F.when(new, _number(at("alignment"))).otherwise(F.coalesce(align4, F.lit(2)))}
    out |= {c: _margin(at(c)) for c in ("margin_l", "margin_r", "margin_v")} | {"encoding": _number(at("encoding"))}
    return rows.select("file_id", "ord", *(v.alias(k) for k, v in out.items()))


def lines(found: DataFrame) -> DataFrame:
    """Event lines. A text that begins with {=1=2} refers to extradata by these ids; rows with too few fields are left out."""
    rows = found.where("kind = 'event'").withColumn("f", F.split("value", ",", 10)).where("size(f) = 10")
    f = lambda k: F.get("f", F.lit(k))
    ids = F.regexp_extract(f(9), r"^\{(=\d+(?:=\d+)*)\}", 1)
    w = Window.partitionBy("file_id").orderBy("ord")
    return rows.select(
        "file_id",
        (F.row_number().over(w) - 1).cast("bigint").alias("id"),
        (F.row_number().over(w) - 1).alias("row_no"),
        (F.col("key") == "Comment").alias("comment"),
        F.greatest(F.coalesce(F.regexp_extract(f(0), r"(\d+)\s*$", 1).try_cast("int"), F.lit(0)), F.lit(0)).alias("layer"),
        parse(f(1)).alias("start_ms"),
        parse(f(2)).alias("end_ms"),
        F.trim(f(3)).alias("style"),
        F.trim(f(4)).alias("actor"),
        *(_margin(f(k)).alias(c) for k, c in ((5, "margin_l"), (6, "margin_r"), (7, "margin_v"))),
        F.trim(f(8)).alias("effect"),
        F.when(ids == "", F.array().cast("array<bigint>")).otherwise(F.split(F.substring(ids, 2, 1 << 20), "=").cast("array<bigint>")).alias("extradata_ids"),
        F.regexp_replace(f(9), r"^\{=\d+(?:=\d+)*\}", "").alias("text"),
    )


def style_catalog(files: DataFrame) -> DataFrame:
    """Styles of catalogs: files with one style a line; lines that are none are left out."""
    rows = files.select("file_id", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line")).where(F.col("line").startswith("Style:"))
    found = rows.select("file_id", F.lit(True).alias("ok"), F.lit("style1").alias("kind"), "ord", F.lit(None).cast("string").alias("key"), F.ltrim(F.substring("line", 7, 1 << 20)).alias("value"), F.lit(None).cast("binary").alias("data"))
    return styles(found)


# ---------------------------------------------------------------- writing


def _plain(c: str, decimals: int = 3) -> Column:
    return F.regexp_replace(F.format_string(f"%.{decimals}f", F.col(c).cast("double")), r"\.?0+$", "")


def style_line(old: bool = False) -> Column:
    """The style line of a row of styles()."""
    flag = lambda c: F.when(F.col(c), "-1").otherwise("0")
    color = lambda c: F.concat(F.lit("&H"), F.col(c))
    comma = lambda c: F.replace(c, F.lit(","), F.lit(";"))
    s = lambda c: F.col(c).cast("string")
    if old:
        whole = lambda c: F.conv(F.right(c, F.lit(6)), 16, 10)
        align = F.element_at(F.create_map(*(F.lit(x) for a, b in _ALIGN4.items() for x in (b, a))), F.col("alignment"))
        fields = [comma("name"), comma("font"), _plain("fontsize"), whole("primary"), whole("secondary"), F.lit("0"), whole("shadow"), flag("bold"), flag("italic"), s("borderstyle"), _plain("outline_w"), _plain("shadow_w"), F.coalesce(align, F.lit(2)).cast("string"), s("margin_l"), s("margin_r"), s("margin_v"), F.lit("0"), s("encoding")]
    else:
        fields = [comma("name"), comma("font"), _plain("fontsize"), *(color(c) for c in ("primary", "secondary", "outline", "shadow")), *(flag(c) for c in ("bold", "italic", "underline", "strikeout")), *(_plain(c) for c in ("scalex", "scaley", "spacing", "angle")), s("borderstyle"), _plain("outline_w"), _plain("shadow_w"), *(s(c) for c in ("alignment", "margin_l", "margin_r", "margin_v", "encoding"))]
    return F.concat(F.lit("Style: "), F.concat_ws(",", *fields))


def event_line() -> Column:
    comma = lambda c: F.replace(c, F.lit(","), F.lit(";"))
    ids = F.when(F.size("extradata_ids") > 0, F.concat(F.lit("{="), F.array_join(F.col("extradata_ids").cast("array<string>"), "="), F.lit("}"))).otherwise("")
    fields = [F.col("layer").cast("string"), format_ass("start_ms"), format_ass("end_ms"), comma("style"), comma("actor"), *(F.col(c).cast("string") for c in ("margin_l", "margin_r", "margin_v")), comma("effect"), F.concat(ids, F.regexp_replace("text", "[\r\n]", ""))]
    return F.concat(F.when(F.col("comment"), "Comment: ").otherwise("Dialogue: "), F.concat_ws(",", *fields))


def _extradata_line() -> Column:
    def one(i: int, k: str, v: str) -> str:
        raw, safe = v.encode(), inline_encode(v)
        return f"Data: {i},{inline_encode(k)}," + (f"u{uuencode(raw)}".replace("\r\n", "") if 4 * len(raw) < 3 * len(safe.encode()) else f"e{safe}")

    @F.pandas_udf("string")
    def run(id: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(id, key, value)])

    return run("id", "key", "value")


def _attachment() -> Column:
    @F.pandas_udf("string")
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: uuencode(bytes(d)).replace("\r\n", "\n"))

    return run("data")


def script(info: DataFrame, properties: DataFrame | None = None, styles: DataFrame | None = None, attachments: DataFrame | None = None, lines: DataFrame | None = None, extradata: DataFrame | None = None, program: str = "Lineweave") -> DataFrame:
    """(file_id, content): scripts of the tables of this module, each section that has rows after the one before, in their order.
    An export leaves properties and extradata out. program: whose name these two sections bear."""
    parts = [info.select("file_id", F.lit(0).alias("s"), F.col("ord").alias("n"), F.concat("key", F.lit(": "), "value").alias("line"))]
    heads = ["[Script Info]"]

    def add(df: DataFrame | None, order: Column, line: Column, head: str) -> None:
        if df is not None:
            parts.append(df.select("file_id", F.lit(len(heads)).alias("s"), order.cast("int").alias("n"), line.alias("line")))
            heads.append(head)

    add(properties, F.rank().over(Window.partitionBy("file_id").orderBy("key")), F.concat("key", F.lit(": "), "value"), f"[{program} Project Garbage]")
    add(styles, F.col("ord"), style_line(), "[V4+ Styles]\n" + FORMAT_STYLE)
    if attachments is not None:
        add(attachments.where("grp = 'font'"), F.col("ord"), F.concat(F.lit("fontname: "), "filename", F.lit("\n"), _attachment()), "[Fonts]")
        add(attachments.where("grp = 'graphic'"), F.col("ord"), F.concat(F.lit("filename: "), "filename", F.lit("\n"), _attachment()), "[Graphics]")
    add(lines, F.col("row_no"), event_line(), "[Events]\n" + FORMAT_EVENT)
    add(extradata, F.col("id"), _extradata_line(), f"[{program} Extradata]")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sections = rows.groupBy("file_id", "s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.element_at(F.array(*map(F.lit, heads)), F.col("s") + 1)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", F.concat(head, F.lit("\n"), "body").alias("t")))), lambda x: x["t"]), "\n\n")
    return sections.groupBy("file_id").agg(F.concat(whole, F.lit("\n")).alias("content"))
