"""Edits of neighbouring lines, copies as text, extradata of lines, replacing one match, and the columns of a grid."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import chars_per_second, strip_tags
from lineweave.functions.times import format_ass, frame_at, parse, time_at
from lineweave.operators.lines import KEY
from lineweave.operators.windows import by_file, renumber

_TRIM = r"^[ \t\r\n\f\x0b]+|[ \t\r\n\f\x0b]+$"

# ---------------------------------------------------------------- joining and splitting


def join_neighbour(lines: DataFrame, active: DataFrame, after: bool = True) -> DataFrame:
    """Each active line (file_id, id) takes over the next line of its file, or the one before it: both texts without the white
    space at their ends and with one space between, from the earlier start to the later end. Without a neighbour it stays. Of
    lines that follow each other at most one may be active."""
    rows = lines.join(active.select(*KEY, F.lit(True).alias("_on")).distinct(), KEY, "left").withColumn("_on", F.coalesce("_on", F.lit(False)))
    w = by_file()
    here, there = (F.lead, F.lag) if after else (F.lag, F.lead)
    own, other = F.regexp_replace("text", _TRIM, ""), F.regexp_replace(here("text").over(w), _TRIM, "")
    first, second = (own, other) if after else (other, own)
    joined = F.array_join(F.filter(F.array(first, second), lambda x: x != ""), " ")
    has = here("id").over(w).isNotNull() & F.col("_on")
    gone = F.coalesce(there("_on").over(w), F.lit(False))
    new = {
        "_t": F.when(has, joined).otherwise(F.col("text")),
        "_s": F.when(has, F.least("start_ms", here("start_ms").over(w))).otherwise(F.col("start_ms")),
        "_e": F.when(has, F.greatest("end_ms", here("end_ms").over(w))).otherwise(F.col("end_ms")),
        "_gone": gone,
    }
    rows = rows.withColumns(new).where(~F.col("_gone"))
    rows = rows.withColumns({"text": F.col("_t"), "start_ms": F.col("_s"), "end_ms": F.col("_e")})
    return renumber(rows.select(lines.columns))


def split_at_cursor(lines: DataFrame, cursors: DataFrame, how: str = "preserve", frame: int = 0, rate: tuple[int, int] = (25, 1)) -> DataFrame:
    """Each line with a cursor (file_id, id, pos: bytes of its text before it) becomes two, without white space at the cut; the
    second has a null id. how: preserve the times, estimate (in proportion to the bytes of both texts), or frame (both meet
    where a frame ends, of those that the line is shown in)."""
    rows = lines.join(cursors.select(*KEY, "pos"), KEY, "left")
    raw = F.col("text").cast("binary")
    cut = lambda a, n: F.substring(raw, a, n).cast("string")
    left = F.regexp_replace(cut(F.lit(1), F.col("pos")), r"[ \t\r\n\f\x0b]+$", "")
    right = F.regexp_replace(cut(F.col("pos") + 1, F.octet_length("text")), r"^[ \t\r\n\f\x0b]+", "")
    a, b = F.octet_length(left), F.octet_length(right)
    if how == "estimate":
        at = F.when(a + b > 0, F.col("start_ms") + ((F.col("end_ms") - F.col("start_ms")) * (a / (a + b))).cast("int"))
    elif how == "frame":
        low, high = frame_at("start_ms", *rate, "start"), frame_at("end_ms", *rate, "end")
        at = time_at(F.greatest(low, F.least(F.lit(frame), high)), *rate, "end")
    else:
        at = F.lit(None).cast("int")
    one = lambda id, text, s, e: F.struct(id.alias("id"), text.alias("text"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    start, end = F.col("start_ms"), F.col("end_ms")
    two = F.array(one(F.col("id"), left, start, F.coalesce(at, end)), one(F.lit(None).cast("bigint"), right, F.coalesce(at, start), end))
    parts = F.when(F.col("pos").isNull(), F.array(one(F.col("id"), F.col("text"), start, end))).otherwise(two)
    out = rows.select("*", F.posexplode(parts).alias("_k", "_p"))
    out = out.withColumns({"id": F.col("_p.id"), "text": F.col("_p.text"), "start_ms": F.col("_p.s"), "end_ms": F.col("_p.e")})
    return renumber(out, F.struct("row_no", "_k")).select(lines.columns)


def swap(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines (file_id, id, other_id) change places."""
    both = pairs.select(*KEY, "other_id").unionByName(pairs.select("file_id", F.col("other_id").alias("id"), F.col("id").alias("other_id")))
    places = lines.select("file_id", F.col("id").alias("other_id"), F.col("row_no").alias("_r"))
    to = both.join(places, ["file_id", "other_id"]).select(*KEY, "_r")
    return lines.join(to, KEY, "left").withColumn("row_no", F.coalesce("_r", "row_no")).select(lines.columns)


def in_row_order(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected lines with their place among the selected of their file, by row."""
    rows = lines.join(selected.select(KEY).distinct(), KEY, "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("row_no")) - 1)


def invert_comments(lines: DataFrame, selected: Column) -> DataFrame:
    """Each selected line becomes what it wasn't, comment or dialogue."""
    return lines.withColumn("comment", F.when(selected, ~F.col("comment")).otherwise(F.col("comment")))


def visible_at_frame(lines: DataFrame, frame: int, rate: tuple[int, int]) -> DataFrame:
    """Lines that are shown in a frame; comments too, as a selection has them."""
    return lines.where((frame_at("start_ms", *rate, "start") <= frame) & (frame_at("end_ms", *rate, "end") >= frame))


# ---------------------------------------------------------------- copies as text


def copy_rows(lines: DataFrame) -> DataFrame:
    """(file_id, content): the lines as event lines, by row, one below the other."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in lines.columns else F.lit("0")
    kind = F.when(F.col("comment"), "Comment: ").otherwise("Dialogue: ")
    safe = lambda c: F.replace(c, F.lit(","), F.lit(";"))
    event = F.concat(kind, F.concat_ws(",", field("layer"), format_ass("start_ms"), format_ass("end_ms"), safe("style"), safe("actor"), field("margin_l"), field("margin_r"), field("margin_v"), safe("effect"), F.regexp_replace("text", "[\r\n]", "")))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", event.alias("e")))), lambda x: x["e"]), "\r\n").alias("content"))


def paste_rows(lines: DataFrame, clips: DataFrame, length: int = 5000) -> DataFrame:
    """Lines with those of a text (file_id, at, content) before the line at row `at` of its file. Event lines are read as such;
    any other line is the text of a plain one of the default style; empty lines are left out. New lines have a null id."""
    rows = clips.select("file_id", "at", F.posexplode(F.split("content", "\r?\n|\r")).alias("_n", "_line"))
    rows = rows.withColumn("_line", F.regexp_replace("_line", _TRIM, "")).where("_line <> ''")
    event = r"^(Dialogue|Comment):\s*(?:[^,]*,){9}"
    kind = F.regexp_extract("_line", event, 1)
    p = F.when(kind != "", F.split(F.regexp_replace("_line", r"^\w+:\s*", ""), ",", 10))
    got = {
        "id": F.lit(None).cast("bigint"),
        "comment": kind == "Comment",
        "layer": F.coalesce(p[0].try_cast("int"), F.lit(0)),
        "start_ms": F.when(kind != "", parse(p[1])).otherwise(0),
        "end_ms": F.when(kind != "", parse(p[2])).otherwise(length),
        "style": F.coalesce(F.trim(p[3]), F.lit("Default")),
        "actor": F.coalesce(F.trim(p[4]), F.lit("")),
        "margin_l": F.coalesce(p[5].try_cast("int"), F.lit(0)),
        "margin_r": F.coalesce(p[6].try_cast("int"), F.lit(0)),
        "margin_v": F.coalesce(p[7].try_cast("int"), F.lit(0)),
        "effect": F.coalesce(F.trim(p[8]), F.lit("")),
        "text": F.coalesce(p[9], F.col("_line")),
        "row_no": F.col("_n"),
    }
    kinds = dict(lines.dtypes)
    new = rows.select("file_id", "at", *(got[c].cast(kinds[c]).alias(c) if c in got else F.lit(None).cast(kinds[c]).alias(c) for c in lines.columns if c != "file_id"))
    place = lambda a, b: F.struct(a.cast("int").alias("a"), F.lit(b).alias("b"), F.col("row_no").alias("c"))
    new = new.withColumn("_at", place(F.col("at"), 0)).drop("at")
    return renumber(lines.withColumn("_at", place(F.col("row_no"), 1)).unionByName(new), F.col("_at")).select(lines.columns)


# ---------------------------------------------------------------- extradata


def set_extradata(lines: DataFrame, extradata: DataFrame, values: DataFrame, delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines and extradata after values (file_id, line_id, key, value) are set, or with delete the keys removed.

    A line has one entry of a key; an entry with the same key and value in the file is used again, others get the next ids, in
    the order of key and value. Entries that no line uses stay until clean_extradata().
    """
    v = values.select("file_id", "line_id", "key", "value").groupBy("file_id", "line_id", "key").agg(F.min("value").alias("value"))
    known = extradata.groupBy("file_id", "key", "value").agg(F.min("id").alias("_id"))
    after = extradata
    if not delete:
        wanted = v.select("file_id", "key", "value").distinct().join(known, ["file_id", "key", "value"], "left_anti")
        top = extradata.groupBy("file_id").agg(F.max("id").alias("_top"))
        order = F.row_number().over(Window.partitionBy("file_id").orderBy("key", "value"))
        new = wanted.join(top, "file_id", "left").select("file_id", (F.coalesce("_top", F.lit(0)) + order).cast("bigint").alias("id"), F.lit(0).alias("expiration"), "key", "value")
        after = extradata.unionByName(new.select(extradata.columns))
        known = after.groupBy("file_id", "key", "value").agg(F.min("id").alias("_id"))
    own = lines.select("file_id", F.col("id").alias("line_id"), F.posexplode("extradata_ids").alias("_n", "_d"))
    old = own.join(extradata.select("file_id", F.col("id").alias("_d"), "key"), ["file_id", "_d"], "left")
    kept = old.join(v.select("file_id", "line_id", "key"), ["file_id", "line_id", "key"], "left_anti").select("file_id", "line_id", "_n", "_d")
    if not delete:
        added = v.join(known, ["file_id", "key", "value"]).select("file_id", "line_id", (F.lit(1 << 30) + F.row_number().over(Window.partitionBy("file_id", "line_id").orderBy("key"))).alias("_n"), F.col("_id").alias("_d"))
        kept = kept.unionByName(added)
    ids = kept.groupBy("file_id", "line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_d"))), lambda x: x["_d"]).alias("_ids"))
    touched = v.select("file_id", "line_id").distinct().withColumn("_touched", F.lit(True))
    out = lines.join(ids.withColumnRenamed("line_id", "id"), KEY, "left").join(touched.withColumnRenamed("line_id", "id"), KEY, "left")
    new_ids = F.when(F.col("_touched"), F.coalesce("_ids", F.array().cast("array<bigint>"))).otherwise(F.col("extradata_ids"))
    return out.withColumn("extradata_ids", new_ids).select(lines.columns), after


# ---------------------------------------------------------------- search


def replace_one(lines: DataFrame, found: DataFrame, field: str, pattern: str, replacement: str) -> DataFrame:
    """The first match of a pattern in a field of the found lines (file_id, id) is replaced ($1 stands for a group), others
    stay."""
    java = re.sub(r"\$(\d)", r"\\\1", replacement)

    @F.pandas_udf("string")
    def once(s: pd.Series) -> pd.Series:
        one = re.compile(pattern)
        return s.map(lambda t: None if t is None else one.sub(java, t, count=1))

    rows = lines.join(found.select(*KEY, F.lit(True).alias("_on")).distinct(), KEY, "left")
    return rows.withColumn(field, F.when(F.col("_on"), once(field)).otherwise(F.col(field))).select(lines.columns)


# ---------------------------------------------------------------- grid


def grid(lines: DataFrame, tags: str = "simple", rate: tuple[int, int] | None = None) -> DataFrame:
    """The columns of a grid: number from 1, layer, start and end as time or, with a rate, as frame, style, actor, effect, margins
    (empty where 0), characters per second, and the text with its blocks shown (show), as one sign (simple) or left out
    (hide)."""
    blocks = {"show": F.col("text"), "simple": F.regexp_replace("text", r"\{[^}]*\}", "☀"), "hide": strip_tags("text")}
    time = (lambda c, mode: frame_at(c, *rate, mode).cast("string")) if rate else (lambda c, mode: format_ass(c))
    blank = lambda c: F.when(F.col(c) == 0, "").otherwise(F.col(c).cast("string")).alias(c)
    margins = [blank(c) for c in ("margin_l", "margin_r", "margin_v") if c in lines.columns]
    cps = F.when(F.col("comment"), F.lit(None).cast("int")).otherwise(chars_per_second("text", "start_ms", "end_ms"))
    return lines.select(*KEY, (F.col("row_no") + 1).alias("number"), blank("layer"), time("start_ms", "start").alias("start"), time("end_ms", "end").alias("end"), "style", "actor", "effect", *margins, cps.alias("cps"), blocks[tags].alias("text"))


def column_widths(lines: DataFrame) -> DataFrame:
    """What each file's grid must have room for: the greatest layer and margins, and the longest style, actor and effect."""
    sizes = [F.max(F.length(c)).alias(f"{c}_width") for c in ("style", "actor", "effect")]
    most = [F.max(c).alias(f"max_{c}") for c in ("layer", "margin_l", "margin_r", "margin_v") if c in lines.columns]
    return lines.groupBy("file_id").agg(F.max("row_no").alias("max_row"), *most, *sizes)


def least_gap(lines: DataFrame) -> DataFrame:
    """Smallest time of each file between the end of a line and the start of the next; null where none is positive."""
    gap = F.col("start_ms") - F.lag("end_ms").over(by_file())
    return lines.withColumn("_g", gap).groupBy("file_id").agg(F.min(F.when(F.col("_g") > 0, F.col("_g"))).alias("gap"))


def nth_pairs(lines: DataFrame, source: str, target: str) -> DataFrame:
    """The n-th line of one style with the n-th of another, of each file; those without a counterpart have none."""
    n = F.row_number().over(Window.partitionBy("file_id", "style").orderBy("row_no"))
    rows = lines.where(~F.col("comment")).withColumn("n", n)
    a = rows.where(F.col("style") == source).select("file_id", "n", F.col("id").alias("source_id"), F.col("text").alias("source_text"))
    b = rows.where(F.col("style") == target).select("file_id", "n", F.col("id").alias("target_id"), F.col("text").alias("target_text"))
    return a.join(b, ["file_id", "n"], "left")
