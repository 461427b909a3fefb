"""Syllables of karaoke lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TAG = re.compile(r"\\(kf|ko|k|K)(\d+)")
_SCHEMA = "array<struct<idx:int,tag:string,duration_ms:int,text:string,tags:string>>"


def parse(c: Column | str) -> Column:
    """Syllables of a text: what follows each timing tag, its duration, and the other tags of its blocks."""

    def one(text: str) -> list[dict]:
        out = [{"idx": 0, "tag": "k", "duration_ms": 0, "text": "", "tags": ""}]
        for block, plain in re.findall(r"(\{[^}]*\})|([^{]+|\{)", text):
            if not block:
                out[-1]["text"] += plain
                continue
            rest, at = "", 1
            for m in _TAG.finditer(block):
                out[-1]["tags"] += rest + block[at : m.start()]
                rest, at = "", m.end()
                out.append({"idx": 0, "tag": "kf" if m[1] == "K" else m[1], "duration_ms": int(m[2]) * 10, "text": "", "tags": ""})
            out[-1]["tags"] += block[at:-1]
        out = [s for s in out if s["duration_ms"] or s["text"] or s["tags"]]
        for i, s in enumerate(out):
            s["idx"] = i
        return out

    @F.pandas_udf(_SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else one(t))

    return run(c)


def syllables(lines: DataFrame) -> DataFrame:
    """A row for each syllable with its start: the line's start and all durations before."""
    rows = lines.withColumn("s", F.explode(parse("text"))).select("file_id", "id", "start_ms", "end_ms", "s.idx", "s.tag", "s.duration_ms", F.col("s.text").alias("text"), "s.tags")
    return timed(rows)


def timed(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("syl_start_ms", (F.col("start_ms") + F.sum("duration_ms").over(w) - F.col("duration_ms")).cast("int"))


def running_sum(c: Column | str) -> Column:
    """Sums of an array of whole numbers up to each of them: no shuffle as a window would need, no array built step by step."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: None if a is None else np.cumsum(a, dtype=np.int64))

    return run(c)


def split_words(lines: DataFrame) -> DataFrame:
    """One syllable for each word, with the line's time in proportion to its bytes."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    rows = lines.withColumn("_w", words).withColumn("_u", running_sum(F.transform("_w", F.octet_length)))
    rows = rows.select("file_id", "id", "start_ms", "end_ms", F.array_max("_u").alias("_total"), "_u", F.posexplode("_w").alias("idx", "text"))
    rows = rows.withColumn("upto", F.get("_u", "idx"))
    span = F.col("end_ms") - F.col("start_ms")
    mark = lambda k: F.floor(span * k / F.col("_total") / 10).cast("int") * 10
    before = F.col("upto") - F.octet_length("text")
    out = rows.withColumns({"duration_ms": mark(F.col("upto")) - mark(before), "syl_start_ms": F.col("start_ms") + mark(before)})
    return out.select("file_id", "id", "start_ms", "end_ms", "idx", "text", "duration_ms", "syl_start_ms")


def fit_to_line(rows: DataFrame) -> DataFrame:
    """Durations cut at the line's end; the last syllable reaches it."""
    end = F.least(F.col("syl_start_ms") + F.col("duration_ms"), F.col("end_ms"))
    last = F.max("idx").over(Window.partitionBy("file_id", "id")) == F.col("idx")
    return rows.withColumn("duration_ms", F.greatest(F.when(last, F.col("end_ms")).otherwise(end) - F.col("syl_start_ms"), F.lit(0)).cast("int"))


def render(rows: DataFrame) -> DataFrame:
    """Texts from syllables, durations rounded to centiseconds."""
    one = F.concat(F.lit("{\\"), "tag", F.floor((F.col("duration_ms") + 5) / 10).cast("string"), "tags", F.lit("}"), "text")
    return rows.groupBy("file_id", "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", one.alias("t")))), lambda x: x["t"]), "").alias("text"))


def split_lines(lines: DataFrame) -> DataFrame:
    """A line for each syllable of lines that have two at least."""
    rows = syllables(lines)
    n = F.count("*").over(Window.partitionBy("file_id", "id"))
    return rows.withColumn("_n", n).where("_n > 1").select("file_id", "id", "idx", F.col("syl_start_ms").alias("start_ms"), (F.col("syl_start_ms") + F.col("duration_ms")).alias("end_ms"), "text")


def merge_with_previous(rows: DataFrame, at: int) -> DataFrame:
    """Each line's syllable `at` joins the one before; the first stays."""
    if at < 1:
        return rows
    place = F.when(F.col("idx") >= at, F.col("idx") - 1).otherwise(F.col("idx"))
    parts = F.sort_array(F.collect_list(F.struct("idx", "text", "tag", "tags")))
    out = rows.withColumn("_p", place).groupBy("file_id", "id", "start_ms", "end_ms", F.col("_p").alias("new_idx")).agg(parts.alias("p"), F.sum("duration_ms").cast("int").alias("duration_ms"))
    join = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "")
    return timed(out.select("file_id", "id", "start_ms", "end_ms", F.col("new_idx").alias("idx"), F.col("p")[0]["tag"].alias("tag"), "duration_ms", join("text").alias("text"), join("tags").alias("tags")))


def clear_timing(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"duration_ms": F.lit(0), "syl_start_ms": F.col("start_ms")})


def set_boundaries(rows: DataFrame, ends: Column) -> DataFrame:
    """Syllables that end at the given times, kept in order and within the line; where one is null, at the line's end."""
    w = Window.partitionBy("file_id", "id").orderBy("idx")
    end = F.greatest(F.col("start_ms"), F.max(F.least(F.coalesce(ends, "end_ms"), "end_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.withColumn("_e", end)
    begin = F.coalesce(F.lag("_e").over(w), "start_ms")
    return out.withColumn("syl_start_ms", begin.cast("int")).withColumn("duration_ms", (F.col("_e") - F.col("syl_start_ms")).cast("int")).drop("_e")


def auto_lead_in(lines: DataFrame) -> DataFrame:
    """Lines begin where the one before ends, the gap a timed syllable without text in front. Lines that touch or overlap stay."""
    before = F.lag("end_ms").over(Window.partitionBy("file_id").orderBy("row_no"))
    rows = lines.withColumn("_gap", F.col("start_ms") - before)
    text = F.concat(F.lit("{\\k"), F.floor(F.col("_gap") / 10).cast("string"), F.lit("}"), "text")
    return rows.withColumns({"start_ms": F.when(F.col("_gap") > 0, F.col("start_ms") - F.col("_gap")).otherwise(F.col("start_ms")), "text": F.when(F.col("_gap") > 0, text).otherwise(F.col("text"))}).drop("_gap")


def auto_split(rows: DataFrame) -> DataFrame:
    """Lines of one syllable come to have one for each word, which keeps the space after it; a space at the end has an empty
    one after it. What follows a cut gets its share of the time by bytes, rounded to 10 ms, cut after cut."""
    words = F.split("text", " ")
    rows = rows.withColumn("_one", F.count("*").over(Window.partitionBy("file_id", "id")) == 1)
    rows = rows.withColumn("_parts", F.when(F.col("_one"), F.transform(words, lambda x, i: F.when(i < F.size(words) - 1, F.concat(x, F.lit(" "))).otherwise(x))).otherwise(F.array("text")))
    size = lambda k: F.octet_length(F.array_join(F.slice("_parts", k + 1, F.size("_parts")), ""))
    share = lambda left, k: F.floor((F.floor(left * size(k) / size(k - 1)) + 5) / 10).cast("int") * 10
    cuts = F.filter(F.sequence(F.lit(0), F.size("_parts") - 1), lambda k: k > 0)
    rows = rows.withColumn("_left", F.aggregate(cuts, F.array(F.col("duration_ms").cast("int")), lambda a, k: F.concat(a, F.array(F.when(size(k) == 0, 0).otherwise(share(F.element_at(a, -1), k))))))
    out = rows.select("*", F.posexplode("_parts").alias("_k", "_t"))
    time = F.get("_left", F.col("_k")) - F.coalesce(F.get("_left", F.col("_k") + 1), F.lit(0))
    return timed(out.withColumns({"text": F.col("_t"), "idx": F.col("idx") + F.col("_k"), "duration_ms": time, "tags": F.when(F.col("_k") == 0, F.col("tags")).otherwise("")}).drop("_one", "_parts", "_left", "_k", "_t"))


def split_syllable(rows: DataFrame, cuts: DataFrame, how: str = "bytes") -> DataFrame:
    """Syllables with a cut (file_id, id, idx, pos: bytes of the text before it) become two. The time is divided by bytes to whole
    10 ms (bytes), by characters so that the sum stays (characters), or the second has none (zero). The other tags stay with
    the first. A cut at or beyond the end gives an empty second one."""
    r = rows.join(cuts.select("file_id", "id", "idx", "pos"), ["file_id", "id", "idx"], "left")
    raw = F.col("text").cast("binary")
    left = F.when(F.col("pos") < F.octet_length("text"), F.substring(raw, F.lit(1), F.col("pos")).cast("string")).otherwise(F.col("text"))
    right = F.when(F.col("pos") < F.octet_length("text"), F.substring(raw, F.col("pos") + 1, F.octet_length("text")).cast("string")).otherwise("")
    d = F.col("duration_ms")
    if how == "characters":
        whole = F.floor((d + 5) / 10)
        n = F.length(left) + F.length(right)
        first = F.when(n > 0, F.floor((2 * whole * F.length(left) + n) / (2 * n)) * 10).otherwise(d)
        second = F.when(n > 0, whole * 10 - first).otherwise(0)
    elif how == "zero":
        first, second = d, F.lit(0)
    else:
        a, b = F.octet_length(left), F.octet_length(right)
        second = F.when(b == 0, 0).when(a == 0, d).otherwise(F.floor((F.floor(d * b / (a + b)) + 5) / 10) * 10)
        first = d - second
    one = lambda t, ms, tags: F.struct(t.alias("t"), ms.cast("int").alias("ms"), tags.alias("g"))
    two = F.array(one(left, first, F.col("tags")), one(right, second, F.lit("")))
    parts = F.when(F.col("pos").isNull(), F.array(one(F.col("text"), d, F.col("tags")))).otherwise(two)
    out = r.select("*", F.posexplode(parts).alias("_k", "_p"))
    place = F.row_number().over(Window.partitionBy("file_id", "id").orderBy("idx", "_k")) - 1
    out = out.withColumn("_i", place).withColumns({"idx": F.col("_i"), "text": F.col("_p.t"), "duration_ms": F.col("_p.ms"), "tags": F.col("_p.g")})
    return timed(out.select(*(c for c in rows.columns if c != "syl_start_ms"))).select(rows.columns)


def insert_empty(rows: DataFrame, at: int) -> DataFrame:
    """An empty syllable without time before syllable `at` of each line; beyond the last it comes after it."""
    n = F.max("idx").over(Window.partitionBy("file_id", "id")) + 1
    r = rows.withColumn("_n", F.least(F.lit(at), n))
    new = r.groupBy("file_id", "id", "start_ms", "end_ms").agg(F.max("_n").alias("idx")).withColumns({"tag": F.lit("k"), "duration_ms": F.lit(0), "text": F.lit(""), "tags": F.lit("")})
    old = r.withColumn("idx", F.when(F.col("idx") >= F.col("_n"), F.col("idx") + 1).otherwise(F.col("idx")))
    names = ["file_id", "id", "start_ms", "end_ms", "idx", "tag", "duration_ms", "text", "tags"]
    return timed(old.select(names).unionByName(new.select(names))).select(rows.columns)


def pre_syllable(rows: DataFrame) -> DataFrame:
    """Syllables numbered from 1, with an empty one of number 0 at the start of each line."""
    first = rows.groupBy("file_id", "id", "start_ms", "end_ms").agg(F.lit(0).alias("idx")).withColumns({"tag": F.lit(""), "duration_ms": F.lit(0), "text": F.lit(""), "tags": F.lit(""), "syl_start_ms": F.col("start_ms")})
    return rows.withColumn("idx", F.col("idx") + 1).unionByName(first.select(rows.columns))
