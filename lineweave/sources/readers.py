"""Files to tables. Each reader takes a folder or glob; files are whole texts and become rows where they are read."""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions.htmltags import to_overrides
from lineweave.functions.times import parse, time_at

LINES = "file_id string, row_no int, comment boolean, layer int, start_ms int, end_ms int, style string, actor string, effect string, margin_l int, margin_r int, margin_v int, text string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) of whole files, without byte order marks and carriage returns."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_id"), F.regexp_replace("value", "^\ufeff|\r", "").alias("content"))
    return df


def numbered(files: DataFrame) -> DataFrame:
    """(file_id, n, line)."""
    return files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))


def ass_lines(files: DataFrame) -> DataFrame:
    """Events of scripts: nine comma-separated fields, then the text. Sections hold until the next header."""
    rows = numbered(files)
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]\s*$"), F.lower(F.trim("line"))), ignorenulls=True).over(w))
    kind = F.regexp_extract("line", "^(Dialogue|Comment):", 1)
    rows = rows.where((F.col("section") == "[events]") & (kind != ""))
    p = F.split(F.regexp_replace("line", r"^\w+:\s*", ""), ",", 10)
    margin = lambda k: F.greatest(F.least(F.coalesce(F.trim(p[k]).try_cast("int"), F.lit(0)), F.lit(99999)), F.lit(-9999))
    row = (F.row_number().over(Window.partitionBy("file_id").orderBy("n")) - 1).cast("int")
    return rows.select("file_id", row.alias("row_no"), (kind == "Comment").alias("comment"), F.coalesce(F.trim(p[0]).try_cast("int"), F.lit(0)).alias("layer"), parse(p[1]).alias("start_ms"), parse(p[2]).alias("end_ms"), F.trim(p[3]).alias("style"), F.trim(p[4]).alias("actor"), F.trim(p[8]).alias("effect"), margin(5).alias("margin_l"), margin(6).alias("margin_r"), margin(7).alias("margin_v"), p[9].alias("text"))


def ass_info(files: DataFrame) -> DataFrame:
    """(file_id, ord, key, value) of script info; comments are left out."""
    rows = numbered(files)
    w = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]\s*$"), F.lower(F.trim("line"))), ignorenulls=True).over(w))
    rows = rows.where((F.col("section") == "[script info]") & F.col("line").rlike("^[^;!\\[].*:"))
    return rows.select("file_id", F.col("n").alias("ord"), F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("key"), F.ltrim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))


#: Fixed names: fields of a style line, in order
STYLE = ("name font fontsize primary secondary outline shadow bold italic underline strikeout scalex scaley spacing angle borderstyle outline_w shadow_w alignment margin_l margin_r margin_v encoding").split()


def ass_styles(files: DataFrame) -> DataFrame:
    """(file_id, ord, 23 fields as text): numbers are cast by who needs them."""
    rows = numbered(files).where(F.col("line").startswith("Style:"))
    p = F.split(F.regexp_replace("line", r"^Style:\s*", ""), ",")
    rows = rows.withColumn("_p", p).where(F.size("_p") == len(STYLE))
    return rows.select("file_id", F.col("n").alias("ord"), *(F.trim(F.col("_p")[i]).alias(c) for i, c in enumerate(STYLE)))


_SRT_TIMES = re.compile(r"([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2},[0-9]+) --> ([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2},[0-9]+)")


def _srt_blocks(content: str) -> list[tuple[str, str, str]]:
    """(start, end, text) of each subtitle; ValueError says which line is wrong. A subtitle begins after a blank line, with a number and
    then times, or with times at once; any other line after a blank one goes on with the text."""
    lines = [x.strip(" \t\r\f\v") for x in content.split("\n")]
    begins = [(not k or not lines[k - 1]) and bool(re.fullmatch("[0-9]+", x) or _SRT_TIMES.match(x)) for k, x in enumerate(lines)]
    first = next((k for k, x in enumerate(lines) if x), len(lines))
    if first < len(lines) and not begins[first]:
        raise ValueError(f"line {first + 1}: a number was expected")
    out, k = [], first
    while k < len(lines):
        k += not _SRT_TIMES.match(lines[k])
        if k < len(lines) and not (times := _SRT_TIMES.match(lines[k])):
            raise ValueError(f"line {k + 1}: times were expected")
        body = k + 1
        if body >= len(lines) or body == len(lines) - 1 and not lines[body]:
            raise ValueError("the file ends within a subtitle")
        # the line after the times is text whatever it holds
        k = next((j for j in range(body + 1, len(lines)) if begins[j]), len(lines))
        out.append((times[1], times[2], "\n".join(lines[body:k]).rstrip("\n")))
    return out


def _srt(files: DataFrame) -> DataFrame:
    def run(batches):
        for p in batches:
            rows = []
            for name, content in zip(p.file_id, p.content):
                try:
                    rows += [(name, i, *x, None) for i, x in enumerate(_srt_blocks(content))]
                except ValueError as e:
                    rows.append((name, 0, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file_id", "row_no", "a", "b", "text", "problem"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInPandas(run, f"file_id {kind}, row_no int, a string, b string, text string, problem string")


def srt_lines(files: DataFrame) -> DataFrame:
    """SubRip: blocks of a number, times and text, whose b, i, u, s and font tags become overrides. A file with an error gives no lines;
    srt_problems() names it."""
    text = F.replace(to_overrides("text"), F.lit("\n"), F.lit("\\N")).alias("text")
    return _srt(files).where("problem is null").select("file_id", "row_no", parse("a").alias("start_ms"), parse("b").alias("end_ms"), text)


def srt_problems(files: DataFrame) -> DataFrame:
    return _srt(files).where("problem is not null").select("file_id", "problem")


def microdvd_lines(files: DataFrame, num: int = 24000, den: int = 1001) -> DataFrame:
    """{first}{last}text by frames; a first line of {1}{1} names the rate, which the caller passes."""
    rows = numbered(files).withColumn("m", F.regexp_extract("line", r"^\{(\d+)\}\{(\d+)\}(.*)$", 3))
    a, b = (F.regexp_extract("line", r"^\{(\d+)\}\{(\d+)\}", k).try_cast("int") for k in (1, 2))
    rows = rows.withColumns({"a": a, "b": b}).where(F.col("a").isNotNull() & ~((F.col("a") == 1) & (F.col("b") == 1)))
    row = (F.row_number().over(Window.partitionBy("file_id").orderBy("n")) - 1).cast("int")
    return rows.select("file_id", row.alias("row_no"), time_at("a", num, den, "start").alias("start_ms"), time_at("b", num, den, "end").alias("end_ms"), F.replace("m", F.lit("|"), F.lit("\\N")).alias("text"))


def plain_lines(files: DataFrame, separator: str = ":", comment: str = "#") -> DataFrame:
    """A line each; what stands before the separator is the actor and holds for lines that name none."""
    rows = numbered(files).where(F.trim("line") != "")
    is_comment = F.col("line").startswith(comment)
    named = ~is_comment & F.col("line").contains(separator)
    actor = F.when(named, F.trim(F.split_part("line", F.lit(separator), F.lit(1))))
    w = Window.partitionBy("file_id").orderBy("n")
    text = F.when(is_comment, F.substring("line", len(comment) + 1, 1 << 30)).when(named, F.ltrim(F.regexp_replace("line", f"^[^{separator}]*{separator}", ""))).otherwise(F.col("line"))
    return rows.select("file_id", (F.row_number().over(w) - 1).cast("int").alias("row_no"), is_comment.alias("comment"), F.coalesce(F.last(actor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")).alias("actor"), text.alias("text"))


def timecodes(files: DataFrame) -> DataFrame:
    """Timecode files, version 2: (file_id, frame, ms). Fewer than two, unsorted or all equal times are an error."""
    rows = numbered(files).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    w = Window.partitionBy("file_id").orderBy("n")
    out = rows.select("file_id", (F.row_number().over(w) - 1).cast("int").alias("frame"), F.round(F.trim("line").cast("double")).cast("int").alias("ms"))
    bad = out.withColumn("_p", F.lag("ms").over(Window.partitionBy("file_id").orderBy("frame"))).groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("ms") < F.col("_p")).alias("back"), F.count_distinct("ms").alias("kinds")).where("n < 2 or back > 0 or kinds < 2")
    if bad.limit(1).count():
        raise ValueError("timecodes must be two at least, sorted and not all equal")
    return out


def timecodes_v1(text: str, frames: int) -> list[int]:
    """Times of the first frames of a version 1 file: a rate for all and ranges of frames with other rates."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    rate = float(re.fullmatch(r"Assume (\S+)", lines[0])[1])
    if not 0 < rate <= 1000:
        raise ValueError("rate")
    rates, last = [rate] * frames, -1
    for x in lines[1:]:
        a, b, r = x.split(",")
        a, b, r = int(a), int(b), float(r)
        if a < 0 or b < a or a <= last or not 0 < r <= 1000:
            raise ValueError(x)
        last = b
        rates[a : b + 1] = [r] * len(rates[a : b + 1])
    out, t = [], 0.0
    for r in rates:
        out.append(int(t + 0.5))
        t += 1000 / r
    return out


def keyframes(files: DataFrame) -> DataFrame:
    """(file_id, frame) of plain lists of numbers, and of encoder logs whose lines begin with a frame type."""
    rows = numbered(files)
    w = Window.partitionBy("file_id").orderBy("n")
    kind = F.lower(F.regexp_extract("line", r"^\s*(?:\d+\s+)?([iIpPbB])\b", 1))
    listed = rows.where(F.col("line").rlike(r"^\s*\d+(\s+[Ii]\b.*)?\s*$")).select("file_id", F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("frame"))
    logged = rows.where(F.col("line").rlike("^[iIpPbB]")).withColumns({"k": kind, "frame": (F.row_number().over(w) - 1).cast("int")}).where("k = 'i'").select("file_id", "frame")
    return listed.unionByName(logged)


_ITEMS = "file string, key string, text string"


def items_json(content: str, name: str) -> list[tuple]:
    """Text leaves of a JSON file, keyed by their path; a record with key or id names its text."""
    out = []

    def walk(x, path, depth):
        if depth > 64:
            return
        if isinstance(x, str):
            out.append((name, path, x))
        elif isinstance(x, dict):
            own = x.get("key") or x.get("id")
            for k, v in x.items():
                if not (own and k in ("key", "id")):
                    walk(v, "/".join(p for p in (path, str(own) if own else "", k if not own or k != "text" else "") if p), depth + 1)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}" if path else str(i), depth + 1)

    walk(json.loads(content), "", 0)
    return out


def items_csv(content: str, name: str) -> list[tuple]:
    """Rows of key and text; the delimiter is the more frequent of tab, semicolon and comma."""
    first = content.split("\n", 1)[0]
    rows = list(csv.reader(io.StringIO(content), delimiter=max("\t;,", key=first.count)))
    if rows and rows[0] and rows[0][0].strip().lower() in ("key", "id", "name"):
        rows = rows[1:]
    return [(name, r[0], r[1]) for r in rows if len(r) > 1]


def items_pairs(content: str, name: str) -> list[tuple]:
    """key=value or key: value lines; a line without either is a text of its own."""
    out = []
    for i, x in enumerate(content.splitlines()):
        x = x.strip()
        if not x or x.startswith(("#", ";", "//")):
            continue
        key, sep, value = x.partition("=")
        if not sep and ":" in x[:64] and x[:64].partition(":")[0].isascii():
            key, sep, value = x.partition(":")
        out.append((name, key.strip(), value.strip().strip('"')) if sep else (name, str(i), x))
    return out


def items(files: DataFrame) -> DataFrame:
    """(file, key, text) of translation files by extension; a file that can't be read gives no rows."""

    def run(batches):
        for p in batches:
            rows = []
            for name, content in zip(p.file_id, p.content):
                read = items_json if name.endswith(".json") else items_csv if name.endswith((".csv", ".tsv")) else items_pairs
                if "\0" not in content:
                    try:
                        rows += read(content, name)
                    except (ValueError, csv.Error):
                        continue
            yield pd.DataFrame(rows, columns=["file", "key", "text"])

    return files.mapInPandas(run, _ITEMS)
