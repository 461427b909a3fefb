"""Timed text as XML samples: each says when it begins and holds until the next."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import convert_newlines, strip_tags
from lineweave.functions.times import parse
from lineweave.operators.windows import by_file
from lineweave.sources.writers import prepared

#: The end of a last line, and the sample description that files have
LAST_END = 35999990
HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<TextStream version="1.1">
  <TextStreamHeader width="400" height="60" layer="0" translation_x="0" translation_y="0">
    <TextSampleDescription horizontalJustification="center" verticalJustification="bottom" backColor="0 0 0 0" verticalText="no" fillTextRegion="no" continuousKaraoke="no" scroll="None">
      <FontTable>
        <FontTableEntry fontName="Sans" fontID="1"/>
      </FontTable>
      <TextBox top="0" left="0" bottom="60" right="400"/>
      <Style styles="Normal" fontID="1" fontSize="18" color="ff ff ff ff"/>
    </TextSampleDescription>
  </TextStreamHeader>
"""


def _samples(content: str) -> list[tuple[str, str]]:
    """(time, text) of each sample; ValueError for what is no such file."""
    try:
        root = ElementTree.fromstring(content.encode())
    except ElementTree.ParseError as e:
        raise ValueError(f"not XML: {e}") from e
    version = root.get("version", "")
    if root.tag != "TextStream" or version not in ("1.0", "1.1"):
        raise ValueError(f"{root.tag} {version}: not a known text stream")
    out = []
    for x in root.findall("TextSample"):
        if version == "1.1":
            text = (x.text or "").replace("\r", "").replace("\n", "\\N")
        else:  # lines stand in single quotes
            text = "\\N".join(x.get("text", "").split("'")[1::2])
        quoted = version == "1.1" or x.get("text", "") != ""
        out.append((x.get("sampleTime", "00:00:00.000"), text if quoted else None))
    return out


def _read(files: DataFrame) -> DataFrame:
    """(file_id, n, time, text, problem): a row for each sample, or one that says what is wrong with the file."""

    def run(batches):
        for p in batches:
            rows = []
            for name, content in zip(p.file_id, p.content):
                try:
                    rows += [(name, i, t, x, None) for i, (t, x) in enumerate(_samples(content))]
                except ValueError as e:
                    rows.append((name, 0, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["file_id", "n", "time", "text", "problem"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInPandas(run, f"file_id {kind}, n int, time string, text string, problem string")


def ttxt_lines(files: DataFrame) -> DataFrame:
    """Lines of files: a sample with text ends where the next sample begins, with text or without; the last after ten hours less
    10 ms. Files that can't be read give none; problems() names them."""
    w = Window.partitionBy("file_id").orderBy("n")
    rows = _read(files).where("problem is null").withColumn("start_ms", parse("time"))
    rows = rows.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.lit(LAST_END)).cast("int"))
    rows = rows.where((F.col("text") != ""))
    return rows.select("file_id", (F.row_number().over(w) - 1).cast("int").alias("row_no"), "start_ms", "end_ms", "text")


def problems(files: DataFrame) -> DataFrame:
    return _read(files).where("problem is not null").select("file_id", "problem")


def clock(ms: Column) -> Column:
    """hh:mm:ss.mmm of a time below 100 hours."""
    part = lambda unit, of: (F.floor(ms / unit) % of).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", part(3600000, 100), part(60000, 60), part(1000, 60), part(1, 1000))


def samples(lines: DataFrame) -> DataFrame:
    """(file_id, row_no, part, start_ms, text): a sample for each line, before it an empty one where the line before ends at another
    time, and an empty one at the end of the last."""
    w = by_file()
    rows = lines.withColumns({"_before": F.lag("end_ms").over(w), "_next": F.lead("row_no").over(w)})
    one = lambda part, at, text: F.struct(F.lit(part).alias("part"), at.cast("int").alias("start_ms"), text.alias("text"))
    blank = F.when(F.col("_before") != F.col("start_ms"), one(0, F.col("_before"), F.lit("")))
    last = F.when(F.col("_next").isNull(), one(2, F.col("end_ms"), F.lit("")))
    kept = F.filter(F.array(blank, one(1, F.col("start_ms"), F.col("text")), last), lambda x: x.isNotNull())
    return rows.select("file_id", "row_no", F.explode(kept).alias("s")).select("file_id", "row_no", "s.*")


def ttxt(lines: DataFrame) -> DataFrame:
    """(file_id, content) of version 1.1."""
    rows = samples(prepared(lines)).withColumn("text", strip_tags(convert_newlines("text", "\r\n")))
    safe = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    one = F.concat(F.lit('  <TextSample sampleTime="'), clock(F.col("start_ms")), F.lit('" xml:space="preserve">'), safe, F.lit("</TextSample>\n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "part", one.alias("t")))), lambda x: x["t"])
    return rows.groupBy("file_id").agg(F.concat(F.lit(HEAD), F.array_join(ordered, ""), F.lit("</TextStream>\n")).alias("content"))
