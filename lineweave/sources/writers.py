"""Tables to files: each writer gives one text for each file (file_id, content); save() writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.text import convert_newlines, strip_tags
from lineweave.functions.times import format_ass, format_srt, frame_at, smpte, time_at
from lineweave.operators.lines import actor_share, merge_identical, recombine_overlaps, sort_lines, strip_comments, with_style
from lineweave.operators.windows import by_file


def gathered(rows: DataFrame, line: Column, head: str = "", between: str = "\n") -> DataFrame:
    """Lines of each file in order, as one text. A file is one task's work; a table of many files is spread over all."""
    one = F.transform(F.sort_array(F.collect_list(F.struct("row_no", line.alias("t")))), lambda x: x["t"])
    return rows.groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(one, between), F.lit("\n")).alias("content"))


def event_line(first: str = "layer") -> Column:
    field = lambda c: F.translate(F.regexp_replace(c, r"[\r\n]", ""), ",", ";")
    kind = F.when(F.col("comment"), "Comment: ").otherwise("Dialogue: ")
    lead = F.col("layer").cast("string") if first == "layer" else F.lit("Marked=0")
    return F.concat(kind, F.concat_ws(",", lead, format_ass("start_ms"), format_ass("end_ms"), field("style"), field("actor"), *(F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("margin_l", "margin_r", "margin_v")), field("effect"), F.regexp_replace("text", r"[\r\n]", "")))


#: Fixed text: headers of the script formats
ASS_HEAD = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
SSA_HEAD = "[Script Info]\nScriptType: v4.00\n\n[Events]\nFormat: Marked, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"


def ass(lines: DataFrame) -> DataFrame:
    return gathered(lines, event_line(), ASS_HEAD)


def ssa(lines: DataFrame) -> DataFrame:
    return gathered(lines, event_line("marked"), SSA_HEAD)


def prepared(lines: DataFrame) -> DataFrame:
    """Sorted, without comments, overlaps recombined, equal neighbours merged, numbered anew."""
    out = merge_identical(recombine_overlaps(strip_comments(sort_lines(lines))))
    return out.withColumn("row_no", F.row_number().over(by_file()) - 1)


def srt_tags(c: Column | str) -> Column:
    r"""``{\b1}`` to <b> for b, i, u and s; other tags go."""
    out = c
    for t in "bius":
        out = F.regexp_replace(F.regexp_replace(out, rf"\{{\\{t}1\}}", f"<{t}>"), rf"\{{\\{t}0\}}", f"</{t}>")
    return strip_tags(out)


def srt(lines: DataFrame) -> DataFrame:
    line = F.concat((F.col("row_no") + 1).cast("string"), F.lit("\n"), format_srt("start_ms"), F.lit(" --> "), format_srt("end_ms"), F.lit("\n"), srt_tags(convert_newlines("text")), F.lit("\n"))
    return gathered(prepared(lines), line)


def microdvd(lines: DataFrame, num: int = 24000, den: int = 1001, with_rate: bool = False) -> DataFrame:
    """with_rate: a first line {1}{1} names the frames per second."""
    line = F.concat(F.lit("{"), frame_at("start_ms", num, den, "start").cast("string"), F.lit("}{"), frame_at("end_ms", num, den, "end").cast("string"), F.lit("}"), strip_tags(convert_newlines("text", "|", merge=False)))
    return gathered(prepared(lines), line, f"{{1}}{{1}}{num / den:.6f}\n" if with_rate else "")


def plain(lines: DataFrame) -> DataFrame:
    """Actors are written where more than half of the file's lines name one."""
    rows = strip_comments(lines).join(actor_share(lines), "file_id")
    line = F.concat(F.when(F.col("write_actor"), F.concat("actor", F.lit(": "))).otherwise(""), "text")
    return gathered(rows, line)


def encore(lines: DataFrame, rate: int = 30, drop: bool = False) -> DataFrame:
    code = lambda c, mode: smpte(frame_at(c, rate, 1, mode), rate, drop)
    line = F.concat_ws(" ", (F.col("row_no") + 1).cast("string"), code("start_ms", "start"), code("end_ms", "end"), strip_tags(convert_newlines("text", "\r\n")))
    return gathered(prepared(lines), line)


def merged(lines: DataFrame) -> DataFrame:
    """(file_id, start_ms, row_no, end_ms, style, text): as prepared(), but each run of equal lines has its last one's number and style."""
    rows = recombine_overlaps(strip_comments(sort_lines(lines)))
    w = by_file()
    same = (F.lag("text").over(w) == F.col("text")) & (F.lag("end_ms").over(w) == F.col("start_ms"))
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    rows = rows.groupBy("file_id", "_run").agg(F.min("start_ms").alias("start_ms"), F.max_by(F.struct("row_no", "end_ms", "style", "text"), "row_no").alias("x"))
    return rows.select("file_id", "start_ms", "x.*")


def transtation(lines: DataFrame, styles: DataFrame, rate: int = 25, drop: bool = False) -> DataFrame:
    """Entries SUB[alignment type start>end] with times in frames. styles: (file_id, ord, name, alignment, italic), of which a line's
    says where it stands and whether it is italic. An end at which the next line begins is a frame earlier, as ends count."""
    rows, w = merged(lines), by_file()
    rows = with_style(rows.withColumn("next_start", F.lead("start_ms").over(w)), styles, ["alignment", "italic"])
    touch = (F.col("end_ms") == F.col("next_start")) & (F.col("next_start") > 0)
    end = F.when(touch, time_at(frame_at("end_ms", rate, 1, "end") - 1, rate, 1, "end")).otherwise(F.col("end_ms"))
    a = F.coalesce("style_alignment", F.lit(2))
    place = F.concat(F.when(a >= 7, "9").when(a >= 4, "4").otherwise("0"), F.when(a % 3 == 1, "L").when(a % 3 == 0, "R").otherwise(" "), F.when(F.col("style_italic"), "I").otherwise("N"))
    code = lambda c: smpte(frame_at(c, rate, 1), rate, drop)
    line = F.concat(F.lit("SUB["), place, F.lit(" "), code(F.col("start_ms")), F.lit(">"), code(end), F.lit("]\r\n"), strip_tags(convert_newlines("text", "\r\n")))
    return gathered(rows, line, between="\n\n").withColumn("content", F.concat("content", F.lit("SUB[\n")))


#: Fixed text: first lines of timecode and keyframe files
TIMECODE_HEAD = "# timecode format v2\n"
KEYFRAME_HEAD = "# keyframe format v1\nfps 0\n"


def timecodes(codes: DataFrame, length: int | None = None) -> DataFrame:
    """codes: (file_id, frame, ms). Files with fewer frames than length go on at their mean rate; a file of one time ends there."""
    rows = codes.select("file_id", "frame", "ms")
    if length is not None:
        ends = rows.groupBy("file_id").agg(F.count("*").alias("n"), F.min("ms").alias("a"), F.max("ms").alias("b"), F.max("frame").alias("last"))
        ends = ends.where((F.col("n") > 1) & (F.col("last") < length - 1)).withColumn("f", F.explode(F.sequence(F.col("last") + 1, F.lit(length - 1))))
        ms = F.round(F.col("b") + (F.col("f") - F.col("last")) * (F.col("b") - F.col("a")) / (F.col("n") - 1)).cast("int")
        rows = rows.unionByName(ends.select("file_id", F.col("f").cast("int").alias("frame"), ms.alias("ms")))
    return gathered(rows.withColumnRenamed("frame", "row_no"), F.col("ms").cast("string"), TIMECODE_HEAD)


def keyframes(frames: DataFrame) -> DataFrame:
    """frames: (file_id, frame); each frame is written once, in order."""
    rows = frames.select("file_id", F.col("frame").alias("row_no")).distinct()
    return gathered(rows, F.col("row_no").cast("string"), KEYFRAME_HEAD)


#: Sections of motion keyframes, the columns of each with what follows them, and the factor of their numbers
MOTION = {"Anchor Point": ("\tX pixels\tY pixels\tZ pixels", ("anchor_x", "anchor_y"), "\t0", 1), "Position": ("\tX pixels\tY pixels\tZ pixels", ("x", "y"), "\t0", 1),
          "Scale": ("\tX percent\tY percent\tZ percent", ("scale_x", "scale_y"), "\t100", 100), "Rotation": ("\tDegrees", ("rotation",), "", 1)}


def motion_keyframes(samples: DataFrame, tracks: DataFrame, first_frame: int | None = None) -> DataFrame:
    """(track_id, content) of samples (track_id, frame, anchor_x, anchor_y, x, y, scale_x, scale_y, rotation) and tracks (track_id, fps, width,
    height): frames count from first_frame, or from the track's first; numbers have three decimals. Tracks without samples have
    empty sections."""
    end = "\r\n"
    numbers = [c for _, names, _, _ in MOTION.values() for c in names]
    rows = F.sort_array(F.collect_list(F.struct("frame", *(F.col(c).cast("double").alias(c) for c in numbers))))
    per = tracks.join(samples.groupBy("track_id").agg(rows.alias("_s")), "track_id", "left")
    per = per.withColumn("_s", F.coalesce("_s", F.array().cast(per.schema["_s"].dataType)))
    first = F.lit(first_frame) if first_frame is not None else F.get("_s", F.lit(0))["frame"]

    def section(name: str) -> Column:
        head, names, tail, factor = MOTION[name]
        line = lambda s: F.concat(F.lit("\t"), (s["frame"] - first).cast("string"), *(F.format_string("\t%.3f", s[c] * factor) for c in names), F.lit(tail + end))
        return F.concat(F.lit(f"{name}{end}\tFrame{head}{end}"), F.array_join(F.transform("_s", line), ""), F.lit(end))

    top = F.format_string(f"Adobe After Effects 6.0 Keyframe Data{end}{end}\tUnits Per Second\t%.3f{end}\tSource Width\t%d{end}\tSource Height\t%d{end}\tSource Pixel Aspect Ratio\t1{end}\tComp Pixel Aspect Ratio\t1{end}{end}", F.col("fps").cast("double"), "width", "height")
    return per.select("track_id", F.concat(top, *map(section, MOTION), F.lit(f"End of Keyframe Data{end}")).alias("content"))


def can_save_plain(lines: DataFrame) -> DataFrame:
    """Whether a format without styles and markup keeps all of each file."""
    return lines.groupBy("file_id").agg(F.bool_and((F.col("style") == "Default") & ~F.col("text").rlike(r"\{[^}]*\}")).alias("can_save"))


def save(content: DataFrame, path: str) -> None:
    """One text file for each file, in a folder for each file_id."""
    content.select("file_id", F.col("content").alias("value")).repartition("file_id").write.partitionBy("file_id").text(path)
