"""Operators on line times: shifting, lead-in and lead-out, gaps, keyframes, frame rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.tags import retimed
from lineweave.functions.times import clamp, frame_at, time_at
from lineweave.operators.windows import asof, by_file

BEFORE = (Window.unboundedPreceding, 0)


def shift(lines: DataFrame, ms: int, start: bool = True, end: bool = True, selected: Column | None = None, onward: bool = False) -> DataFrame:
    """Moves starts and ends by ms; of all lines, of the selected, or from the first selected on."""
    hit = F.lit(True) if selected is None else selected
    if onward:
        hit = F.max(hit.cast("int")).over(by_file().rowsBetween(*BEFORE)) == 1
    out = lines.withColumn("_hit", hit)
    for name, on in (("start_ms", start), ("end_ms", end)):
        if on:
            out = out.withColumn(name, F.when(F.col("_hit"), clamp(F.col(name) + ms)).otherwise(F.col(name)).cast("int"))
    return out.drop("_hit")


def shift_frames(lines: DataFrame, frames: int, num: int, den: int) -> DataFrame:
    return lines.withColumns({"start_ms": clamp(time_at(frame_at("start_ms", num, den, "start") + frames, num, den, "start")), "end_ms": clamp(time_at(frame_at("end_ms", num, den, "end") + frames, num, den, "end"))})


def lead_in(lines: DataFrame, ms: int) -> DataFrame:
    """Earlier starts, not before the latest end of the lines that end before."""
    ends = lines.select("file_id", F.col("end_ms").alias("start_ms"), F.col("end_ms").alias("limit"))
    out = asof(lines, ends, ["file_id"], "start_ms", "limit")
    return out.withColumn("start_ms", F.greatest(F.col("start_ms") - ms, F.coalesce("limit", F.lit(0))).cast("int")).drop("limit")


def lead_out(lines: DataFrame, ms: int) -> DataFrame:
    """Later ends, not past the next start of the lines that begin after."""
    starts = lines.select("file_id", F.col("start_ms").alias("end_ms"), F.col("start_ms").alias("limit"))
    out = asof(lines, starts, ["file_id"], "end_ms", "limit", forward=True)
    return out.withColumn("end_ms", F.least(F.col("end_ms") + ms, F.col("limit")).cast("int")).drop("limit")


def make_adjacent(lines: DataFrame, gap: int, overlap: int, bias: float = 0.5) -> DataFrame:
    """Neighbours by start that are less than gap apart, or overlap by less than overlap, meet at the point between that the
    bias says."""
    w = by_file("start_ms", "row_no")
    out = lines.withColumns({"_pe": F.lag("end_ms").over(w), "_ns": F.lead("start_ms").over(w), "_s": F.col("start_ms"), "_e": F.col("end_ms")})

    def meet(a: str, b: str) -> Column:
        d = F.col(b) - F.col(a)
        near = ((d > 0) & (d <= gap)) | ((d < 0) & (-d <= overlap))
        return F.when(near, F.col(a) + (d * bias).cast("int"))

    return out.withColumns({"start_ms": F.coalesce(meet("_pe", "_s"), "_s").cast("int"), "end_ms": F.coalesce(meet("_e", "_ns"), "_e").cast("int")}).drop("_pe", "_ns", "_s", "_e")


def snap(lines: DataFrame, keyframes: DataFrame, column: str, before: int, after: int) -> DataFrame:
    """column goes to the nearest key time (file_id, key_ms), the earlier of two equally near, if it lies at most `before` ms
    before or `after` ms after it."""
    keys = keyframes.select("file_id", F.col("key_ms").alias(column), "key_ms")
    out = asof(asof(lines, keys, ["file_id"], column, "key_ms", name="_low"), keys, ["file_id"], column, "key_ms", forward=True, name="_high")
    low, high, c = F.col("_low"), F.col("_high"), F.col(column)
    near = F.when(high.isNull() | (c - low <= high - c), low).otherwise(high)
    ok = ((c - near >= 0) & (c - near <= after)) | ((near - c >= 0) & (near - c <= before))
    return out.withColumn(column, F.when(ok, near).otherwise(c).cast("int")).drop("_low", "_high")


def post_process(lines: DataFrame, lead_before: int = 0, lead_after: int = 0, gap: int = 0, overlap: int = 0, bias: float = 0.5, keyframes: DataFrame | None = None, thresholds: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Lead-in, lead-out, adjacency and snapping, each on what the one before gives. Comments stay as they are; a negative
    duration of another line is an error."""
    comments, lines = lines.where("comment"), lines.where(~F.col("comment"))
    if lines.where("end_ms < start_ms").limit(1).count():
        raise ValueError("a line ends before it begins")
    out = lead_in(lines, lead_before) if lead_before else lines
    out = lead_out(out, lead_after) if lead_after else out
    out = make_adjacent(out, gap, overlap, bias) if gap or overlap else out
    if keyframes is not None:
        out = snap(snap(out, keyframes, "start_ms", *thresholds[:2]), keyframes, "end_ms", *thresholds[2:])
    return out.select(lines.columns).unionByName(comments)


def snap_to_keyframes(lines: DataFrame, keyframes: DataFrame, rate: tuple[int, int], thresholds: tuple[int, int, int, int]) -> DataFrame:
    """Starts go to the nearest key frame (file_id, frame), the earlier of two equally near, ends to the end of the frame before the
    nearest; if the new time lies within the thresholds in ms: of starts before and after, of ends before and after."""
    keys = F.sort_array(F.collect_set("frame"))
    k = keyframes.groupBy("file_id").agg(keys.alias("_keys"))
    out = lines.join(k, "file_id", "left")
    for column, mode, (before, after) in (("start_ms", "start", thresholds[:2]), ("end_ms", "end", thresholds[2:])):
        frame = frame_at(column, *rate, mode)
        out = out.withColumn("_f", frame)
        low = F.array_max(F.filter("_keys", lambda x: x <= F.col("_f")))
        high = F.array_min(F.filter("_keys", lambda x: x > F.col("_f")))
        near = F.when(low.isNull() | (high - F.col("_f") < F.col("_f") - low), high).otherwise(low) - (1 if mode == "end" else 0)
        time, c = time_at(near, *rate, mode), F.col(column)
        ok = ((near > F.col("_f")) & (time - c <= before)) | ((near < F.col("_f")) & (c - time <= after))
        out = out.withColumn(column, F.when(ok, clamp(time)).otherwise(c).cast("int"))
    return out.select(lines.columns)


def snap_to_frame(lines: DataFrame, selected: Column, frame: int, rate: tuple[int, int], start: bool = True) -> DataFrame:
    """Starts (or ends) of selected lines go to where a frame begins (or ends); the other end follows where it would lie beyond."""
    a, b = (clamp(time_at(F.lit(frame), *rate, mode)).cast("int") for mode in ("start", "end"))
    new_start = a if start else F.least("start_ms", a)
    new_end = F.greatest("end_ms", b) if start else b
    return lines.withColumns({"start_ms": F.when(selected, new_start).otherwise(F.col("start_ms")), "end_ms": F.when(selected, new_end).otherwise(F.col("end_ms"))})


def snap_to_scene(lines: DataFrame, keyframes: DataFrame, selected: Column, frame: int, rate: tuple[int, int], frames: int) -> DataFrame:
    """Selected lines take the time between the key frames (file_id, frame) about a frame: the last one up to it (else 0), and the
    first after it, else the number of frames of the video. Files without key frames stay."""
    k = keyframes.groupBy("file_id").agg(F.max(F.when(F.col("frame") <= frame, F.col("frame"))).alias("_a"), F.min(F.when(F.col("frame") > frame, F.col("frame"))).alias("_b"), F.lit(True).alias("_has"))
    out = lines.join(k, "file_id", "left")
    start = clamp(time_at(F.coalesce("_a", F.lit(0)), *rate, "start")).cast("int")
    end = clamp(time_at(F.coalesce("_b", F.lit(frames)) - 1, *rate, "end")).cast("int")
    hit = selected & F.coalesce("_has", F.lit(False))
    return out.withColumns({"start_ms": F.when(hit, start).otherwise(F.col("start_ms")), "end_ms": F.when(hit, end).otherwise(F.col("end_ms"))}).select(lines.columns)


def align_to(lines: DataFrame, selected: Column, active: DataFrame, frame: int, rate: tuple[int, int]) -> DataFrame:
    """Shifts the selected lines of each file so that its active line (file_id, id) begins where a frame does."""
    a = active.join(lines, ["file_id", "id"]).select("file_id", (clamp(time_at(F.lit(frame), *rate, "start")) - F.col("start_ms")).alias("_by"))
    out = lines.join(a, "file_id", "left")
    by = F.when(selected, F.coalesce("_by", F.lit(0))).otherwise(0)
    return out.withColumns({c: clamp(F.col(c) + by).cast("int") for c in ("start_ms", "end_ms")}).select(lines.columns)


def make_continuous(lines: DataFrame, end: bool = True) -> DataFrame:
    """Ends go to the next start, or starts to the end before."""
    w = by_file()
    if end:
        return lines.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), "end_ms"))
    return lines.withColumn("start_ms", F.coalesce(F.lag("end_ms").over(w), "start_ms"))


def nudge(lines: DataFrame, start_units: int = 0, end_units: int = 0) -> DataFrame:
    """Start and end by units of 10 ms; neither passes the other."""
    s = F.least(clamp(F.col("start_ms") + 10 * start_units), F.col("end_ms"))
    return lines.withColumn("start_ms", s.cast("int")).withColumn("end_ms", F.greatest(F.col("end_ms") + 10 * end_units, F.col("start_ms")).cast("int"))


def monotone(marks: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Marks that never go back: each at least the greatest before."""
    return marks.withColumn(column, F.max(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*BEFORE)))


# ---------------------------------------------------------------- variable frame rates


def frames_of(lines: DataFrame, timecodes: DataFrame, column: str, name: str = "frame") -> DataFrame:
    """Frame shown at a time, by a table of (file_id, frame, ms)."""
    return asof(lines, timecodes.select("file_id", F.col("ms").alias(column), "frame"), ["file_id"], column, "frame", name=name)


def times_of(frames: DataFrame, timecodes: DataFrame) -> DataFrame:
    """Time of each (file_id, frame); beyond the last timecode at the mean rate of all."""
    t = timecodes.groupBy("file_id").agg(F.max("frame").alias("_last"), F.max("ms").alias("_end"), F.min("ms").alias("_first"))
    out = frames.join(t, "file_id", "left").join(timecodes.select("file_id", "frame", F.col("ms").alias("_ms")), ["file_id", "frame"], "left")
    beyond = F.col("_end") + F.round((F.col("frame") - F.col("_last")) * (F.col("_end") - F.col("_first")) / F.greatest(F.col("_last"), F.lit(1)))
    return out.withColumn("ms", F.coalesce("_ms", beyond.cast("int"))).drop("_last", "_end", "_first", "_ms")


def _moved(c: Column, source: tuple[int, int], target: tuple[int, int]) -> Column:
    f = frame_at(c, *source)
    old, new = ((time_at(f, *r), time_at(f + 1, *r)) for r in (source, target))
    return (new[0] + (new[1] - new[0]) * ((c - old[0]) / (old[1] - old[0]).cast("double"))).cast("int")


def _moved_int(ms: int, source: tuple[int, int], target: tuple[int, int]) -> int:
    """_moved() of one time that isn't negative."""
    begins = lambda f, r: (f * 1000 * r[1] + r[0] // 2) // r[0]
    f = (ms * source[0] + (source[0] + 1) // 2 - 1) // (1000 * source[1])
    old, new = ((begins(f, r), begins(f + 1, r)) for r in (source, target))
    return int(new[0] + (new[1] - new[0]) * ((ms - old[0]) / (old[1] - old[0])))


def transform_rate(lines: DataFrame, source: tuple[int, int], target: tuple[int, int], tags: bool = False) -> DataFrame:
    """Lines keep their frames, and their places within them, while the frame rate changes from source to target. Starts are
    cut and ends rounded up to 10 ms. With tags the times in override tags change likewise."""
    start = F.floor(_moved(F.col("start_ms"), source, target) / 10) * 10
    end = F.floor((_moved(F.col("end_ms"), source, target) + 9) / 10) * 10
    out = lines.withColumns({"_s": start.cast("int"), "_e": end.cast("int")})
    if tags:
        out = out.withColumn("text", retimed("text", "start_ms", "end_ms", "_s", "_e", lambda ms: _moved_int(ms, source, target)))
    return out.withColumns({"start_ms": clamp(F.col("_s")), "end_ms": clamp(F.col("_e"))}).select(lines.columns)
