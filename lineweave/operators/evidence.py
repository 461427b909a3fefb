"""Runs in frame-by-frame evidence, row clusters, motion samples and audio blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.windows import islands


def scan_window():
    return Window.partitionBy("scan_id").orderBy("frame")


def presence(frames: DataFrame, enter: float, leave: float) -> DataFrame:
    """Hysteresis over (scan_id, frame, coverage, ocr_box): on from `enter`, off below `leave`, between them as before; without a
    box it is off whatever the coverage; negative coverage holds. A null box doesn't veto. The state is off at first."""
    c = F.col("coverage")
    state = F.when(c < 0, F.lit(None).cast("boolean")).when(~F.col("ocr_box"), False).when(c >= enter, True).when(c < leave, False)
    w = scan_window().rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("_s", state).withColumn("present", F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(False))).drop("_s")


def fill_dips(frames: DataFrame, shortest: int) -> DataFrame:
    """Absent runs of fewer frames, between present ones, count as present."""
    rows = islands(frames, F.col("present"), ["scan_id"], "frame")
    run, scan = Window.partitionBy("scan_id", "island"), Window.partitionBy("scan_id")
    rows = rows.withColumns({"_n": F.count("*").over(run), "_last": F.max("island").over(scan)})
    inner = (F.col("island") > 1) & (F.col("island") < F.col("_last")) & (F.col("_n") < shortest)
    return rows.withColumn("present", F.col("present") | inner).drop("island", "_n", "_last")


def runs(frames: DataFrame) -> DataFrame:
    """First and last frame of each present run."""
    rows = islands(frames, F.col("present"), ["scan_id"], "frame").where("present")
    return rows.groupBy("scan_id", "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames")).drop("island")


def run_at(frames: DataFrame, anchor: int) -> DataFrame:
    return runs(frames).where((F.col("first_frame") <= anchor) & (F.col("last_frame") >= anchor))


def merge_same_interval(events: DataFrame) -> DataFrame:
    """Events of one scan with equal bounds become one, their texts joined top down, with the mean confidence and, of the edges
    that the events have, the box around all."""
    one = F.transform(F.sort_array(F.collect_list(F.struct("top", "text"))), lambda x: x["text"])
    box = [f(c).alias(c) for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max)) if c in events.columns]
    return events.groupBy("scan_id", "first_frame", "last_frame").agg(F.array_join(one, "\n").alias("text"), F.avg("confidence").alias("confidence"), *box)


def mean_abs_diff(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def coverage(template: Column | str, image: Column | str, tolerance: float) -> Column:
    """Share of elements that differ by at most the tolerance."""
    return F.size(F.filter(F.zip_with(template, image, lambda x, y: F.abs(x - y)), lambda d: d <= tolerance)) / F.size(template)


def settle(frames: DataFrame, column: str, limit: float) -> DataFrame:
    """Mean difference from the frame before and whether it is settled."""
    w = scan_window()
    return frames.withColumn("diff", mean_abs_diff(column, F.lag(column).over(w))).withColumn("settled", F.col("diff") <= limit)


def cluster_rows(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Boxes (scan_id, frame, box_id, top, bottom) of a frame in rows: each joins the first row, top down, with which it
    shares half the lower height."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        out = []
        p = p.sort_values(["top", "box_id"], kind="stable")
        for t, b in zip(p.top, p.bottom):
            for k, r in enumerate(rows):
                if min(b, r[1]) - max(t, r[0]) >= share * min(b - t, r[1] - r[0]):
                    r[0], r[1] = min(t, r[0]), max(b, r[1])
                    out.append(k)
                    break
            else:
                rows.append([t, b])
                out.append(len(rows) - 1)
        return p.assign(cluster=np.array(out, np.int32))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema.fields)
    return boxes.groupBy("scan_id", "frame").applyInPandas(run, names + ", cluster int")


def text_pixels(rgb: Column | str, deviation: int) -> Column:
    """Places of the pixels of an image (red, green, blue by turns) that look like burnt-in text: much lighter or darker than the
    commonest brightness, or, if those are fewer than one in 64, with a channel that differs from the mean colour there by the
    deviation. An empty image has none."""

    def one(values) -> np.ndarray:
        px = np.asarray(values, np.int64).reshape(-1, 3)
        if not len(px):
            return np.zeros(0, np.int32)
        light = px.sum(1) // 3
        common = int(np.bincount(light // 8, minlength=32).argmax()) * 8
        ground = px[(light >= common) & (light < min(255, common + 8))]
        ground = ground.sum(0) // len(ground) if len(ground) else np.zeros(3, np.int64)
        base = int(ground.sum()) // 3
        bright, dark = light >= np.clip(base + 80, 195, 235), light <= np.clip(base - 80, 25, 60)
        text = bright if base < 140 else dark if base > 200 else bright | dark
        if text.sum() < len(px) // 64:
            text = np.abs(px - ground).max(1) >= deviation
        return np.flatnonzero(text).astype(np.int32)

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else one(v))

    return run(rgb)


#: Fixed value: how far, in pixels, the extents of a colour may differ from those at the anchor
EXTENT = 5


def align_to_point(frames: DataFrame, anchors: DataFrame) -> DataFrame:
    """(scan_id, first_frame, last_frame): where a patch of colour stands around an anchor (scan_id, anchor). frames: (scan_id, frame, found,
    left, right, up, down), every frame from the first to the last, found and the extents of the colour from the point. Every
    second frame from the anchor counts; the one before the first that lacks the patch is looked at too. Scans whose anchor
    lacks it have no row."""
    scan = Window.partitionBy("scan_id")
    order = scan.orderBy("frame")
    edges = ("left", "right", "up", "down")
    rows = frames.join(anchors.select("scan_id", "anchor"), "scan_id")
    rows = rows.withColumn("_a", F.max(F.when((F.col("frame") == F.col("anchor")) & F.col("found"), F.struct(*edges))).over(scan))
    near = F.coalesce(F.col("found"), F.lit(False))
    for e in edges:
        near = near & (F.abs(F.col(e) - F.col("_a")[e]) <= EXTENT)
    rows = rows.where("_a IS NOT NULL").withColumn("_ok", F.coalesce(near, F.lit(False)))
    rows = rows.withColumns({"_before": F.lag("_ok").over(order), "_after": F.lead("_ok").over(order)})
    far = F.col("frame") - F.col("anchor")
    gone = (far % 2 == 0) & ~F.col("_ok")
    right = F.min(F.when(gone & (far > 0), F.struct("frame", (F.col("frame") - F.when(F.col("_before"), 1).otherwise(2)).alias("to"))))
    left = F.max(F.when(gone & (far < 0), F.struct("frame", (F.col("frame") + F.when(F.col("_after"), 1).otherwise(2)).alias("to"))))
    out = rows.groupBy("scan_id").agg(left.alias("l"), right.alias("r"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    return out.select("scan_id", F.coalesce("l.to", "a").alias("first_frame"), F.coalesce("r.to", "b").alias("last_frame"))


# ---------------------------------------------------------------- motion samples


def last_writer(samples: DataFrame) -> DataFrame:
    """Of the samples (track_id, segment, frame, ...) of a frame that of the last segment."""
    w = Window.partitionBy("track_id", "frame").orderBy(F.col("segment").desc())
    return samples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repair_spikes(samples: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """A point that is further than the limit from both neighbours and from where the line between them puts its frame goes
    there. columns: the coordinates of a point, or one scalar. A track's first and last frames stay."""
    w = Window.partitionBy("track_id").orderBy("frame")
    f, before, after = F.col("frame"), F.lag("frame").over(w), F.lead("frame").over(w)
    share = (f - before) / F.greatest(after - before, F.lit(1))
    old = {c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w)) for c in columns}
    between = {c: a + (b - a) * share for c, (a, _, b) in old.items()}
    far = lambda d: F.sqrt(sum((d(c) * d(c) for c in columns), F.lit(0.0))) > limit
    spike = far(lambda c: old[c][1] - between[c]) & far(lambda c: old[c][1] - old[c][0]) & far(lambda c: old[c][1] - old[c][2])
    return samples.withColumns({c: F.when(spike, between[c]).otherwise(old[c][1]) for c in columns})


def hold_jitter(samples: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """A point nearer than the limit to the one held stays there. Depends on all points before, so each track is a fold; its
    first and last frames stay."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame")
        at = p[columns].to_numpy(float)
        for k in range(1, len(at) - 1):
            if np.sqrt(((at[k] - at[k - 1]) ** 2).sum()) < limit:
                at[k] = at[k - 1]
        return p.assign(**{c: at[:, k] for k, c in enumerate(columns)})

    return samples.groupBy("track_id").applyInPandas(run, samples.schema)


def straighten(samples: DataFrame, column: str) -> DataFrame:
    """Linear from the first to the last frame of each track's run of consecutive frames."""
    rows = samples.withColumn("_run", F.col("frame") - F.row_number().over(Window.partitionBy("track_id").orderBy("frame")))
    w = Window.partitionBy("track_id", "_run").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b, f, g = F.first(column).over(w), F.last(column).over(w), F.first("frame").over(w), F.last("frame").over(w)
    return rows.withColumn(column, F.when(g > f, a + (b - a) * (F.col("frame") - f) / (g - f)).otherwise(a)).drop("_run")


# ---------------------------------------------------------------- audio


def peaks(samples: DataFrame, width: int) -> DataFrame:
    """Least, greatest and mean sample of each column of `width` samples of (track_id, idx, value)."""
    return samples.groupBy("track_id", F.floor(F.col("idx") / width).alias("column")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def downmix(channels: Column | str) -> Column:
    return F.aggregate(channels, F.lit(0).cast("bigint"), lambda s, x: s + x).cast("double") / F.size(channels)


def volume(value: Column, factor: float) -> Column:
    return F.greatest(F.least((value * factor).cast("int"), F.lit(32767)), F.lit(-32768))


def double_rate(samples: DataFrame) -> DataFrame:
    """Twice the samples: each followed by the mean of it and the next (the last by itself)."""
    w = Window.partitionBy("track_id").orderBy("idx")
    half = F.floor((F.col("value") + F.coalesce(F.lead("value").over(w), "value")) / 2).cast("int")
    return samples.withColumn("_h", half).select("track_id", F.explode(F.array(F.struct((F.col("idx") * 2).alias("idx"), F.col("value").cast("int").alias("value")), F.struct((F.col("idx") * 2 + 1).alias("idx"), F.col("_h").alias("value")))).alias("s")).select("track_id", "s.idx", "s.value")


def spectrum(block: Column | str, user_size: int | None = None) -> Column:
    """Log magnitudes of the lower half of the Fourier transform of a block of 16-bit samples: log10(9 m + 1) of magnitudes m that
    are relative to the root of twice its length. user_size: the length for which levels are wanted, where a higher sampling
    rate has made the block longer."""

    def one(x) -> list[float]:
        level = 9 / np.sqrt(2 * len(x)) / np.sqrt(len(x) / (user_size or len(x)))
        return np.log10(1 + level * np.abs(np.fft.rfft(np.asarray(x, float) / 32768))[: max(1, len(x) // 2)]).tolist()

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x) if len(x) else [])

    return run(block)


def upsert_samples(samples: DataFrame, new: DataFrame) -> DataFrame:
    """Samples (track_id, segment, frame, ...) of both tables; where both have a frame of a segment, the new one."""
    keys = ["track_id", "segment", "frame"]
    return samples.join(new.select(keys), keys, "left_anti").select(samples.columns).unionByName(new.select(samples.columns))


def owned(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Samples within the bounds of their enabled segment (track_id, segment, first_frame, last_frame, enabled)."""
    s = segments.where("enabled").select("track_id", "segment", "first_frame", "last_frame")
    return samples.join(s, ["track_id", "segment"]).where("frame between first_frame and last_frame").select(samples.columns)


def row_signature(luma: Column | str, width: Column | str, height: Column | str, across: int = 16, down: int = 8, deviation: int = 40) -> Column:
    """For each cell of a grid over an image, the share (0..255) of pixels that are so far off the median luminance. Images
    without pixels, or with a size that doesn't fit, give zeros."""

    def one(pixels, w: int, h: int) -> list[int]:
        if pixels is None or not len(pixels) or len(pixels) != w * h:
            return [0] * (across * down)
        p = np.asarray(pixels, np.int64)
        far = (np.abs(p - np.sort(p)[len(p) // 2]) >= deviation).reshape(h, w)
        ys, xs = [k * h // down for k in range(down + 1)], [k * w // across for k in range(across + 1)]
        cells = [far[a:b, c:d] for a, b in zip(ys, ys[1:]) for c, d in zip(xs, xs[1:])]
        return [int(x.sum()) * 255 // x.size if x.size else 0 for x in cells]

    @F.pandas_udf("array<int>")
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(p, w, h)])

    return run(luma, width, height)


def signature_distance(a: Column | str, b: Column | str) -> Column:
    """Mean difference of two signatures, 0 to 1; 1 if they are empty or differ in length."""
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), mean_abs_diff(a, b) / 255).otherwise(1.0)


def near_center(left: Column, right: Column, width: Column, band: float) -> Column:
    """Whether a box's middle lies in the band (in percent of the width) around the middle; all do from 100 on."""
    middle = F.floor((left + right) / 2)
    return F.lit(band >= 100) | (width <= 0) | (F.abs(middle - width / 2) <= band / 200 * width)


def snap_boundary(frames: DataFrame, leave: float, earliest: bool = True) -> DataFrame:
    """(scan_id, frame): first (or last) frame of each scan whose coverage is at least `leave` and that a box confirms; null
    where no frame is so."""
    hit = F.when((F.col("coverage") >= leave) & F.col("ocr_box"), F.col("frame"))
    return frames.groupBy("scan_id").agg((F.min(hit) if earliest else F.max(hit)).alias("frame"))


def ambiguous(frames: DataFrame, bounds: DataFrame, leave: float, start: bool = True) -> DataFrame:
    """bounds (scan_id, frame) with `ambiguous`: the boundary has no evidence, or one of the two frames beyond it is missing
    while evidence goes on, or covered."""
    side = -1 if start else 1
    outer = F.lead if side > 0 else F.lag
    w = scan_window()
    bad = F.lit(False)
    for k in (1, 2):
        f = outer("frame", k).over(w)
        bad = bad | (f.isNotNull() & ((f != F.col("frame") + side * k) | (outer("coverage", k).over(w) >= leave)))
    seen = frames.withColumn("_bad", bad).select("scan_id", "frame", "_bad")
    return bounds.join(seen, ["scan_id", "frame"], "left").withColumn("ambiguous", F.coalesce("_bad", F.lit(True))).drop("_bad")


# ---------------------------------------------------------------- regions of frames


def crop(pixels: Column | str, width: Column | str, left: int, top: int, across: int, down: int, channels: int = 3) -> Column:
    """A rectangle of an image of interleaved channels, as such an image. Null where it isn't within the image."""
    c, w = (F.col(x) if isinstance(x, str) else x for x in (pixels, width))
    inside = (left + across <= w) & ((top + down) * w * channels <= F.size(c)) & F.lit(left >= 0 and top >= 0 and across > 0 and down > 0)
    rows = F.transform(F.sequence(F.lit(0), F.lit(max(down, 1) - 1)), lambda y: F.slice(c, ((y + top) * w + left) * channels + 1, across * channels))
    return F.when(inside, F.flatten(rows))


def histogram_mode(values: Column | str, bins: int = 32) -> Column:
    """The bin, of 256 values in equal bins, that most values lie in, the lowest of equally full ones; null without values."""
    c = F.col(values) if isinstance(values, str) else values
    place = F.transform(c, lambda x: F.floor(x * bins / 256).cast("int"))
    count = lambda k: F.size(F.filter(place, lambda x: x == k))
    found = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.struct(count(k).alias("n"), (-k).alias("k")))
    return F.when(F.size(c) > 0, -F.array_max(found)["k"])


def channel_means(pixels: Column | str, channels: int = 3) -> Column:
    """Mean of each channel of an image of interleaved channels; an empty image has none."""
    c = F.col(pixels) if isinstance(pixels, str) else pixels
    of = lambda k: F.filter(c, lambda x, i: i % channels == k)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(F.size(c) >= channels, F.array(*(mean(of(k)) for k in range(channels))))


def changed_ratio(a: Column | str, b: Column | str, limit: int, channels: int = 3) -> Column:
    """Share of pixels of two images of interleaved channels of which one channel differs by more than the limit; 1 where the
    sizes differ, 0 where both are empty."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    far = F.zip_with(a, b, lambda x, y: F.abs(x - y) > limit)
    pixels = F.sequence(F.lit(0), F.floor(F.size(a) / channels) - 1)
    hit = F.filter(pixels, lambda p: F.exists(F.slice(far, (p * channels + 1).cast("int"), channels), lambda x: x))
    return F.when(F.size(a) != F.size(b), 1.0).when(F.size(a) < channels, 0.0).otherwise(F.size(hit) / F.floor(F.size(a) / channels))


def accumulated(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Offsets (track_id, segment, frame, ...) of segments that follow each other, each carried on from where the one before
    ended: the last offset of all earlier segments is added."""
    ends = samples.groupBy("track_id", "segment").agg(*(F.max_by(c, "frame").alias(f"_{c}") for c in columns))
    w = Window.partitionBy("track_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("track_id", "segment", *(F.coalesce(F.sum(f"_{c}").over(w), F.lit(0.0)).alias(f"_{c}") for c in columns))
    out = samples.join(base, ["track_id", "segment"])
    return out.select(*((F.col(c) + F.col(f"_{c}")).alias(c) if c in columns else c for c in samples.columns))


def nearest_track(detections: DataFrame, tracks: DataFrame, limit: float) -> DataFrame:
    """Each detection (scan_id, det_id, signature) with the track (scan_id, track_id, signature) of its scan that is nearest by
    signature_distance(), the first of equals; null where none is within the limit. A scan's tracks are few."""
    t = tracks.select("scan_id", "track_id", F.col("signature").alias("_s"))
    d = signature_distance("signature", "_s")
    pairs = detections.join(t, "scan_id").select("scan_id", "det_id", "track_id", d.alias("distance")).where(F.col("distance") <= limit)
    best = pairs.groupBy("scan_id", "det_id").agg(F.min(F.struct("distance", "track_id")).alias("b"))
    return detections.select("scan_id", "det_id").join(best, ["scan_id", "det_id"], "left").select("scan_id", "det_id", "b.track_id", "b.distance")


def region_hash(pixels: Column | str) -> Column:
    """FNV-1a of an image's bytes in 64 bits, as 16 hexadecimal digits."""

    def one(x) -> str:
        h = 0xCBF29CE484222325
        for v in x:
            h = (h ^ (int(v) & 255)) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x))

    return run(pixels)
