"""Column functions on times in milliseconds and frame numbers. All arithmetic is on integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: largest time, 596 hours less 6 ms
LATEST = 596 * 3_600_000 - 6


def clamp(ms: Column) -> Column:
    return F.least(F.greatest(ms, F.lit(0)), F.lit(LATEST))


def centiseconds(ms: Column | str) -> Column:
    """The time as comparisons see it: half up to 10 ms."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return (c + 5) - (c + 5) % 10


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def parse(c: Column | str) -> Column:
    """h:mm:ss.cc or with a comma or three decimals, in ms; other characters are ignored."""
    clean = F.regexp_replace(F.regexp_replace(c, ",", "."), r"[^0-9:.]", "")
    whole, part = F.split_part(clean, F.lit("."), F.lit(1)), F.regexp_replace(F.substring_index(F.concat(clean, F.lit(".")), ".", 2), r"^[^.]*\.", "")
    units = F.transform(F.split(whole, ":"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
    seconds = F.aggregate(units, F.lit(0).cast("bigint"), lambda s, x: s * 60 + x)
    return clamp(seconds * 1000 + F.coalesce(F.rpad(F.substring(part, 1, 3), 3, "0").try_cast("bigint"), F.lit(0))).cast("int")


def format_ass(ms: Column | str) -> Column:
    t = _div(centiseconds(ms), 10)
    return F.format_string("%d:%02d:%02d.%02d", _div(t, 360000), _div(t, 6000) % 60, _div(t, 100) % 60, t % 100)


def format_srt(ms: Column | str) -> Column:
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.format_string("%02d:%02d:%02d,%03d", _div(c, 3600000), _div(c, 60000) % 60, _div(c, 1000) % 60, c % 1000)


def _whole(a: Column, b: int) -> Column:
    """Whole quotient of two integers, towards zero."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def frame_at(ms: Column | str, num: int, den: int, mode: str = "exact") -> Column:
    """Frame shown at a time at num / den frames a second, by the times in whole ms at which frames begin; start: first frame that
    begins at or after it, end: last that begins before it. Negative times have negative frames."""
    c = F.col(ms) if isinstance(ms, str) else ms

    def exact(t: Column) -> Column:
        later = _whole(t * F.lit(num).cast("bigint") + ((num + 1) // 2 - 1), den * 1000)
        return F.when(t < 0, _whole(_whole(t * F.lit(num).cast("bigint"), den) - 999, 1000)).otherwise(later)

    t = c.cast("bigint")
    if mode == "exact":
        return exact(t).cast("int")
    return (exact(t - 1) + (1 if mode == "start" else 0)).cast("int")


def time_at(frame: Column | str, num: int, den: int, mode: str = "exact") -> Column:
    """Time in ms at which a frame begins; start and end: midway to the frame before or after, rounded up."""
    f = F.col(frame) if isinstance(frame, str) else frame

    def exact(k: Column) -> Column:
        t = k.cast("bigint") * F.lit(den * 1000).cast("bigint")
        return _whole(F.when(k < 0, t).otherwise(t + num // 2), num).cast("int")

    if mode == "exact":
        return exact(f)
    a, b = (exact(f - 1), exact(f)) if mode == "start" else (exact(f), exact(f + 1))
    return (a + _whole((b - a + 1).cast("bigint"), 2)).cast("int")


def smpte(frame: Column | str, rate: int = 30, drop: bool = False) -> Column:
    """hh:mm:ss:ff. With drop frames, numbers 0 and 1 (and 2, 3 at 60) are left out in minutes that aren't tenth."""
    f = (F.col(frame) if isinstance(frame, str) else frame).cast("bigint")
    sep = ";" if drop else ":"
    if drop:
        lost = rate // 15
        minute, ten = rate * 60 - lost, rate * 600 - 9 * lost
        tens, rest = F.floor(f / ten), f % ten
        f = f + tens * 9 * lost + F.when(rest >= lost, lost * F.floor((rest - lost) / minute)).otherwise(0)
    s = F.floor(f / rate)
    return F.format_string(f"%02d:%02d:%02d{sep}%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"), (f % rate).cast("int"))


def frame_of_smpte(code: Column | str, rate: int = 30, drop: bool = False) -> Column:
    """Frame number, a long, of hh:mm:ss:ff. With drop frames a number that is left out stands for the
    next there is. What isn't four numbers within an int's range gives 0."""
    c = F.col(code) if isinstance(code, str) else code
    parts = F.transform(F.split(c, "[:;]"), lambda x: x.try_cast("int").cast("bigint"))
    h, m, s, f = (F.get(parts, F.lit(k)) for k in range(4))
    plain = ((h * 60 + m) * 60 + s) * rate + f
    if drop:
        lost = rate // 15
        minute, ten = rate * 60 - lost, rate * 600 - 9 * lost
        f = F.when((m % 10 != 0) & (s == 0) & (f < lost), lost).otherwise(f)
        plain = h * ten * 6 + F.floor(m / 10) * ten + m % 10 * minute + s * rate + f
    return F.when((F.size(parts) == 4) & plain.isNotNull(), plain).otherwise(0).cast("bigint")
