"""Vector drawings, clips, perspective and placed gradients. Drawings are arrays of segments (kind, p: x and y of each point)."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<kind:string,p:array<double>>>"
#: Numbers that a drawing command takes for one segment, and steps of the search along a curve
TAKES = {"m": 2, "l": 2, "b": 6}
STEPS = 100


def decode(text: str, scale: int = 1) -> list[tuple[str, list[float]]]:
    """Segments of a drawing: m a point, l two points, b four, each from where the last one ended. A line or curve at the very
    start begins at (0, 0), which counts as a point. Numbers divide by 2^(scale - 1). Unknown commands take nothing."""
    out: list[tuple[str, list[float]]] = []
    here, command, got = [0.0, 0.0], "m", []
    for word in text.split(" "):
        try:
            got.append(float(word) / (1 << (scale - 1)))
        except ValueError:
            if len(word) == 1:
                command, got = word, []
            continue
        if len(got) != TAKES.get(command):
            continue
        if command != "m" and not out:
            out.append(("m", list(here)))
        out.append((command, got if command == "m" else here + got))
        here, got = got[-2:], []
    return out


def segments(c: Column | str, scale: int = 1) -> Column:
    """Null drawings have null, empty ones no segments."""

    @F.pandas_udf(SEGMENTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"kind": k, "p": p} for k, p in decode(t, scale)])

    return run(c)


def encode(c: Column | str, scale: int = 1) -> Column:
    """Drawing text of segments, a command where it changes, numbers with three decimals at most."""

    def number(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x * float(1 << (scale - 1))), r"\.?0+$", ""), "^-0$", "0")

    one = lambda s: F.array_join(F.transform(F.when(s["kind"] == "m", s["p"]).otherwise(F.slice(s["p"], 3, 6)), number), " ")
    before = lambda i: F.get(c, i - 1)["kind"]
    said = lambda s, i: F.when((i > 0) & (before(i) == s["kind"]), "").otherwise(F.concat(s["kind"], F.lit(" ")))
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda s, i: F.concat(said(s, i), one(s))), " ")


def point(p: Column, t: Column | float) -> Column:
    """(x, y) at share t of a segment's points: a point, a straight line or a cubic curve."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    u = 1 - t

    def at(k: int) -> Column:
        q = [F.get(p, F.lit(k + 2 * i)) for i in range(4)]
        curve = q[0] * u * u * u + q[1] * t * u * u * 3 + q[2] * t * t * u * 3 + q[3] * t * t * t
        return F.when(F.size(p) == 2, q[0]).when(F.size(p) == 4, q[0] * u + q[1] * t).otherwise(curve)

    return F.struct(at(0).alias("x"), at(1).alias("y"))


def halves(p: Column, t: float) -> Column:
    """The two parts of a segment's points, cut at share t, by repeated division of its control polygon."""
    mix = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 2), F.slice(a, 3, F.size(a)), lambda x, y: x * (1 - t) + y * t)
    ends = lambda rows: (F.flatten(F.array(*(F.slice(r, 1, 2) for r in rows))), F.flatten(F.array(*(F.slice(r, -2, 2) for r in rows[::-1]))))
    line = [p, mix(p)]
    curve = [p, mix(p), mix(mix(p)), mix(mix(mix(p)))]
    pick = lambda k: F.when(F.size(p) == 2, p).when(F.size(p) == 4, ends(line)[k]).otherwise(ends(curve)[k])
    return F.struct(pick(0).alias("first"), pick(1).alias("second"))


def nearest(p: Column, x: Column, y: Column) -> Column:
    """Share t at which a segment comes nearest to (x, y): exact for a line, the best of 101 places, earliest first, for a curve."""
    q = [F.get(p, F.lit(k)) for k in range(4)]
    dx, dy = q[2] - q[0], q[3] - q[1]
    along = ((x - q[0]) * dx + (y - q[1]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    line = F.greatest(F.lit(0.0), F.least(F.coalesce(along, F.lit(0.0)), F.lit(1.0)))
    away = lambda t: (point(p, t)["x"] - x) * (point(p, t)["x"] - x) + (point(p, t)["y"] - y) * (point(p, t)["y"] - y)
    tries = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: F.struct(away(k / STEPS).alias("d"), (k / STEPS).alias("t")))
    return F.when(F.size(p) == 2, 0.0).when(F.size(p) == 4, line).otherwise(F.array_min(tries)["t"])


def smoothed(c: Column | str, amount: float) -> Column:
    """Straight segments of a drawing of three at least become curves whose control points follow their neighbours, at amount 0 to 1."""
    amount = min(max(amount, 0.0), 1.0)

    def one(rows: list) -> list[dict]:
        segs = [(r["kind"], np.asarray(r["p"], float).reshape(-1, 2)) for r in rows]
        if len(segs) < 3:
            return [{"kind": k, "p": q.ravel().tolist()} for k, q in segs]
        out = []
        for i, (kind, q) in enumerate(segs):
            if kind == "l" and (q[0] != q[1]).any():
                # segments before are curves already: only where they begin counts
                path = np.stack([out[i - 1]["p"][:2] if i else segs[-1][1][0], q[0], q[1], segs[(i + 1) % len(segs)][1][-1]])
                mid, size = (path[:-1] + path[1:]) / 2, np.linalg.norm(np.diff(path, axis=0), axis=1)
                handle = []
                for k in (0, 1):
                    m = mid[k] + (mid[k + 1] - mid[k]) * size[k] / (size[k] + size[k + 1])
                    handle.append(q[k] + (mid[1] - m) * amount)
                kind, q = "b", np.stack([q[0], *handle, q[1]])
            out.append({"kind": kind, "p": q.ravel().tolist()})
        return out

    @F.pandas_udf(SEGMENTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda r: None if r is None else one(list(r)))

    return run(c)


def bounds(c: Column | str) -> Column:
    """(left, top, right, bottom) of all points of segments, control points too; null for none."""
    c = F.col(c) if isinstance(c, str) else c
    xy = F.flatten(F.transform(c, lambda s: s["p"]))
    axis = lambda k: F.filter(xy, lambda v, i: i % 2 == k)
    return F.struct(F.array_min(axis(0)).alias("left"), F.array_min(axis(1)).alias("top"), F.array_max(axis(0)).alias("right"), F.array_max(axis(1)).alias("bottom"))


def clip_value(c: Column | str) -> Column:
    r"""(inverse, x1, y1, x2, y2) of a rectangular \clip or \iclip in a text, null where there is none or a drawing."""
    num = r"\s*(-?[0-9]*\.?[0-9]+)\s*"
    pattern = r"\\(i?)clip\(" + ",".join([num] * 4) + r"\)"
    parts = [F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("double") for k in range(2, 6)]
    found = F.struct((F.regexp_extract(c, pattern, 1) == "i").alias("inverse"), *(x.alias(n) for x, n in zip(parts, ("x1", "y1", "x2", "y2"))))
    return F.when(parts[0].isNotNull(), found)


def perspective(x: Column, y: Column, quad: list[Column]) -> Column:
    """Where (x, y) of the unit square goes when its corners, from (0, 0) clockwise in a picture, go to quad's x0, y0, ... y3;
    null where that lies at infinity. The closed form of a homography of the square."""
    x0, y0, x1, y1, x2, y2, x3, y3 = quad
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    den = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = (sx * by - bx * sy) / den, (ax * sy - sx * ay) / den
    w = F.nullif(g * x + h * y + 1, F.lit(0.0))
    put = lambda a0, a1, a3: ((a1 - a0 + g * a1) * x + (a3 - a0 + h * a3) * y + a0) / w
    return F.struct(put(x0, x1, x3).alias("x"), put(y0, y1, y3).alias("y"))


# ---------------------------------------------------------------- placed gradients


def gradient_parts(value: str) -> list[str]:
    """What commas outside inner brackets part in a bracketed value; nothing if it isn't bracketed."""
    if not re.fullmatch(r"(?s)\(.*\)", value):
        return []
    parts, depth = [""], 0
    for ch in value[1:-1]:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


def _finite(text: str) -> float | None:
    try:
        x = float(text) if "_" not in text else math.nan
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def placed_gradient(c: Column | str) -> Column:
    """(left, top, right, bottom, rest) of a value of two corners, an angle and two stops at least, corners put in order and rest
    the value without them; null for any other value."""

    def one(value: str | None) -> list[dict] | None:
        parts = gradient_parts(value or "")
        numbers = [_finite(p) for p in parts[:5]]
        if len(parts) < 7 or None in numbers or "" in parts:
            return None
        x, y = sorted(numbers[0:4:2]), sorted(numbers[1:4:2])
        return [{"left": x[0], "top": y[0], "right": x[1], "bottom": y[1], "rest": f"({','.join(parts[4:])})"}]

    @F.pandas_udf("array<struct<left:double,top:double,right:double,bottom:double,rest:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.get(run(c), F.lit(0))


def gradient_text(left: Column, top: Column, right: Column, bottom: Column, rest: Column) -> Column:
    """The value with its corners in front, twelve significant digits; rest alone where a corner is null or rest isn't bracketed."""

    @F.pandas_udf("string")
    def number(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else f"{v + 0.0:.12g}")

    corners = F.concat(*(x for c in (left, top, right, bottom) for x in (number(c), F.lit(","))))
    return F.when(corners.isNotNull() & rest.rlike(r"(?s)^\(.*\)$"), F.concat(F.lit("("), corners, F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)
