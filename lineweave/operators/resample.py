"""Lines and styles brought to another script resolution."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.functions.markup import _PIECE


@dataclass(frozen=True)
class Scale:
    """Factors across and down, the stretch of letters, and the margins (left, right, top) added before scaling."""

    x: float
    y: float
    stretch: float = 1.0
    left: int = 0
    right: int = 0
    top: int = 0


def scale(source: tuple[int, int], target: tuple[int, int], mode: str = "stretch", margins: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Scale:
    """How to get from one resolution to another; mode says what becomes of another shape: stretch, add_border,
    remove_border or manual (the given margins left, right, top, bottom). Shapes within 1 % of each other count as equal."""
    (w, h), (tw, th) = source, target
    old, new = w / h, tw / th
    left, right, top, bottom = margins
    stretch = 1.0
    if abs(old - new) / new > 0.01:
        if mode in ("add_border", "remove_border"):
            if (new > old) == (mode == "add_border"):
                left = right = int((h * new - w) / 2)
            else:
                top = bottom = int((w / new - h) / 2)
        elif mode == "stretch":
            stretch = new / old
        else:
            old = (w + left + right) / (h + top + bottom)
            stretch = new / old if abs(old - new) / new > 0.01 else 1.0
    return Scale(tw / (w + left + right), th / (h + top + bottom), stretch, left, right, top)


#: Tags by what their numbers measure. Sizes scale down the page; x and y are positions; whole ones are rounded.
SIZES = "xbord ybord bord xshad yshad shad fsp blur fs".split()
PLACES = {"pos": False, "move": False, "org": True, "clip": True, "iclip": True}
_SINGLE = re.compile(r"\\(" + "|".join([*SIZES, "fscx", "pbo", "be"]) + r")([-+]?(?:\d+\.?\d*|\.\d+))")
_PLACED = re.compile(r"\\(" + "|".join(PLACES) + r")\(([^()]*)\)")


def _short(v: float) -> str:
    return f"{v:.3f}".rstrip("0").rstrip(".")


def _whole(v: float) -> str:
    return str(int(v + 0.5))


def drawing(text: str, left: float, top: float, x: float, y: float) -> str:
    """A vector drawing moved and scaled, its coordinates rounded to eighths. Signs other than commands and numbers go."""
    out, across = [], True
    for part in text.split(" "):
        try:
            v = float(part)
        except ValueError:
            if len(part) == 1 and part.lower() in "mnlbspc":
                out.append(part.lower())
                across = True
            continue
        v = (v + left) * x if across else (v + top) * y
        eighths = int(abs(v) * 8 + 0.5)
        out.append(_short((eighths if v >= 0 else -eighths) / 8))
        across = not across
    return " ".join(out)


def _placed(m: re.Match, s: Scale) -> str:
    parts = [p.strip() for p in m[2].split(",")]
    if m[1] in ("clip", "iclip") and len(parts) != 4:
        parts[-1] = drawing(parts[-1], s.left, s.top, s.x, s.y)
        return f"\\{m[1]}({','.join(parts)})"
    write = _whole if PLACES[m[1]] else _short
    for k, p in enumerate(parts[:4]):
        v = re.match(r"[-+]?\d*\.?\d*", p)[0]
        try:
            number = int(float(v)) if PLACES[m[1]] else float(v)
        except ValueError:
            number = 0
        parts[k] = write((number + s.left) * s.x if k % 2 == 0 else (number + s.top) * s.y)
    return f"\\{m[1]}({','.join(parts)})"


def _single(m: re.Match, s: Scale) -> str:
    name, v = m[1], float(m[2])
    if name == "fscx":
        return f"\\{name}{_short(v * s.stretch)}"
    if name in ("be", "pbo"):
        return f"\\{name}{_whole((int(v) + (s.top if name == 'pbo' else 0)) * s.y)}"
    return m[0] if name == "fs" and m[2][0] in "+-" else f"\\{name}{_short(v * s.y)}"


def resample_text(c: Column | str, s: Scale) -> Column:
    """Positions, sizes and drawings of a text; tags within transforms too. Colours stay as they are."""

    def one(text: str) -> str:
        out, drawn = "", False
        for m in _PIECE.finditer(text):
            if m[1] is None:
                out += drawing(m[2], 0, 0, s.x / s.stretch, s.y) if drawn else m[2]
                continue
            for level in re.findall(r"\\p(\d+)", m[1]):
                drawn = int(level) > 0
            out += "{" + _SINGLE.sub(lambda t: _single(t, s), _PLACED.sub(lambda t: _placed(t, s), m[1])) + "}"
        return out

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda t: None if t is None else one(t))

    return run(c)


def _margins(df: DataFrame, s: Scale, zero_stays: bool) -> dict[str, Column]:
    out = {}
    for name, add, by in (("margin_l", s.left, s.x), ("margin_r", s.right, s.x), ("margin_v", s.top, s.y)):
        if name in df.columns:
            moved = ((F.col(name) + add) * by + 0.5).cast("int")
            out[name] = F.when(F.col(name) == 0, 0).otherwise(moved) if zero_stays else moved
    return out


def resample_lines(lines: DataFrame, s: Scale) -> DataFrame:
    """Texts and margins (0: the style's) of all lines but comments that hold templates or code."""
    kept = F.col("comment") & (F.col("effect").startswith("template") | F.col("effect").startswith("code"))
    new = {"text": resample_text("text", s), **_margins(lines, s, True)}
    return lines.withColumns({k: F.when(F.coalesce(kept, F.lit(False)), F.col(k)).otherwise(v) for k, v in new.items()})


def resample_styles(styles: DataFrame, s: Scale) -> DataFrame:
    """Sizes, spacing, letter stretch and margins of styles, as far as the table has those columns."""
    by = {"outline_w": s.y, "shadow_w": s.y, "spacing": s.x, "scalex": s.stretch}
    new = {k: F.col(k) * v for k, v in by.items() if k in styles.columns}
    if "fontsize" in styles.columns:
        new["fontsize"] = F.floor(F.col("fontsize") * s.y + 0.5).cast("double")
    return styles.withColumns({**new, **_margins(styles, s, False)})
