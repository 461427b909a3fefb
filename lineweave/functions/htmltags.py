"""Markup of SubRip texts as override tags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([bius]|font)([^>]*)>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\s+(face|size|color)=('[^']*'|"[^"]*"|\S+)""", re.IGNORECASE)
#: Tags of the attributes of a font, in the order in which they are written
FONT = {"face": "fn", "size": "fs", "color": "c"}


def _color(text: str) -> str:
    """&Hbbggrr& of #rgb, #rrggbb, rgb(r, g, b) or such a value itself; black for anything else."""
    if m := re.fullmatch(r"#([0-9a-fA-F]{6})", text):
        r, g, b = (m[1][k : k + 2] for k in (0, 2, 4))
        return f"&H{b}{g}{r}&".upper()
    if m := re.fullmatch(r"#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])", text):
        return f"&H{m[3] * 2}{m[2] * 2}{m[1] * 2}&".upper()
    if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", text):
        return "&H" + "".join(f"{min(int(m[k]), 255):02X}" for k in (3, 2, 1)) + "&"
    if m := re.fullmatch(r"&H([0-9a-fA-F]{1,8})&?", text):
        return f"&H{m[1][-6:].zfill(6).upper()}&"
    return "&H000000&"


def overrides(text: str) -> str:
    """b, i, u and s count how deep they are and write a tag where the outermost begins or ends; a font sets what differs from the
    one around it, and its end takes that back. A closing tag without an opening one goes. Other tags, and blocks, stay;
    blocks that meet become one."""
    depth = dict.fromkeys("bius", 0)
    fonts: list[dict[str, str]] = [{}]

    def write(old: dict[str, str], new: dict[str, str]) -> str:
        return "".join(f"{{\\{tag}{new.get(name, '')}}}" for name, tag in FONT.items() if old.get(name, "") != new.get(name, ""))

    def one(m: re.Match) -> str:
        closing, name, rest = m[1], m[2].lower(), m[3]
        if name in depth:
            before = depth[name]
            depth[name] = max(0, before - 1) if closing else before + 1
            if before and depth[name] or not before and closing:
                return ""
            return f"{{\\{name}}}" if closing else f"{{\\{name}1}}"
        if closing:
            if len(fonts) == 1:
                return ""
            old = fonts.pop()
            return write(old, fonts[-1])
        new, at = dict(fonts[-1]), 0
        while a := _ATTRIBUTE.match(rest, at):  # until something else stands there
            value = a[2][1:-1] if len(a[2]) > 1 and a[2][0] in "'\"" and a[2][-1] == a[2][0] else a[2]
            new[a[1].lower()] = _color(value) if a[1].lower() == "color" else value
            at = a.end()
        fonts.append(new)
        return write(fonts[-2], new)

    return _TAG.sub(one, text).replace("}{", "")


def to_overrides(c: Column | str) -> Column:
    """Null stays null; texts without a < aren't looked at further."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else overrides(t) if "<" in t else t.replace("}{", ""))

    return run(c)
