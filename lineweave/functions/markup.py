"""Override markup of line texts: parameters, tags, line wrapping, values, and the fonts that characters are shown in."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.tags import arguments, tidied
from lineweave.functions.text import BLOCK

_PIECE = re.compile(r"\{([^}]*)\}|([^{]+|\{)")


def _each(c: Column | str, f: Callable, kind: str) -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run(c)


# ---------------------------------------------------------------- parameters and values


def parameters(c: Column | str) -> Column:
    """What follows a tag's name, as a list: one value, or the parts between parentheses cut at their own commas, with any
    text after the closing one as a last part. Null stays null."""
    return _each(c, arguments, "array<string>")


def write_tag(name: Column, values: Column) -> Column:
    """A tag with its parameters: in parentheses only if there are two at least."""
    joined = F.array_join(values, ",")
    return F.concat(name, F.when(F.size(values) > 1, F.concat(F.lit("("), joined, F.lit(")"))).otherwise(joined))


def alpha_value(c: Column | str) -> Column:
    """The hexadecimal number of &Hxx& in 0..255; without digits 0."""
    digits = F.ltrim(F.regexp_extract(c, "([0-9A-Fa-f]+)", 1), F.lit("0"))
    return F.when(F.length(digits) > 2, 255).when(digits == "", 0).otherwise(F.conv(digits, 16, 10).cast("int"))


def whole_value(c: Column | str) -> Column:
    """The whole number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def number_text(c: Column | str, precision: int = 3) -> Column:
    """A number with at most so many decimals, without zeros at its end."""
    return F.regexp_replace(F.format_string(f"%.{precision}f", F.col(c).cast("double") if isinstance(c, str) else c.cast("double")), r"\.?0+$", "")


def interpolate(share: Column, low: Column, high: Column) -> Column:
    return F.when(share <= 0, low).when(share >= 1, high).otherwise(low + share * (high - low))


# ---------------------------------------------------------------- tags in texts


def split_blocks(c: Column | str) -> Column:
    """Blocks with their braces and the texts between them, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\{[^}]*\}|[^{]+|\{)"), 1)


def in_blocks(c: Column | str, change: Callable[[Column], Column], plain: bool = False) -> Column:
    """The text with change applied to each override block (plain: to each text between them)."""
    hit = lambda p: p.rlike(f"^{BLOCK}$") != plain
    return F.array_join(F.transform(split_blocks(c), lambda p: F.when(hit(p), change(p)).otherwise(p)), "")


def _tag(name: str) -> str:
    return rf"\\{re.escape(name)}" + (r"[^\\}]*" if name in ("fn", "r") else r"(?![A-Za-z])(?:\([^)]*\)|[^\\}(]*)")


def remove_tag(c: Column | str, name: str) -> Column:
    """The text without a tag, wherever it stands in a block. Blocks that become empty stay."""
    return in_blocks(c, lambda p: F.regexp_replace(p, _tag(name), ""))


def set_tag(c: Column | str, name: str, value: Column) -> Column:
    """The tag with a value in the block that the text begins with, which is made where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    added = F.concat(F.lit("\\" + name), value, F.lit("}"))
    head = F.regexp_extract(c, f"^({BLOCK})", 1)
    kept = F.regexp_replace(head, _tag(name), "")
    return F.when(head == "", F.concat(F.lit("{"), added, c)).otherwise(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), added, F.substring(c, F.length(head) + 1, F.length(c))))


def toggle_tag(c: Column | str, name: str) -> Column:
    """Turns bold, italic, underline or strikeout of a line's first block off where it is on, else on."""
    now = F.regexp_extract(F.regexp_extract(c, f"^({BLOCK})", 1), rf"\\{name}(\d+)", 1)
    return set_tag(c, name, F.when(whole_value(now) != 0, "0").otherwise("1"))


def font_name_at(c: Column | str, position: Column) -> Column:
    r"""(start, end) of the font name that a \fn tag gives and the character at a position, from 0, is part of; end is exclusive. Null
    where that character is part of none."""
    text = F.col(c) if isinstance(c, str) else c
    upto = F.substring(text, F.lit(1), position + 1)
    # whole blocks, then one that is open and in which a font name has begun
    head = F.regexp_extract(upto, r"(?s)^(?:[^{]*\{[^}]*\})*[^{]*\{[^}]*\\fn([^\\}]+)$", 1)
    start = (position + 1 - F.length(head)).cast("int")
    rest = F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"(?s)^[^\\}]*", 0)
    found = F.struct(start.alias("start"), (start + F.length(rest)).cast("int").alias("end"))
    return F.when((position >= 0) & (position < F.length(text)) & (head != ""), found)


def translate_blocks(c: Column | str, texts: Column) -> Column:
    """The text with its plain pieces replaced by those that texts (map of piece number, from 0, to text) has."""
    return F.array_join(F.transform(split_blocks(c), lambda p, i: F.when(~p.rlike(f"^{BLOCK}$"), F.coalesce(F.element_at(texts, i), p)).otherwise(p)), "")


def edge_blur(c: Column | str) -> Column:
    return F.concat(F.lit("{\\be1}"), c)


def fullwidth(c: Column | str) -> Column:
    """ASCII signs outside blocks in their full width; quotes become typographic ones."""
    signs = [chr(k) for k in range(0x21, 0x7F)]
    wide = [{'"': "”", "'": "’", "`": "‘"}.get(s, chr(ord(s) + 0xFEE0)) for s in signs]
    return in_blocks(c, lambda p: F.translate(p, "".join(signs), "".join(wide)), plain=True)


def clean_tags(c: Column | str) -> Column:
    """tags.tidied(): neighbouring blocks joined, timing tags and tags of the whole line in front, no empty blocks."""
    return tidied(c)


# ---------------------------------------------------------------- words and wrapping


def word_list(c: Column | str) -> Column:
    """Words of a text without its blocks and line ends."""
    return F.regexp_extract_all(F.regexp_replace(F.regexp_replace(c, BLOCK, " "), r"\\[Nnh]", " "), F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*)"), 1)


def _balanced(widths: list[int], most: int) -> list[int]:
    """Numbers of the words before which lines break, so that the squares of the room left sum up to the least."""
    upto = [0, *accumulate(widths)]
    best: list[tuple[int, int]] = [(0, 0)]  # least cost of the first words, and where their last line begins
    for end in range(1, len(upto)):
        options = [(best[b][0] + (upto[end] - upto[b] - most) ** 2, -b) for b in range(end) if b == end - 1 or upto[end] - upto[b] <= most]
        cost, begin = min(options)
        best.append((cost, -begin))
    at, found = best[-1][1], []
    while at:
        found.append(at)
        at = best[at][1]
    return found[::-1]


def _wrap(widths: list[int], most: int, mode: str) -> list[int]:
    if mode == "none" or len(widths) < 2 or sum(widths) <= most:
        return []
    found = _balanced(widths, most)
    if mode == "balanced":
        return found
    step = 1 if mode == "first_longer" else -1
    edges = [0, *found, len(widths)]
    lines = [sum(widths[a:b]) for a, b in zip(edges, edges[1:])]
    for k in range(len(found)):
        big, small = (k, k + 1) if step > 0 else (k + 1, k)
        # the width that moves is that of the word after the break, in both directions
        while lines[big] < lines[small] and lines[big] + (w := widths[found[k]]) <= most:
            lines[big] += w
            lines[small] -= w
            found[k] += step
    return found


def _greedy(widths: Column, most: int) -> Column:
    """Numbers of the words before which greedy lines break, as one fold over the array."""
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("found"))

    def step(s: Column, w: Column) -> Column:
        over = (s["line"] > 0) & (s["line"] + w > most)
        return F.struct(F.when(over, w).otherwise(s["line"] + w).alias("line"), (s["k"] + 1).alias("k"), F.when(over, F.concat(s["found"], F.array(s["k"]))).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.transform(widths, lambda w: w.cast("int")), start, step, lambda s: s["found"])


def wrap_points(widths: Column | str, most: int, mode: str = "first_longer") -> Column:
    """Numbers of the words before which lines of at most a width break: greedy, balanced, first_longer, last_longer or
    none. A single word may be wider. Nothing breaks where all words fit."""
    if mode == "greedy":
        return _greedy(F.col(widths) if isinstance(widths, str) else widths, most)
    return _each(widths, lambda w: _wrap([int(x) for x in w], most, mode), "array<int>")


# ---------------------------------------------------------------- fonts


def shown_fonts(text: Column | str, style: Column | str, styles: Column | str) -> Column:
    """(face, bold, italic, changed, chars) of each plain piece: what the line's style and the tags before it say.

    styles: map of the file's style names to (face, bold, italic). Lines of unknown styles give null. A reset to a name
    the file doesn't have is one to the line's own style.
    """

    def one(t: str, own: str, known: dict) -> list[dict] | None:
        known = {k: tuple(v.values()) if isinstance(v, dict) else tuple(v) for k, v in dict(known or {}).items()}
        if own not in known:
            return None
        base = known[own]
        now, changed, out = list(base), False, []
        for m in _PIECE.finditer(t):
            if m[1] is None:
                shown = re.sub(r"\\[Nn]", "", m[2]).replace("\\h", "\u00a0")
                out.append({"face": now[0], "bold": bool(now[1]), "italic": bool(now[2]), "changed": changed, "chars": sorted(set(shown))})
                continue
            for name, value in re.findall(r"\\(fn|r|b(?=\d|\\|$)|i(?=\d|\\|$))([^\\]*)", m[1]):
                value = value.strip()
                if name == "r":
                    now, changed = list(known.get(value, base)), False
                    continue
                k = ("fn", "b", "i").index(name)
                now[k] = (value if name == "fn" else value not in ("", "0")) if value else base[k]
                changed = True
        return out

    @F.pandas_udf("array<struct<face:string,bold:boolean,italic:boolean,changed:boolean,chars:array<string>>>")
    def run(t: pd.Series, own: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else one(a, b, k) for a, b, k in zip(t, own, known)])

    return run(text, style, styles)
