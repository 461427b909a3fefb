"""Override tags: what each tag's parameters are, parsing blocks into tags and back, and functions that visit parameters."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of tags and the kinds of their parameters. `?` and digits: only present where there are so many parameters.
# A tag has the longest name that its text begins with. A second row of a name is for other than four parameters.
KINDS = """
1a alpha
1c color
2a alpha
2c color
3a alpha
3c color
4a alpha
4c color
K karaoke
a int
alpha alpha
an int
b int
be size
blur size
bord size
c color
clip x y x y
clip int?2 drawing
fad start end
fade int int int start start start start
fax float
fay float
fe text
fn text
fr float
frx float
fry float
frz float
fs size
fs+ float
fs- float
fscx percent_x
fscy percent_y
fsp size
i bool
iclip x y x y
iclip int?2 drawing
k karaoke
kf karaoke
ko karaoke
move x y x y start start
org x y
p int
pbo y
pos x y
q int
r text
s bool
shad size
t start?34 start?34 float?24 block
u bool
xbord size
xshad size
ybord size
yshad size
"""

_TABLE: dict[str, list[list[tuple[str, str]]]] = {}
for _row in KINDS.split("\n"):
    if _row:
        _name, *_params = _row.split()
        _TABLE.setdefault(_name, []).append([(k, n) for k, _, n in (p.partition("?") for p in _params)])
_LONGEST = sorted(_TABLE, key=lambda n: -len(n))
_BLANK = " \t\n\r\f\v"
#: Tags that time a syllable.
TIMING = ("k", "K", "kf", "ko")


@dataclass
class Tag:
    """name is None for text that is no tag, which then is in `rest`. values: one for each parameter, None where it's left out."""

    name: str | None
    kinds: list[str] = field(default_factory=list)
    values: list[str | None] = field(default_factory=list)
    rest: str = ""

    def text(self) -> str:
        if self.name is None:
            return self.rest
        given = ",".join(v for v in self.values if v is not None)
        return f"\\{self.name}" + (f"({given})" if len(self.values) > 1 else given)

    def given(self) -> int:
        return sum(v is not None for v in self.values)


def arguments(text: str) -> list[str]:
    """What follows a tag's name as a list: one value, or the parts between parentheses cut at their own commas, with any text
    after the closing one as a last part."""
    if not text.startswith("("):
        return [text.strip(_BLANK)] if text else []
    found, depth, rest = [""], 0, ""
    for k, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if not depth:
            rest = text[k + 1 :]
            break
        if ch == "," and depth == 1:
            found.append("")
        elif k:
            found[-1] += ch
    return [x.strip(_BLANK) for x in found] + [rest] * bool(rest)


def parse_tag(text: str) -> Tag:
    name = next((n for n in _LONGEST if text.startswith("\\" + n)), None)
    if name is None:
        return Tag(None, rest=text)
    given = arguments(text[1 + len(name) :])
    forms = _TABLE[name]
    form = forms[1] if len(forms) > 1 and len(given) != 4 else forms[0]
    left = iter(given)
    values = [next(left, None) if not counts or str(len(given)) in counts else None for _, counts in form]
    return Tag(name, [k for k, _ in form], values)


def parse_block(inner: str) -> list[Tag]:
    """Tags of a block without its braces. A backslash begins a tag, but not between a parenthesis and the next closing one."""
    starts, closed = [0], True
    for k, ch in enumerate(inner):
        if not closed:
            closed = ch == ")"
        elif ch == "\\" and k:
            starts.append(k)
        elif ch == "(" and k:
            closed = False
    return [parse_tag(inner[a:b]) for a, b in zip(starts, [*starts[1:], len(inner)]) if a < b]


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, text) of a line's parts: override (tags, without braces), comment (a block without a tag), drawing and plain. A
    brace that isn't closed is plain text."""
    out: list[tuple[str, str]] = []
    drawing = False
    for m in re.finditer(r"\{([^}]*)\}|((?:[^{]|\{(?![^}]*\}))+)", text):
        if m[1] is None:
            out.append(("drawing" if drawing else "plain", m[2]))
        elif "\\" not in m[1]:
            out.append(("comment", m[1]))
        else:
            out.append(("override", m[1]))
            for t in parse_block(m[1]):
                if t.name == "p":
                    drawing = _leading_int(t.values[0]) > 0
    return out


def _leading_int(v: str | None) -> int:
    m = re.match(r"\s*[+-]?\d+", v or "")
    return int(m[0]) if m else 0


def written(parts: list[tuple[str, str]]) -> str:
    return "".join(t if kind in ("plain", "drawing") else "{" + t + "}" for kind, t in parts)


Change = Callable[[str, str, str], str]


def visit(tags: list[Tag], change: Change) -> list[Tag]:
    """The tags with change(name, kind, value) for each parameter that is given; blocks within parameters are visited too."""
    for t in tags:
        for k, v in enumerate(t.values):
            if v is not None:
                v = change(t.name, t.kinds[k], v)
                t.values[k] = "".join(x.text() for x in visit(parse_block(v), change)) if t.kinds[k] == "block" else v
    return tags


def change_text(text: str, change: Change) -> str:
    """The text with change() for each parameter of its override blocks, written anew; other parts stay as they are."""
    return written([(kind, "".join(t.text() for t in visit(parse_block(x), change)) if kind == "override" else x) for kind, x in pieces(text)])


# ---------------------------------------------------------------- columns


def _each(c: Column | str, f: Callable, kind: str) -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run(c)


def parts_of(c: Column | str) -> Column:
    """(kind, text) of a line's parts: override, comment, drawing and plain."""
    return _each(c, lambda t: [{"kind": k, "text": x} for k, x in pieces(t)], "array<struct<kind:string,text:string>>")


def stripped(c: Column | str) -> Column:
    """The plain text: without blocks and drawings."""
    return _each(c, lambda t: "".join(x for k, x in pieces(t) if k == "plain"), "string")


def tags_of(c: Column | str) -> Column:
    """Tags of a text in order: number of the block among all parts, name (null: no tag), parameters (null: left out), their kinds,
    and the tag as it is written."""

    def one(text: str) -> list[dict]:
        out = []
        for n, (kind, x) in enumerate(pieces(text)):
            if kind == "override":
                out += [{"part": n, "name": t.name, "values": t.values, "kinds": t.kinds, "text": t.text()} for t in parse_block(x)]
        return out

    return _each(c, one, "array<struct<part:int,name:string,values:array<string>,kinds:array<string>,text:string>>")


def with_parameters(c: Column | str, change: Change) -> Column:
    """The text after change(name, kind, value) of each parameter of its tags."""
    return _each(c, lambda t: change_text(t, change), "string")


# Tags that hold for a whole line: those of one group exclude each other. With how many parameters they are such.
_WHOLE_LINE = ({"an": 1, "a": 1}, {"org": 2}, {"move": 4, "pos": 2}, {"fade": 7, "fad": 2})


def _tidied(text: str) -> str:
    blocks: list[tuple[str, list[Tag]]] = []  # plain text, then the block after it
    for kind, x in [*pieces(text), ("plain", "")]:
        own = [] if kind in ("plain", "drawing") else [t for t in parse_block(x) if t.name or t.rest.strip(_BLANK)]
        if kind in ("plain", "drawing"):
            blocks.append((x, []))
        elif blocks and not (_timed(blocks[-1][1]) and _timed(own)):
            blocks[-1][1].extend(own)
        else:
            blocks.append(("", own))
    front: list[Tag] = []
    for group in _WHOLE_LINE:
        every = [t for _, b in blocks for t in b if t.name in group and t.given() >= group[t.name]]
        front += every[:1]
        for _, b in blocks:
            b[:] = [t for t in b if not any(t is x for x in every)]
    for _, b in blocks:
        for t in b:
            t.values = [re.sub(r"\s+", " ", v) if k == "drawing" and v else v for k, v in zip(t.kinds, t.values)]
        b.sort(key=lambda t: t.name not in TIMING)
    if front:
        if blocks[0][0]:
            blocks.insert(0, ("", []))
        blocks[0][1][:0] = front
    return "".join(x + ("{" + "".join(t.text() for t in b) + "}" if b else "") for x, b in blocks)


def _timed(tags: list[Tag]) -> bool:
    return any(t.name in TIMING for t in tags)


def tidied(c: Column | str) -> Column:
    """Neighbouring blocks become one unless both time a syllable; timing tags come first in their block, the first tag of each kind
    that holds for the whole line at the very front, in the order alignment, origin, position, fading, and further ones go;
    parameters lose spaces around them, empty blocks go."""
    return _each(c, _tidied, "string")


def retimed(text: Column | str, start: Column | str, end: Column | str, new_start: Column | str, new_end: Column | str, moved: Callable[[int], int]) -> Column:
    """The text of a line whose times change: those in tags that count from its start or its end, and durations of syllables, which
    follow each other. moved: from a time in ms to its new one. A time from the start that wasn't 0 doesn't become 0."""

    def one(t: str, a: int, b: int, p: int, q: int) -> str:
        a, b, sung, new_sung = a // 10 * 10, b // 10 * 10, 0, 0

        def change(name: str, kind: str, value: str) -> str:
            nonlocal sung, new_sung
            old = _leading_int(value)
            if kind == "start":
                new = moved(max(a + old, 0)) - p
                return str(1 if new == 0 and old else new)
            if kind == "end":
                return str(q - moved(max(b - old, 0)))
            if kind == "karaoke":
                sung += old
                new = int((moved(a + 10 * sung) - p) / 10) - new_sung
                new_sung += new
                return str(new)
            return value

        return change_text(t, change)

    @F.pandas_udf("string")
    def run(t: pd.Series, a: pd.Series, b: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if x[0] is None else one(x[0], *map(int, x[1:])) for x in zip(t, a, b, p, q)])

    return run(text, start, end, new_start, new_end)
