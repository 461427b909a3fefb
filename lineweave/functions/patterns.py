"""Regular expressions over columns: flags, places of matches, splitting and substitution. Patterns are Java's, which Catalyst runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags by name as inline flags
FLAGS = {"ICASE": "i", "MULTILINE": "m", "DOTALL": "s", "COMMENTS": "x", "UNICODE": "u"}


def compiled(pattern: str, *flags: str) -> str:
    """The pattern with its flags in front; unknown flags are an error."""
    if unknown := [f for f in flags if f not in FLAGS]:
        raise ValueError(f"unknown flags: {unknown}")
    letters = "".join(dict.fromkeys(FLAGS[f] for f in flags))
    return f"(?{letters}){pattern}" if letters else pattern


def found(c: Column | str, pattern: str) -> Column:
    """array<struct<str, first, last>> of matches from left to right, places in characters from 1, last inclusive. The pattern must
    not match an empty text."""
    text = F.col(c) if isinstance(c, str) else c
    parts = F.split(text, pattern, -1)
    hits = F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: x != "")
    row = lambda s, at: F.struct(s.alias("str"), at.alias("first"), (at + F.length(s) - 1).alias("last"))
    # matches and the texts between them take turns: a match begins after all that stands before it
    start = F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS array<struct<str:string,first:int,last:int>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(s["out"], F.array(row(x["hit"], at))).alias("out"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def groups(c: Column | str, pattern: str, count: int) -> Column:
    """The first match and its groups, null where there is no match."""
    return F.when(F.col(c).rlike(pattern) if isinstance(c, str) else c.rlike(pattern), F.array(*(F.regexp_extract(c, pattern, k) for k in range(count + 1))))


def split(c: Column | str, pattern: str, skip_empty: bool = False, most: int = 0) -> Column:
    """Parts between matches; at most `most` cuts if that isn't 0, the rest of the text being the last part."""
    parts = F.split(c, pattern, most + 1 if most else -1)
    return F.filter(parts, lambda x: x != "") if skip_empty else parts


def substitute(c: Column | str, pattern: str, replacement: str, most: int = 0) -> Column:
    r"""Matches replaced, $1 being the first group; only the first `most` of them if that isn't 0. With a limit, the pattern must not
    match an empty text, and the replacement has no groups."""
    if not most:
        return F.regexp_replace(c, pattern, replacement)
    parts = F.split(c, pattern, most + 1)
    return F.array_join(parts, replacement)


def substituted(c: Column | str, pattern: str, change) -> Column:
    """Matches as change(column) gives them. The pattern must not match an empty text."""
    hits = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)
    parts = F.split(c, pattern, -1)
    return F.array_join(F.transform(parts, lambda g, i: F.concat(g, F.coalesce(F.get(F.transform(hits, change), i), F.lit("")))), "")
