"""Texts from bytes of unknown encoding, and thesaurus files, whose index counts bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks at the start of a file, and encodings tried in turn where there is none
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
TRIED = ("utf-8", "shift_jis", "euc-jp", "euc-kr", "gb18030", "big5")


def charset_of(raw: bytes) -> str:
    """By a mark; two-byte text by zero bytes that stand on one side in a third of its pairs; else the first encoding that fits every
    byte, Japanese only if it gives kana, Korean only if it gives mostly syllables; cp1252 if none does. 'binary' for other zero bytes."""
    for mark, name in MARKS:
        if raw.startswith(mark):
            return name
    even, odd = raw[::2].count(0), raw[1::2].count(0)
    if even or odd:
        most = max(even, odd)
        if len(raw) % 2 == 0 and most * 6 >= len(raw) and min(even, odd) * 4 <= most:
            return "utf-16-be" if even > odd else "utf-16-le"
        return "binary"
    for name in TRIED:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        wide = [c for c in text if c > "\x7f"]
        if name in ("shift_jis", "euc-jp") and not 4 * sum("぀" <= c <= "ヿ" for c in wide) >= len(wide):
            continue
        if name == "euc-kr" and not 2 * sum("가" <= c <= "힣" for c in wide) >= len(wide):
            continue
        return name
    return "cp1252"


def text_of(raw: bytes, name: str | None = None) -> str | None:
    """Text without its mark; bytes that don't fit become U+FFFD; null for binary data."""
    name = name or charset_of(raw)
    if name == "binary":
        return None
    return raw.decode(name, "replace").removeprefix("﻿")


def charset(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else charset_of(bytes(b)))

    return run(c)


def decoded(c: Column | str, name: str | None = None) -> Column:
    """Text of a binary column, in the named encoding or the one that its bytes show."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else text_of(bytes(b), name))

    return run(c)


def thesaurus(files: DataFrame) -> DataFrame:
    """(word, meaning, synonym) from rows (idx, dat: binary), the files of one thesaurus in a row. The index names the encoding, then the
    words with the byte where their entry begins; an entry says how many lines of meanings follow. A word that the index has
    twice counts where it comes last; lines that aren't of that form, and places beyond the file, are left out."""

    def entry(dat: bytes, at: int, name: str) -> list[tuple[str, str]]:
        def line(at: int) -> tuple[str, int]:
            end = dat.find(b"\n", at)
            end = len(dat) if end < 0 else end
            return dat[at:end].removesuffix(b"\r").decode(name, "replace"), end + 1

        head, at = line(at)
        parts = head.split("|")
        if len(parts) != 2 or not parts[1].strip().isdigit():
            return []
        out = []
        for _ in range(int(parts[1])):
            if at >= len(dat):
                break
            text, at = line(at)
            kind, *words = text.split("|")
            if words:
                meaning = f"{kind} {words[0]}" if kind else words[0]
                out += [(meaning, s) for s in words[1:] if s] or [(meaning, None)]
        return out

    def run(batches):
        for p in batches:
            for idx, dat in zip(p.idx, p.dat):
                name, _, *rest = [x.removesuffix(b"\r") for x in bytes(idx).split(b"\n")] + [b""]
                name = name.decode("ascii", "replace").strip()
                places = dict(x.decode(name, "replace").split("|") for x in rest if x.count(b"|") == 1)
                rows = [(w, m, s) for w, at in places.items() if at.strip().isdigit() and int(at) < len(dat) for m, s in entry(bytes(dat), int(at), name)]
                yield pd.DataFrame(rows, columns=["word", "meaning", "synonym"])

    return files.select("idx", "dat").mapInPandas(run, "word string, meaning string, synonym string")
