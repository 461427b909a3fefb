"""Paths that begin with the name of a folder: ?script/a.png."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names, and beginnings of paths that name no file
TOKENS = ("?audio", "?data", "?dictionary", "?local", "?script", "?temp", "?user", "?video")
NO_FILE = ("?dummy", "dummy-audio:")


def checked(folders: dict[str, str]) -> dict[str, str]:
    """Folders by token; a file stands for its folder, relative paths for none. Unknown tokens are an error."""
    if unknown := set(folders) - set(TOKENS):
        raise ValueError(f"unknown: {sorted(unknown)}")
    return {t: os.path.dirname(f) if os.path.isfile(f) else f for t, f in sorted(folders.items()) if os.path.isabs(f)}


def decode(c: Column | str, folders: dict[str, str]) -> Column:
    """The path with its token's folder; the slash after the token may lack. Other paths, and tokens without a folder, stay."""
    path = F.col(c) if isinstance(c, str) else c
    out = path
    for token, folder in checked(folders).items():
        rest = F.ltrim(F.substring(path, len(token) + 1, 1 << 30), F.lit("/"))
        out = F.when(path.startswith(token), F.concat(F.lit(folder.rstrip("/")), F.when(rest != "", F.concat(F.lit("/"), rest)).otherwise(""))).otherwise(out)
    return out


def relative(path: str, base: str) -> str:
    """From base to path by way of the folder that both have. Empty paths and those that name no file stay."""
    if not path or not base or path.startswith(NO_FILE):
        return path
    a, b = PurePosixPath(path).parts, PurePosixPath(base).parts
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return "/".join([".."] * (len(b) - same) + list(a[same:]))


def encode(c: Column | str, folders: dict[str, str]) -> Column:
    """The form with the fewest parts: the path itself, or relative to one of the folders, the first of equals by token."""
    known = checked(folders)

    def one(path: str) -> str:
        best, parts = path, len(PurePosixPath(path).parts)
        for token, folder in known.items():
            way = relative(path, folder)
            if len(PurePosixPath(way).parts) < parts:
                best, parts = f"{token}/{way}" if way else token, len(PurePosixPath(way).parts)
        return best

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else one(p))

    return run(c)


def relative_to(c: Column | str, base: str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else relative(p, base))

    return run(c)


def absolute(c: Column | str, folder: str) -> Column:
    """Relative paths in the folder; absolute ones, empty ones and those that name no file stay."""
    path = F.col(c) if isinstance(c, str) else c
    stay = (path == "") | path.startswith("/") | path.startswith(NO_FILE[0]) | path.startswith(NO_FILE[1]) | F.lit(folder == "")
    return F.when(stay, path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))
