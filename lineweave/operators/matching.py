"""Matching texts across translation files: normalised, exact, by key, fuzzy, ranked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Code points that count as punctuation, as white space and as nothing, and ranges of capitals with the step to
# their small letters (those from 0100 to 0137 alternate).
_PUNCTUATION = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\u00A1\u00BF\u2000-\u206F\u203C\u2047\u2E00-\u2E7F\u3001-\u3003\u3008-\u301F\u3030\uFE10-\uFE1F\uFE30-\uFE4F\uFF01-\uFF0F\uFF1A-\uFF1F\uFF3B-\uFF40\uFF5B-\uFF65"
_SPACES = r" \t\n\r\f\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_NOTHING = r"\u200B-\u200D\u2060\uFEFF"
_CAPITALS = ((0x41, 0x5A, 32), (0xC0, 0xD6, 32), (0xD8, 0xDE, 32), (0x391, 0x3A1, 32), (0x3A3, 0x3A9, 32), (0x410, 0x42F, 32), (0xFF21, 0xFF3A, 32))
_UPPER = [(c, c + step) for low, high, step in _CAPITALS for c in range(low, high + 1)] + [(c, c + 1) for c in range(0x100, 0x138, 2)]
#: Levels of braces within braces that are told apart.
_DEPTH = 8


def normalize(c: Column | str, fold_case: bool = True) -> Column:
    """Without tags in braces (what follows an open brace too) and simple tags in angles, line ends, zero-width characters and
    punctuation; spaces collapsed, small letters."""
    out = F.regexp_replace(c, r"\\[Nn]", " ")
    for _ in range(_DEPTH):
        out = F.regexp_replace(out, r"\{[^{}]*\}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)\{.*", ""), r"<[^<> \t\r\n]+>", "")
    out = F.regexp_replace(F.regexp_replace(out, f"[{_NOTHING}]", ""), f"[{_SPACES}]+", " ")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, f"[{_PUNCTUATION}]", ""), " +", " "))
    return F.translate(out, "".join(chr(a) for a, _ in _UPPER), "".join(chr(b) for _, b in _UPPER)) if fold_case else out


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity_from(a: Column | str, b: Column | str, least: float) -> Column:
    """similarity() where it is at least `least`, else null. The distance isn't followed beyond what that allows."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - least) * longest + 1e-9).cast("int")
    close = F.call_function("levenshtein", *(F.col(x) if isinstance(x, str) else x for x in (a, b)), most)
    return F.when(longest == 0, 1.0).when(close >= 0, 1 - close / longest)


def exact(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, text) and (file, key, text) with equal normalised texts."""
    q = queries.select("query_id", normalize("text").alias("norm"))
    return entries.withColumn("norm", normalize("text")).join(q, "norm").select("query_id", "file", "key", "text")


def across_files(entries: DataFrame) -> DataFrame:
    """Pairs of entries with one key in different files."""
    b = entries.select(F.col("file").alias("other_file"), "key", F.col("text").alias("other_text"))
    return entries.join(b, "key").where("file <> other_file")


def fuzzy(queries: DataFrame, entries: DataFrame, threshold: float = 0.7, band: int = 8) -> DataFrame:
    """Pairs with at least the similarity. Texts that are similar have like lengths, so both sides meet by length bands, and
    the distance stops where the threshold can't be met any more."""
    q = queries.select("query_id", normalize("text").alias("q"))
    q = q.withColumn("_n", F.length("q")).where("_n > 0")
    low, high = F.floor(F.ceil(F.col("_n") * threshold) / band), F.floor(F.floor(F.col("_n") / threshold) / band)
    q = q.withColumn("_band", F.explode(F.sequence(low, high)))
    e = entries.withColumn("norm", normalize("text")).withColumn("_band", F.floor(F.length("norm") / band))
    pairs = e.join(q, "_band")
    longest = F.greatest(F.length("q"), F.length("norm"))
    fits = F.least(F.length("q"), F.length("norm")) >= longest * threshold
    pairs = pairs.where(fits).withColumn("score", similarity_from("q", "norm", threshold))
    return pairs.where(F.col("score").isNotNull()).select("query_id", "file", "key", "text", "score")


def _scored(probes: DataFrame, queries: DataFrame, threshold: float, band: int = 8) -> DataFrame:
    """probes (norm, ...) with each query (query_id, text, q) that is equal or at least so similar: columns query_id, query, score and
    exact. Texts that are similar have like lengths, so they meet by bands of lengths, equal ones once; texts of up to two code
    points only match longer ones that hold them."""
    n = F.length("q")
    low, high = F.floor(F.ceil(n * threshold) / band), F.floor(F.floor(n / threshold) / band)
    q = queries.select("q").distinct().withColumn("_band", F.explode(F.sequence(low, high)))
    pairs = probes.select("norm").where("norm <> ''").distinct().withColumn("_band", F.floor(F.length("norm") / band)).join(q, "_band")
    exact = F.col("norm") == F.col("q")
    short = (F.least(F.length("q"), F.length("norm")) <= 2) & (F.length("q") != F.length("norm"))
    held = F.contains("q", "norm") | F.contains("norm", "q")
    fits = F.least(F.length("q"), F.length("norm")) >= F.greatest(F.length("q"), F.length("norm")) * threshold
    pairs = pairs.where(exact | (fits & (~short | held))).withColumn("exact", exact)
    pairs = pairs.withColumn("score", F.when(exact, 1.0).otherwise(similarity_from("q", "norm", threshold))).where("score is not null").drop("_band")
    return probes.join(pairs, "norm").join(queries.select("query_id", F.col("text").alias("query"), "q"), "q")


def match(queries: DataFrame, entries: DataFrame, threshold: float = 0.7, most: int = 300, pairs: DataFrame | None = None, languages: DataFrame | None = None, preferred: str = "", split_regex: str = "") -> DataFrame:
    """The best replacements (file, key, text, score, exact, from_key, matched, rank) of each query (query_id, text).

    entries: (file, key, text). Their texts, their keys and the best segment of their texts are compared with the query, and give
    themselves and what other files have under their key (of a segment the segment with the same number). pairs: (file, key,
    source, translation), of which the source and its segments are compared and give the translation or its segment. Of one
    replacement under one file and key the first stays: equal texts, equal keys, similar texts, similar keys, sources, segments, segments
    of sources. Ranked by preferred language (languages: file, language), equality, score, texts without split_regex, texts before
    keys, then by name. Nothing replaces a query by itself.
    """
    q = queries.select("query_id", "text", normalize("text").alias("q")).where("q <> ''")
    cut = lambda c: F.transform(split_segments(c, split_regex), lambda x: F.struct(x.alias("raw"), normalize(x).alias("norm")))
    segments = lambda c: F.filter(cut(c), lambda x: x["norm"] != "")
    e = entries.select("file", "key", "text").distinct().withColumn("segments", segments("text"))
    size = F.octet_length("norm")
    one = lambda kind, norm, matched, direct, k: F.struct(F.lit(kind).alias("kind"), norm.alias("norm"), matched.alias("matched"), direct.alias("direct"), k.cast("int").alias("k"))
    none = F.lit(-1)
    own = F.array(one("text", normalize("text"), F.col("text"), F.col("text"), none), one("key", normalize("key"), F.col("key"), F.col("text"), none))
    parts = F.transform("segments", lambda x, k: one("segment", x["norm"], x["raw"], x["raw"], k))
    found = _scored(e.select("file", "key", "text", F.explode(F.concat(own, parts)).alias("x")).select("file", "key", "text", "x.*"), q, threshold)
    found = found.where((F.col("kind") != "key") | (size >= F.when(F.col("exact"), 2).otherwise(4)))
    best = Window.partitionBy("query_id", "file", "key", "text", "kind").orderBy(F.col("score").desc(), "k")
    found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    turn = F.when(F.col("kind") == "segment", 6).when(F.col("exact"), F.when(F.col("kind") == "text", 1).otherwise(2)).otherwise(F.when(F.col("kind") == "text", 3).otherwise(4))
    found = found.select("query_id", "query", "score", "exact", (F.col("kind") == "key").alias("from_key"), "matched", "direct", "k", "key", F.col("file").alias("of"), turn.alias("turn"), F.struct("file", "text", "k").alias("order"))
    other = e.where("key <> ''").select(F.col("key").alias("_k"), F.col("file").alias("_f"), F.col("text").alias("_t"), "segments")
    both = found.withColumn("sub", F.explode(F.array(F.lit(0), F.lit(1))))  # an entry itself, and what its key has elsewhere
    both = both.join(other, (F.col("key") == F.col("_k")) & (F.col("sub") == 1), "left")
    beside = F.coalesce(F.when(F.col("k") >= 0, F.get("segments", F.col("k"))["raw"]), "_t")
    both = both.withColumns({"file": F.when(F.col("sub") == 0, F.col("of")).otherwise(F.col("_f")), "text": F.when(F.col("sub") == 0, F.col("direct")).otherwise(beside)})
    both = both.where("if(sub = 0, direct <> query, file <> of and text <> '' and text <> direct)")
    columns = ["query_id", "file", "key", "text", "score", "exact", "from_key", "matched", "turn", "order", "sub"]
    out = both.select(columns)
    if pairs is not None:
        p = pairs.select("file", "key", "source", "translation").distinct().withColumns({"_s": segments("source"), "_t": segments("translation")})
        place = lambda kind, norm, matched, text, k: F.struct(F.lit(kind).alias("turn"), norm.alias("norm"), matched.alias("matched"), text.alias("text"), k.cast("int").alias("k"))
        whole = F.array(place(5, normalize("source"), F.col("source"), F.col("translation"), none))
        part = F.transform("_s", lambda x, k: place(7, x["norm"], x["raw"], F.coalesce(F.get("_t", k)["raw"], F.col("translation")), k))
        hits = _scored(p.select("file", "key", F.explode(F.concat(whole, part)).alias("x")).select("file", "key", "x.*"), q, threshold).where("text <> ''")
        hits = hits.withColumns({"from_key": F.lit(False), "order": F.struct("file", "text", "k"), "sub": F.lit(0)})
        out = out.unionByName(hits.select(columns))
    first = Window.partitionBy("query_id", "file", "key", "text").orderBy("turn", "order", "sub")
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    liked = F.lit(True)
    if languages is not None and preferred:
        out = out.join(languages.select("file", "language"), "file", "left")
        liked = F.coalesce(F.col("language") == preferred, F.lit(False))
    clean = ~F.col("text").rlike(split_regex) if split_regex else F.lit(True)
    w = Window.partitionBy("query_id").orderBy(liked.desc(), F.col("exact").desc(), F.col("score").desc(), clean.desc(), "from_key", "file", "key", "text")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "file", "key", "text", "score", "exact", "from_key", "matched", "rank")


#: Names of languages and the code points of their scripts, the first that occurs in a text decides.
SCRIPTS = (
    ("日本語", r"\u3040-\u30FF\u31F0-\u31FF\uFF66-\uFF9F"),
    ("中文", r"\u4E00-\u9FFF\u3400-\u4DBF"),
    ("한국어", r"\uAC00-\uD7AF\u1100-\u11FF"),
    ("Русский", r"\u0400-\u04FF"),
    ("English", r"A-Za-z\u00C0-\u024F"),
)


def script_of(c: Column | str) -> Column:
    """Language by the scripts that occur: one kana is enough for the first, and so on down; empty if none occurs. Texts of the
    last script alone are scanned once."""
    c = F.col(c) if isinstance(c, str) else c
    last, pattern = SCRIPTS[-1]
    out = F.when(c.rlike(f"[{pattern}]"), last).otherwise("")
    some = F.lit(None).cast("string")
    for name, pattern in reversed(SCRIPTS[:-1]):
        some = F.when(c.rlike(f"[{pattern}]"), name).otherwise(some)
    foreign = (F.octet_length(c) > F.length(c)) & c.rlike("[" + "".join(p for _, p in SCRIPTS[:-1]) + "]")
    return F.when(c.isNull(), None).when(foreign, some).otherwise(out)


def split_segments(c: Column | str, also: str = "") -> Column:
    """Texts at markers such as {*1}, {2} and {*4-5}, line ends, matches of `also`, and sentence ends: CJK ones anywhere, others
    before a space and not within an ellipsis. A text without parts is one."""
    marks = r"\{\*?[0-9]+(?:[-,][0-9]+)?\}|\\[Nn]|[\n\r]|(?<=[。！？])|(?<=[^.][.!?])(?=\s)"
    pattern = re.compile(f"{marks}|(?:{also})" if also else marks)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [x.strip() for x in pattern.split(t) if x and x.strip()] or [x for x in [t.strip()] if x])

    return run(c)
