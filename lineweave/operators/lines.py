"""Selecting, searching, ordering and editing lines: DataFrame in, DataFrame out. Rows are ordered by row_no within file_id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import strip_tags
from lineweave.operators.windows import by_file, fold, islands, renumber

KEY = ["file_id", "id"]

# ---------------------------------------------------------------- predicates and selections


def matches(field: str, needle: str, mode: str = "contains", ignore_case: bool = False, skip_tags: bool = False) -> Column:
    """Predicate of one field: contains, exact or regex."""
    c = strip_tags(field) if skip_tags else F.col(field)
    if mode == "regex":
        return c.rlike(("(?iu)" if ignore_case else "") + needle)
    if ignore_case:
        c, needle = F.lower(c), needle.lower()
    return c == needle if mode == "exact" else c.contains(needle)


def select(lines: DataFrame, predicate: Column, invert: bool = False, comments: bool = True, dialogue: bool = True) -> DataFrame:
    keep = ~predicate if invert else predicate
    if not comments:
        keep = keep & ~F.col("comment")
    if not dialogue:
        keep = keep & F.col("comment")
    return lines.where(keep)


def selection(old: DataFrame, new: DataFrame, how: str = "set") -> DataFrame:
    """Keys of the selection after set, add, subtract or intersect."""
    a, b = old.select(KEY), new.select(KEY)
    if how == "set":
        return b.distinct()
    if how == "add":
        return a.union(b).distinct()
    return a.distinct().join(b.distinct(), KEY, "left_anti" if how == "subtract" else "left_semi")


def find_next(lines: DataFrame, predicate: Column, cursor: int) -> DataFrame:
    """First match after the cursor row of each file, going round at the end."""
    turn = F.struct((F.col("row_no") <= cursor).alias("past"), "row_no")
    return lines.where(predicate).groupBy("file_id").agg(F.min_by("id", turn).alias("id"), F.min_by("row_no", turn).alias("row_no"))


def replace_all(lines: DataFrame, field: str, pattern: str, replacement: str) -> DataFrame:
    return lines.withColumn(field, F.regexp_replace(field, pattern, replacement))


def count_matches(lines: DataFrame, field: str, pattern: str) -> DataFrame:
    n = F.regexp_count(field, F.lit(pattern))
    return lines.groupBy("file_id").agg(F.sum(n).alias("matches"), F.count_if(n > 0).alias("lines_changed"))


def visible_at(lines: DataFrame, ms: int) -> DataFrame:
    return lines.where(~F.col("comment") & (F.col("start_ms") <= ms) & (F.col("end_ms") > ms))


def toggle_comment(lines: DataFrame) -> DataFrame:
    """A file whose lines all are comments loses the marks, any other gets them all."""
    return lines.withColumn("comment", ~F.bool_and("comment").over(Window.partitionBy("file_id")))


def paste_over(lines: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns from the line of `other` with the same place in its file."""
    b = other.select("file_id", "row_no", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_has"))
    out = lines.join(b, ["file_id", "row_no"], "left")
    return out.select(*(F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in lines.columns))


def select_overlaps(lines: DataFrame) -> DataFrame:
    """Lines that begin before the end of the last line, by start, that wasn't an overlap itself."""

    def step(p):
        p = p.sort_values(["start_ms", "row_no"], kind="stable")
        keep, end = [], None
        for s, e in zip(p.start_ms, p.end_ms):
            hit = end is not None and s < end
            keep.append(hit)
            if not hit:
                end = e
        return p[keep]

    return fold(lines, step, lines.schema)


# ---------------------------------------------------------------- order

_SORT = {"start": "start_ms", "end": "end_ms", "style": "style", "actor": "actor", "effect": "effect", "layer": "layer", "text": "text"}


def sort_lines(lines: DataFrame, by: str = "start") -> DataFrame:
    """Stable sort of each file; by: start, end, style, actor, effect, layer, text or stripped (text without tags)."""
    return renumber(lines, strip_tags("text") if by == "stripped" else F.col(_SORT[by]), F.col("row_no"))


def sort_blocks(lines: DataFrame, selected: Column, by: str = "start") -> DataFrame:
    """Sorts each maximal block of selected lines; other lines keep their places."""
    rows = islands(lines.withColumn("_sel", selected), F.col("_sel"), ["file_id"], "row_no")
    w = Window.partitionBy("file_id", "island")
    place = F.min("row_no").over(w) + F.row_number().over(w.orderBy(_SORT[by], "row_no")) - 1
    return rows.withColumn("row_no", F.when(F.col("_sel"), place).otherwise(F.col("row_no")).cast("int")).select(lines.columns)


def move(lines: DataFrame, selected: Column, down: bool = False) -> DataFrame:
    """Each block of selected lines passes the unselected line above (or below) it."""
    rows = islands(lines.withColumn("_sel", selected), F.col("_sel"), ["file_id"], "row_no")
    w, block = by_file(), Window.partitionBy("file_id", "island")
    size = F.count("*").over(block)
    rows = rows.withColumns({"_size": size, "_low": F.min("row_no").over(block), "_high": F.max("row_no").over(block), "_last": F.max("row_no").over(Window.partitionBy("file_id"))})
    near, jump = (F.lag, 1) if down else (F.lead, 1)
    # an unselected line beside a block goes to the block's other end
    passed = near("_sel", jump).over(w) & ~F.col("_sel")
    step = F.coalesce(near("_size", jump).over(w), F.lit(0))
    place = F.when(F.col("_sel") & ((F.col("_high") < F.col("_last")) if down else (F.col("_low") > 0)), F.col("row_no") + (1 if down else -1))
    place = place.when(passed, F.col("row_no") + (-step if down else step)).otherwise(F.col("row_no"))
    return rows.withColumn("row_no", place.cast("int")).select(lines.columns)


def recent(log: DataFrame, key: str, order: str, most: int, group: list[str]) -> DataFrame:
    """The latest distinct values of each group, newest first: rank 1 to most."""
    last = log.groupBy(*group, key).agg(F.max(order).alias(order))
    w = Window.partitionBy(*group).orderBy(F.col(order).desc(), F.col(key))
    return last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def neighbours(lines: DataFrame) -> DataFrame:
    w = by_file()
    return lines.withColumns({"prev_id": F.lag("id").over(w), "next_id": F.lead("id").over(w)})


# ---------------------------------------------------------------- edits


def delete(lines: DataFrame, selected: DataFrame) -> DataFrame:
    return renumber(lines.join(selected.select(KEY), KEY, "left_anti"))


def duplicate_blocks(lines: DataFrame, selected: Column) -> DataFrame:
    """Copies of each block of selected lines come after it; column copy tells them apart."""
    rows = islands(lines.withColumn("_sel", selected), F.col("_sel"), ["file_id"], "row_no")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("_sel"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return renumber(rows, "island", "copy", "row_no").select(*lines.columns, "copy")


def split_at(lines: DataFrame, ms: int) -> DataFrame:
    """Lines that the time falls into become two; part tells them apart."""
    hit = (F.col("start_ms") < ms) & (F.col("end_ms") > ms)
    parts = F.when(hit, F.array(F.struct(F.col("start_ms").alias("s"), F.lit(ms).alias("e")), F.struct(F.lit(ms).alias("s"), F.col("end_ms").alias("e")))).otherwise(F.array(F.struct(F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))))
    rows = lines.select("*", F.posexplode(parts).alias("part", "p")).withColumns({"start_ms": F.col("p.s"), "end_ms": F.col("p.e")}).drop("p")
    return renumber(rows, "row_no", "part")


def join_lines(lines: DataFrame, group: list[str], how: str = "concatenate") -> DataFrame:
    """One line for each group: concatenate, keep_first or karaoke (each text after its duration in centiseconds)."""
    text = F.col("text")
    if how == "karaoke":
        text = F.concat(F.lit("{\\k"), F.floor((F.col("end_ms") - F.col("start_ms")) / 10).cast("string"), F.lit("}"), text)
    one = F.transform(F.sort_array(F.collect_list(F.struct("row_no", text.alias("t")))), lambda x: x["t"])
    joined = F.element_at(one, 1) if how == "keep_first" else F.array_join(one, "" if how == "karaoke" else " ")
    return lines.groupBy(*group).agg(F.min("row_no").alias("row_no"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), joined.alias("text"))


def fit_new_line(lines: DataFrame, at: int, length: int) -> DataFrame:
    """Times of a line to insert at a time in each file: it ends where the next line begins that doesn't begin before it."""
    after = F.min(F.when(F.col("start_ms") >= at, F.col("start_ms")))
    return lines.groupBy("file_id").agg(F.lit(at).alias("start_ms"), F.least(F.lit(at + length), after).alias("end_ms"))


def insert_beside(lines: DataFrame, selected: DataFrame, length: int, before: bool = False) -> DataFrame:
    """An empty line (id null) beside each selected one, with its style. After a line it is shown from its end on, before it until
    its start, for `length` ms at most and not beyond the neighbour on that side."""
    w = by_file()
    rows = lines.withColumns({"_up": F.lag("end_ms").over(w), "_down": F.lead("start_ms").over(w)}).join(selected.select(KEY), KEY, "left_semi")
    if before:
        start = F.greatest(F.col("start_ms") - length, F.coalesce("_up", F.lit(0)), F.lit(0))
        times = {"start_ms": F.least(start, F.col("start_ms")), "end_ms": F.col("start_ms")}
    else:
        end = F.least(F.col("end_ms") + length, F.coalesce("_down", F.col("end_ms") + length))
        times = {"start_ms": F.col("end_ms"), "end_ms": F.greatest(end, F.col("end_ms"))}
    new = rows.withColumns(times | {"text": F.lit(""), "comment": F.lit(False)}).drop("_up", "_down").withColumn("id", F.lit(None).cast("bigint"))
    place = lambda d, k: d.withColumn("_at", F.struct(F.col("row_no").alias("a"), F.lit(k).alias("b")))
    return renumber(place(lines, 0).unionByName(place(new, -1 if before else 1)), F.col("_at")).drop("_at")


_EDGE = re.compile(r"^(?: |\t|\\[nNh])+|(?: |\t|\\[nNh])+$")


def recombine(lines: DataFrame) -> DataFrame:
    """Undoes splits and merges of neighbours: a text that begins or ends with another line's loses that part, and the other line
    comes to be shown as long as both were. Line ends and spaces at the ends of texts go; of lines that come to have equal
    texts one stays, and empty ones go, each while it is compared with those after it. Each file is a fold in order of starts.
    """

    def shed(long: dict, short: dict, front: bool) -> bool:
        t, s = long["text"], short["text"]
        if not (t.startswith(s) if front else t.endswith(s)):
            return False
        long["text"] = _EDGE.sub("", t[len(s) :] if front else t[: len(t) - len(s)])
        cover(short, long)
        return True

    def cover(line: dict, other: dict) -> None:
        line["start_ms"], line["end_ms"] = min(line["start_ms"], other["start_ms"]), max(line["end_ms"], other["end_ms"])

    def step(p):
        rows = p.sort_values(["start_ms", "row_no"], kind="stable").to_dict("records")
        for r in rows:
            r["text"] = _EDGE.sub("", r["text"])
        gone = set()
        for k, line in enumerate(rows[:-1]):
            after = rows[k + 1]
            if line["text"] == after["text"]:
                cover(after, line)
                gone.add(k)
            elif not line["text"]:
                gone.add(k)
            elif k + 2 == len(rows) and not after["text"]:
                gone.add(k + 1)
            else:
                rest = iter(rows[k + 1 :])
                other = next(rest, None)
                # the next one holds this line in front, then at its end; this one the next at its end, then in front
                for this_is_short, front in ((True, True), (True, False), (False, False), (False, True)):
                    while other is not None and (shed(other, line, front) if this_is_short else shed(line, other, front)):
                        other = next(rest, None)
        out = [r for k, r in enumerate(rows) if k not in gone]
        return p.iloc[:0] if not out else type(p)(out, columns=p.columns)

    return fold(lines, step, lines.schema)


# ---------------------------------------------------------------- preparation for export


def strip_comments(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("comment") & (F.col("text") != ""))


def merge_identical(lines: DataFrame) -> DataFrame:
    """Chains of lines with equal text, each beginning where the one before ends, become one."""
    w = by_file()
    same = (F.lag("text").over(w) == F.col("text")) & (F.lag("end_ms").over(w) == F.col("start_ms"))
    rows = lines.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy("file_id", "_run").agg(F.min("row_no").alias("row_no"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("text").alias("text"), F.count("*").alias("n")).drop("_run")


def coverage(lines: DataFrame) -> DataFrame:
    """Each file's time cut at every start and end, with how many lines are shown in each piece; empty pieces are left out."""
    ends = lines.where("end_ms > start_ms").select("file_id", F.explode(F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("file_id", F.col("x.t").alias("start_ms")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("file_id").orderBy("start_ms")
    out = steps.withColumns({"end_ms": F.lead("start_ms").over(w), "active": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where("active > 0").select("file_id", "start_ms", "end_ms", F.col("active").cast("long").alias("active"))


def recombine_overlaps(lines: DataFrame) -> DataFrame:
    """Lines without overlaps: where two meet, a line of both texts, the later one's first. What comes of a pair has the earlier
    line's other fields. Each file is a fold in order of starts; a new line goes before the first one beyond the pair that
    doesn't begin before it."""

    def step(p):
        rows = p.sort_values(["start_ms", "row_no"], kind="stable").to_dict("records")
        done: list[dict] = []  # before the pair
        while rows:
            if not done or done[-1]["end_ms"] <= rows[0]["start_ms"]:
                done.append(rows.pop(0))
                continue
            a, b = done.pop(), rows.pop(0)
            both = max(a["end_ms"], b["end_ms"])
            pieces = [(a["start_ms"], b["start_ms"], a["text"]), (b["start_ms"], min(a["end_ms"], b["end_ms"]), b["text"] + "\\N" + a["text"])]
            pieces += [(b["end_ms"], both, a["text"])] * (a["end_ms"] > b["end_ms"]) + [(a["end_ms"], both, b["text"])] * (b["end_ms"] > a["end_ms"])
            for start, end, text in pieces[not b["start_ms"] > a["start_ms"] :]:
                new = {**a, "start_ms": start, "end_ms": end, "text": text}
                at = next((k for k, r in enumerate(rows) if r["start_ms"] >= start), len(rows))
                if at:
                    rows.insert(at, new)
                else:
                    done.append(new)
        out = p.iloc[:0] if not done else type(p)(done, columns=p.columns)
        out["row_no"] = range(len(out))
        return out

    return fold(lines, step, lines.schema)


def gap_blanks(lines: DataFrame) -> DataFrame:
    """Blank samples for the time between each line's end and the next start."""
    w = by_file("start_ms", "row_no")
    gaps = lines.withColumn("next_start", F.lead("start_ms").over(w)).where("next_start > end_ms")
    return gaps.select("file_id", F.col("end_ms").alias("start_ms"), F.col("next_start").alias("end_ms"))


def actor_share(lines: DataFrame) -> DataFrame:
    """Whether more than half of each file's dialogue lines name an actor."""
    share = F.count_if(F.col("actor") != "") / F.count("*")
    return lines.where(~F.col("comment")).groupBy("file_id").agg(share.alias("share"), (share > 0.5).alias("write_actor"))


def fill_actor(lines: DataFrame) -> DataFrame:
    """Lines without an actor get the last one before."""
    w = by_file().rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("actor", F.coalesce(F.last(F.when(F.col("actor") != "", F.col("actor")), ignorenulls=True).over(w), F.lit("")))


# ---------------------------------------------------------------- lookups


def first_styles(styles: DataFrame) -> DataFrame:
    """The first style of each name, whatever its case."""
    w = Window.partitionBy("file_id", F.lower("name")).orderBy("ord")
    return styles.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_style(lines: DataFrame, styles: DataFrame, columns: list[str]) -> DataFrame:
    s = first_styles(styles).select(F.col("file_id").alias("_f"), F.lower("name").alias("_n"), *(F.col(c).alias(f"style_{c}") for c in columns))
    return lines.join(s, (lines.file_id == s._f) & (F.lower("style") == s._n), "left").drop("_f", "_n")


def fix_styles(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """Lines whose style isn't in their file get Default."""
    s = styles.select(F.col("file_id").alias("_f"), F.lower("name").alias("_n"), F.lit(True).alias("_has")).distinct()
    out = lines.join(s, (lines.file_id == s._f) & (F.lower("style") == s._n), "left")
    return out.withColumn("style", F.when(F.col("_has"), F.col("style")).otherwise("Default")).select(lines.columns)


def with_extradata(lines: DataFrame, extradata: DataFrame) -> DataFrame:
    """A row for each key and value that a line refers to."""
    rows = lines.select("file_id", "id", F.explode("extradata_ids").alias("data_id"))
    return rows.join(extradata.select("file_id", F.col("id").alias("data_id"), "key", "value"), ["file_id", "data_id"])


def clean_extradata(lines: DataFrame, extradata: DataFrame, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """The last id of each key and line stays; entries that no line uses count up and go at `keep`."""
    used = with_extradata(lines, extradata).groupBy("file_id", "id", "key").agg(F.max("data_id").alias("data_id"))
    ids = used.groupBy("file_id", "id").agg(F.sort_array(F.collect_list("data_id")).alias("_ids"))
    out = lines.join(ids, KEY, "left").withColumn("extradata_ids", F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids")
    has = used.select("file_id", F.col("data_id").alias("_d"), F.lit(True).alias("_has")).distinct()
    e = extradata.join(has.withColumnRenamed("file_id", "_f"), (F.col("file_id") == F.col("_f")) & (F.col("id") == F.col("_d")), "left")
    e = e.withColumn("expiration", F.when(F.col("_has"), 0).otherwise(F.col("expiration") + 1)).where(F.col("expiration") < keep)
    return out, e.select(extradata.columns)


def unused(names: DataFrame, lines: DataFrame, field: str) -> DataFrame:
    return names.join(lines.select("file_id", F.col(field).alias("name")).distinct(), ["file_id", "name"], "left_anti")


def set_info(info: DataFrame, key: str, value: str) -> DataFrame:
    """Script info with a value set (case-insensitive key); an empty one deletes it."""
    rest = info.where(F.lower("key") != key.lower())
    if not value:
        return rest
    new = info.groupBy("file_id").agg(F.coalesce(F.min(F.when(F.lower("key") == key.lower(), F.col("ord"))), F.max("ord") + 1).alias("ord"))
    return rest.unionByName(new.select("file_id", "ord", F.lit(key).alias("key"), F.lit(value).alias("value")))


def resolution(width: Column, height: Column) -> Column:
    """Script resolution where one or both are missing (0 or null)."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    rw = F.when((w == 0) & (h == 0), 384).when((w == 0) & (h == 1024), 1280).when(w == 0, F.floor(h * 4 / 3)).otherwise(w)
    rh = F.when((w == 0) & (h == 0), 288).when((h == 0) & (w == 1280), 1024).when(h == 0, F.floor(w * 3 / 4)).otherwise(h)
    return F.struct(rw.cast("int").alias("width"), rh.cast("int").alias("height"))


# ---------------------------------------------------------------- a script's rows as one table


def script_rows(info: DataFrame, styles: DataFrame, lines: DataFrame) -> DataFrame:
    """One table of a script's rows, told apart by `class` (info, style, dialogue); columns that a class lacks are null."""
    parts = [d.withColumn("class", F.lit(c)) for c, d in (("info", info), ("style", styles), ("dialogue", lines))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def rows_of_class(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return rows.where(F.col("class") == name).select(columns)


def delete_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Lines without those from place first to last of each file, both included."""
    return renumber(lines.where(~F.col("row_no").between(first, last)), F.col("row_no"))


def insert_lines(lines: DataFrame, new: DataFrame, at: int | None = None) -> DataFrame:
    """New lines, in their own order, before the line at a place of their file; without one, or beyond the end, after all."""
    old = lines.withColumn("_at", F.struct(F.col("row_no").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")))
    place = F.lit((1 << 31) - 1 if at is None else at)
    added = new.select(lines.columns).withColumn("_at", F.struct(place.alias("a"), F.lit(0).alias("b"), F.col("row_no").alias("c")))
    return renumber(old.unionByName(added), F.col("_at")).drop("_at")
