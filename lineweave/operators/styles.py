"""Styles of files: order, copies, imports, assignment, and which characters each font shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.markup import shown_fonts, word_list


def order_styles(styles: DataFrame, first: int, last: int, how: str) -> DataFrame:
    """Moves the styles of each file from place first to last (both included): up, down, top or bottom, or sorts all by name."""
    file = Window.partitionBy("file_id")
    if how == "sort":
        return styles.withColumn("ord", (F.row_number().over(file.orderBy("name", "ord")) - 1).cast("int"))
    at, size, n = F.col("ord"), last - first + 1, F.count("*").over(file)
    chosen = at.between(first, last)
    if how in ("up", "top"):
        to = max(first - 1, 0) if how == "up" else 0
        place = F.when(chosen, at - (first - to)).when(at.between(to, first - 1), at + size).otherwise(at)
    else:
        by = F.least(F.lit(1), n - 1 - last) if how == "down" else n - 1 - last
        by = F.greatest(by, F.lit(0))
        place = F.when(chosen, at + by).when((at > last) & (at <= last + by), at - size).otherwise(at)
    return styles.withColumn("ord", place.cast("int"))


def copy_styles(styles: DataFrame, chosen: Column) -> DataFrame:
    """Copies of the chosen styles after a file's others, named "X - Copy", or "X - Copy (n)" with the least n from 2 on
    that is free."""
    file = Window.partitionBy("file_id")
    rows = styles.withColumns({"_names": F.collect_set("name").over(file), "_top": F.max("ord").over(file)}).where(chosen)
    base = F.concat("name", F.lit(" - Copy"))
    numbered = F.transform(F.sequence(F.lit(2), F.size("_names") + 2), lambda k: F.concat(base, F.lit(" ("), k.cast("string"), F.lit(")")))
    free = F.filter(F.concat(F.array(base), numbered), lambda x: ~F.array_contains(F.col("_names"), x))
    place = F.col("_top") + F.row_number().over(file.orderBy("ord"))
    return styles.unionByName(rows.withColumns({"name": free[0], "ord": place.cast("int")}).drop("_names", "_top"))


def import_styles(styles: DataFrame, other: DataFrame) -> DataFrame:
    """The styles of both tables; of one name in a file that of `other` stays."""
    return styles.join(other.select("file_id", "name"), ["file_id", "name"], "left_anti").select(styles.columns).unionByName(other.select(styles.columns))


def assign(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """Lines with the styles that chosen (file_id, id, style) gives them."""
    new = chosen.groupBy("file_id", "id").agg(F.max("style").alias("_new"))
    return lines.join(new, ["file_id", "id"], "left").withColumn("style", F.coalesce("_new", "style")).select(lines.columns)


def font_usage(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """(face, bold, italic, chars, lines): the distinct characters that each font shows, and how many lines' tags choose it.
    styles needs face, bold and italic. Comments and lines of unknown styles are left out."""
    known = styles.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("face", "bold", "italic")))).alias("_known"))
    shown = lines.where(~F.col("comment")).join(known, "file_id").select("file_id", "id", F.explode(shown_fonts("text", "style", "_known")).alias("f")).select("file_id", "id", "f.*")
    line = F.when(F.col("changed"), F.struct("file_id", "id"))
    per = shown.select("face", "bold", "italic", F.explode_outer("chars").alias("c"), line.alias("l"))
    return per.groupBy("face", "bold", "italic").agg(F.count_distinct("c").alias("chars"), F.count_distinct("l").alias("lines"))


def misspelled(lines: DataFrame, dictionary: DataFrame, uppercase: bool = False, comments: bool = False) -> DataFrame:
    """(file_id, id, pos, word) of the words that dictionary (word, in lower case) lacks. Words in capitals count if asked."""
    rows = lines if comments else lines.where(~F.col("comment"))
    words = rows.select("file_id", "id", F.posexplode(word_list("text")).alias("pos", "word"))
    if not uppercase:
        words = words.where((F.upper("word") != F.col("word")) | (F.lower("word") == F.col("word")))
    known = dictionary.select(F.lower("word").alias("_w")).distinct()
    return words.join(known, F.lower("word") == F.col("_w"), "left_anti")


def synonyms(words: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """The entries of thesaurus (word, meaning, synonym) for each word, whatever its case."""
    t = thesaurus.select(F.lower("word").alias("_w"), "meaning", "synonym")
    return words.join(t, F.lower("word") == F.col("_w")).drop("_w")


def suggestions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, suggestion, distance): the dictionary's words (word) at most one edit from each, whatever its case. Words that are
    equal but for one letter, or one more, share a form with one letter less: such forms are joined, no pairs are tried."""
    forms = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    a = words.select("word", F.lower("word").alias("_w")).distinct().withColumn("_f", F.explode(forms(F.col("_w"))))
    b = dictionary.select(F.lower("word").alias("suggestion")).distinct().withColumn("_f", F.explode(forms(F.col("suggestion"))))
    near = a.join(b, "_f").select("word", "suggestion", F.levenshtein("_w", "suggestion", 1).alias("distance")).where("distance >= 0")
    return near.distinct()


def user_words(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """The dictionary (word) after changes (word, added boolean, at): a word's last change holds."""
    last = changes.groupBy(F.lower("word").alias("word")).agg(F.max_by("added", "at").alias("_in"))
    rows = dictionary.select(F.lower("word").alias("word")).distinct().join(last, "word", "full")
    return rows.where(F.coalesce("_in", F.lit(True))).select("word")
