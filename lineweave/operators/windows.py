"""Helpers that the operators share: windows by file, islands, as-of and interval joins, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_file(*order: str | Column):
    """A file's lines in order. Files, not the table, bound a window: a table of many files is dealt out by file."""
    return Window.partitionBy("file_id").orderBy(*(order or ("row_no",)))


def renumber(lines: DataFrame, *order: str | Column) -> DataFrame:
    return lines.withColumn("row_no", (F.row_number().over(by_file(*order)) - 1).cast("int"))


def islands(df: DataFrame, flag: Column, keys: list[str], order: str, name: str = "island") -> DataFrame:
    """Numbers the maximal runs of equal flags in the order of a column, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.lag(flag).over(w).eqNullSafe(flag), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, forward: bool = False, strict: bool = False, name: str | None = None) -> DataFrame:
    """For each row of left the value of right at the greatest `on` at most (forward: least at least) its own. One sort by key
    and time of both sides together; nothing is paired."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    side = F.col("_side") * (-1 if strict else 1)
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.col(on).desc(), side).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*keys).orderBy(F.col(on), side).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name or value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Pairs of half-open intervals [start, end) that overlap, with b's columns prefixed by b_. Both sides are cut into bins
    of `width` for an equi-join; a pair is kept in the one bin in which the later of the two begins."""

    def binned(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col(end) - 1, F.col(start))
        return df.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))

    right = binned(b).select(*(F.col(c).alias(c if c in keys or c == "_bin" else f"b_{c}") for c in [*b.columns, "_bin"]))
    both = binned(a).join(right, [*keys, "_bin"])
    overlap = (F.col(start) < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(end))
    return both.where(overlap & (F.floor(F.greatest(start, f"b_{start}") / width) == F.col("_bin"))).drop("_bin")


def fold(lines: DataFrame, step: Callable, schema) -> DataFrame:
    """Runs step(pandas frame of one file, in row order) -> pandas frame: for what depends on all rows before."""
    return lines.groupBy("file_id").applyInPandas(lambda p: step(p.sort_values("row_no", kind="stable").reset_index(drop=True)), schema)
