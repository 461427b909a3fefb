"""Folds of lines and versions of a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.operators.windows import fold


def check_folds(marks: DataFrame) -> DataFrame:
    """Marks (file_id, row_no, closing, fold_id, collapsed) of folds with `valid` and the ids they come to have.

    An id that is met again after its fold is over names a new fold. An end takes all folds opened inside and left open
    with it as invalid, and is itself so without a beginning; an end is collapsed as its beginning is.
    """

    def step(p):
        ids, shut = p.fold_id.astype(int).tolist(), p.collapsed.tolist()
        good, renamed, begun, over, nest = [True] * len(p), {}, {}, set(), []
        top = max(ids, default=0)
        for k, closing in enumerate(p.closing):
            name = ids[k]
            while name in renamed:
                name = renamed[name]
            if name in over:
                top += 1
                renamed[name] = name = top
            ids[k] = name
            if not closing:
                good[k] = name not in begun
                if good[k]:
                    begun[name] = k
                    nest.append(name)
                continue
            over.add(name)
            good[k] = name in nest
            if good[k]:
                inner = nest[nest.index(name) + 1 :]
                del nest[nest.index(name) :]
                over.update(inner)
                for x in inner:
                    good[begun[x]] = False
                shut[k] = shut[begun[name]]
        for name in nest:
            good[begun[name]] = False
        return p.assign(fold_id=ids, collapsed=shut, valid=good)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marks.schema)
    return fold(marks, step, f"{schema}, valid boolean")


def at_version(history: DataFrame, version: int) -> DataFrame:
    """The lines as they were: of each line the last row of history (..., version, deleted) up to a version, unless that
    deletes it. Undo and redo are other versions of one append-only table."""
    w = Window.partitionBy("file_id", "id").orderBy(F.col("version").desc())
    last = history.where(F.col("version") <= version).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return last.where("not deleted").drop("_n", "version", "deleted")


def coalesce_versions(log: DataFrame, keep: str = "label") -> DataFrame:
    """Commits (file_id, version, label, saved) without those that the next one amends: one of the same label, before any save."""
    w = Window.partitionBy("file_id").orderBy("version")
    amended = (F.lead(keep).over(w) == F.col(keep)) & ~F.col("saved") & F.lead("version").over(w).isNotNull()
    return log.withColumn("_a", F.coalesce(amended, F.lit(False))).where("not _a").drop("_a")
