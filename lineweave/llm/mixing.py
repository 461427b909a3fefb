"""Mixing sources to target weights by nested hash thresholds, without sorting documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lineweave.llm.common import cut, drop

WORDS = r"[^\x20\x09-\x0D]+"
#: Bits of the hash of a document, and how many of them one histogram resolves.
HASH_BITS, STEP_BITS = 60, 10
#: Sources that a mix may have: each is one row at the driver and of a table sent to each executor.
MOST_SOURCES = 100_000


def hashed(docs: DataFrame) -> DataFrame:
    """(row, source, _size, _hash): each row of docs as a struct, its words, and 60 bits that depend on doc_id alone."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.struct(*docs.columns).alias("row"), "source", size.alias("_size"), h.alias("_hash"))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Target of each source: the budget by weight, no source above `most` times its size, the excess to the others.

    Sources are taken by code point, null last, and weighed by the given weights in turn. This is the level at which
    min(cap, level x weight) adds up to the budget; sources are capped in ascending order of cap over weight.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, rest = share * sum(sizes.values()), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] <= left / rest * weight[s]:
            out[s] = most * sizes[s]
            left, rest = left - out[s], rest - weight[s]
        else:
            break
    return {s: out.get(s, left / rest * weight[s] if rest else 0.0) for s in names}


_PLAN = StructType([StructField("_source", StringType()), StructField("_source_size", LongType()), StructField("_target", DoubleType()), StructField("_times", LongType()), StructField("_need", DoubleType())])


def thresholds(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each source: its size, target, whole passes (_times) and the hash below which documents come once more (_cut).

    sized: (source, _size, _hash). A histogram sums words by source and hash bucket; the bucket in which the sum reaches
    what is needed is resolved by the next bits, and so on until it holds one hash value, which is taken if that comes
    nearer to the target. Every histogram has at most 2^10 buckets a source, however many documents there are; only one
    sum for each source comes to the driver.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("_size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r[0]: int(r[1] or 0) for r in sums}
    goal = targets(sizes, weights, share, most)
    rows = []
    for s, t in goal.items():
        times = min(int(t // sizes[s]), int(most)) if sizes[s] else 0
        rows.append((s, sizes[s], float(t), times, float(t - times * sizes[s])))
    plan = spark.createDataFrame(rows, _PLAN)
    now = plan.where("_need > 0").select("_source", F.lit(0).cast("long").alias("prefix"), F.col("_need").alias("need"))
    ends = None
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        shift = HASH_BITS - bits
        old = F.shiftright("_hash", shift + STEP_BITS) if bits > STEP_BITS else F.lit(0).cast("long")
        hist = sized.join(now, sized.source.eqNullSafe(now._source) & (old == F.col("prefix"))).where("_size > 0")
        hist = hist.groupBy("_source", "need", F.shiftright("_hash", shift).alias("bucket")).agg(F.sum("_size").alias("words"), F.min("_hash").alias("low"), F.max("_hash").alias("high"))
        from pyspark.sql import Window

        run = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("upto", run).where("upto >= need and upto - words < need")
        hist = cut(hist.select("_source", "bucket", "low", "high", "words", (F.col("need") - F.col("upto") + F.col("words")).alias("left")))
        done = hist.where("low = high").select("_source", F.when(2 * F.col("left") >= F.col("words"), F.col("low") + 1).otherwise(F.col("low")).alias("_cut"))
        ends = done if ends is None else ends.unionByName(done)
        now = hist.where("low < high").select("_source", F.col("bucket").alias("prefix"), F.col("left").alias("need"))
        if not now.head(1):
            break
    found = ends.withColumnRenamed("_source", "s")
    return plan.join(found, plan._source.eqNullSafe(found.s), "left").select("_source", "_source_size", "_target", "_times", F.coalesce("_cut", F.lit(0)).alias("_cut"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(row, size, source_size, target, copies): each row of docs as a struct, whatever its columns are called, and how often the
    mix takes it.

    Each source's share is its target, met by whole passes over it and a last partial pass of the documents whose hash
    lies below the source's threshold, so a larger budget takes a superset and reruns agree. Null texts have size zero;
    null sources are one source, the last; rows that repeat a doc_id go together; a source without words gets nothing.
    An empty table gives an empty one.
    """
    sized = cut(hashed(docs).select("source", "_size", "_hash"))
    plan = cut(thresholds(sized, **options))
    drop(sized)
    rows = hashed(docs)
    rows = rows.join(F.broadcast(plan), rows.source.eqNullSafe(plan._source), "left")  # MOST_SOURCES small rows at most
    copies = F.col("_times") + F.when(F.col("_hash") < F.col("_cut"), 1).otherwise(0)
    return rows.select("row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: those of docs, repeated as often as mixed() takes them; nulls, empty texts and repeated rows as
    there. All columns stay, whatever their names."""
    rows = mixed(docs, **options).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
