"""Adapters from the driver's tables to lines, styles, frames and entries, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as lines: a turn is a line, three seconds after the last."""
    t = F.col("turn")
    style = F.when(F.col("role") == "user", "Default").when(t % 3 == 0, "Top").otherwise("Sign")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("conv_id") * 1000 + t).alias("id"), t.cast("int").alias("row_no"), (t % 7 == 3).alias("comment"), (t % 3).cast("int").alias("layer"), (t * 3000).cast("int").alias("start_ms"), (t * 3000 + 600 + 40 * F.length("text")).cast("int").alias("end_ms"), style.alias("style"), F.when(t % 4 == 1, "").otherwise(F.col("role")).alias("actor"), F.lit("").alias("effect"), "text")


LINES = """lines AS (SELECT conv_id AS file_id, conv_id * 1000 + turn AS id, turn::INT AS row_no, (turn % 7 = 3) AS comment, (turn % 3)::INT AS layer,
 (turn * 3000)::INT AS start_ms, (turn * 3000 + 600 + 40 * length(text))::INT AS end_ms,
 CASE WHEN role = 'user' THEN 'Default' WHEN turn % 3 = 0 THEN 'Top' ELSE 'Sign' END AS style,
 CASE WHEN turn % 4 = 1 THEN '' ELSE role END AS actor, '' AS effect, text FROM conversations)"""


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three styles for each conversation, one of them twice in other case."""
    files = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id")).distinct()
    names = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(s).alias("fontsize")) for i, (n, s) in enumerate((("default", 48.0), ("Default", 50.0), ("TOP", 36.0)))))
    return files.select("file_id", F.explode(names).alias("s")).select("file_id", "s.*")


STYLES = """styles AS (SELECT file_id, ord, name, fontsize FROM (SELECT DISTINCT conv_id AS file_id FROM conversations),
 (VALUES (0, 'default', 48.0::DOUBLE), (1, 'Default', 50.0), (2, 'TOP', 36.0)) AS s(ord, name, fontsize))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as evidence: a user is a scan, the order of events its frames, the value's fraction the coverage."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    c = F.col("value") - F.floor("value")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.row_number().over(w).alias("frame"), F.when(F.col("event_type") == "error", -1.0).otherwise(c).alias("coverage"), (F.col("event_type") != "view").alias("ocr_box"), "value")


FRAMES = """frames AS (SELECT user_id AS scan_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS frame,
 CASE WHEN event_type = 'error' THEN -1.0 ELSE value - floor(value) END AS coverage, event_type <> 'view' AS ocr_box, value FROM events)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as two translation files; two items that follow each other have one key, one in each file."""
    b = read(spark, sf_dir, "benchmark")
    key = F.concat(F.lit("item/"), F.floor(F.col("item_id") / 2).cast("string"))
    return b.select(F.when(F.col("item_id") % 2 == 0, "a.json").otherwise("b.json").alias("file"), key.alias("key"), "text")


ENTRIES = """entries AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'a.json' ELSE 'b.json' END AS file, 'item/' || (item_id // 2)::VARCHAR AS key, text FROM benchmark)"""


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key time every 2,500 ms up to 60 s in each conversation."""
    files = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id")).distinct()
    return files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(60000), F.lit(2500))).alias("key_ms"))


KEYFRAMES = """keyframes AS (SELECT file_id, k::INT AS key_ms FROM (SELECT DISTINCT conv_id AS file_id FROM conversations), range(0, 60001, 2500) AS r(k))"""
