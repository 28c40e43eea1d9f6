"""Pixel and cell tables made from the driver's tables by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, r, g, b, a: one pixel an event, 64 by 64 pixels an image."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.expr("event_id div 4096").alias("image_id"),
        (i % 64).alias("x"),
        F.expr("(event_id % 4096) div 64").alias("y"),
        F.pmod(F.floor(F.col("value") * 100), F.lit(256)).alias("r"),
        F.pmod(F.col("user_id") * 37, F.lit(256)).alias("g"),
        F.pmod(i * 11, F.lit(256)).alias("b"),
        F.when(F.col("event_type") == "error", 0).otherwise(255).alias("a"),
    )


def padded(pixels: DataFrame) -> DataFrame:
    """event_pixels with clear black ones behind the last, so that its image has all 64 by 64."""
    n = pixels.agg(F.max(F.col("image_id") * 4096 + F.col("y") * 64 + F.col("x")).alias("last"))
    rest = n.where("last % 4096 <> 4095").select(F.explode(F.sequence(F.col("last") + 1, F.expr("(last div 4096) * 4096 + 4095"))).alias("i"))
    zero = [F.lit(0).cast("long").alias(c) for c in "rgb"]
    return pixels.unionByName(rest.select(F.expr("i div 4096").alias("image_id"), (F.col("i") % 64).alias("x"), F.expr("(i % 4096) div 64").alias("y"), *zero, F.lit(0).alias("a")))


def vec_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, hi, lo, intensity: a vector of 64 numbers as one 8 by 8 cell."""
    v = table(spark, sf_dir, "embeddings")
    half = lambda a: F.aggregate(F.slice("embedding", a, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
    return v.select("vec_id", half(1).alias("hi"), half(33).alias("lo"), F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5)).alias("intensity"))


#: The same views in SQL that DuckDB runs.
EVENT_PIXELS_SQL = """(SELECT event_id // 4096 AS image_id, event_id % 64 AS x, (event_id % 4096) // 64 AS y,
  ((CAST(floor(value * 100) AS BIGINT) % 256) + 256) % 256 AS r, (((user_id * 37) % 256) + 256) % 256 AS g,
  (event_id * 11) % 256 AS b, CASE WHEN event_type = 'error' THEN 0 ELSE 255 END AS a FROM events)"""
FULL_PIXELS_SQL = f"""(SELECT * FROM {EVENT_PIXELS_SQL} p UNION ALL SELECT i // 4096, i % 64, (i % 4096) // 64, 0, 0, 0, 0
  FROM (SELECT unnest(range(max(event_id) + 1, (max(event_id) // 4096 + 1) * 4096)) AS i FROM events) z)"""
VEC_BITS_SQL = "(SELECT vec_id, i, CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END AS bit, CAST(floor((embedding[i + 1]::DOUBLE + 1) * 127.5) AS BIGINT) AS v FROM embeddings, range(64) t(i))"
VEC_CELLS_SQL = f"""(SELECT vec_id, CAST(sum(CASE WHEN i < 32 THEN bit * (1::BIGINT << (31 - i)) ELSE 0 END) AS BIGINT) AS hi,
  CAST(sum(CASE WHEN i >= 32 THEN bit * (1::BIGINT << (63 - i)) ELSE 0 END) AS BIGINT) AS lo FROM {VEC_BITS_SQL} z GROUP BY vec_id)"""
