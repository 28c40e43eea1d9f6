"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

HUB_ROWS = 1_000
HUB_SHARE = 64  # a node of more than this part of all rows is a hub: there are no more than twice as many
SALTS = 64


def _with_least(rows: DataFrame, own: bool) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the smallest v of each u (or u itself, if own), and the table (w, m).

    The rows of a hub are dealt over SALTS tasks, each with a copy of its one row of the table.
    """
    small = F.min("v")
    least = rows.groupBy(F.col("u").alias("w")).agg((F.least(small, F.first("u")) if own else small).alias("m"), F.count(F.lit(1)).alias("n"))
    least = saved(least, "components-least")
    total = least.agg(F.sum("n")).first()[0] or 0
    hubs = [r["w"] for r in least.where(F.col("n") > max(HUB_ROWS, total // HUB_SHARE)).select("w").collect()]
    least = least.select("w", "m")
    if not hubs:
        return rows.join(least, F.col("u") == F.col("w")), least
    salt = F.when(F.col("u").isin(hubs), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(F.col("w").isin(hubs), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = least.withColumn("salt", F.explode(copies))
    return rows.join(dealt, (F.col("u") == F.col("w")) & (salt == F.col("salt"))).drop("salt"), least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge that joins two nodes; root is the smallest of its component.

    Each round points a node's larger, then its smaller neighbours at the smallest
    one, so the number of rounds follows the logarithm of the longest path.  Minima
    are pre-aggregated and no neighbourhood is gathered.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = saved(now, "components"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both, _ = _with_least(now.union(now.select(F.col("v"), F.col("u"))), True)
        large = saved(both.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        met, least = _with_least(large, False)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        now = saved(small.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
