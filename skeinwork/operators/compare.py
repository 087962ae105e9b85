"""Comparison of two graphs by identity and claim keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILAR_PATHS = 0.5


def compare_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): left, right or both; one row a key."""
    l, r = left.select(F.col(key).alias("l")).distinct(), right.select(F.col(key).alias("r")).distinct()
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return l.join(r, F.col("l") == F.col("r"), "full_outer").select(F.coalesce("l", "r").alias(key), side.alias("side"))


def only(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def listed(rows: DataFrame, group: str, order: list[str], limit: int = 500) -> DataFrame:
    """The first ``limit`` rows by ``order``, and whether there are more."""
    from pyspark.sql import Window

    first = rows.orderBy(*order).limit(limit + 1).withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    more = first.agg((F.count("*") > limit).alias("truncated"))
    return first.where(F.col("nth") <= limit).drop("nth").crossJoin(F.broadcast(more))


def path_overlap(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Jaccard overlap of paths; below a half the two sides are hardly one project."""
    sides = compare_keys(left, right, path).agg(F.count_if(F.col("side") == "both").alias("shared"), F.count("*").alias("total"))
    overlap = F.when(F.col("total") == 0, 1.0).otherwise(F.col("shared") / F.col("total"))
    return sides.select("shared", "total", overlap.alias("overlap"), (overlap < SIMILAR_PATHS).alias("doubtful"))
