"""What people say about the graph: annotations and solutions, joined on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import keyed_upsert


def annotated(claims: DataFrame, annotations: DataFrame, key: str, hide_rejected: bool = False) -> DataFrame:
    """Claims with status manual where someone judged them; confidence stays. annotations: (target_key,
    verdict). A rejected claim stays visible unless asked otherwise."""
    said = annotations.select(F.col("target_key").alias("k"), "verdict")
    out = claims.join(said, F.col(key) == F.col("k"), "left").withColumn("status", F.when(F.col("k").isNotNull(), "manual").otherwise(F.col("status")))
    if hide_rejected:
        out = out.where(~F.col("verdict").eqNullSafe("rejected"))
    return out.drop("k")


def resolved(annotations: DataFrame, claims: DataFrame, key: str, claim_id: str) -> DataFrame:
    """Annotations with the current id of their claim, null where the claim is gone."""
    now = claims.groupBy(F.col(key).alias("k")).agg(F.min(claim_id).alias("current_id"))
    return annotations.join(now, F.col("target_key") == F.col("k"), "left").drop("k")


def clear(annotations: DataFrame, keys: DataFrame) -> DataFrame:
    """Annotations but for those of ``keys`` (target_key)."""
    return annotations.join(keys.select(F.col("target_key").alias("k")), F.col("target_key") == F.col("k"), "left_anti")


def forget(solutions: DataFrame, error_key: str, description: str) -> DataFrame:
    """Solutions but for one."""
    return solutions.where(~((F.col("error_key") == error_key) & (F.col("description") == description)))


def annotate(old: DataFrame, new: DataFrame) -> DataFrame:
    return keyed_upsert(old, new, ["project_id", "target_kind", "target_key"])


def add_solution(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Solutions by project, error and text; blank ones are refused, and those of what isn't an error among ``entities``."""
    errors = entities.where("entity_type = 'Error'").select(F.col("identity_key").alias("k"))
    new = new.join(errors, F.col("error_key") == F.col("k"), "left_semi")
    return keyed_upsert(old, new.where(F.length(F.trim("description")) > 0), ["project_id", "error_key", "description"])


def solutions_of(incidents: DataFrame, solutions: DataFrame, key: str) -> DataFrame:
    """Incidents with their solutions, those that worked first."""
    grouped = solutions.groupBy(F.col("error_key").alias("k")).agg(F.sort_array(F.collect_list(F.struct((-F.col("worked")).alias("w"), "description"))).alias("s"))
    grouped = grouped.select("k", F.col("s.description").alias("solutions"))
    return incidents.join(grouped, F.col(key) == F.col("k"), "left").drop("k")
