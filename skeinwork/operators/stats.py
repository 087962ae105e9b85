"""Counts, incidents and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def project_stats(entities: DataFrame, relationships: DataFrame, files: DataFrame) -> DataFrame:
    """One row: how much of everything there is."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(entities, "n_entities").crossJoin(one(relationships, "n_relationships")).crossJoin(one(files, "n_files"))


def incidents(sightings: DataFrame, code: str, at: str, limit: int | None = None) -> DataFrame:
    """Errors by code with how often and when they were seen, most frequent first."""
    out = sightings.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return out if limit is None else out.orderBy(F.desc("n"), "code").limit(limit)


def freshness(files: DataFrame, suite: str) -> DataFrame:
    """Analysed files by the suite that analysed them, and how many of them are stale."""
    done = files.where(F.col("analyzed_hash").isNotNull())
    return done.groupBy(F.coalesce("analyzed_by", F.lit("unknown")).alias("suite")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("analyzed_by").eqNullSafe(F.lit(suite)), 0).otherwise(1)).alias("stale"))


def files_with_errors(errors: DataFrame, files: DataFrame, severity: str | None = None) -> DataFrame:
    """Errors with their file's path; severities in descending text order, so warnings come first."""
    own = errors if severity is None else errors.where(F.col("severity") == severity)
    out = own.join(files.select(F.col("file_id").alias("f"), "path"), F.col("file_id") == F.col("f"), "left").drop("f")
    return out.orderBy(F.desc("severity"), F.asc_nulls_first("path"))


def schema_twins(entities: DataFrame, key: str) -> DataFrame:
    """(key, twin): entities of one type, container and name that differ in whether a schema is known."""
    parts = F.split(F.col(key), r"\|")
    keyed = entities.select(F.col(key).alias("k"), F.concat_ws("|", parts[0], parts[2], parts[3]).alias("bare"), parts[1].alias("schema"))
    plain, owned = keyed.where("schema = ''"), keyed.where("schema <> ''")
    return plain.select("k", "bare").join(owned.select(F.col("k").alias("twin"), F.col("bare").alias("b")), F.col("bare") == F.col("b")).select(F.col("k").alias("key"), "twin")
