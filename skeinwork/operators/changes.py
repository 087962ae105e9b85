"""Inventory changes between two states of a project, and what has to be analysed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differs(new: str, old: str) -> Column:
    return ~F.col(new).eqNullSafe(F.col(old))


def change_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind): added, modified, unchanged or deleted.

    Both sides: (path, content_hash, skip_reason, size_bytes); old also is_deleted. Files without a
    hash are compared by skip reason and size; a deleted file that is back counts as added.
    """
    o = old.select(F.col("path").alias("o_path"), F.col("content_hash").alias("o_hash"), F.col("skip_reason").alias("o_skip"), F.col("size_bytes").alias("o_size"), F.col("is_deleted").alias("o_gone"))
    n = new.select(F.col("path").alias("n_path"), F.col("content_hash").alias("n_hash"), F.col("skip_reason").alias("n_skip"), F.col("size_bytes").alias("n_size"))
    both = o.join(n, F.col("o_path") == F.col("n_path"), "full_outer")
    unhashed = F.col("n_hash").isNull() & F.col("o_hash").isNull()
    changed = F.when(unhashed, _differs("n_skip", "o_skip") | _differs("n_size", "o_size")).otherwise(_differs("n_hash", "o_hash"))
    kind = (
        F.when(F.col("o_path").isNull() | (F.col("n_path").isNotNull() & F.col("o_gone")), "added")
        .when(F.col("n_path").isNull() & F.col("o_gone"), None)
        .when(F.col("n_path").isNull(), "deleted")
        .when(changed, "modified")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce("n_path", "o_path").alias("path"), kind.alias("kind")).where("kind is not null")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def pending(files: DataFrame) -> DataFrame:
    """Files whose content isn't what was last analysed, whatever the reason."""
    return files.where(_differs("content_hash", "analyzed_hash"))


def stale(files: DataFrame, suite: str) -> DataFrame:
    """Files analysed as they are, but by another suite of analyzers, or an unknown one."""
    return files.where((F.col("analyzed_hash") == F.col("content_hash")) & ~F.col("analyzed_by").eqNullSafe(F.lit(suite)))


def work_queue(files: DataFrame, suite: str, analyzable: Column) -> DataFrame:
    """Pending and stale files that an analyzer can read, each once."""
    due = _differs("content_hash", "analyzed_hash") | ~F.col("analyzed_by").eqNullSafe(F.lit(suite))
    return files.where(due & analyzable)


def counters(queue: DataFrame, targets: DataFrame) -> DataFrame:
    """files_skipped, never below zero."""
    a, b = queue.agg(F.count("*").alias("q")), targets.agg(F.count("*").alias("t"))
    return a.crossJoin(b).select(F.greatest(F.col("q") - F.col("t"), F.lit(0)).alias("files_skipped"))


def latest_versions(versions: DataFrame, by: str = "path", limit: int = 50) -> DataFrame:
    """The newest ``limit`` versions of each file. versions: (path, content_hash, at, run_id)."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("run_id"))
    return versions.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit)


def changes_since(versions: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Versions that the given run, or the latest one, wrote."""
    if run_id is not None:
        return versions.where(F.col("run_id") == run_id)
    last = runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1).select(F.col("run_id").alias("last"))
    return versions.join(F.broadcast(last), F.col("run_id") == F.col("last"), "left_semi")
