"""The life of a project's tables: scans applied to the inventory, status of analyses, what files that
are gone leave behind, and projects themselves. Everything is set-based: tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from .changes import change_diff
from .merge import keyed_upsert, retract
from .references import cascade

_SCANNED = ("size_bytes", "content_hash", "modified_at", "skip_reason", "detected_type", "extension", "absolute_path")


def apply_inventory(old: DataFrame, new: DataFrame, project: str | None = None) -> DataFrame:
    """The files table after a scan, one row a path, with ``kind`` of its change (null where nothing is
    observed and nothing was there).

    A new file's id comes from ``project`` and its path (a 64-bit hash of them where ids are whole numbers),
    so a scan that is applied to another copy of the table, or again, gives it the same. New and changed files are pending, unchanged ones keep their status; all of them take what the scan
    saw. A file that is gone keeps its row and its size, loses its hash and is marked; one that is back
    is as new, under its old id.
    """
    kinds = change_diff(old, new).withColumnRenamed("path", "k_path")
    seen = new.select(F.col("path").alias("n_path"), F.lit(True).alias("n_here"), *[F.col(c).alias(f"n_{c}") for c in new.columns if c in _SCANNED])
    both = old.withColumn("o_here", F.lit(True)).join(seen, F.col("path") == F.col("n_path"), "full_outer")
    both = both.withColumn("path", F.coalesce("path", "n_path")).join(kinds, F.col("path") == F.col("k_path"), "left")
    here = F.col("n_here").isNotNull()
    out = {c: F.when(here, F.col(f"n_{c}")).otherwise(F.col(c)) for c in old.columns if f"n_{c}" in seen.columns}
    out["content_hash"] = F.when(here, F.col("n_content_hash"))
    out["is_deleted"] = ~here
    changed = F.col("kind").isin("added", "modified")
    out["analysis_status"] = F.when(~here, "deleted").when(changed, "pending").otherwise(F.col("analysis_status"))
    if "file_id" in old.columns:
        made = naming.file_id(F.lit(project or ""), F.col("path"))
        text = dict(old.dtypes)["file_id"] == "string"
        out["file_id"] = F.coalesce("file_id", made if text else F.xxhash64(made).cast(dict(old.dtypes)["file_id"]))
    if "project_id" in old.columns:
        out["project_id"] = F.coalesce("project_id", F.lit(project))
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in old.columns], "kind")


def recorded_versions(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    """(path, content_hash, size_bytes, change_kind, run_id): a version for each change that has content;
    of a deleted file its last content."""
    kinds = change_diff(old, new).where("kind <> 'unchanged'")
    side = lambda df, p: df.select(F.col("path").alias(f"{p}_path"), F.col("content_hash").alias(f"{p}_hash"), F.col("size_bytes").alias(f"{p}_size"))
    met = kinds.join(side(new, "n"), F.col("path") == F.col("n_path"), "left").join(side(old, "o"), F.col("path") == F.col("o_path"), "left")
    gone = F.col("kind") == "deleted"
    of = lambda c: F.when(gone, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return met.select("path", of("hash").alias("content_hash"), of("size").alias("size_bytes"), F.col("kind").alias("change_kind"), F.lit(run_id).alias("run_id")).where("content_hash is not null")


def set_status(files: DataFrame, done: DataFrame, suite: str) -> DataFrame:
    """``files`` after analyses: ``done`` is (file_id, status, analyzed_hash); without a hash the last
    analysis stays what it was."""
    said = done.select(F.col("file_id").alias("f"), F.col("status").alias("s"), F.col("analyzed_hash").alias("h"))
    out = files.join(said, F.col("file_id") == F.col("f"), "left")
    new = {"analysis_status": F.coalesce("s", "analysis_status"), "analyzed_hash": F.coalesce("h", "analyzed_hash"), "analyzed_by": F.when(F.col("h").isNotNull(), suite).otherwise(F.col("analyzed_by"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def purge(relationships: DataFrame, evidence: DataFrame, errors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without what the files ``gone`` (file_id) proved or reported."""
    return retract(relationships, gone), retract(evidence, gone), retract(errors, gone)


def without_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Every table's rows that don't name the project; what refers to the others isn't looked at."""
    return {name: df.where(~F.col("project_id").eqNullSafe(F.lit(project_id))) for name, df in tables.items()}


def delete_project(tables: dict[str, DataFrame], project_id: str) -> dict[str, DataFrame]:
    """Every table without the project's rows and without what refers to them."""
    spark = next(iter(tables.values())).sparkSession
    spark = next(iter(tables.values())).sparkSession
    # a range, as its size is known: one row is broadcast, and the project's rows aren't shuffled by one id
    return cascade(tables, {"projects": spark.range(1).select(F.lit(project_id).alias("id"))})


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the files ``gone`` (file_id) and what refers to them; entities stay, without their file."""
    return cascade(tables, {"files": gone.select(F.col("file_id").alias("id"))})


def open_projects(old: DataFrame, new: DataFrame) -> DataFrame:
    """Projects (id, root, name, settings map, updated_at) by their canonical root: one opened again keeps its id."""
    root = F.regexp_replace(F.regexp_replace("root", r"[\\/]+", "/"), r"(?<=.)/$", "")
    return keyed_upsert(old.withColumn("root", root), new.withColumn("root", root), ["root"], fixed=("id",))


def with_settings(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects with single settings replaced. changes: (project_id, key, value), a null value removes a key."""
    grouped = changes.groupBy(F.col("project_id").alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("c"))
    kept = F.map_filter(F.coalesce("settings", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce("c", F.create_map().cast("map<string,string>")), k))
    added = F.map_filter(F.coalesce("c", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    return projects.join(grouped, F.col("id") == F.col("p"), "left").withColumn("settings", F.map_concat(kept, added)).drop("p", "c")


def dry_run(inventory: DataFrame) -> DataFrame:
    """(detected_type, skip_reason, n, bytes) of a scan; nothing is written."""
    return inventory.groupBy("detected_type", "skip_reason").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def default_status(confidence: Column) -> Column:
    """What a claim of that confidence (0 to 100) is until someone judges it."""
    return F.when(confidence >= 100, "confirmed").otherwise("inferred")


def json_lines(df: DataFrame) -> DataFrame:
    """(line): each row as one ASCII JSON object."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    units = F.transform(F.split(text, ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    return df.select(F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(units, "")).otherwise(text).alias("line"))
