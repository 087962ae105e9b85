"""Streams: a folder watched run by run, and incidents by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import decode


def watch(spark: SparkSession, root: str, suffixes: str = "*") -> DataFrame:
    """New files of a folder as a stream of (path, text)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(root)
    return raw.select("path", decode(F.col("content")).alias("text"))


def run_each(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """One incremental run a batch; the checkpoint makes a restarted stream go on where it was."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def incident_windows(lines: DataFrame, at: str, code: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Errors by window and code. Lines later than ``late`` behind the newest are left out; state of
    closed windows is dropped."""
    return lines.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), code).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), code, "n")


def incident_sessions(lines: DataFrame, at: str, code: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of one error: sightings no more than ``gap`` apart."""
    return lines.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), code).agg(F.count("*").alias("n")).select(F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), code, "n")
