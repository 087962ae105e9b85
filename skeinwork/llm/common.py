"""Helpers that the corpus operators share: session folders, materialised steps, safe column access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that every text operator here splits on, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Tables written by ``materialise`` and not yet swept, of this process.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``, which a cluster must name. Only in local mode, as in tests, is a
    folder under /tmp taken where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/skeinwork-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than re-reading files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(docs: DataFrame) -> None:
    """Remove the tables that ``materialise`` wrote for earlier steps, but for what ``docs`` is read from.

    Only for the caller that has written down all results of those steps.
    """
    if not _WRITTEN:
        return
    spark = docs.sparkSession
    held = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()}
    kept = []
    for path in _WRITTEN:
        if path.rpartition("/")[2] in held:
            kept.append(path)
        else:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN[:] = kept


def column(df: DataFrame, name: str, kind: str) -> Column:
    """``df[name]`` cast to ``kind``; a typed null when the table lacks the column."""
    if name in df.columns:
        return F.col(f"`{name}`").cast(kind)
    return F.lit(None).cast(kind)


def whole_text(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(column(df, name, "string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    name = f"__sk_{stem}"
    while name in df.columns:
        name += "_"
    return name


def struct_of(fields: dict[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
