"""A saved adjacency: the edges that walks follow, bucketed and sorted by the end that a walk comes from.

A level of a walk joins its frontier with the edges on that end. Saved so, the edges are read where they
lie: only the frontier is shuffled, to as many partitions as there are buckets, whatever the number of
levels and of questions. It is made once for a state of the graph and dropped with it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.folder import Folder
from ..plans.store import materialise
from ..schema import STRUCTURAL

#: Edges of a bucket; there are never fewer buckets than partitions of a shuffle, or both sides would be dealt anew.
EDGES_A_BUCKET = 2_000_000
DIRECTIONS = {"incoming": ("target_id", "source_id"), "outgoing": ("source_id", "target_id")}
_IMPACT = "`from` string, `to` string, relation_type string, conf int, edge_id string, guess boolean"
_RING = "`from` string, `to` string"


def walk_edges(rels: DataFrame, ents: DataFrame | None, direction: str, min_conf: int = 0) -> DataFrame:
    """(from, to, relation_type, conf, edge_id, guess) of the edges that carry impact to a known entity, or to
    any where ``ents`` isn't given."""
    own, other = DIRECTIONS[direction]
    edges = rels.where(~F.col("relation_type").isin(*STRUCTURAL) & (F.col("conf") >= min_conf)).select(
        F.col(own).alias("from"), F.col(other).alias("to"), "relation_type", "conf", F.col("id").alias("edge_id"), (F.col("status") != "confirmed").alias("guess")
    )
    return edges if ents is None else edges.join(ents.select(F.col("id").alias("known")), F.col("to") == F.col("known"), "left_semi")


def both_ways(rels: DataFrame) -> DataFrame:
    """(from, to) of all edges, once from either end."""
    return rels.select(F.col("source_id").alias("from"), F.col("target_id").alias("to")).unionByName(rels.select(F.col("target_id").alias("from"), F.col("source_id").alias("to")))


@dataclass(frozen=True)
class Adjacency:
    """Bucketed tables of one state of a graph under ``root``, registered in the session."""

    spark: SparkSession
    root: str
    names: dict[str, str]

    def edges(self, kind: str) -> DataFrame:
        return self.spark.table(self.names[kind])

    def drop(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        Folder(self.spark, self.root).remove("")


def save(rels: DataFrame, ents: DataFrame, root: str, kinds: tuple[str, ...] = ("incoming", "outgoing", "around")) -> Adjacency:
    """Write the edges by each end, and (``around``) by both, and register them."""
    spark, names = rels.sparkSession, {}
    # written once, as it is counted and laid for each kind
    rels = materialise(rels.select("id", "source_id", "target_id", "relation_type", "conf", "status"), "edges")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rels.count() // EDGES_A_BUCKET))
    for kind in kinds:
        edges = both_ways(rels) if kind == "around" else walk_edges(rels, ents, kind)
        names[kind] = name = f"edges_{kind}_{uuid.uuid4().hex}"
        laid = edges.repartition(buckets, "from")
        laid.write.format("parquet").option("path", f"{root}/{kind}-{buckets}").bucketBy(buckets, "from").sortBy("from").saveAsTable(name)
    return Adjacency(spark, root, names)


def load(spark: SparkSession, root: str) -> Adjacency:
    """Register what ``save`` wrote, in another session."""
    names = {}
    for folder in Folder(spark, root).names(""):
        kind, _, buckets = folder.rpartition("-")
        if kind in (*DIRECTIONS, "around"):
            names[kind] = name = f"edges_{kind}_{uuid.uuid4().hex}"
            columns = _RING if kind == "around" else _IMPACT
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`from`) SORTED BY (`from`) INTO {buckets} BUCKETS LOCATION '{root}/{folder}'")
    return Adjacency(spark, root, names)
