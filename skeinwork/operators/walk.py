"""Multi-hop walks: impact and neighbourhood.

Each level is one join of the frontier with the edges. Levels are written out, so lineage stays short
and a lost executor costs a re-read. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import materialise
from .adjacency import Adjacency, both_ways, walk_edges

VISIT = "id string, depth int, min_conf int, inferred boolean, via string, path array<string>"


def impact(rels: DataFrame, ents: DataFrame, root: str, direction: str = "incoming", depth: int = 4, max_nodes: int | None = 500, min_conf: int = 0, saved: Adjacency | None = None) -> DataFrame:
    """(id, depth, min_conf, inferred, via, path) of what depends on ``root`` (or it on, outgoing).

    A node is fixed at its first depth. There the best chain wins: highest weakest link, then one
    without inferred edges, then the stronger edge, relation type and edge id. A chain counts as
    inferred with its first edge that isn't confirmed. Containment edges don't carry impact. With a
    budget, the best candidates of the level that exceeds it are admitted; ``truncated`` tells so. With a
    ``saved`` adjacency nothing is read of ``rels`` and ``ents``.
    """
    spark = rels.sparkSession
    # without a saved adjacency the walk's edges are written once, so that a level reads six columns; what is known is asked
    # of the few entities that a level reaches, not of all edges
    edges = materialise(walk_edges(rels, None, direction, min_conf), "edges") if saved is None else saved.edges(direction).where(F.col("conf") >= min_conf)
    frontier = spark.createDataFrame([(root, 0, 100, False, None, [root])], VISIT)
    visited, admitted, truncated = frontier, 1, False
    levels: list[DataFrame] = []
    for level in range(1, max(1, depth) + 1):
        met = frontier.join(edges, F.col("id") == F.col("from"))
        met = met.select(F.col("to").alias("id"), F.least("min_conf", "conf").alias("min_conf"), (F.col("inferred") | F.col("guess")).alias("inferred"), F.col("edge_id").alias("via"), "relation_type", "conf", F.concat("path", F.array("to")).alias("path"))
        met = met.join(visited.select(F.col("id").alias("seen")), F.col("id") == F.col("seen"), "left_anti")
        order = [F.desc("min_conf"), F.asc("inferred"), F.desc("conf"), F.asc("relation_type"), F.asc("via")]
        # partial aggregates: a hub's whole in-degree never meets in one task
        rank = F.struct((-F.col("min_conf")).alias("m"), "inferred", (-F.col("conf")).alias("c"), "relation_type", "via")
        best = met.groupBy("id").agg(F.min_by(F.struct("min_conf", "inferred", "via", "relation_type", "conf", "path"), rank).alias("b")).select("id", "b.*")
        best = materialise(best.withColumn("depth", F.lit(level)), "level")
        if saved is None:
            known = ents.select(F.col("id").alias("known")).join(best.select(F.col("id").alias("reached")), F.col("known") == F.col("reached"), "left_semi")
            best = materialise(best.join(known, F.col("id") == F.col("known"), "left_semi"), "level")
        n = best.count()
        if max_nodes is not None and n > (room := max(max_nodes - admitted, 0)):
            truncated, n = True, room
            best = materialise(best.orderBy(*order).limit(room), "level")
        frontier = best.select("id", "depth", "min_conf", "inferred", "via", "path")
        if n:
            levels.append(frontier)
        admitted += n
        if truncated or not n:
            break
        visited = visited.unionByName(frontier)
    out = spark.createDataFrame([], VISIT)
    for x in levels:
        out = out.unionByName(x)
    return out.withColumn("truncated", F.lit(truncated))


def neighborhood(rels: DataFrame, ents: DataFrame, root: str, depth: int = 1, max_nodes: int | None = 150, saved: Adjacency | None = None, written: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes (id, depth), edges among them, truncated): undirected walk over all edge types.

    Of a level that exceeds the budget the least ids are admitted. Edges come once each, both ends
    among the nodes. Edges that the caller has ``written`` are read as they are, as by several walks.
    """
    spark = rels.sparkSession
    if saved is None and not written:
        rels = materialise(rels, "edges")
    both = both_ways(rels) if saved is None else saved.edges("around")
    known = ents.select(F.col("id").alias("known"))
    frontier = nodes = spark.createDataFrame([(root, 0)], "id string, depth int")
    admitted, truncated = 1, False
    for level in range(1, depth + 1):
        met = frontier.join(both, F.col("id") == F.col("from")).select(F.col("to").alias("id")).distinct()
        met = met.join(nodes.select(F.col("id").alias("seen")), F.col("id") == F.col("seen"), "left_anti").join(known, F.col("id") == F.col("known"), "left_semi")
        met = materialise(met.withColumn("depth", F.lit(level)), "ring")
        n = met.count()
        if max_nodes is not None and n > max_nodes - admitted:
            met, truncated = materialise(met.orderBy("id").limit(max(max_nodes - admitted, 0)), "ring"), True
            n = max(max_nodes - admitted, 0)
        admitted += n
        nodes = nodes.unionByName(met)
        if truncated or not n:
            break
        frontier = met
    keep = nodes.select(F.col("id").alias("k"))
    edges = rels.join(keep, F.col("source_id") == F.col("k"), "left_semi").join(keep, F.col("target_id") == F.col("k"), "left_semi")
    return nodes, edges, truncated


def merge_neighborhoods(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Least depth of each node; one edge (the last by id) for each source, relation and target."""
    all_nodes, all_edges = nodes[0], edges[0]
    for n, e in zip(nodes[1:], edges[1:], strict=True):
        all_nodes, all_edges = all_nodes.unionByName(n), all_edges.unionByName(e)
    merged = all_nodes.groupBy("id").agg(F.min("depth").alias("depth"))
    one = all_edges.groupBy("source_id", "relation_type", "target_id").agg(F.max("id").alias("edge_id"))
    return merged, one


def radial_layout(nodes: DataFrame, names: DataFrame, ring: float = 190.0) -> DataFrame:
    """x and y: a ring for each depth, nodes by name, odd rings turned by half a step."""
    w = Window.partitionBy("depth")
    placed = nodes.join(names, "id").withColumn("i", F.row_number().over(w.orderBy("name", "id")) - 1).withColumn("n", F.count("*").over(w))
    angle = 2 * F.pi() * F.col("i") / F.col("n") + (F.col("depth") % 2) * F.pi() / F.col("n")
    return placed.select("id", "depth", F.round(ring * F.col("depth") * F.cos(angle), 4).alias("x"), F.round(ring * F.col("depth") * F.sin(angle), 4).alias("y"))


def grid_layout(rows: DataFrame, order: str) -> DataFrame:
    """Cells of a square grid by ``order``."""
    w = Window.orderBy(order)
    numbered = rows.withColumn("i", F.row_number().over(w) - 1).crossJoin(F.broadcast(rows.agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("cols"))))
    return numbered.withColumn("col", F.pmod("i", "cols")).withColumn("row", F.floor(F.col("i") / F.col("cols")).cast("int")).drop("i", "cols")
