"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): each node hangs its larger (or smaller) neighbours on its least one.

    A small step hangs the node itself there too. A node with any number of neighbours is reduced to
    one row a task before the shuffle.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.where("v > u")
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        hung = both.unionByName(both.select("u", F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    out = hung.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); component is its least reachable node.

    A round is two jobs, and rounds grow with the logarithm of the longest path. Whether a round
    changed anything is counted while its edges are written.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        watch = Observation()
        large = materialise(_star(edges, True), "large")
        edges = materialise(_star(large, False).observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "small")
        state = (watch.get["n"], watch.get["s"])
        if state == seen or not state[0]:
            break
        seen = state
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links`` (a, b); only the classes that these join are worked on."""
    of = lambda name: labels.select(F.col("id").alias(f"{name}_id"), F.col("component").alias(f"{name}_c"))
    met = links.join(of("a"), F.col("a") == F.col("a_id"), "left").join(of("b"), F.col("b") == F.col("b_id"), "left")
    met = materialise(met.select("a", "b", F.coalesce("a_c", "a").alias("ca"), F.coalesce("b_c", "b").alias("cb")), "met")
    if met.isEmpty():
        return labels
    merged = materialise(components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "merged").withColumnsRenamed({"id": "c", "component": "to"})
    nodes = labels.unionByName(met.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("component")), F.struct(F.col("b").alias("id"), F.col("cb").alias("component")))).alias("x")).select("x.*")).distinct()
    return nodes.join(merged, F.col("component") == F.col("c"), "left").select("id", F.coalesce("to", "component").alias("component"))
