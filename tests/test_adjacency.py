"""Walks over a saved adjacency: equal to those over tables, without shuffling the edges."""

import re

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import adjacency, walk

REL = "id string, source_id string, target_id string, relation_type string, conf int, status string"


@pytest.fixture(scope="module")
def graph(spark):
    n = 400
    rels = spark.range(5 * n).select(
        F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(n))).alias("source_id"), F.concat(F.lit("n"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)))).alias("target_id"),
        F.when(F.col("id") % 11 == 0, "FILE_CONTAINS_ENTITY").otherwise("ENTITY_DEPENDS_ON_ENTITY").alias("relation_type"), (50 + F.col("id") % 51).cast("int").alias("conf"), F.when(F.col("id") % 2 == 0, "confirmed").otherwise("inferred").alias("status"),
    )
    return rels, spark.range(n - 20).select(F.concat(F.lit("n"), "id").alias("id"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_walks_are_alike(spark, graph, tmp_path):
    rels, ents = graph
    saved = adjacency.save(rels, ents, f"file://{tmp_path}/adj")
    again = adjacency.load(spark, f"file://{tmp_path}/adj")
    for kept in (saved, again):
        for way in ("incoming", "outgoing"):
            for more in ({}, {"max_nodes": None, "min_conf": 70}):
                assert rows(walk.impact(rels, ents, "n5", way, 3, saved=kept, **more)) == rows(walk.impact(rels, ents, "n5", way, 3, **more))
        a, b = (walk.neighborhood(rels, ents, "n7", 2, 60, saved=s) for s in (kept, None))
        assert rows(a[0]) == rows(b[0]) and rows(a[1]) == rows(b[1]) and a[2] == b[2]
    again.drop()
    assert not (tmp_path / "adj").exists()


def test_edges_are_read_where_they_lie(spark, graph, tmp_path):
    rels, ents = graph
    saved = adjacency.save(rels, ents, f"file://{tmp_path}/adj", ("incoming",))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frontier = spark.range(1000).select(F.concat(F.lit("n"), "id").alias("id"))
        met = frontier.join(saved.edges("incoming"), F.col("id") == F.col("from"))
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    final = plan.partition("Initial Plan")[0]
    assert "SortMergeJoin" in final and len(re.findall(r"\bExchange ", final)) == 1 and "Bucketed: true" in final
    # the one exchange is the frontier's
    assert final.index("FileScan") > final.rindex("Exchange ") and "Range" in final[final.rindex("Exchange ") : final.index("FileScan")]


def test_an_empty_graph(spark, graph, tmp_path):
    rels, ents = (df.limit(0) for df in graph)
    saved = adjacency.save(rels, ents, f"file://{tmp_path}/adj")
    assert walk.impact(rels, ents, "n1", saved=saved).collect() == [] and walk.neighborhood(rels, ents, "n1", saved=saved)[0].count() == 1
