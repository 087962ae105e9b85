"""Work that must not be done twice, by one task or on rows that it can't concern."""

import datetime

from pyspark.sql import functions as F

from skeinwork.operators import adjacency, ingest, merge, views, walk
from skeinwork.operators.extract.base import Analyzer, Ref, Registry, analyze_files
from skeinwork.operators.extract.others import default_registry
from skeinwork.streaming import changes


def test_small_files_are_dealt_over_the_tasks(spark):
    files = spark.createDataFrame([(f"f{i}.log", "ORA-01400: x") for i in range(200)], "path string, text string").coalesce(1)
    assert analyze_files(files, default_registry()).select(F.spark_partition_id()).distinct().count() > 1


def test_each_file_is_analysed_once_for_all_tables(spark, tmp_path):
    told = tmp_path / "told"

    def analyze(d):
        with open(told, "a") as f:
            f.write(d.path + "\n")
        here = d.entity(Ref("UnknownEntity", d.path))
        d.relate(here, "ENTITY_DEPENDS_ON_ENTITY", d.entity(Ref("OracleTable", "A")))
        d.relate(here, "ENTITY_DEPENDS_ON_ENTITY", Ref("UnknownEntity", "b.x"))
        d.relate(here, "ENTITY_DEPENDS_ON_ENTITY", Ref("UnknownEntity", "nowhere"))
        d.relate(here, "QUERY_READS_TABLE", Ref("OracleTable", "a"))

    files = spark.createDataFrame([("a.x", "1"), ("b.x", "2")], "path string, text string")
    built = ingest.build(files, Registry().add(Analyzer("x", 1, 1, (".x",), analyze)), "p")
    assert built.entities.count() == 3
    assert built.evidence.count() == 12
    ends = built.relationships.join(built.entities.select(F.col("id").alias("target_id"), "name"), "target_id")
    assert sorted(r.name for r in ends.collect()) == ["A", "A", "A", "A", "b.x", "b.x"]
    assert sorted(r.message.split("|")[-1] for r in built.messages.collect()) == ["nowhere", "nowhere"]
    assert sorted(told.read_text().split()) == ["a.x", "b.x"]


def test_edges_are_made_once_for_every_kind_of_adjacency(spark, tmp_path):
    made = tmp_path / "made"

    @F.udf("string")
    def seen(x):
        with open(made, "a") as f:
            f.write(x + "\n")
        return x

    rels = spark.createDataFrame([("e1", "a", "b", "QUERY_READS_TABLE", 90, "confirmed")], "id string, source_id string, target_id string, relation_type string, conf int, status string")
    ents = spark.createDataFrame([("a",), ("b",)], "id string")
    saved = adjacency.save(rels.withColumn("source_id", seen("source_id")), ents, f"file://{tmp_path}/adj", ("incoming", "around"))
    assert saved.edges("around").count() == 2
    saved.drop()
    assert made.read_text().split() == ["a"]


def test_what_is_known_is_asked_of_what_a_walk_reaches(spark):
    rels = spark.createDataFrame([("e1", "a", "r", "QUERY_READS_TABLE", 90, "confirmed"), ("e2", "x", "r", "QUERY_READS_TABLE", 90, "confirmed"), ("e3", "b", "x", "QUERY_READS_TABLE", 90, "confirmed")], "id string, source_id string, target_id string, relation_type string, conf int, status string")
    ents = spark.createDataFrame([("r",), ("a",), ("b",)], "id string")
    assert "Join" not in adjacency.walk_edges(rels, None, "incoming")._jdf.queryExecution().toString()
    assert [r.id for r in walk.impact(rels, ents, "r").collect()] == ["a"]


def test_edges_that_are_written_are_not_written_again(spark, monkeypatch):
    rels = spark.createDataFrame([("e1", "a", "b", "QUERY_READS_TABLE")], "id string, source_id string, target_id string, relation_type string")
    ents = spark.createDataFrame([("a",), ("b",)], "id string")
    labels, write = [], walk.materialise
    monkeypatch.setattr(walk, "materialise", lambda df, label: labels.append(label) or write(df, label))
    nodes, edges, _ = walk.neighborhood(rels, ents, "a", 1, None, written=True)
    assert (nodes.count(), edges.count(), "edges" in labels) == (2, 1, False)


def test_claims_of_no_file_and_of_one_file_are_not_sorted(spark):
    claims = spark.createDataFrame([("x", None, 1), ("y", 1, 1), ("z", 2, 1)], "id string, file_id bigint, start_line int")
    files = spark.createDataFrame([(1, "a"), (2, "b")], "file_id bigint, path string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, shown = merge.retract(claims, files.where("file_id = 1")), views.markers(claims, files, "b")
        assert sorted(r.id for r in left.collect()) == ["x", "z"]
        assert [r.id for r in shown.collect()] == ["z"]
        for df in (left, shown):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_a_path_that_one_scan_misses_is_deleted_and_added_in_one_run(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1 + n, 12)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = []
    try:
        for n, paths in enumerate((["a", "b"], ["a"], ["a", "b"])):
            rows = [(p, "h", None, 1, at(n)) for p in paths]
            spark.createDataFrame(rows, changes.SCAN).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = changes.changes(spark.readStream.schema(changes.SCAN).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
        writer = stream.writeStream.foreachBatch(lambda df, i: got.extend((r.scanned_at.day, r.path, r.kind) for r in df.collect()))
        writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert sorted(got) == [(1, "a", "added"), (1, "b", "added"), (2, "a", "unchanged"), (2, "b", "deleted"), (3, "a", "unchanged"), (3, "b", "added")]
