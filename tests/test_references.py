"""Ids of scanned files, and deletions that follow references through all tables."""

from pyspark.sql import functions as F

from skeinwork.operators import ingest, lifecycle
from skeinwork.operators.extract.others import default_registry
from skeinwork.operators.references import cascade, order

FILES = "file_id string, project_id string, path string, content_hash string, skip_reason string, size_bytes bigint, is_deleted boolean, analysis_status string"
SCAN = "path string, content_hash string, skip_reason string, size_bytes bigint"


def built(spark, project, **more):
    texts = {"a.sql": "select x from wms.t1 join t2 on t1.a = t2.a", "b.log": "ORA-00942: no table", "c.pkb": "begin q.run(1); end;"} | more
    return ingest.build(spark.createDataFrame(sorted(texts.items()), "path string, text string"), default_registry(), project)


def test_new_files_have_ids_that_a_second_scan_keeps(spark):
    none = spark.createDataFrame([], FILES)
    scan = spark.createDataFrame([("a.sql", "h1", None, 5), ("b.log", "h2", None, 7)], SCAN)
    first = lifecycle.apply_inventory(none, scan, "p").drop("kind")
    ids = {r.path: r.file_id for r in first.collect()}
    assert all(ids.values()) and len(set(ids.values())) == 2 and {r.project_id for r in first.collect()} == {"p"}
    again = spark.createDataFrame([("a.sql", "h9", None, 6), ("c.sql", "h3", None, 1)], SCAN)
    second = {r.path: r for r in lifecycle.apply_inventory(first, again, "p").collect()}
    assert {p: second[p].file_id for p in ids} == ids and second["c.sql"].file_id and second["b.log"].is_deleted
    # the same project scanned into an empty table, and another project
    assert {r.path: r.file_id for r in lifecycle.apply_inventory(none, scan, "p").collect()} == ids
    assert not set(ids.values()) & {r.file_id for r in lifecycle.apply_inventory(none, scan, "other").collect()}
    # the status of a new file can be set by its id, and its evidence speaks of it
    done = spark.createDataFrame([(ids["a.sql"], "analyzed", "h1")], "file_id string, status string, analyzed_hash string")
    files = first.withColumn("analyzed_hash", F.lit(None).cast("string")).withColumn("analyzed_by", F.lit(None).cast("string"))
    assert {(r.path, r.analysis_status) for r in lifecycle.set_status(files, done, "s").collect()} == {("a.sql", "analyzed"), ("b.log", "pending")}
    assert {r.file_id for r in built(spark, "p").evidence.collect()} >= {ids["a.sql"], ids["b.log"]}


def test_whole_number_ids(spark):
    old = spark.createDataFrame([(7, "a.sql", "h1", None, 5, False)], "file_id bigint, path string, content_hash string, skip_reason string, size_bytes bigint, is_deleted boolean").withColumn("analysis_status", F.lit("analyzed"))
    got = {r.path: r.file_id for r in lifecycle.apply_inventory(old, spark.createDataFrame([("a.sql", "h1", None, 5), ("b.sql", "h2", None, 5)], SCAN), "p").collect()}
    assert got["a.sql"] == 7 and got["b.sql"] not in (None, 7)


def test_a_deleted_project_leaves_no_row_in_any_built_table(spark):
    one, two = built(spark, "p"), built(spark, "q", **{"d.log": "ORA-01400: null"})
    projects = spark.createDataFrame([("p",), ("q",)], "id string")
    tables = {n: getattr(one, n).unionByName(getattr(two, n)) for n in ("entities", "relationships", "evidence", "messages")} | {"projects": projects}
    # an edge of q that reaches into p, and its evidence, go as well
    foreign = two.relationships.limit(1).withColumn("id", F.lit("bridge")).withColumn("target_id", F.lit(one.entities.first().id))
    backing = two.evidence.limit(1).withColumn("relationship_id", F.lit("bridge")).withColumn("entity_id", F.lit(None).cast("string"))
    tables["relationships"], tables["evidence"] = tables["relationships"].unionByName(foreign), tables["evidence"].unionByName(backing)
    left = lifecycle.delete_project(tables, "p")
    assert all(left[n].columns == tables[n].columns for n in tables)
    assert {n: left[n].count() for n in left} == {n: getattr(two, n).count() for n in ("entities", "relationships", "evidence", "messages")} | {"projects": 1}
    assert all(left[n].where("project_id = 'p'").count() == 0 for n in ("entities", "relationships", "evidence", "messages"))


def test_files_take_their_claims_along_but_not_their_entities(spark):
    tables = {n: getattr(built(spark, "p"), n) for n in ("entities", "relationships", "evidence", "messages")}
    file = next(r.file_id for r in tables["evidence"].select("file_id").distinct().orderBy("file_id").collect())
    left = lifecycle.delete_files(tables, spark.createDataFrame([(file,)], "file_id string"))
    assert left["entities"].count() == tables["entities"].count() and left["entities"].where(F.col("source_file_id") == file).count() == 0
    assert left["evidence"].where(F.col("file_id") == file).count() == 0 < left["evidence"].count()
    ids = {r.id for r in left["relationships"].collect()}
    assert {r.relationship_id for r in left["evidence"].collect()} - {None} <= ids


def test_order_nulls_and_empty_tables(spark):
    names = order({"evidence", "entities", "projects", "relationships", "files"})
    assert names.index("projects") < names.index("files") < names.index("entities") < names.index("relationships") < names.index("evidence")
    rows = spark.createDataFrame([("e1", None), ("e2", "p")], "id string, project_id string")
    left = cascade({"entities": rows}, {"projects": spark.createDataFrame([("p",), (None,)], "id string")})
    assert [r.id for r in left["entities"].collect()] == ["e1"]
    assert cascade({"entities": rows.limit(0)}, {"projects": spark.createDataFrame([("p",)], "id string")})["entities"].count() == 0
    assert cascade({"entities": rows}, {"files": spark.createDataFrame([("x",)], "id string")})["entities"].count() == 2
