"""Walks against brute force, stores, streams and sources on small inputs."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions import naming, text
from skeinwork.operators import changes, graph, merge, overlay, search, walk
from skeinwork.plans.store import GraphStore
from skeinwork.sources import files as sources
from skeinwork.streaming import incremental

RELS = "id string, source_id string, target_id string, relation_type string, file_id bigint, start_line int, conf int, status string"
ENTS = "id string, entity_type string, name string, qualified_name string, conf int"


def brute_impact(edges, known, root, depth):
    """Level by level, the best chain at the first depth."""
    seen, frontier = {root: (0, 100, False)}, {root: (100, False)}
    for level in range(1, depth + 1):
        best = {}
        for i, s, t, kind, _, _, conf, status in edges:
            if t in frontier and s not in seen and s in known and kind not in ("FILE_CONTAINS_ENTITY", "ENTITY_DEFINED_IN_FILE"):
                m, g = min(frontier[t][0], conf), frontier[t][1] or status != "confirmed"
                order = (-m, g, -conf, kind, i)
                if s not in best or order < best[s][0]:
                    best[s] = (order, (m, g))
        for s, (_, v) in best.items():
            seen[s] = (level, *v)
        frontier = {s: v for s, (_, v) in best.items()}
    seen.pop(root)
    return seen


edge = st.tuples(st.integers(0, 7), st.integers(0, 7), st.sampled_from(["QUERY_READS_TABLE", "FILE_CONTAINS_ENTITY", "TABLE_JOINS_TABLE"]), st.integers(1, 100), st.sampled_from(["confirmed", "inferred", "manual"]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(edge, max_size=25))
def test_impact_matches_brute_force(spark, edges):
    rows = [(f"e{i}", f"n{s}", f"n{t}", kind, 1, 1, conf, status) for i, (s, t, kind, conf, status) in enumerate(edges)]
    known = {f"n{i}" for i in range(7)}  # n7 dangles
    rels = spark.createDataFrame(rows, RELS)
    ents = spark.createDataFrame([(k, "OracleTable", k, None, 100) for k in known], ENTS)
    got = {r.id: (r.depth, r.min_conf, r.inferred) for r in walk.impact(rels, ents, "n0", depth=3).collect()}
    assert got == brute_impact(rows, known, "n0", 3)


def test_impact_budget_and_paths(spark):
    rels = spark.createDataFrame([("a", "x", "r", "QUERY_READS_TABLE", 1, 1, 90, "confirmed"), ("b", "y", "r", "QUERY_READS_TABLE", 1, 1, 80, "inferred"), ("c", "r", "x", "QUERY_READS_TABLE", 1, 1, 80, "inferred")], RELS)
    ents = spark.createDataFrame([(k, "OracleTable", k, None, 100) for k in "rxy"], ENTS)
    rows = walk.impact(rels, ents, "r", max_nodes=2).collect()
    assert [(r.id, r.path, r.truncated) for r in rows] == [("x", ["r", "x"], True)]
    nodes, edges, cut = walk.neighborhood(rels, ents, "r", 2)
    assert {(r.id, r.depth) for r in nodes.collect()} == {("r", 0), ("x", 1), ("y", 1)} and edges.count() == 3 and not cut
    assert graph.where_used(rels, ents, "r").count() == 3


def test_change_kinds(spark):
    cols = "path string, content_hash string, skip_reason string, size_bytes bigint"
    old = spark.createDataFrame([("same", "1", None, 1, False), ("mod", "1", None, 1, False), ("gone", "1", None, 1, False), ("back", "1", None, 1, True), ("big", None, "too_large", 9, False), ("dead", "1", None, 1, True)], cols + ", is_deleted boolean")
    new = spark.createDataFrame([("same", "1", None, 1), ("mod", "2", None, 1), ("back", "1", None, 1), ("big", None, "too_large", 10), ("new", "3", None, 1)], cols)
    assert {r.path: r.kind for r in changes.change_diff(old, new).collect()} == {"same": "unchanged", "mod": "modified", "gone": "deleted", "back": "added", "big": "modified", "new": "added"}
    assert {r.path for r in changes.change_diff(old.limit(0), new).collect()} == {"same", "mod", "back", "big", "new"}


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.sql").write_text("select 1")
    (tmp_path / "a" / "y.png").write_bytes(b"\x89PNG\x00")
    (tmp_path / "a" / "big.log").write_text("x" * 200)
    (tmp_path / "a" / "u.txt").write_bytes(b"\xef\xbb\xbfcaf\xe9")
    (tmp_path / "node_modules" / "z.js").write_text("1")
    rows = {r.path: r for r in sources.scan(spark, str(tmp_path), sources.ScanPolicy(max_bytes=100)).collect()}
    assert set(rows) == {"a/x.sql", "a/y.png", "a/big.log", "a/u.txt"}
    assert (rows["a/x.sql"].detected_type, rows["a/x.sql"].skip_reason) == ("sql", None)
    assert rows["a/y.png"].skip_reason == "binary" and rows["a/y.png"].content_hash and rows["a/big.log"].skip_reason == "too_large"
    with pytest.raises(ValueError):
        sources.ScanPolicy(max_bytes=0)


def test_store_versions(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    assert store.read("t", "a int").count() == 0
    store.commit({"t": spark.range(3).selectExpr("cast(id as int) a")})
    store.commit({"u": spark.range(1).selectExpr("cast(id as int) a")})
    assert (store.read("t", "a int").count(), store.read("u", "a int").count()) == (3, 1)


def test_stream_run_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("select 1 from t")
    got = []
    for _ in range(2):
        incremental.run_each(incremental.watch(spark, str(tmp_path / "in")), lambda df, n: got.append(sorted(r.text for r in df.collect())), str(tmp_path / "ck")).awaitTermination()
    assert got == [["select 1 from t"]]


def test_windows_are_batch_and_stream_alike(spark):
    t = datetime.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([(t, "E1"), (t + datetime.timedelta(minutes=10), "E1"), (t + datetime.timedelta(hours=2), "E1")], "at timestamp, code string")
    assert sorted(r.n for r in incremental.incident_windows(df, "at", "code").collect()) == [1, 2]
    assert sorted(r.n for r in incremental.incident_sessions(df, "at", "code").collect()) == [1, 2]


def test_names_and_text(spark):
    one = spark.range(1)
    col = lambda c: one.select(c.alias("x")).first().x
    assert col(naming.normalize_name(F.lit(' "a  b" '), F.lit("OracleTable"))) == "A B"
    assert col(naming.normalize_name(F.lit("a"), F.lit("JsonProperty"))) == "a"
    assert col(naming.normalize_path(F.lit("./a\\b/"))) == "a/b" and col(naming.extension(F.lit("x/.git"))) == "" and col(naming.extension(F.lit("a/B.SQL"))) == ".sql"
    assert col(naming.band(F.lit(0.8))) == "strong" and col(naming.clamp(F.lit(1.5))) == 1.0
    assert col(naming.valid_ulid(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) and col(naming.ulid_millis(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259
    assert col(text.blank_noise(F.lit("a 'x''y' -- c\n/* d */ b"))).count("x") == 0
    assert col(text.line_of(F.lit("a\nb\nc"), F.lit(2))) == 2 and col(text.lines(F.lit("a\nb\nc"), F.lit(2), F.lit(3))) == "b\nc"
    assert col(text.signature(F.lit("x 12 y 3"))) == "x # y #"


def test_search_fallback_and_overlay(spark):
    docs = spark.createDataFrame([(1, "UC_INSP_ENT", None), (2, "insp other", "ent")], "id bigint, name string, note string")
    hits = search.search(docs.withColumnRenamed("id", "k"), "k", "name", ["name", "note"], "insp ent")
    assert {r.hit_id for r in hits.collect()} == {1, 2}
    assert [r.hit_id for r in search.search(docs.withColumnRenamed("id", "k"), "k", "name", ["name"], "nsp_e").collect()] == [1]
    claims = spark.createDataFrame([("a", "k1", "inferred"), ("b", "k2", "confirmed")], "id string, claim string, status string")
    notes = spark.createDataFrame([("k1", "rejected")], "target_key string, verdict string")
    assert {(r.id, r.status) for r in overlay.annotated(claims, notes, "claim").collect()} == {("a", "manual"), ("b", "confirmed")}
    assert overlay.annotated(claims, notes, "claim", hide_rejected=True).count() == 1


def test_keyed_upsert_keeps_identity(spark):
    cols = "id string, created_at int, updated_at int, project_id string, key string, value string"
    old, new = spark.createDataFrame([("i", 1, 1, "p", "k", "a")], cols), spark.createDataFrame([("j", 2, 2, "p", "k", "b"), ("l", 2, 2, "p", "m", "c")], cols)
    got = {r.key: (r.id, r.created_at, r.value) for r in merge.keyed_upsert(old, new, ["project_id", "key"]).collect()}
    assert got == {"k": ("i", 1, "b"), "m": ("l", 2, "c")}
