"""The kept search index against the one that is made for a query."""

import re

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import search
from skeinwork.operators.search_index import SearchIndex
from skeinwork.plans.store import CommitConflict, GraphStore

DOC = "id bigint, name string, more string"
DOCS = [(1, "The ring of fire", "red ring"), (2, "ringed nut", None), (3, "nut", "ring ring nut of"), (4, None, "a"), (5, "", ""), (6, "of fire the ring", "x-y Ring_of")]


def same(index, docs, text, prefix=True):
    rows = search.bm25(search.index(docs, "id", ["name", "more"]), text, prefix)
    found = lambda df: sorted((r.id, round(r.score, 9)) for r in df.collect())
    assert found(index.search(text, prefix)) == found(rows)
    return [i for i, _ in found(rows)]


@pytest.fixture
def index(spark, tmp_path):
    made = SearchIndex(GraphStore(spark, str(tmp_path / "s")), "names", "id", ["name", "more"], "bigint")
    made.sync(spark.createDataFrame(DOCS, DOC))
    return made


def test_searches_equal_those_over_all_rows(spark, index):
    docs = spark.createDataFrame(DOCS, DOC)
    assert same(index, docs, "ring") == [1, 2, 3, 6] and same(index, docs, "ring", False) == [1, 3, 6]
    assert same(index, docs, "ring_of") == [1, 6] and same(index, docs, "r nut") == []
    assert same(index, docs, "nut r") == [2, 3] and same(index, docs, "none") == [] and same(index, docs, '" *') == []


def test_syncs_and_compaction(spark, index):
    changed = [(2, "bolt", "ring", False), (3, None, None, True), (7, "new ring nut", None, False), (99, "never there", None, True)]
    index.sync(spark.createDataFrame(changed, DOC + ", is_deleted boolean"))
    index.sync(spark.createDataFrame([(7, "new bolt nut", None)], DOC))
    now = [d for d in DOCS if d[0] not in (2, 3)] + [(2, "bolt", "ring"), (7, "new bolt nut", None)]
    docs = spark.createDataFrame(now, DOC)
    for _ in range(2):
        assert same(index, docs, "ring") == [1, 2, 6] and same(index, docs, "bolt") == [2, 7] and same(index, docs, "nut") == [7]
        assert same(index, docs, "of fire") == [1, 6]
        totals = index.store.read("names.totals").first()
        assert (totals.n_docs, totals.words) == (5, sum(len(re.findall("[a-z0-9]+", f"{n or ''} {m or ''}".lower())) for _, n, m in now))
        index.compact()
    assert len(index._segments(index.store.latest())) == 1
    # a sync writes its own rows only
    index.sync(spark.createDataFrame([(8, "one two", None)], DOC))
    assert index.store.read(f"names.postings.{max(index._segments(index.store.latest()))}").count() == 2


def test_a_search_reads_its_buckets_only(spark, index):
    index.sync(spark.createDataFrame([(8, "ring", "zebra")], DOC))
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = index.search("ring zeb")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    scans = [line for line in plan.splitlines() if "FileScan parquet [token" in line]
    numbers = [re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = (\d+)\)\]", line)[1] for line in scans]
    assert set(numbers) == {str(index._bucket("ring")), str(index._bucket("zebra"))} and len(scans) % 4 == 0


def test_two_syncs_at_a_time(spark, index, monkeypatch):
    other = SearchIndex(index.store, "names", "id", ["name", "more"], "bigint")
    sizes, once = index._sizes, []

    def late(docs):
        if not once:
            once.append(1)
            other.sync(spark.createDataFrame([(9, "between", None)], DOC))
        return sizes(docs)

    monkeypatch.setattr(index, "_sizes", late)
    index.sync(spark.createDataFrame([(1, "replaced", None)], DOC))
    docs = spark.createDataFrame([d for d in DOCS if d[0] != 1] + [(1, "replaced", None), (9, "between", None)], DOC)
    assert same(index, docs, "between") == [9] and same(index, docs, "replaced") == [1] and same(index, docs, "ring") == [2, 3, 6]
    with index.store.snapshot() as now:
        index._segments(now)
        index.sync(spark.createDataFrame([(10, "again", None)], DOC))
        with pytest.raises(CommitConflict):
            now.commit({"names.totals": spark.createDataFrame([(0, 0)], "n_docs bigint, words bigint")})


def test_an_empty_table(spark, tmp_path):
    index = SearchIndex(GraphStore(spark, str(tmp_path / "s")), "names", "id", ["name"], "bigint")
    assert index.search("x").collect() == []
    index.sync(spark.createDataFrame([], DOC))
    assert index.search("x y").collect() == [] and index.store.read("names.totals").first().n_docs == 0
    index.sync(spark.createDataFrame([(1, "x", None)], DOC).withColumn("is_deleted", F.lit(None).cast("boolean")))
    assert [r.id for r in index.search("x").collect()] == [1]
