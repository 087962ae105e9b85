"""Runs that are watched and stopped, the analyzers in SQL, dates, tolerant JSON, a diagram's focus."""

import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import dates, text
from skeinwork.operators import views
from skeinwork.operators.extract import table_function
from skeinwork.operators.extract.base import analyze_files
from skeinwork.operators.extract.others import default_registry
from skeinwork.plans.runs import Run
from skeinwork.plans.store import GraphStore


def test_a_run_tells_what_it_wrote(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    run = Run(store)
    assert run.execute(lambda now: {"a": spark.range(7), "b": spark.range(0)}) == 1
    assert run.progress() == {"a": 7, "b": 0} and not run.cancelled


def test_a_cancelled_run_leaves_the_last_version(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "s"))
    store.commit({"a": spark.range(3), "b": spark.range(3)})

    def slow(frames):
        for frame in frames:
            time.sleep(60)
            yield frame

    run, failed = Run(store), []

    def work():
        try:
            run.execute(lambda now: {"a": spark.range(5), "b": spark.range(8, numPartitions=2).mapInPandas(slow, "id bigint")})
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    began = time.perf_counter()
    while thread.is_alive() and time.perf_counter() - began < 50:
        run.cancel()
        thread.join(1)
    assert not thread.is_alive() and failed and run.cancelled
    assert (store.read("a").count(), store.read("b").count(), store.versions()) == (3, 3, [1])
    assert all(len([f for f in (tmp_path / "s" / t).iterdir() if not f.name.startswith(".")]) == 1 for t in "ab")
    assert Run(store).execute(lambda now: {"a": now.read("a")}) == 2


def test_drafts_in_sql(spark):
    files = spark.createDataFrame([("a.sql", "select x from t1 join t2 on t1.a = t2.a"), ("b.json", '{"a": 1'), ("c.py", None), (None, "x"), ("d.log", "ORA-00942: x")], "path string, text string")
    table_function.register(spark, default_registry(), "test_drafts")
    files.createOrReplaceTempView("test_files")
    got = spark.sql("SELECT d.* FROM test_files f, LATERAL test_drafts(f.path, f.text) d")
    wanted = analyze_files(files.select(F.coalesce("path", F.lit("")).alias("path"), "text"), default_registry())
    key = lambda df: sorted(map(repr, df.collect()))
    assert got.columns == wanted.columns and key(got) == key(wanted) != []


def test_dates_and_json(spark):
    at = datetime.datetime(2024, 2, 29, 23, 59, 58, 12)
    row = spark.createDataFrame([(at, 19782)], "at timestamp_ntz, days int").select(dates.to_iso(F.col("at")).alias("iso"), dates.from_iso(dates.to_iso(F.col("at"))).alias("back"), dates.civil(F.col("days")).alias("day"), dates.now_iso().alias("now")).first()
    assert (row.iso, row.back, row.day) == ("2024-02-29T23:59:58.000012Z", at, datetime.date(2024, 2, 29))
    assert abs(datetime.datetime.fromisoformat(row.now) - datetime.datetime.now(datetime.UTC)) < datetime.timedelta(minutes=1)
    bad = spark.createDataFrame([("2024-13-01T00:00:00.000000Z",), ("2024-01-01",), (None,)], "t string").select(dates.from_iso(F.col("t")))
    assert [r[0] for r in bad.collect()] == [None] * 3
    texts = ['{"a": 1, "b": {"c": [2]}}', "{broken", "[1]", "7", "", None, " {}"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.json_object(F.col("t"))).collect()]
    assert got == [{"a": "1", "b": '{"c":[2]}'}, {}, {}, {}, {}, {}, {}]


@pytest.mark.parametrize(("selected", "wanted"), [("v", "v"), ("p", "t1"), (None, "t1")])
def test_focus(spark, selected, wanted):
    ents = spark.createDataFrame([("v", "OracleView", "V"), ("p", "OracleProcedure", "P")], "id string, entity_type string, name string")
    shown = spark.createDataFrame([("t2", "OracleTable", "A", 9), ("t1", "OracleTable", "B", 2), ("p", "OracleProcedure", "P", 1)], "id string, entity_type string, name string, first_line int")
    assert [r.id for r in views.focus_choice(ents.where(F.col("id") == selected), shown).collect()] == [wanted]
    assert views.focus_choice(ents.limit(0), shown.limit(0)).collect() == []
