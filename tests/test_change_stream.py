"""Changes as a stream against the batch comparison, over several scans and a restart."""

import datetime

from skeinwork.operators.changes import change_diff
from skeinwork.streaming import changes

SCANS = [
    [("a", "h1", None, 1), ("b", "h2", None, 2), ("c", None, "too_large", 9), ("d", None, "binary", 3)],
    [("a", "h1", None, 1), ("b", "h3", None, 2), ("c", None, "too_large", 10), ("e", "h5", None, 5)],
    [("a", "h1", None, 7), ("d", None, "binary", 3), ("c", "h9", None, 4)],
    [("b", "h3", None, 2), ("a", None, "unreadable", 7), ("e", "h5", None, 5), ("d", None, "binary", 3)],
]
ROW = "path string, content_hash string, skip_reason string, size_bytes bigint"


def batch_kinds(spark):
    """By the batch comparison, scan after scan; a path that is gone is said so once."""
    known, out = {}, []
    for n, scan in enumerate(SCANS):
        old = spark.createDataFrame([(*row, gone) for row, gone in known.values()], ROW + ", is_deleted boolean")
        kinds = {r.path: r.kind for r in change_diff(old, spark.createDataFrame(scan, ROW)).collect()}
        out += [(n, p, k) for p, k in kinds.items()]
        known = {p: (row, kinds.get(p, "deleted") == "deleted") for p, (row, _) in known.items()} | {row[0]: (row, False) for row in scan}
    return sorted(out)


def test_stream_and_batch_agree_over_a_restart(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1 + n, 12)
    got = []

    def run(scans):
        for n in scans:
            spark.createDataFrame([(*row, at(n)) for row in SCANS[n]], changes.SCAN).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = changes.changes(spark.readStream.schema(changes.SCAN).json(str(tmp_path / "in")))
            writer = stream.writeStream.foreachBatch(lambda df, i: got.extend((r.scanned_at, r.path, r.kind) for r in df.collect()))
            writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        run([0, 1])
        assert not any(q.isActive for q in spark.streams.active)
        run([2, 3])  # a new query each time goes on from the checkpoint
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    number = {at(n): n for n in range(len(SCANS))}
    assert sorted((number[t], p, k) for t, p, k in got) == batch_kinds(spark)
    assert {k for _, _, k in got} == {"added", "modified", "unchanged", "deleted"}
