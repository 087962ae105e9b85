"""A kept search index: postings in buckets, written once and searched by bucket.

Postings (token, id, col, places, len) lie in segments, partitioned by a bucket that the first two
characters of the token name, so that a word and all its prefixes of two characters or more are in one
bucket. A sync writes one segment with the rows that were touched and, under ``dead``, their ids: what
older segments say of these ids counts no more. The number of rows with words and the sum of their lengths
are kept beside the segments, and a row's length stands in each of its postings, so a search reads nothing
but its tokens' buckets. ``compact`` makes one segment of all.

Everything is committed to a GraphStore at once: searches see a sync whole or not at all, and of two syncs
at a time one is done again.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.store import CommitConflict, GraphStore, Snapshot
from .search import B, K1, parse

BUCKETS = 64
#: Files that a bucket of one segment is written to at most, so that a frequent word's rows are spread.
SPREAD = 8
#: Times that a sync is done again after another one came in between.
TRIES = 5
_POSTING = "token string, id {kind}, col string, places array<int>, len int, bucket int"


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.substring(token, 1, 2).cast("binary")), F.lit(buckets)).cast("int")


class SearchIndex:
    """An index of some columns of a table, kept in a store under ``name``."""

    def __init__(self, store: GraphStore, name: str, key: str, columns: list[str], kind: str = "string", buckets: int = BUCKETS):
        self.store, self.name, self.key, self.columns, self.kind, self.buckets = store, name, key, columns, kind, buckets

    # -- tables --

    def _segments(self, now: Snapshot) -> list[int]:
        return sorted(int(n.rpartition(".")[2]) for n in now.names(f"{self.name}.postings."))

    def _all(self, now: Snapshot, what: str, schema: str) -> DataFrame:
        """All segments of one of the tables, with the segment's number."""
        parts = [now.read(f"{self.name}.{what}.{s}", schema).withColumn("segment", F.lit(s)) for s in self._segments(now)]
        return reduce(DataFrame.unionByName, parts) if parts else self.store.spark.createDataFrame([], f"{schema}, segment int")

    def _alive(self, now: Snapshot, rows: DataFrame) -> DataFrame:
        """``rows`` (id, segment) without those that a later segment replaced."""
        if len(self._segments(now)) < 2:
            return rows
        dead = self._all(now, "dead", f"id {self.kind}").groupBy(F.col("id").alias("dead_id")).agg(F.max("segment").alias("until"))
        return rows.join(dead, F.col("id") == F.col("dead_id"), "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("dead_id", "until")

    def _postings(self, docs: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in self.columns]))
        size = reduce(lambda a, b: a + b, [F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in self.columns])
        words = docs.select(F.col(self.key).cast(self.kind).alias("id"), size.alias("len"), each.alias("x")).select("id", "len", "x.col", F.posexplode("x.t").alias("pos", "token"))
        # places of a word in one row: grouped where they are made, as (id, token) never leaves its row
        found = words.groupBy("token", "id", "col", "len").agg(F.sort_array(F.collect_list("pos")).alias("places"))
        return found.select("token", "id", "col", "places", "len", bucket_of(F.col("token"), self.buckets).alias("bucket"))

    def _segment(self, number: int, postings: DataFrame, dead: DataFrame) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
        name = f"{self.name}.postings.{number}"
        laid = postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "token", "id")
        return {name: laid, f"{self.name}.dead.{number}": dead}, {name: ["bucket"]}

    def _sizes(self, docs: DataFrame) -> DataFrame:
        size = reduce(lambda a, b: a + b, [F.size(tokens(F.coalesce(F.col(c), F.lit("")))) for c in self.columns])
        return docs.select(F.col(self.key).cast(self.kind).alias("id"), size.alias("len")).where("len > 0")

    # -- writing --

    def sync(self, touched: DataFrame) -> int:
        """Take in rows: ``touched`` has the key, the columns and, if rows can be gone, ``is_deleted``; one row a key.

        The first sync builds the index. Only touched rows are written.
        """
        gone = F.col("is_deleted") if "is_deleted" in touched.columns else F.lit(False)
        here, ids = touched.where(~F.coalesce(gone, F.lit(False))), touched.select(F.col(self.key).cast(self.kind).alias("id")).distinct()

        for left in reversed(range(TRIES)):
            with self.store.snapshot() as now:
                segments = self._segments(now)
                number = (segments[-1] + 1) if segments else 1
                tables, partition = self._segment(number, self._postings(here), ids)
                tables[f"{self.name}.lengths.{number}"] = self._sizes(here)
                # what the touched rows counted before, and what they count now
                before = self._alive(now, self._all(now, "lengths", f"id {self.kind}, len int")).join(ids, "id", "left_semi").select((-F.col("len")).alias("len"), F.lit(-1).alias("one"))
                after = self._sizes(here).select("len", F.lit(1).alias("one"))
                old = now.read(f"{self.name}.totals", "n_docs bigint, words bigint")
                change = before.unionByName(after).agg(F.sum("one").alias("n_docs"), F.sum("len").alias("words"))
                tables[f"{self.name}.totals"] = old.unionByName(change).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).coalesce(1)
                try:
                    return now.commit(tables, partition=partition)
                except CommitConflict:
                    if not left:
                        raise
        raise AssertionError

    def compact(self) -> int:
        """One segment of all that is alive."""
        with self.store.snapshot() as now:
            segments = self._segments(now)
            if len(segments) < 2:
                return now.version
            number = segments[-1] + 1
            alive = self._alive(now, self._all(now, "postings", _POSTING.format(kind=self.kind))).drop("segment")
            tables, partition = self._segment(number, alive, self.store.spark.createDataFrame([], f"id {self.kind}"))
            tables[f"{self.name}.lengths.{number}"] = self._alive(now, self._all(now, "lengths", f"id {self.kind}, len int")).drop("segment")
            gone = tuple(f"{self.name}.{what}.{s}" for s in segments for what in ("postings", "dead", "lengths"))
            return now.commit(tables, drop=gone, partition=partition)

    # -- reading --

    def hits(self, now: Snapshot, phrase: list[str], prefix: bool) -> DataFrame:
        """(id, len, tf) of a phrase, read from the buckets of its tokens; with ``prefix`` its last token may go on."""
        every = self._all(now, "postings", _POSTING.format(kind=self.kind))
        out = None
        for i, token in enumerate(phrase):
            open_end = prefix and i == len(phrase) - 1
            rows = every.where(F.col("token").startswith(token) if open_end else F.col("token") == token)
            if not open_end or len(token) > 1:
                rows = rows.where(F.col("bucket") == self._bucket(token))
            step = self._alive(now, rows).select("id", "col", "len", F.explode("places").alias("pos")).select("id", "col", "len", (F.col("pos") - i).alias("at"))
            out = step if out is None else out.join(step.select("id", "col", "at"), ["id", "col", "at"], "left_semi")
        return out.groupBy("id", "len").agg(F.count("*").alias("tf"))

    def _bucket(self, token: str) -> int:
        """The bucket as a plain number, so that it prunes folders while the query is planned."""
        return zlib.crc32(token[:2].encode()) % self.buckets

    def search(self, text: str, last_is_prefix: bool = True, now: Snapshot | None = None) -> DataFrame:
        """(id, score), lower is better, by bm25 over all rows of the index; all phrases must occur."""
        if now is None:
            now = self.store.latest()
        spark, phrases = self.store.spark, parse(text)
        if not phrases:
            return spark.createDataFrame([], f"id {self.kind}, score double")
        totals = now.read(f"{self.name}.totals", "n_docs bigint, words bigint")
        parts = []
        for i, phrase in enumerate(phrases):
            found = self.hits(now, phrase, last_is_prefix and i == len(phrases) - 1)
            idf = found.agg(F.count("*").alias("df")).crossJoin(F.broadcast(totals)).select(F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"), (F.col("words") / F.col("n_docs")).alias("avg_len"))
            weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
            parts.append(found.crossJoin(F.broadcast(idf)).select("id", weight.alias(f"w{i}")))
        both = reduce(lambda a, b: a.join(b, "id"), parts)
        return both.select("id", (-reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(len(phrases))])).alias("score"))
