"""Jaccard join of word n-gram sets, reported as classes of linked documents.

Set-relation skipping, in two forms. Index level: a document is indexed under the window of its
least shingle hashes, and lists keep each entry's size and position. A short list is sorted by
position, and an entry meets only the part of it that sizes and positions leave open; a group of
documents from long lists is cut into blocks by size, and pairs of blocks whose sizes can't reach the
threshold are skipped whole. Answer level: sets that are equal share one entry; the members of a
long list are first checked against two leaders of the list only, and whoever is as similar as that
shares the leader's answers, so a list is searched again only across the classes that are still
apart, where a set's intersections follow from its leader's and the differences from it.

Why no link is lost. Let p(n) = n - ceil(t n) + 1, a window hold the w(n) = min(n, p(n) + ceil(p(n) / 2)) least
hashes, and need(n) = w(n) - p(n) + 1. Two linked sets share at least min(need(x), need(y)) hashes of
their windows. Short lists (at most ``long_list`` entries) are paired whole, and a pair's shared short
lists are counted; a pair passes if its count and the long lists that both are in can make up the
need. A pair that shares no short list must share that many long ones, so both documents belong to
the few that are in need(ceil(t n)) long lists. These are indexed a second time by the classic prefix
filter over whole sets, rarest shingle first, whose lists are only long where documents are alike.

A hot shingle or leader is one row in an aggregate; the joins that carry its entries are sort-merge
joins, whose hot partitions adaptive execution splits.

Defined results: without words or text a document has no shingles, links with nothing and is its
own component; so is one with a null doc_id (its component_id is null); rows that share a doc_id
count as one document in links, each text searched by itself; repeated rows each get a row; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, materialise, whole_text
from .components import components, joined

CACHE_WORDS = 400_000
#: Ids that may be broadcast, 8 bytes each.
BROADCAST_IDS = 500_000
#: Leaders of a long list before classes that are still apart are searched in blocks.
LEADERS = 2
#: Hashes (8 bytes each) and documents in a block, and columns of a step of a block's product.
BLOCK_HASHES, BLOCK_ROWS, CHUNK = 120_000, 1000, 2048


class WordHashes(dict):
    """64-bit hash of each word, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def shingle_hashes(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of ``text``; A-Z count as a-z.

    With fewer than k words, the whole sequence is the one shingle.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out += w[i : n - width + 1 + i] * np.uint64(_MULTIPLIERS[i % 8] + 2 * (i // 8))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out.sort()
    if len(out) > 1:
        out = out[np.concatenate(([True], out[1:] != out[:-1]))]
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _array(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    col = batch.column(name)
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    return [flat[at[i] : at[i + 1]].view(np.uint64) for i in range(len(col))]


@dataclass(frozen=True)
class NgramJaccardJoin:
    """k words a shingle; linked when ``den`` * intersection >= ``num`` * union."""

    k: int = 4
    num: int = 85
    den: int = 100
    #: Entries up to which a list counts as short.
    long_list: int = 6

    def least(self, n: int) -> int:
        """ceil(t n): the least intersection a set of n elements needs."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def window(self, n: int) -> int:
        return min(n, self.prefix(n) + (self.prefix(n) + 1) // 2)

    # -- building sets ------------------------------------------------------------------------

    def sets(self, docs: DataFrame) -> DataFrame:
        """(uid, doc_id, n, fp, win) of every row: set size, 128-bit digest of the set, index window."""
        join = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                found = [shingle_hashes(t.as_py(), join.k, hashes) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in found], pa.int32()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                        _lists([s[: join.window(len(s))] for s in found]),
                    ],
                    ["doc_id", "n", "fp", "win"],
                )

        rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), whole_text(docs).cast("binary").alias("text"))
        return rows.mapInArrow(run, "doc_id bigint, n int, fp binary, win array<bigint>").withColumn("uid", F.monotonically_increasing_id())

    def whole_sets(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """(id, crowd, n, arr) for the documents in ``ids`` (id, crowd): all of their shingle hashes.

        A task passes on a repeated row once.
        """
        join = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, seen = WordHashes(), set()
            for batch in batches:
                rows, found = [], []
                for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                    s = shingle_hashes(text.as_py(), join.k, hashes)
                    if (mark := (key, xxhash.xxh3_64_intdigest(s.tobytes()))) not in seen:
                        seen.add(mark)
                        rows.append(i)
                        found.append(s)
                pick = pa.array(rows, pa.int64())
                sizes = pa.array([len(s) for s in found], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), sizes, _lists(found)], ["id", "crowd", "n", "arr"])

        rows = docs.select(column(docs, "doc_id", "bigint").alias("d"), whole_text(docs).cast("binary").alias("text"))
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return rows.join(side, F.col("d") == F.col("id")).select("id", "crowd", "text").mapInArrow(run, "id bigint, crowd boolean, n int, arr array<bigint>")

    # -- candidates ---------------------------------------------------------------------------

    def _least(self, n: Column) -> Column:
        return F.floor((F.lit(self.num).cast("bigint") * n + self.den - 1) / self.den).cast("int")

    def _need(self, n: Column) -> Column:
        p = n - self._least(n) + 1
        return F.least(n, p + F.floor((p + 1) / 2).cast("int")) - p + 1

    def _sizes(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num

    def _reach(self, x: Column, y: Column) -> Column:
        """Sizes and positions of the two entries leave room for a link."""
        most = F.least(x["pos"], y["pos"]) + F.least(x["n"] - x["pos"], y["n"] - y["pos"])
        return self._sizes(x["n"], y["n"]) & (most * (self.den + self.num) >= self.num * (x["n"] + y["n"]))

    @staticmethod
    def _shared(entries: DataFrame) -> DataFrame:
        """``entries`` of lists with two or more of them, with the list's length m."""
        counts = entries.groupBy("tok").agg(F.count("*").alias("m")).where("m >= 2").withColumnRenamed("tok", "t")
        return entries.join(counts, F.col("tok") == F.col("t")).drop("t")

    def window_entries(self, sets: DataFrame) -> DataFrame:
        """(tok, id, n, pos, long) of the window entries that share their list; n and pos travel as one number."""
        entry = sets.select("id", "n", F.posexplode("win").alias("pos", "tok")).select("tok", "id", (F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("pos")).alias("at"))
        n, pos = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return self._shared(entry).select("tok", "id", n.alias("n"), pos.alias("pos"), (F.col("m") > self.long_list).alias("long"))

    def short_pairs(self, entries: DataFrame, in_long: DataFrame) -> DataFrame:
        """(a, b): pairs of short lists that share enough of them. in_long: (d, h), long lists a document is in."""
        # a short list has at most long_list entries, so it fits one row
        lists = entries.where("not long").groupBy("tok").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "n"))).alias("l"))
        x = lists.select("l", F.posexplode("l").alias("i", "x"))
        open_ = F.filter(F.slice("l", F.col("i") + 2, F.size("l")), lambda y: self._reach(F.col("x"), y) & (y["id"] != F.col("x.id")))
        x = x.select("x", F.explode(open_).alias("y"))
        first = F.col("x.id") > F.col("y.id")
        side = lambda c, up: F.when(first, F.col(f"{'x' if up else 'y'}.{c}")).otherwise(F.col(f"{'y' if up else 'x'}.{c}"))
        met = x.select(side("id", True).alias("xid"), side("id", False).alias("yid"), side("n", True).alias("xn"), side("n", False).alias("yn")).groupBy("xid", "yid", "xn", "yn").agg(F.count("*").alias("c"))
        hx, hy = in_long.select(F.col("d").alias("xd"), F.col("h").alias("xh")), in_long.select(F.col("d").alias("yd"), F.col("h").alias("yh"))
        met = met.join(hx, F.col("xid") == F.col("xd"), "left").join(hy, F.col("yid") == F.col("yd"), "left")
        both = F.least(F.coalesce("xh", F.lit(0)), F.coalesce("yh", F.lit(0)))
        return met.where(F.col("c") + both >= F.least(self._need(F.col("xn")), self._need(F.col("yn")))).select(F.col("xid").alias("a"), F.col("yid").alias("b"))

    def prefix_entries(self, whole: DataFrame) -> DataFrame:
        """(tok, id, n) of the documents in ``whole`` (id, n, arr): prefixes of whole sets, rarest shingle first."""
        entry = whole.select("id", "n", F.explode("arr").alias("tok"))
        counts = entry.groupBy("tok").agg(F.count("*").alias("m")).withColumnRenamed("tok", "t")
        # n tells two texts of one id apart; two of one size only make the prefix of both too long
        ranked = entry.join(counts, F.col("tok") == F.col("t")).withColumn("pos", F.row_number().over(Window.partitionBy("id", "n").orderBy("m", "tok")) - 1)
        texts = whole.groupBy(F.col("id").alias("i"), F.col("n").alias("k")).agg(F.count("*").cast("int").alias("texts")).where("texts > 1")
        ranked = ranked.join(texts, (F.col("id") == F.col("i")) & (F.col("n") == F.col("k")), "left")
        longest = (F.col("n") - self._least(F.col("n"))) + F.coalesce(F.col("texts") - 1, F.lit(0)) * F.col("n")
        return ranked.where((F.col("pos") <= longest) & (F.col("m") > 1)).select("tok", "id", "n").distinct()

    def stars(self, entries: DataFrame) -> DataFrame:
        """(a, b): each entry with the LEADERS leaders of its list.

        Lists of the same documents tend to have the same leaders, so that few different pairs come out.
        """
        which = [F.min(F.struct(F.xxhash64("id", F.pmod("tok", F.lit(4)), F.lit(turn)).alias("w"), F.col("id").alias("yid"), F.col("n").alias("yn"))) for turn in range(LEADERS)]
        leaders = entries.groupBy(F.col("tok").alias("t")).agg(F.array(*which).alias("ls"))
        met = entries.join(leaders, F.col("tok") == F.col("t")).select("id", "n", F.explode(F.array_distinct("ls")).alias("l"))
        met = met.where((F.col("id") != F.col("l.yid")) & self._sizes(F.col("n"), F.col("l.yn")))
        return met.select(F.greatest("id", "l.yid").alias("a"), F.least("id", "l.yid").alias("b"))

    def across(self, entries: DataFrame, labels: DataFrame, whole: DataFrame) -> DataFrame:
        """(a, b): links between classes that still meet in a list.

        The documents of lists with the same leader form a group. It is cut by size, so that linked sets
        lie in the same or in neighbouring cuts, and each cut is dealt to blocks of at most about
        BLOCK_HASHES hashes and BLOCK_ROWS documents. A task gets two blocks and the leader. Every set is
        turned into its difference from the leader, and the intersection of two sets follows from their
        intersections with the leader and what their differences share, which are short. One link for
        each two classes of a task comes out.
        """
        num, den = self.num, self.den
        named = entries.join(labels.select(F.col("id").alias("i"), "component"), F.col("id") == F.col("i"), "left").select("tok", "id", "n", F.coalesce("component", "id").alias("c"))
        named = materialise(named, "named")
        first = F.struct(F.xxhash64("id").alias("w"), "id").alias("s")
        apart = named.groupBy("tok").agg(F.min(first).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        apart = apart.select(F.col("tok").alias("t"), F.col("s.id").alias("g"))
        cut = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int") if num < den else F.col("n")
        members = named.join(apart, F.col("tok") == F.col("t")).select("g", "id", "n", "c", cut.alias("s")).distinct()
        members = materialise(members, "members")
        # a group has few cuts, as many as its sizes have powers of 1 / t between them
        blocks = members.groupBy("g", "s").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_HASHES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("k"))
        blocks = blocks.groupBy(F.col("g").alias("gg")).agg(F.map_from_entries(F.collect_list(F.struct("s", "k"))).alias("ks"))
        dealt = members.join(blocks, F.col("g") == F.col("gg")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("ks")[F.col("s")]).cast("int"))
        at = lambda s, r, t, o, low: F.struct(s.alias("s"), r.cast("int").alias("r"), t.alias("t"), o.cast("int").alias("o"), F.lit(low).alias("low"))
        s, own = F.col("s"), F.col("own")
        numbers = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        level = F.transform(numbers(F.col("ks")[s]), lambda o: F.when(o >= own, at(s, own, s, o, True)).otherwise(at(s, o, s, own, False)))
        above = F.transform(numbers(F.col("ks")[s + 1]), lambda o: at(s, own, s + 1, o, True))
        below = F.transform(numbers(F.col("ks")[s - 1]), lambda o: at(s - 1, o, s, own, False))
        dealt = dealt.select("g", "id", "c", F.explode(F.concat(level, above, below)).alias("at")).select("g", "id", "c", "at.*", F.lit(False).alias("lead"))
        # a task's two blocks are there only where it has two classes
        tasks = dealt.groupBy("g", "s", "r", "t", "o").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").drop("c1", "c2")
        dealt = materialise(dealt, "dealt")
        tasks = materialise(tasks, "tasks")
        leads = tasks.select("g", F.col("g").alias("id"), F.col("g").alias("c"), "s", "r", "t", "o", F.lit(True).alias("low"), F.lit(True).alias("lead"))
        rows = dealt.join(tasks, ["g", "s", "r", "t", "o"], "left_semi").select(*leads.columns).unionByName(leads).withColumnRenamed("id", "m")
        rows = rows.join(whole, F.col("m") == F.col("id")).select("g", "s", "r", "t", "o", "id", "c", "low", "lead", "arr")

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("lead", "descending"), ("low", "descending"), ("id", "ascending")]).combine_chunks()
            arrays = _array(table.to_batches()[0], "arr")
            lead, arrays = arrays[0], arrays[1:]
            ids, label = table.column("id").to_numpy()[1:], table.column("c").to_numpy()[1:]
            low = table.column("low").to_numpy(zero_copy_only=False)[1:]
            size = np.array([len(x) for x in arrays])
            apart = [np.setxor1d(x, lead, assume_unique=True) for x in arrays]
            shared = (size + len(lead) - np.array([len(x) for x in apart])) // 2  # with the leader
            flat = np.concatenate(apart)
            _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
            keep = count[at] > 1
            column = np.cumsum(count > 1)[at] - 1
            row = np.repeat(np.arange(len(apart)), [len(x) for x in apart])
            # one block with itself, or the lower with the upper one
            up = int(low.sum())
            x, y = (slice(0, len(ids)), slice(0, len(ids))) if low.all() else (slice(0, up), slice(up, len(ids)))
            seen: set[tuple[int, int]] = set()
            out: list[tuple[int, int]] = []
            common = np.zeros((len(ids[x]), len(ids[y])), np.float32)
            width = int((count > 1).sum())
            for lo in range(0, width, CHUNK):  # a bounded number of columns at a time
                pick = keep & (column >= lo) & (column < lo + CHUNK)
                part = np.zeros((len(ids), min(CHUNK, width - lo)), np.float32)
                part[row[pick], column[pick] - lo] = 1
                common += part[x] @ part[y].T
            # |x & y| = |x & L| + |y & L| - |L| + |common differences|, as a hash in both differences
            # is either missing from both (and in L) or in both (and not in L)
            inter = shared[x][:, None] + shared[y][None, :] - len(lead) + common
            linked = (den * inter >= num * (size[x][:, None] + size[y][None, :] - inter)) & (label[x][:, None] != label[y][None, :])
            for i, j in zip(*np.nonzero(linked), strict=True):
                j = j + y.start
                key = (min(label[i], label[j]), max(label[i], label[j]))
                if key not in seen and ids[i] != ids[j]:
                    seen.add(key)
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
            return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

        return rows.groupBy("g", "s", "r", "t", "o").applyInArrow(run, "a bigint, b bigint")

    # -- verification -------------------------------------------------------------------------

    def check(self, pairs: DataFrame, arrays: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` that are linked. arrays: (id, n, arr).

        The array of b, of which a leader has many pairs, is joined first, so that the pairs are then dealt by a.
        """
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for i, (x, y) in enumerate(zip(_array(batch, "x"), _array(batch, "y"), strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if den * common >= num * (len(x) + len(y) - common):
                        keep.append(i)
                if keep:
                    pick = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick)], ["a", "b"])

        side = lambda name: arrays.select(F.col("id").alias(f"{name}_id"), F.col("n").alias(f"{name}_n"), F.col("arr").alias(name))
        met = pairs.join(side("y"), F.col("b") == F.col("y_id")).select("a", "b", "y", "y_n")
        met = met.join(side("x"), F.col("a") == F.col("x_id")).where(self._sizes(F.col("x_n"), F.col("y_n"))).select("a", "b", "x", "y")
        return met.mapInArrow(run, "a bigint, b bigint").distinct()

    # -- results ------------------------------------------------------------------------------

    def shared_ids(self, live: DataFrame, reps: DataFrame) -> DataFrame:
        """(a, b): links from a doc_id with several texts to what stands for each of them."""
        ids = live.groupBy(F.col("doc_id").alias("d")).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("d")
        ids = materialise(ids, "shared_ids")
        texts = live.join(ids, F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", F.col("fp").alias("f"))
        return texts.join(reps, F.col("fp") == F.col("f")).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))

    def classes(self, docs: DataFrame) -> DataFrame:
        """One row a document: doc_id, n_shingles, component_id."""
        sets = materialise(self.sets(docs), "sets")
        live = sets.where("n > 0 and doc_id is not null")
        # one row stands for each set; windows are joined with the sets that occur again, which are few
        best = F.min(F.struct("doc_id", "uid"))
        reps = materialise(live.groupBy("fp").agg(best.alias("best"), F.count("*").alias("copies")).select("fp", F.col("best.doc_id").alias("id"), F.col("best.uid").alias("row"), "copies"), "reps")
        again = reps.where("copies > 1").select(F.col("fp").alias("f"), "row")
        again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again.hint("merge")
        rows = live.join(again, F.col("fp") == F.col("f"), "left").where("row is null or row = uid").select(F.col("doc_id").alias("id"), "n", "win")
        entries = materialise(self.window_entries(rows), "entries")
        in_long = materialise(entries.where("long").groupBy(F.col("id").alias("d"), "n").agg(F.count("*").alias("h")), "in_long")
        pairs = materialise(self.short_pairs(entries, in_long), "pairs")
        crowded = in_long.where(F.col("h") >= self._need(self._least(F.col("n")))).select(F.col("d").alias("id"), F.lit(True).alias("crowd"))
        paired = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("crowd"))
        ids = materialise(crowded.unionByName(paired).groupBy("id").agg(F.bool_or("crowd").alias("crowd")), "ids")

        whole = materialise(self.whole_sets(docs, ids), "whole")
        prefixes = materialise(self.prefix_entries(whole.where("crowd")), "prefixes")
        tried = materialise(pairs.unionByName(self.stars(prefixes)).distinct(), "tried")
        links = materialise(self.check(tried, whole).unionByName(self.shared_ids(live, reps)), "links")
        labels = materialise(components(links), "labels")
        # what is linked across classes joins whole classes, so only their labels are worked on again
        crossed = materialise(self.across(prefixes, labels, whole), "crossed")
        labels = materialise(joined(labels, crossed), "joined")

        reps = reps.join(labels.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").where("copies > 1 or component is not null")
        reps = reps.select(F.col("fp").alias("f"), F.coalesce("component", "id").alias("component"))
        out = sets.select("doc_id", "fp", F.col("n").cast("bigint").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("fp")).alias("key"))
        out = out.join(reps, F.col("key") == F.col("f"), "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def keep_one(self, docs: DataFrame) -> DataFrame:
        """The documents that are the least doc_id of their component, with all their columns; of
        repeated rows of such a doc_id all stay."""
        gone = self.classes(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(fresh(docs, "id"))).distinct()
        gone = materialise(gone, "gone")
        key = column(docs, "doc_id", "bigint")
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key == F.col(gone.columns[0]), "left_anti")
