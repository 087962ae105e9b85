"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents are all wanted ``target / source_size`` times: the whole part is taken as whole
copies, and the rest is a copy probability. Pairs of open probabilities trade word mass at random
until one of them is 0 or 1; the other goes on. A block of documents is folded like that in one
step, its one open document moves up to a block of the next level, and so on until a source has one
open document, which a last draw decides. Words move between documents but never appear or vanish,
so a source ends within one document of its target.

Defined results: null text has size 0; a null source is a source of its own, placed last; documents
of size 0 take 0; where all sizes are 0 all targets are 0; an empty table gives no rows; repeated
rows are rounded each by itself; a rerun gives the same rows, since every draw is a hash of the ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, column, fresh, materialise, whole_text

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 48
SEED = 20240607
#: Rows whose decision may be broadcast, one byte each.
BROADCAST_ROWS = 64 << 20
#: ``monotonically_increasing_id`` holds the row's place in its partition in this many bits.
PLACE_BITS = 33


def word_count(text: Column) -> Column:
    """Number of words: the white-space runs inside the trimmed text, plus one."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.array_remove(F.split(text, SPACE + "+"), ""))).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from one row a source.

    Filling by weight with a ceiling: sources in order of ceiling over weight; the first k are at
    their ceiling where k is the first count at which the next one stays below.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    named = named.withColumn("ceiling", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    filled = named.withColumns({
        "full": F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "wanted": F.lit(share) * F.sum("source_size").over(all_rows),
    })
    filled = filled.withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open_weight"))
    stops = F.col("level") * F.col("weight") <= F.col("ceiling")
    filled = filled.withColumn("rank", F.row_number().over(order))
    final = filled.withColumn("at", F.min(F.when(stops, F.struct("rank", "level"))).over(all_rows))
    target = F.coalesce(F.least(F.col("at.level") * F.col("weight"), F.col("ceiling")), F.col("ceiling"))
    return final.select("source", "source_size", "n", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on ``cols`` and the seed alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(level: int) -> Column:
    """Fold array ``xs`` of (key, row, mass, p): (done: rows with their outcome, open: the rest)."""
    item = "struct<key:bigint,row:struct<uid:bigint,doc_id:bigint,size:bigint,source:string,source_size:bigint,target:double,whole:int>,p:double>"
    done = "array<struct<row:struct<uid:bigint,doc_id:bigint,size:bigint,source:string,source_size:bigint,target:double,whole:int>,up:int>>"

    def trade(acc: Column, x: Column) -> Column:
        a = acc["open"]
        sa, sb = a["row"]["size"].cast("double"), x["row"]["size"].cast("double")
        pa, pb = a["p"], x["p"]
        up, down = F.least((1.0 - pa) * sa, pb * sb), F.least(pa * sa, (1.0 - pb) * sb)
        # two that are both whole already have nothing to trade; the first then keeps its value
        raise_a = (_uniform(a["key"], x["key"], F.lit(level)) * (up + down) < down) | ((up + down == 0) & (pa >= 0.5))
        # which one becomes whole, and as what
        a_whole = F.when(raise_a, (1.0 - pa) * sa <= pb * sb).otherwise(pa * sa <= (1.0 - pb) * sb)
        na = F.when(raise_a, pa + up / sa).otherwise(pa - down / sa)
        nb = F.when(raise_a, pb - up / sb).otherwise(pb + down / sb)
        a_up, b_up = F.when(raise_a, 1).otherwise(0), F.when(raise_a, 0).otherwise(1)
        out = F.when(a_whole, F.struct(a["row"].alias("row"), a_up.alias("up"))).otherwise(F.struct(x["row"].alias("row"), b_up.alias("up")))
        left = F.when(a_whole, F.struct(x["key"].alias("key"), x["row"].alias("row"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), nb)).alias("p"))).otherwise(
            F.struct(a["key"].alias("key"), a["row"].alias("row"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), na)).alias("p"))
        )
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), F.struct(x["key"].alias("key"), x["row"].alias("row"), x["p"].alias("p")).cast(item).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(out)).cast(done).alias("done"), left.cast(item).alias("open"))
        )

    return F.aggregate("xs", F.struct(F.array().cast(done).alias("done"), F.lit(None).cast(item).alias("open")), trade)


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with copy: 0, or a repeated row's number among its like.

    Numbers come from the rows' order in each partition and the partitions' counts, so that a row that is
    repeated any number of times isn't sorted in one task.
    """
    again = materialise(rows.groupBy("doc_id", "hash").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(F.col("doc_id").alias("d"), F.col("hash").alias("h")), "again")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("bigint"))
    like = rows.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left_semi").select("uid", "doc_id", "hash", F.shiftright("uid", PLACE_BITS).alias("part"))
    before = Window.partitionBy("doc_id", "hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = like.groupBy("doc_id", "hash", "part").agg(F.count("*").alias("c")).select(F.col("doc_id").alias("d"), F.col("hash").alias("h"), F.col("part").alias("p"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    placed = like.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "hash", "part").orderBy("uid")))
    placed = placed.join(counts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("part") == F.col("p"))).select(F.col("uid").alias("u"), (F.col("before") + F.col("at")).alias("copy"))
    return rows.join(placed, F.col("uid") == F.col("u"), "left").drop("u").withColumn("copy", F.coalesce("copy", F.lit(0).cast("bigint")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, uid: str | None = None) -> DataFrame:
    """uid, doc_id, size, source, source_size, target, copies and taken (copies * size) of every row; uid
    is the column of ``docs`` of that name, or a number of the row."""
    number = F.monotonically_increasing_id() if uid is None else F.col(uid)
    sized = materialise(
        docs.select(number.alias("uid"), column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "source", "string").alias("source"), word_count(whole_text(docs)).alias("size"), F.xxhash64(whole_text(docs)).alias("hash")), "sizes"
    )
    wanted = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most), "targets")
    named = wanted.select(F.col("source").alias("s"), "source_size", "target", "n")
    # one small row a source; Spark broadcasts it where its own size limit allows, and splits the hot source where it doesn't
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
    rows = rows.withColumn("p", F.col("rate") - F.col("whole"))
    settled = (F.col("size") == 0) | (F.col("p") <= 0)
    result = rows.where(settled).select("uid", "doc_id", "size", "source", "source_size", "target", F.when(F.col("size") == 0, 0).otherwise(F.col("whole")).alias("copies"))

    rows = _told_apart(rows)
    row = F.struct("uid", "doc_id", "size", "source", "source_size", "target", "whole").alias("row")
    most_rows = wanted.agg(F.max("n")).first()[0] or 0
    level, blocks = 0, max(1, math.ceil(most_rows / BLOCK))
    # a source's blocks follow its own number of rows, so that small sources aren't scattered
    own = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    live = rows.where(~settled).withColumn("key", F.xxhash64("doc_id", "hash", "copy", F.lit(SEED)))
    live = live.select("key", row, "p", F.pmod("key", own).alias("block"))
    while True:
        folded = (
            live.groupBy(F.col("row.source").alias("src"), "block")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("row.size").alias("big"), "key", "row", "p")), asc=False).alias("xs"))
            .select("block", _fold(level).alias("f"))
        )
        folded = materialise(folded, f"fold{level}")
        out = folded.select(F.explode("f.done").alias("d")).select("d.row.*", "d.up")
        result = result.unionByName(out.select("uid", "doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies")))
        live = folded.where("f.open is not null").select("f.open.key", "f.open.row", "f.open.p", F.expr(f"block div {BLOCK}").alias("block"))
        if blocks == 1:
            break
        level, blocks = level + 1, math.ceil(blocks / BLOCK)
    last = F.when(_uniform(F.col("key"), F.lit(-1)) < F.col("p"), 1).otherwise(0)
    result = result.unionByName(live.select("row.*", last.alias("up")).select("uid", "doc_id", "size", "source", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies")))
    return result.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all their columns.

    Rows are numbered once and written with their numbers. A partition's decisions are an array in
    order of its rows; these arrays are broadcast, so texts aren't shuffled, or joined by number where
    the rows are too many.
    """
    uid, times = fresh(docs, "uid"), fresh(docs, "copies")
    numbered = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, uid=uid, **how).select("uid", F.col("copies").cast("tinyint").alias("copies"))
    if numbered.count() <= broadcast_rows:
        part, all_of = fresh(docs, "part"), fresh(docs, "all")
        place = F.col("uid").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        runs = taken.groupBy(F.shiftright("uid", PLACE_BITS).alias(part)).agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), "copies")))["copies"].alias(all_of))
        at = F.col(uid).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
        told = numbered.join(F.broadcast(runs), F.shiftright(uid, PLACE_BITS) == F.col(part)).withColumn(times, F.get(all_of, at)).drop(part, all_of)
    else:
        told = numbered.join(taken.select(F.col("uid").alias(times + "_uid"), F.col("copies").alias(times)), F.col(uid) == F.col(times + "_uid")).drop(times + "_uid")
    told = told.where(F.col(times) > 0)
    return told.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).drop(uid, times)
