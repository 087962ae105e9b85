"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one maps each normalised text's digest to one bit of a table and keeps the bits that two or more
rows hit: a row goes to the shuffle as its bit's number and a count, added up in each partition. The
kept bits are set in bitmaps of 4 KB, built inside partitions and OR-ed. Pass two probes the bitmaps: a
row whose bit is set is possibly repeated, and only such rows are shuffled by digest. All other rows
pass straight through.

The table has BITS_A_ROW or more bits a row, so its size follows the input, about two to four bytes a
row. It is broadcast while it has at most ``broadcast_bytes``; a larger input is shuffled by digest
whole, each row once.

Defined results: null text counts as empty; empty texts are equal to each other; a null doc_id
sorts after all others; of repeated rows (same doc_id and text) one stays; an empty table gives no
rows; further columns of the input pass through ``deduplicate`` and never clash with internal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, column, fresh, materialise, whole_text

BITS_A_ROW = 16
#: Bytes of bitmaps that may be broadcast: enough for 32 million rows or more.
BROADCAST_BYTES = 128 << 20
#: Fixed values of Spark's bitmap functions: bits and bytes of one bitmap.
BITMAP_BITS, BITMAP_BYTES = 15, 4096


def normalised(text: Column) -> Column:
    """The text without any white space character."""
    return F.translate(text, SPACE_CHARS, "")


def table_bits(rows: int) -> int:
    """Bits of the table: a power of two, at least BITS_A_ROW a row."""
    return 1 << max(16, (rows * BITS_A_ROW - 1).bit_length())


def _bit(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def repeated_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap): the bits that at least two rows of ``keys`` hit."""
    hit = keys.groupBy(_bit(key, bits).alias("bit")).agg(F.count("*").alias("n")).where("n >= 2")
    return hit.groupBy(F.shiftright("bit", BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))).alias("bitmap"))


def mark_possible(df: DataFrame, key: str, flag: str, filters: DataFrame | None, bits: int) -> DataFrame:
    """Add ``flag``: the row's bit is among the repeated ones. Without ``filters`` every row may be repeated."""
    if filters is None:
        return df.withColumn(flag, F.lit(True))
    bucket, bitmap = f"{flag}_bucket", f"{flag}_bitmap"
    side = filters.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
    at = _bit(key, bits)
    joined = df.join(F.broadcast(side), F.shiftright(at, BITMAP_BITS) == F.col(bucket), "left")
    byte = F.substring(bitmap, F.shiftright(at, 3).bitwiseAND(F.lit(BITMAP_BYTES - 1)).cast("int") + 1, F.lit(1))
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(8)]), at.bitwiseAND(F.lit(7)).cast("int"))
    test = F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(bit) != 0, F.lit(False))
    return joined.select(*[F.col(f"`{n}`") for n in df.columns], test.alias(flag))


def bloom(keys: DataFrame, key: str, broadcast_bytes: int) -> tuple[DataFrame | None, int]:
    """The bitmaps of repeated bits of ``keys`` (None where they would be too many) and the table's bits."""
    bits = table_bits(keys.count())
    if bits // 8 > broadcast_bytes:
        return None, bits
    return materialise(repeated_bits(keys, key, bits), "bits"), bits


def digests(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n_chars, text_sha256) of every row; uid tells repeated rows apart."""
    text = whole_text(docs)
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        column(docs, "doc_id", "bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_chars"),
        F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"),
    )


def membership(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(digests(docs), "digests")
    filters, bits = bloom(rows, "text_sha256", broadcast_bytes)
    marked = mark_possible(rows, "text_sha256", "possible", filters, bits)
    alone = marked.where("not possible").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.where("possible")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("uid").alias("d"))
    groups = materialise(maybe.groupBy(F.col("text_sha256").alias("sha")).agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    joined = maybe.join(groups, maybe.text_sha256 == groups.sha)
    found = joined.select("doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.d")).alias("kept"), "text_sha256")
    return alone.unionByName(found)


def deduplicate(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that are surely alone never shuffle; of the possibly repeated ones each task keeps its
    best row a digest before the shuffle, so a group of any size arrives as one row a task.
    """
    key, flag = fresh(docs, "sha"), fresh(docs, "possible")
    text = whole_text(docs)
    keyed = docs.withColumn(key, F.sha2(normalised(text).cast("binary"), 256))
    filters, bits = bloom(materialise(keyed.select(F.col(key).alias("sha")), "keys"), "sha", broadcast_bytes)
    names = [F.col(f"`{n}`") for n in docs.columns]
    marked = mark_possible(keyed, key, flag, filters, bits)
    doc_id = column(docs, "doc_id", "bigint")
    order = F.struct((-F.length(text)).alias("a"), doc_id.isNull().alias("b"), doc_id.alias("c"))
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(names)])
    best = marked.where(F.col(flag)).groupBy(key).agg(F.min_by(whole, order).alias("row"))
    back = best.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(docs.columns)])
    return marked.where(~F.col(flag)).select(*names).unionByName(back)
