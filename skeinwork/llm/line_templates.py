"""Line deduplication by a tree of line templates, in DataFrame functions only.

A line's tokens that hold a digit become the variable field <*>. The tree has a fixed depth: token
count, then the first three tokens, then the last one; lines that agree on count and first tokens share
a leaf. Per leaf and position the most frequent token makes up the leaf's template; a line that agrees
with it in SIMILAR of its positions belongs to it, whatever stands in the others. Lines that are left
over are dealt by their last token to leaves below, which vote again; what is left then is a template by
itself. A line of under MIN_TOKENS tokens is a leaf by its own tokens, with its digits where nothing
else is left of it, so a short line recurs only as the same line.
A template that occurs in two or more documents recurs: all of its lines are dropped but the first
one (least doc_id, then line number), so that no content is lost altogether.

A recurring template is told by its least and greatest document, so a line with any number of copies
reaches the shuffle as one row a task.

Defined results: null text is empty; lines without a token are never dropped; a null
doc_id sorts after all others; a document is a doc_id with a text, so repeated rows keep the same lines
and rows that share only the doc_id, or have none, are documents of their own; a document that loses
all lines has an empty text; columns named n_lines or n_dropped are replaced, all others pass through;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column, fresh, materialise, whole_text

DEPTH = 3
MIN_TOKENS = 4
SIMILAR = 0.7
FIELD = "<*>"
#: Leaves (8 bytes each) that may be broadcast.
BROADCAST_LEAVES = 1 << 20


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, line_no, line, leaf, variant) of all lines; d and the text's hash h order documents, line has its
    tokens masked and parted by one space, leaf is 0 for lines without a token.

    Lines stay strings, as all that is asked of most of them is their number of tokens, their first ones and
    a hash. Only lines with a digit or unusual white space go through the patterns that mask and split. leaf
    is never null and nothing is filtered here, so that no expression is pushed down and evaluated twice.
    """
    doc = F.coalesce(column(docs, "doc_id", "bigint"), F.lit((1 << 63) - 1))
    rows = docs.select(doc.alias("d"), F.xxhash64(whole_text(docs)).alias("h"), F.posexplode(F.split(whole_text(docs), "\n")).alias("line_no", "line"))
    # one pass tells lines that need a pattern at all from the many that don't
    rows = rows.select("*", F.col("line").rlike(r"[0-9\x09\x0B-\x0D]").alias("odd"))
    spaced = F.col("odd") | F.col("line").contains("  ") | F.col("line").startswith(" ") | F.col("line").endswith(" ")
    rows = rows.select("d", "h", "line_no", "odd", F.when(spaced, F.trim(F.regexp_replace("line", SPACE + "+", " "))).otherwise(F.col("line")).alias("raw"))
    masked = F.regexp_replace("raw", r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*", FIELD)
    rows = rows.select("d", "h", "line_no", "raw", F.when(F.col("odd"), masked).otherwise(F.col("raw")).alias("line"))
    bare = F.col("line").isin(*[" ".join([FIELD] * n) for n in range(1, MIN_TOKENS)])
    rows = rows.select("d", "h", "line_no", F.when(bare, F.col("raw")).otherwise(F.col("line")).alias("line"))
    leaf = F.xxhash64(F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "))), F.substring_index("line", " ", DEPTH))
    return rows.select("d", "h", "line_no", "line", F.when(F.col("line") != "", leaf).otherwise(F.lit(0).cast("bigint")).alias("leaf"), F.xxhash64("line").alias("variant"))


def _voted(tokens: DataFrame) -> DataFrame:
    """(l, base): by leaf the most frequent token of each position after the first DEPTH, the greater token on
    ties. The first DEPTH tokens are the leaf's own. Distinct variants vote with their numbers of lines."""
    spread = tokens.select("leaf", "w", F.posexplode(F.slice("toks", F.lit(DEPTH + 1), F.size("toks"))).alias("pos", "tok"))
    counted = spread.groupBy("leaf", "pos", "tok").agg(F.sum("w").alias("w"))
    best = counted.groupBy("leaf", "pos").agg(F.max(F.struct("w", "tok")).alias("m"))
    return best.groupBy(F.col("leaf").alias("l")).agg(F.sort_array(F.collect_list(F.struct("pos", "m.tok"))).alias("x")).select("l", F.col("x.tok").alias("base"))


def _general(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (leaf, variant, toks, w) that belong to their leaf's template."""
    base = materialise(_voted(tokens), "base")
    rest = F.slice("toks", F.lit(DEPTH + 1), F.size("toks"))
    same = F.aggregate(F.zip_with(rest, "base", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(DEPTH), lambda s, x: s + x)
    return tokens.join(base, F.col("leaf") == F.col("l")).where(same >= F.ceil(F.size("toks") * F.lit(SIMILAR) - 1e-9))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(d, h, line_no) of every line to drop; rows with the same d and text repeat theirs.

    Least and greatest d and h are found by themselves, as numbers: documents differ where one of the two
    does. The first line of a template is then sought among the lines of its least d alone.
    """
    ends = lambda lo, hi, hlo, hhi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(hlo).alias("hlo"), F.max(hhi).alias("hhi"))
    lines = materialise(_lines(docs), "lines", "zstd").where("leaf <> 0")
    variants = materialise(lines.groupBy("leaf", "variant").agg(F.count("*").alias("w"), *ends("d", "d", "h", "h")), "variants")
    forks = variants.groupBy("leaf").agg(F.count("*").alias("n"), *ends("lo", "hi", "hlo", "hhi")).where("n > 1 and (lo <> hi or hlo <> hhi)").select(F.col("leaf").alias("f"))
    forks = materialise(forks, "forks")
    side = F.broadcast(forks) if forks.count() <= BROADCAST_LEAVES else forks
    again = lines.select("leaf", "variant", "line").join(side, F.col("leaf") == F.col("f"), "left_semi")
    tokens = again.groupBy("leaf", "variant").agg(F.first("line").alias("line"), F.count("*").alias("w"))
    tokens = materialise(tokens.select("leaf", "variant", F.split("line", " ").alias("toks"), "w"), "tokens")
    level1 = materialise(_general(tokens).select("leaf", "variant"), "level1").withColumnsRenamed({"leaf": "l", "variant": "v"})
    rest = tokens.join(level1, (F.col("leaf") == F.col("l")) & (F.col("variant") == F.col("v")), "left_anti")
    rest = rest.select(F.col("leaf").alias("trunk"), F.xxhash64("leaf", F.element_at("toks", -1)).alias("leaf"), "variant", "toks", "w")
    level2 = _general(materialise(rest, "rest")).select(F.col("trunk").alias("l"), F.col("variant").alias("v"), F.col("leaf").alias("own"))
    general = materialise(level1.withColumn("own", F.lit(0).cast("bigint")).unionByName(level2), "general")
    named = variants.join(general, (F.col("leaf") == F.col("l")) & (F.col("variant") == F.col("v")), "left")
    named = materialise(named.select("leaf", "variant", "w", "lo", "hi", "hlo", "hhi", F.coalesce("own", "variant").alias("own")), "named")
    recurring = named.groupBy(F.col("leaf").alias("l"), F.col("own").alias("o")).agg(*ends("lo", "hi", "hlo", "hhi")).where("lo <> hi or hlo <> hhi")
    recurring = materialise(recurring.select("l", "o", F.col("lo").alias("start")), "recurring")
    gone = named.join(recurring, (F.col("leaf") == F.col("l")) & (F.col("own") == F.col("o"))).select(F.col("leaf").alias("l"), F.col("variant").alias("v"), "own", "start")
    gone = materialise(gone, "gone")
    met = lines.select("d", "h", "line_no", "leaf", "variant").join(gone.hint("shuffle_hash"), (F.col("leaf") == F.col("l")) & (F.col("variant") == F.col("v")))
    met = materialise(met.select("d", "h", "line_no", "leaf", "own", "start"), "met")
    early = met.where("d = start")
    first = early.groupBy(F.col("leaf").alias("l"), F.col("own").alias("o")).agg(F.min(F.struct("h", "line_no")).alias("first"))
    late = early.join(first, (F.col("leaf") == F.col("l")) & (F.col("own") == F.col("o"))).where(F.struct("h", "line_no") != F.col("first"))
    return met.where("d <> start").select("d", "h", "line_no").unionByName(late.select("d", "h", "line_no"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the dropped lines, and with n_lines and n_dropped.

    The lost line numbers of a document are one array, no longer than the document; they meet its
    text in a shuffled join at any size, as they grow with the documents.
    """
    d, h, lost, parts = fresh(docs, "d"), fresh(docs, "h"), fresh(docs, "lost"), fresh(docs, "parts")
    gone = dropped_lines(docs).groupBy("d", "h").agg(F.collect_set("line_no").alias(lost)).withColumnsRenamed({"d": d, "h": h})
    doc = F.coalesce(column(docs, "doc_id", "bigint"), F.lit((1 << 63) - 1))
    out = docs.join(gone.hint("shuffle_hash"), (doc == F.col(d)) & (F.xxhash64(whole_text(docs)) == F.col(h)), "left")
    # as (line number, line) pairs without the lost numbers: set operations on hashes, linear in the document
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
    whole = out.withColumn(parts, F.split(whole_text(docs), "\n"))
    kept = F.transform(keep, lambda i: F.get(parts, i))
    text = F.when(F.col(lost).isNull(), whole_text(docs)).otherwise(F.array_join(kept, "\n"))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return whole.select(*names, text.alias("text"), F.size(parts).cast("bigint").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("bigint").alias("n_dropped"))
