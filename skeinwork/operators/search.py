"""Full-text search: an inverted index, phrase and prefix terms, bm25.

The index holds (id, column, position, token). A query is an AND of phrases; the last word is a
prefix. Scores follow bm25 with k1 = 1.2 and b = 0.75 over all documents, and a filter on a project
comes after scoring. Only postings of the query's tokens are read for a score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialise

from ..functions.text import tokens

K1, B = 1.2, 0.75


def index(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(id, col, pos, token) of every token of ``columns``."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("t")) for c in columns]))
    return docs.select(F.col(key).alias("id"), each.alias("x")).select("id", "x.col", F.posexplode("x.t").alias("pos", "token"))


def lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("id").agg(F.count("*").alias("len"))


def parse(text: str) -> list[list[str]]:
    """Phrases of a query: each word's tokens, without the characters that have a meaning in queries."""
    cleaned = "".join(" " if c in '"*():^-' else c for c in text)
    import re

    return [p for p in ([t for t in re.split(r"[^a-z0-9]+", w.lower()) if t] for w in cleaned.split()) if p]


def occurrences(postings: DataFrame, phrase: list[str], prefix: bool) -> DataFrame:
    """(id, tf) of a phrase; its last token matches as a prefix if asked."""
    out = None
    for i, token in enumerate(phrase):
        hit = F.col("token").startswith(token) if prefix and i == len(phrase) - 1 else F.col("token") == token
        step = postings.where(hit).select("id", "col", (F.col("pos") - i).alias("at"))
        out = step if out is None else out.join(step, ["id", "col", "at"], "left_semi")
    return out.groupBy("id").agg(F.count("*").alias("tf"))


def bm25(postings: DataFrame, text: str, last_is_prefix: bool = True) -> DataFrame:
    """(id, score), lower is better; all phrases must occur."""
    phrases = parse(text)
    lens = lengths(postings)
    stats = lens.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    if not phrases:
        return lens.select("id", F.lit(0.0).alias("score")).limit(0)
    parts = []
    for i, p in enumerate(phrases):
        found = occurrences(postings, p, last_is_prefix and i == len(phrases) - 1)
        idf = found.agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select(F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"), "avg_len")
        scored = found.join(lens, "id").crossJoin(F.broadcast(idf))
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        parts.append(scored.select("id", weight.alias(f"w{i}")))
    both = reduce(lambda a, b: a.join(b, "id"), parts)
    return both.select("id", (-reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(len(phrases))])).alias("score"))


def search(docs: DataFrame, key: str, name: str, columns: list[str], text: str, limit: int = 50) -> DataFrame:
    """Best hits by bm25, then name; without any, names that contain the text as a pattern."""
    return search_index(index(docs, key, columns), docs, key, name, text, limit)


def synced(postings: DataFrame, touched: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A kept index after changes: ``touched`` holds (key, is_deleted) and the columns of all changed rows."""
    ids = touched.select(F.col(key).cast("string").alias("touched_id"))
    kept = postings.join(ids, F.col("id").cast("string") == F.col("touched_id"), "left_anti")
    return kept.unionByName(index(touched.where("not is_deleted"), key, columns))


def search_index(postings: DataFrame, docs: DataFrame, key: str, name: str, text: str, limit: int = 50) -> DataFrame:
    """``search`` over an index that is kept beside ``docs``; the hits, ``limit`` at most, are computed once."""
    scores = bm25(postings, text).withColumnRenamed("id", "scored_id")
    hits = docs.join(scores, F.col(key) == F.col("scored_id")).select(F.col(key).alias("hit_id"), F.col(name).alias("hit"), "score").orderBy("score", "hit", "hit_id").limit(limit)
    hits = materialise(hits, "hits")
    return hits if hits.take(1) else like(docs, key, name, text, limit)


def like(docs: DataFrame, key: str, name: str, text: str, limit: int = 50) -> DataFrame:
    """The fallback: % and _ in the text keep their meaning; shortest names first."""
    hits = docs.where(F.col(name).ilike(f"%{text}%")).select(F.col(key).alias("hit_id"), F.col(name).alias("hit"), F.lit(0.0).alias("score"))
    return hits.orderBy(F.length("hit"), "hit", "hit_id").limit(limit)
