"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over common words are compared with
the reference of its language by Jensen-Shannon distance (base 2, 0 to 1). A reference is the mean
histogram over all documents of the language that pass the base rules, taken again over those of
them that lie near the first mean, so that junk doesn't shift it. Every language with LEAST_DOCS such
documents has one, whatever their number: the BROADCAST_LANGUAGES most frequent ones are broadcast, rows
of other languages meet theirs in a shuffle. A document of no stated language is held against its nearest
reference of all, one of a language without reference passes. Short documents carry too little evidence to be judged by a histogram: the word test applies from ``GUARD_WORDS`` words on, the
character test from ``GUARD_CHARS`` characters on.

Defined results: null text counts as empty, has no words and fails the base rules; repeated rows
are judged alike; an empty table gives no rows; a null doc_id or lang is carried; without any
reference (few clean documents) the method passes all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, column, materialise, whole_text

# Frequent function words of four languages, in order of language.
COMMON_WORDS = (
    "der die und das den von zu mit ist auf "
    "the of and to in is that for it was with be on as this by are from "
    "de la que el en los las por con para un una no se del y "
    "le les et des du une est dans pour au qui sur pas plus"
).split()
SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = ("lower", "upper", "digit", "symbol", "stop", "other_mark", "letter", "space")

MIN_WORDS = 50
GUARD_WORDS = 80
GUARD_CHARS = 300
#: Documents that make a reference.
LEAST_DOCS = 20
#: References (about 600 bytes each) that are broadcast.
BROADCAST_LANGUAGES = 4096
#: Documents within this distance of the first mean make the second.
TRIM = 0.15
MAX_CHAR_DISTANCE = 0.205
MAX_WORD_DISTANCE = 0.55


def _left(text: Column, drop: str) -> Column:
    return F.regexp_replace(text, drop, "")


def features(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """``keep`` plus word and line counts and the two histograms (as counts) of every document."""
    base = docs.select(*[c.alias(n) for n, c in keep.items()], whole_text(docs).alias("t"))
    base = base.select(*keep, "t", F.array_remove(F.split("t", SPACE + "+"), "").alias("w"), _left(F.col("t"), r"[a-z\x20\x09-\x0D]+").alias("r1"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"))
    # code of each common word is one character, so that counting a word is counting a character
    codes = F.create_map(*[x for i, w in enumerate(COMMON_WORDS) for x in (F.lit(w), F.lit(chr(0x21 + i)))])
    trimmed = lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))
    common = F.transform(F.filter(F.transform("w", trimmed), lambda x: x.isin(*COMMON_WORDS)), lambda x: codes[x])
    grams = F.transform("w", lambda w, i: F.struct(F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    base = base.select(
        *keep,
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length("t").cast("bigint").alias("n_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length("r1").alias("n1"),
        "r1",
        _left(F.col("r1"), r"[A-Z]+").alias("r2"),
        F.array_join(common, "").alias("codes"),
        F.sort_array(F.slice(grams, 1, F.greatest(F.size("w") - 2, F.lit(0)))).alias("g"),
    )
    again = lambda s, i: F.when(F.coalesce(F.get("g", i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get("g", i + 1)["h"] == s["h"], F.lit(False)), s["i"]).otherwise(F.lit(-1))
    base = base.withColumn("at", F.filter(F.transform("g", again), lambda x: x >= 0))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.array(x, x + 1, x + 2)))))
    base = base.withColumns({
        "r3": _left(F.col("r2"), r"[0-9]+"),
        "n_symbols": (F.length("r2") - F.length(F.translate("r2", SYMBOLS, ""))).cast("bigint"),
        "n_repeat_words": covered.cast("bigint"),
    })
    stops = F.length("r3") - F.length(F.translate("r3", ".,;:!?'\"()-", ""))
    letters = F.length(_left(F.col("r3"), r"[\x00-\x7F]+"))
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.length("r3") - F.col("n_symbols") - stops - letters
    chars = F.array(*[x.cast("double") for x in (F.col("n_chars") - space - F.col("n1"), F.col("n1") - F.length("r2"), F.length("r2") - F.length("r3"), F.col("n_symbols"), stops, rest, letters, space)])
    hits = F.array(*[(F.length("codes") - F.length(F.replace(F.col("codes"), F.lit(chr(0x21 + i))))).cast("double") for i in range(len(COMMON_WORDS))])
    out = base.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), F.concat(hits, F.array((F.col("n_words") - F.length("codes")).cast("double"))).alias("hits"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to 1."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2.0))


def _means(good: DataFrame) -> DataFrame:
    """(lang, n, c, h): mean histograms of each language with enough rows."""
    k, m = len(CHAR_CLASSES), len(COMMON_WORDS) + 1
    means = good.groupBy("lang").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("cs", F.lit(i))) for i in range(k)]).alias("c"), F.array(*[F.avg(F.get("hs", F.lit(i))) for i in range(m)]).alias("h"))
    return materialise(means.where(F.col("n") >= LEAST_DOCS), "means")


def _with_own(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with the reference of their language as own, null where there is none.

    Only rows of none of the BROADCAST_LANGUAGES most frequent languages are shuffled.
    """
    refs = refs.select(F.col("lang").alias("of"), "n", F.struct("c", "h").alias("own"))
    often = refs.orderBy(F.desc("n"), "of").limit(BROADCAST_LANGUAGES)
    out = rows.join(F.broadcast(often.drop("n")), F.col("lang") == F.col("of"), "left").drop("of")
    if refs.count() <= BROADCAST_LANGUAGES:
        return out
    far = F.col("own").isNull() & F.col("lang").isNotNull()
    rest = refs.join(F.broadcast(often.select("of")), "of", "left_anti").drop("n")
    return out.where(~far).unionByName(out.where(far).drop("own").join(rest.hint("merge"), F.col("lang") == F.col("of"), "left").drop("of"))


def references(shares: DataFrame) -> DataFrame:
    """(lang, n, c, h): the reference of every language with enough clean documents."""
    good = shares.where(~F.col("base_failed") & F.col("lang").isNotNull())
    first = _means(good)
    near = _with_own(good, first).where((js_distance(F.col("cs"), F.col("own.c")) <= TRIM) & (js_distance(F.col("hs"), F.col("own.h")) <= 2 * TRIM))
    again = _means(near)
    return materialise(again.unionByName(first.join(again, "lang", "left_anti")), "references")


def _distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with char_distance and word_distance from the reference of their language, without a language
    from the nearest of all references; null without any."""
    sides = (("char_distance", "cs", "c"), ("word_distance", "hs", "h"))
    from_own = {x: js_distance(F.col(of), F.col("own")[which]) for x, of, which in sides}
    unknown = F.col("lang").isNull()
    if refs.count() <= BROADCAST_LANGUAGES:
        out = _with_own(rows, refs).join(F.broadcast(refs.agg(F.collect_list(F.struct("c", "h")).alias("refs"))), unknown, "left")
        nearest = lambda of, which: F.array_min(F.transform("refs", lambda r: js_distance(F.col(of), r[which])))
        return out.withColumns({x: F.when(unknown, nearest(of, which)).otherwise(from_own[x]) for x, of, which in sides}).drop("own", "refs")
    pairs = rows.where(unknown).select("uid", "cs", "hs").crossJoin(refs.select(F.struct("c", "h").alias("r")))
    least = pairs.groupBy(F.col("uid").alias("u")).agg(*[F.min(js_distance(F.col(of), F.col("r")[which])).alias(x) for x, of, which in sides])
    known = _with_own(rows.where(~unknown), refs).withColumns(from_own).drop("own")
    return known.unionByName(rows.where(unknown).join(least, F.col("uid") == F.col("u"), "left").drop("u"))


def verdicts(feats: DataFrame) -> DataFrame:
    """Add char_distance, word_distance and kept; ``feats`` has a number of its own, uid, in each row."""
    n_chars = F.aggregate("chars", F.lit(0.0), lambda s, x: s + x)
    shares = feats.withColumns({"cs": _shares(F.col("chars"), F.greatest(n_chars, F.lit(1.0))), "hs": _shares(F.col("hits"), F.greatest("n_words", F.lit(1)))})
    judged = _distances(shares, references(shares)).withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("char_distance", "word_distance")}).withColumn("total_chars", n_chars)
    odd = ((F.col("total_chars") >= GUARD_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") >= GUARD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return judged.withColumn("kept", ~F.col("base_failed") & ~odd).drop("cs", "hs", "uid", "total_chars")


def _written(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    return materialise(features(docs, keep).withColumn("uid", F.monotonically_increasing_id()), "quality")


def assess(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base_failed, the two distances and kept."""
    keep = {"doc_id": column(docs, "doc_id", "bigint"), "lang": column(docs, "lang", "string")}
    return verdicts(_written(docs, keep))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Documents are written with their features, so that the verdict, once the references are known, is
    a filter on each row and nothing is shuffled up to BROADCAST_LANGUAGES references.
    """
    names = {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}
    carried = _written(docs, names | {"lang": column(docs, "lang", "string")})
    return verdicts(carried).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
