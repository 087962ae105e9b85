"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find the seeds: e-mail addresses, network addresses, card and telephone numbers. The words
around a seed induce lexical patterns: one or two words before or after the place. Besides the seeds, tokens
with a digit or an @ are possible instances, and a graph of patterns and instances, counted over all texts,
is scored in ROUNDS rounds. A pattern's confidence for a kind is the share of all occurrences of its words,
whatever stands beside them, that have an instance of that kind, each weighted by its own confidence; it
needs LEAST_SUPPORT different instances. An instance gets its confidence from the patterns that it occurs
with, as the chance that not all of them err; one word counts only where no pair with it is a pattern. Instances that reach ACCEPT are identifiers, found in
every place where they stand, and induce patterns in the next round. All scores are whole millionths, so
results don't depend on the order of sums.

Positions come without Python: the text between matches and the matches themselves, in turn, are added
up. The patterns are written so that a scan is linear in the text: no start inside a run that failed, no group
that backtracks. Occurrences of pattern words are counted in a second pass, against the patterns of the
graph, which are broadcast up to BROADCAST_PATTERNS of them; beyond, words are counted first and joined.

Defined results: null text is empty and has no spans; a null doc_id is carried; repeated rows give a row
each, all of them with the same spans; an empty table gives no rows; a possible instance that touches a base
span, has under LEAST_CHARS letters or digits, or over MOST_CHARS characters, is none; of kinds that
score alike the first listed counts; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, whole_text

# The kinds, and what each looks like before its digits are tested.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Tokens with a digit or an @, and tokens of digits that follow after one blank.
POSSIBLE = r"""(?<![^\s,;"'<>|])[^\s,;"'<>|0-9@]*+[0-9@][^\s,;"'<>|]*+(?: [(+]?[0-9][^\s,;"'<>|]*+)*+"""
LEADING, TRAILING = "([{", ".:!?)]}"
WORDS = r"[^\p{L}]+"
#: Code points beside a place that are searched for its two words.
WINDOW = 100
ROUNDS, LEAST_SUPPORT = 3, 3
#: Millionths: a sure instance, the confidence from which a pattern counts, and that of an identifier.
SURE, LEAST_CONFIDENCE, ACCEPT = 1_000_000, 500_000, 700_000
LEAST_CHARS, MOST_CHARS = 6, 64
BROADCAST_PATTERNS = 500_000
ITEM = "struct<kind:string,i:int,gap:int,match:string,size:int,before:array<string>,after:array<string>>"


def _matches(text: Column, kind: str, regex: str) -> Column:
    """One struct a match of ``regex``: its number, the text's length before it since the last one, itself, and two words
    on either side."""
    def words(gap: Column, before: bool) -> Column:
        near = F.right(gap, F.lit(WINDOW)) if before else F.left(gap, F.lit(WINDOW))
        every = F.filter(F.split(F.lower(near), WORDS), lambda w: w != "")
        return F.slice(every, F.greatest(F.size(every) - 1, F.lit(1)), 2) if before else F.slice(every, 1, 2)

    def items(cut: Column) -> Column:
        def item(match: Column, i: Column) -> Column:
            gap, following = F.get(cut["gaps"], i), F.get(cut["gaps"], i + 1)
            return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), match.alias("match"), F.length(match).alias("size"), words(gap, True).alias("before"), words(following, False).alias("after"))

        return F.transform(cut["found"], item)

    # both arrays stand in one struct first: inside the lambda they would be made again for each match
    cut = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"))
    return F.flatten(F.transform(F.array(cut), items)).cast(f"array<{ITEM}>")


def _items(text: Column) -> Column:
    """All matches of the base patterns and all possible instances of a text."""
    none = F.array().cast(f"array<{ITEM}>")
    at, plus = F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    digit = text.rlike("[0-9]")
    return F.concat(
        F.when(at, _matches(text, "email", BASE["email"])).otherwise(none),
        F.when(digit, _matches(text, "ip", BASE["ip"])).otherwise(none),
        F.when(digit, _matches(text, "card", BASE["card"])).otherwise(none),
        F.when(digit & plus, _matches(text, "phone", BASE["phone"])).otherwise(none),
        F.when(digit | at, _matches(text, "possible", POSSIBLE)).otherwise(none),
    )


def _valid(kind: Column, match: Column) -> Column:
    """The match passes its kind's test."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    card = F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike("^" + r"\.".join([_OCTET] * 4) + "$"))
        .when(kind == "card", card)
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise((F.length(F.regexp_replace(match, r"[^\p{L}0-9]", "")) >= LEAST_CHARS) & (F.length(match) <= MOST_CHARS))
    )


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, n_items) of every document, and (uid, doc_id, kind, start, end, match, before, after, valid) of
    every base match and every possible instance that touches no valid base match."""
    text = whole_text(docs)
    found = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), column(docs, "doc_id", "bigint").alias("doc_id"), _items(text).alias("items")), "matches")
    rows = found.select("uid", "doc_id", F.explode("items").alias("x")).select("uid", "doc_id", "x.*").repartition("uid")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("uid", "kind").orderBy("i"))
    rows = rows.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("size"))
    own = F.col("kind") == "possible"
    # a possible instance without its outer brackets and full stops
    left = F.ltrim("match", F.lit(LEADING))
    rows = rows.withColumn("start", F.when(own, F.col("start") + F.col("size") - F.length(left)).otherwise(F.col("start"))).withColumn("match", F.when(own, F.rtrim(left, F.lit(TRAILING))).otherwise(F.col("match")))
    rows = rows.withColumn("end", F.col("start") + F.length("match")).withColumn("valid", _valid(F.col("kind"), F.col("match")))
    base = ~own & F.col("valid")
    # both ways from the beginning of an order: a frame to the end of one is gone through for each row
    order, before = [F.col("start"), F.col("end"), F.col("kind")], (Window.unboundedPreceding, -1)
    ended = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("uid").orderBy(*order).rowsBetween(*before))
    begun = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("uid").orderBy(*[c.desc() for c in order]).rowsBetween(*before))
    touches = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begun < F.col("end"), F.lit(False))
    rows = rows.withColumn("touches", touches).where(~own | (F.col("valid") & ~F.col("touches")))
    return found.select("uid", "doc_id", F.size("items").alias("n_items")), materialise(rows.select("uid", "doc_id", "kind", "start", "end", "match", "before", "after", "valid"), "spans")


def _instance() -> Column:
    return F.when(F.length("match") <= MOST_CHARS, F.col("match")).otherwise(F.sha2(F.col("match").cast("binary"), 256))


def edges(rows: DataFrame) -> DataFrame:
    """(instance, side, words, n, speaks): how often an instance occurs with a pattern, for all patterns that have
    LEAST_SUPPORT different instances. One word ``speaks`` for an instance only where it stands with it in a
    pair that is no such pattern: the nearer context counts, so "order number" isn't told by "number"."""
    last = F.get("before", F.size("before") - 1)
    places = F.array(
        F.struct(F.lit("before").alias("side"), last.alias("one"), F.when(F.size("before") == 2, F.array_join("before", " ")).alias("pair")),
        F.struct(F.lit("after").alias("side"), F.get("after", F.lit(0)).alias("one"), F.when(F.size("after") == 2, F.array_join("after", " ")).alias("pair")),
    )
    seen = rows.where("valid").select(_instance().alias("instance"), F.explode(places).alias("p")).select("instance", "p.*").where("one is not null")
    counted = materialise(seen.groupBy("instance", "side", "one", "pair").agg(F.count("*").alias("n")), "graph")
    wide = lambda by, instances: instances.groupBy("side", by).agg(F.count("*").alias("instances")).where(F.col("instances") >= LEAST_SUPPORT).select("side", by, F.lit(True).alias("wide"))
    marked = materialise(counted.join(wide("pair", counted.where("pair is not null")), ["side", "pair"], "left"), "marked")
    pairs = marked.where("wide").select("instance", "side", F.col("pair").alias("words"), "n", F.lit(True).alias("speaks"))
    ones = marked.groupBy("instance", "side", "one").agg(F.sum("n").alias("n"), F.max(F.col("wide").isNull()).alias("speaks"))
    ones = ones.join(wide("one", ones), ["side", "one"], "left_semi").select("instance", "side", F.col("one").alias("words"), "n", "speaks")
    return materialise(pairs.unionByName(ones), "edges")


def occurrences(docs: DataFrame, words: DataFrame, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """(words, total): how often each of ``words`` (single words and pairs) occurs in all texts."""
    every = docs.select(F.filter(F.split(F.lower(whole_text(docs)), WORDS), lambda w: w != "").alias("w"))
    pairs = every.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("x")).select("x.a", "x.b")
    keys = pairs.select(F.explode(F.array(F.col("a"), F.concat(F.col("a"), F.lit(" "), F.col("b")))).alias("words")).where("words is not null")
    words = materialise(words, "words")
    if words.count() <= broadcast_patterns:
        return keys.join(F.broadcast(words), "words").groupBy("words").agg(F.count("*").alias("total"))
    return keys.groupBy("words").agg(F.count("*").alias("total")).join(words, "words")


def discover(docs: DataFrame, rows: DataFrame, rounds: int = ROUNDS, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """(instance, kind) of the possible instances that the patterns tell to be identifiers."""
    graph = edges(rows)
    totals = occurrences(docs, graph.select("words").distinct(), broadcast_patterns)
    counts = graph.groupBy("side", "words").agg(F.sum("n").alias("n"))
    totals = materialise(counts.join(totals, "words", "left").select("side", "words", F.greatest(F.coalesce("total", F.lit(0)), "n").alias("total")), "totals")
    seeds = materialise(rows.where("valid and kind <> 'possible'").select(_instance().alias("instance"), "kind").distinct().withColumn("confidence", F.lit(SURE).cast("bigint")), "seeds")
    others = graph.where("speaks").join(seeds.select("instance").distinct(), "instance", "left_anti")
    known, order = seeds, F.array(*map(F.lit, KINDS))
    for turn in range(rounds):
        scored = graph.join(known, "instance").groupBy("side", "words", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("mass"), F.count("*").alias("support"))
        confidence = F.expr("mass div (total + 1)")
        patterns = scored.where(F.col("support") >= LEAST_SUPPORT).join(totals, ["side", "words"]).withColumn("c", confidence).where(F.col("c") >= LEAST_CONFIDENCE)
        doubt = F.floor(-F.log(1 - F.col("c") / SURE) * SURE).cast("bigint")
        met = others.join(patterns.select("side", "words", "kind", doubt.alias("doubt")), ["side", "words"]).groupBy("instance", "kind").agg(F.sum("doubt").alias("doubt"))
        found = met.withColumn("confidence", F.floor((1 - F.exp(-F.col("doubt") / SURE)) * SURE).cast("bigint")).where(F.col("confidence") >= ACCEPT).select("instance", "kind", "confidence")
        found = materialise(found, f"found{turn}")
        known = seeds.unionByName(found)
    best = found.groupBy("instance").agg(F.max(F.struct("confidence", (-F.array_position(order, F.col("kind"))).alias("first"), "kind")).alias("b"))
    return best.select("instance", F.col("b.kind").alias("found_kind"))


def extract(docs: DataFrame, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """doc_id, spans as structs of kind, start, end and whether a base pattern found it, and the base counts."""
    every, rows = spans(docs)
    found = discover(docs, rows, broadcast_patterns=broadcast_patterns)
    base = rows.where("valid and kind <> 'possible'").select("uid", "doc_id", "kind", "start", "end", F.lit(True).alias("base"))
    more = rows.where("kind = 'possible'").withColumn("instance", _instance()).join(found, "instance").select("uid", "doc_id", F.col("found_kind").alias("kind"), "start", "end", F.lit(False).alias("base"))
    order = F.array(*map(F.lit, KINDS))
    span = F.struct(F.array_position(order, F.col("kind")).alias("order"), "start", "end", "kind", "base")
    held = base.unionByName(more).groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("found"))
    out = every.join(held, "uid", "left")
    empty = F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")
    return out.select("doc_id", F.coalesce("found", empty).alias("spans"))


def report(docs: DataFrame, broadcast_patterns: int = BROADCAST_PATTERNS) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, and all spans as text."""
    found = extract(docs, broadcast_patterns)
    base = F.filter("spans", lambda s: s["base"])
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
