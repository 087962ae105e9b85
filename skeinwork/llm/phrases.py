"""Phrase collocation mining with word-id suffix arrays.

Texts (A-Z as a-z) are cut into pieces at sentence marks and line ends, pieces into words. A task
collects documents into shards of about SHARD_TOKENS words, gives each (language, word) of a shard a
number, and builds the suffix array of the numbers by prefix doubling in numpy. Neighbours in it with
their common prefix of n words or more form an interval: one n-gram, as often as the interval is
long. Intervals of all shards are merged by key.

That takes two passes, so that what is shuffled stays small. Pass one counts words and pairs by a 64-bit
hash; hashes that reach ``least`` are kept as bits. Pass two builds suffix arrays again, over runs of
words whose pairs all have their bit (an n-gram can't occur more often than a pair in it), and emits
n-grams as text, which are merged and counted exactly. Hashes that meet in a bit only cost rows, never a
count, so results are exact at any size; the bits take 16 for each kept hash, MOST_BITS at most.

A phrase of 2 to ``most_words`` words with a = f(phrase) >= ``least`` is a candidate. Each cut into first
part and rest has score floor(1000000 a a / (l r)); its lowest-scoring cut counts, of equal ones the
earliest. A candidate goes if its words lie inside a longer candidate that occurs at least half as
often. Each language's best ``top`` stay, found by salted parts first, so that no task sorts a language.

Defined results: null text is empty; null lang is ``und``, as is the language of that name; ids play no
part, so repeated rows count each time; ties are ranked by a, then by the phrase's bytes; an empty table
gives no rows; a text of any length is one shard at most together with others; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, whole_text

LEAST, MOST_WORDS, TOP = 10, 3, 2000
#: Percent of a phrase's occurrences from which a longer one makes it superfluous.
INSIDE = 50
#: Words that a task collects for one suffix array: some ten arrays of that length.
SHARD_TOKENS = 1_000_000
#: Bits for each kept hash, and bits at most (64 MB).
BITS_A_HASH, MOST_BITS = 16, 1 << 29
#: Candidates of a language that one salted part ranks.
PART = 100_000
#: Fixed values of Spark's bitmap functions: bits of one bitmap.
BITMAP_BITS = 15
UNKNOWN = "und"

#: Sentence marks and line ends become a token of their own (a line feed between blanks), tabs blanks.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_END = 0


class Words(dict):
    """Number of each token of one language; 0 for a piece's end, -1 for no token."""

    def __init__(self, shard: Shard, lang: str):
        super().__init__({b"": -1, b"\n": _END})
        # its lists and not the shard: with a cycle a shard would stay until the collector's next full run
        self.words, self.langs, self.lang = shard.words, shard.langs, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return number


class Shard:
    """Token numbers of some documents; number 0 ends a piece."""

    def __init__(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.by_lang: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str, lang: str) -> None:
        words = self.by_lang.get(lang)
        if words is None:
            words = self.by_lang[lang] = Words(self, lang)
        tokens = text.encode().lower().translate(_MARKS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(np.append(ids[ids >= 0], np.int32(_END)))
        self.size += len(self.parts[-1])

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each (language, word)."""
        whole = (lang.encode() + b"\0" + word for lang, word in zip(self.langs, self.words, strict=True))
        return np.fromiter(map(xxhash.xxh64_intdigest, whole), np.uint64, len(self.words))


def suffix_array(ids: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """``starts`` ordered by the ``words`` or more tokens from each, by prefix doubling.

    A round joins the rank of the tokens from i with the rank of those as many places on, so that ranks
    tell twice as many tokens apart. Past the end stands 0.
    """
    rank, known = ids.astype(np.int32), 1
    while True:
        last = 2 * known >= words
        # the last round orders only ``starts``
        at = starts if last else np.arange(len(rank))
        key = rank[at].astype(np.int64)
        key *= int(rank.max(initial=0)) + 1
        inside = at < len(rank) - known
        key[inside] += rank[at[inside] + known]
        order = np.argsort(key)
        if last:
            return starts[order]
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)))
        known *= 2


def common_prefixes(ids: np.ndarray, order: np.ndarray, words: int) -> np.ndarray:
    """Tokens, ``words`` at most, that each suffix of ``order`` shares with the one before it."""
    padded = np.concatenate([ids, np.zeros(words, ids.dtype)])
    lcp, same = np.zeros(len(order), np.int8), np.ones(max(0, len(order) - 1), bool)
    for j in range(words):
        at = padded[order + j]
        same &= at[1:] == at[:-1]
        lcp[1:] += same
    return lcp


def intervals(ids: np.ndarray, room: np.ndarray, most: int, least: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, position of one occurrence, count) of every n-gram of ``least`` to ``most`` words.

    ``room`` says how many words an n-gram from each position may have.
    """
    starts = np.flatnonzero(room >= least)
    order = suffix_array(ids, starts, most)
    lcp = common_prefixes(ids, order, most)
    for n in range(least, most + 1):
        first = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(first, len(order)))
        at = order[first]
        fits = room[at] >= n
        yield n, at[fits], counts[fits]


def room_to(ends: np.ndarray) -> np.ndarray:
    """Distance from each position to the next place where ``ends`` is true, itself included."""
    places = np.where(ends, np.arange(len(ends)), len(ends))
    return np.minimum.accumulate(places[::-1])[::-1] - np.arange(len(ends))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of words from theirs."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return mixed ^ (mixed >> np.uint64(29))


def _shards(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard.add(text.as_py(), lang)
            if shard.size >= tokens:
                # handed over, so that it has gone before the next one grows
                full, shard = [shard], Shard()
                yield full.pop()
                pa.default_memory_pool().release_unused()
    if shard.size:
        yield shard


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(column(docs, "lang", "string"), F.lit(UNKNOWN)).alias("lang"), whole_text(docs).alias("text"))


def hash_counts(docs: DataFrame, tokens: int = SHARD_TOKENS) -> DataFrame:
    """(h, c): count by hash of every word and every pair of words, over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, tokens):
            own = [shard]
            del shard
            yield from counted(own.pop())

    def counted(shard: Shard) -> Iterator[pa.RecordBatch]:
        ids, words = shard.ids(), shard.hashes()
        for n, at, counts in intervals(ids, room_to(ids == _END), 2):
            h = words[ids[at]] if n == 1 else pair_hash(words[ids[at]], words[ids[at + 1]])
            for lo in range(0, len(at), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(counts[part].astype(np.int32))], ["h", "c"])

    return _rows(docs).mapInArrow(run, "h bigint, c int").groupBy("h").agg(F.sum("c").alias("c"))


def frequent_bits(counts: DataFrame, least: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits, as bytes, of the hashes that occur ``least`` times or more; at most ``most_bits`` in all."""
    kept = materialise(counts.where(F.col("c") >= least).select("h"), "frequent")
    size = 1 << max(BITMAP_BITS, min((kept.count() * BITS_A_HASH).bit_length(), most_bits.bit_length() - 1))
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    maps = kept.groupBy(F.shiftright(bit, BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))).alias("bits"))
    out = np.zeros((size >> BITMAP_BITS, 1 << (BITMAP_BITS - 3)), np.uint8)
    for batch in maps.toArrow().to_batches():
        for bucket, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[bucket] = np.frombuffer(bits.as_py(), np.uint8)
    return out.ravel()


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def gram_counts(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, tokens: int = SHARD_TOKENS, most_bits: int = MOST_BITS) -> DataFrame:
    """(lang, words, phrase, f): exact counts of the n-grams of 1 to ``most_words`` words that occur
    ``least`` times or more in a language, and in the row of 0 words the language's number of words."""
    bits = frequent_bits(hash_counts(docs, tokens), least, most_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for shard in _shards(batches, tokens):
            own = [shard]
            del shard
            yield from emitted_of(own.pop(), bits)

    def emitted_of(shard: Shard, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, hashes = shard.ids(), shard.hashes()
        end = ids == _END
        langs, words = pa.array(shard.langs, pa.string()).dictionary_encode(), pa.array([w.decode() for w in shard.words], pa.string())
        by_lang = np.bincount(langs.indices.to_numpy()[ids[~end]], minlength=len(langs.dictionary))
        for lang, n in zip(langs.dictionary.to_pylist(), by_lang.tolist(), strict=True):
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([n], pa.int64())], ["lang", "words", "phrase", "f"])
        # numbers are dense: each has its count and its first place without a sort
        counts, at = np.bincount(ids, minlength=len(hashes)), np.zeros(len(hashes), np.int64)
        at[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
        kept = _has(bits, hashes) & (counts > 0)
        kept[_END] = False
        found = [(1, at[kept], counts[kept])]
        # an n-gram ends where the pair that begins at its last word isn't frequent
        last = np.append(~_has(bits, pair_hash(hashes[ids[:-1]], hashes[ids[1:]])), True)
        room = room_to(last | end | np.append(end[1:], True)) + 1
        room[end] = 0
        for n, at, counts in chain(found, intervals(ids, room, most_words, 2)):
            take = [words.take(pa.array(ids[at + j])) for j in range(n)]
            phrase = take[0] if n == 1 else pc.binary_join_element_wise(*take, " ")
            lang = langs.dictionary.take(langs.indices.take(pa.array(ids[at])))
            for lo in range(0, len(at), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([lang[part], pa.array(np.full(len(at[part]), n, np.int32)), phrase[part], pa.array(counts[part].astype(np.int64))], ["lang", "words", "phrase", "f"])

    emitted = _rows(docs).mapInArrow(run, "lang string, words int, phrase string, f bigint")
    return emitted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _part(first: Column, n: Column, words: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside: int = INSIDE, tokens: int = SHARD_TOKENS, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of every language's ``top`` best phrases."""
    grams = materialise(gram_counts(docs, least, most_words, tokens, most_bits), "grams")
    totals = grams.where("words = 0").select("lang", F.col("f").alias("n"))
    return rank(scored(grams, most_words, inside), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def scored(grams: DataFrame, most_words: int = MOST_WORDS, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r and score of every candidate that no longer one makes superfluous."""
    counts = grams.where("words > 0").select("lang", "phrase", "f")
    ready = grams.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # the parts of every cut, looked up by key
    cuts = ready.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), _part(F.lit(1), k, F.col("w")).alias("first"), _part(k + 1, F.col("words") - k, F.col("w")).alias("rest")))).alias("cut"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    both = cuts.select("lang", "phrase", "a", F.col("cut.k").alias("k"), F.col("cut.first").alias("first"), F.col("cut.rest").alias("rest")).join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    both = both.withColumn("over", (whole("a", 15) * whole("a", 15) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("under", (whole("l", 18) * whole("r", 18)).cast("decimal(38,0)"))
    best = both.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase inside a candidate, with the count of the most frequent one around it
    if most_words > 2:
        around = reduce(lambda x, y: x.unionByName(y), [ready.where(F.col("words") == m).select("lang", F.explode(_inside(m)).alias("phrase"), F.col("a").alias("longer")) for m in range(3, most_words + 1)])
        around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    return best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def _inside(m: int) -> Column:
    """All phrases of 2 to m - 1 words in the m words of column ``w``."""
    return F.array(*[_part(F.lit(i), F.lit(n), F.col("w")) for n in range(2, m) for i in range(1, m - n + 2)])


def rank(found: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best of each language, numbered from 1."""
    found = materialise(found, "phrases")
    salts = max(1, -(-found.count() // PART))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if salts > 1:
        salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt")
        found = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "score")
