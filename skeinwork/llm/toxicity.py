"""Toxicity by weak supervision.

Many voters (fixed lexicons, words and word stems found in labelled rows, patterns) each say toxic, clean or
nothing about a text. A generative label model estimates them by expectation maximisation over the
training rows' votes: a voter's vote depends on the class and, where two voters are correlated within
the classes, on the vote of its parent in the maximum spanning tree of these correlations, so that
what repeats another voter adds little. The given label is one more voter with an accuracy of its own.
The posterior labels train a linear classifier over votes and hit rates, which scores every document.

Bound: at most ``TRAIN_ROWS`` labelled rows are fitted on, those of the least hash. Everything else
covers all rows, and all words with enough support are taken. Labels, lang, source and doc_id are no
inputs of a score.

Defined results: null text is empty and gets the score of a text without hits; repeated rows score
alike; a null doc_id is not held out; labels that are null are ignored; of rows that share a doc_id one text is
fitted on; without labelled rows of both
kinds the fixed lexicons alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, whole_text

TRAIN_ROWS = 20_000
#: Correlation from which on one voter depends on another, and votes that its own odds count for.
LEAST_CORRELATION, OWN_VOTES = 0.05, 8.0
#: Rows whose features are held at a time.
ROWS = 1024
LEAST_SUPPORT = 8
THRESHOLD = 0.3
HELD_OUT = (4, 2)

# Short lists of abusive words by kind and language.
LEXICONS = {
    "insult_en": "idiot moron imbecile loser clown dumb stupid fool jerk creep freak dumbass retard",
    "contempt_en": "worthless pathetic trash scum garbage vermin filth lowlife parasite subhuman",
    "disgust_en": "disgusting vile repulsive filthy sickening revolting",
    "threat_en": "kill shoot hurt destroy murder strangle",
    "profanity_en": "damn crap shit fuck fucking bitch bastard asshole bullshit",
    "insult_de": "idiot trottel dummkopf depp versager arschloch abschaum dreck",
    "insult_fr": "idiot imbécile crétin abruti ordure salaud connard débile",
    "insult_es": "idiota imbécil estúpido basura escoria patético asqueroso inútil",
}
_STRIP = ".,;:!?\"'()[]{}<>*_-+=~#/\\|&%$@^`0123456789\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u2039\u203a"
_EDGE = ".,;:!?\"'()[]{}*_-"
_LEET = str.maketrans("013457@$", "oieastas")
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are| r)\s+(?:such\s+|so\s+|all\s+)?(?:an?\s+)?\w+"),
    "masked": re.compile(r"\b[a-z]+[*#@]{2,}[a-z]*\b"),
    "shut_up": re.compile(r"\b(?:shut up|go away|get lost|nobody (?:likes|wants) you)\b"),
}


def held_out(doc_id: Column, by: tuple[int, int] = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by[0] == by[1], F.lit(False))


class Voters:
    """Votes and features of a text. ``found``: words ("w") and stems ("w-") that labelled rows give away."""

    def __init__(self, found: list[str]):
        self.lists = [frozenset(words.split()) for words in LEXICONS.values()] + [frozenset() if w.endswith("-") else frozenset([w]) for w in found]
        self.stems = {w[:-1]: len(LEXICONS) + i for i, w in enumerate(found) if w.endswith("-")}
        self.stem_lengths = sorted({*map(len, self.stems)})
        known = sorted(set().union(*self.lists))
        self.words = {w: [i for i, s in enumerate(self.lists) if w in s] for w in known}
        self.names = [*LEXICONS, *(f"word:{w}" for w in found), *PATTERNS, "shouting", "leet", "none_found", "found_share"]

    def votes(self, text: str) -> np.ndarray:
        """1 toxic, -1 clean, 0 nothing said, for each name."""
        low = text.lower()
        words = low.split()
        whole = set(words)
        forms = {w.strip(_STRIP) for w in whole}
        out = np.zeros(len(self.names), np.int8)
        hits = self.words.keys() & forms
        for w in hits:
            for i in self.words[w]:
                out[i] = 1
        for k in self.stem_lengths:
            for stem in self.stems.keys() & {f[:k] for f in forms}:
                out[self.stems[stem]] = 1
                hits.add(stem)
        at = len(self.lists)
        for i, p in enumerate(PATTERNS.values(), at):
            out[i] = 1 if p.search(low) else 0
        at += len(PATTERNS)
        out[at] = 1 if len(text) >= 40 and text.isupper() else 0
        odd = [f for f in whole if not f.isalpha() and any(c in "013457@$" for c in f) and any(c.isalpha() for c in f)]
        out[at + 1] = 1 if any(f.strip(_EDGE).translate(_LEET) in self.words for f in odd) else 0
        out[at + 2] = 0 if hits or out[at + 1] else -1
        out[at + 3] = 1 if len(hits) >= 2 else -1 if not hits else 0
        return out


def _features(votes: np.ndarray) -> np.ndarray:
    """Votes for and against, the number of voters for, and a constant."""
    v = votes.astype(np.float64)
    up = (v > 0).sum(1, keepdims=True)
    return np.hstack([v, np.log1p(up), np.ones((len(v), 1))])


def _blocks(n: int) -> list[slice]:
    return [slice(at, at + ROWS) for at in range(0, n, ROWS)]


def spanning_parents(m: int, strength: Callable[[int], np.ndarray]) -> np.ndarray:
    """Each voter's parent in the maximum spanning forest, -1 for roots. ``strength`` gives a voter's links
    (symmetric, 0 for no link and for the voter itself) and is asked once for each."""
    parent, best, done = np.full(m, -1), np.full(m, -1.0), np.zeros(m, bool)
    for _ in range(m):
        at = int(np.argmax(np.where(done, -2.0, best)))
        done[at] = True
        links = strength(at)
        closer = ~done & (links > best) & (links > 0)
        best[closer], parent[closer] = links[closer], at
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic for each row, parent of each voter).

    A voter's table says how often it gives each vote in each class after each vote of its parent;
    what its parent rarely said leans on the voter's own table.

    Votes stay single bytes and are read in blocks of rows. The two classes' weights of a row add up to 1, so
    correlations follow from sums over pairs of voters that are made once; besides the votes these 4 bytes
    a pair are all that grows.
    """
    n, m = votes.shape
    prior = min(max(float(labels.mean()), 1e-3), 0.5)
    post, sign = np.where(labels > 0, 0.8, 0.2), np.where(labels > 0, 1.0, -1.0)
    parent, rows = np.full(m, -1), np.arange(m)
    pairs = np.zeros((m, m), np.float32)  # whole numbers, at most the number of rows
    for at in _blocks(n):
        v = votes[at].astype(np.float32)
        pairs += v.T @ v
    for _ in range(rounds):
        right = np.clip(np.where(labels > 0, post, 1 - post).mean(), 0.6, 0.99)
        weight = np.stack([1 - post, post])  # class by row
        mass = weight.sum(1)
        said = np.zeros((3, 2, m))  # vote, class, voter
        for at in _blocks(n):
            for k, vote in enumerate((-1, 0, 1)):
                said[k] += weight[:, at] @ (votes[at] == vote)
        alone = (said + 0.05) / (mass[:, None] + 0.15)
        mean = (said[2] - said[0]) / np.maximum(mass, 1e-9)[:, None]
        sd = np.sqrt(np.maximum(np.diag(pairs) - mass @ mean**2, 0) / n) + 1e-6

        def strength(i: int) -> np.ndarray:
            out = np.abs((pairs[i] - (mass * mean[:, i]) @ mean) / n / (sd * sd[i]))  # noqa: B023
            out[i] = 0
            return np.where(out >= LEAST_CORRELATION, out, 0)

        parent = spanning_parents(m, strength)
        above = np.where(parent < 0, rows, parent)
        given = np.zeros((3, 3, 2, m))  # vote of the parent, own vote, class, voter
        for at in _blocks(n):
            v, up = votes[at], votes[at][:, above]
            for u in range(3):
                for k in range(3):
                    given[u, k] += weight[:, at] @ ((up == u - 1) & (v == k - 1))
        table = (given + OWN_VOTES * alone) / (given.sum(1, keepdims=True) + OWN_VOTES)
        odds = np.log(table[:, :, 1]) - np.log(table[:, :, 0])  # vote of the parent, own vote, voter
        odds[:, :, parent < 0] = (np.log(alone[:, 1]) - np.log(alone[:, 0]))[None][:, :, parent < 0]
        told = np.concatenate([odds[votes[at][:, above].astype(int) + 1, votes[at].astype(int) + 1, rows].sum(1) for at in _blocks(n)])
        score = np.log(prior / (1 - prior)) + told + sign * np.log(right / (1 - right))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        still = np.abs(new - post).max() < 1e-4
        post = new
        if still:
            break
    return post, parent


def linear_classifier(votes: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression of soft labels on the features of ``votes`` by Newton steps, in blocks of rows;
    the last weight is the constant's.

    A voter can't count against toxicity by speaking for it: columns that come out below zero are
    left out and the rest is fitted again.
    """
    size = votes.shape[1] + 2
    use = np.ones(size, bool)
    while True:
        w = np.zeros(use.sum())
        for _ in range(rounds):
            hess, grad = ridge * np.eye(len(w)), -ridge * w
            for at in _blocks(len(y)):
                z = _features(votes[at])[:, use]
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                hess += (z * (p * (1 - p))[:, None]).T @ z
                grad += z.T @ (y[at] - p)
            step = np.linalg.solve(hess, grad)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        out = np.zeros(size)
        out[use] = w
        against = (out < 0) & (np.arange(size) < size - 1)
        if not against.any():
            return out
        use &= ~against


def found_words(train: DataFrame) -> list[str]:
    """Words and stems ("stem-", the first 4 to 6 letters) that stand in toxic training texts and hardly
    in others.

    Support counts different texts by the least word hash, so copies of one text count once. A stem
    takes the place of the words that it begins; of nested stems the better supported one stays, the
    longer one on ties.
    """
    strip = F.btrim("w", F.lit(_STRIP))
    rows = train.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("ws"))
    # the hash of a text is a column before the words are spread, or it would be computed for each word
    rows = rows.select("toxic", "ws", F.array_min(F.transform("ws", lambda w: F.xxhash64(w))).alias("sketch"))
    rows = rows.select("toxic", "sketch", F.explode("ws").alias("w")).select("toxic", "sketch", strip.alias("w"))
    rows = materialise(rows.where("length(w) between 4 and 24"), "words")
    forms = F.array("w", *[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("-"))) for k in (4, 5, 6)])
    of = lambda some: some.select("toxic", "sketch", F.explode(forms).alias("w")).where("w is not null")
    # only what stands in enough toxic rows is looked for in the others
    seen = of(rows.where("toxic = 1")).groupBy("w").agg(F.count("*").alias("seen"), F.countDistinct("sketch").alias("up")).where(F.col("up") >= LEAST_SUPPORT)
    seen = materialise(seen, "seen")
    down = of(rows.where("toxic = 0")).groupBy(F.col("w").alias("d")).agg(F.count("*").alias("down"))
    both = seen.join(down, F.col("w") == F.col("d"), "left").select("w", "seen", "up", F.coalesce("down", F.lit(0)).alias("down"))
    best = both.where((F.col("seen") >= 9 * F.col("down")) & (F.col("up") >= 9 * F.col("down"))).orderBy(F.desc(F.col("up") - 20 * F.col("down")), F.desc(F.length("w")), "w")
    words, stems, begins = [], set(), set()
    for w in (r.w for r in best.collect()):
        plain = w.rstrip("-")
        # nothing is taken that a taken stem begins, and no stem that begins what is taken
        if any(plain[:k] in stems for k in range(1, len(plain) + 1)) or (w.endswith("-") and plain in begins):
            continue
        words.append(w)
        begins.update(plain[:k] for k in range(1, len(plain) + 1))
        if w.endswith("-"):
            stems.add(plain)
    return words


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """The voters and the classifier's weights, from the training rows only."""
    key = column(docs, "doc_id", "bigint")
    known = labels.select(column(labels, "doc_id", "bigint").alias("l"), column(labels, "toxic", "int").alias("toxic")).where("toxic in (0, 1)").groupBy("l").agg(F.max("toxic").alias("toxic"))
    picked = known.where(~held_out(F.col("l"))).orderBy(F.xxhash64("l"), "l").limit(TRAIN_ROWS)
    train = docs.select(key.alias("doc_id"), whole_text(docs).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l"))
    train = materialise(train.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism), "train")
    voters = Voters(found_words(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [voters.votes(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(votes, pa.binary())], ["doc_id", "toxic", "votes"])

    got = train.mapInArrow(run, "doc_id bigint, toxic int, votes binary").orderBy("doc_id", "votes").toArrow()
    y = got.column("toxic").to_numpy()
    votes = np.empty((len(y), len(voters.names)), np.int8)
    for i, row in enumerate(got.column("votes")):
        votes[i] = np.frombuffer(row.as_py(), np.int8)
    del got
    if not len(y) or y.min() == y.max():
        weights = np.zeros(len(voters.names) + 2)
        weights[: len(LEXICONS)], weights[-1] = 3.0, -3.0
        return voters, weights
    posterior, _ = label_model(votes, y)
    return voters, linear_classifier(votes, posterior)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    voters, weights = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.empty(batch.num_rows)
            for at in range(0, batch.num_rows, ROWS):
                votes = np.array([voters.votes(t.as_py()) for t in batch.column("text")[at : at + ROWS]], np.int8).reshape(-1, len(voters.names))
                p[at : at + ROWS] = 1 / (1 + np.exp(-np.clip(_features(votes) @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    key = column(docs, "doc_id", "bigint")
    rows = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
