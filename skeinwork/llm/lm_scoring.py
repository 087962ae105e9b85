"""Language-model scores of documents: a log-bilinear neural model trained in numpy by
noise-contrastive estimation, over exact corpus counts.

Tokens are words (A-Z as a-z) and one end a document. Counts of all training tokens are exact and
live in a table by 64-bit word hash. The neural model predicts classes: each of the most frequent
words is a class (2 sqrt(V) words of V distinct ones, at least LEAST_OWN), the end is one, and all
other words fall into surface classes by their last letters, one for about OWN_A_SURFACE own words;
inside such a class a word has probability (c + 1) / (sum of c + 1 over the class's training words,
plus 1 for all unknown ones). The class distribution given the two classes before, whose features make
h = C1 r1 + C2 r2, is a softmax of two levels: of n classes the sqrt(n) most frequent stand on the first
level beside blocks of sqrt(n) classes each, softmax(q . h + b) goes over these and, where a block comes,
once more over its classes. So a token's log-probability is normalised exactly from about 3 sqrt(n)
scores, which batches of tokens get by matrix products; the first level's normalisers come from tables by class.

Texts are split twice, for the counts and for class numbers, which are written once and read by
training and scoring. Training goes over all training documents in ROUNDS rounds. A document's hash
says its round and its part; parts hold about PART_TOKENS tokens, so they grow in number, not in size.
In a round every part trains from the common parameters by noise-contrastive estimation with noise
drawn from class frequencies, and the next round starts from the average of the parts, added up in
whole numbers. So the model depends on the documents only, not on how they are partitioned.

At most about ``HEAD`` of the most frequent words are sent to tasks (16 bytes each); all rarer words are
looked up by a join.

Defined results: null text is empty and has the one end token; a null doc_id is not held out; repeated
rows score alike up to the rounding of single precision; without training documents every count is 0 and the model is the base model over
the end and the unknown words; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialise, whole_text

HELD_OUT = (7, 2)
HEAD = 1 << 17
#: Own words at least, own words for a surface class, and buckets of last letters.
LEAST_OWN, OWN_A_SURFACE, LETTERS = 512, 13, 4096
DIM = 20
NOISE = 48
BATCH = 1024
#: Numbers of a table of the first level's normalisers at most.
MOST_CELLS = 1 << 24
#: Tokens that are scored together.
SCORED = 1 << 15
RATE = 0.05
ROUNDS = 2
#: Training tokens of a part, and tokens that a part of a small corpus goes over at least.
PART_TOKENS, LEAST_TOKENS, MOST_PASSES = 3_000_000, 400_000, 8
#: Parameters are added up as multiples of this.
GRAIN = 1 << 24
#: Words whose place a task remembers, about.
CACHE_WORDS = 200_000
#: Distinct words that a counting task holds before it hands them on.
COUNT_WORDS = 400_000


def held_out(doc_id: Column, by: tuple[int, int] = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by[0] == by[1], F.lit(False))


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def surfaces(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), np.int64, len(words)) % LETTERS


def _rows(docs: DataFrame) -> DataFrame:
    key = column(docs, "doc_id", "bigint")
    return docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), whole_text(docs).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, g, c): hash, bucket of last letters and count of every word of the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            rows = [pa.array(hashes(words).view(np.int64)), pa.array(surfaces(words), pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, ["h", "g", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(text.as_py().lower().split())
                if len(held) >= COUNT_WORDS:
                    yield out()
        if held:
            yield out()

    rows = _rows(docs).where("not held_out").select("text").mapInArrow(run, "h bigint, g int, c bigint")
    return rows.groupBy("h").agg(F.min("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head words and the corpus totals; classes are own words, then surface classes, then the end."""

    hashes: np.ndarray  # of head words, most frequent first
    counts: np.ndarray
    own: int
    surface: int
    classes: np.ndarray  # class of each head word, then of each surface class
    class_words: np.ndarray  # sum of c + 1 by surface class, plus 1
    class_counts: np.ndarray  # training tokens of each class
    tokens: int
    types: int
    ends: int

    @property
    def size(self) -> int:
        return self.own + self.surface + 1

    @property
    def kind(self) -> str:
        """The type that class numbers are written in."""
        return "<u2" if self.size < 1 << 16 else "<u4"


class Places:
    """Numbers words as they come, and knows of each number its hash and its place: the head index of
    the word, or the number of head words plus its surface class."""

    def __init__(self, hashes: np.ndarray, n_surface: int):
        head = hashes.view(np.uint64)
        self.n_surface, self.order = n_surface, np.argsort(head)
        self.head = head[self.order]
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.hashes, self.places = np.empty(0, np.uint64), np.empty(0, np.int32)

    def look_up(self) -> None:
        """Finds hashes and places of the words that were numbered since the last call."""
        words = list(itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.hashes)))[::-1]
        h = hashes(words)
        if len(self.head):
            near = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
            at, rare = self.order[near].astype(np.int32), np.flatnonzero(self.head[near] != h)
        else:
            at, rare = np.empty(len(words), np.int32), np.arange(len(words))
        at[rare] = len(self.head) + surfaces([words[i] for i in rare.tolist()]) % self.n_surface
        self.hashes, self.places = np.concatenate([self.hashes, h]), np.concatenate([self.places, at])


def own_words(types: int) -> int:
    return max(LEAST_OWN, 2 * math.isqrt(types))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Totals of ``counts``; about HEAD rows and one row for each bucket of letters reach the driver.

    The head is cut at a step of a logarithmic scale of counts, so that no task sorts all words; of the
    step that doesn't fit whole, words of small hash are taken.
    """
    step = F.floor(F.log2("c") * 16).cast("int")
    cut, share, room = -1, 0.0, HEAD
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        if r.n > room:
            cut, share = r.s, room / r.n
            break
        room -= r.n
    top = counts.where((step > cut) | ((step == cut) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))).toArrow()
    h, g, c = (top.column(x).to_numpy() for x in ("h", "g", "c"))
    order = np.lexsort((h, -c))
    h, g, c = h[order], g[order], c[order]
    sums = {r.g: (r.n, r.c) for r in counts.groupBy("g").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    all_types, all_tokens = sum(n for n, _ in sums.values()), sum(t for _, t in sums.values())
    own = min(own_words(all_types), len(h))
    n_surface = max(1, own_words(all_types) // OWN_A_SURFACE)
    types, tokens = np.zeros(n_surface, np.int64), np.zeros(n_surface, np.int64)
    for k, (n, t) in sums.items():
        types[k % n_surface] += n
        tokens[k % n_surface] += t
    g = g % n_surface
    np.subtract.at(types, g[:own], 1)
    np.subtract.at(tokens, g[:own], c[:own])
    classes = np.concatenate([np.arange(own), own + g[own:], own + np.arange(n_surface)]).astype(np.int32)
    class_counts = np.concatenate([c[:own], tokens, [ends]]).astype(np.float64)
    return Vocabulary(h, c, own, n_surface, classes, (types + tokens + 1).astype(np.float64), class_counts, all_tokens + ends, all_types + (ends > 0), ends)


# -- the model --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Levels:
    """The two levels of the classes: some that stand alone, then blocks of ``width`` classes."""

    size: int

    @property
    def width(self) -> int:
        return math.isqrt(self.size)

    @property
    def single(self) -> int:
        return self.width

    @property
    def tops(self) -> int:
        """Places of the first level; the places of the classes inside blocks follow."""
        return self.single - (self.single - self.size) // self.width

    def top(self, classes: np.ndarray) -> np.ndarray:
        return np.where(classes < self.single, classes, self.single + (classes - self.single) // self.width)

    def shares(self, class_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of the first level's places, and of the classes inside blocks among each other."""
        p = class_counts + 1
        low = p[self.single :]
        first = np.bincount(self.top(np.arange(self.size)), p, self.tops)
        return first / first.sum(), low / low.sum()


def _log_sums(s: np.ndarray) -> np.ndarray:
    """Log of the row sums of exp(s); only rows whose sum leaves the range are shifted by their greatest score."""
    with np.errstate(over="ignore", divide="ignore"):
        z = np.exp(s) @ np.ones(s.shape[1], np.float32)
        out = np.log(z)
    for i in np.flatnonzero(~((z > 1e-30) & (z < 1e30))):
        m = s[i].max()
        out[i] = m + np.log(np.exp(s[i] - m).sum())
    return out


def _by_place(places: np.ndarray, size: int) -> np.ndarray:
    """An order of ``places`` (below ``size``), equal ones as they come; of two bytes each it is found without comparisons."""
    return np.argsort(places.astype(np.uint16 if size <= 1 << 16 else np.int32), kind="stable")


def _sums(rows: np.ndarray, size: int, grads: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` (below ``size``) and the sum of each one's ``grads``.

    Numbers are added by twos, as complex ones; ``cells`` numbers those of every row of the sums.
    """
    at = np.flatnonzero(np.bincount(rows, minlength=size))
    place = np.empty(size, np.int64)
    place[at] = np.arange(len(at))
    out = np.zeros((len(at), grads.shape[1]), np.float32)
    np.add.at(out.view(np.complex64).ravel(), cells.take(place.take(rows), axis=0).ravel(), grads.view(np.complex64).ravel())
    return at, out


@dataclass
class LogBilinear:
    r: np.ndarray  # contexts: a row for each class, the last for the start
    q: np.ndarray  # targets: the first level's places, then the classes inside blocks
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, class_counts: np.ndarray, seed: int = 7) -> LogBilinear:
        rng, n = np.random.default_rng(seed), len(class_counts)
        p = np.concatenate(Levels(n).shares(class_counts))
        small = lambda rows: rng.normal(0, 0.1, (rows, DIM)).astype(np.float32)
        return cls(small(n + 1), small(len(p)), np.eye(DIM, dtype=np.float32), np.eye(DIM, dtype=np.float32) * np.float32(0.5), np.log(p).astype(np.float32))

    @property
    def levels(self) -> Levels:
        return Levels(len(self.r) - 1)

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c1, self.c2, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def first_sums(self, hidden: np.ndarray) -> np.ndarray:
        """Log of the first level's normaliser for each row of ``hidden``."""
        to, out = self.levels, np.empty(len(hidden), np.float32)
        q = np.ascontiguousarray(self.q[: to.tops].T)
        for lo in range(0, len(hidden), BATCH):
            s = hidden[lo : lo + BATCH] @ q
            s += self.b[: to.tops]
            out[lo : lo + BATCH] = _log_sums(s)
        return out

    def log_probabilities(self, hidden: np.ndarray, target: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each target class given its row of ``hidden``; ``sums``: ``first_sums``, if known."""
        to, top = self.levels, self.levels.top(target)
        out = np.einsum("ij,ij->i", hidden, self.q.take(top, axis=0)) + self.b.take(top)
        out -= self.first_sums(hidden) if sums is None else sums
        order = _by_place(top, to.tops)
        cuts = np.searchsorted(top[order], np.arange(to.single, to.tops + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows, lo = order[cuts[k] : cuts[k + 1]], to.tops + k * to.width
            s = hidden.take(rows, axis=0) @ self.q[lo : lo + to.width].T + self.b[lo : lo + to.width]
            out[rows] += s[np.arange(len(rows)), target[rows] - to.single - k * to.width] - _log_sums(s)
        return out


class Contexts:
    """Hidden numbers and first-level normalisers of pairs of classes.

    A score is a sum of what the two classes give, so its exp is a product: with the exps of both, by
    class and place, a normaliser is one product of two rows. Rows are divided by their greatest
    number; pairs whose product leaves the range, and all pairs where a table would have over
    MOST_CELLS numbers, get their scores one by one.
    """

    def __init__(self, model: LogBilinear):
        self.model, tops = model, model.levels.tops
        self.parts = [model.r @ model.c1, model.r @ model.c2]
        self.tables, self.greatest = [], []
        if len(model.r) * tops <= MOST_CELLS:
            for x, b in zip(self.parts, (model.b[:tops], np.float32(0)), strict=True):
                s = x @ model.q[:tops].T + b
                self.greatest.append(s.max(1))
                s -= self.greatest[-1][:, None]
                self.tables.append(np.exp(s, out=s))

    def of(self, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden numbers, first level's log-normalisers)"""
        hidden = self.parts[0].take(near, axis=0)
        hidden += self.parts[1].take(far, axis=0)
        if not self.tables:
            return hidden, self.model.first_sums(hidden)
        z = np.empty(len(near), np.float32)
        for lo in range(0, len(near), BATCH // 4):
            at = slice(lo, lo + BATCH // 4)
            np.einsum("ij,ij->i", self.tables[0].take(near[at], axis=0), self.tables[1].take(far[at], axis=0), out=z[at])
        with np.errstate(divide="ignore"):
            sums = np.log(z)
        sums += self.greatest[0].take(near)
        sums += self.greatest[1].take(far)
        lost = np.flatnonzero(~(z > 1e-28))
        sums[lost] = self.model.first_sums(hidden[lost])
        return hidden, sums


class Trainer:
    """Noise-contrastive estimation with adaptive steps; noise is shared by a batch.

    Each level has its own noise. Inside blocks the classes are told from noise over all blocks, so
    that their scores hold within each of them. A row of ``q`` ends with its b and a zero, and one of
    hidden numbers with 1 and 0, so that b needs no steps of its own and a row is made of pairs.
    """

    def __init__(self, model: LogBilinear, class_counts: np.ndarray, seed: int):
        self.to = model.levels
        shares = self.to.shares(class_counts)
        self.noise_log = np.log(NOISE * np.concatenate(shares)).astype(np.float32)
        self.cum = [np.cumsum(p) for p in shares]
        self.rng = np.random.default_rng(seed)
        self.r, self.c = model.r.copy(), np.concatenate([model.c1, model.c2])
        self.q = np.concatenate([model.q, model.b[:, None], np.zeros_like(model.b)[:, None]], axis=1)
        self.second = {x: np.full(getattr(self, x).shape, 1e-6, np.float32) for x in "rqc"}
        self.cells = {x: np.empty((0, 0), np.int64) for x in "rq"}

    @property
    def m(self) -> LogBilinear:
        return LogBilinear(self.r, self.q[:, :DIM], self.c[:DIM], self.c[DIM:], self.q[:, DIM])

    def _contrast(self, level: int, hidden: np.ndarray, target: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of hidden, noise) for one level; the gradients of the targets' rows of q, then the noise's, go into ``grads``."""
        cum, n = self.cum[level], len(target)
        noise = np.minimum(np.searchsorted(cum, self.rng.random(NOISE)), len(cum) - 1) + level * self.to.tops
        qt, qn = self.q.take(target, axis=0), self.q.take(noise, axis=0)
        shifted = -qn
        shifted[:, DIM] += self.noise_log[noise]
        with np.errstate(over="ignore"):
            up = np.exp(np.einsum("ij,ij->i", hidden, qt) - self.noise_log.take(target))
            down = hidden @ shifted.T
            np.exp(down, out=down)
        up = np.reciprocal(up + 1)[:, None]
        down += 1
        np.divide(np.float32(-1), down, out=down)
        np.multiply(hidden, up, out=grads[:n])
        np.matmul(down.T, hidden, out=grads[n:])
        qt *= up
        qt += down @ qn
        return qt, noise

    def _move(self, part: str, rows: np.ndarray, grads: np.ndarray) -> None:
        """One step of the rows that have gradients; rows may repeat."""
        x, second = getattr(self, part), self.second[part]
        if len(self.cells[part]) < len(rows):
            self.cells[part] = np.arange(len(rows) * x.shape[1] // 2).reshape(len(rows), -1)
        at, g = _sums(rows, len(x), grads, self.cells[part])
        s = second.take(at, axis=0)
        s += g * g
        second[at] = s
        g *= RATE
        g /= np.sqrt(s, out=s)
        g += x.take(at, axis=0)
        x[at] = g

    def step(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> None:
        to, n = self.to, len(target)
        inside = target >= to.single
        # tokens of classes inside blocks come last, so that those are one slice
        order, singles = np.concatenate([np.flatnonzero(~inside), np.flatnonzero(inside)]), n - np.count_nonzero(inside)
        rows, target = np.stack([near.take(order), far.take(order)], axis=1).ravel(), target.take(order)
        x = self.r.take(rows, axis=0).reshape(n, 2 * DIM)
        hidden = np.zeros((n, DIM + 2), np.float32)
        hidden[:, DIM] = 1
        np.matmul(x, self.c, out=hidden[:, :DIM])
        first = n + NOISE
        dq = np.empty((first + (n - singles + NOISE if singles < n else 0), DIM + 2), np.float32)
        top = to.top(target)
        dh, noise = self._contrast(0, hidden, top, dq[:first])
        places = [top, noise]
        if singles < n:
            low = target[singles:] - to.single + to.tops
            dh_low, noise = self._contrast(1, hidden[singles:], low, dq[first:])
            dh[singles:] += dh_low
            places += [low, noise]
        dh = dh[:, :DIM] * np.float32(1 / n)
        dx, dc = dh @ self.c.T, x.T @ dh
        self.second["c"] += dc * dc
        self.c += RATE * dc / np.sqrt(self.second["c"])
        self._move("r", rows, dx.reshape(2 * n, DIM))
        dq *= np.float32(1 / n)
        self._move("q", np.concatenate(places), dq)


def _sequence(ids: bytes, kind: str, first: int, end: int) -> np.ndarray:
    """Two starts, the document's classes, and the end."""
    at = np.frombuffer(ids, kind)
    seq = np.empty(len(at) + 3, np.int32)
    seq[:2], seq[2:-1], seq[-1] = first, at, end
    return seq


def train(placed: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """What the parts learn in all rounds from the training documents of ``placed``.

    Equal rows are counted, then dealt one by one, so that they don't all fall into one part.
    """
    end, first, kind = vocab.size - 1, vocab.size, vocab.kind
    model, parts = LogBilinear.start(vocab.class_counts), max(1, -(-vocab.tokens // PART_TOKENS))
    rows = placed.where("not held_out").select("doc_id", "ids", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(ROUNDS)).alias("turn"))

    def learner(start: LogBilinear):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
            seqs = [_sequence(x, kind, first, end) for x in table.column("ids").to_pylist()]
            tokens = np.stack([np.concatenate([s[i : len(s) - 2 + i] for s in seqs]) for i in range(3)], axis=1)
            trainer, n = Trainer(start, vocab.class_counts, 11), len(tokens)
            for _ in range(min(MOST_PASSES, max(1, LEAST_TOKENS // n))):
                order = trainer.rng.permutation(n)
                for at in range(0, n, BATCH):
                    trainer.step(*tokens.take(order[at : at + BATCH], axis=0).T)
            flat = np.rint(trainer.m.flat().astype(np.float64) * GRAIN).astype(np.int64) * n
            return pa.table({"i": pa.array(np.arange(-1, len(flat), dtype=np.int32)), "v": pa.array(np.concatenate([[n], flat]))})

        return run

    for turn in range(ROUNDS):
        alike = rows.where(F.col("turn") == turn).groupBy("doc_id", "ids").agg(F.count("*").alias("n"))
        each = alike.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
        dealt = each.select(F.pmod(F.xxhash64("doc_id", "ids", "copy"), F.lit(parts)).alias("part"), "doc_id", "ids")
        learned = dealt.groupBy("part").applyInArrow(learner(model), "i int, v bigint")
        # place -1 holds the tokens, by which every part's parameters are weighted
        total = learned.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).cast("double").alias("v")).toArrow()
        if len(total):
            v = total.column("v").to_numpy()[np.argsort(total.column("i").to_numpy())]
            model = model.filled(v[1:] / v[0] / GRAIN)
    return model


# -- scores -----------------------------------------------------------------------------------

PLACED = "doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, share double, h array<bigint>, c array<int>, ids binary"


def place(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every document's class numbers, the sums of what the head tells of its words, and its rare words."""
    head = len(vocab.hashes)
    base_all = math.log10(vocab.tokens + vocab.types + 1)
    own = np.arange(head) < vocab.own
    in_class = np.where(own, 0.0, np.log10(vocab.counts + 1.0) - np.log10(vocab.class_words[np.where(own, 0, vocab.classes[:head] - vocab.own)]))
    #: by place: log10(c + 1) as far as known here, and the log10 share inside the class as far as known here
    base_part = np.concatenate([np.log10(vocab.counts + 1.0), np.zeros(vocab.surface)])
    class_part = np.concatenate([in_class, -np.log10(vocab.class_words)])
    end_base = math.log10(vocab.ends + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Places(vocab.hashes, vocab.surface)

        def found(held: list[np.ndarray]) -> list[list]:
            """The seven columns of some documents, given the numbers of their words."""
            words.look_up()
            sizes = [len(x) for x in held]
            number, row = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
            at = words.places.take(number)
            base, share = (np.bincount(row, x.take(at), len(held)) for x in (base_part, class_part))
            rare = np.flatnonzero(at >= head)
            pairs, c = np.unique(row.take(rare) * len(words.hashes) + number.take(rare), return_counts=True)
            h, row = words.hashes.take(pairs % len(words.hashes)).view(np.int64), pairs // len(words.hashes)
            cuts, ends = np.searchsorted(row, np.arange(len(held) + 1)), np.cumsum(sizes)
            known = np.array(sizes) - np.bincount(row, c, len(held)).astype(np.int64) + (vocab.ends > 0)
            n, ids = np.array(sizes) + 1, vocab.classes.take(at).astype(vocab.kind)
            per = [(h[i:j], c[i:j].astype(np.int32)) for i, j in itertools.pairwise(cuts.tolist())]
            if len(words.numbers) >= CACHE_WORDS:
                words.clear()
            return [n.tolist(), known.tolist(), (base + end_base - n * base_all).tolist(), share.tolist(), *map(list, zip(*per, strict=True)), [ids[j - k : j].tobytes() for j, k in zip(ends.tolist(), sizes, strict=True)]]

        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            held, size = [], 0

            def flush() -> None:
                for col, x in zip(cols, found(held), strict=True):  # noqa: B023
                    col.extend(x)

            for text in batch.column("text"):
                split = text.as_py().lower().split()
                held.append(np.fromiter(map(words.numbers.__getitem__, split), np.int64, len(split)))
                size += len(split)
                if size >= SCORED:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in cols[4]]))).astype(np.int32))
            flat = lambda k, kind: pa.array(np.concatenate(cols[k]) if cols[k] else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.ListArray.from_arrays(offsets, flat(4, np.int64)), pa.ListArray.from_arrays(offsets, flat(5, np.int32)), pa.array(cols[6], pa.binary())],
                ["doc_id", "held_out", "n_tokens", "known", "base", "share", "h", "c", "ids"],
            )

    return _rows(docs).mapInArrow(run, PLACED).withColumn("uid", F.monotonically_increasing_id())


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    counts = materialise(word_counts(docs), "counts")
    ends = _rows(docs).where("not held_out").count()
    vocab = vocabulary(counts, ends)
    placed = materialise(place(docs, vocab), "placed")
    model = train(placed, vocab)
    end, first, kind = vocab.size - 1, vocab.size, vocab.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts(model)
        for batch in batches:
            lm, held, size = np.zeros(batch.num_rows), [], 0

            def flush() -> None:
                row = np.repeat([k for k, _ in held], [len(s) - 2 for _, s in held])
                far, near, target = (np.concatenate([s[i : len(s) - 2 + i] for _, s in held]) for i in range(3))
                for lo in range(0, len(row), SCORED):
                    at = slice(lo, lo + SCORED)
                    hidden, sums = contexts.of(near[at], far[at])
                    got = model.log_probabilities(hidden, target[at], sums)
                    lm[:] += np.bincount(row[at], got, len(lm))  # noqa: B023

            for k, ids in enumerate(batch.column("ids")):
                held.append((k, _sequence(ids.as_py(), kind, first, end)))
                size += len(held[-1][1])
                if size >= SCORED:
                    flush()
                    held, size = [], 0
            if held:
                flush()
            lm = lm / math.log(10) + batch.column("share").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("uid", "doc_id", "held_out", "n_tokens", "known", "base")), pa.array(lm, pa.float64())], ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "lm"])

    found = placed.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "share", "ids").mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, lm double")
    rare = placed.select("uid", F.explode(F.arrays_zip("h", "c")).alias("x")).select("uid", "x.h", F.col("x.c").alias("n"))
    known = rare.join(counts.select(F.col("h").alias("k"), F.col("c").alias("count")), F.col("h") == F.col("k"))
    more = known.groupBy(F.col("uid").alias("u")).agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("count") + 1.0)).alias("more"))
    out = found.join(more, F.col("uid") == F.col("u"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("lm") + more).alias("score")
    )
