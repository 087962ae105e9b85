"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of one character class (white space or not) with the number of
units that end by each run. A cut after k units is found by binary search in those numbers, and its
place inside the run by arithmetic: a run's units are all equally long. With ``unit="word"`` a unit is
a word with the white space before it, so a run of word characters ends one unit as long as itself and
white space ends none, but for white space that closes a text, which is a unit of its own. With
``unit="char"`` every code point is a unit. So memory follows the number of runs, not of units.

A document's draws come from its id alone: prefix and middle end after the smaller and the larger of
two draws of 0 to n units. Another draw says whether the document is transformed at all, and the last
one which form it takes: suffix first (``spm``) or prefix first (``psm``). A text that is empty or has
one of the marks in it stays plain, so ``restore`` is exact.

Defined results: null text is empty, so plain; a null doc_id draws as an empty one and is carried;
repeated rows come out alike, once each; an empty table gives no rows; a text of any length is one row,
never cut; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, whole_text

# The marks before prefix, suffix and middle, and the salt of the draws.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = 42
#: Percent of documents that are transformed, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
UNITS = ("word", "char")
FORMS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Runs:
    """Maximal class runs of a text: first code point of each, units that end by its end, length of its units."""

    starts: np.ndarray
    units: np.ndarray
    steps: np.ndarray
    n_chars: int

    @classmethod
    def of(cls, text: str, unit: str = "word") -> Runs:
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(points)
        if not n:
            return cls(*(np.zeros(0, np.int64),) * 3, 0)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        starts = np.concatenate(([0], np.flatnonzero(space[1:] != space[:-1]) + 1))
        sizes = np.diff(np.append(starts, n))
        if unit == "char":
            return cls(starts, np.cumsum(sizes), np.ones(len(sizes), np.int64), n)
        ends = ~space[starts]
        ends[-1] = True
        return cls(starts, np.cumsum(ends), sizes, n)

    @property
    def n_units(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, k: int) -> int:
        """Code points before the end of the k-th unit."""
        if k <= 0:
            return 0
        if k > self.n_units:
            raise ValueError(f"{k} of {self.n_units} units")
        run = int(np.searchsorted(self.units, k))
        before = int(self.units[run - 1]) if run else 0
        return int(self.starts[run]) + (k - before) * int(self.steps[run])


def draws(doc_id: int | None, salt: int = SALT) -> tuple[int, int, int, int]:
    """Four draws of 32 bits, from the document's id alone."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))  # type: ignore[return-value]


@dataclass(frozen=True)
class Middled:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform_text(text: str, doc_id: int | None, unit: str = "word", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: int = SALT) -> Middled:
    runs = Runs.of(text, unit)
    h1, h2, h3, h4 = draws(doc_id, salt)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Middled(runs.n_units, "plain", None, None, text)
    a, b = sorted((h1 % (runs.n_units + 1), h2 % (runs.n_units + 1)))
    a, b = runs.cut(a), runs.cut(b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return Middled(runs.n_units, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Middled(runs.n_units, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore_text(output: str, form: str) -> str:
    """The text that ``output`` of that form was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"no output of form {form}")
    a, _, rest = output[len(first) :].partition(second)
    b, _, middle = rest.partition(MIDDLE)
    return b + middle + a if form == "spm" else a + middle + b


def transform(docs: DataFrame, unit: str = "word", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, salt: int = SALT) -> DataFrame:
    """doc_id, units n, form, lengths of prefix and middle, and the output text of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [transform_text(text.as_py(), i, unit, rate, suffix_first, salt) for i, text in zip(ids, batch.column(1), strict=True)]
            longs = lambda name: pa.array([getattr(m, name) for m in made], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), longs("n"), pa.array([m.form for m in made], pa.string()), longs("prefix_chars"), longs("middle_chars"), pa.array([m.output for m in made], pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, FORMS)


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id and text of every row of ``outputs``, rebuilt from its columns output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore_text(output.as_py(), form.as_py()) for output, form in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return outputs.select("doc_id", "output", "form").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame) -> DataFrame:
    """What ``transform`` makes of every document, with digests of its output and of the text restored from it."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, back = [], []
            for output, form in zip(batch.column("output"), batch.column("form"), strict=True):
                text = output.as_py()
                made.append(sha(text))
                back.append(sha(restore_text(text, form.as_py())))
            kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(made, pa.string()), pa.array(back, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    return transform(docs).mapInArrow(run, FORMS.removesuffix("output string") + "output_sha256 string, restored_sha256 string")
