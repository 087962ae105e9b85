"""Best-fit packing of token sequences with bound-certified repacking.

Documents become pieces of at most ``size`` tokens. Pieces are dealt to partitions, and each
partition packs its own by best-fit decreasing. Dual-feasible functions give a lower bound on the
bins that a partition's lengths need; a partition that meets its bound is certified. The others hand
over the pieces of their least filled bins, by four for each bin of their gap and one more, and the
handed-over pieces of all partitions are dealt anew to fewer partitions and packed again, until no
partition hands over any or one holds them all. A partition keeps at least half of its pieces, so the
levels grow with the logarithm of the input at most.

Defined results: null text is empty and has the one end token; a null doc_id is carried; repeated
rows give a piece each; an empty table gives no rows; a text of any length is cut into whole pieces
with the shorter piece first.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, whole_text

SIZE = 2048
END = 0
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces that one partition packs; its memory is a few arrays of that length.
PIECES = 20_000
# Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Characters that both tokenizer libraries class alike: ASCII text, Latin letters, usual punctuation.
_PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u024f\u2010-\u2027\u20ac]*")


def encoder(tokenizer_path: str, ranks_path: str | None = None):
    """A function from text to token ids.

    The ids are those of the ``tokenizers`` file, which reads its own special tokens' strings in a text as
    those tokens. Where ``ranks_path`` names the same vocabulary as byte ranks, texts of plain characters
    without such a string are encoded from that by a several times faster library with equal results; all
    other texts go through the file itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    plain = lambda text: _PLAIN.fullmatch(text) and not any(t in text for t in added)
    return lambda text: fast.encode_ordinary(text) if plain(text) else slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path, ranks_path)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), END], "<u4")
                n = len(ids)
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            doc, no, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), whole_text(docs).alias("text"))
    return rows.mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin number of each item, best fit in the given order (descending makes it best-fit decreasing).

    Bins are kept by room left: a sorted list of the rooms in use, and a stack of bins for each.
    """
    bins = np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    made = 0
    for i, n in enumerate(lengths.tolist()):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, room = made, size
            made += 1
        else:
            room = rooms[at]
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                del rooms[at], stacks[room]
        bins[i] = b
        if left := room - n:
            if left not in stacks:
                rooms.insert(bisect_left(rooms, left), left)
                stacks[left] = []
            stacks[left].append(b)
    return bins


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing needs: the best of some dual-feasible functions.

    The threshold function for e counts items over ``size - e`` as whole bins and drops those under ``e``;
    e is taken wherever one of the lengths changes sides, and 0 leaves all as they are. On each of them
    u_k is set, which rounds x (k + 1) down where that isn't whole, for k up to 20, as a function of a
    dual-feasible one is one, too. Sums are exact integers.
    """
    if not len(lengths):
        return 0
    x, counts = np.unique(lengths, return_counts=True)
    e = np.unique(np.concatenate(([0], x, size - x + 1)))
    e = e[e <= size // 2][:, None]
    cut = np.where(x > size - e, size, np.where(x < e, 0, x))  # a row for each e
    best = -(-int((cut @ counts).max()) // size)
    for k in range(1, 21):
        whole = (cut * (k + 1)) % size == 0
        value = np.where(whole, cut * k, (cut * (k + 1) // size) * size)  # in units of 1 / (k size)
        best = max(best, -(-int((value @ counts).max()) // (k * size)))
    return best


def _packed(items: DataFrame, groups: int, level: int, size: int, last: bool) -> DataFrame:
    """items with sequence_id, offset and open, packed in ``groups`` groups; the pieces that are open
    are handed over to the next level."""

    def run(table: pa.Table) -> pa.Table:
        # in a fixed order, so that a second attempt packs alike
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("uid", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths, size)
        load = np.bincount(bins, lengths).astype(np.int64)
        gap = len(load) - lower_bound(lengths, size)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], np.diff(bins[order]) != 0))
        offsets = np.empty(len(lengths), np.int64)
        offsets[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        handed = np.zeros(len(load), bool)
        if not last:
            # a certified group still gives up its least filled bin, so that rounding up isn't paid in each;
            # at most half of the pieces go on, so that levels shrink and end whatever the lengths
            worst = np.argsort(load, kind="stable")[: 4 * gap + 1]
            worst = worst[load[worst] < size]
            handed[worst[np.cumsum(np.bincount(bins)[worst]) <= len(lengths) // 2]] = True
        ids = (np.int64(level) << 56) + (np.int64(table.column("part")[0].as_py()) << 24) + bins
        out = table.drop_columns(["part"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))
        return out.append_column("open", pa.array(handed[bins]))

    part = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)).cast("int").alias("part")
    return items.select("*", part).groupBy("part").applyInArrow(run, f"{PIECE}, uid bigint, sequence_id bigint, offset bigint, open boolean")


def pack(items: DataFrame, size: int = SIZE, per_group: int = PIECES) -> DataFrame:
    """items with their sequence_id and offset.

    A group holds about ``per_group`` pieces whatever the input, and a level hands over half of its
    pieces at most, mostly far fewer; the last level is the one whose pieces fit one group.
    """
    items = items.withColumn("uid", F.monotonically_increasing_id())
    live, out, level = materialise(items, "pieces"), None, 0
    n = live.count()
    while True:
        groups = max(1, -(-n // per_group))
        done = materialise(_packed(live, groups, level, size, groups == 1), f"pack{level}")
        closed = done.where("not open")
        out = closed if out is None else out.unionByName(closed)
        if groups == 1:
            return out.drop("uid", "open")
        live, level = done.where("open").drop("sequence_id", "offset", "open"), level + 1
        n = live.count()
        if not n:
            return out.drop("uid", "open")
