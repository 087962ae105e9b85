"""Changes of a project's files as a stream: scans go in, what has changed since the last one comes out.

A scan is all rows with one time. State is kept for each path: its hash, skip reason and size as last seen,
when that was, and whether it is gone. Paths are dealt to GROUPS groups by their hash, and a group's paths share
one state and one timer, so that a call has many paths to follow and not one. A path that the next scan doesn't
have is told when the watermark, the time of the newest scan, has passed its last sighting: with the batch after that of the
scan that missed it, and before anything else that this batch says of it. State outlives restarts in the
stream's checkpoint; scans must come in the order of their times, one a batch or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCAN = "path string, content_hash string, skip_reason string, size_bytes bigint, scanned_at timestamp"
CHANGE = "path string, kind string, scanned_at timestamp"
#: Fixed for a stream's life, as its state is kept by group.
GROUPS = 1 << 12
_STATE = "paths array<string>, hashes array<string>, reasons array<string>, sizes array<bigint>, seen array<bigint>, gone array<boolean>"
_OUT = "path string, kind string, at bigint"


def _none(value):
    return None if pd.isna(value) else value


def _differs(old: tuple, new: tuple) -> bool:
    """As the batch comparison has it: by hash, and where neither side has one by skip reason and size."""
    return old[1:] != new[1:] if old[0] is None and new[0] is None else old[0] != new[0]


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    watermark = state.getCurrentWatermarkMs()
    # by path: hash, skip reason, size, last sighting in microseconds, gone
    known = {p: tuple(rest) for p, *rest in zip(*state.get, strict=True)} if state.exists else {}
    out = []
    for path, (*seen, at, gone) in known.items():
        if not gone and at // 1000 + 1 < watermark:
            known[path] = (*seen, at, True)
            out.append((path, "deleted", watermark * 1000))
    if not state.hasTimedOut:
        rows = [row for f in frames for row in zip(*(f[c].tolist() for c in ("at", "path", "content_hash", "skip_reason", "size_bytes")), strict=True)]
        for at, path, content_hash, skip_reason, size in sorted(rows, key=lambda r: r[0]):
            now = (_none(content_hash), _none(skip_reason), None if pd.isna(size) else int(size))
            *before, _, gone = known.get(path, (None, None, None, 0, True))
            out.append((path, "added" if gone else "modified" if _differs(tuple(before), now) else "unchanged", at))
            known[path] = (*now, at, False)
    state.update((list(known), *map(list, zip(*known.values(), strict=True))))
    if timers := [at // 1000 + 1 for _, _, _, at, gone in known.values() if not gone]:
        state.setTimeoutTimestamp(max(min(timers), watermark))
    if out:
        yield pd.DataFrame(out, columns=["path", "kind", "at"])


def changes(scans: DataFrame) -> DataFrame:
    """(path, kind, scanned_at) of a stream of scans: added, modified, unchanged and deleted; of a deletion, the time
    of the newest scan when it was told. scans: path, content_hash, skip_reason, size_bytes, scanned_at."""
    rows = scans.select("path", "content_hash", "skip_reason", "size_bytes", F.col("scanned_at").cast("timestamp").alias("scanned_at")).withWatermark("scanned_at", "0 seconds")
    rows = rows.withColumns({"at": F.unix_micros("scanned_at"), "group": F.pmod(F.xxhash64("path"), F.lit(GROUPS))})
    told = rows.groupBy("group").applyInPandasWithState(_follow, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("path", "kind", F.timestamp_micros("at").alias("scanned_at"))
