"""Runs that can be watched and stopped: what they write is committed at their end or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import GraphStore, Snapshot


class Run:
    """One run over a store. ``progress`` has the rows that each table got, once it is written; ``cancel``, from
    another thread, stops the run's jobs, and the store stays at its last version."""

    def __init__(self, store: GraphStore):
        self.store, self.tag, self._seen = store, f"run-{uuid.uuid4().hex}", {}
        self.cancelled = False

    def execute(self, change: Callable[[Snapshot], dict[str, DataFrame]]) -> int:
        """The version that the tables of ``change`` were committed as."""

        def watched(snapshot: Snapshot) -> dict[str, DataFrame]:
            out = {}
            for name, df in change(snapshot).items():
                self._seen[name] = Observation(f"{self.tag}-{name}-{uuid.uuid4().hex}")
                out[name] = df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"))
            return out

        context = self.store.spark.sparkContext  # a context's tags reach the jobs of writes, too
        context.addJobTag(self.tag)
        try:
            return self.store.update(watched)
        finally:
            context.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        self.store.spark.sparkContext.cancelJobsWithTag(self.tag)

    def progress(self) -> dict[str, int]:
        """Rows by table of what was written; for a run that has ended."""
        return {name: seen.get["rows"] for name, seen in self._seen.items()}
