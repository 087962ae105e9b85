"""What refers to what among a project's tables, and deletions that follow from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialise


@dataclass(frozen=True)
class Reference:
    """``table.column`` names a row of ``parent``; when that goes, the row goes too or forgets it."""

    table: str
    column: str
    parent: str
    forgets: bool = False


_OWNED = "runs files file_versions entities relationships evidence messages annotations solutions".split()
REFERENCES = (
    *(Reference(t, "project_id", "projects") for t in _OWNED),
    Reference("file_versions", "file_id", "files"),
    Reference("file_versions", "run_id", "runs", forgets=True),
    Reference("entities", "source_file_id", "files", forgets=True),
    Reference("relationships", "source_id", "entities"),
    Reference("relationships", "target_id", "entities"),
    Reference("relationships", "file_id", "files"),
    Reference("evidence", "entity_id", "entities"),
    Reference("evidence", "relationship_id", "relationships"),
    Reference("evidence", "file_id", "files"),
    Reference("evidence", "run_id", "runs", forgets=True),
    Reference("messages", "run_id", "runs"),
    Reference("messages", "file_id", "files"),
)
#: Columns that name a row, where it isn't ``id``.
KEYS = {"files": "file_id"}


def order(tables: set[str], references: tuple[Reference, ...] = REFERENCES) -> list[str]:
    """Tables with every parent before what refers to it."""
    above = {t: {r.parent for r in references if r.table == t and r.parent in tables and r.parent != t} for t in tables}
    return list(TopologicalSorter({t: sorted(p) for t, p in sorted(above.items())}).static_order())


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> dict[str, DataFrame]:
    """All tables after the rows ``gone`` (id, by table) are deleted, with everything that follows.

    Tables are taken in the order of their references, each once: a join a reference, of the ids that
    have gone. Only ids of tables that others refer to are written; a reference whose column a table lacks,
    or whose parent has lost nothing, costs nothing. Tables of ``gone`` needn't be among ``tables``.
    """
    lost, out = {t: df.select(F.col("id").cast("string").alias("gone")).distinct() for t, df in gone.items()}, dict(tables)
    parents = {r.parent for r in references}
    for name in order(set(tables) | set(gone), references):
        if name not in tables:
            continue
        df, key = tables[name], KEYS.get(name, "id")
        flags = []
        own = [(r.column, lost[r.parent], r.forgets) for r in references if r.table == name and r.parent in lost and r.column in df.columns]
        if name in gone and key in df.columns:
            own.append((key, lost[name], False))
        if not own:
            continue
        columns = df.columns
        for i, (column, ids, forgets) in enumerate(own):
            flag = f"__gone{i}"
            df = df.join(ids.withColumn(flag, F.lit(True)), F.col(column).cast("string") == F.col("gone"), "left").drop("gone")
            flags.append((flag, column, forgets))
        dies = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f, _, forgets in flags if not forgets], F.lit(False))
        if name in parents and key in columns:
            found = materialise(df.where(dies).select(F.col(key).cast("string").alias("gone")).distinct(), f"gone-{name}")
            lost[name] = lost[name].unionByName(found).distinct() if name in lost else found
        emptied = {column: F.when(F.col(f).isNull(), F.col(column)).alias(column) for f, column, forgets in flags if forgets}
        out[name] = df.where(~dies).select(*[emptied.get(c, F.col(c)) for c in columns])
    return out
