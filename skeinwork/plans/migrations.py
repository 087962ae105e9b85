"""Schema versions of the stored tables.

A table folder names the schema version it was written with. Reading lifts older rows through the steps
between; migrating writes them down. Every step looks at the columns that are there, so that it can run
again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """What ``table`` got with schema version ``version``; without ``change`` the table itself."""

    version: int
    name: str
    table: str
    change: Callable[[DataFrame], DataFrame] | None = None
    schema: str | None = None


def with_column(name: str, kind: str, value=None) -> Callable[[DataFrame], DataFrame]:
    """A step's change: a new column with the same value for all rows that are older than it."""
    return lambda df: df if name in df.columns else df.withColumn(name, F.lit(value).cast(kind))


ANNOTATION = "id string, project_id string, target_kind string, target_key string, verdict string, note string, author string, created_at timestamp, updated_at timestamp"
SOLUTION = "id string, project_id string, error_key string, description string, author string, worked boolean, created_at timestamp, updated_at timestamp"

#: In order; version 1 is the first set of tables.
STEPS = (
    Step(2, "suite that analysed a file", "files", with_column("analyzed_by", "string")),
    Step(3, "files read again for new analyzers", "runs", with_column("files_reanalyzed", "int", 0)),
    Step(4, "judgements", "annotations", schema=ANNOTATION),
    Step(5, "remedies", "solutions", schema=SOLUTION),
)


def current(steps: tuple[Step, ...] = STEPS) -> int:
    return max((s.version for s in steps), default=1)


def lift(table: str, df: DataFrame, version: int, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """Rows of ``table`` written with schema ``version``, as the newest schema has them."""
    for step in sorted(steps, key=lambda s: s.version):
        if step.table == table and step.version > version and step.change is not None:
            df = step.change(df)
    return df
