"""The analyzers as a table function for SQL: ``SELECT d.* FROM files, LATERAL drafts(path, text) d``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ...schema import DRAFT
from .base import COLUMNS, Registry


def register(spark: SparkSession, registry: Registry, name: str = "drafts") -> None:
    """Make ``name(path, text)`` known to the session: the drafts of one file by all analyzers of ``registry``."""

    class Drafts:
        def eval(self, path: str, text: str) -> Iterator[tuple]:
            for row in registry.drafts(path or "", text or ""):
                yield tuple(row[c] for c in COLUMNS)

    spark.udtf.register(name, udtf(Drafts, returnType=DRAFT, useArrow=True))
