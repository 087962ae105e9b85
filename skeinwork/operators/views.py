"""Small reports that a viewer asks of tables already made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import FEW_IDS, resolve


def resolve_one(ents: DataFrame, wanted: str) -> DataFrame:
    """(id, entity_type, name, chosen): the entity of that id, else all of that name; chosen where it is the only one."""
    by_id = ents.where(F.col("id") == wanted).select("id", "entity_type", "name", F.lit(0).alias("turn"))
    found = by_id.unionByName(resolve(ents, wanted).select("id", "entity_type", "name", F.lit(1).alias("turn")))
    least = found.agg(F.min("turn").alias("t"))
    kept = found.join(F.broadcast(least), F.col("turn") == F.col("t"), "left_semi")
    n = kept.agg(F.count("*").alias("n"))
    return kept.join(F.broadcast(n)).select("id", "entity_type", "name", (F.col("n") == 1).alias("chosen"))


def evidence_of(evidence: DataFrame, key: str, value: str, limit: int | None = 100) -> DataFrame:
    """Evidence of one entity or relationship, the most confident first, then by line and id."""
    out = evidence.where(F.col(key) == value).orderBy(F.desc("confidence"), "start_line", "id")
    return out if limit is None else out.limit(limit)


def errors_of(errors: DataFrame, key: str, value: str, limit: int | None = None) -> DataFrame:
    """Errors of a run (all) or of a project (the latest ``limit``), newest first."""
    out = errors.where(F.col(key) == value).orderBy(F.desc("at"), "error_id")
    return out if limit is None else out.limit(limit)


def home(files: DataFrame, entities: DataFrame, top: int = 8) -> DataFrame:
    """(entity_type, n, total_bytes): the most frequent types beside the size of all files."""
    types = entities.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(top)
    return types.join(F.broadcast(files.agg(F.sum("size_bytes").alias("total_bytes"))))


def impact_groups(impact: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_type, n, certain, guessed) of an impact's nodes."""
    typed = impact.select("id", "inferred").join(entities.select(F.col("id").alias("i"), "entity_type"), F.col("id") == F.col("i"))
    return typed.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if(~F.col("inferred")).alias("certain"), F.count_if("inferred").alias("guessed"))


def path_filter(files: DataFrame, text: str) -> DataFrame:
    """Files whose path contains ``text``, in any case."""
    return files.where(F.contains(F.lower("path"), F.lit(text.strip().lower())))


def markers(rels: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Claims with a line in the file that is shown. Its ids are counted, so that few are sent to the claims and these
    aren't sorted."""
    shown = files.where(F.col("path") == path).select(F.col("file_id").alias("f")).distinct()
    shown = F.broadcast(shown) if shown.count() <= FEW_IDS else shown
    return rels.where("start_line is not null").join(shown, F.col("file_id") == F.col("f"), "left_semi")


def er_focus(ents: DataFrame, links: DataFrame, focus: str) -> DataFrame:
    """(id, name) of a table and its join partners. links: (a, b)."""
    partners = links.where((F.col("a") == focus) | (F.col("b") == focus)).select(F.explode(F.array("a", "b")).alias("p"))
    return ents.join(partners.unionByName(ents.where(F.col("id") == focus).select(F.col("id").alias("p"))), F.col("id") == F.col("p"), "left_semi").select("id", "name")


def focus_choice(selected: DataFrame, in_file: DataFrame, types: tuple[str, ...] = ("OracleTable", "OracleView")) -> DataFrame:
    """(id, name) of the table that a diagram is drawn around: the selected entity if it is one, else the first, by
    line and name, in the file that is shown. selected: (id, entity_type, name); in_file with first_line, too."""
    turn = lambda df, n, line: df.where(F.col("entity_type").isin(*types)).select("id", "name", F.lit(n).alias("turn"), line.alias("line"))
    both = turn(selected, 0, F.lit(0)).unionByName(turn(in_file, 1, F.col("first_line")))
    return both.orderBy("turn", "line", "name", "id").limit(1).select("id", "name")


def bounds(placed: DataFrame, padding: float = 120.0) -> DataFrame:
    """(x0, y0, x1, y1) around all nodes."""
    return placed.agg((F.min("x") - padding).alias("x0"), (F.min("y") - padding).alias("y0"), (F.max("x") + padding).alias("x1"), (F.max("y") + padding).alias("y1"))


def window(rows: DataFrame, order: list[str], top: int, height: int, row_height: int, over: int = 8) -> DataFrame:
    """The rows that a scrolled list shows, with ``over`` more on either side."""
    first = max(top // row_height - over, 0)
    return rows.orderBy(*order).offset(first).limit(-(-(top + height) // row_height) + over - first)
