"""One-hop questions, entity-relationship views and review lists over a graph.

entities: (id, entity_type, name, qualified_name, conf, ...); relationships: (id, source_id, target_id,
relation_type, file_id, start_line, conf, status). Filters on an id come before every join, so a
question about one entity reads its own edges only, and each result of bounded length is a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import READS, REVIEWABLE, STRUCTURAL, WRITES

#: Ids of one path that may be broadcast.
FEW_IDS = 100_000


def _other_end(edges: DataFrame, entities: DataFrame, end: str) -> DataFrame:
    ends = entities.select(F.col("id").alias("other_id"), "entity_type", "name")
    return edges.join(ends, F.col(end) == F.col("other_id")).select(
        "other_id", "entity_type", "name", "relation_type", F.col("id").alias("edge_id"), "conf", "status", "file_id", "start_line"
    )


def _strongest(hits: DataFrame, limit: int | None) -> DataFrame:
    ordered = hits.orderBy(F.desc("conf"), "name", "edge_id")
    return ordered if limit is None else ordered.limit(limit)


def related(rels: DataFrame, ents: DataFrame, entity_id: str, direction: str, structural: bool = False, limit: int | None = 200, relations: Sequence[str] | None = None) -> DataFrame:
    """Edges of one entity with their other end, strongest first. direction: incoming or outgoing."""
    own, other = ("target_id", "source_id") if direction == "incoming" else ("source_id", "target_id")
    edges = rels.where(F.col(own) == entity_id)
    if relations is not None:
        edges = edges.where(F.col("relation_type").isin(*relations))
    elif not structural:
        edges = edges.where(~F.col("relation_type").isin(*STRUCTURAL))
    return _strongest(_other_end(edges, ents, other), limit)


def where_used(rels: DataFrame, ents: DataFrame, entity_id: str, structural: bool = False, limit: int = 200) -> DataFrame:
    """Both directions, ``limit`` of each; a self-edge shows in both."""
    both = [related(rels, ents, entity_id, d, structural, limit).withColumn("direction", F.lit(d)) for d in ("incoming", "outgoing")]
    return both[0].unionByName(both[1])


def tables_of_file(rels: DataFrame, ents: DataFrame, files: DataFrame, path: str, written: bool | None = None) -> DataFrame:
    """Tables that a file's statements read or write, one row a relationship."""
    kinds = {True: WRITES, False: READS, None: READS + WRITES}[written]
    own = files.where(F.col("path") == path).select(F.col("file_id").alias("f"))
    edges = rels.where(F.col("relation_type").isin(*kinds)).join(own, F.col("file_id") == F.col("f")).drop("f")
    return _other_end(edges, ents, "target_id").withColumn("written", F.col("relation_type").isin(*WRITES))


def entities_in_file(rels: DataFrame, ents: DataFrame, files: DataFrame, path: str, types: Sequence[str] | None = None) -> DataFrame:
    """Entities that a file mentions, each with its first line there; of ``types`` only, as for its page items. The file's
    ids are counted, so that few are sent to the edges and these aren't shuffled."""
    if types is not None:
        ents = ents.where(F.col("entity_type").isin(*types))
    own = files.where(F.col("path") == path).select(F.col("file_id").alias("f")).distinct()
    own = F.broadcast(own) if own.count() <= FEW_IDS else own
    seen = rels.join(own, F.col("file_id") == F.col("f"), "left_semi").select(F.explode(F.array("source_id", "target_id")).alias("e"), "start_line")
    first = seen.groupBy("e").agg(F.min("start_line").alias("first_line"))
    return ents.join(first, F.col("id") == F.col("e")).select("id", "entity_type", "name", "first_line")


def from_type(rels: DataFrame, ents: DataFrame, entity_id: str, source_type: str) -> DataFrame:
    """Incoming edges of any relation whose source has a type, as for reports that use a table."""
    hits = _other_end(rels.where(F.col("target_id") == entity_id), ents.where(F.col("entity_type") == source_type), "source_id")
    return hits.select("other_id", "name", "relation_type", "edge_id", "conf")


def images_of_report(rels: DataFrame, ents: DataFrame, entity_id: str) -> DataFrame:
    return related(rels, ents, entity_id, "outgoing", relations=("REPORT_REFERENCES_IMAGE",), limit=None)


_BANDS = "array<struct<section:string,`group`:string,height:int,elements:array<struct<kind:string,x:int,y:int,width:int,height:int,text:string,references:array<string>>>>>"


def report_structure(reports: DataFrame) -> DataFrame:
    """(name, band, section, height, elements) of reports with their metadata, elements counted; other entities give nothing."""
    rows = reports.where("entity_type = 'JasperReport'").select("name", F.posexplode(F.from_json(F.col("metadata")["bands"], _BANDS)).alias("band", "b"))
    return rows.select("name", "band", "b.section", "b.height", F.size("b.elements").alias("elements"))


def report_layout(reports: DataFrame, files: DataFrame, suite: str) -> DataFrame:
    """(id, name, path, analyzed_by, stale, band, section, group, band_height, element, kind, x, y, width, height, text,
    references): a row for each thing that a report draws, one with no element for a band that draws nothing, and one
    with no band for a report without any. ``stale``: another suite than ``suite`` has read its file, or an unknown one.
    files: (file_id, path, analyzed_by)."""
    own = files.select(F.col("file_id").alias("f"), "path", "analyzed_by")
    rows = reports.where("entity_type = 'JasperReport'").join(own, F.col("source_file_id") == F.col("f"), "left")
    rows = rows.withColumn("stale", ~F.col("analyzed_by").eqNullSafe(F.lit(suite)))
    rows = rows.select("id", "name", "path", "analyzed_by", "stale", F.posexplode_outer(F.from_json(F.col("metadata")["bands"], _BANDS)).alias("band", "b"))
    rows = rows.select("id", "name", "path", "analyzed_by", "stale", "band", "b.section", "b.group", F.col("b.height").alias("band_height"), F.posexplode_outer("b.elements").alias("element", "e"))
    return rows.select(*rows.columns[:-1], "e.*")


def orphans(rels: DataFrame, ents: DataFrame, types: Sequence[str] = REVIEWABLE, limit: int | None = 300) -> DataFrame:
    """Entities of ``types`` that no non-structural edge reaches."""
    reached = rels.where(~F.col("relation_type").isin(*STRUCTURAL)).select(F.col("target_id").alias("t"))
    out = ents.where(F.col("entity_type").isin(*types)).join(reached, F.col("id") == F.col("t"), "left_anti").orderBy("entity_type", "name", "id")
    return out if limit is None else out.limit(limit)


def orphan_report(rels: DataFrame, ents: DataFrame, types: Sequence[str] = REVIEWABLE, limit: int = 300) -> DataFrame:
    """Orphans by type, and whether the list reached its limit (also when it just fits)."""
    found = orphans(rels, ents, types, limit)
    total = found.agg(F.count("*").alias("total"))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") >= limit)


def joined_with(rels: DataFrame, entity_id: str) -> DataFrame:
    """Partners of a table in joins, either way round, itself left out."""
    own = rels.where((F.col("relation_type") == "TABLE_JOINS_TABLE") & ((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)))
    return own.select(F.when(F.col("source_id") == entity_id, F.col("target_id")).otherwise(F.col("source_id")).alias("id")).where(F.col("id") != entity_id).distinct()


def er_links(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Join links with both ends among ``ids``, one for each unordered pair, strongest first."""
    links = rels.where("relation_type = 'TABLE_JOINS_TABLE'").select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "conf").where("a <> b")
    keep = ids.select(F.col("id").alias("k"))
    inside = links.join(keep, F.col("a") == F.col("k"), "left_semi").join(keep, F.col("b") == F.col("k"), "left_semi")
    return inside.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("conf").alias("conf"))


def er_tables(ents: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their columns; a column belongs to the tables named by the first part of its
    qualified name, whatever their schema. columns: (qualified_name)."""
    owned = columns.select(F.upper(F.element_at(F.split("qualified_name", r"\."), 1)).alias("owner"), F.element_at(F.split("qualified_name", r"\."), -1).alias("column"))
    lists = owned.groupBy("owner").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    return ents.join(lists, F.upper("name") == F.col("owner"), "left").select("id", "name", F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"), "columns")


def resolve(ents: DataFrame, name: str, entity_type: str | None = None) -> DataFrame:
    """Exact name or qualified name without regard to case and one layer of quotes."""
    wanted = name.strip()
    wanted = (wanted[1:-1] if len(wanted) > 1 and wanted[0] == wanted[-1] == '"' else wanted).upper()
    hits = ents.where((F.upper("name") == wanted) | (F.upper("qualified_name") == wanted))
    return hits if entity_type is None else hits.where(F.col("entity_type") == entity_type)


def low_confidence(ents: DataFrame, threshold: int = 80, limit: int | None = 200) -> DataFrame:
    out = ents.where(F.col("conf") < threshold).orderBy("conf", "name", "id")
    return out if limit is None else out.limit(limit)


def page(ents: DataFrame, entity_type: str | None, offset: int, limit: int) -> DataFrame:
    rows = ents if entity_type is None else ents.where(F.col("entity_type") == entity_type)
    return rows.orderBy("name", "id").offset(offset).limit(limit)


def confidence_band(conf: Column) -> Column:
    return F.when(conf >= 100, "confirmed").when(conf >= 80, "strong").when(conf >= 50, "probable").otherwise("low")
