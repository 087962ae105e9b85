"""Every graph query on the given tables, each beside SQL that states what it computes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, naming, text
from .operators import adjacency, changes, compare, graph, ingest, lifecycle, merge, overlay, search, stats, views, walk
from .operators.extract import table_function
from .operators.extract.base import analyze_files, dealt
from .operators.extract.others import default_registry
from .operators.search_index import SearchIndex
from .plans.projection import Graph, with_graph
from .plans.projection import graph as project
from .plans.store import GraphStore, materialise, shared_dir
from .schema import STRUCTURAL, WRITES
from .sources import files as sources
from .streaming import changes as change_stream_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROOT, TABLE, REPORT, FILE = "r0", "p7", "s3", "src/f/f"
SUITE = "suite-2"


def on_graph(sql: str | None):
    """Register a query over the projected graph; its SQL may use entities, relationships and files."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_graph(f" {sql}" if not sql.lstrip().startswith(",") else sql)
        return f

    return add


def on_tables(sql: str | None, *tables: str):
    """Register a query over plain tables."""

    def add(f: Callable[..., DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_EDGE = "e.id AS other_id, e.entity_type, e.name, r.relation_type, r.id AS edge_id, r.conf, r.status, r.file_id, r.start_line"
_TYPES_SQL = "CASE regexp_extract(lower(path), '(\\.[^./]+)$', 1) WHEN '.sql' THEN 'sql' WHEN '.pkb' THEN 'plsql' WHEN '.jrxml' THEN 'jrxml' WHEN '.log' THEN 'log' WHEN '.png' THEN 'image' ELSE 'unknown' END"

# -- sources ----------------------------------------------------------------------------------


@on_graph(f"SELECT file_id, path, {_TYPES_SQL} AS detected_type, regexp_extract(lower(path), '(\\.[^./]+)$', 1) AS extension FROM files")
def scan_inventory(g: Graph) -> DataFrame:
    return g.files.select("file_id", "path", sources.detect_type(F.col("path")).alias("detected_type"), naming.extension(F.col("path")).alias("extension"))


@on_graph(f"SELECT detected_type, count(*) AS n FROM (SELECT {_TYPES_SQL} AS detected_type FROM files) GROUP BY detected_type")
def detect_type_mix(g: Graph) -> DataFrame:
    return stats.count_by(g.files.select(sources.detect_type(F.col("path")).alias("detected_type")), "detected_type")


@on_tables(
    "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 5242880 THEN 'too_large' END AS skip_reason, CASE WHEN octet_length(encode(text)) <= 5242880 THEN sha256(text) END AS content_hash FROM documents WHERE text IS NOT NULL", "documents"
)
def skip_reasons(docs: DataFrame) -> DataFrame:
    content = F.col("text").cast("binary")
    named = docs.where("text is not null").select("doc_id", F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.octet_length(content).cast("bigint").alias("size_bytes"), content.alias("content"))
    return sources.classify(named).select("doc_id", "skip_reason", "content_hash")


@on_graph("SELECT 'oracle-apex' AS project_type FROM (SELECT count(*) FROM files) WHERE (SELECT count(*) FROM files WHERE path LIKE '%.sql' OR path LIKE '%.pkb') > 0 AND NOT (abs((SELECT count(*) FROM files WHERE path LIKE '%.sql' OR path LIKE '%.pkb') - (SELECT count(*) FROM files WHERE path LIKE '%.jrxml')) < 0.5 * (SELECT count(*) FROM files WHERE path LIKE '%.sql' OR path LIKE '%.pkb'))")
def project_type(g: Graph) -> DataFrame:
    return sources.guess_project_type(g.files.select(sources.detect_type(F.col("path")).alias("detected_type")))


@on_graph("""SELECT node, depth, is_dir, count(*) AS n_files, CASE WHEN contains(node, '/') THEN regexp_replace(node, '/[^/]*$', '') ELSE '' END AS parent FROM (
  SELECT array_to_string(p[1:i], '/') AS node, CAST(i AS INTEGER) AS depth, i < len(p) AS is_dir FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM files))) GROUP BY node, depth, is_dir""")
def file_tree(g: Graph) -> DataFrame:
    return sources.file_tree(g.files)


# -- changes ----------------------------------------------------------------------------------

_VERSIONS = """, old AS (SELECT path, content_hash, CAST(NULL AS VARCHAR) AS skip_reason, size_bytes, file_id % 11 = 0 AS is_deleted FROM files WHERE file_id % 10 <> 1),
new AS (SELECT path, CASE WHEN file_id % 9 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash, CAST(NULL AS VARCHAR) AS skip_reason, size_bytes FROM files WHERE file_id % 10 <> 2),
diff AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL OR (n.path IS NOT NULL AND o.is_deleted) THEN 'added' WHEN n.path IS NULL AND o.is_deleted THEN NULL WHEN n.path IS NULL THEN 'deleted'
  WHEN n.content_hash IS DISTINCT FROM o.content_hash THEN 'modified' ELSE 'unchanged' END AS kind FROM old o FULL JOIN new n ON o.path = n.path)
"""


def _diff(g: Graph) -> DataFrame:
    none = F.lit(None).cast("string").alias("skip_reason")
    old = g.files.where("file_id % 10 <> 1").select("path", "content_hash", none, "size_bytes", (F.col("file_id") % 11 == 0).alias("is_deleted"))
    new = g.files.where("file_id % 10 <> 2").select("path", F.when(F.col("file_id") % 9 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), none, "size_bytes")
    return changes.change_diff(old, new)


@on_graph(_VERSIONS + "SELECT path, kind FROM diff WHERE kind IS NOT NULL")
def change_diff(g: Graph) -> DataFrame:
    return _diff(g)


@on_graph(_VERSIONS + "SELECT kind, count(*) AS n FROM diff WHERE kind IS NOT NULL GROUP BY kind")
def change_counts(g: Graph) -> DataFrame:
    return changes.change_counts(_diff(g))


@on_graph("SELECT file_id FROM files WHERE content_hash IS DISTINCT FROM analyzed_hash")
def pending_files(g: Graph) -> DataFrame:
    return changes.pending(g.files).select("file_id")


@on_graph(f"SELECT file_id FROM files WHERE analyzed_hash = content_hash AND analyzed_by IS DISTINCT FROM '{SUITE}'")
def stale_files(g: Graph) -> DataFrame:
    return changes.stale(g.files, SUITE).select("file_id")


@on_graph(f"SELECT file_id FROM files WHERE (content_hash IS DISTINCT FROM analyzed_hash OR analyzed_by IS DISTINCT FROM '{SUITE}') AND {_TYPES_SQL} IN {_IN(sources.ANALYZABLE)}")
def work_queue(g: Graph) -> DataFrame:
    return changes.work_queue(g.files, SUITE, sources.detect_type(F.col("path")).isin(*sources.ANALYZABLE)).select("file_id")


def _runs(g: Graph) -> tuple[DataFrame, DataFrame]:
    run = F.date_format("scanned_at", "yyyy-MM")
    versions = g.files.select("path", "content_hash", F.col("scanned_at").alias("at"), run.alias("run_id"))
    return versions, versions.groupBy("run_id").agg(F.min("at").alias("started_at"), F.count("*").alias("files_analyzed"))


@on_graph("SELECT strftime(scanned_at, '%Y-%m') AS run_id, CAST(min(scanned_at) AS VARCHAR)[1:10] AS started_on, count(*) AS files_analyzed FROM files GROUP BY run_id ORDER BY started_on DESC LIMIT 25")
def run_history(g: Graph) -> DataFrame:
    return _runs(g)[1].orderBy(F.desc("started_at"), F.desc("run_id")).limit(25).select("run_id", F.date_format("started_at", "yyyy-MM-dd").alias("started_on"), "files_analyzed")


@on_graph("SELECT path, content_hash FROM files WHERE strftime(scanned_at, '%Y-%m') = (SELECT max(strftime(scanned_at, '%Y-%m')) FROM files)")
def changes_since(g: Graph) -> DataFrame:
    return changes.changes_since(*_runs(g)).select("path", "content_hash")


@on_graph("SELECT regexp_extract(path, '^src/[^/]*') AS folder, content_hash FROM files QUALIFY row_number() OVER (PARTITION BY folder ORDER BY scanned_at DESC, content_hash DESC) <= 50")
def version_history(g: Graph) -> DataFrame:
    rows = g.files.select(F.regexp_extract("path", "^src/[^/]*", 0).alias("folder"), "content_hash", F.col("scanned_at").alias("at"), F.col("content_hash").alias("run_id"))
    return changes.latest_versions(rows, "folder").select("folder", "content_hash")


@on_graph(f"SELECT greatest(count(*) FILTER (content_hash IS DISTINCT FROM analyzed_hash) - count(*) FILTER (analyzed_hash = content_hash AND analyzed_by IS DISTINCT FROM '{SUITE}'), 0) AS files_skipped FROM files")
def skipped_counter(g: Graph) -> DataFrame:
    return changes.counters(changes.pending(g.files), changes.stale(g.files, SUITE))


# -- merging ----------------------------------------------------------------------------------

_SIGHT = "SELECT upper(p_name) AS k, p_name AS name, CAST((l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS BIGINT) AS seq, CAST(round(100 - l_discount * 100) AS INT) AS confidence, CASE WHEN l_linestatus = 'O' THEN 'confirmed' ELSE 'inferred' END AS status, CASE WHEN l_linenumber > 2 THEN p_brand ELSE '' END AS description FROM lineitem JOIN part ON l_partkey = p_partkey"


@on_tables(f"SELECT k, arg_min(name, seq) AS name, max(confidence) AS confidence, first(status ORDER BY confidence DESC, seq) AS status, arg_min(description, seq) FILTER (description <> '') AS description, count(*) AS sightings FROM ({_SIGHT}) GROUP BY k", "lineitem", "part")
def entity_merge(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    rows = lineitem.sparkSession.sql(_SIGHT.replace("lineitem", "{lineitem}").replace("part ON", "{part} ON"), lineitem=lineitem, part=part)
    return merge.merge_entities(rows, ["k"])


@on_graph("""SELECT source_id, relation_type, target_id, max(conf) AS confidence, count(*) AS sightings, arg_max(start_line, conf * 100000000000 - seq) AS start_line, arg_max(status, conf * 100000000000 - seq) AS status
FROM (SELECT *, file_id * 10 + start_line AS seq FROM relationships WHERE starts_with(id, 'l')) GROUP BY source_id, relation_type, target_id""")
def relationship_merge(g: Graph) -> DataFrame:
    rows = g.relationships.where(F.col("id").startswith("l")).withColumn("seq", F.col("file_id") * 10 + F.col("start_line")).withColumnRenamed("conf", "confidence")
    return merge.merge_relationships(rows, ["source_id", "relation_type", "target_id"])


@on_graph("SELECT source_id || '|' || relation_type || '|' || target_id AS claim, count(*) AS n_evidence FROM relationships GROUP BY claim")
def evidence_counts(g: Graph) -> DataFrame:
    claim = naming.claim_key(F.col("source_id"), F.col("relation_type"), F.col("target_id"))
    return stats.count_by(g.relationships.select(claim.alias("claim")), "claim").withColumnRenamed("n", "n_evidence")


@on_graph("SELECT id FROM relationships r WHERE file_id IS NULL OR file_id % 5 <> 0")
def retract_file(g: Graph) -> DataFrame:
    return merge.retract(g.relationships, g.files.where("file_id % 5 = 0")).select("id")


@on_graph("SELECT id FROM entities WHERE id IN (SELECT source_id FROM relationships WHERE file_id % 5 = 0 UNION SELECT target_id FROM relationships WHERE file_id % 5 = 0) OR (entity_type = 'OraclePackage')")
def orphan_gc(g: Graph) -> DataFrame:
    evidence = g.entities.where("entity_type = 'OraclePackage'").select(F.col("id").alias("entity_id"))
    return merge.collect_orphans(g.entities, g.relationships.where("file_id % 5 = 0"), evidence).select("id")


@on_graph("SELECT entity_type || '|' || CASE WHEN qualified_name IS NULL THEN '' ELSE upper(regexp_replace(qualified_name, '\\.[^.]*$', '')) END || '||' || CASE WHEN entity_type LIKE 'Oracle%' THEN upper(name) ELSE name END AS identity_key, count(*) AS n FROM entities GROUP BY identity_key")
def identity_keys(g: Graph) -> DataFrame:
    owner = F.coalesce(naming.qualified_parts(F.col("qualified_name"))["owner"], F.lit(""))
    key = naming.identity_key(F.col("entity_type"), owner, F.lit(""), naming.normalize_name(F.col("name"), F.col("entity_type")))
    return stats.count_by(g.entities.select(key.alias("identity_key")), "identity_key")


# -- lookup -----------------------------------------------------------------------------------


@on_graph("SELECT id, entity_type, name FROM entities WHERE upper(name) = 'SMALL RING' OR upper(qualified_name) = 'SMALL RING'")
def resolve_name(g: Graph) -> DataFrame:
    return graph.resolve(g.entities, '"small ring"').select("id", "entity_type", "name")


@on_graph(f"SELECT id, entity_type, name, conf FROM entities WHERE id = '{TABLE}'")
def get_entity(g: Graph) -> DataFrame:
    return g.entities.where(F.col("id") == TABLE).select("id", "entity_type", "name", "conf")


@on_graph("SELECT id, name FROM entities WHERE entity_type = 'JasperReport' ORDER BY name, id LIMIT 20 OFFSET 10")
def list_page(g: Graph) -> DataFrame:
    return graph.page(g.entities, "JasperReport", 10, 20).select("id", "name")


@on_graph("SELECT id, conf FROM entities WHERE conf < 80 ORDER BY conf, name, id LIMIT 200")
def low_confidence(g: Graph) -> DataFrame:
    return graph.low_confidence(g.entities).select("id", "conf")


@on_graph("SELECT CASE WHEN conf >= 100 THEN 'confirmed' WHEN conf >= 80 THEN 'strong' WHEN conf >= 50 THEN 'probable' ELSE 'low' END AS band, count(*) AS n FROM entities GROUP BY band")
def confidence_bands(g: Graph) -> DataFrame:
    return stats.count_by(g.entities.select(graph.confidence_band(F.col("conf")).alias("band")), "band")


@on_graph("SELECT regexp_extract(path, '^src/[^/]*') AS project, count(*) AS n_files FROM files GROUP BY project ORDER BY max(coalesce(scanned_at, TIMESTAMP '1970-01-01')) DESC, project LIMIT 20")
def recent_projects(g: Graph) -> DataFrame:
    rows = g.files.groupBy(F.regexp_extract("path", "^src/[^/]*", 0).alias("project")).agg(F.count("*").alias("n_files"), F.max("scanned_at").alias("at"))
    return rows.orderBy(F.desc("at"), "project").limit(20).select("project", "n_files")


@on_graph("SELECT path, analyzed_hash IS DISTINCT FROM content_hash AS is_modified FROM files")
def file_rows(g: Graph) -> DataFrame:
    return g.files.select("path", (~F.col("analyzed_hash").eqNullSafe(F.col("content_hash"))).alias("is_modified"))


# -- one hop ----------------------------------------------------------------------------------

_REL = "FROM relationships r JOIN entities e ON e.id = r.{other} WHERE r.{own} = '{id}' AND r.relation_type {kind}"
_incoming = lambda i, kind: _REL.format(other="source_id", own="target_id", id=i, kind=kind)
_outgoing = lambda i, kind: _REL.format(other="target_id", own="source_id", id=i, kind=kind)
_PLAIN = f"NOT IN {_IN(STRUCTURAL)}"
_TOP = "ORDER BY conf DESC, name, edge_id LIMIT 200"


@on_graph(f"(SELECT {_EDGE}, 'incoming' AS direction {_incoming(TABLE, _PLAIN)} {_TOP}) UNION ALL (SELECT {_EDGE}, 'outgoing' AS direction {_outgoing(TABLE, _PLAIN)} {_TOP})")
def where_used(g: Graph) -> DataFrame:
    return graph.where_used(g.relationships, g.entities, TABLE)


@on_graph(f"SELECT {_EDGE} {_incoming(TABLE, _PLAIN)} {_TOP}")
def dependents(g: Graph) -> DataFrame:
    return graph.related(g.relationships, g.entities, TABLE, "incoming")


@on_graph(f"SELECT {_EDGE} {_outgoing(REPORT, _PLAIN)} {_TOP}")
def dependencies(g: Graph) -> DataFrame:
    return graph.related(g.relationships, g.entities, REPORT, "outgoing")


@on_graph(f"SELECT {_EDGE} {_incoming(TABLE, 'IS NOT NULL')} {_TOP}")
def with_structural(g: Graph) -> DataFrame:
    return graph.related(g.relationships, g.entities, TABLE, "incoming", structural=True)


@on_graph(f"SELECT {_EDGE} {_outgoing(REPORT, 'IN ' + _IN(WRITES))} {_TOP}")
def by_relations(g: Graph) -> DataFrame:
    return graph.related(g.relationships, g.entities, REPORT, "outgoing", relations=WRITES)


@on_graph(f"SELECT {_EDGE}, r.relation_type IN {_IN(WRITES)} AS written FROM relationships r JOIN entities e ON e.id = r.target_id JOIN files f ON f.file_id = r.file_id WHERE f.path = (SELECT min(path) FROM files WHERE path LIKE 'src/f/%') AND r.relation_type IN ('QUERY_READS_TABLE', 'REPORT_QUERIES_TABLE', 'QUERY_WRITES_TABLE', 'APEX_PROCESS_UPDATES_TABLE')")
def tables_of_file(g: Graph) -> DataFrame:
    path = g.files.where("path like 'src/f/%'").agg(F.min("path")).first()[0]
    return graph.tables_of_file(g.relationships, g.entities, g.files, path)


@on_graph("SELECT e.id, e.entity_type, e.name, s.first_line FROM entities e JOIN (SELECT i, min(start_line) AS first_line FROM (SELECT source_id AS i, start_line FROM relationships r JOIN files f ON f.file_id = r.file_id WHERE path = (SELECT min(path) FROM files) UNION ALL SELECT target_id, start_line FROM relationships r JOIN files f ON f.file_id = r.file_id WHERE path = (SELECT min(path) FROM files)) GROUP BY i) s ON s.i = e.id")
def entities_in_file(g: Graph) -> DataFrame:
    return graph.entities_in_file(g.relationships, g.entities, g.files, g.files.agg(F.min("path")).first()[0])


@on_graph(f"SELECT e.id AS other_id, e.name, r.relation_type, r.id AS edge_id, r.conf FROM relationships r JOIN entities e ON e.id = r.source_id WHERE r.target_id = '{TABLE}' AND e.entity_type = 'JasperReport'")
def reports_using_table(g: Graph) -> DataFrame:
    return graph.from_type(g.relationships, g.entities, TABLE, "JasperReport")


@on_graph(f"SELECT {_EDGE} {_outgoing(REPORT, 'IN ' + _IN(('REPORT_QUERIES_TABLE',)))} ORDER BY conf DESC, name, edge_id")
def tables_of_report(g: Graph) -> DataFrame:
    return graph.related(g.relationships, g.entities, REPORT, "outgoing", relations=("REPORT_QUERIES_TABLE",), limit=None)


@on_graph(f"SELECT id, entity_type FROM entities e WHERE entity_type IN ('OracleTable', 'OracleProcedure', 'SqlQuery') AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.target_id = e.id AND r.relation_type NOT IN {_IN(STRUCTURAL)})")
def orphans(g: Graph) -> DataFrame:
    return graph.orphans(g.relationships, g.entities, ("OracleTable", "OracleProcedure", "SqlQuery"), None).select("id", "entity_type")


@on_graph(f", found AS (SELECT id, entity_type FROM entities e WHERE entity_type IN ('OracleProcedure', 'SqlQuery') AND NOT EXISTS (SELECT 1 FROM relationships r WHERE r.target_id = e.id AND r.relation_type NOT IN {_IN(STRUCTURAL)}) ORDER BY entity_type, name, id LIMIT 300) SELECT entity_type, count(*) AS n, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found) >= 300 AS truncated FROM found GROUP BY entity_type")
def orphan_report(g: Graph) -> DataFrame:
    return graph.orphan_report(g.relationships, g.entities, ("OracleProcedure", "SqlQuery")).drop("ids")


@on_graph(f"SELECT DISTINCT CASE WHEN source_id = '{TABLE}' THEN target_id ELSE source_id END AS id FROM relationships WHERE relation_type = 'TABLE_JOINS_TABLE' AND '{TABLE}' IN (source_id, target_id) AND source_id <> target_id")
def joined_with(g: Graph) -> DataFrame:
    return graph.joined_with(g.relationships, TABLE)


_BRAND = "(SELECT id FROM entities WHERE entity_type = 'OracleTable')"


@on_graph(f"SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, count(*) AS n, max(conf) AS conf FROM relationships WHERE relation_type = 'TABLE_JOINS_TABLE' AND source_id <> target_id AND source_id IN {_BRAND} AND target_id IN {_BRAND} GROUP BY 1, 2")
def er_links(g: Graph) -> DataFrame:
    return graph.er_links(g.relationships, g.entities.where("entity_type = 'OracleTable'").select("id"))


@on_graph(", own AS (SELECT upper(string_split(qualified_name, '.')[1]) AS owner, count(DISTINCT string_split(qualified_name, '.')[-1]) AS n FROM (SELECT concat(n_name, '.', c_name) AS qualified_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY owner) SELECT e.id, e.name, CAST(coalesce(own.n, 0) AS INTEGER) AS n_columns FROM entities e LEFT JOIN own ON upper(e.name) = own.owner WHERE e.entity_type = 'OraclePackage'")
def er_tables(g: Graph) -> DataFrame:
    names = g.entities.where("entity_type = 'OraclePackage'").select(F.col("id").alias("i"), F.col("name").alias("package"))
    calls = g.relationships.join(names, F.col("target_id") == F.col("i")).join(g.entities.where("entity_type = 'OracleProcedure'").select(F.col("id").alias("c"), F.col("name").alias("cname")), F.col("source_id") == F.col("c"))
    columns = calls.select(F.concat_ws(".", "package", "cname").alias("qualified_name"))
    return graph.er_tables(g.entities.where("entity_type = 'OraclePackage'"), columns).drop("columns")


# -- walks ------------------------------------------------------------------------------------

_WALK = """, walk AS (SELECT '{root}' AS id, 0 AS depth, 100 AS min_conf, false AS inferred
  UNION ALL SELECT r.{to}, w.depth + 1, least(w.min_conf, r.conf), w.inferred OR r.status <> 'confirmed' FROM walk w JOIN relationships r ON r.{own} = w.id
  WHERE w.depth < {depth} AND r.conf >= {least} AND r.relation_type NOT IN ('FILE_CONTAINS_ENTITY', 'ENTITY_DEFINED_IN_FILE'))
"""


@on_graph(_WALK.format(root=ROOT, to="source_id", own="target_id", depth=4, least=0) + f"SELECT id, CAST(depth AS INTEGER) AS depth, CAST(min_conf AS INTEGER) AS min_conf, inferred FROM walk WHERE id <> '{ROOT}'")
def impact_region(g: Graph) -> DataFrame:
    return walk.impact(g.relationships, g.entities, ROOT, max_nodes=None).select("id", "depth", "min_conf", "inferred")


@on_graph(_WALK.format(root="o5", to="target_id", own="source_id", depth=4, least=0) + "SELECT id, CAST(depth AS INTEGER) AS depth, CAST(min_conf AS INTEGER) AS min_conf, inferred FROM walk WHERE id <> 'o5'")
def impact_outgoing(g: Graph) -> DataFrame:
    return walk.impact(g.relationships, g.entities, "o5", "outgoing").select("id", "depth", "min_conf", "inferred")


@on_graph(_WALK.format(root=ROOT, to="source_id", own="target_id", depth=4, least=80) + f"SELECT id, CAST(depth AS INTEGER) AS depth FROM walk WHERE id <> '{ROOT}'")
def impact_min_conf(g: Graph) -> DataFrame:
    return walk.impact(g.relationships, g.entities, ROOT, max_nodes=None, min_conf=80).select("id", "depth")


@on_graph(_WALK.format(root=ROOT, to="source_id", own="target_id", depth=4, least=0) + f"SELECT e.entity_type, count(*) AS n, CAST(max(depth) AS INTEGER) AS deepest FROM walk w JOIN entities e ON e.id = w.id WHERE w.id <> '{ROOT}' GROUP BY e.entity_type")
def impact_by_type(g: Graph) -> DataFrame:
    hit = walk.impact(g.relationships, g.entities, ROOT, max_nodes=None).select(F.col("id").alias("i"), "depth")
    return g.entities.join(hit, F.col("id") == F.col("i")).groupBy("entity_type").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@on_graph(f""", l1 AS (SELECT source_id AS id, conf AS m, status <> 'confirmed' AS g FROM relationships WHERE target_id = '{ROOT}'),
l2 AS (SELECT r.source_id AS id, least(l1.m, r.conf) AS m, l1.g OR r.status <> 'confirmed' AS g, r.conf, r.relation_type, r.id AS via FROM l1 JOIN relationships r ON r.target_id = l1.id ORDER BY m DESC, g, conf DESC, relation_type, via LIMIT 20 - 1 - (SELECT count(*) FROM l1))
SELECT id, 1 AS depth, CAST(m AS INTEGER) AS min_conf FROM l1 UNION ALL SELECT id, 2, CAST(m AS INTEGER) FROM l2""")
def impact_budget(g: Graph) -> DataFrame:
    return walk.impact(g.relationships, g.entities, ROOT, max_nodes=20).select("id", "depth", "min_conf")


@on_graph(f", ends AS (SELECT source_id AS a, target_id AS b FROM relationships UNION SELECT target_id, source_id FROM relationships) SELECT b AS id, 1 AS depth FROM ends WHERE a = 'n3' AND b <> 'n3' UNION ALL SELECT 'n3', 0")
def neighborhood_d1(g: Graph) -> DataFrame:
    return walk.neighborhood(g.relationships, g.entities, "n3", 1, None)[0]


@on_graph(", ends AS (SELECT source_id AS a, target_id AS b FROM relationships UNION SELECT target_id, source_id FROM relationships), d1 AS (SELECT DISTINCT b FROM ends WHERE a = 'c3' AND b <> 'c3'), d2 AS (SELECT DISTINCT e.b FROM ends e JOIN d1 ON d1.b = e.a WHERE e.b <> 'c3' AND e.b NOT IN (SELECT b FROM d1)) SELECT 'c3' AS id, 0 AS depth UNION ALL SELECT b, 1 FROM d1 UNION ALL SELECT b, 2 FROM d2")
def neighborhood_d2(g: Graph) -> DataFrame:
    return walk.neighborhood(g.relationships, g.entities, "c3", 2, None)[0]


@on_graph(", ends AS (SELECT source_id AS a, target_id AS b FROM relationships UNION SELECT target_id, source_id FROM relationships), nodes AS (SELECT 'n3' AS id, 0 AS depth UNION ALL SELECT b, 1 FROM ends WHERE a = 'n3' UNION ALL SELECT 'n4', 0 UNION ALL SELECT b, 1 FROM ends WHERE a = 'n4') SELECT id, min(depth) AS depth FROM nodes GROUP BY id")
def merge_neighborhoods(g: Graph) -> DataFrame:
    rels = materialise(g.relationships.select("id", "source_id", "target_id", "relation_type"), "edges")
    a, b = (walk.neighborhood(rels, g.entities, x, 1, None, written=True) for x in ("n3", "n4"))
    return walk.merge_neighborhoods([a[0], b[0]], [a[1], b[1]])[0]


@on_graph(""", ends AS (SELECT source_id AS a, target_id AS b FROM relationships UNION SELECT target_id, source_id FROM relationships), nodes AS (SELECT b AS id, 1 AS depth FROM ends WHERE a = 'n3' AND b <> 'n3' UNION ALL SELECT 'n3', 0),
placed AS (SELECT n.*, row_number() OVER (PARTITION BY depth ORDER BY name, n.id) - 1 AS i, count(*) OVER (PARTITION BY depth) AS k FROM nodes n JOIN entities e ON e.id = n.id)
SELECT id, depth, round(190.0 * depth * cos(2 * pi() * i / k + (depth % 2) * pi() / k), 4) AS x, round(190.0 * depth * sin(2 * pi() * i / k + (depth % 2) * pi() / k), 4) AS y FROM placed""")
def radial_layout(g: Graph) -> DataFrame:
    nodes = walk.neighborhood(g.relationships, g.entities, "n3", 1, None)[0]
    return walk.radial_layout(nodes, g.entities.select("id", "name"))


@on_graph("SELECT id, CAST(i % cols AS INTEGER) AS col, CAST(floor(i / cols) AS INTEGER) AS \"row\" FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, CAST(ceil(sqrt(count(*) OVER ())) AS INTEGER) AS cols FROM entities WHERE entity_type = 'OraclePackage')")
def er_grid(g: Graph) -> DataFrame:
    return walk.grid_layout(g.entities.where("entity_type = 'OraclePackage'").select("id"), "id")


# -- comparison -------------------------------------------------------------------------------

_CLAIM = "source_id || '|' || relation_type || '|' || target_id"


@on_graph(f"SELECT coalesce(l.k, r.k) AS claim, CASE WHEN r.k IS NULL THEN 'left' WHEN l.k IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT {_CLAIM} AS k FROM relationships WHERE status = 'confirmed') l FULL JOIN (SELECT DISTINCT {_CLAIM} AS k FROM relationships WHERE status = 'inferred') r ON l.k = r.k")
def compare_claims(g: Graph) -> DataFrame:
    claim = naming.claim_key(F.col("source_id"), F.col("relation_type"), F.col("target_id")).alias("claim")
    return compare.compare_keys(g.relationships.where("status = 'confirmed'").select(claim), g.relationships.where("status = 'inferred'").select(claim), "claim")


@on_graph("SELECT DISTINCT e.id FROM entities e WHERE id IN (SELECT target_id FROM relationships WHERE relation_type = 'QUERY_READS_TABLE') AND id NOT IN (SELECT target_id FROM relationships WHERE relation_type = 'QUERY_WRITES_TABLE' AND conf > 97)")
def compare_entities(g: Graph) -> DataFrame:
    ends = lambda t, above=-1: g.relationships.where((F.col("relation_type") == t) & (F.col("conf") > above)).select(F.col("target_id").alias("id")).distinct()
    return compare.only(ends("QUERY_READS_TABLE"), ends("QUERY_WRITES_TABLE", 97), "id")


@on_graph("SELECT count(*) FILTER (a AND b) AS shared, count(*) AS total, count(*) FILTER (a AND b) / count(*) AS overlap, count(*) FILTER (a AND b) / count(*) < 0.5 AS doubtful FROM (SELECT file_id % 10 <> 1 AS a, file_id % 10 <> 2 AS b FROM files) WHERE a OR b")
def path_overlap(g: Graph) -> DataFrame:
    return compare.path_overlap(g.files.where("file_id % 10 <> 1"), g.files.where("file_id % 10 <> 2"))


@on_graph("SELECT id FROM (SELECT id FROM entities WHERE entity_type = 'OracleProcedure') ORDER BY id LIMIT 500")
def compare_listed(g: Graph) -> DataFrame:
    return compare.listed(g.entities.where("entity_type = 'OracleProcedure'").select("entity_type", "id"), "entity_type", ["id"]).select("id")


# -- aggregates -------------------------------------------------------------------------------


@on_graph("SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type")
def entities_by_type(g: Graph) -> DataFrame:
    return stats.count_by(g.entities, "entity_type")


@on_graph("SELECT relation_type, count(*) AS n FROM relationships GROUP BY relation_type")
def relationships_by_type(g: Graph) -> DataFrame:
    return stats.count_by(g.relationships, "relation_type")


@on_graph("SELECT analysis_status, count(*) AS n FROM files GROUP BY analysis_status")
def files_by_status(g: Graph) -> DataFrame:
    return stats.count_by(g.files, "analysis_status")


@on_graph("SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relationships) AS n_relationships, (SELECT count(*) FROM files) AS n_files")
def project_stats(g: Graph) -> DataFrame:
    return stats.project_stats(g.entities, g.relationships, g.files)


@on_graph(f"SELECT coalesce(analyzed_by, 'unknown') AS suite, count(*) AS n, CAST(sum(CASE WHEN analyzed_by IS DISTINCT FROM '{SUITE}' THEN 1 ELSE 0 END) AS BIGINT) AS stale FROM files WHERE analyzed_hash IS NOT NULL GROUP BY suite")
def freshness(g: Graph) -> DataFrame:
    return stats.freshness(g.files, SUITE)


@on_graph("SELECT r.id AS error_id, CASE WHEN conf < 92 THEN 'error' ELSE 'warning' END AS severity, path FROM relationships r LEFT JOIN files f ON f.file_id = r.file_id WHERE relation_type = 'QUERY_WRITES_TABLE'")
def files_with_errors(g: Graph) -> DataFrame:
    errors = g.relationships.where("relation_type = 'QUERY_WRITES_TABLE'").select(F.col("id").alias("error_id"), F.when(F.col("conf") < 92, "error").otherwise("warning").alias("severity"), "file_id")
    return stats.files_with_errors(errors, g.files).select("error_id", "severity", "path")


_ERRORS = "SELECT 'ERR-' || json_extract_string(props, '$.k') AS code, ts, user_id FROM events WHERE event_type = 'error'"


def _errors(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(F.concat(F.lit("ERR-"), F.get_json_object("props", "$.k")).alias("code"), "ts", "user_id")


@on_tables(f"SELECT code, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM ({_ERRORS}) GROUP BY code", "events")
def incidents(events: DataFrame) -> DataFrame:
    return stats.incidents(_errors(events), "code", "ts")


@on_tables(f"SELECT DISTINCT code, user_id FROM ({_ERRORS})", "events")
def affected(events: DataFrame) -> DataFrame:
    return _errors(events).select("code", "user_id").distinct()


@on_tables(f"SELECT code, n, CASE WHEN CAST(code[5:] AS INTEGER) % 2 = 0 THEN 2 ELSE 0 END AS n_solutions FROM (SELECT code, count(*) AS n FROM ({_ERRORS}) GROUP BY code)", "events")
def solutions_join(events: DataFrame) -> DataFrame:
    found = stats.incidents(_errors(events), "code", "ts")
    known = found.where("cast(substring(code, 5) as int) % 2 = 0")
    solutions = known.select(F.col("code").alias("error_key"), F.lit(1).alias("worked"), F.lit("restart").alias("description")).unionByName(known.select(F.col("code").alias("error_key"), F.lit(0).alias("worked"), F.lit("wait").alias("description")))
    return overlay.solutions_of(found, solutions, "code").select("code", "n", F.coalesce(F.size("solutions"), F.lit(0)).alias("n_solutions"))


@on_graph(", keys AS (SELECT 'OracleTable||' || '|' || upper(name) AS k, 'OracleTable|' || upper(split_part(qualified_name, '.', 1)) || '||' || upper(name) AS t FROM entities WHERE entity_type = 'OracleTable') SELECT DISTINCT k AS \"key\", t AS twin FROM keys")
def same_but_schema(g: Graph) -> DataFrame:
    part = g.entities.where("entity_type = 'OracleTable'")
    name = naming.normalize_name(F.col("name"), F.col("entity_type"))
    bare = part.select(naming.identity_key(F.col("entity_type"), F.lit(""), F.lit(""), name).alias("k"))
    owned = part.select(naming.identity_key(F.col("entity_type"), naming.qualified_parts(F.col("qualified_name"))["owner"], F.lit(""), name).alias("k"))
    return stats.schema_twins(bare.unionByName(owned).distinct(), "k")


# -- overlays ---------------------------------------------------------------------------------

_NOTES = f"(SELECT DISTINCT {_CLAIM} AS target_key, CASE WHEN conf > 95 THEN 'confirmed' ELSE 'rejected' END AS verdict FROM relationships WHERE relation_type = 'QUERY_READS_TABLE' AND start_line = 1)"


def _notes(g: Graph) -> DataFrame:
    claim = naming.claim_key(F.col("source_id"), F.col("relation_type"), F.col("target_id"))
    return g.relationships.where("relation_type = 'QUERY_READS_TABLE' and start_line = 1").select(claim.alias("target_key"), F.when(F.col("conf") > 95, "confirmed").otherwise("rejected").alias("verdict")).distinct()


def _claims(g: Graph) -> DataFrame:
    return g.relationships.withColumn("claim", naming.claim_key(F.col("source_id"), F.col("relation_type"), F.col("target_id")))


@on_graph(f"SELECT r.id, CASE WHEN n.target_key IS NOT NULL THEN 'manual' ELSE r.status END AS status, n.verdict FROM relationships r LEFT JOIN {_NOTES} n ON n.target_key = {_CLAIM}")
def annotations_apply(g: Graph) -> DataFrame:
    return overlay.annotated(_claims(g), _notes(g), "claim").select("id", "status", "verdict")


@on_graph(f"SELECT n.target_key, n.verdict, c.id AS current_id FROM {_NOTES} n LEFT JOIN (SELECT {_CLAIM} AS k, min(id) AS id FROM relationships WHERE file_id % 2 = 0 GROUP BY k) c ON c.k = n.target_key")
def annotations_resolved(g: Graph) -> DataFrame:
    return overlay.resolved(_notes(g), _claims(g).where("file_id % 2 = 0"), "claim", "id")


# -- search -----------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: t <> '')"


@on_tables(f"SELECT doc_id FROM documents WHERE len(list_filter({_TOK}, lambda t: t = 'the')) > 0 AND len(list_filter({_TOK}, lambda t: starts_with(t, 'thing'))) > 0", "documents")
def search_prefix(docs: DataFrame) -> DataFrame:
    return search.bm25(search.index(docs, "doc_id", ["text"]), "the thing").select(F.col("id").alias("doc_id"))


@on_tables(f"SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM (SELECT doc_id, {_TOK} AS t FROM documents)) WHERE t[i] = 'of' AND t[i + 1] = 'the' GROUP BY doc_id", "documents")
def search_phrase(docs: DataFrame) -> DataFrame:
    found = search.occurrences(search.index(docs, "doc_id", ["text"]), ["of", "the"], False)
    return found.select(F.col("id").alias("doc_id"), "tf")


@on_tables("SELECT p_partkey AS hit_id, p_name AS hit FROM part WHERE p_name ILIKE '%ma_l%' ORDER BY length(p_name), p_name, p_partkey LIMIT 50", "part")
def search_like(part: DataFrame) -> DataFrame:
    return search.like(part, "p_partkey", "p_name", "ma_l").select("hit_id", "hit")


@on_tables(
    f"""WITH post AS (SELECT doc_id, unnest({_TOK}) AS token FROM documents), lens AS (SELECT doc_id, count(*) AS len FROM post GROUP BY doc_id), s AS (SELECT count(*) AS n, avg(len) AS a FROM lens),
tf AS (SELECT doc_id, token, count(*) AS tf FROM post WHERE token IN ('pathetic', 'worthless') GROUP BY doc_id, token), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w AS (SELECT tf.doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM tf JOIN df USING (token) JOIN lens USING (doc_id), s)
SELECT doc_id, round(-sum(w), 6) AS score FROM w GROUP BY doc_id HAVING count(*) = 2""", "documents")
def search_bm25(docs: DataFrame) -> DataFrame:
    return search.bm25(search.index(docs, "doc_id", ["text"]), "pathetic worthless", False).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# -- scalar and text --------------------------------------------------------------------------


@on_tables("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS signature FROM documents", "documents")
def error_signature(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.signature(F.col("text")).alias("signature"))


@on_tables("SELECT doc_id, CAST(length(left(text, CAST(length(text) * 2 // 3 AS INTEGER))) - length(replace(left(text, CAST(length(text) * 2 // 3 AS INTEGER)), chr(10), '')) + 1 AS INTEGER) AS line FROM documents", "documents")
def line_of_offset(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text.line_of(F.col("text"), F.floor(F.length("text") * 2 / 3).cast("int")).alias("line"))


@on_tables("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events", "events")
def json_refs(events: DataFrame) -> DataFrame:
    entry = F.explode(F.from_json("props", "map<string,string>")).alias("path", "value")
    return events.select("event_id", entry)


@on_tables("SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]+-[0-9]+')) AS n FROM conversations", "conversations")
def log_codes(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+-[0-9]+"), F.lit(0))).cast("bigint").alias("n"))


@on_tables("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host, coalesce(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/(.*[^/])/?$', 1), ''), '') AS path FROM pages", "pages")
def normalized_urls(pages: DataFrame) -> DataFrame:
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host"), naming.normalize_path(F.regexp_extract(bare, r"^https?://[^/]*(/.*)$", 1)).alias("path"))


@on_tables("SELECT doc_id, 'a   ' || regexp_replace(replace(text, '*/', ''), '[^\n]', ' ', 'g') || '   b' AS clean FROM documents", "documents")
def blank_noise(docs: DataFrame) -> DataFrame:
    source = F.concat(F.lit("a /*"), F.replace("text", F.lit("*/"), F.lit("")), F.lit("*/ b"))
    return docs.select("doc_id", text.blank_noise(source).alias("clean"))


_SOURCE = "concat('insert into wms.t', o_custkey % 50, ' (num, gross) values (:P', o_custkey % 9, '_NUM, :P', o_custkey % 9, '_GROSS);\n-- from t99\nselect a.num from t', o_custkey % 50, ' a join u', o_custkey % 7, ' b on a.num = b.num;')"


def _built(orders: DataFrame, *wanted: str) -> ingest.GraphTables:
    files = orders.select(F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".sql")).alias("path"), F.expr(_SOURCE).alias("text"))
    return ingest.build(files, default_registry(), "orders", wanted)


@on_tables("SELECT relation_type, count(*) AS n FROM (SELECT unnest(['QUERY_WRITES_TABLE', 'QUERY_READS_TABLE', 'QUERY_READS_TABLE', 'TABLE_JOINS_TABLE', 'QUERY_USES_COLUMN', 'QUERY_USES_COLUMN', 'QUERY_USES_COLUMN', 'QUERY_USES_COLUMN', 'TABLE_HAS_COLUMN', 'TABLE_HAS_COLUMN', 'TABLE_HAS_COLUMN', 'TABLE_HAS_COLUMN', 'APEX_PAGE_CONTAINS_ITEM', 'APEX_PAGE_CONTAINS_ITEM', 'APEX_ITEM_MAPS_TO_COLUMN', 'APEX_ITEM_MAPS_TO_COLUMN']) AS relation_type FROM orders) GROUP BY relation_type", "orders")
def ingest_edges(orders: DataFrame) -> DataFrame:
    return stats.count_by(_built(orders, "relationships").relationships, "relation_type")


@on_tables("SELECT 'OracleTable|WMS||T' || (o_custkey % 50) AS identity_key, count(*) AS sightings FROM orders GROUP BY 1 UNION ALL SELECT 'OracleTable|||T' || (o_custkey % 50), count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'OracleTable|||U' || (o_custkey % 7), count(*) FROM orders GROUP BY 1", "orders")
def ingest_tables(orders: DataFrame) -> DataFrame:
    return _built(orders, "entities").entities.where("entity_type = 'OracleTable'").select("identity_key", "sightings")


@on_tables("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all('update t set a = :P' || doc_id % 100 || '_A where b = :APP_USER', ':(P[0-9]+_[A-Z]+)', 1)) AS item FROM documents) GROUP BY doc_id", "documents")
def apex_binds(docs: DataFrame) -> DataFrame:
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("update t set a = :P"), F.col("doc_id") % 100, F.lit("_A where b = :APP_USER")).alias("text"))
    drafts = analyze_files(files.withColumn("path", F.concat("path", F.lit(".sql"))), default_registry()).where("kind = 'entity' and entity_type = 'ApexItem'")
    return drafts.groupBy(F.regexp_extract("path", "^([0-9]+)", 1).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))


@on_tables("SELECT event_id, 'ORA-' || (10000 + event_id % 7) AS error FROM events WHERE event_type = 'error'", "events")
def log_errors(events: DataFrame) -> DataFrame:
    files = events.where("event_type = 'error'").select(F.concat(F.lit("e"), F.col("event_id"), F.lit(".log")).alias("path"), F.concat(F.lit("[x] ORA-"), 10000 + F.col("event_id") % 7, F.lit(": failed\nORA-06512: at \"A.B\", line 3")).alias("text"))
    found = analyze_files(files, default_registry()).where("kind = 'entity' and entity_type = 'Error'")
    return found.select(F.regexp_extract("path", "e([0-9]+)", 1).cast("bigint").alias("event_id"), F.col("name").alias("error"))


_REPORT = """concat('<jasperReport name="R', s_suppkey, '"><detail><band height="', s_nationkey, '"><image><reportElement/><imageExpression>"img/n', s_nationkey, '.png"</imageExpression></image></band></detail></jasperReport>')"""


def _reports(suppliers: DataFrame) -> ingest.GraphTables:
    files = suppliers.select(F.concat(F.lit("r"), F.col("s_suppkey"), F.lit(".jrxml")).alias("path"), F.expr(_REPORT).alias("text"))
    return ingest.build(files, default_registry(), "reports")


@on_tables("SELECT 'R' || s_suppkey AS name, 0 AS band, 'detail' AS section, s_nationkey AS height, 1 AS elements FROM supplier", "supplier")
def report_structure(suppliers: DataFrame) -> DataFrame:
    return graph.report_structure(_reports(suppliers).entities)


_LAYOUT = """concat('<?xml version="1.0"?>', chr(10), '<j:jasperReport xmlns:j="http://x" name="L', p_partkey, '"><queryString>select a &lt; b from ', lower(p_type), '.t', p_size, ' x</queryString><field name="F', p_size % 5, '"/>',
  '<group name="', p_brand, '"><groupHeader><band height="', p_size, '"><staticText><reportElement x="', p_partkey % 90, '" y="1" width="20" height="10"/><text><![CDATA[ ', p_name, ' < ', p_size, ']]></text></staticText></band></groupHeader></group>',
  '<detail><band height="12"><textField><reportElement x="2" width="7"/><textFieldExpression>$F{F', p_size % 5, '} + $P{a} + $F{ b }</textFieldExpression></textField><line/></band></detail>',
  CASE WHEN p_partkey % 3 = 0 THEN '<summary><band/></summary>' ELSE '' END, '</j:jasperReport>')"""


@on_tables(
    """WITH base AS (SELECT 'L' || p_partkey AS name, p_partkey % 2 = 0 AS stale, p_partkey, p_size, p_brand, p_name FROM part)
SELECT name, stale, 0 AS band, 'groupHeader' AS section, p_brand AS "group", p_size AS band_height, 0 AS element, 'staticText' AS kind, CAST(p_partkey % 90 AS INTEGER) AS x, 1 AS y, 20 AS width, p_name || ' < ' || p_size AS text, '' AS "references" FROM base
UNION ALL SELECT name, stale, 1, 'detail', NULL, 12, 0, 'textField', 2, -1, 7, '$F{F' || p_size % 5 || '} + $P{a} + $F{ b }', '$F{F' || p_size % 5 || '} $F{b} $P{a}' FROM base
UNION ALL SELECT name, stale, 1, 'detail', NULL, 12, 1, 'line', -1, -1, -1, '', '' FROM base
UNION ALL SELECT name, stale, 2, 'summary', NULL, -1, -1, NULL, -1, -1, -1, NULL, NULL FROM base WHERE p_partkey % 3 = 0""", "part")
def report_layout(part: DataFrame) -> DataFrame:
    built = ingest.build(part.select(F.concat(F.lit("l"), "p_partkey", F.lit(".jrxml")).alias("path"), F.expr(_LAYOUT).alias("text")), default_registry(), "layouts")
    path = F.concat(F.lit("l"), "p_partkey", F.lit(".jrxml"))
    files = part.select(naming.file_id(F.lit("layouts"), path).alias("file_id"), path.alias("path"), F.when(F.col("p_partkey") % 2 == 1, SUITE).when(F.col("p_partkey") % 4 == 0, "suite-1").alias("analyzed_by"))
    shown = graph.report_layout(built.entities, files, SUITE)
    known = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("band_height", "element", "x", "y", "width")]
    return shown.select("name", "stale", "band", "section", "group", *known, "kind", "text", F.array_join("references", " ").alias("references"))


@on_tables("""SELECT event_id, v.name, CAST(v.line AS INTEGER) AS line FROM events, (VALUES ('event', 1), ('event.type', 1), ('event.props', 2), ('event.props.k', 2), ('event.tags', 3), ('event.tags[].id', 3)) v(name, line)""", "events")
def json_properties(events: DataFrame) -> DataFrame:
    """Every event as a JSON file, each tenth broken off before its end."""
    whole = F.concat(F.lit('{"event": {"type": "'), "event_type", F.lit('",\n "props": '), "props", F.lit(',\n "t\\u0061gs": [{"id": '), "event_id", F.lit('}, "P'), F.col("user_id") % 9, F.lit('_Q"]}}'))
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.substring(whole, F.lit(1), F.length(whole) - 3), F.lit("#"))).otherwise(whole)
    found = analyze_files(events.select(F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("path"), text.alias("text")), default_registry())
    return found.where("entity_type = 'JsonProperty' and kind = 'entity'").select(F.regexp_extract("path", "e([0-9]+)", 1).cast("bigint").alias("event_id"), "name", F.col("start_line").alias("line"))


@on_tables("SELECT 'img/n' || s_nationkey || '.png' AS image, 1.0 AS confidence FROM supplier WHERE s_suppkey = 3", "supplier")
def images_of_report(suppliers: DataFrame) -> DataFrame:
    built = _reports(suppliers)
    report = built.entities.where("name = 'R3'").select("id").first()[0]
    rels = built.relationships.withColumn("conf", F.col("confidence"))
    return graph.images_of_report(rels, built.entities, report).select(F.col("name").alias("image"), F.col("conf").alias("confidence"))


@on_tables("SELECT 'P' || (o_custkey % 9) || '_' || x AS name, 1 AS first_line FROM orders, (VALUES ('NUM'), ('GROSS')) v(x) WHERE o_orderkey = 5", "orders")
def apex_items_in_file(orders: DataFrame) -> DataFrame:
    built = _built(orders, "entities", "relationships")
    files = orders.select(F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".sql")).alias("path")).withColumn("file_id", naming.file_id(F.lit("orders"), F.col("path")))
    return graph.entities_in_file(built.relationships, built.entities, files, "f5.sql", ("ApexItem",)).select("name", "first_line")


# -- the write path and the viewer's reports --------------------------------------------------

_STATE = "CASE WHEN file_id % 11 = 0 THEN 'deleted' WHEN analyzed_hash = content_hash THEN 'analyzed' ELSE 'pending' END"
_STORED = _VERSIONS + f", stored AS (SELECT path, {_STATE} AS status FROM files WHERE file_id % 10 <> 1)"


def _scans(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The stored inventory and what a scan found."""
    none = F.lit(None).cast("string").alias("skip_reason")
    old = g.files.where("file_id % 10 <> 1").select("file_id", "path", "content_hash", none, "size_bytes", (F.col("file_id") % 11 == 0).alias("is_deleted"), F.expr(_STATE).alias("analysis_status"))
    new = g.files.where("file_id % 10 <> 2").select("path", F.when(F.col("file_id") % 9 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), none, "size_bytes")
    return old, new


@on_graph(_STORED + """SELECT coalesce(n.path, o.path) AS path, n.content_hash, n.path IS NULL AS is_deleted, coalesce(n.size_bytes, o.size_bytes) AS size_bytes,
  CASE WHEN n.path IS NULL THEN 'deleted' WHEN d.kind IN ('added', 'modified') THEN 'pending' ELSE s.status END AS analysis_status, d.kind
FROM old o FULL JOIN new n ON n.path = o.path LEFT JOIN diff d ON d.path = coalesce(n.path, o.path) LEFT JOIN stored s ON s.path = o.path""")
def inventory_apply(g: Graph) -> DataFrame:
    return lifecycle.apply_inventory(*_scans(g)).select("path", "content_hash", "is_deleted", "size_bytes", "analysis_status", "kind")


@on_graph(_VERSIONS + """SELECT d.path, CASE WHEN d.kind = 'deleted' THEN o.content_hash ELSE n.content_hash END AS content_hash, CASE WHEN d.kind = 'deleted' THEN o.size_bytes ELSE n.size_bytes END AS size_bytes, d.kind AS change_kind, 'run-2' AS run_id
FROM diff d LEFT JOIN old o ON o.path = d.path LEFT JOIN new n ON n.path = d.path WHERE d.kind <> 'unchanged'""")
def recorded_versions(g: Graph) -> DataFrame:
    return lifecycle.recorded_versions(*_scans(g), "run-2")


@on_graph(_VERSIONS + "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN status = 'deleted' THEN 'gone' ELSE 'here' END AS kind FROM (SELECT CASE WHEN n.path IS NULL THEN 'deleted' END AS status FROM old o FULL JOIN new n ON n.path = o.path)) GROUP BY kind")
def soft_deleted(g: Graph) -> DataFrame:
    applied = lifecycle.apply_inventory(*_scans(g))
    return stats.count_by(applied.select(F.when(F.col("is_deleted"), "gone").otherwise("here").alias("kind")), "kind")


@on_graph(f"SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'analyzed' WHEN file_id % 3 = 1 THEN 'failed' ELSE analysis_status END AS analysis_status, CASE WHEN file_id % 3 = 0 THEN content_hash ELSE analyzed_hash END AS analyzed_hash, CASE WHEN file_id % 3 = 0 THEN '{SUITE}' ELSE analyzed_by END AS analyzed_by FROM files")
def status_update(g: Graph) -> DataFrame:
    done = g.files.where("file_id % 3 < 2").select("file_id", F.when(F.col("file_id") % 3 == 0, "analyzed").otherwise("failed").alias("status"), F.when(F.col("file_id") % 3 == 0, F.col("content_hash")).alias("analyzed_hash"))
    return lifecycle.set_status(g.files, done, SUITE).select("file_id", "analysis_status", "analyzed_hash", "analyzed_by")


@on_graph("SELECT 'claims' AS what, count(*) AS n FROM relationships WHERE file_id IS NULL OR file_id % 5 <> 0 UNION ALL SELECT 'errors', count(*) FROM relationships WHERE conf < 92 AND (file_id IS NULL OR file_id % 5 <> 0)")
def purge_deleted(g: Graph) -> DataFrame:
    errors = g.relationships.where("conf < 92").select("id", "file_id")
    claims, _, left = lifecycle.purge(g.relationships, g.relationships, errors, g.files.where("file_id % 5 = 0"))
    return stats.count_by(claims.select(F.lit("claims").alias("what")).unionByName(left.select(F.lit("errors").alias("what"))), "what")


@on_graph("SELECT 'entities' AS what, count(*) AS n FROM entities WHERE entity_type <> 'SqlQuery' UNION ALL SELECT 'relationships', count(*) FROM relationships WHERE relation_type <> 'QUERY_READS_TABLE'")
def project_delete(g: Graph) -> DataFrame:
    tables = {"entities": g.entities.withColumn("project_id", F.col("entity_type")), "relationships": g.relationships.withColumn("project_id", F.when(F.col("relation_type") == "QUERY_READS_TABLE", "SqlQuery").otherwise("other"))}
    left = lifecycle.without_project(tables, "SqlQuery")
    return stats.count_by(left["entities"].select(F.lit("entities").alias("what")).unionByName(left["relationships"].select(F.lit("relationships").alias("what"))), "what")


@on_tables("SELECT c_custkey AS id, '/data/' || c_mktsegment || c_custkey AS root, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer", "customer")
def project_open(customer: DataFrame) -> DataFrame:
    at = lambda day: F.lit(day).cast("date").alias("updated_at")
    path = F.concat(F.lit("/data/"), "c_mktsegment", "c_custkey")
    old = customer.select(F.col("c_custkey").alias("id"), path.alias("root"), F.col("c_name").alias("name"), at("2024-01-01"))
    new = customer.where("c_custkey % 2 = 0").select((-F.col("c_custkey")).alias("id"), F.concat(path, F.lit("//")).alias("root"), F.lit("new").alias("name"), at("2024-01-02"))
    return lifecycle.open_projects(old, new).select("id", "root", "name")


@on_tables("SELECT c_custkey AS id, 'en' AS lang, CASE WHEN c_custkey % 3 = 0 THEN '9' WHEN c_custkey % 3 = 2 THEN '4' END AS depth FROM customer", "customer")
def project_settings(customer: DataFrame) -> DataFrame:
    projects = customer.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("lang"), F.lit("en"), F.lit("depth"), F.lit("4")).alias("settings"))
    changed = customer.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("project_id"), F.lit("depth").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "9").alias("value"))
    return lifecycle.with_settings(projects, changed).select("id", F.col("settings")["lang"].alias("lang"), F.try_element_at("settings", F.lit("depth")).alias("depth"))


@on_graph(f"SELECT {_TYPES_SQL} AS detected_type, CAST(NULL AS VARCHAR) AS skip_reason, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM files GROUP BY detected_type")
def dry_run(g: Graph) -> DataFrame:
    return lifecycle.dry_run(g.files.select(sources.detect_type(F.col("path")).alias("detected_type"), F.lit(None).cast("string").alias("skip_reason"), "size_bytes")).select("detected_type", "skip_reason", "n", F.col("bytes").cast("bigint").alias("bytes"))


@on_graph("SELECT status, CASE WHEN conf >= 100 THEN 'confirmed' ELSE 'inferred' END AS fallback, count(*) AS n FROM relationships GROUP BY status, fallback")
def default_status(g: Graph) -> DataFrame:
    return g.relationships.groupBy("status", lifecycle.default_status(F.col("conf")).alias("fallback")).agg(F.count("*").alias("n"))


@on_tables("SELECT '{\"nation\":\"' || n_name || '\",\"note\":\"caf\\u00e9 ' || n_nationkey || '\",\"none\":null}' AS line FROM nation", "nation")
def json_wire(nation: DataFrame) -> DataFrame:
    return lifecycle.json_lines(nation.select(F.col("n_name").alias("nation"), F.concat(F.lit("café "), "n_nationkey").alias("note"), F.lit(None).cast("string").alias("none")))


@on_graph(f"SELECT id AS edge_id, conf, start_line FROM relationships WHERE target_id = '{TABLE}' ORDER BY conf DESC, start_line, id LIMIT 100")
def evidence_lookup(g: Graph) -> DataFrame:
    evidence = g.relationships.select("id", F.col("target_id").alias("entity_id"), F.col("conf").alias("confidence"), "start_line")
    return views.evidence_of(evidence, "entity_id", TABLE).select(F.col("id").alias("edge_id"), F.col("confidence").alias("conf"), "start_line")


@on_graph("SELECT id, entity_type, name, count(*) OVER () = 1 AS chosen FROM entities WHERE upper(name) = (SELECT upper(name) FROM entities WHERE id = 'p7') OR upper(qualified_name) = (SELECT upper(name) FROM entities WHERE id = 'p7')")
def resolve_candidates(g: Graph) -> DataFrame:
    name = g.entities.where("id = 'p7'").first()["name"]
    return views.resolve_one(g.entities, name)


@on_graph(f"SELECT id, entity_type, name, true AS chosen FROM entities WHERE id = '{TABLE}'")
def resolve_by_id(g: Graph) -> DataFrame:
    return views.resolve_one(g.entities, TABLE)


_FAULTS = "SELECT event_id AS error_id, ts AS seen_at, 'run-' || (event_id % 13) AS run_id, 'p' || (event_id % 3) AS project_id FROM events WHERE event_type = 'error'"


def _faults(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("at"), F.concat(F.lit("run-"), F.col("event_id") % 13).alias("run_id"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("project_id"))


@on_tables(f"SELECT error_id FROM ({_FAULTS}) WHERE run_id = 'run-4'", "events")
def errors_of_run(events: DataFrame) -> DataFrame:
    return views.errors_of(_faults(events), "run_id", "run-4").select("error_id")


@on_tables(f"SELECT error_id FROM ({_FAULTS}) WHERE project_id = 'p1' ORDER BY seen_at DESC, error_id LIMIT 200", "events")
def errors_of_project(events: DataFrame) -> DataFrame:
    return views.errors_of(_faults(events), "project_id", "p1", 200).select("error_id")


@on_graph("SELECT id FROM relationships WHERE conf % 4 = 1")
def annotations_clear(g: Graph) -> DataFrame:
    notes = g.relationships.where("conf % 2 = 1").select("id", F.col("conf").cast("string").alias("target_key"))
    gone = notes.where("cast(target_key as int) % 4 = 3").select("target_key").distinct()
    return overlay.clear(notes, gone).select("id")


@on_tables(f"SELECT code AS error_key, d AS description FROM (SELECT DISTINCT code FROM ({_ERRORS})), (VALUES ('wait'), ('restart')) v(d) WHERE NOT (code = (SELECT min(code) FROM ({_ERRORS})) AND d = 'wait')", "events")
def solutions_forget(events: DataFrame) -> DataFrame:
    codes = _errors(events).select(F.col("code").alias("error_key")).distinct()
    known = codes.select("error_key", F.explode(F.array(F.lit("wait"), F.lit("restart"))).alias("description"))
    return overlay.forget(known, codes.agg(F.min("error_key")).first()[0], "wait")


@on_graph("SELECT entity_type, count(*) AS n, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM files) AS total_bytes FROM entities GROUP BY entity_type ORDER BY n DESC, entity_type LIMIT 8")
def home_report(g: Graph) -> DataFrame:
    return views.home(g.files, g.entities).select("entity_type", "n", F.col("total_bytes").cast("bigint").alias("total_bytes"))


@on_graph(f"SELECT e.entity_type, count(*) AS n, count(*) FILTER (r.status = 'confirmed') AS certain, count(*) FILTER (r.status <> 'confirmed') AS guessed FROM relationships r JOIN entities e ON e.id = r.source_id WHERE r.target_id = '{ROOT}' GROUP BY e.entity_type")
def impact_groups(g: Graph) -> DataFrame:
    return views.impact_groups(walk.impact(g.relationships, g.entities, ROOT, depth=1, max_nodes=None), g.entities)


@on_graph("SELECT file_id FROM files WHERE contains(lower(path), '7.pkb')")
def path_filter(g: Graph) -> DataFrame:
    return views.path_filter(g.files, " 7.PKB ").select("file_id")


@on_graph("SELECT id FROM relationships WHERE file_id = (SELECT min(file_id) FROM files WHERE path = (SELECT min(path) FROM files)) AND start_line IS NOT NULL")
def file_markers(g: Graph) -> DataFrame:
    shown = g.files.agg(F.min("path")).first()[0]
    return views.markers(g.relationships, g.files, shown).select("id")


@on_graph(f"SELECT id, name FROM entities WHERE id = '{TABLE}' OR id IN (SELECT CASE WHEN source_id = '{TABLE}' THEN target_id ELSE source_id END FROM relationships WHERE relation_type = 'TABLE_JOINS_TABLE' AND (source_id = '{TABLE}' OR target_id = '{TABLE}'))")
def er_focus(g: Graph) -> DataFrame:
    return views.er_focus(g.entities, graph.er_links(g.relationships, g.entities.select("id")), TABLE)


@on_graph("SELECT CAST(min(conf) - 120 AS DOUBLE) AS x0, CAST(min(id[2:]::BIGINT) - 120 AS DOUBLE) AS y0, CAST(max(conf) + 120 AS DOUBLE) AS x1, CAST(max(id[2:]::BIGINT) + 120 AS DOUBLE) AS y1 FROM entities")
def layout_bounds(g: Graph) -> DataFrame:
    return views.bounds(g.entities.select(F.col("conf").cast("double").alias("x"), F.substring("id", 2, 99).cast("bigint").cast("double").alias("y")))


@on_graph("SELECT path FROM files ORDER BY path LIMIT 41 OFFSET 92")
def row_window(g: Graph) -> DataFrame:
    return views.window(g.files.select("path"), ["path"], top=2000, height=500, row_height=20).select("path")


@on_graph("SELECT id AS hit_id, name AS hit, 0.0 AS score FROM entities WHERE name ILIKE '%tomer#0000_0001%' ORDER BY length(name), name, id LIMIT 50")
def search_fallback(g: Graph) -> DataFrame:
    return search.search(g.entities, "id", "name", ["name"], "tomer#0000_0001")


@on_graph("SELECT id AS hit_id, name AS hit FROM entities WHERE regexp_matches(name, '(^| )(ring|nut)( |$)', 'i') AND (id NOT LIKE '%7' OR regexp_matches(name, '(^| )nut( |$)', 'i'))")
def search_synced(g: Graph) -> DataFrame:
    """The index built, then brought up to date: of entities whose id ends in 7 the word ring is gone."""
    part = g.entities.select("id", "name")
    kept = search.index(part, "id", ["name"])
    new = part.where("id like '%7'").select("id", F.regexp_replace("name", "(?i)ring", "rod").alias("name"), F.lit(False).alias("is_deleted"))
    now = search.synced(kept, new, "id", ["name"])
    found = search.bm25(now, "ring").unionByName(search.bm25(now, "nut")).select(F.col("id").alias("found")).distinct()
    return part.join(found, F.col("id") == F.col("found"), "left_semi").select(F.col("id").alias("hit_id"), F.col("name").alias("hit"))


@on_graph(_WALK.format(root=ROOT, to="source_id", own="target_id", depth=4, least=80) + f"SELECT id, 'incoming' AS way, CAST(depth AS INTEGER) AS depth FROM walk WHERE id <> '{ROOT}'" + """
UNION ALL SELECT e.b, 'around', 1 FROM (SELECT source_id AS a, target_id AS b FROM relationships UNION SELECT target_id, source_id FROM relationships) e WHERE e.a = 'n3' AND e.b <> 'n3'""")
def walks_saved(g: Graph) -> DataFrame:
    """Two questions to one saved adjacency, found again by its folder."""
    root = f"{shared_dir(g.files.sparkSession)}/edges-{uuid.uuid4().hex}"
    adjacency.save(g.relationships, g.entities, root, ("incoming", "around"))
    kept = adjacency.load(g.files.sparkSession, root)
    hit = walk.impact(g.relationships, g.entities, ROOT, max_nodes=None, min_conf=80, saved=kept).select("id", F.lit("incoming").alias("way"), "depth")
    ring = walk.neighborhood(g.relationships, g.entities, "n3", 1, None, saved=kept)[0].where("depth > 0")
    return hit.unionByName(ring.select("id", F.lit("around").alias("way"), "depth"))


@on_tables("SELECT lang AS folder, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents WHERE lang <> 'fr' GROUP BY lang", "documents")
def scan_written(docs: DataFrame) -> DataFrame:
    """A folder of all texts by language, scanned with one language's folder ignored."""
    spark, name = docs.sparkSession, f"scan-{uuid.uuid4().hex}"
    docs.select("lang", "text").write.partitionBy("lang").text(f"{shared_dir(spark)}/{name}")
    policy = sources.ScanPolicy(ignored_files=("*.crc", "_SUCCESS"), extra_ignored_directories=("lang=fr",))
    found = sources.scan(spark, f"{shared_dir(spark)}/{name}", policy)
    return found.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("folder")).agg(F.sum("size_bytes").alias("bytes"))


#: Small files of every kind; # is a number that differs from row to row.
_TEXTS = {
    "mcmd": "publish data where wh = 'W#' and @item = 5\n|\n[select x from wms.t# where a = @item]\n|\nlist orders where ordnum = @ord#\ncatch(@?)\n",
    "pkb": "create or replace package body pk# is\n procedure run#(a number) is\n begin\n  insert into log# (a) values (1);\n end;\n function calc# return number is begin return 1; end;\nend pk#;\n",
    "sql": "with c# as (select * from wms.base#)\nselect a.x from c# a\n join dim# d on a.id = d.id;\nbegin update emp# set sal = :P#_SAL; end;\n",
    "py": "import lib#\nclass C#:\n  def m#(self):\n    return 1\ndef f#(): pass\n",
    "js": "function go#() { return 1 }\nconst add# = (a) => a;\n",
    "log": 'noise\nORA-01400: cannot insert NULL into ("WMS"."TAB#"."COL#")\nORA-06512: at "WMS.PROC#", line 12\n',
}
#: (kind of file, what is found, line)
_FOUND = """('mcmd', 'MocaCommand publish data#1', 1), ('mcmd', 'MocaVariable ITEM', 1), ('mcmd', 'MocaVariable WH', 1), ('mcmd', 'MocaCommand sql#2', 3), ('mcmd', 'MocaVariable ITEM', 3), ('mcmd', 'OracleTable T{k}', 3),
('mcmd', 'QUERY_READS_TABLE T{k}', 3), ('mcmd', 'MOCA_COMMAND_USES_VARIABLE ITEM', 1), ('mcmd', 'MOCA_COMMAND_USES_VARIABLE ITEM', 3), ('mcmd', 'ENTITY_DEPENDS_ON_ENTITY publish data#1', 3), ('mcmd', 'MocaCommand list orders#3', 5),
('mcmd', 'MocaVariable ORD{k}', 5), ('mcmd', 'MOCA_COMMAND_USES_VARIABLE ORD{k}', 5), ('mcmd', 'unused_publish', 1),
('pkb', 'OraclePackage PK{k}', 1), ('pkb', 'OracleProcedure RUN{k}', 2), ('pkb', 'OracleFunction CALC{k}', 6), ('pkb', 'OracleTable LOG{k}', 4), ('pkb', 'QUERY_WRITES_TABLE LOG{k}', 4), ('pkb', 'OracleColumn A', 4),
('sql', 'OracleTable BASE{k}', 1), ('sql', 'OracleTable DIM{k}', 3), ('sql', 'QUERY_READS_TABLE BASE{k}', 1), ('sql', 'QUERY_READS_TABLE DIM{k}', 3), ('sql', 'OracleTable EMP{k}', 4), ('sql', 'QUERY_WRITES_TABLE EMP{k}', 4),
('sql', 'OracleColumn ID', 3), ('sql', 'OracleColumn SAL', 4), ('sql', 'ApexItem P{k}_SAL', 4), ('sql', 'ApexPage {k}', 4), ('sql', 'APEX_PAGE_CONTAINS_ITEM P{k}_SAL', 4), ('sql', 'APEX_ITEM_MAPS_TO_COLUMN SAL', 4),
('py', 'UnknownEntity lib{k}', 1), ('py', 'PythonFunction C{k}', 2), ('py', 'PythonFunction m{k}', 3), ('py', 'PythonFunction f{k}', 5), ('py', 'ENTITY_DEPENDS_ON_ENTITY lib{k}', 1),
('js', 'JavaScriptFunction go{k}', 1), ('js', 'JavaScriptFunction add{k}', 2),
('log', 'Error ORA-01400 TAB{k}.COL{k}', 2), ('log', 'OracleColumn COL{k}', 2), ('log', 'OracleTable TAB{k}', 2), ('log', 'ERROR_AFFECTS_ENTITY COL{k}', 2), ('log', 'ERROR_AFFECTS_ENTITY TAB{k}', 2), ('log', 'OraclePackage PROC{k}', 3), ('log', 'ERROR_AFFECTS_ENTITY PROC{k}', 3)"""
_PASSED_OVER = ("FILE_CONTAINS_ENTITY", "ENTITY_DEFINED_IN_FILE", "TABLE_HAS_COLUMN", "QUERY_USES_COLUMN")


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    k = (F.col(key) % 97).cast("string")
    each = F.explode(F.array(*[F.struct(F.concat(F.lit("f"), key, F.lit(f".{kind}")).alias("path"), F.replace(F.lit(text), F.lit("#"), k).alias("text")) for kind, text in _TEXTS.items()]))
    return rows.select(each.alias("f")).select("f.*")


def _said(drafts: DataFrame) -> DataFrame:
    said = F.when(F.col("kind") == "entity", F.concat_ws(" ", "entity_type", "name")).when(F.col("kind") == "relationship", F.concat_ws(" ", "relation_type", "target_name")).otherwise(F.col("code"))
    rows = drafts.where(~F.coalesce(F.col("relation_type").isin(*_PASSED_OVER), F.lit(False)) & ~F.coalesce(F.col("entity_type").isin("File", "SqlQuery") & (F.col("kind") == "entity"), F.lit(False)))
    return rows.select("path", said.alias("found"), F.col("start_line").alias("line")).distinct()


@on_tables(f"SELECT 'f' || c_custkey || '.' || kind AS path, replace(found, '{{k}}', CAST(c_custkey % 97 AS VARCHAR)) AS found, CAST(line AS INTEGER) AS line FROM customer, (VALUES {_FOUND}) v(kind, found, line)", "customer")
def analyzer_mix(customer: DataFrame) -> DataFrame:
    """Files of six kinds for every customer, through all analyzers."""
    return _said(analyze_files(_mixed(customer, "c_custkey"), default_registry()))


@on_tables(f"SELECT 'f' || s_suppkey || '.' || kind AS path, replace(found, '{{k}}', CAST(s_suppkey % 97 AS VARCHAR)) AS found, CAST(line AS INTEGER) AS line FROM supplier, (VALUES {_FOUND}) v(kind, found, line)", "supplier")
def analyzer_table_function(supplier: DataFrame) -> DataFrame:
    """The same in SQL, by the analyzers' table function."""
    spark = supplier.sparkSession
    table_function.register(spark, default_registry(), "skeinwork_drafts")
    return _said(spark.sql("SELECT d.* FROM {files} f, LATERAL skeinwork_drafts(f.path, f.text) d", files=dealt(_mixed(supplier, "s_suppkey"))))


@on_tables("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, true AS back, strftime(DATE '1970-01-01' + CAST(user_id AS INTEGER), '%Y-%m-%d') AS day, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""", "events")
def iso_dates(events: DataFrame) -> DataFrame:
    at = dates.to_iso(F.col("ts"))
    return events.select("event_id", at.alias("at"), (dates.from_iso(at) == F.col("ts")).alias("back"), dates.civil(F.col("user_id")).cast("string").alias("day"), text.json_object(F.col("props"))["k"].cast("int").alias("k"))


@on_graph("SELECT id, name FROM (SELECT e.id, e.name, min(r.start_line) AS line FROM relationships r JOIN files f ON f.file_id = r.file_id JOIN entities e ON e.id IN (r.source_id, r.target_id) WHERE f.path = (SELECT min(path) FROM files WHERE path LIKE 'src/f/%') AND e.entity_type = 'OracleTable' GROUP BY e.id, e.name ORDER BY line, e.name, e.id LIMIT 1)")
def focus_choice(g: Graph) -> DataFrame:
    """Nothing that is a table is selected, so the first table of the file is chosen."""
    path = g.files.where("path like 'src/f/%'").agg(F.min("path")).first()[0]
    return views.focus_choice(g.entities.where(F.col("id") == REPORT), graph.entities_in_file(g.relationships, g.entities, g.files, path))


@on_graph(_STORED + """SELECT coalesce(n.path, o.path) AS path, coalesce(CAST(f.file_id AS VARCHAR), sha256('demo|file|' || n.path)) AS file_id, d.kind
FROM old o FULL JOIN new n ON n.path = o.path LEFT JOIN diff d ON d.path = coalesce(n.path, o.path) LEFT JOIN files f ON f.path = o.path""")
def inventory_ids(g: Graph) -> DataFrame:
    """Ids after a scan: known files keep theirs, new ones get one that every scan gives them."""
    old, new = _scans(g)
    return lifecycle.apply_inventory(old.withColumn("file_id", F.col("file_id").cast("string")), new, "demo").select("path", "file_id", "kind")


@on_tables(f"""WITH f AS (SELECT 'f' || s_suppkey || '.' || kind AS path, s_suppkey, kind, replace(found, '{{k}}', CAST(s_suppkey % 97 AS VARCHAR)) AS found FROM supplier, (VALUES {_FOUND}) v(kind, found, line))
SELECT DISTINCT sha256('kept|file|' || path) AS file_id, split_part(found, ' ', 1) AS entity_type FROM f WHERE split_part(found, ' ', 1) NOT LIKE '%\\_%' ESCAPE '\\'
UNION SELECT sha256('kept|file|f' || s_suppkey || '.' || kind), t FROM supplier, (VALUES ('pkb', 'File'), ('sql', 'File'), ('pkb', 'SqlQuery'), ('sql', 'SqlQuery')) v(kind, t)""", "supplier")
def project_delete_built(supplier: DataFrame) -> DataFrame:
    """Two projects of the same files; when one is deleted, the evidence of the other is all that is left."""
    one, two = (ingest.build(_mixed(supplier, "s_suppkey"), default_registry(), p) for p in ("gone", "kept"))
    tables = {n: getattr(one, n).unionByName(getattr(two, n)) for n in ("entities", "relationships", "evidence", "messages")}
    left = lifecycle.delete_project(tables, "gone")
    seen = left["evidence"].where("entity_id is not null").select("file_id", "entity_id").distinct()
    return seen.join(left["entities"].select("id", "entity_type"), F.col("entity_id") == F.col("id"), "left").select("file_id", "entity_type").distinct()


@on_tables("""WITH seen AS (SELECT n, 'p/' || p_partkey AS path, p_partkey % 10 <> n + 1 AS here, CASE WHEN p_partkey % 9 = n THEN p_name || '!' ELSE p_name END AS hash FROM part, (VALUES (0), (1), (2)) s(n)),
pairs AS (SELECT a.n, a.path, a.here, coalesce(b.here, false) AS was, a.hash = b.hash AS same FROM seen a LEFT JOIN seen b ON b.path = a.path AND b.n = a.n - 1)
SELECT path, CAST(n AS INTEGER) AS scan, CASE WHEN NOT here THEN 'deleted' WHEN NOT was THEN 'added' WHEN same THEN 'unchanged' ELSE 'modified' END AS kind FROM pairs WHERE here OR was""", "part")
def change_stream(part: DataFrame) -> DataFrame:
    """Three scans as a stream; each query goes on where the one before it ended."""
    spark, root = part.sparkSession, f"{shared_dir(part.sparkSession)}/changes-{uuid.uuid4().hex}"
    at = lambda n: F.lit(f"2024-01-0{n + 1} 12:00:00").cast("timestamp_ntz").cast("timestamp")
    for n in range(3):
        found = part.where(F.col("p_partkey") % 10 != n + 1).withColumn("hash", F.concat("p_name", F.when(F.col("p_partkey") % 9 == n, "!").otherwise("")))
        scan = found.select(F.concat(F.lit("p/"), "p_partkey").alias("path"), F.col("hash").alias("content_hash"), F.lit(None).cast("string").alias("skip_reason"), F.lit(1).cast("bigint").alias("size_bytes"), at(n).alias("scanned_at"))
        scan.write.mode("append").parquet(f"{root}/scans")
        stream = change_stream_of.changes(spark.readStream.schema(change_stream_of.SCAN).parquet(f"{root}/scans"))
        out = stream.writeStream.format("parquet").option("path", f"{root}/kinds").option("checkpointLocation", f"{root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    kinds = spark.read.schema(change_stream_of.CHANGE).parquet(f"{root}/kinds")
    return kinds.select("path", (F.dayofmonth("scanned_at") - 1).alias("scan"), "kind")


_KEPT = "list_filter(regexp_split_to_array(lower(concat(p_name, CASE WHEN p_partkey % 7 = 0 THEN ' ring' ELSE '' END, ' ', p_type)), '[^a-z0-9]+'), lambda t: t <> '')"


@on_tables(
    f"""WITH lens AS (SELECT p_partkey, {_KEPT} AS t FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM lens),
tf AS (SELECT p_partkey, len(t) AS len, p, len(list_filter(t, lambda x: CASE p WHEN 0 THEN x = 'ring' ELSE starts_with(x, 'sm') END)) AS tf FROM lens, (VALUES (0), (1)) phrases(p)),
df AS (SELECT p, count(*) AS df FROM tf WHERE tf > 0 GROUP BY p),
w AS (SELECT p_partkey, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)) AS w FROM tf JOIN df USING (p), s WHERE tf > 0)
SELECT p_partkey AS hit_id, round(-sum(w), 6) AS score FROM w GROUP BY p_partkey HAVING count(*) = 2""", "part")
def search_kept(part: DataFrame) -> DataFrame:
    """A kept index after two syncs: every seventh name has got a word, every fifth row is gone."""
    index = SearchIndex(GraphStore(part.sparkSession, f"{shared_dir(part.sparkSession)}/search-{uuid.uuid4().hex}"), "part", "p_partkey", ["p_name", "p_type"], "bigint")
    index.sync(part)
    index.sync(part.where("p_partkey % 7 = 0").withColumn("p_name", F.concat("p_name", F.lit(" ring"))))
    index.sync(part.where("p_partkey % 5 = 0").withColumn("is_deleted", F.lit(True)))
    return index.search("ring sm").select(F.col("id").alias("hit_id"), F.round("score", 6).alias("score"))


@on_graph("SELECT 'files' AS what, file_id AS id, CASE WHEN file_id % 2 = 0 THEN 'analyzed' ELSE analysis_status END AS value FROM files UNION ALL SELECT 'nations', CAST(substr(id, 2) AS BIGINT), CAST(conf + CASE WHEN id LIKE '%1' THEN 7 ELSE 5 END AS VARCHAR) FROM entities WHERE id LIKE 'n%'")
def store_commits(g: Graph) -> DataFrame:
    """Two writers of one version of the store: their tables differ, so both commits stand; a third whose table has
    changed meanwhile is turned away and done again."""
    store = GraphStore(g.files.sparkSession, f"{shared_dir(g.files.sparkSession)}/store-{uuid.uuid4().hex}")
    store.commit({"files": g.files.select("file_id", "analysis_status"), "nations": g.entities.where("id like 'n%'").select("id", "conf")})
    with store.snapshot() as one, store.snapshot() as two:
        status = F.when(F.col("file_id") % 2 == 0, "analyzed").otherwise(F.col("analysis_status"))
        one.commit({"files": one.read("files").withColumn("analysis_status", status)})
        two.commit({"nations": two.read("nations").withColumn("conf", F.col("conf") + 5)})
    turns = []

    def raised(now):
        turns.append(now.version)
        found = now.read("nations")
        if len(turns) == 1:
            store.commit({"nations": found.withColumn("conf", F.col("conf") + F.when(F.col("id").like("%1"), 1).otherwise(0))})
        return {"nations": found.withColumn("conf", F.col("conf") + F.when(F.col("id").like("%1"), 1).otherwise(0))}

    store.update(raised)
    now = store.latest()
    files = now.read("files").select(F.lit("files").alias("what"), F.col("file_id").alias("id"), F.col("analysis_status").alias("value"))
    return files.unionByName(now.read("nations").select(F.lit("nations").alias("what"), F.substring("id", 2, 10).cast("bigint").alias("id"), F.col("conf").cast("string").alias("value")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
