"""The star schema seen as a knowledge graph, so that every graph operator runs on the given tables.

Confidence is a whole percentage here, which both engines store exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ENTITIES = """
SELECT concat('r', r_regionkey) AS id, 'Directory' AS entity_type, r_name AS name, CAST(NULL AS STRING) AS qualified_name, 100 AS conf, CAST(NULL AS BIGINT) AS file_id FROM region
UNION ALL SELECT concat('n', n_nationkey), 'OraclePackage', n_name, concat('GEO.', n_name), 100, NULL FROM nation
UNION ALL SELECT concat('c', c_custkey), 'OracleProcedure', c_name, concat(c_mktsegment, '.', c_name), CAST(50 + c_custkey % 51 AS INT), NULL FROM customer
UNION ALL SELECT concat('s', s_suppkey), 'JasperReport', s_name, CAST(NULL AS STRING), CAST(30 + s_suppkey % 71 AS INT), NULL FROM supplier
UNION ALL SELECT concat('p', p_partkey), 'OracleTable', p_name, concat(p_brand, '.', p_name), CAST(40 + p_partkey % 61 AS INT), NULL FROM part
UNION ALL SELECT concat('o', o_orderkey), 'SqlQuery', concat('query#', o_orderkey), CAST(NULL AS STRING), 90, o_orderkey FROM orders
"""
RELATIONSHIPS = """
SELECT concat('nr', n_nationkey) AS id, concat('n', n_nationkey) AS source_id, concat('r', n_regionkey) AS target_id, 'ENTITY_DEPENDS_ON_ENTITY' AS relation_type, CAST(NULL AS BIGINT) AS file_id, 1 AS start_line, 100 AS conf, 'confirmed' AS status FROM nation
UNION ALL SELECT concat('cn', c_custkey), concat('c', c_custkey), concat('n', c_nationkey), 'ENTITY_DEPENDS_ON_ENTITY', CAST(NULL AS BIGINT), 1, CAST(50 + c_custkey % 51 AS INT), CASE WHEN c_custkey % 51 = 50 THEN 'confirmed' ELSE 'inferred' END FROM customer
UNION ALL SELECT concat('sn', s_suppkey), concat('s', s_suppkey), concat('n', s_nationkey), 'ENTITY_DEPENDS_ON_ENTITY', CAST(NULL AS BIGINT), 1, 65, 'inferred' FROM supplier
UNION ALL SELECT concat('oc', o_orderkey), concat('o', o_orderkey), concat('c', o_custkey), 'PROCEDURE_CALLS_PROCEDURE', o_orderkey, 1, 90, 'confirmed' FROM orders
UNION ALL SELECT concat('l', l_orderkey, '_', l_linenumber), concat('s', l_suppkey), concat('p', l_partkey),
  CASE WHEN l_returnflag = 'R' THEN 'QUERY_READS_TABLE' WHEN l_returnflag = 'A' THEN 'QUERY_WRITES_TABLE' WHEN l_linestatus = 'O' THEN 'FILE_CONTAINS_ENTITY' ELSE 'REPORT_QUERIES_TABLE' END,
  l_orderkey, l_linenumber, CAST(round(100 - l_discount * 100) AS INT), CASE WHEN l_linestatus = 'O' THEN 'confirmed' ELSE 'inferred' END FROM lineitem
UNION ALL SELECT concat('j', a.l_orderkey, '_', a.l_linenumber), concat('p', a.l_partkey), concat('p', b.l_partkey), 'TABLE_JOINS_TABLE', a.l_orderkey, a.l_linenumber, 90, 'inferred'
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
"""
FILES = """
SELECT o_orderkey AS file_id, concat('src/', lower(o_orderstatus), '/f', o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '.sql' WHEN 1 THEN '.pkb' WHEN 2 THEN '.jrxml' WHEN 3 THEN '.log' WHEN 4 THEN '.png' ELSE '.xyz' END) AS path,
  CAST(floor(o_totalprice * 10) AS BIGINT) AS size_bytes, CASE o_orderstatus WHEN 'F' THEN 'analyzed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS analysis_status,
  concat('h', o_orderkey) AS content_hash, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'old' ELSE concat('h', o_orderkey) END AS analyzed_hash,
  CASE WHEN o_orderkey % 3 = 0 THEN 'suite-1' WHEN o_orderkey % 3 = 1 THEN 'suite-2' END AS analyzed_by, o_orderdate AS scanned_at FROM orders
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    relationships: DataFrame
    files: DataFrame


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    run = lambda sql: spark.sql(_named(sql), **sources)
    return Graph(run(ENTITIES), run(RELATIONSHIPS), run(FILES))


def _named(sql: str) -> str:
    """The statement with its table names as parameters, so that sessions share no temporary views."""
    import re

    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)


def with_graph(body: str) -> str:
    """SQL over entities, relationships and files."""
    duck = lambda s: s.replace("AS STRING", "AS VARCHAR").strip()
    return f"WITH RECURSIVE entities AS ({duck(ENTITIES)}), relationships AS ({duck(RELATIONSHIPS)}), files AS ({duck(FILES)}){body}"


