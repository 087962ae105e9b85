"""Vocabularies, constants and table schemas of the knowledge graph."""

from __future__ import annotations

# The closed vocabularies of the data model.
ENTITY_TYPES = (
    "Project File Directory OracleTable OracleView OracleColumn OracleSequence OracleProcedure OracleFunction OraclePackage SqlQuery "
    "ApexApplication ApexPage ApexItem ApexRegion ApexProcess ApexValidation ApexButton JasperReport JasperField JasperParameter "
    "JasperVariable JasperSubreport MocaCommand MocaVariable JsonProperty XmlElement JavaScriptFunction PythonFunction Error Solution UnknownEntity"
).split()
RELATION_TYPES = (
    "FILE_CONTAINS_ENTITY QUERY_READS_TABLE QUERY_WRITES_TABLE QUERY_USES_COLUMN TABLE_HAS_COLUMN PROCEDURE_CALLS_PROCEDURE "
    "APEX_PAGE_CONTAINS_ITEM APEX_ITEM_MAPS_TO_COLUMN APEX_PROCESS_UPDATES_TABLE REPORT_USES_PARAMETER REPORT_USES_FIELD REPORT_QUERIES_TABLE "
    "REPORT_REFERENCES_IMAGE REPORT_INCLUDES_SUBREPORT MOCA_COMMAND_USES_VARIABLE ENTITY_DEFINED_IN_FILE ERROR_AFFECTS_ENTITY "
    "SOLUTION_RESOLVES_ERROR ENTITY_DEPENDS_ON_ENTITY ENTITY_MENTIONS_ENTITY TABLE_JOINS_TABLE"
).split()
#: Types whose names are compared without regard to case.
FOLDED_TYPES = tuple(t for t in ENTITY_TYPES if t.startswith(("Oracle", "Apex", "Moca")))
STRUCTURAL = ("FILE_CONTAINS_ENTITY", "ENTITY_DEFINED_IN_FILE")
READS = ("QUERY_READS_TABLE", "REPORT_QUERIES_TABLE")
WRITES = ("QUERY_WRITES_TABLE", "APEX_PROCESS_UPDATES_TABLE")
REVIEWABLE = ("OracleTable", "OracleView", "OracleColumn", "OracleProcedure", "OracleFunction", "ApexItem")
STATUSES = ("confirmed", "inferred", "manual")

CONFIRMED, STRONG, PROBABLE, MENTION = 1.0, 0.90, 0.65, 0.30

ENTITY = "id string, project_id string, identity_key string, entity_type string, name string, normalized_name string, qualified_name string, description string, source_file_id string, start_line int, end_line int, confidence double, status string, metadata map<string,string>"
RELATIONSHIP = "id string, project_id string, identity_key string, source_id string, target_id string, relation_type string, file_id string, start_line int, end_line int, snippet string, analyzer string, confidence double, status string, metadata map<string,string>"
EVIDENCE = "entity_id string, relationship_id string, file_id string, start_line int, end_line int, snippet string, original_name string, analyzer string, confidence double, status string, run_id string"
#: One row a draft: kind is entity, relationship or message. ``ends_here``: the same file names both ends of a relationship.
DRAFT = "path string, ordinal int, kind string, entity_type string, name string, schema string, container string, description string, relation_type string, target_type string, target_name string, target_schema string, target_container string, start_line int, end_line int, snippet string, analyzer string, confidence double, status string, severity string, code string, message string, metadata map<string,string>, ends_here boolean"
