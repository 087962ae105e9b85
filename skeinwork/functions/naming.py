"""Names, keys and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FOLDED_TYPES


def normalize_name(name: Column, entity_type: Column) -> Column:
    """One layer of double quotes and extra white space removed; upper case where case doesn't matter."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(name), r'^"(.*)"$', "$1")), r"\s+", " ")
    return F.when(entity_type.isin(*FOLDED_TYPES), F.upper(bare)).otherwise(bare)


def identity_key(entity_type: Column, schema: Column, container: Column, normalized: Column) -> Column:
    """type|schema|container|name. An unknown part is empty, and so never equals a known one."""
    part = lambda c: F.when(entity_type.isin(*FOLDED_TYPES), F.upper(F.coalesce(c, F.lit("")))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws("|", entity_type, part(schema), part(container), F.coalesce(normalized, F.lit("")))


def relationship_key(source: Column, relation: Column, target: Column, file_id: Column) -> Column:
    return F.concat_ws("|", source, relation, target, F.coalesce(file_id, F.lit("")))


def claim_key(source_key: Column, relation: Column, target_key: Column) -> Column:
    """The same claim whatever file it stands in."""
    return F.concat_ws("|", source_key, relation, target_key)


def content_id(project: Column, key: Column) -> Column:
    """A stable id: the same entity has it in every run."""
    return F.sha2(F.concat_ws("|", project, key), 256)


def file_id(project: Column, path: Column) -> Column:
    """A file's id: every scan of the same project gives a path the same one."""
    return content_id(project, F.concat(F.lit("file|"), path))


def qualified_parts(qualified: Column) -> Column:
    """(owner, name), split at the last dot; owner is empty without one."""
    return F.struct(F.regexp_extract(qualified, r"^(.*)\.[^.]*$", 1).alias("owner"), F.regexp_extract(qualified, r"([^.]*)$", 1).alias("name"))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), r"^/+|/+$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for names without one."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 1.0, "confirmed").when(confidence >= 0.8, "strong").when(confidence >= 0.5, "probable").otherwise("low")


def valid_ulid(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$"), F.lit(False))


def ulid_millis(value: Column) -> Column:
    """Milliseconds since 1970 that a ULID starts with: ten base-32 digits."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.instr(F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), F.substring(value, i, F.lit(1))) - 1)
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, x: a * 32 + x)
