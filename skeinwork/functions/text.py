"""Text positions, signatures and SQL noise as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 600


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.length(F.substring(text, F.lit(1), offset)) - F.length(F.translate(F.substring(text, F.lit(1), offset), "\n", "")) + 1


def lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive."""
    return F.array_join(F.slice(F.split(text, "\n"), start, end - start + 1), "\n")


def snippet(text: Column) -> Column:
    return F.when(F.length(text) > SNIPPET, F.concat(F.substring(text, 1, SNIPPET - 1), F.lit("…"))).otherwise(text)


def signature(message: Column) -> Column:
    """A message with its numbers taken out."""
    return F.regexp_replace(message, r"\d+", "#")


def blank_noise(sql: Column) -> Column:
    """Comments and string literals as spaces of the same length; line ends stay."""
    piece = r"(?s)--[^\n]*+|/\*.*?(?:\*/|\z)|'(?:[^']++|'')*+(?:'|\z)|[^-/']++|."
    noise = r"(?s)^(--.*|/\*.*|'.*)$"
    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(piece), F.lit(0)), lambda x: F.when(x.rlike(noise), F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; anything else separates, the underscore too."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / 1024**3, 1), F.lit(" GB")))
    )


def json_object(text: Column) -> Column:
    """The top level of a JSON object as a map of texts; empty for null, broken JSON or anything else."""
    return F.coalesce(F.from_json(F.when(F.get_json_object(text, "$").rlike(r"^\s*\{"), text), "map<string,string>"), F.create_map().cast("map<string,string>"))
