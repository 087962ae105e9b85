"""Folders of source files as an inventory table."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import extension
from .folder_scan import FORMAT, ProjectFolder, inside

# File types by extension. Error, trace and output files count as logs.
TYPES = {
    "sql": ".sql .vw", "plsql": ".pls .plsql .pks .pkb .prc .fnc .trg .spc .bdy", "moca": ".mcmd .moca .mcom", "jrxml": ".jrxml", "jasper-compiled": ".jasper",
    "xml": ".xml .xsd .xsl .xslt", "json": ".json .jsonc", "yaml": ".yaml .yml", "csv": ".csv", "properties": ".properties .ini .cfg .toml", "javascript": ".js .mjs .cjs .jsx",
    "typescript": ".ts .tsx", "python": ".py", "java": ".java", "shell": ".sh", "batch": ".bat", "powershell": ".ps1", "markdown": ".md .markdown", "text": ".txt",
    "log": ".log .err .trc .out", "html": ".html .htm", "css": ".css", "image": ".png .jpg .jpeg .gif .bmp .svg .ico", "document": ".pdf .docx", "spreadsheet": ".xlsx .xls", "archive": ".zip .jar",
}
BINARY = ("jasper-compiled", "image", "document", "spreadsheet", "archive")
ANALYZABLE = ("sql", "plsql", "moca", "jrxml", "json", "javascript", "typescript", "python", "log", "xml", "text")
SNIFF = 8192


@dataclass(frozen=True)
class ScanPolicy:
    # What a scan passes over unless told otherwise.
    ignored_directories: tuple[str, ...] = (".git", "node_modules", "target", "dist", "build", ".next", ".venv", "venv", "__pycache__", ".idea", ".vscode", "coverage")
    ignored_files: tuple[str, ...] = ("*.pyc", "*.pyo", "*.class", "*.o", "*.so", "*.dll", "*.exe", "*.lock", ".DS_Store", "Thumbs.db")
    max_bytes: int = 5 * 1024 * 1024
    max_depth: int = 24
    hash_binaries: bool = True
    follow_symlinks: bool = False
    extra_ignored_directories: tuple[str, ...] = ()

    def __post_init__(self):
        if self.max_bytes <= 0 or self.max_depth <= 0:
            raise ValueError("limits must be above zero")

    @classmethod
    def from_dict(cls, settings: dict | None) -> ScanPolicy:
        """A policy from stored settings; names that it doesn't know are passed over."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in (settings or {}).items() if k in known and v is not None})

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


def detect_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kind, exts in TYPES.items() for ext in exts.split() for x in (ext, kind)])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.lit("unknown"))


def looks_binary(content: Column, kind: Column) -> Column:
    """A NUL in the first bytes, or a type that is binary by nature."""
    return F.contains(F.substring(content, 1, SNIFF), F.lit(b"\x00")) | kind.isin(*BINARY)


#: Bytes 80 to 9F that Windows-1252 gives a character other than their Latin-1 control, and those it leaves out.
_C1 = {i: bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
_WINDOWS = {i: c for i, c in _C1.items() if c}


def decode(content: Column) -> Column:
    """UTF-8 with or without a mark, else Windows-1252, else (with a byte that it leaves out) Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))
    other = F.when(latin.rlike("[" + "".join(f"\\x{i:02x}" for i in _C1 if i not in _WINDOWS) + "]"), latin).otherwise(windows)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(other)
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def classify(files: DataFrame, policy: ScanPolicy = ScanPolicy()) -> DataFrame:
    """files (path, size_bytes, content) with detected_type, skip_reason and content_hash; passed-over
    paths are left out, skipped ones stay with their reason."""
    names = "|".join(fnmatch.translate(g) for g in policy.ignored_files)
    dirs = "|".join(re.escape(d) for d in (*policy.ignored_directories, *policy.extra_ignored_directories))
    rows = files.where(~F.col("path").rlike(rf"(^|/)({dirs})/") & ~F.regexp_extract("path", r"([^/]*)$", 1).rlike(names.replace("(?s:", "(?:").replace(r"\z", "$").replace(r"\Z", "$")))
    rows = rows.withColumn("detected_type", detect_type(F.col("path")))
    deep = F.size(F.split("path", "/")) - 1 > policy.max_depth
    reason = F.when(deep, "too_deep").when(F.col("size_bytes") > policy.max_bytes, "too_large").when(F.col("content").isNull(), "unreadable").when(looks_binary(F.col("content"), F.col("detected_type")), "binary")
    rows = rows.withColumn("skip_reason", F.coalesce("skip_reason", reason) if "skip_reason" in rows.columns else reason)
    hashed = F.col("skip_reason").isNull() | ((F.col("skip_reason") == "binary") & F.lit(policy.hash_binaries))
    return rows.withColumn("content_hash", F.when(hashed, F.sha2("content", 256)))


def scan(spark: SparkSession, root: str, policy: ScanPolicy = ScanPolicy(), shares: int | None = None) -> DataFrame:
    """Inventory of a folder. Files over the size limit are listed without being read.

    A folder that all machines see under the same path is listed level by level, by the policy; any other
    file system's folders are listed whole by Spark and then filtered.
    """
    if re.match(r"[a-zA-Z][\w+.-]+:", root) and not root.startswith("file:"):
        return _scan_elsewhere(spark, root, policy)
    spark.dataSource.register(ProjectFolder)
    read = spark.read.format(FORMAT).option("root", project_root(re.sub("^file:/*", "/", root))).option("policy", json.dumps(policy.to_dict()))
    return classify((read.option("shares", str(shares)) if shares else read).load(), policy)


def _scan_elsewhere(spark: SparkSession, root: str, policy: ScanPolicy) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring("path", F.length(F.lit(root.rstrip("/"))) + 2, F.length("path"))
    cut = lambda rows, content: rows.select(relative.alias("path"), F.col("path").alias("absolute_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), content.alias("content"))
    small, large = F.col("length") <= policy.max_bytes, F.col("length") > policy.max_bytes
    return classify(cut(read.where(small), F.col("content")).unionByName(cut(read.where(large), F.lit(None).cast("binary"))), policy)


def project_root(root: str) -> str:
    """The real folder that ``root`` names; it must exist. For folders of this machine, before they are listed."""
    real = os.path.realpath(os.path.expanduser(root.removeprefix("file://")))
    if not os.path.isdir(real):
        raise ValueError(f"{root} is no folder")
    return real


def is_within(root: str, path: str) -> bool:
    """``path``, links followed, lies in ``root`` or is it; by folders, not by the beginning of the text."""
    return inside(os.path.realpath(root), path)


def read_file(spark: SparkSession, root: str, path: str, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """(path, text, truncated) of one file of a project, at most ``max_bytes`` of it."""
    real = os.path.join(project_root(root), path)
    if not is_within(root, real):
        raise ValueError(f"{path} lies outside the project")
    found = spark.read.format("binaryFile").load(f"file://{real}")
    return found.select(F.lit(path).alias("path"), decode(F.substring("content", 1, max_bytes)).alias("text"), (F.col("length") > max_bytes).alias("truncated"))


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """An inventory that someone else scanned."""
    return spark.createDataFrame(records, "path string, size_bytes bigint, content_hash string, detected_type string, skip_reason string")


def guess_project_type(inventory: DataFrame) -> DataFrame:
    """One row: what kind of project the mix of types makes."""
    n = lambda *t: F.count_if(F.col("detected_type").isin(*t))
    mix = inventory.agg(n("sql", "plsql").alias("oracle"), n("jrxml", "jasper-compiled").alias("jasper"), n("moca").alias("moca"), n("javascript", "typescript", "python").alias("code"), F.countDistinct("detected_type").alias("kinds"))
    best = F.greatest("oracle", "jasper", "moca", "code")
    both = (F.col("oracle") > 0) & (F.col("jasper") > 0) & (F.abs(F.col("oracle") - F.col("jasper")) < F.greatest("oracle", "jasper") * 0.5)
    top = F.when(F.col("moca") == best, "blue-yonder-moca").when(F.col("jasper") == best, "jasper-reports").when(F.col("oracle") == best, "oracle-apex").otherwise("application-code")
    return mix.select(F.when(best == 0, F.when(F.col("kinds") > 1, "mixed").otherwise("unknown")).when(both, "oracle-jasper").otherwise(top).alias("project_type"))


def file_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """(node, parent, depth, is_dir, n_files) of every file and of every folder above one."""
    parts = F.split(F.col(path), "/")
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.alias("depth"), (i < F.size(parts)).alias("is_dir")))).alias("x")).select("x.*")
    out = nodes.groupBy("node", "depth", "is_dir").agg(F.count("*").alias("n_files"))
    return out.withColumn("parent", F.regexp_extract("node", r"^(.*)/[^/]*$", 1))
