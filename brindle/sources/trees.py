"""Source trees, configuration, line-JSON logs, and results as versioned folders."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.sources.commits import CommitLog, rotate

# Directories that are never read, and languages by suffix.
PRUNED = (".git", ".hg", ".svn", "node_modules", "dist", "build", "target", "__pycache__", ".venv", "venv", ".idea")
LANGUAGES = {
    "py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "json": "json", "xml": "xml", "css": "css", "html": "html", "md": "markdown", "yml": "yaml",
    "yaml": "yaml", "sql": "sql", "sh": "shell", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "kt": "kotlin", "scala": "scala", "vue": "vue", "toml": "toml", "properties": "properties",
}
MOST_BYTES = 500_000


def ignore_pattern(line: str) -> str | None:
    """One line of an ignore file as a regular expression on the whole path."""
    line = line.rstrip("\n").strip()
    if not line or line.startswith("#"):
        return None
    anchored = line.startswith("/") or "/" in line.rstrip("/")
    body, n, out = line.strip("/"), 0, ""
    while n < len(body):
        if body.startswith("**/", n):
            out, n = out + "(?:.*/)?", n + 3
        elif body.startswith("**", n):
            out, n = out + ".*", n + 2
        else:
            c = body[n]
            out, n = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), n + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if line.endswith("/") else "(?:/.*)?$")


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), suffix)


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every file under ``root`` with what becomes of it: ``path, language, size, mtime_ns,
    sha256, state, content``. ``state`` is ``eligible``, ``pruned``, ``excluded``,
    ``unsupported``, ``too_large``, ``binary`` or ``unsupported_encoding``; only eligible
    files have content. Nothing is left out silently."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    files = files.select(F.substring(path, len(str(Path(base).resolve())) + 2, 1 << 20).alias("path"), "modificationTime", "length", "content")
    patterns = [p for line in exclude or [] if (p := ignore_pattern(line))]
    wanted = [p for line in include or [] if (p := ignore_pattern(line))]
    parts = F.split("path", "/")
    pruned = F.exists(parts, lambda p: p.isin(*PRUNED) | (F.startswith(p, F.lit(".")) & (p != ".")))
    excluded = F.lit(False)
    if patterns:
        excluded = excluded | F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))
    if wanted:
        excluded = excluded | ~F.col("path").rlike("|".join(f"(?:{p})" for p in wanted))
    text = F.decode("content", "UTF-8")
    state = (
        F.when(pruned, "pruned")
        .when(excluded, "excluded")
        .when(language_of(F.col("path")).isNull(), "unsupported")
        .when(F.col("length") > most_bytes, "too_large")
        .when(F.contains(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), F.lit("\x00")), "binary")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "unsupported_encoding")
        .otherwise("eligible")
    )
    eligible = F.col("state") == "eligible"
    return files.withColumn("state", state).select(
        "path",
        language_of(F.col("path")).alias("language"),
        F.col("length").alias("size"),
        (F.unix_micros(F.col("modificationTime").cast("timestamp")) * 1000).alias("mtime_ns"),
        F.when(eligible, F.sha2("content", 256)).alias("sha256"),
        "state",
        F.when(eligible, text).alias("content"),
    )


def inventory(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("state").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def read_config(*paths: str) -> dict:
    """TOML files merged field by field, later ones over earlier ones; missing ones are empty."""

    def merge(low: dict, high: dict) -> dict:
        return low | {k: merge(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}

    merged: dict = {}
    for path in paths:
        if Path(path).exists():
            merged = merge(merged, tomllib.loads(Path(path).read_text()))
    return merged


def append_events(events: DataFrame, folder: str, most_bytes: int = 10 << 20) -> None:
    """Events as line-JSON; each call adds files and changes none. A folder that has grown
    beyond ``most_bytes`` is moved aside first."""
    rotate(events.sparkSession, folder, most_bytes)
    events.write.mode("append").json(folder)


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def result_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one compact JSON text and its size in bytes."""
    packed = rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
    return packed.withColumn("bytes", F.octet_length(name))


def packed_json(rows: DataFrame, group: str, place: str, budget: int) -> DataFrame:
    """Per group one compact JSON array of its rows in order of ``place``, as many as fit into
    ``budget`` bytes exactly, brackets and commas counted: ``group, json, bytes, items``.
    Keys are in the order of the columns."""
    fields = [c for c in rows.columns if c != group]
    items = rows.select(group, place, F.to_json(F.struct(*fields)).alias("_json")).withColumn("_bytes", F.octet_length("_json") + 1)
    running = F.sum("_bytes").over(Window.partitionBy(group).orderBy(place, "_json").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = items.withColumn("_total", running).filter(F.col("_total") + 1 <= budget)
    packed = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(place, "_json"))).alias("_items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("_items", lambda i: i["_json"]), ","), F.lit("]"))
    return packed.select(group, text.alias("json"), F.size("_items").alias("items")).withColumn("bytes", F.octet_length("json"))


def result_markdown(rows: DataFrame, most: int = 50) -> str:
    """A table for reading: the first ``most`` rows."""
    escape = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(escape(v) for v in row) + " |" for row in rows.take(most)]
    return "\n".join(lines)


class Publication:
    """Tables published together, as one version of a log: readers see all of a version
    or nothing of it, and no writer touches the files of another."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def version(self) -> int:
        return self.log.version()

    def publish(self, tables: dict[str, DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """Write the tables and commit them; tables of earlier versions that are not among
        ``tables`` are left out of the new one."""
        home = self.log.new_folder()
        for name, df in tables.items():
            df.write.parquet(f"{self.log.folder}/{home}/{name}")
        version, _ = self.log.change(lambda version, content: {name: f"{home}/{name}" for name in sorted(tables)}, before_commit=before_commit)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.log.version() if version is None else version
        if not version:
            raise FileNotFoundError("nothing is published yet")
        return self.spark.read.parquet(f"{self.log.folder}/{self.log.read(version)[name]}")
