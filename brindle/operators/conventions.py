"""Tests and the production files that conventions of paths tie them to, per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Suffixes of script files, and directories whose files are no targets.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue")
NO_TARGET = r"(?:^|/)(?:__generated__|__snapshots__|fixtures?|generated|goldens?|snapshots?|test-data|test_data|testdata)/"


def is_test_path(path: Column) -> Column:
    """Whether the name of a file, or its place, says that it is a test of its language; the
    path is relative to its project unit."""
    return (
        path.rlike(r"[^/](?:ITCase|Tests|Test|IT)\.java$")
        | path.rlike(r"[^/]_test\.go$")
        | path.rlike(r"[^/]_tests?\.rs$|^tests/.*\.rs$")
        | path.rlike(r"(?:^|/)test_[^/]+\.py$|[^/]_test\.py$")
        | path.rlike(r"[^/]\.(?:test|spec)\.(?:tsx?|jsx?|vue)$")
    )


def production_candidates(path: Column) -> Column:
    """Sorted paths, relative to the project unit, that a test may be about; empty for what is
    no test or is laid out otherwise."""
    none = F.array().cast("array<string>")
    swap = lambda p, pattern, by: F.regexp_replace(p, pattern, by)
    java = F.when(path.rlike(r"^src/test/java/(?:.*/)?[^/]+(?:ITCase|Tests|Test|IT)\.java$"), F.array(swap(swap(path, r"(?:ITCase|Tests|Test|IT)\.java$", ".java"), "^src/test/", "src/main/")))
    go = F.when(path.rlike(r"[^/]_test\.go$"), F.array(swap(path, r"_test\.go$", ".go")))
    rust = F.when(path.rlike(r"[^/]_tests?\.rs$|^tests/.*\.rs$"), F.array_compact(F.array(F.when(path.rlike(r"[^/]_tests?\.rs$"), swap(path, r"_tests?\.rs$", ".rs")), F.when(path.rlike("^tests/"), swap(path, "^tests/", "src/")))))
    nested = path.rlike("^[^/]+/(?:.*/)?tests/")
    bare = F.array_compact(F.array(F.when(path.rlike(r"(?:^|/)test_[^/]+\.py$"), swap(path, r"(^|/)test_([^/]+)$", "$1$2")), F.when(path.rlike(r"[^/]_test\.py$"), swap(path, r"_test\.py$", ".py"))))
    moved = lambda paths: F.flatten(F.transform(paths, lambda p: F.when(p.rlike("^tests/"), F.array(swap(p, "^tests/", ""), swap(p, "^tests/", "src/"))).otherwise(F.array(p))))
    python = F.when(path.rlike(r"(?:^|/)test_[^/]+\.py$|[^/]_test\.py$") & ~nested, moved(bare))
    stem = swap(path, r"\.(?:test|spec)\.(?:tsx?|jsx?|vue)$", "")
    twice = path.rlike("(?:^|/)__tests__/(?:.*/)?__tests__/")
    bases = F.when(path.rlike("(?:^|/)__tests__/"), F.array(swap(stem, "(^|/)__tests__/", "$1"))).otherwise(moved(F.array(stem)))
    script = F.when(path.rlike(r"[^/]\.(?:test|spec)\.(?:tsx?|jsx?|vue)$") & ~nested & ~twice, F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(s)) for s in SCRIPT_SUFFIXES]))))
    return F.array_sort(F.array_distinct(F.coalesce(java, go, rust, python, script, none)))


def test_targets(files: DataFrame, most: int = 8) -> DataFrame:
    """Tests and the one existing file their convention leads to: ``repo_key, test_path, path,
    confidence``. ``files`` has ``repo_key, unit, path, is_test, is_generated`` with paths
    relative to the unit. A test whose candidates exist more than once is left out, and so
    are targets that are tests, generated, or in directories of fixtures."""
    tests = files.filter(is_test_path(F.col("path"))).select("repo_key", "unit", F.col("path").alias("test_path"), F.explode(production_candidates(F.col("path"))).alias("path")).distinct()
    plain = ~is_test_path(F.col("path")) & ~F.coalesce("is_test", F.lit(False)) & ~F.coalesce("is_generated", F.lit(False)) & ~F.lower("path").rlike(NO_TARGET)
    targets = files.filter(plain).select("repo_key", "unit", "path").distinct()
    found = tests.join(targets, ["repo_key", "unit", "path"])
    single = found.withColumn("n", F.count("*").over(Window.partitionBy("repo_key", "unit", "test_path"))).filter("n = 1")
    order = Window.partitionBy("repo_key", "unit", "test_path").orderBy("path")
    return single.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most).select("repo_key", "unit", "test_path", "path", F.lit(0.95).alias("confidence"))
