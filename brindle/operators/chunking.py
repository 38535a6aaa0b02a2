"""Files to line-window chunks, tokens and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.text import chunk_id, distinct_lower, identifier_tokens, text_lines
from brindle.session import spread

MAX_LINES = 80


def line_chunks(files: DataFrame, path: str, text: str, max_lines: int = MAX_LINES) -> DataFrame:
    """Windows of ``max_lines`` lines that do not overlap: the columns of ``files`` but the
    text, and ``chunk_id, start_line, end_line, content``. Empty text has no chunk. The
    windows of a file are made where it is read, without a shuffle."""
    lines = files.withColumn("_lines", text_lines(F.col(text)))
    starts = F.when(F.size("_lines") > 0, F.sequence(F.lit(1), F.size("_lines"), F.lit(max_lines))).otherwise(F.array().cast("array<int>"))
    windows = lines.withColumn("start_line", F.explode(starts))
    windows = windows.withColumn("end_line", F.least(F.col("start_line") + (max_lines - 1), F.size("_lines")))
    content = F.array_join(F.slice("_lines", F.col("start_line"), F.lit(max_lines)), "\n")
    named = windows.withColumn("content", content).drop("_lines", *([text] if text != "content" else []))
    return named.withColumn("chunk_id", chunk_id(F.col(path), F.col("start_line"), F.col("end_line"), F.col("content")))


def chunk_tokens(path: Column, content: Column) -> Column:
    """Distinct tokens of content and path, small letters, in order."""
    return distinct_lower(F.concat(identifier_tokens(content), identifier_tokens(path)))


def token_lists(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens``: the tokens of each text in small letters. The list is handed on as a
    generated column, so that what reads it twice does not take the text apart twice."""
    tokens = F.transform(identifier_tokens(F.col(text)), lambda t: F.lower(t))
    return spread(texts.select(key, text), key).select(key, F.explode(F.array(tokens)).alias("tokens"))


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, length``: term counts merge before the shuffle; ``length`` is the
    number of tokens of the text. Tokens are in small letters."""
    counted = token_lists(texts, key, text)
    return counted.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").cast("bigint").alias("length"))


def embedding_text(content: Column, tokens: Column) -> Column:
    return F.concat(content, F.lit("\n\n"), F.array_join(tokens, " "))


def first_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """At most ``most`` rows of a group, in a total order; Spark cuts before it shuffles."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("position") <= most)


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int = MAX_LINES) -> DataFrame:
    """Pairs of line intervals of one ``key`` that overlap. Both sides have ``start_line,
    end_line``; the right ones are renamed ``r_start, r_end``. Intervals are joined on the
    blocks of ``bucket`` lines they touch, so a long file is no single group; a pair
    counts in the block where the later one starts."""
    def spread(df: DataFrame, low: str, high: str) -> DataFrame:
        blocks = F.sequence(F.floor(F.col(low) / bucket), F.floor(F.greatest(F.col(high), F.col(low)) / bucket))
        return df.withColumn("_block", F.explode(blocks))

    named = right.withColumnsRenamed({"start_line": "r_start", "end_line": "r_end"})
    joined = spread(left, "start_line", "end_line").join(spread(named, "r_start", "r_end"), [key, "_block"])
    meets = (F.col("start_line") <= F.col("r_end")) & (F.col("r_start") <= F.col("end_line"))
    once = F.col("_block") == F.floor(F.greatest("start_line", "r_start") / bucket)
    return joined.filter(meets & once).drop("_block")


def project_units(files: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Directories that hold a marker file: ``repo_key, unit, kind``. ``markers`` maps a file
    name to the kind of its project."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(markers.items()) for x in pair]), name)
    unit = F.regexp_replace("path", "/?[^/]*$", "")
    return files.select("repo_key", unit.alias("unit"), kind.alias("kind")).filter(F.col("kind").isNotNull()).groupBy("repo_key", "unit").agg(F.min("kind").alias("kind"))


def ancestors(path: Column) -> Column:
    """All directories over a path, the root (empty) first."""
    parts = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def deepest_unit(files: DataFrame, units: DataFrame) -> DataFrame:
    """``repo_key, path, unit``: the deepest unit a path lies in, the root where none does.
    Paths are joined on their ancestors, not by prefix comparison."""
    spread = files.select("repo_key", "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "unit"))
    found = spread.join(units.select("repo_key", "unit"), ["repo_key", "unit"], "left_semi")
    best = found.groupBy("repo_key", "path").agg(F.max_by("unit", "depth").alias("unit"))
    return files.select("repo_key", "path").join(best, ["repo_key", "path"], "left").withColumn("unit", F.coalesce("unit", F.lit("")))
