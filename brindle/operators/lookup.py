"""Point lookups, profile aggregates and integrity counts over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("deleted_at").isNull())


def directory(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def siblings(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files of the same repository and directory as each wanted path, itself left out."""
    near = paths.select("repo_key", F.col("path").alias("sibling"), directory(F.col("path")).alias("folder"))
    return wanted.select("repo_key", "path", directory(F.col("path")).alias("folder")).join(near, ["repo_key", "folder"]).filter(F.col("path") != F.col("sibling"))


def spans_at(points: DataFrame, spans: DataFrame, key: str, bucket: int = 64) -> DataFrame:
    """The narrowest, latest span over each point. ``points`` has ``key, line``; ``spans`` has
    ``key, start_line, end_line, signal_id``. Joined on blocks of lines, not per file."""
    blocks = F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.greatest("end_line", "start_line") / bucket)))
    spread = spans.withColumn("_block", blocks)
    joined = points.withColumn("_block", F.floor(F.col("line") / bucket)).join(spread, [key, "_block"]).filter((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line")))
    return joined.groupBy(key, "line").agg(F.min(F.struct((-F.col("start_line")).alias("s"), "end_line", "signal_id"))["signal_id"].alias("signal_id"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language; known languages first, then by number and name."""
    known = F.when(F.lower("language").isin("java", "python", "typescript", "javascript", "go"), 0).otherwise(1)
    counted = files.groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("files"))
    order = Window.orderBy(known, F.desc("files"), "language")  # one row per language
    return counted.withColumn("position", F.row_number().over(order))


def profile_files(files: DataFrame, signals: DataFrame, most: int = 16) -> DataFrame:
    """Files that tell most about each repository: hand-written before generated, no tests,
    many symbols, short paths."""
    symbols = live(signals).groupBy(F.col("file_path").alias("path")).agg(F.count_distinct("name").alias("symbols"))
    joined = files.join(symbols, "path", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    order = [F.coalesce("is_generated", F.lit(False)), F.coalesce("is_test", F.lit(False)), F.desc("symbols"), F.length("path"), "path"]
    return joined.withColumn("position", F.row_number().over(Window.partitionBy("repo_key").orderBy(*order))).filter(F.col("position") <= most).select("repo_key", "path", "symbols", "position")


def top_counts(rows: DataFrame, group: str, value: str, most: int) -> DataFrame:
    """The commonest values of each group with their counts, ties by value."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return counted.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def edges(relations: DataFrame, signals: DataFrame, side: str, most: int = 65) -> DataFrame:
    """The heaviest live resolved edges at each live signal, at most ``most``. ``side`` is the
    end that is looked up: ``source`` for outgoing, ``target`` for incoming."""
    from brindle.operators.graph import effective_confidence, kind_weight

    ids = live(signals).select("signal_id").distinct()
    end = f"{side}_signal_id"
    resolved = live(relations).filter(F.col("resolution").isin("resolved_exact", "resolved_unique"))
    weighted = resolved.select(F.col(end).alias("signal_id"), "relation_id", "kind", F.round(effective_confidence() * F.coalesce(kind_weight(), F.lit(0.0)), 6).alias("weight")).distinct()
    held = weighted.join(ids, "signal_id", "left_semi")
    order = Window.partitionBy("signal_id").orderBy(F.desc("weight"), "kind", "relation_id")
    return held.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)


def chunks_for_ids(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks by id in the order asked for: ``wanted`` has ``query_id, chunk_id, place``. Ids
    asked for twice come at their first place; unknown ones are left out."""
    first = wanted.groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy("place", "chunk_id")
    return first.join(chunks, "chunk_id").withColumn("place", F.row_number().over(order))
