"""A full index build from a source tree, published as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import chunking, extract
from brindle.session import cut_lineage
from brindle.sources import trees
from brindle.sources.commits import WriterLock


def build_index(spark: SparkSession, root: str, index: str, include: list[str] | None = None, exclude: list[str] | None = None) -> int:
    """Scan ``root`` and publish the tables of its index under ``index``: ``files`` (with what
    became of every file), ``chunks``, ``postings`` of the chunks, and ``facts``. Returns the
    version. One writer at a time; readers see the version before until the new one is
    whole, and a build that dies leaves nothing that they read."""
    with WriterLock(spark, index):
        scanned = cut_lineage(trees.scan_tree(spark, root, include, exclude))
        texts = scanned.filter(F.col("state") == "eligible").select("path", "language", "content")
        chunks = cut_lineage(chunking.line_chunks(texts, "path", "content"))
        tokens = chunks.select("chunk_id", F.concat_ws("\n", "path", "content").alias("text"))
        tables = {
            "files": scanned.drop("content"),
            "chunks": chunks,
            "postings": chunking.postings(tokens, "chunk_id", "text"),
            "facts": extract.facts(texts),
        }
        return trees.Publication(spark, index).publish(tables)


def index_stats(spark: SparkSession, index: str) -> DataFrame:
    """Rows of every table of the newest version."""
    published = trees.Publication(spark, index)
    rows = [published.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in ("files", "chunks", "postings", "facts")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
