"""Queries on chunks, tokens and project units, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import bounded_text, chunk_id, cjk_groups, distinct_lower, identifier_tokens
from brindle.operators import chunking
from brindle.sources.tables import table

#: Marker files of project units and their kinds.
MARKERS = {"pom.xml": "java", "package.json": "frontend", "pyproject.toml": "python", "go.mod": "go", "tsconfig.json": "frontend", "package-lock.json": "frontend"}


def b1_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 80 lines of every source file."""
    files = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id")
    return chunking.line_chunks(files, "path", "content").select("chunk_id", "file_id", "start_line", "end_line", F.length("content").cast("bigint").alias("chars"))


def b1_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 8 lines of every document."""
    docs = table(spark, d, "documents").select("doc_id", "path", "text")
    return chunking.line_chunks(docs, "path", "text", 8).select("chunk_id", "doc_id", "start_line", "end_line")


def b2_symbol_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Signals on the chunks they overlap."""
    files = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id")
    chunks = chunking.line_chunks(files, "path", "content").select("file_id", "path", "chunk_id", "start_line", "end_line")
    signals = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select(F.col("file_path").alias("path"), "signal_id", "start_line", "end_line").distinct()
    return chunking.overlapping(chunks, signals, "path").select("file_id", "chunk_id", "signal_id", "r_start", "r_end")


def b3_containing_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The first chunk that holds the start of a signal."""
    files = table(spark, d, "source_files").select("file_id", "path").join(table(spark, d, "file_texts"), "file_id")
    chunks = chunking.line_chunks(files, "path", "content").select("file_id", "path", F.col("chunk_id").alias("held_by"), "start_line", "end_line")
    signals = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select(F.col("file_path").alias("path"), "signal_id", "start_line", F.col("start_line").alias("end_line")).distinct()
    return chunking.overlapping(chunks, signals, "path").groupBy("file_id", "signal_id").agg(F.min_by("held_by", F.struct("start_line", "held_by")).alias("held_by"))


def b4_postings(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every document with their counts."""
    return chunking.postings(table(spark, d, "documents"), "doc_id", "text")


def b5_cjk_groups(spark: SparkSession, d: str) -> DataFrame:
    """CJK groups of words outside ASCII, counted per document."""
    words = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9]+|[\p{L}\p{N}]+"), 0))
    found = table(spark, d, "documents").select("doc_id", words.alias("word")).filter(F.col("word").rlike("[\\u3400-\\u9fff]"))
    return found.select("doc_id", F.explode(cjk_groups(F.col("word"))).alias("grp")).groupBy("doc_id", "grp").agg(F.count("*").alias("n"))


def b7_distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of signal names and tokens, in order of first occurrence."""
    tokens = F.concat(identifier_tokens(F.col("name")), F.coalesce("tokens", F.array().cast("array<string>")))
    return table(spark, d, "code_signals").select("signal_id", "recorded_at", F.array_join(distinct_lower(tokens), " ").alias("tokens")).distinct()


def b8_distinct_names(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a signal without repeats, letter case and order kept."""
    rows = table(spark, d, "code_signals").filter(F.col("tokens").isNotNull())
    return rows.select("signal_id", "recorded_at", F.array_join(F.array_distinct(F.array_compact("tokens")), " ").alias("tokens")).distinct()


def b20_module_signals(spark: SparkSession, d: str) -> DataFrame:
    """One module vertex per file, on its first chunk."""
    files = table(spark, d, "source_files").select("file_id", "repo_key", "path").join(table(spark, d, "file_texts"), "file_id")
    chunks = chunking.line_chunks(files, "path", "content")
    first = chunking.first_per_group(chunks, ["file_id"], ["start_line"], 1)
    return first.select("file_id", "chunk_id", F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/", ".").alias("name"), F.lit("module").alias("kind"))


def b22_capped_signals(spark: SparkSession, d: str) -> DataFrame:
    """At most 4,096 live signals per file, in source order."""
    live = table(spark, d, "code_signals").filter(F.col("deleted_at").isNull()).select("file_path", "signal_id", "start_line", "end_line").distinct()
    return chunking.first_per_group(live, ["file_path"], ["start_line", "end_line", "signal_id"], 4096).select("file_path", "signal_id", "position")


def b23_merged_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations of one id as one: occurrences, best confidence, first record."""
    live = table(spark, d, "code_relations").filter(F.col("deleted_at").isNull())
    return live.groupBy("relation_id").agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"), F.min(F.struct("recorded_at", "source_file_path"))["source_file_path"].alias("first_path"))


def b24_local_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a signal that its name bears out."""
    own = F.filter(F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.lower(t)), lambda t: F.contains(F.lower("name"), t) & (t != ""))
    return table(spark, d, "code_signals").select("signal_id", F.size(F.array_distinct(own)).alias("kept")).groupBy("signal_id").agg(F.max("kept").alias("kept"))


def b25_project_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.project_units(table(spark, d, "source_files"), MARKERS)


def b26_deepest_units(spark: SparkSession, d: str) -> DataFrame:
    """The deepest of the first-level directories and marked directories over a path."""
    files = table(spark, d, "source_files").select("repo_key", "path")
    units = chunking.project_units(table(spark, d, "source_files"), MARKERS).select("repo_key", "unit")
    firsts = files.filter(F.instr("path", "/") > 0).select("repo_key", F.substring_index("path", "/", 1).alias("unit"))
    return chunking.deepest_unit(files, units.unionByName(firsts).distinct())


def a16_request_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts as an embedding request sends them."""
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2(bounded_text(F.col("text")), 256).alias("digest"))


def b_chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identity of a whole document as one chunk."""
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", chunk_id(F.col("path"), F.lit(1), F.col("n_chars"), F.col("text")).alias("chunk_id"))


# --- SQL ---------------------------------------------------------------------------
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORDS = r"[A-Za-z0-9]+|[\p{L}\p{N}]+"


def sql_lines(text: str) -> str:
    parts = f"regexp_split_to_array({text}, '{BREAK}')"
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN []::VARCHAR[] WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def sql_tokens(text: str) -> str:
    spaced = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
    groups = "list_concat({0}, {1})".format(*[rf"list_filter(list_transform(range(1, length(w) - {n - 2}), lambda i: substring(w, i, {n})), lambda g: regexp_matches(g, '[\x{{3400}}-\x{{9fff}}]'))" for n in (2, 3)])
    return f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '{WORDS}'), lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN string_split(lower({spaced}), ' ') ELSE list_concat([w], {groups}) END))"


def sql_chunks(rows: str, key: str, max_lines: int) -> str:
    """Chunks of ``rows(key, path, text)`` as a common table ``chunks``."""
    return f"""lined AS (SELECT {key}, path, {sql_lines('text')} AS lines FROM {rows}),
windows AS (SELECT {key}, path, lines, unnest(range(1, len(lines) + 1, {max_lines})) AS s FROM lined),
cut AS (SELECT {key}, path, s::INT AS start_line, least(s + {max_lines - 1}, len(lines))::INT AS end_line, array_to_string(lines[s:s + {max_lines - 1}], chr(10)) AS content FROM windows),
chunks AS (SELECT *, sha256(path || ':' || start_line || '-' || end_line || ':' || sha256(content)[1:16]) AS chunk_id FROM cut)"""


SOURCE_TEXTS = "WITH files AS (SELECT f.file_id, f.path, t.content AS text FROM source_files f JOIN file_texts t USING (file_id)), "
LIVE_SIGNALS = "live AS (SELECT DISTINCT file_path AS path, signal_id, start_line, end_line FROM code_signals WHERE deleted_at IS NULL)"
UNITS = "marked AS (SELECT repo_key, regexp_replace(path, '/?[^/]*$', '') AS unit, CASE string_split(path, '/')[-1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKERS.items()) + " END AS kind FROM source_files), units AS (SELECT repo_key, unit, min(kind) AS kind FROM marked WHERE kind IS NOT NULL GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (b1_line_chunks, b1_document_chunks, b2_symbol_overlap, b3_containing_chunk, b4_postings, b5_cjk_groups, b7_distinct_tokens, b8_distinct_names, b20_module_signals, b22_capped_signals, b23_merged_relations, b24_local_tokens, b25_project_units, b26_deepest_units, a16_request_texts, b_chunk_ids)}

ORACLES = {
    "b1_line_chunks": SOURCE_TEXTS + sql_chunks("files", "file_id", 80) + " SELECT chunk_id, file_id, start_line, end_line, length(content) AS chars FROM chunks",
    "b1_document_chunks": "WITH " + sql_chunks("documents", "doc_id", 8) + " SELECT chunk_id, doc_id, start_line, end_line FROM chunks",
    "b2_symbol_overlap": SOURCE_TEXTS + sql_chunks("files", "file_id", 80) + ", " + LIVE_SIGNALS + " SELECT c.file_id, c.chunk_id, s.signal_id, s.start_line AS r_start, s.end_line AS r_end FROM chunks c JOIN live s ON s.path = c.path AND c.start_line <= s.end_line AND s.start_line <= c.end_line",
    "b3_containing_chunk": SOURCE_TEXTS + sql_chunks("files", "file_id", 80) + ", " + LIVE_SIGNALS + " SELECT c.file_id, s.signal_id, arg_min(c.chunk_id, (c.start_line, c.chunk_id)) AS held_by FROM chunks c JOIN live s ON s.path = c.path AND s.start_line BETWEEN c.start_line AND c.end_line GROUP BY c.file_id, s.signal_id",
    "b4_postings": f"WITH t AS (SELECT doc_id, list_transform({sql_tokens('text')}, lambda x: lower(x)) AS tokens FROM documents), p AS (SELECT doc_id, len(tokens) AS length, unnest(tokens) AS term FROM t) SELECT doc_id, term, count(*) AS tf, length FROM p GROUP BY ALL",
    "b5_cjk_groups": rf"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(w)), lambda i: substring(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)))) AS grp FROM w) SELECT doc_id, grp, count(*) AS n FROM g WHERE regexp_matches(grp, '[\x{{3400}}-\x{{9fff}}]') GROUP BY ALL",
    "b7_distinct_tokens": f"WITH t AS (SELECT signal_id, recorded_at, list_transform(list_concat({sql_tokens('name')}, coalesce(tokens, []::VARCHAR[])), lambda x: lower(x)) AS l FROM code_signals) SELECT DISTINCT signal_id, recorded_at, array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: (x, i)), lambda p: p[1] IS NOT NULL AND list_position(l, p[1]) = p[2]), lambda p: p[1]), ' ') AS tokens FROM t",
    "b8_distinct_names": "SELECT DISTINCT signal_id, recorded_at, array_to_string(list_filter(tokens, lambda x, i: x IS NOT NULL AND list_position(tokens, x) = i), ' ') AS tokens FROM code_signals WHERE tokens IS NOT NULL",
    "b20_module_signals": SOURCE_TEXTS + sql_chunks("files", "file_id", 80) + " SELECT file_id, chunk_id, replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.') AS name, 'module' AS kind FROM chunks WHERE start_line = 1",
    "b22_capped_signals": "WITH live AS (SELECT DISTINCT file_path, signal_id, start_line, end_line FROM code_signals WHERE deleted_at IS NULL) SELECT file_path, signal_id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, signal_id)::INT AS position FROM live QUALIFY position <= 4096",
    "b23_merged_relations": "SELECT relation_id, count(*) AS occurrences, max(confidence) AS confidence, min((recorded_at, source_file_path))[2] AS first_path FROM code_relations WHERE deleted_at IS NULL GROUP BY relation_id",
    "b24_local_tokens": "SELECT signal_id, max(len(list_distinct(list_filter(list_transform(coalesce(tokens, []::VARCHAR[]), lambda x: lower(x)), lambda x: x <> '' AND contains(lower(name), x)))))::INT AS kept FROM code_signals GROUP BY signal_id",
    "b25_project_units": "WITH " + UNITS + " SELECT * FROM units",
    "b26_deepest_units": "WITH " + UNITS + ", every AS (SELECT repo_key, unit FROM units UNION SELECT repo_key, string_split(path, '/')[1] FROM source_files WHERE contains(path, '/')) SELECT f.repo_key, f.path, coalesce(arg_max(e.unit, length(e.unit)), '') AS unit FROM source_files f LEFT JOIN every e ON e.repo_key = f.repo_key AND (e.unit = '' OR starts_with(f.path, e.unit || '/')) GROUP BY f.repo_key, f.path",
    "a16_request_texts": "SELECT doc_id, sha256(CASE WHEN length(text) > 2000 THEN text[1:1500] || chr(10) || right(text, 499) ELSE text END) AS digest FROM documents WHERE text IS NOT NULL",
    "b_chunk_ids": "SELECT doc_id, sha256(path || ':1-' || n_chars || ':' || sha256(text)[1:16]) AS chunk_id FROM documents WHERE text IS NOT NULL",
}
