"""Facts from source texts: declarations, imports, endpoints, routes, statements."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, qualified_name string, start_line int, end_line int, target string"

JAVA_TYPE = re.compile(r"^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+(\w+)(?:[^{;]*?\bextends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*[({]", re.M)
JAVA_METHOD = re.compile(r"^[ \t]+(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s+)?([\w.<>,\[\] ?]+?)\s+(\w+)\s*\(([^)]*)\)[^;{]*\{", re.M)
JAVA_IMPORT = re.compile(r"^import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", re.M)
JAVA_PACKAGE = re.compile(r"^package\s+([\w.]+)\s*;", re.M)
JAVA_ROUTE = re.compile(r"@(Request|Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?[{\s]*\"([^\"]*)\"")
SCRIPT_IMPORT = re.compile(r"(?:import\s+(?:[\w*{}\s,$]+\s+from\s+)?|export\s+[\w*{}\s,$]+\s+from\s+|require\(\s*|import\(\s*)['\"]([^'\"]+)['\"]")
SCRIPT_DECLARATION = re.compile(r"^export\s+(?:default\s+)?(?:async\s+)?(function|class|interface|const|let|type|enum)\s*\*?\s*([\w$]+)", re.M)
SCRIPT_ROUTE = re.compile(r"\bpath\s*:\s*['\"]([^'\"]+)['\"]")
STATEMENT = re.compile(r"<(select|insert|update|delete)\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"']")
NAMESPACE = re.compile(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"']")
GO_DECLARATION = re.compile(r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", re.M)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def joined_route(*parts: str) -> str:
    """Class and method routes as one path."""
    return "/" + "/".join(p.strip("/") for p in parts if p.strip("/"))


def java_facts(text: str) -> Iterator[tuple]:
    package = m.group(1) if (m := JAVA_PACKAGE.search(text)) else ""
    types = [(m.start(), m.group(2)) for m in JAVA_TYPE.finditer(text)]

    def owner(at: int) -> str:
        return ".".join(filter(None, [package, next((n for s, n in reversed(types) if s < at), "")]))

    for m in JAVA_IMPORT.finditer(text):
        yield "imports", m.group(2).rsplit(".", 1)[-1], m.group(2), _line(text, m.start()), _line(text, m.end()), m.group(2)
    for m in JAVA_TYPE.finditer(text):
        name = ".".join(filter(None, [package, m.group(2)]))
        yield "type", m.group(2), name, _line(text, m.start()), _line(text, m.end()), None
        for base in (m.group(4) or "").split(","):
            if base.strip():
                yield "implements", m.group(2), name, _line(text, m.start()), _line(text, m.end()), re.sub(r"<.*", "", base.strip())
    first = types[0][0] if types else 0
    prefix = next((m.group(2) for m in JAVA_ROUTE.finditer(text) if m.start() < first), "")
    for m in JAVA_METHOD.finditer(text):
        yield "method", m.group(2), f"{owner(m.start())}.{m.group(2)}", _line(text, m.start()), _line(text, m.end()), None
    for m in JAVA_ROUTE.finditer(text):
        if m.start() > first:
            yield "endpoint", m.group(1).upper(), joined_route(prefix, m.group(2)), _line(text, m.start()), _line(text, m.end()), None


def script_facts(text: str) -> Iterator[tuple]:
    for m in SCRIPT_IMPORT.finditer(text):
        yield "imports", m.group(1), m.group(1), _line(text, m.start()), _line(text, m.end()), m.group(1)
    for m in SCRIPT_DECLARATION.finditer(text):
        kind = {"class": "type", "interface": "type", "type": "type", "enum": "type", "function": "function"}.get(m.group(1), "variable")
        yield kind, m.group(2), m.group(2), _line(text, m.start()), _line(text, m.end()), None
    for m in SCRIPT_ROUTE.finditer(text):
        yield "route", m.group(1), m.group(1), _line(text, m.start()), _line(text, m.end()), None


def python_facts(text: str) -> Iterator[tuple]:
    """From the syntax tree; a file that has none gives no facts."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    todo = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            end = getattr(child, "end_lineno", None)
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                yield "type" if isinstance(child, ast.ClassDef) else "function", child.name, name, child.lineno, end, None
                todo.append((child, name))
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield "imports", a.asname or a.name, a.name, child.lineno, end, a.name
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                for a in child.names:
                    yield "imports", a.asname or a.name, f"{module}.{a.name}".replace("..", "."), child.lineno, end, module
            elif isinstance(child, ast.Assign) and node is tree:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        yield "variable", t.id, t.id, child.lineno, end, None
            else:
                todo.append((child, owner))


def statement_facts(text: str) -> Iterator[tuple]:
    space = m.group(1) if (m := NAMESPACE.search(text)) else ""
    for m in STATEMENT.finditer(text):
        name = ".".join(filter(None, [space, m.group(2)]))
        yield "mybatis_statement", m.group(2), name, _line(text, m.start()), _line(text, m.end()), None
        if space:
            yield "mapped_by", m.group(2), name, _line(text, m.start()), _line(text, m.end()), name


def go_facts(text: str) -> Iterator[tuple]:
    for m in GO_DECLARATION.finditer(text):
        yield "function" if m.group().startswith("func") else "type", m.group(1), m.group(1), _line(text, m.start()), _line(text, m.end()), None


PRODUCERS = {"java": java_facts, "py": python_facts, "js": script_facts, "ts": script_facts, "vue": script_facts, "jsx": script_facts, "tsx": script_facts, "xml": statement_facts, "go": go_facts}


def register(suffix: str, producer) -> None:
    """Adds a producer of facts for files of a suffix: a function of the text that yields
    ``kind, name, qualified_name, start_line, end_line, target``."""
    PRODUCERS[suffix] = producer


def facts(files: DataFrame) -> DataFrame:
    """Facts of every file by the producer of its suffix. ``files`` has ``path, content``;
    null texts and unknown suffixes give none. Files are read where they lie."""
    producers = dict(PRODUCERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                producer = producers.get((path or "").rsplit(".", 1)[-1].lower())
                if producer and content:
                    rows.extend((path, *fact) for fact in producer(content))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "qualified_name", "start_line", "end_line", "target"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


# Suffixes and index files that a module selector of a script may stand for.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".json")


def script_candidates(path: str, selector: str) -> list[str]:
    """Paths a module selector may mean, most specific first; none for packages and for
    what lies above the root."""
    if selector.startswith("@/"):
        base = ["src", *selector[2:].split("/")]
    elif selector.startswith("."):
        base = path.split("/")[:-1] + selector.split("/")
    else:
        return []
    parts: list[str] = []
    for p in base:
        if p == "..":
            if not parts:
                return []
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    target = "/".join(parts)
    if target.endswith(SCRIPT_SUFFIXES):
        return [target]
    return [target + s for s in SCRIPT_SUFFIXES] + [f"{target}/index{s}" for s in SCRIPT_SUFFIXES[:4]]


def _all_candidates(paths: pd.Series, selectors: pd.Series) -> pd.Series:
    return pd.Series([script_candidates(p, s) for p, s in zip(paths, selectors)], dtype=object)


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports of scripts resolved to files: ``path, selector, target``, the most
    specific candidate that exists. Candidates are joined, not probed one by one."""
    candidates = F.pandas_udf(_all_candidates, "array<string>")
    imports = found.filter((F.col("kind") == "imports") & F.col("path").rlike(r"\.(ts|tsx|js|jsx|vue)$")).select("path", F.col("target").alias("selector")).distinct()
    spread = imports.select("path", "selector", F.posexplode(candidates("path", "selector")).alias("order", "target"))
    hit = spread.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.groupBy("path", "selector").agg(F.min_by("target", "order").alias("target"))


def hash_vector(text: str, dimensions: int) -> np.ndarray:
    """Signed counts of hashed words, unit length; zeros for text without words."""
    vector = np.zeros(dimensions, dtype=np.float64)
    for word in text.split():
        digest = hashlib.blake2b(word.encode(), digest_size=16).digest()
        vector[int.from_bytes(digest[:8], "big") % dimensions] += 1.0 if digest[8] & 1 else -1.0
    norm = np.linalg.norm(vector)
    return vector / norm if norm else vector


def hash_embeddings(texts: DataFrame, key: str, text: str, dimensions: int = 384) -> DataFrame:
    """``key, vector`` without a model: a hashed bag of words per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": [hash_vector(t or "", dimensions).astype(np.float32) for t in batch[text]]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def embed(texts: DataFrame, key: str, text: str, provider, dimensions: int, batch: int = 64) -> DataFrame:
    """``key, vector`` from a provider: a function of a list of texts that returns one
    vector each. Numbers and lengths of what it returns are checked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = provider(part[text].fillna("").tolist())
                if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                    raise ValueError("the provider returned other numbers or lengths than asked for")
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": [np.asarray(v, dtype=np.float32) for v in vectors]})

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")
