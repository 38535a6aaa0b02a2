"""Generated, minified, vendored and data files among source files.

Layout statistics of the whole text decide, with thresholds per language; a header
that names a generator or a library release, and a directory that holds third-party
code, decide where the layout looks like hand-written code.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage, spread

# Directories that hold third-party code, files that package managers
# write, and markers of generators and libraries.
VENDOR_DIRS = ("3rdparty", "bower_components", "deps", "external", "node_modules", "third_party", "vendor")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", "go.sum", "composer.lock")
GENERATED_HEADER = r"""(?xi)
    @generated | <auto-?generated | \bautogenerated\b | automatically\ generated\ by | \bauto-generated\b
  | \bgenerated\ by\ \S.*do\ not\ (edit|modify) | code\ generated\ by\ .*do\ not\ edit | built\ from\ \S+;\ edit
  | \b(machine|computer|tool)[-\ ]?(generated|made|written|produced)\b
  | \b(generated|produced|created|written|emitted)\ by\ (a|the)\ (tool|script|generator|compiler|program)\b
  | \b(changes|edits|modifications)\ ((made\ )?(here|to\ this\ file)\ )?(will\ be|are|get)\ (lost|overwritten|discarded)\b
  | ^[\W_]*(output|product)\ of\ [`'"]
  | automatisch\ (erzeugt|generiert) | produit\ par\ .*ne\ pas\ modifier | générée?\ automatiquement
  | generado\ autom[aá]ticamente | 自动生成 | 自動生成 | автоматически\ (создан|сгенерирован)
"""
LIBRARY_HEADER = r"""(?xi)
    @license\s+(?<lib>[a-z][\w.-]+)\s+v?\d+\.\d+
  | part\ of\ the\ (?<lib>[a-z][\w.-]+)\ library,\ release
  | copyright\ .{0,12}\bthe\ (?<lib>[a-z][\w.-]+)\ contributors
  | ^[\W_]*(?<lib>[a-z][\w.-]+)\s+v?\d+\.\d+\.\d+\s*(?:,\ (?:taken\ over|vendored|bundled|copied|unchanged|unmodified)\b.*)?[\W_]*$
"""
JSON_LIBRARY = r"""^\s*\{\s*["']name["']\s*:\s*["'](?<lib>[^"']+)["']\s*,\s*["']version["']\s*:\s*["'][^"']*["']\s*,\s*["']license["']"""
#: Comment markers that a header line may start with.
COMMENT = r"^\s*(?:#|//|/\*|\*|<!--|\{?\s*\"_comment\"|--|;|%|'''|\"\"\")"
#: What opens a block comment or a docstring, and what ends it if not the same.
BLOCK_OPEN = r"^\s*[rRuUbB]{0,2}(/\*|<!--|\'\'\'|\"\"\")"
_BLOCK_END = {"/*": "*/", "<!--": "-->"}

#: Thresholds per language: minified below ``space`` with a mean line above ``line`` or a
#: line above ``longest``; data above ``digits`` (share of the text in numeric literals),
#: ``encoded`` (share in long encoded runs) or ``alnum`` (share of letters and digits, as in
#: encoded data of any width); repeated layout above ``repeat`` (share of lines in the four
#: commonest line forms, where these are few) from ``lines`` lines on. Markup and data
#: languages repeat their layout by nature and have no such limit. Each lies between the
#: extremes that plain code and the other kind show in the language.
THRESHOLDS = {
    "default": {"space": 0.09, "line": 120, "longest": 1000, "digits": 0.28, "encoded": 0.2, "alnum": 0.82, "repeat": 0.78, "lines": 8},
    "js": {"space": 0.1, "line": 90, "longest": 500, "digits": 0.25},
    "ts": {"space": 0.1, "line": 90, "longest": 500, "digits": 0.25},
    "py": {"space": 0.1, "line": 100, "longest": 800, "digits": 0.3},
    "java": {"space": 0.11, "line": 100, "longest": 800, "digits": 0.22},
    "go": {"space": 0.1, "line": 110, "longest": 800, "digits": 0.22},
    "css": {"space": 0.1, "longest": 500, "repeat": 2},
    "json": {"space": 0.08, "line": 400, "longest": 4000, "digits": 0.35, "alnum": 0.85, "repeat": 2},
    "xml": {"space": 0.06, "line": 200, "longest": 2000, "repeat": 2},
}

_GENERATED, _LIBRARY, _JSON_LIBRARY, _COMMENT, _BLOCK_OPEN = (regex.compile(p) for p in (GENERATED_HEADER, LIBRARY_HEADER, JSON_LIBRARY, COMMENT, BLOCK_OPEN))
_LINE = regex.compile(r"[^\n]+")
_STRING = regex.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_NUMBER = regex.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z]?\b")
_WORD = regex.compile(r"[\p{L}_$][\p{L}\p{M}\p{N}_$]*")
_ENCODED = regex.compile(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_MAPPING = regex.compile(r"^\s*(?:-\s+)?[\w.-]+:(?:\s[^;{(]*)?$")
_MARKUP = regex.compile(r"\s*(?:[<\[]|\{\s*[\"'\n}]|[.#]?[\w-]+\s*\{\s*\n\s*[\w-]+:)")
_BODY = regex.compile(r"\s+")

SCHEMA = (
    "file_id bigint, max_line bigint, mean_line double, space_share double, alnum_share double, digit_share double, "
    "encoded_share double, repeat_share double, code_lines bigint, has_text boolean, generated_header boolean, library string, body_hash string"
)


def _mixed(run: str) -> bool:
    """Encoded data mixes cases and digits; rules and long names do not."""
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and len(set(run)) > 9


def header_lines(text: str) -> list[str]:
    """The comment lines before the first line of code, however many; a block comment or
    a docstring counts up to its end, with or without markers on its lines."""
    found, end = [], None
    for m in _LINE.finditer(text):
        line = rest = m.group()
        if end is None and not _COMMENT.match(line) and not _BLOCK_OPEN.match(line):
            if line.strip() and not line.startswith(("package", "<?xml", "<?", "#!", "'use strict'", '"use strict"')):
                break
            continue
        found.append(line)
        while True:
            if end is not None:
                if end not in rest:
                    break
                rest, end = rest[rest.index(end) + len(end) :], None
                # Code behind a comment on its line is the first line of code.
                if rest.strip() and not _COMMENT.match(rest):
                    return found
            if not (opened := _BLOCK_OPEN.match(rest)):
                break
            end, rest = _BLOCK_END.get(opened.group(1), opened.group(1)), rest[opened.end() :]
    return found


def layout(text: str) -> dict:
    """Statistics over the whole text."""
    lines = text.replace("\r\n", "\n").split("\n")
    filled = [x for x in lines if x.strip()]
    size = max(1, len(text))
    encoded = sum(len(m) for m in _ENCODED.findall(text) if _mixed(m))
    digits = sum(len(m) for m in _NUMBER.findall(_STRING.sub('""', text)))
    # Lines of code as forms: words, numbers and strings become one letter each.
    forms: Counter = Counter()
    for x in filled:
        if _COMMENT.match(x):
            continue
        form = _WORD.sub("a", _NUMBER.sub("0", _STRING.sub("s", x.strip())))
        if any(c.isalnum() for c in form):
            forms[form] += 1
    code = sum(forms.values())
    # A tool writes few forms again and again; markup, lists and mappings do so by
    # nature, also under another suffix.
    listed = sum(1 for x in filled if _MAPPING.match(x)) > 0.9 * len(filled) or bool(_MARKUP.match(text))
    common = sum(n for _, n in forms.most_common(4)) if 10 * len(forms) <= 3 * code and not listed else 0
    head = header_lines(text)
    library = next((m.group("lib").lower() for x in head if (m := _LIBRARY.search(x))), None)
    if library is None and (m := _JSON_LIBRARY.match(text)):
        library = m.group("lib").lower()
    body = "\n".join(x for x in filled if not _COMMENT.match(x))
    return {
        "max_line": max(map(len, lines)),
        "mean_line": sum(map(len, filled)) / max(1, len(filled)),
        "space_share": sum(map(str.isspace, text)) / size,
        "alnum_share": sum(map(str.isalnum, text)) / size,
        "digit_share": digits / size,
        "encoded_share": encoded / size,
        "repeat_share": common / max(1, code),
        "code_lines": code,
        "has_text": bool(filled),
        "generated_header": any(_GENERATED.search(x) for x in head),
        "library": library,
        "body_hash": hashlib.sha1(_BODY.sub(" ", body).encode("utf-8", "replace")).hexdigest() if code >= 8 else None,
    }


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for batch in batches:
        yield pd.DataFrame([{"file_id": i, **layout(c or "")} for i, c in zip(batch["file_id"], batch["content"])], columns=names)


def _limit(name: str):
    suffix, default = F.col("suffix"), THRESHOLDS["default"][name]
    chain = F.lit(float(default))
    for language, own in THRESHOLDS.items():
        if name in own and language != "default":
            chain = F.when(suffix == language, float(own[name])).otherwise(chain)
    return chain


def classify_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Every file with its layout statistics and ``origin``: ``generated``, ``minified``,
    ``data``, ``vendored`` or ``handwritten``.

    ``files`` has ``file_id, path``, ``texts`` has ``file_id, content``. The first of
    these that holds decides: third-party directory, library header, a directory named
    like a library of the collection's headers, or code equal to such a file;
    generator header; encoded or numeric data; minified; repeated layout.
    ``is_generated`` is not used: it is wrong either way. Null, empty and comment-only
    texts are ``handwritten`` unless path or header say otherwise; a file without a
    text row counts as empty; repeated rows of a file count once. Null ids are left out.

    Texts are read once, and one row of statistics each is kept in the checkpoint folder; the library names and
    the hashes of library code come back as semi joins that AQE may broadcast by size.
    """
    text = spread(texts.select("file_id", "content").dropna(subset=["file_id"]), "file_id")
    stats = cut_lineage(text.mapInPandas(_layouts, SCHEMA).dropDuplicates(["file_id"]))
    named = files.select("file_id", "path").dropna(subset=["file_id"]).dropDuplicates(["file_id"])
    known = named.join(stats, "file_id", "left").withColumns(
        {
            "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)),
            "folders": F.slice(F.split(F.coalesce("path", F.lit("")), "/"), 1, F.greatest(F.size(F.split(F.coalesce("path", F.lit("")), "/")) - 1, F.lit(1))),
            "has_text": F.coalesce("has_text", F.lit(False)),
            "generated_header": F.coalesce("generated_header", F.lit(False)),
        }
    )
    # A third-party directory holds one directory per library.
    in_vendor = F.exists(F.slice("folders", 1, F.greatest(F.size("folders") - 1, F.lit(1))), lambda x: F.lower(x).isin(*VENDOR_DIRS)) | F.col("library").isNotNull()
    known = known.withColumn("in_vendor", in_vendor)
    libraries = stats.filter(F.col("library").isNotNull()).select(F.col("library").alias("folder")).distinct()
    folders = known.filter(~F.col("in_vendor")).select("file_id", F.explode("folders").alias("folder")).withColumn("folder", F.regexp_replace(F.lower("folder"), r"-\d[\d.]*$", ""))
    by_folder = folders.join(libraries, "folder", "left_semi").select("file_id").distinct().withColumn("folder_named", F.lit(True))
    copied = known.filter(F.col("in_vendor") & F.col("body_hash").isNotNull()).select("body_hash").distinct().withColumn("copied", F.lit(True))
    joined = known.join(by_folder, "file_id", "left").join(copied, "body_hash", "left")
    vendored = F.col("has_text") & (F.col("in_vendor") | F.coalesce("folder_named", F.lit(False)) | F.coalesce("copied", F.lit(False)))
    lockfile = F.col("has_text") & F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1).isin(*LOCKFILES)
    data = (F.col("encoded_share") > _limit("encoded")) | (F.col("digit_share") > _limit("digits")) | ((F.col("alnum_share") > _limit("alnum")) & (F.col("code_lines") >= _limit("lines")))
    minified = (F.col("space_share") < _limit("space")) & ((F.col("mean_line") > _limit("line")) | (F.col("max_line") > _limit("longest")))
    repeated = (F.col("repeat_share") >= _limit("repeat")) & (F.col("code_lines") >= _limit("lines"))
    origin = F.when(vendored, "vendored").when(F.col("generated_header") | lockfile, "generated").when(data, "data").when(minified, "minified").when(repeated, "generated").otherwise("handwritten")
    return joined.withColumn("origin", origin).select("file_id", "path", "suffix", "max_line", "mean_line", "space_share", "alnum_share", "digit_share", "encoded_share", "repeat_share", "code_lines", "generated_header", "library", "origin")
