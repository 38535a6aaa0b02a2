"""Frontend files: their roles, what a query wants of them, and cohorts of imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions.text import distinct_lower, identifier_tokens

# Roles by the place under the source directory, the first that fits.
PLACES = (
    ("type_decl", r"^src/types/|^src/.*\.d\.ts$"),
    ("route_config", r"^src/(?:router|routes)/"),
    ("view_page", r"^src/(?:views|pages)/|^pages/"),
    ("layout_component", r"^src/app\.[tj]sx$|^src/components/applayout\.vue$|^src/components/layout/|^src/layouts/"),
    ("shared_component", r"^src/components/"),
    ("store", r"^src/stores?/"),
    ("service", r"^src/(?:services|api)/"),
    ("utility", r"^src/(?:utils|lib|helpers)/"),
)
LOCKFILE, SCRATCH, SOURCE = r"(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb)$", r"^(?:temp|tmp|\.cache)(?:/|$)", r"\.(?:astro|jsx?|svelte|tsx?|vue)$"
# Words that ask for an entry point, an implementation, a state, and that name
# types or scratch files; words of names that say nothing.
ENTRY_WORDS = "tool page view component layout sidebar theme reader scan scanner camera image remove remover upload download route navigation"
UTILITY_WORDS = "generate decode encode parse format convert entity class interface typescript java csharp"
STATE_WORDS = "pinia store state theme sidebar dark light history"
TYPE_WORDS, SCRATCH_WORDS = "declaration declarations type typedef types typing typings", "cache generated mock scratch temp tmp"
LOCK_WORDS = "bun dependencies dependency lock lockfile npm package packages pnpm version versions yarn"
PLAIN_WORDS = "astro component components d from index js jsx page pages src svelte to ts tsx view views vue"
ENTRY_ROLES, SUPPORT_ROLES = ("view_page", "layout_component", "route_config"), ("service", "utility", "store", "type_decl", "shared_component")
ANCHOR_ROLES = ("view_page", "layout_component", "shared_component")


def source_path(path: Column) -> Column:
    """The path from its first source directory on, in small letters."""
    low = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(?:\./)+", "")
    return F.when(low.rlike("(?:^|/)src/"), F.concat(F.lit("src/"), F.regexp_extract(low, "(?:^|/)src/(.*)$", 1))).otherwise(low)


def frontend_role(path: Column) -> Column:
    low = F.lower(path)
    chain = F.when(low.rlike(LOCKFILE), "lockfile").when(low.rlike(SCRATCH), "scratch_temp").when(~low.rlike(SOURCE), "other")
    for name, pattern in PLACES:
        chain = chain.when(source_path(path).rlike(pattern), name)
    return chain.otherwise("other")


def name_words(text: Column) -> Column:
    """Words of a query or a name, cut at signs and case; of a name of several also the whole."""
    # A run of words without a blank or sign between them in the text is one name.
    runs = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\\/._-]+", " ")), r"\s+")
    cut = lambda r: F.regexp_extract_all(F.lower(F.regexp_replace(F.regexp_replace(r, r"([A-Z])(?=[A-Z][a-z])", "$1 "), "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), 0)
    return F.flatten(F.transform(runs, lambda r: F.when(F.size(cut(r)) > 1, F.concat(F.array(F.array_join(cut(r), "")), cut(r))).otherwise(cut(r))))


def _score(words: Column, group: str, weight: float) -> Column:
    named = F.size(F.filter(words, lambda w: w.isin(*group.split())))
    return F.least(F.lit(1.0), named * weight)


def _any_of(words: Column, group: str) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in group.split()]))


def with_frontend_parts(rows: DataFrame) -> DataFrame:
    """Adds ``frontend_role, entrypoint_boost, support_boost, support_name_boost`` and
    ``frontend_penalty`` (not above 0) to rows with ``query_text`` and ``path``."""
    rows = rows.withColumns({"frontend_role": frontend_role(F.col("path")), "_words": name_words(F.col("query_text"))})
    role, words = F.col("frontend_role"), F.col("_words")
    entry, utility, state = _score(words, ENTRY_WORDS, 0.35), _score(words, UTILITY_WORDS, 0.18), _score(words, STATE_WORDS, 0.18)
    plain = F.array(*[F.lit(w) for w in PLAIN_WORDS.split()])
    own = F.array_except(name_words(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")), plain)
    common = F.size(F.array_intersect(own, F.array_except(words, plain)))
    named = (F.size(own) >= 2) & (common >= 2) & (common / F.size(own) >= 2 / 3)
    types = _any_of(words, TYPE_WORDS) | F.contains(F.lower("query_text"), F.lit("d.ts"))
    path_words = F.array_except(F.flatten(F.transform(F.split(source_path(F.col("path")), "/"), lambda p: name_words(F.regexp_replace(p, r"(?:\.d\.ts|\.[^.]+)$", "")))), F.array(*[F.lit(w) for w in "d index src ts type types".split()]))
    by_role = F.when(role.isin(*ENTRY_ROLES) & (entry >= 0.45), entry * 0.35).when((role == "shared_component") & (entry >= 0.55), entry * 0.18).otherwise(0.0)
    return rows.withColumns(
        {
            "entrypoint_boost": F.greatest(by_role, F.when(role.isin(*ENTRY_ROLES) & named, 0.25).otherwise(0.0)),
            "support_boost": F.when(role.isin("utility", "service") & (utility >= 0.45), utility * 0.18).when((role == "store") & (state >= 0.35), state * 0.18).when((role == "type_decl") & types, 0.12).otherwise(0.0),
            "support_name_boost": F.when(role.isin("utility", "service") & named, 0.18).otherwise(0.0),
            "frontend_penalty": F.when((role == "lockfile") & ~_any_of(words, LOCK_WORDS), -0.80)
            .when((role == "scratch_temp") & ~_any_of(words, SCRATCH_WORDS), -1.00)
            .when((role == "type_decl") & ~types & ~F.arrays_overlap(path_words, words) & (entry >= 0.45) & (entry >= utility), -0.12)
            .otherwise(0.0),
        }
    ).drop("_words")


def import_cohorts(ranked: DataFrame, imports: DataFrame, top: int = 10, files: int = 3) -> DataFrame:
    """Supporting files that the leading pages and components import, lifted to just under
    them: ``query_id, chunk_id, rerank, boosted``. ``ranked`` has ``query_id, chunk_id, path,
    rerank, position``; ``imports`` has ``source_path, target_path``. Anchors are the first
    ``files`` distinct files with such a role among the first ``top`` rows; a lift is at most
    .30 and never lowers a row."""
    rows = ranked.withColumn("_role", frontend_role(F.col("path")))
    leading = rows.filter((F.col("position") <= top) & F.col("_role").isin(*ANCHOR_ROLES)).groupBy("query_id", "path").agg(F.min("position").alias("p"), F.max("rerank").alias("anchor"))
    anchors = leading.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("p"))).filter(F.col("n") <= files)
    reached = anchors.join(imports.select(F.col("source_path").alias("path"), "target_path").distinct(), "path").groupBy("query_id", F.col("target_path").alias("path")).agg(F.max("anchor").alias("anchor"))
    lifted = rows.filter(F.col("_role").isin(*SUPPORT_ROLES)).join(reached, ["query_id", "path"])
    boosted = F.least(F.col("rerank") + 0.30, F.col("anchor") - 0.001)
    return lifted.select("query_id", "chunk_id", "rerank", F.round(F.greatest("rerank", boosted), 9).alias("boosted")).filter(F.col("boosted") > F.col("rerank"))


def java_context(rows: DataFrame) -> DataFrame:
    """What members of a Java chunk have in common with the query: ``query_id, chunk_id,
    method, field, executor``. ``rows`` has ``query_id, chunk_id, path, role, query_tokens,
    kind, tokens``, a row per signal; two shared tokens count."""
    words = F.transform("query_tokens", lambda t: F.lower(t))
    shared = F.size(F.array_intersect(words, F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: F.lower(t)))) >= 2
    found = rows.filter(F.col("kind").isin("method", "field") & F.lower("path").endswith(".java") & shared)
    of = lambda condition, value: F.max(F.when(condition, value).otherwise(0.0))
    return found.groupBy("query_id", "chunk_id").agg(of(F.col("kind") == "method", 0.14).alias("method"), of(F.col("kind") == "field", 0.12).alias("field"), of(F.col("role") == "executor", 0.10).alias("executor"))


def route_tail(route: Column, names: Column, role: Column) -> Column:
    """.22 where the name of an executor holds all words of the last part of a route that has
    two or more."""
    last = F.try_element_at(F.filter(F.split(F.coalesce(route, F.lit("")), "/"), lambda s: s != ""), F.lit(-1))
    tail = F.filter(distinct_lower(identifier_tokens(last)), lambda w: ~w.isin("src", "main", "test", "java", "com", "org", "net"))
    holds = F.exists(names, lambda n: F.size(F.array_except(tail, distinct_lower(identifier_tokens(n)))) == 0)
    return F.when((role == "executor") & (F.size(tail) >= 2) & holds, 0.22).otherwise(0.0)
