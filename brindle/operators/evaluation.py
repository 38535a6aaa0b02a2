"""Retrieval quality: hits, recall, reciprocal rank, noise, percentiles, comparison of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT_AT, RECALL_AT, NOISE_AT = (1, 3, 5, 10), (5, 10), (5, 10)


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, n = "", 0
    while n < len(glob):
        if glob.startswith("**/", n):
            out, n = out + "(?:.*/)?", n + 3
        elif glob.startswith("**", n):
            out, n = out + ".*", n + 2
        elif glob[n] in "*?":
            out, n = out + ("[^/]*" if glob[n] == "*" else "[^/]"), n + 1
        else:
            out, n = out + ("\\" if glob[n] in ".+()[]{}^$|\\" else "") + glob[n], n + 1
    return f"^{out}$"


def matches(path: Column, kind: str, value: str) -> Column:
    """One matcher: ``path`` equal, ``glob``, or ``contains``."""
    if kind == "path":
        return path == value
    if kind == "glob":
        return path.rlike(glob_pattern(value))
    if kind == "contains":
        return F.contains(path, F.lit(value))
    raise ValueError(f"no such matcher: {kind}")


def case_metrics(ranked: DataFrame, case: str) -> DataFrame:
    """Per case: first relevant rank, reciprocal rank, hit and recall at depths, precision at
    5 (divided by 5 also where fewer rows came back) and noise. ``ranked`` has ``case,
    position, relevant, noise``."""
    relevant = F.col("relevant")
    first = F.min(F.when(relevant, F.col("position")))
    total = F.count_if(relevant)
    return ranked.groupBy(case).agg(
        first.alias("first_rank"),
        F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"),
        *[F.coalesce(first <= k, F.lit(False)).alias(f"hit_{k}") for k in HIT_AT],
        *[F.round(F.when(total > 0, F.count_if(relevant & (F.col("position") <= k)) / total).otherwise(0.0), 6).alias(f"recall_{k}") for k in RECALL_AT],
        F.round(F.count_if(relevant & (F.col("position") <= 5)) / 5, 6).alias("precision_5"),
        *[F.count_if(F.col("noise") & (F.col("position") <= k)).alias(f"noise_{k}") for k in NOISE_AT],
    )


def grouped_metrics(cases: DataFrame, groups: list[str], measure: str, tags: str | None = None) -> DataFrame:
    """Overall, per value of each of ``groups`` and per tag of the array ``tags``, in one pass:
    ``grouping, value, cases, hits, hit_rate, mrr`` and the nearest-rank percentiles of
    ``measure``. A case counts once per grouping, and once per distinct tag."""
    named = lambda g, value: F.struct(F.lit(g).alias("grouping"), value.cast("string").alias("value"))
    pairs = F.array(named("overall", F.lit("all")), *[named(g, F.col(g)) for g in groups])
    if tags is not None:
        pairs = F.concat(pairs, F.transform(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))), lambda t: named("tag", t)))
    spread = cases.select("hit_10", "reciprocal_rank", measure, F.explode(pairs).alias("p")).select("p.*", "hit_10", "reciprocal_rank", measure)
    return spread.groupBy("grouping", "value").agg(
        F.count("*").alias("cases"),
        F.count_if("hit_10").alias("hits"),
        F.round(F.count_if("hit_10") / F.count("*"), 6).alias("hit_rate"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        *[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{measure}`)").alias(f"{measure}_p{int(p * 100)}") for p in (0.5, 0.95)],
    )


def compare_reports(before: DataFrame, after: DataFrame, case: str) -> DataFrame:
    """Case by case: ``added``, ``removed``, ``regressed``, ``improved`` or ``same``. A case
    regresses if its reciprocal rank falls by more than 0.25, it loses its hit at 5, or
    noise grows by 2 or more."""
    fields = ("reciprocal_rank", "hit_5", "noise_5")
    a = before.select(case, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a"))
    b = after.select(case, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b"))
    delta = F.round(F.col("b_reciprocal_rank") - F.col("a_reciprocal_rank"), 6)
    worse = (delta < -0.25) | (F.col("a_hit_5") & ~F.col("b_hit_5")) | (F.col("b_noise_5") - F.col("a_noise_5") >= 2)
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(worse, "regressed").when((delta > 1e-12) | (F.col("b_hit_5") & ~F.col("a_hit_5")), "improved").otherwise("same")
    return a.join(b, case, "full_outer").select(case, status.alias("status"), delta.alias("rank_delta"))


# What becomes of a required case by its status before and after, where it did
# not pass both times, and which of these stop a release.
REQUIRED_CHANGES = {
    ("pass", "fail"): "regressed", ("pass", "error"): "regressed", ("pass", "skipped"): "regressed", ("fail", "pass"): "improved", ("fail", "fail"): "unchanged_fail", ("fail", "error"): "execution_regressed",
    ("fail", "skipped"): "coverage_lost_required", ("error", "pass"): "improved", ("error", "fail"): "newly_evaluated_failure", ("error", "error"): "unchanged_error", ("error", "skipped"): "unchanged_unverified",
    ("skipped", "pass"): "newly_verified", ("skipped", "fail"): "newly_evaluated_failure", ("skipped", "error"): "unchanged_unverified", ("skipped", "skipped"): "skipped",
}
STOPPING = ("regressed", "execution_regressed", "coverage_lost_required", "removed_required", "gate_weakened")


def compare_cases(before: DataFrame, after: DataFrame, case: str) -> DataFrame:
    """Case by case what changed between two reports, and whether it stops a release: ``case,
    change, stops``. Both have ``case, gate, status, reciprocal_rank, hit_5, noise_5``; a null
    gate is required. A required case that passes both times has regressed if it lost its hit
    at 5, its reciprocal rank fell by more than .25 or noise grew by two, and improved the
    other way round; a change of gate is told before anything else. Cases that are not
    required are ``changed`` or ``same`` and stop nothing."""
    fields = ("status", "reciprocal_rank", "hit_5", "noise_5")
    side = lambda df, s: df.select(case, F.coalesce("gate", F.lit("required")).alias(f"{s}_gate"), *[F.col(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(f"in_{s}"))
    joined = side(before, "a").join(side(after, "b"), case, "full_outer")
    rank, noise = F.col("b_reciprocal_rank") - F.col("a_reciprocal_rank"), F.col("b_noise_5") - F.col("a_noise_5")
    worse = (F.col("a_hit_5") & ~F.col("b_hit_5")) | (rank < -0.25 - 1e-12) | (noise >= 2)
    better = (~F.col("a_hit_5") & F.col("b_hit_5")) | (rank > 0.25 + 1e-12) | (noise <= -2)
    both_pass = F.when(worse, "regressed").when(better, "improved").otherwise("unchanged_pass")
    chain = F.when((F.col("a_status") == "pass") & (F.col("b_status") == "pass"), both_pass)
    for (a, b), change in REQUIRED_CHANGES.items():
        chain = chain.when((F.col("a_status") == a) & (F.col("b_status") == b), change)
    required_a, required_b = F.col("a_gate") == "required", F.col("b_gate") == "required"
    change = (
        F.when(F.col("in_a").isNull(), "new_case")
        .when(F.col("in_b").isNull(), F.when(required_a, "removed_required").otherwise("removed_observation"))
        .when(required_a & ~required_b, "gate_weakened")
        .when(~required_a & required_b, "gate_strengthened")
        .when(F.col("a_gate") != F.col("b_gate"), "gate_changed_observation")
        .when(required_a, chain)
        .when((F.col("a_status") != F.col("b_status")) | worse | better, "changed")
        .otherwise("same")
    )
    return joined.select(case, change.alias("change")).withColumn("stops", F.coalesce(F.col("change").isin(*STOPPING), F.lit(False)))


def metric_means(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, mean`` over the cases; values of six digits are added exactly."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = cases.select(pairs.alias("p")).select("p.*").filter(F.col("value").isNotNull())
    return long.groupBy("metric").agg((F.sum(F.round(F.col("value") * 1_000_000).cast("bigint")) / F.count("*") / 1e6).alias("mean"))


def metric_deltas(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of both reports and their difference, per metric; one that a report lacks is null."""
    a, b = metric_means(before, metrics).withColumnRenamed("mean", "before"), metric_means(after, metrics).withColumnRenamed("mean", "after")
    return a.join(b, "metric", "full_outer").select("metric", F.round("before", 5).alias("before"), F.round("after", 5).alias("after"), F.round(F.col("after") - F.col("before"), 5).alias("delta"))


def case_status(gate: Column, failed: Column) -> Column:
    """A required case passes or fails; a known gap that holds is expected, one that does not
    is told apart; an informational case never fails."""
    return F.when(~failed, F.when(gate == "known_gap", "unexpected_pass").otherwise("pass")).when(gate == "required", "fail").when(gate == "known_gap", "expected_gap").otherwise("info")


def first_ranks(ranked: DataFrame, targets: DataFrame, case: str) -> DataFrame:
    """``case, target, rank``: the first position whose path a target's matcher meets, null
    if none does. ``ranked`` has ``case, path, position``; ``targets`` has ``case, target`` and
    one of ``path``, ``contains`` or ``pattern`` (a regular expression, see ``glob_pattern``)."""
    wanted = targets.select(case, "target", F.col("path").alias("_path"), "contains", "pattern")
    met = F.coalesce(F.col("path") == F.col("_path"), F.contains("path", "contains"), F.regexp_like("path", F.col("pattern")), F.lit(False))
    found = wanted.join(ranked.select(case, "path", "position"), case, "left")
    return found.groupBy(case, "target").agg(F.min(F.when(met, F.col("position"))).alias("rank"))


def order_checks(ranks: DataFrame, rules: DataFrame, case: str) -> DataFrame:
    """``case, better, worse, holds``: a rule holds if ``better`` is among the first ``top_k``
    and ``worse`` is not before it. ``ranks`` as ``first_ranks``."""
    better = ranks.select(case, F.col("target").alias("better"), F.col("rank").alias("b"))
    worse = ranks.select(case, F.col("target").alias("worse"), F.col("rank").alias("w"))
    joined = rules.join(better, [case, "better"], "left").join(worse, [case, "worse"], "left")
    holds = F.coalesce((F.col("b") <= F.col("top_k")) & (F.col("w").isNull() | (F.col("b") < F.col("w"))), F.lit(False))
    return joined.select(case, "better", "worse", holds.alias("holds"))


def coverage(ranks: DataFrame, case: str, depth: int = 5) -> DataFrame:
    """Share of each case's targets that stand among the first ``depth``, and the mean
    reciprocal rank of the best one: ``case, targets, covered, reciprocal_rank``."""
    return ranks.groupBy(case).agg(
        F.count("*").alias("targets"), F.round(F.count_if(F.col("rank") <= depth) / F.count("*"), 6).alias("covered"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )


def redacted(text: Column) -> Column:
    """Secrets and home directories taken out of error texts."""
    text = F.regexp_replace(text, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.regexp_replace(text, r"/(home|Users|root|srv)/[^\s:'\"]+", "[path]")
