"""Mixing sources to target shares of tokens.

Shares of the sources are exponentiated between what the sources hold and what the
mix asks for: with ``p`` the natural share and ``t`` the target, the share at exponent
``a`` is proportional to ``p * (t / p) ** a``. Exponent 1 is the target, 0 the natural
mix. The exponent is bisected where a token budget would repeat a source more often
than allowed, or to meet a target entropy. The shares are then realised as token
budgets: whole passes over a source, and a part pass over a random permutation of its
documents, block by block.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import cut_lineage, spread

#: Folder of the public vocabulary files, and the file counted with.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a block of a permutation, about.
BLOCK_ROWS = 8192


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with ``tokens``, their number in a public byte-level vocabulary.
    Null and empty texts have none. The file is read once per worker, on its own disk."""
    path = str(Path(tokenizers) / vocabulary)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn("tokens", F.pandas_udf(count, "bigint")("text"))


def source_name(c: Column) -> Column:
    """One spelling: white space around and letter case do not count."""
    return F.lower(F.trim(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``source, doc_id, tokens`` with a text once per source, under its least id: copies
    under several ids are one document as to repetition. Tokens are counted where a text is
    read; only digests, ids and counts are shuffled."""
    named = spread(documents.select("source", "doc_id", "text"), "doc_id").select(source_name(F.col("source")).alias("source"), "doc_id", "text")
    filled = named.filter(F.col("source").isNotNull() & (F.col("source") != "") & F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull())
    counted = token_counts(filled).select("source", "doc_id", "tokens", F.sha2("text", 256).alias("digest"))
    return counted.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens")).select("source", "doc_id", "tokens").filter(F.col("tokens") > 0)


def shares_at(natural: list[float], target: list[float], exponent: float) -> list[float]:
    """Shares between natural (0) and target (1); a target of zero stays zero."""
    raw = [math.exp((1 - exponent) * math.log(p) + exponent * math.log(t)) if p > 0 and t > 0 else 0.0 for p, t in zip(natural, target)]
    total = sum(raw)
    return [x / total for x in raw] if total else raw


def entropy(shares: list[float]) -> float:
    return -sum(x * math.log(x) for x in shares if x > 0)


def bisect_exponent(fits, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The largest exponent that ``fits``, for a condition that holds below it."""
    if fits(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def temperature_shares(sizes: list[float], target_entropy: float) -> tuple[float, list[float]]:
    """Plain temperature mixing: shares proportional to ``size ** a`` with ``a`` bisected
    to the entropy; 0 is uniform, 1 natural. Returns exponent and shares."""

    def at(a: float) -> list[float]:
        raw = [s**a if s > 0 else 0.0 for s in sizes]
        return [x / sum(raw) for x in raw]

    exponent = bisect_exponent(lambda a: entropy(at(a)) >= target_entropy)
    return exponent, at(exponent)


def plan_mix(sizes: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, growth: float | None = None, evenness: float | None = None) -> list[dict]:
    """Token budgets of one mix. ``sizes``: tokens per source; ``targets``: weight and most
    copies per source. Sources that are absent or empty get none; their weight goes to
    the others in proportion. Without a ``budget`` the mix is as large as the exact
    target shares allow, so the exponent is 1; a larger one lowers the exponent, and
    where even the natural shares exceed what repetition allows, sources are used up.
    ``growth`` states the budget as a multiple of that largest exact size. ``evenness``
    takes the place of the weights: the shares of what the sources hold are exponentiated
    until their entropy is that share of the greatest one."""
    targets = {s: (w, r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0}
    present = sorted(s for s in targets if sizes.get(s, 0) > 0)
    plan = []
    if present:
        weight = sum(targets[s][0] for s in present)
        target = [targets[s][0] / weight for s in present]
        held = sum(sizes[s] for s in present)
        natural = [sizes[s] / held for s in present]
        most = [sizes[s] * targets[s][1] for s in present]
        if evenness is not None:
            exponent, shares = temperature_shares([float(sizes[s]) for s in present], evenness * math.log(len(present)))
            exact = min(m / x for m, x in zip(most, shares) if x > 0)
            total = budget if budget is not None else exact * (growth or 1)
        else:
            exact = min(m / t for m, t in zip(most, target))
            total = budget if budget is not None else exact * (growth or 1)
            exponent = bisect_exponent(lambda a: all(x * total <= m * (1 + 1e-12) for x, m in zip(shares_at(natural, target, a), most)))
            shares = shares_at(natural, target, exponent)
        for s, t, x, m in zip(present, target, shares, most):
            plan.append({"source": s, "target_share": t, "planned_share": x, "token_budget": int(min(m, round(x * total))), "exponent": exponent})
    plan += [{"source": s, "target_share": 0.0, "planned_share": 0.0, "token_budget": 0, "exponent": None} for s in sorted(set(targets) - set(present))]
    return plan


def plan_mixes(sources: DataFrame, targets: DataFrame, **wanted) -> DataFrame:
    """Plans of all mixes, as ``plan_mix``: one row per mix and source. What is read to the
    driver is two numbers per source that a mix names: the targets are the stated, small
    request."""
    spark = sources.sparkSession
    asked = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").dropna()
    asked = asked.groupBy("mix_id", "source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    held = sources.join(asked.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    sizes = {r["source"]: (r["tokens"], r["documents"]) for r in held.toLocalIterator()}
    mixes: dict[int, dict] = {}
    for r in asked.toLocalIterator():
        mixes.setdefault(r["mix_id"], {})[r["source"]] = (r["target_weight"], r["max_repeats"])
    tokens = {s: n for s, (n, _) in sizes.items()}
    rows = []
    for mix, named in sorted(mixes.items()):
        for p in plan_mix(tokens, named, **wanted):
            n, documents = sizes.get(p["source"], (0, 0))
            rows.append((mix, p["source"], p["target_share"], p["planned_share"], p["token_budget"], n, documents, p["exponent"]))
    return spark.createDataFrame(rows, "mix_id bigint, source string, target_share double, planned_share double, token_budget bigint, source_tokens bigint, source_documents bigint, exponent double")


def realise(sources: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """Documents of the mixes: ``mix_id, source, doc_id, tokens, copies``.

    A budget of ``n`` whole passes and a rest takes every document ``n`` times, and once
    more those at the head of a random permutation until the rest is used up, and then
    the one largest document that still fits into what is left: sums are never over the
    budget, and under it by less than one document per source. The permutation is of hash
    blocks of some ``BLOCK_ROWS`` documents and inside each block: block totals are added
    first, so no task orders a whole source, whatever its share of the rows.
    """
    active = plan.filter(F.col("token_budget") > 0).select("mix_id", "source", "token_budget", "source_tokens", "source_documents")
    placed = sources.join(active, "source")
    turn = F.floor(F.col("token_budget") / F.col("source_tokens"))
    placed = placed.withColumns(
        {
            "whole": turn.cast("int"),
            "rest": F.col("token_budget") - turn * F.col("source_tokens"),
            "order": F.xxhash64(F.lit(seed), "mix_id", "doc_id"),
        }
    ).withColumn("block", F.pmod("order", F.ceil(F.col("source_documents") / BLOCK_ROWS)).cast("int"))
    totals = placed.groupBy("mix_id", "source", "block").agg(F.sum("tokens").alias("held"))
    before = Window.partitionBy("mix_id", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy("mix_id", "source", "block").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = placed.join(offsets, ["mix_id", "source", "block"]).withColumn("reached", F.col("offset") + F.sum("tokens").over(inside))
    headed = reached.withColumn("head", F.col("reached") <= F.col("rest"))
    group = ["mix_id", "source"]
    # One more document fills the gap that the head leaves: the largest that still fits.
    gaps = headed.groupBy(*group).agg((F.max("rest") - F.sum(F.when(F.col("head"), F.col("tokens")).otherwise(0))).alias("gap"))
    fits = ~F.col("head") & (F.col("tokens") <= F.col("gap"))
    fillers = headed.join(gaps, group).filter(fits).groupBy(*group).agg(F.max(F.struct("tokens", "order", "doc_id")).alias("filler"))
    filled = headed.join(fillers, group, "left")
    extra = F.col("head") | F.coalesce(F.col("filler.doc_id") == F.col("doc_id"), F.lit(False))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return filled.withColumn("copies", copies.cast("int")).filter(F.col("copies") > 0).select(*group, "doc_id", "tokens", "copies")


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 1, **wanted) -> DataFrame:
    """The mixes as documents with their number of copies, never more than ``max_repeats``;
    ``wanted`` may state ``budget``, ``growth`` or ``evenness`` (see ``plan_mix``).

    Spellings of a source are joined. Null or blank sources, null ids, and texts that are
    null or without tokens take no part; a mix none of whose sources is present is
    empty. Equal texts of one source are one document. Targets that are null, zero or
    negative ask for nothing.
    """
    sources = cut_lineage(distinct_texts(documents))  # tokens are counted once
    return realise(sources, plan_mixes(sources, targets, **wanted), seed)


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 1, **wanted) -> DataFrame:
    """Per mix and source: target, planned and reached share of tokens, documents, copies,
    the most copies of one document, and whether the source is absent."""
    sources = cut_lineage(distinct_texts(documents))
    plan = plan_mixes(sources, targets, **wanted)
    used = realise(sources, plan, seed).groupBy("mix_id", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))
    joined = plan.join(used, ["mix_id", "source"], "left").na.fill(0, ["tokens", "documents", "copies", "most_copies"])
    return joined.select(
        "mix_id",
        "source",
        F.round("target_share", 6).alias("target_share"),
        F.round("planned_share", 6).alias("planned_share"),
        F.round(F.when(total > 0, F.col("tokens") / total).otherwise(0.0), 6).alias("actual_share"),
        "tokens",
        "documents",
        "copies",
        "most_copies",
        (F.col("source_tokens") == 0).alias("absent"),
    )
