"""Best sums per query: exact, and without a row per query and key."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import anchors, recall
from brindle.operators.sums import best_sums


def shuffled_rows(df):
    """Rows written by the shuffles of the plan that ran."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name != "ReusedExchangeExec":
            if name == "ShuffleExchangeExec":
                total += node.metrics().get("shuffleRecordsWritten").get().value()
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return total


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize("block,most", [(1000, 1 << 16), (7, 20)])
def test_best_sums_against_brute_force(spark, every, block, most):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(12)]
    asked = {q: rng.sample([*words, "none"], rng.randint(1, 4)) for q in range(30)}
    asked[30] = asked[29]
    postings = {(t, f"k{k:03}"): rng.choice([0, 1, 1, 149, 150, 151]) for k in range(300) for t in words if rng.random() < (0.03 if t < "t2" else 0.5)}
    late = {f"k{k:03}": rng.choice([None, 0, 1]) for k in range(300)}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id bigint, term string")
    rows = spark.createDataFrame([(t, k, late[k], w) for (t, k), w in postings.items()], "term string, key string, late int, weight bigint")
    got = {}
    for r in best_sums(terms, rows, "key", 9, ["late"], every, 100, block, most).collect():
        got.setdefault(r.query_id, set()).add((r.key, r.total))
    want = {}
    for q, ts in asked.items():
        held = {k: [postings[t, k] for t in ts if (t, k) in postings] for k in late}
        sums = [(-((sum(w) + 50) // 100), -1 if late[k] is None else late[k], k) for k, w in held.items() if w and (not every or len(w) == len(ts))]
        if sums:
            want[q] = {(k, -total) for total, _, k in sorted(sums)[:9]}
    assert got == want


def test_no_queries_and_no_postings(spark):
    terms = spark.createDataFrame([(1, "a")], "query_id bigint, term string")
    rows = spark.createDataFrame([("a", "k", 1)], "term string, key string, weight bigint")
    assert best_sums(terms.limit(0), rows, "key", 3).collect() == []
    assert best_sums(terms, rows.filter("weight > 1"), "key", 3).collect() == []


def test_lexical_all_shuffles_no_row_per_query_and_text(spark):
    """300 queries and 300 texts of the same two words: 90,000 pairs, 1,200 rows and 80 per query and core."""
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), F.repeat(F.lit("gamma "), (F.col("id") % 7).cast("int"))).alias("text"))
    terms = recall.query_terms(spark.range(300).select(F.col("id").alias("query_id"), F.lit("alpha beta").alias("query_text")))
    best = recall.lexical_all(recall.scored_postings(texts, "doc_id", "text", terms), terms, "doc_id", 2)
    assert best.count() == 600
    assert {r.doc_id for r in best.collect()} == {0, 7}
    assert shuffled_rows(best) < 20_000


def test_path_symbol_shuffles_no_row_per_query_and_path(spark):
    files = spark.range(300).select(F.format_string("src/alpha/beta%03d.py", "id").alias("path"))
    symbols = spark.createDataFrame([("src/alpha/beta007.py", "gammaRay"), ("z", "gamma")], "path string, name string")
    tokens = spark.createDataFrame([("src/alpha/beta009.py", "gamma")], "path string, term string")
    terms = recall.query_terms(spark.range(300).select(F.col("id").alias("query_id"), F.lit("alpha beta gamma").alias("query_text")))
    best = recall.path_symbol(terms, files, symbols, tokens, 3)
    assert {(r.path, r.score) for r in best.filter("query_id = 5").collect()} == {("src/alpha/beta007.py", 3.0), ("src/alpha/beta009.py", 2.25), ("src/alpha/beta000.py", 2.0)}
    assert best.count() == 900
    assert shuffled_rows(best) < 20_000


def signals_and_terms(spark):
    """300 signals and 300 queries of the same two words; a third word is in two signals only."""
    schema = "signal_id string, kind string, name string, tokens array<string>, metadata map<string,string>, start_line int, end_line int, file_path string, recallable boolean, deleted_at bigint"
    rows = [(f"s{i:03}", "endpoint" if i == 70 else "type", "alphaBeta" + "Gamma" * (i in (7, 9)), None, {"k": "v"}, 1000 - i, None, "p", True, None) for i in range(300)]
    rows += [("gone", "type", "alphaBetaGamma", None, {}, 1, 1, "p", True, 5), ("mute", "type", "alphaBetaGamma", None, {}, 1, 1, "p", False, None)]
    return spark.createDataFrame(rows, schema), recall.query_terms(spark.range(300).select(F.col("id").alias("query_id"), F.lit("alpha beta gamma").alias("query_text")))


def test_signal_scores_shuffle_no_row_per_query_and_signal(spark):
    signals, terms = signals_and_terms(spark)
    scores = anchors.signal_scores(recall.signal_recall(terms, signals, 4), terms, signals)
    assert {(r.signal_id, r.score) for r in scores.filter("query_id = 5").collect()} == {("s009", 1.0), ("s007", 1.0), ("s070", 0.666667), ("s299", 0.666667)}
    assert shuffled_rows(scores) < 30_000


def test_signal_recall_shuffles_no_row_per_query_and_signal(spark):
    signals, terms = signals_and_terms(spark)
    best = recall.signal_recall(terms, signals, 4)
    assert {(r.signal_id, r.hits) for r in best.filter("query_id = 5").collect()} == {("s009", 3), ("s007", 3), ("s070", 2), ("s299", 2)}
    assert shuffled_rows(best) < 20_000


def test_hint_parts_shuffle_no_row_per_query_and_path(spark):
    texts = spark.range(300).select(F.format_string("p%03d", "id").alias("path"), F.concat(F.lit("alpha beta "), F.repeat(F.lit("gamma "), (F.col("id") % 150).cast("int"))).alias("text"))
    hints = spark.range(300).select(F.col("id").alias("query_id"), F.explode(F.when(F.col("id") > 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array(F.lit("alpha"), F.lit("none")))).alias("term"))
    symbols = texts.select("path", F.lit("alphaRay").alias("name"))
    parts = recall.hint_parts(hints, texts, texts.select("path"), symbols, spark.createDataFrame([], "path string, term string"), 2)
    rows = parts.collect()
    assert {(r.path, r.key) for r in rows if r.query_id == 5} == {("p000", "planner_lexical"), ("p150", "planner_lexical"), ("p000", "planner_path_symbol"), ("p001", "planner_path_symbol")}
    assert {(r.path, r.key) for r in rows if r.query_id == 0} == {("p000", "planner_lexical"), ("p150", "planner_lexical"), ("p000", "planner_path_symbol"), ("p001", "planner_path_symbol")}
    assert len(rows) == 1200
    assert shuffled_rows(parts) < 30_000
