import math

from pyspark.sql import functions as F

from brindle.llm.mixing import entropy, mix_report, mix_sources, plan_mix, shares_at, temperature_shares, token_counts

DOCS, TARGETS = "doc_id bigint, text string, source string", "mix_id bigint, source string, target_weight double, max_repeats int"


def documents():
    big = [(i, f"text number {i} of the big source " + "word " * (i % 7), " Big " if i % 3 else "BIG") for i in range(600)]
    small = [(1000 + i, f"small text {i} here", "small") for i in range(12)]
    odd = [(2000, None, "small"), (2001, "", "small"), (2002, "no source", None), (2003, "blank", "  "), (2004, "small text 0 here", "small"), (None, "no id", "small"), (1000, "small text 0 here", "small")]
    return big + small + odd


def test_shares_and_repeats(spark):
    docs = spark.createDataFrame(documents(), DOCS).withColumns({c: F.lit(1) for c in ("tokens", "block", "order", "copies")})
    targets = spark.createDataFrame([(1, "big", 3.0, 1), (1, "Small", 1.0, 4), (1, "absent", 5.0, 2), (2, "absent", 1.0, 1), (3, "big", None, 1), (3, "small", -1.0, 1)], TARGETS)
    report = {(r.mix_id, r.source): r for r in mix_report(docs, targets).collect()}
    assert abs(report[1, "big"].actual_share - 0.75) < 0.01 and abs(report[1, "small"].actual_share - 0.25) < 0.01
    assert report[1, "small"].most_copies == 4 and report[1, "big"].most_copies == 1
    assert report[1, "absent"].absent and report[2, "absent"].tokens == 0
    mixed = mix_sources(docs, targets)
    rows = mixed.collect()
    assert {r.mix_id for r in rows} == {1} and 2004 not in {r.doc_id for r in rows}
    assert len({(r.source, r.doc_id) for r in rows}) == len(rows)
    again = mix_sources(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mix_sources(docs.limit(0), targets).count() == 0 and mix_sources(docs, targets.limit(0)).count() == 0


def test_plan_lowers_the_exponent_for_a_large_budget():
    plan = {p["source"]: p for p in plan_mix({"a": 1000, "b": 10}, {"a": (1.0, 1), "b": (1.0, 2)}, budget=500)}
    assert plan["b"]["token_budget"] <= 20 and 0 < plan["a"]["exponent"] < 1
    exact = {p["source"]: p for p in plan_mix({"a": 1000, "b": 10}, {"a": (1.0, 1), "b": (1.0, 2)})}
    assert exact["a"]["exponent"] == 1 and exact["a"]["token_budget"] == exact["b"]["token_budget"] == 20


def test_growth_and_evenness(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    targets = spark.createDataFrame([(1, "big", 1.0, 1), (1, "small", 1.0, 4)], TARGETS)
    exact, grown, even = ({r.source: r for r in mix_report(docs, targets, **wanted).collect()} for wanted in ({}, {"growth": 3.0}, {"evenness": 0.9}))
    assert abs(exact["small"].actual_share - 0.5) < 0.05
    # Small is used as often as it may be; big makes up the rest of three times the size.
    assert grown["small"].most_copies == 4 and grown["small"].planned_share < 0.2
    size = sum(r.tokens for r in exact.values())
    assert abs(sum(r.tokens for r in grown.values()) / size - 3) < 0.1
    shares = [r.planned_share for r in even.values()]
    assert math.isclose(entropy(shares), 0.9 * math.log(2), abs_tol=1e-4) and all(abs(r.actual_share - r.planned_share) < 0.05 for r in even.values())


def test_temperature():
    exponent, shares = temperature_shares([900.0, 90.0, 10.0], 0.9)
    assert 0 < exponent < 1 and math.isclose(entropy(shares), 0.9, abs_tol=1e-6) and math.isclose(sum(shares), 1)
    assert all(map(math.isclose, shares_at([0.9, 0.1], [0.5, 0.5], 0.0), [0.9, 0.1]))


def test_tokens(spark):
    got = [r.tokens for r in token_counts(spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1
