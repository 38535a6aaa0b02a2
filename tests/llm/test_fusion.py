import random

from pyspark.sql import functions as F

from brindle.llm.fusion import PARTS, RRF_K, fused_ranking, leading

SCHEMA = "query_id bigint, chunk_id string, score double, rerank_score double, score_parts map<string,double>"
NAMES = ("score", "rerank_score", *PARTS)


def make(n, seed=1):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random() * 10 ** rnd.randint(0, 6)])
    rows = [(q, f"c{i}", value(), value(), {p: value() for p in PARTS if rnd.random() < 0.8} or None) for q in (1, 2) for i in range(n)]
    return rows + rows[:3]


def brute(rows):
    out = {}
    for q in {r[0] for r in rows}:
        own = {r[1]: [r[2], r[3], *[(r[4] or {}).get(p) for p in PARTS]] for r in rows if r[0] == q}
        own = {c: [None if x is None or x != x else x for x in v] for c, v in own.items()}
        for c, v in own.items():
            ranks = [1 + sum(1 for w in own.values() if w[i] is not None and (v[i] is None or w[i] > v[i])) for i in range(6)]
            out[q, c] = round(sum(1 / (RRF_K + r) for r in ranks), 12)
    return out


def test_equals_brute_force_in_both_forms(spark):
    rows = make(40)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("rank", "piece", "metric", "value", "fused")})
    want = brute(rows)
    for hot in (None, 5):
        got = {(r.query_id, r.chunk_id): r.fused for r in fused_ranking(df, hot=hot, pieces=4).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-11 for k in want), hot
    first = {(r.query_id, r.chunk_id) for r in leading(fused_ranking(df)).collect()}
    for q in (1, 2):
        best = sorted((-s, c) for (a, c), s in want.items() if a == q)[:5]
        assert {(q, c) for _, c in best} == {x for x in first if x[0] == q}


def test_nulls_and_empty(spark):
    rows = [(None, "c", 1.0, 1.0, None), (1, None, 1.0, 1.0, None), (1, "only", None, None, None)]
    got = fused_ranking(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.chunk_id, r.rank_score) for r in got] == [("only", 1)]
    assert fused_ranking(spark.createDataFrame([], SCHEMA)).count() == 0
