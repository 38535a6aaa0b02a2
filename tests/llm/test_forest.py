import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm.forest import ascent_stops, comparable_vectors, nearest_vectors, similar_pairs
from brindle.llm.queries_vectors import p7_nearest


def exact(ids, vectors, k, step=1):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(near[n, j], 12), ids[j]))[:k]] for n, i in enumerate(ids) if n % step == 0}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 24))
    vectors = (centres[rng.integers(0, 60, 1500)] + 0.25 * rng.standard_normal((1500, 24))).astype(np.float32)
    df = spark.createDataFrame([("s", i, 24, v.tolist()) for i, v in enumerate(vectors)], "space string, vec_id bigint, dimensions int, vector array<float>")
    found = {}
    for r in nearest_vectors(df.withColumn("lead", F.lit(1)), k=5, trees=10, candidates=640).collect():
        found.setdefault(r.vec_id, set()).add(r.other)
    want = exact(list(range(1500)), vectors.astype(np.float64), 5)
    hits = sum(len(found.get(i, set()) & set(w)) for i, w in want.items())
    assert hits / (5 * 1500) >= 0.9


def test_copies_and_ties(spark):
    base = [1.0, 0.0, 0.5]
    rows = [("s", i, 3, base) for i in range(9)] + [("s", 20, 3, [1.0, 0.1, 0.5]), ("s", 21, 3, [2.0, 0.0, 1.0]), ("s", 0, 3, base)]
    df = spark.createDataFrame(rows, "space string, vec_id bigint, dimensions int, vector array<float>")
    near = {}
    for r in nearest_vectors(df, k=5).collect():
        near.setdefault(r.vec_id, []).append((r.position, r.other))
    assert [o for _, o in sorted(near[0])] == [1, 2, 3, 4, 5]
    assert [o for _, o in sorted(near[8])] == [0, 1, 2, 3, 4]
    assert [o for _, o in sorted(near[20])] == [0, 1, 2, 3, 4]
    assert near.keys() == {*range(9), 20, 21}


def test_what_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", "h", [1.0, 2.0]), (2, "a", "h", None), (3, "a", "h", []), (4, "a", "h", [1.0, 2.0, 3.0]), (5, "a", "h", [0.0, 0.0]), (6, "a", "h", [nan, 1.0]), (7, "a", "h", [inf, 1.0]), (8, "a", "x", [1.0, 2.0]), (9, None, "h", [3.0, 1.0]), (None, "a", "h", [1.0, 1.0]), (10, "b", "h", [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, chunk_id string, config_hash string, vector array<float>").withColumn("space", F.lit("q"))
    configs = spark.createDataFrame([("h", "p", "m", 2)], "config_hash string, provider string, model string, dimensions int")
    kept = comparable_vectors(vectors, configs)
    assert sorted(r.vec_id for r in kept.collect()) == [1, 9]
    assert [(r.vec_id_a, r.vec_id_b) for r in similar_pairs(nearest_vectors(kept, least=0.5)).collect()] == [(1, 9)]
    assert nearest_vectors(kept.limit(0)).count() == 0
    assert nearest_vectors(kept.filter("vec_id = 1")).count() == 0


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_threshold_drops_only_what_is_under_it(spark, least):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((80, 6)).astype(np.float32)
    df = spark.createDataFrame([("s", i, 6, v.tolist()) for i, v in enumerate(vectors)], "space string, vec_id bigint, dimensions int, vector array<float>")
    got = {(r.vec_id, r.other) for r in nearest_vectors(df, k=5, least=least).collect()}
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(i, j) for i, js in exact(list(range(80)), vectors.astype(np.float64), 5).items() for j in js if unit[i] @ unit[j] >= least}
    assert got == want


def test_nearest_query_loses_nothing(spark, tmp_path):
    vectors = np.random.default_rng(4).standard_normal((6000, 48)).astype(np.float32)
    vectors[100:104] = vectors[50]  # copies
    spark.createDataFrame([(i, f"c{i}", "h", v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, chunk_id string, config_hash string, vector array<float>").write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    spark.createDataFrame([("h", "p", "m", 48)], "config_hash string, provider string, model string, dimensions int").write.parquet(f"{tmp_path}/embedding_configs.parquet")
    got = {}
    for r in p7_nearest(spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, {})[r.position] = r.other
    want = exact(list(range(6000)), vectors.astype(np.float64), 5, 50)
    assert got == {i: {n + 1: int(j) for n, j in enumerate(want[i])} for i in range(0, 6000, 50)}


def test_close_pairs_are_found_where_a_run_is_a_small_part_of_the_space(spark):
    """Close pairs among many strangers, with 256 candidates of 8,000 vectors."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((8000, 64))
    vectors[4000:4400] = vectors[:400] + 0.35 * rng.standard_normal((400, 64))
    vectors = vectors.astype(np.float32)
    df = spark.createDataFrame([("s", i, 64, v.tolist()) for i, v in enumerate(vectors)], "space string, vec_id bigint, dimensions int, vector array<float>")
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    want = {(i, 4000 + i) for i in range(400) if unit[i] @ unit[4000 + i] >= 0.88}
    got = {(r.vec_id_a, r.vec_id_b) for r in similar_pairs(nearest_vectors(df, k=5, trees=24, candidates=256, least=0.88)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_ascent_stops_where_all_trees_hold_enough():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 2**63, (500, 3), dtype=np.int64)
    stops = ascent_stops(keys, np.sort(keys, axis=0), 1.0, 60)
    for row in range(0, 500, 25):
        held = [sum(int(((keys[:, t] >> (63 - level)) == (keys[row, t] >> (63 - level))).sum()) for t in range(3)) for level in (stops[row], stops[row] + 1)]
        assert held[0] >= 60 > held[1] or stops[row] > 8
