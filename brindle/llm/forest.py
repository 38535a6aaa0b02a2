"""Most similar vectors for every vector: a hash-prefix forest.

Each tree gives every vector a long string of hash bits (the sides of random
hyperplanes) and keeps the strings of a space as one sorted array. The vectors that share
a prefix with a vector are one run of the array: from the longest prefix that matches, the
run widens as the prefix gets shorter. All trees ascend together, one bit at a time, until
they hold ``candidates`` vectors between them; where that is, is told by a bounded sample
of each space before the arrays are sorted, so strings and ids are shuffled once and
vectors never with them. Within its run a vector keeps the nearest by the bits of the whole
string, and these are compared exactly, in double.

What is close is found that way. The nearest of a vector without close ones may share no
long prefix with it in any tree: for a stated set of queries ``complete`` compares all
rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import cut_lineage

#: Bits of half a hash string: two signed 64-bit keys hold one, the first keeps the order.
BITS = 63
#: Vectors of all spaces that the sample holds at most; fewest of one space.
SAMPLE, LEAST_SAMPLE = 16384, 256
#: Rows of a sorted range, rows of it compared at a time, and queries of a block.
RANGE_ROWS, STEP, BLOCK = 200_000, 256, 2048
#: Standard deviations that the bits of a pair at the least cosine may differ beyond their mean.
SPREAD = 3.0


def planes(dimensions: int, trees: int) -> np.ndarray:
    """The hyperplanes of all trees: ``dimensions x (trees * 2 * BITS)``."""
    return np.random.default_rng([20250101, dimensions]).standard_normal((dimensions, trees * 2 * BITS), dtype=np.float32)


def hash_strings(vectors: np.ndarray, made: np.ndarray, trees: int) -> np.ndarray:
    """Both halves of the strings of all trees: ``rows x trees x 2``."""
    weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    return (vectors.astype(np.float32) @ made > 0).reshape(len(vectors), trees, 2, BITS) @ weights


def prefix_run(ordered: np.ndarray, keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where in a sorted array the keys that share the first ``level`` bits begin and end."""
    rest = np.int64((1 << BITS) - 1) >> np.asarray(level, dtype=np.int64)
    return np.searchsorted(ordered, keys & ~rest, "left"), np.searchsorted(ordered, keys | rest, "right")


def ascent_stops(keys: np.ndarray, sample: np.ndarray, share: float, candidates: int) -> np.ndarray:
    """For every row the longest prefix at which all trees together hold ``candidates``
    vectors. ``keys`` is ``rows x trees``, ``sample`` has the sorted keys of the sample per
    tree, each of which stands for ``share`` vectors."""
    deepest = max(1, int(math.log2(max(2, len(sample)))) + 1)
    stops = np.full(len(keys), -1, dtype=np.int64)
    for level in range(deepest, -1, -1):
        open_rows = np.flatnonzero(stops < 0)
        if not len(open_rows):
            break
        held = np.zeros(len(open_rows))
        for tree in range(keys.shape[1]):
            low, high = prefix_run(sample[:, tree], keys[open_rows, tree], level)
            held += high - low
        enough = held * share >= candidates
        # Beyond what the sample resolves a bit more halves what is held.
        further = np.floor(np.log2(np.maximum(1.0, held * share / candidates))) if level == deepest else np.zeros(len(held))
        stops[open_rows[enough]] = np.minimum(BITS, level + further[enough]).astype(np.int64)
    return np.maximum(stops, 0)


def _hashed(trees: int, candidates: int, samples: dict[str, tuple[np.ndarray, float]]) -> Callable:
    """``samples`` has per space the sample's vectors and how many vectors each stands for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        sorted_samples: dict[str, np.ndarray] = {}
        for batch in batches:
            for (space, dimensions), part in batch.groupby(["space", "dimensions"]):
                made = known.setdefault(int(dimensions), planes(int(dimensions), trees))
                if space not in sorted_samples:
                    sorted_samples[space] = np.sort(hash_strings(samples[space][0], made, trees)[:, :, 0], axis=0)
                for start in range(0, len(part), 1024):
                    rows = part.iloc[start : start + 1024]
                    keys = hash_strings(np.stack(rows["vector"].to_numpy()), made, trees)
                    stops = ascent_stops(keys[:, :, 0], sorted_samples[space], samples[space][1], candidates)
                    stops[~rows["asks"].to_numpy(dtype=bool)] = -1
                    for tree in range(trees):
                        yield pd.DataFrame({"space": space, "tree": tree, "key": keys[:, tree, 0], "rest": keys[:, tree, 1], "stop": stops, "vec_id": rows["vec_id"].to_numpy()})

    return run


def _bits_apart(least: float) -> int:
    """Bits in which strings of vectors with the cosine ``least`` differ at most, but for
    a deviation beyond ``SPREAD``."""
    share = math.acos(max(-1.0, min(1.0, least))) / math.pi
    return min(2 * BITS, math.ceil(2 * BITS * share + SPREAD * math.sqrt(2 * BITS * share * (1 - share)))) if least > -1 else 2 * BITS


def _candidates(keep: int, reach: int, least: float) -> Callable:
    """Pairs of ids, the asking one first: of the run of its prefix, at most ``reach`` places
    to each side, the ``keep`` with the fewest bits apart."""
    most = _bits_apart(least)

    def compare(key: np.ndarray, rest: np.ndarray, stop: np.ndarray, ids: np.ndarray, first: int, last: int) -> pd.DataFrame:
        rows = np.arange(first, last)[stop[first:last] >= 0]
        if not len(rows):
            return pd.DataFrame({"vec_id": ids[:0], "other": ids[:0]})
        low, high = prefix_run(key, key[rows], stop[rows])
        low, high = np.maximum(low, rows - reach), np.minimum(high, rows + reach + 1)
        start, end = low.min(), high.max()
        apart = np.bitwise_count(key[rows, None] ^ key[None, start:end]) + np.bitwise_count(rest[rows, None] ^ rest[None, start:end])
        places = np.arange(start, end)
        apart[(places < low[:, None]) | (places >= high[:, None]) | (places == rows[:, None])] = 255
        if keep < apart.shape[1]:
            near = np.argpartition(apart, keep - 1, axis=1)[:, :keep]
        else:
            near = np.tile(np.arange(apart.shape[1]), (len(rows), 1))
        good = np.take_along_axis(apart, near, axis=1) <= most
        mine = np.repeat(rows, near.shape[1]).reshape(near.shape)
        return pd.DataFrame({"vec_id": ids[mine[good]], "other": ids[start + near[good]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # of one space and tree, with the first row not yet compared
        first = 0

        def flush(end: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, first
            space, size = held["space"].iat[0], len(held)
            key, rest, stop, ids = (held[c].to_numpy() for c in ("key", "rest", "stop", "vec_id"))
            while first < size and (end or first + STEP + reach <= size):
                last = min(first + STEP, size)
                yield compare(key, rest, stop, ids, first, last).assign(space=space)[["space", "vec_id", "other"]]
                first = last
            drop = max(0, first - reach)
            held, first = held.iloc[drop:], first - drop

        for batch in batches:
            for _, part in batch.groupby(["space", "tree"], sort=False):
                same = held is not None and (held["space"].iat[0], held["tree"].iat[0]) == (part["space"].iat[0], part["tree"].iat[0])
                if held is not None and not same:
                    yield from flush(True)
                held, first = (pd.concat([held, part], ignore_index=True), first) if same else (part, 0)
                yield from flush(False)
        if held is not None:
            yield from flush(True)

    return run


def comparable_vectors(vectors: DataFrame, configs: DataFrame) -> DataFrame:
    """``space, vec_id, chunk_id, dimensions, vector`` of the vectors that take part: of
    the length the config names, all numbers finite, not all zero."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    named = configs.select(F.col("config_hash").alias("space"), "dimensions").dropna().dropDuplicates(["space"])
    rows = vectors.select(F.col("config_hash").alias("space"), "vec_id", "chunk_id", "vector").dropna(subset=["vec_id", "vector"])
    return rows.join(named, "space").filter((F.size("vector") == F.col("dimensions")) & finite & some).select("space", "vec_id", "chunk_id", F.col("dimensions").cast("int").alias("dimensions"), "vector")


def _cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for _, part in batch.groupby("space", sort=False):
            left, right = (np.stack(part[c].to_numpy()).astype(np.float64) for c in ("vector", "other_vector"))
            cosine = np.einsum("ij,ij->i", left / np.linalg.norm(left, axis=1, keepdims=True), right / np.linalg.norm(right, axis=1, keepdims=True))
            made.append(part[["space", "vec_id", "other"]].assign(cosine=np.round(cosine, 12)))
        if made:
            yield pd.concat(made)


NEAR = "space string, vec_id bigint, other bigint, cosine double"


def _best(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("space", "vec_id").orderBy(F.desc("cosine"), "other")
    return near.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def _block_best(k: int, least: float) -> Callable:
    """The best ``k`` for the queries of one block among one slice of the rows."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(dtype=bool)
        unit = np.stack(part["vector"].to_numpy()).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        ids = part["vec_id"].to_numpy()
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows, others, cosines = [], [], []
        for start in range(0, len(mine), STEP):
            own = mine[start : start + STEP]
            near = unit[own] @ unit[theirs].T
            near[ids[own][:, None] == ids[theirs][None, :]] = -2
            wide = min(k + 3, near.shape[1])
            if not wide:
                continue
            best = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
            # All that are as good as the last of them to twelve digits come along.
            bound = np.take_along_axis(near, best, axis=1).min(axis=1) - 1e-11
            a, b = np.nonzero(near >= np.maximum(bound, max(-1.5, least - 1e-9))[:, None])
            rows.append(ids[own[a]])
            others.append(ids[theirs[b]])
            cosines.append(np.einsum("ij,ij->i", unit[own[a]], unit[theirs[b]]))
        rows, others, cosines = (np.concatenate(x) if x else np.zeros(0) for x in (rows, others, cosines))
        found = pd.DataFrame({"space": key[0], "vec_id": rows.astype(np.int64), "other": others.astype(np.int64), "cosine": np.round(cosines, 12)})
        return found.sort_values(["vec_id", "cosine", "other"], ascending=[True, False, True]).groupby("vec_id").head(k)

    return run


def exact_nearest(vectors: DataFrame, asks: str, k: int = 5, least: float = -1.0) -> DataFrame:
    """The ``k`` nearest of every vector for which ``asks`` holds, against all rows:
    ``space, vec_id, other, cosine, position``; a stated query set, in blocks.

    The queries of a space are cut into blocks of some ``BLOCK``; each block meets every
    slice of the rows once, so a task holds one block and one slice, whatever the size of
    the space. Work is the number of queries times that of rows.
    """
    distinct = vectors.select("space", "vec_id", "vector").dropDuplicates(["space", "vec_id"]).withColumn("asks", F.coalesce(F.expr(asks), F.lit(False)))
    sizes = distinct.groupBy("space").agg(F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("slices")).filter(F.col("blocks") > 0)
    rows = distinct.join(sizes, "space").withColumns({"own_slice": F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int"), "own_block": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")})
    as_row = rows.select("space", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("own_slice").alias("slice"), "vec_id", "vector", F.lit(False).alias("asks"))
    as_query = rows.filter("asks").select("space", F.col("own_block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "vec_id", "vector", F.lit(True).alias("asks"))
    met = as_row.unionByName(as_query).groupBy("space", "block", "slice").applyInPandas(_block_best(k, least), NEAR)
    return _best(met.filter(F.col("cosine") >= least) if least > -1 else met, k)


def _samples(lowest: DataFrame) -> dict[str, tuple[np.ndarray, float]]:
    """Vectors of the sample per space, and the number of vectors each stands for. Spaces
    are few, as configurations are; of their rows no more than ``SAMPLE`` reach the driver."""
    counts = {r["space"]: r["n"] for r in lowest.groupBy("space").agg(F.count("*").alias("n")).toLocalIterator()}
    each = max(LEAST_SAMPLE, SAMPLE // max(1, len(counts)))
    order = Window.partitionBy("space").orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id")
    held: dict[str, list] = {}
    for r in lowest.select("space", "vec_id", "vector").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).toLocalIterator():
        held.setdefault(r["space"], []).append(r["vector"])
    return {space: (np.array(rows, dtype=np.float32), counts[space] / len(rows)) for space, rows in held.items()}


def nearest_vectors(vectors: DataFrame, k: int = 5, trees: int = 12, candidates: int = 4096, keep: int = 32, least: float = -1.0, asks: str | None = None) -> DataFrame:
    """The ``k`` most similar vectors of every vector: ``space, vec_id, other, cosine, position``.

    ``vectors`` has ``space, vec_id, dimensions, vector``; only vectors of one space are
    compared, and only those for which ``asks`` (a condition on ``vec_id`` in SQL) holds ask for
    neighbours. ``cosine`` is in double to twelve digits; equal ones go by the smaller id.
    Neighbours under ``least`` are left out as early as possible, which changes none of the
    others. A repeated ``vec_id`` counts once. Vectors equal number for number are one
    class: its least id stands for it in the forest, and its members come back as neighbours
    of each other and in place of it, so copies never crowd a prefix. Empty input gives no
    rows. An index: what shares no long prefix in any tree is missed.

    The sorted arrays are one range-partitioned sort of hash strings and ids by
    ``(space, tree, string)``; ranges balance by rows, so a space, or a prefix, with any
    share of all vectors is many tasks. A task reads its range in order and holds twice the
    places a vector looks at; only at the edges of a range fewer are seen, at other places
    in every tree. Of a run longer than all ``candidates`` (denser than the sample tells) a
    vector looks at as many places to each side. Vectors meet only the pairs that are kept.
    """
    distinct = vectors.select("space", "vec_id", "dimensions", "vector").dropDuplicates(["space", "vec_id"])
    asking = F.lit(True) if asks is None else F.coalesce(F.expr(asks), F.lit(False))
    classes = distinct.withColumn("asks", asking).groupBy("space", "dimensions", "vector")
    lowest = cut_lineage(classes.agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"), F.max("asks").alias("asks")))
    samples = _samples(lowest)
    if not samples:
        return vectors.sparkSession.createDataFrame([], NEAR + ", position int")
    rows = trees * sum(len(v) * share for v, share in samples.values())
    hashed = lowest.select("space", "vec_id", "dimensions", "vector", "asks").mapInPandas(_hashed(trees, candidates, samples), "space string, tree int, key bigint, rest bigint, stop int, vec_id bigint")
    ordered = hashed.repartitionByRange(max(2, math.ceil(rows / RANGE_ROWS)), "space", "tree", "key", "vec_id").sortWithinPartitions("space", "tree", "key", "vec_id")
    pairs = ordered.mapInPandas(_candidates(keep, candidates, least), "space string, vec_id bigint, other bigint").distinct()
    known = lowest.select("space", "vec_id", "vector")
    met = pairs.join(known, ["space", "vec_id"]).join(known.withColumnsRenamed({"vec_id": "other", "vector": "other_vector"}), ["space", "other"])
    near = met.select("space", "vec_id", "other", "vector", "other_vector").mapInPandas(_cosines, NEAR)
    return _with_copies(_best(near.filter(F.col("cosine") >= least), k), distinct, lowest, k, asking)


def _with_copies(best: DataFrame, distinct: DataFrame, lowest: DataFrame, k: int, asking: Column) -> DataFrame:
    """Class neighbours to vector neighbours. Of a class no more than its ``k + 1`` least
    ids can be among anyone's ``k`` nearest, so a class of any size adds at most those."""
    several = lowest.filter(F.col("members") > 1).select("space", F.col("vec_id").alias("lead"), "vector")
    members = distinct.join(several, ["space", "vector"]).select("space", "lead", F.col("vec_id").alias("member"))
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("space", "lead").orderBy("member"))).filter(F.col("at") <= k + 1).drop("at")
    # Each neighbour class brings its first members; each vector brings its class's list.
    wide = best.join(first.withColumnRenamed("lead", "other"), ["space", "other"], "left").select("space", F.col("vec_id").alias("lead"), F.coalesce("member", "other").alias("other"), "cosine")
    all_members = members.withColumnRenamed("member", "vec_id")
    own = all_members.join(first, ["space", "lead"]).filter(F.col("vec_id") != F.col("member")).select("space", "vec_id", F.col("member").alias("other"), F.lit(1.0).alias("cosine"))
    spread = wide.join(all_members, ["space", "lead"], "left").select("space", F.coalesce("vec_id", "lead").alias("vec_id"), "other", "cosine")
    return _best(spread.unionByName(own).filter(asking), k)


def similar_pairs(nearest: DataFrame) -> DataFrame:
    """Distinct pairs, smaller id first, where one is among the nearest of the other."""
    return nearest.select("space", F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
