"""Which of many short probes stand in which texts: one pass over the texts per block of
probes with an automaton of all of them, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probes of one automaton; more are taken in further passes.
BLOCK = 200_000


def _hits(probes: list[str], key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for probe in probes:
            automaton.add_word(probe, probe)
        automaton.make_automaton()
        for batch in batches:
            keys, found = [], []
            for name, text in zip(batch[key], batch["text"]):
                held = {probe for _, probe in automaton.iter(text)}
                keys.extend([name] * len(held))
                found.extend(held)
            yield pd.DataFrame({key: pd.Series(keys, dtype=batch[key].dtype), "probe": pd.Series(found, dtype=object)})

    return run


def contained(texts: DataFrame, key: str, text: str, probes: DataFrame, probe: str, block: int = BLOCK) -> DataFrame:
    """``key, probe`` of the probes that stand literally in the text, each once per row.

    The probes are the stated request: they are read to the driver and sent to the tasks
    in blocks. Null and empty texts and probes have no hits; letter case counts; rows of
    ``texts`` that repeat give repeated hits.
    """
    spark = texts.sparkSession
    rows = texts.select(key, F.col(text).alias("text")).filter(F.col("text").isNotNull())
    schema = f"{key} {texts.schema[key].dataType.simpleString()}, probe string"
    found, held = None, []

    def take(last: DataFrame | None) -> DataFrame:
        one = rows.mapInPandas(_hits(list(held), key), schema)
        return one if last is None else last.unionByName(one)

    for row in probes.select(probe).filter(F.col(probe) != "").distinct().toLocalIterator():
        held.append(row[0])
        if len(held) == block:
            found = take(found)
            held = []
    if held:
        found = take(found)
    return found if found is not None else spark.createDataFrame([], schema)
