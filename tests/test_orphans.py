import datetime as dt

from pyspark.sql import functions as F

from brindle.operators.orphans import OrphanLedger, orphan_counts, orphan_references, replay_orphans

REL = "relation_id string, source_signal_id string, target_signal_id string, resolution string, deleted_at bigint, recorded_at timestamp"
SIG = "signal_id string, deleted_at bigint, recorded_at timestamp"


def day(n):
    return dt.datetime(2025, 1, n)


SIGNALS = [("s1", None, day(1)), ("s1", None, day(5)), ("late", None, day(9)), ("dead", 5, day(1)), ("both", 5, day(1)), ("both", None, day(2)), (None, None, day(1)), ("old", None, None)]
RELATIONS = [
    ("ok", "s1", "both", "resolved_exact", None, day(3)),
    ("ok", "s1", "both", "resolved_exact", None, day(3)),
    ("late", "late", "s1", "resolved_unique", None, day(3)),
    ("dead", "dead", None, "unresolved", None, day(3)),
    ("blank", " \t", "", "resolved_exact", None, day(3)),
    ("null", None, "s1", "resolved_exact", None, day(3)),
    ("padded", "s1 ", "gone", "ambiguous", None, day(3)),
    ("deleted", "nope", "nope", "resolved_exact", 7, day(3)),
    ("timeless", "late", "old", "resolved_exact", None, None),
]


def test_orphans(spark):
    relations = spark.createDataFrame(RELATIONS, REL).withColumns({c: F.lit(1) for c in ("signal_id", "side", "ref_id", "kind", "probe")})
    found = orphan_references(relations, spark.createDataFrame(SIGNALS, SIG).withColumn("relation_id", F.lit(0)))
    cases = {(r.relation_id, r.side): r.kind for r in found.collect()}
    assert cases == {
        ("late", "source"): "late",
        ("dead", "source"): "missing",
        ("blank", "source"): "blank",
        ("blank", "target"): "blank",
        ("null", "source"): "blank",
        ("padded", "source"): "missing",
    }
    counts = {(r.table_name, r.period): (r.orphans, r.blank, r.resolved_later, r.still_open) for r in orphan_counts(found).collect()}
    assert counts[("code_relations.source", "2025-01-01")] == (5, 2, 1, 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], REL)
    assert orphan_references(none, spark.createDataFrame(SIGNALS, SIG)).count() == 0
    every = orphan_references(spark.createDataFrame(RELATIONS[:1], REL), spark.createDataFrame([], SIG))
    assert every.count() == 2


def test_a_hot_id_is_replayed_in_pieces(spark):
    rows = [(f"r{n}", "hot", None, "unresolved", None, day(1 + n % 9)) for n in range(40)]
    signals = spark.createDataFrame([("hot", None, day(5))], SIG)
    want = {r[0] for r in rows if r[5] < day(5)}
    for size in (1000, 7, 1):
        found = orphan_references(spark.createDataFrame(rows, REL), signals, rows_per_piece=size)
        assert {r.relation_id for r in found.filter("side = 'source'").collect()} == want


def batches(spark):
    refs = lambda *rows: spark.createDataFrame(list(rows), "relation_id string, side string, ref_id string")
    ids = lambda *rows: spark.createDataFrame([(r,) for r in rows], "signal_id string")
    waiting = lambda df: {(r.relation_id, r.side) for r in df.collect()}
    return refs, ids, waiting


def test_ledger_resolves_and_reopens(spark, tmp_path):
    ledger = OrphanLedger(spark, str(tmp_path / "orphans"), buckets=2)
    refs, ids, waiting = batches(spark)
    assert waiting(ledger.apply(refs(("r1", "source", "a"), ("r2", "target", "b"), ("r3", "source", None)), ids("a"), ids())) == {("r2", "target"), ("r3", "source")}
    assert waiting(ledger.apply(refs(), ids("b"), ids())) == {("r3", "source")}
    assert waiting(ledger.apply(refs(), ids(), ids("a"))) == {("r3", "source"), ("r1", "source")}
    assert waiting(ledger.apply(refs(("r4", "target", "c")), ids("a", "c"), ids())) == {("r3", "source")}
    assert {r.table_name: r.open_orphans for r in ledger.snapshot().collect()} == {"code_relations.source": 1}
    # A reference that goes waits no longer and is not reopened.
    assert waiting(ledger.apply(refs(), ids(), ids(), refs(("r3", "source", None), ("r1", "source", "a")))) == set()
    assert waiting(ledger.apply(refs(), ids(), ids("a", "b"))) == {("r2", "target")}


def test_two_orphan_writers(spark, tmp_path):
    folder = str(tmp_path / "orphans")
    first, second = OrphanLedger(spark, folder, buckets=2), OrphanLedger(spark, folder, buckets=2)
    refs, ids, waiting = batches(spark)
    done = []

    def other():
        if not done:
            done.append(1)
            second.apply(refs(("r2", "source", "b")), ids("a"))

    # This batch was probed before the other writer's parent came; it is probed again.
    assert waiting(first.apply(refs(("r1", "source", "a")), ids(), before_commit=other)) == {("r2", "source")}
    assert first.version() == 2


def test_replay_through_the_ledger(spark, tmp_path):
    relations, signals = spark.createDataFrame(RELATIONS, REL), spark.createDataFrame(SIGNALS, SIG)
    opened = replay_orphans(OrphanLedger(spark, str(tmp_path / "orphans"), buckets=2), relations, signals, period="day")
    want = {(r.relation_id, r.side) for r in orphan_references(relations, signals).collect()}
    assert {(r.relation_id, r.side) for r in opened.collect()} == want
