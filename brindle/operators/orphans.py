"""References to records that do not exist.

The state of an id is whether a parent is there, and which references wait for it: new
references probe it, arriving parents resolve what waits, deletions reopen it, and counts
are taken as snapshots. ``orphan_references`` replays the whole log of every id in one
plan; ``OrphanLedger`` keeps the state on a shared file system, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.session import cut_lineage
from brindle.sources.commits import CommitLog, KeyedTable

#: Resolutions that promise that the target exists.
RESOLVED = ("resolved_exact", "resolved_unique")


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^[\s\p{Z}]*$")


def references(relations: DataFrame) -> DataFrame:
    """The references of the live relations: ``relation_id, side, ref_id, recorded_at``."""
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_signal_id").alias("ref_id")),
        F.when(F.col("resolution").isin(*RESOLVED), F.struct(F.lit("target").alias("side"), F.col("target_signal_id").alias("ref_id"))),
    )
    return (
        relations.filter(F.col("deleted_at").isNull())
        .select("relation_id", "recorded_at", F.explode(F.array_compact(sides)).alias("r"))
        .select("relation_id", "r.side", "r.ref_id", "recorded_at")
    )


def parent_index(signals: DataFrame) -> DataFrame:
    """Live signals with the first moment each id was recorded. A signal of unknown
    time counts as always there."""
    always = F.to_timestamp(F.lit("0001-01-01"))
    return (
        signals.filter(F.col("deleted_at").isNull() & F.col("signal_id").isNotNull())
        .groupBy("signal_id")
        .agg(F.min(F.coalesce(F.col("recorded_at"), always)).alias("first_seen"))
    )


#: References of one id that one task replays; an id with more is dealt out.
ROWS_PER_PIECE = 100_000


def orphan_references(relations: DataFrame, signals: DataFrame, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """Orphan references: ``relation_id, side, ref_id, recorded_at, kind, resolved_at``.

    The log of every id is replayed in order of time: the arrival of a parent is kept as
    the state of the id, a reference that finds no parent there waits, and the parent's
    later arrival resolves it. ``kind`` is ``blank`` (id null or blank), ``missing``
    (waits still) or ``late`` (resolved since, at ``resolved_at``). Only live signals are
    parents, so a deletion leaves their references waiting. A parent and a reference of
    one moment: the parent is first. A reference of unknown time comes last. Repeated
    relations give repeated rows; empty tables give no rows (no signals: all are orphans).

    One shuffle by id of the references and of one row per signal. An id with more than
    ``rows_per_piece`` references is dealt out in pieces, each with the one row of its
    parent, so no task replays a hot id whole. Blank ids need no state and no shuffle.
    """
    refs = references(relations).withColumn("blank", is_blank(F.col("ref_id")))
    probing = refs.filter(~F.col("blank")).drop("blank")
    hot = probing.groupBy("ref_id").agg(F.count("*").alias("held")).filter(F.col("held") > rows_per_piece)
    pieces = hot.select(F.col("ref_id").alias("hot_id"), F.ceil(F.col("held") / rows_per_piece).cast("int").alias("pieces"))

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.join(pieces, F.col(key) == F.col("hot_id"), "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).drop("hot_id")

    arrivals = dealt(parent_index(signals), "signal_id").select(
        F.col("signal_id").alias("ref_id"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("first_seen").alias("at"), F.lit(0).alias("turn"), "first_seen"
    )
    log = dealt(probing, "ref_id").select(
        "ref_id",
        F.pmod(F.xxhash64("relation_id", "side"), F.col("pieces")).cast("int").alias("piece"),
        F.coalesce("recorded_at", F.to_timestamp(F.lit("9999-12-31"))).alias("at"),
        F.lit(1).alias("turn"),
        "relation_id",
        "side",
        "recorded_at",
    )
    events = log.unionByName(arrivals, allowMissingColumns=True)
    key = Window.partitionBy("ref_id", "piece")
    order = key.orderBy("at", "turn")
    state = F.max("first_seen").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    arrival = F.max("first_seen").over(key)
    replayed = events.withColumns({"parent": state, "resolved_at": arrival})
    waiting = replayed.filter((F.col("turn") == 1) & F.col("parent").isNull())
    found = waiting.select("relation_id", "side", "ref_id", "recorded_at", F.when(F.col("resolved_at").isNull(), "missing").otherwise("late").alias("kind"), "resolved_at")
    blank = refs.filter("blank").select("relation_id", "side", "ref_id", "recorded_at", F.lit("blank").alias("kind"), F.lit(None).cast("timestamp").alias("resolved_at"))
    return found.unionByName(blank)


def orphan_counts(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Distinct orphan references per table and period of ``recorded_at``, as opened,
    resolved since, and still open."""
    distinct = orphans.groupBy("relation_id", "side").agg(F.min("recorded_at").alias("recorded_at"), F.max("kind").alias("kind"), F.max("resolved_at").alias("resolved_at"))
    late = F.col("resolved_at").isNotNull()
    return (
        distinct.withColumn("table_name", F.concat(F.lit("code_relations."), F.col("side")))
        .withColumn("period", F.date_format(F.date_trunc(period, "recorded_at"), "yyyy-MM-dd"))
        .groupBy("table_name", "period")
        .agg(
            F.count("*").alias("orphans"),
            F.count_if(F.col("kind") == "blank").alias("blank"),
            F.count_if(late).alias("resolved_later"),
            F.count_if(~late).alias("still_open"),
        )
    )


PARENTS = "signal_id string, first_seen timestamp"
REFS = "relation_id string, side string, ref_id string, recorded_at timestamp"
OPENED = REFS + ", kind string, resolved_at timestamp"
ALWAYS = "0001-01-01"


class OrphanLedger:
    """Pending orphans as keyed state, moved forward batch by batch.

    A version names three tables in hash buckets of the id: ``parents`` (with the first
    moment each was recorded), ``refs`` (all live references) and ``pending`` (those that
    wait), and the table ``opened`` of the references its batch found without a parent. A
    batch reads and rewrites only the buckets of the ids it names. It counts once its
    commit file exists; a batch that died, or lost the race against another writer, is
    done again from the newest version.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.log = spark, CommitLog(spark, folder)
        self._parents = KeyedTable(self.log, "parents", PARENTS, ["signal_id"], buckets)
        self._refs = KeyedTable(self.log, "refs", REFS, ["ref_id"], buckets)
        self._pending = KeyedTable(self.log, "pending", REFS, ["ref_id"], buckets)

    def version(self) -> int:
        return self.log.version()

    def pending(self) -> DataFrame:
        """The references that wait now."""
        return self._pending.read(self.log.read(self.log.version()))

    def opened(self) -> DataFrame:
        """Every reference that a batch has found without a parent, or that a deletion has
        reopened (``kind`` is then ``reopened``)."""
        names = [self.log.read(v)["opened"] for v in range(1, self.log.version() + 1)]
        return self.spark.read.schema(OPENED).parquet(*[f"{self.log.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], OPENED)

    def apply(self, refs: DataFrame, parents: DataFrame, deleted: DataFrame | None = None, removed: DataFrame | None = None, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """One batch; returns the references that wait afterwards.

        ``refs`` (relation_id, side, ref_id and maybe recorded_at) are new references,
        ``parents`` (signal_id and maybe recorded_at) arriving signals, ``deleted``
        (signal_id) signals that go, ``removed`` (relation_id, side, ref_id) references
        that go. Within a batch parents arrive first, then signals and references go, then
        new references probe: one recorded before its parent waits until the parent's
        moment and is opened as ``late``. Null signal ids are no parents; repeated rows
        count once; what is removed but unknown changes nothing.
        """
        spark = self.spark
        plain = lambda df, schema: df.select(*[F.col(c.split()[0]) if c.split()[0] in df.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
        new_refs = cut_lineage(plain(refs, REFS).distinct())
        arrived = parents.filter(F.col("signal_id").isNotNull())
        seen = F.coalesce(F.col("recorded_at"), F.to_timestamp(F.lit(ALWAYS))) if "recorded_at" in arrived.columns else F.to_timestamp(F.lit(ALWAYS))
        arrived = cut_lineage(arrived.groupBy("signal_id").agg(F.min(seen).alias("first_seen")))
        gone = (deleted if deleted is not None else spark.createDataFrame([], "signal_id string")).select("signal_id").dropna().distinct()
        left = (removed if removed is not None else spark.createDataFrame([], REFS)).select("relation_id", "side", "ref_id").distinct()
        ids = new_refs.select("ref_id").unionByName(left.select("ref_id")).unionByName(arrived.select(F.col("signal_id").alias("ref_id"))).unionByName(gone.select(F.col("signal_id").alias("ref_id")))
        touched = self._refs.touched(ids)
        same = lambda a, b: (F.col(f"{a}.relation_id").eqNullSafe(F.col(f"{b}.relation_id"))) & (F.col(f"{a}.side") == F.col(f"{b}.side")) & (F.col(f"{a}.ref_id").eqNullSafe(F.col(f"{b}.ref_id")))

        def work(version: int, content: dict) -> dict:
            now = self._parents.read(content, touched).unionByName(arrived).groupBy("signal_id").agg(F.min("first_seen").alias("first_seen")).join(gone, "signal_id", "left_anti")
            kept = lambda df: df.alias("o").join(left.alias("l"), same("o", "l"), "left_anti")
            old_refs, old_pending = kept(self._refs.read(content, touched)), kept(self._pending.read(content, touched))
            index = now.withColumnsRenamed({"signal_id": "parent_id", "first_seen": "parent_seen"})
            blank = is_blank(F.col("ref_id"))
            probed = new_refs.join(index, (F.col("ref_id") == F.col("parent_id")) & ~blank, "left")
            kind = F.when(blank, "blank").when(F.col("parent_seen").isNull(), "missing").when(F.col("parent_seen") > F.col("recorded_at"), "late")
            fresh = probed.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select("relation_id", "side", "ref_id", "recorded_at", "kind", F.col("parent_seen").alias("resolved_at"))
            reopened = old_refs.join(gone.withColumnRenamed("signal_id", "ref_id"), "ref_id", "left_semi").select("relation_id", "side", "ref_id", "recorded_at", F.lit("reopened").alias("kind"), F.lit(None).cast("timestamp").alias("resolved_at"))
            opened = fresh.unionByName(reopened)
            waiting = old_pending.join(index, F.col("ref_id") == F.col("parent_id"), "left_anti").unionByName(opened.filter(F.col("kind") != "late").drop("kind", "resolved_at")).distinct()
            home = self.log.new_folder()
            opened.write.parquet(f"{self.log.folder}/{home}/opened")
            made = self._parents.write(now, content, touched, home)
            made = self._refs.write(old_refs.unionByName(new_refs).distinct(), made, touched, home)
            return self._pending.write(waiting, made, touched, home) | {"opened": f"{home}/opened"}

        self.log.change(work, before_commit=before_commit)
        return self.pending()

    def snapshot(self, period: str = "month") -> DataFrame:
        """Open orphans per table and period of ``recorded_at``, as of the newest version."""
        named = self.pending().withColumns({"table_name": F.concat(F.lit("code_relations."), F.col("side")), "period": F.date_format(F.date_trunc(period, "recorded_at"), "yyyy-MM-dd")})
        return named.groupBy("table_name", "period").agg(F.count("*").alias("open_orphans"))


def replay_orphans(ledger: OrphanLedger, relations: DataFrame, signals: DataFrame, period: str = "month") -> DataFrame:
    """Both tables through the ledger, one batch per period of ``recorded_at`` in order;
    signals of unknown time come with the first batch, relations of unknown time with the
    last. Returns every reference that was ever opened. Periods are read to the driver:
    one value per month, whatever the rows."""
    refs = references(relations)
    live = signals.filter(F.col("deleted_at").isNull()).select("signal_id", "recorded_at")
    of = lambda df: df.select(F.date_trunc(period, "recorded_at").alias("p"))
    periods = [r["p"] for r in of(refs).unionByName(of(live)).distinct().orderBy(F.col("p").asc_nulls_last()).toLocalIterator()]
    known = [p for p in periods if p is not None]
    steps: list = known or [None]
    for n, p in enumerate(steps):
        mine = lambda df, open_end: df.filter((F.date_trunc(period, "recorded_at") == F.lit(p)) | (F.col("recorded_at").isNull() & F.lit(open_end)))  # noqa: B023, E731
        ledger.apply(mine(refs, n == len(steps) - 1), mine(live, n == 0))
    return ledger.opened()
