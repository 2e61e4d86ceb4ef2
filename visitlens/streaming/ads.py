"""Streams over parsed ad clicks.

Each function returns a writer that is not started; the caller sets the trigger. What a
batch adds is written into folders of its own (see ``sinks/batches``), so a batch that runs
twice leaves the same state as one that ran once. Dates are those of the session's time
zone, as in the batch reports.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from visitlens import schemas
from visitlens.functions.observing import observed
from visitlens.functions.times import millis_of
from visitlens.operators.ads import (
    blacklisted_users,
    place_counts,
    province_top3,
    trend_columns,
    user_click_counts,
    with_listing,
)
from visitlens.sinks.batches import BY_DATE, EVERY, CommitRecord, StateTable, last_commit
from visitlens.sinks.parallel import together
from visitlens.sources.adlog import CLICK_COLUMNS, REASONS, REJECT_COLUMNS, counted, rejected_counts

STAT_KEY = ("date", "province", "city", "ad_id")
USER_KEY = ("date", "user_id", "ad_id")
TREND_KEY = ("date", "hour", "minute", "ad_id")
TOP3_KEY = ("date", "province", "ad_id")
CLICK = "click_time timestamp, province string, city string, user_id bigint, ad_id bigint"
ALLOWED, LISTED = "allowed click", "click of a listed user"
OUTCOMES = (ALLOWED, LISTED, *REASONS)


def _writer(rows: DataFrame, mode: str, checkpoint: str, save) -> DataStreamWriter:
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )


@dataclass(frozen=True)
class AdTables:
    """The tables of the ad stream, under one folder."""

    out: str
    every: int = EVERY

    def _counts(self, name: str, schema: str, key: tuple[str, ...]) -> StateTable:
        return StateTable(f"{self.out}/{name}", schema, key, "click_count", "sum", BY_DATE, self.every)

    @property
    def user_counts(self) -> StateTable:
        return self._counts("ad_user_click_count", schemas.AD_USER_CLICK_COUNT, USER_KEY)

    @property
    def stat(self) -> StateTable:
        return self._counts("ad_stat", schemas.AD_STAT, STAT_KEY)

    @property
    def blacklist(self) -> StateTable:
        return StateTable(
            f"{self.out}/ad_blacklist", schemas.AD_BLACKLIST, ("user_id",), None, "distinct", (), self.every
        )

    @property
    def lines(self) -> StateTable:
        """A log of allowed clicks and of rejected lines, apart: it is read by batch or whole,
        and never merged."""
        schema = f"{CLICK}, value string, reason string, rejected boolean"
        key = (*CLICK_COLUMNS, *REJECT_COLUMNS)
        return StateTable(f"{self.out}/ad_lines", schema, key, None, "distinct", ("rejected",))

    @property
    def rejected(self) -> StateTable:
        return StateTable(
            f"{self.out}/rejected_ad_lines", schemas.REJECTED_AD_LINES, REJECT_COLUMNS, "line_count", "sum", (), self.every
        )

    @property
    def outcomes(self) -> StateTable:
        """How many lines came to what."""
        return StateTable(
            f"{self.out}/ad_line_outcomes", schemas.AD_LINE_OUTCOMES, ("outcome",), "line_count", "sum", (), self.every
        )

    @property
    def top3(self) -> StateTable:
        return StateTable(
            f"{self.out}/ad_province_top3", schemas.AD_PROVINCE_TOP3, TOP3_KEY, "click_count", "replace", BY_DATE, self.every
        )

    @property
    def merged(self) -> tuple[StateTable, ...]:
        return self.user_counts, self.stat, self.blacklist, self.top3, self.rejected, self.outcomes

    @property
    def commits(self) -> str:
        return f"{self.out}/commits"


def ad_stream(
    read: DataFrame, threshold: int, out: str, checkpoint: str, every: int = EVERY
) -> DataStreamWriter:
    """Keep all ad tables from one pass over read ad lines (or over clicks alone).

    Batch n is filtered by the blacklist after batch n - 1. Its allowed clicks are added to
    the counts per user and per place, whenever they happened; users who reach the threshold
    on a date that the batch touched go on the list, and the top ads of these dates are
    ranked anew. Rejected lines go to tables of their own, and what became of every line is
    counted while the batch is written. No state is kept in Spark's store and no late click
    is dropped. Readers see all tables as of the same batch.
    """
    spark = read.sparkSession
    tables = AdTables(out, every)
    record = CommitRecord(tables.commits, checkpoint)
    record.create(spark)
    record.require(spark)
    if "reason" not in read.columns:
        read = read.select(*CLICK_COLUMNS, *[F.lit(None).cast("string").alias(c) for c in REJECT_COLUMNS])

    def save(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        record.require(session, batch_id)
        known = tables.blacklist.read(session, batch_id - 1)
        outcome = F.coalesce("reason", F.when(F.col("listed"), LISTED).otherwise(ALLOWED))
        marked, seen = counted(with_listing(rows, known), outcome, OUTCOMES)
        wanted = marked.where(~F.col("listed")).withColumn("rejected", F.col("reason").isNotNull())
        tables.lines.write(wanted.select(*tables.lines.key, "rejected"), batch_id)
        # What was written is read back: the join above runs once, and a lost executor
        # costs a re-read instead of a re-run.
        written = tables.lines.delta(session, batch_id)
        passed = written.where("NOT rejected")
        came = session.createDataFrame(list(observed(seen).items()), schemas.AD_LINE_OUTCOMES)
        together(
            lambda: tables.user_counts.write(user_click_counts(passed), batch_id),
            lambda: tables.stat.write(place_counts(passed), batch_id),
            lambda: tables.rejected.write(rejected_counts(written.where("rejected")), batch_id),
            lambda: tables.outcomes.write(came.where("line_count > 0").coalesce(1), batch_id),
        )

        dates = tables.stat.delta(session, batch_id).select("date").distinct()
        over = blacklisted_users(tables.user_counts.read(session, batch_id, dates, running=True), threshold)
        top = province_top3(tables.stat.read(session, batch_id, dates, running=True))
        together(
            lambda: tables.blacklist.write(over.join(known, "user_id", "left_anti"), batch_id),
            lambda: tables.top3.write(top, batch_id),
        )
        together(*[partial(table.snapshot, session, batch_id) for table in tables.merged])
        record.commit(session, batch_id)

    return _writer(read, "append", checkpoint, save)


def _committed(spark: SparkSession, tables: AdTables) -> int:
    return last_commit(spark, tables.commits).batch


def read_ad_stat(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    tables = AdTables(out, every)
    return tables.stat.read(spark, _committed(spark, tables))


def read_user_click_counts(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    tables = AdTables(out, every)
    return tables.user_counts.read(spark, _committed(spark, tables))


def read_blacklist(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    tables = AdTables(out, every)
    return tables.blacklist.read(spark, _committed(spark, tables))


def _logged(spark: SparkSession, out: str, rejected: bool) -> DataFrame:
    tables = AdTables(out)
    log = spark.read.schema(f"{tables.lines.schema}, kind string, batch bigint").parquet(tables.lines.path)
    return log.where((F.col("batch") <= _committed(spark, tables)) & (F.col("rejected") == rejected))


def read_allowed_clicks(spark: SparkSession, out: str) -> DataFrame:
    """All clicks that finished batches let through."""
    return _logged(spark, out, False).select(*CLICK_COLUMNS)


def read_rejected_lines(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    """The lines that were no clicks, with a reason and how often each came."""
    tables = AdTables(out, every)
    return tables.rejected.read(spark, _committed(spark, tables))


def read_line_outcomes(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    """What became of all lines that arrived."""
    tables = AdTables(out, every)
    return tables.outcomes.read(spark, _committed(spark, tables))


def read_province_top3(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    """The top ads of every date, as of the last finished batch; a date that a batch touches
    is replaced as a whole."""
    tables = AdTables(out, every)
    return tables.top3.read(spark, _committed(spark, tables))


def _trend_table(out: str, every: int) -> StateTable:
    return StateTable(
        f"{out}/ad_click_trend",
        f"{schemas.AD_CLICK_TREND}, late boolean",
        (*TREND_KEY, "late"),
        "click_count",
        "sum",
        BY_DATE,
        every,
    )


def click_trend_stream(
    clicks: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", every: int = EVERY
) -> DataStreamWriter:
    """Keep ``ad_click_trend``: clicks per ad in one-minute windows of event time.

    The watermark of a batch is the largest time of the batches before it, less ``delay``.
    Clicks of a minute that ends at the watermark or before are late: the trend leaves them
    out, and ``read_late_clicks`` gives their counts, so trend and late add up to all clicks.
    The watermark is part of the commit record; Spark's store keeps nothing.
    """
    spark = clicks.sparkSession
    table, record = _trend_table(out, every), CommitRecord(f"{out}/commits", checkpoint)
    record.create(spark)
    record.require(spark)
    patience = millis_of(spark, delay)

    def save(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        before = record.mark_before(session, batch_id)
        ends = F.unix_millis("minute_start") + 60_000
        late = F.lit(False) if before is None else ends <= before - patience
        per_minute = rows.groupBy(F.date_trunc("minute", "click_time").alias("minute_start"), "ad_id").agg(
            F.count("*").alias("click_count"), F.max(F.unix_millis("click_time")).alias("last")
        )
        # A task that runs twice is observed twice, which leaves a maximum as it is.
        newest = Observation()
        watched = per_minute.observe(newest, F.max("last").alias("last"))
        table.write(trend_columns(watched, late.alias("late")), batch_id)
        table.snapshot(session, batch_id)
        mark = max((m for m in (before, observed(newest).get("last")) if m is not None), default=None)
        record.commit(session, batch_id, mark, before)

    return _writer(clicks, "append", checkpoint, save)


def _trend(spark: SparkSession, out: str, every: int, late: bool) -> DataFrame:
    table = _trend_table(out, every)
    rows = table.read(spark, last_commit(spark, f"{out}/commits").batch)
    return rows.where(F.col("late") == late).select(*TREND_KEY, "click_count")


def read_click_trend(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    return _trend(spark, out, every, late=False)


def read_late_clicks(spark: SparkSession, out: str, every: int = EVERY) -> DataFrame:
    """Clicks per ad and minute that came behind the watermark of their batch."""
    return _trend(spark, out, every, late=True)
