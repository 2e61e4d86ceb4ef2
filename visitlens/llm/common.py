"""What several operators share: folders, stored stages, ranks, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names the shared folder where ``spark.checkpoint.dir``, which a running session refuses to
#: take, was not set when it began.
OWN_SETTING = "visitlens.shared.dir"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, which all executors share.

    Only a ``local[...]`` master, as in tests, may leave the setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="visitlens-")
        spark.conf.set(OWN_SETTING, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: a lost executor costs a re-read."""
    spark = rows.sparkSession
    path = work_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``most_bytes`` of one column, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0.0
        for i, size in enumerate(sizes):
            size = 0.0 if size != size else float(size)
            if i > start and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0.0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def ranked(rows: DataFrame, group: list[str], order: list[str], total: int, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0, without a group meeting in one task.

    Rows are dealt to chunks by a hash of ``order``; each chunk of a group is numbered on
    its own and moved by the rows of the chunks before it. ``total`` is the number of rows,
    and decides the number of chunks. Ties in ``order`` are numbered in any order.
    """
    chunks = max(1, total // 20_000)
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = (
        dealt.groupBy(*group, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(Window.partitionBy(*group).orderBy("_chunk")) - F.col("_n"),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order)) - 1
    numbered = dealt.withColumn("_local", local)
    return (
        numbered.join(before, [*group, "_chunk"])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_chunk", "_local", "_before")
    )


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component``: the smallest node that edges ``a, b`` reach, for nodes with edges.

    Alternating star steps: every node's larger neighbours move to its smallest neighbour,
    then its smaller ones do. Each round halves path lengths, is written to the shared
    folder, and the rounds stop when the edges no longer change. A hub's edges are only
    ever joined with the hub's one smallest neighbour, so no group is gathered.
    """
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(pair.where("a <> b").distinct(), purpose)
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.where("b > a").join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = large.distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(small_low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("a"), F.col("low").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
                )
            ).alias("e")
        )
        now = stored(small.select("e.a", "e.b").where("a <> b").distinct(), purpose)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            break
        seen = state
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select("b", "b")).distinct()
