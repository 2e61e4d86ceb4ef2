"""Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = 0


def append_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Add rows to a table. Tasks write on their own; the job commit makes them visible."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_groups(rows: DataFrame, path: str, group: Sequence[str]) -> None:
    """Replace the partitions that the rows fall in and leave the others as they are.

    ``rows`` must hold each group whole, which makes a repeated write harmless. Rows are
    gathered by group to keep files few; Spark splits a gathered group that is too large.
    """
    (
        rows.hint("rebalance", *group)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*group)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its declared types; a given schema keeps partition columns as text."""
    return spark.read.schema(schema).parquet(path)


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def current_version(spark: SparkSession, path: str) -> int:
    """The version that readers of a replaced table see; 0 if nothing was written. A version
    is published by a file with its number for a name."""
    files, published = _place(spark, f"{path}/published")
    if not files.exists(published):
        return FIRST
    return max((int(file.getPath().getName()) for file in files.listStatus(published)), default=FIRST)


def _publish(spark: SparkSession, path: str, version: int) -> None:
    """Fails where another writer has published the version."""
    files, mark = _place(spark, f"{path}/published/{version}")
    files.create(mark, False).close()


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join in which nulls are equal."""
    other = right.select([F.col(c).alias(f"other_{c}") for c in columns])
    return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in columns]), how)


def replace_groups(rows: DataFrame, touched: DataFrame, path: str, group: Sequence[str]) -> None:
    """Replace the groups in ``touched`` by ``rows``, which may have no row of some of them.

    Every call writes a version: the new rows in a folder of their own, a manifest that names
    for each group the version that holds it, and last a mark that publishes both. A reader sees the old or the new version, never a mix; a call that fails
    half way is not seen, and the next one overwrites what it left. Two writers of one version
    cannot both publish it. The groups come from the
    input of a run, not from its result: a group whose last row has gone is emptied.
    """
    spark = rows.sparkSession
    last = current_version(spark, path)
    version = last + 1
    groups = touched.select(*group).distinct().withColumn("version", F.lit(version).cast("bigint"))
    if last > FIRST:
        before = spark.read.schema(groups.schema).parquet(f"{path}/manifest/version={last}")
        groups = _same(before, touched.select(*group).distinct(), group, "left_anti").unionByName(groups)
    (
        rows.hint("rebalance", *group)
        .write.mode("overwrite")
        .partitionBy(*group)
        .parquet(f"{path}/data/version={version}")
    )
    groups.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    _publish(spark, path, version)


def read_replaced(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table that ``replace_groups`` writes, in the columns of ``schema``, as of now: later
    calls do not change what the frame reads. Without a schema the files tell it."""
    version = current_version(spark, path)
    if version == FIRST and schema is not None:
        return spark.createDataFrame([], schema)
    manifest = spark.read.parquet(f"{path}/manifest/version={version}")
    held = [row["version"] for row in manifest.select("version").distinct().collect()]
    folders = [f"{path}/data/version={v}" for v in sorted(held)]
    reader = spark.read.option("basePath", f"{path}/data")
    rows = (reader.schema(f"{schema}, version bigint") if schema else reader).parquet(*folders)
    fields = {f.name: f.dataType for f in rows.schema}
    manifest = manifest.select([F.col(c).cast(fields[c]) for c in manifest.columns])
    names = [c.split()[0] for c in schema.split(",")] if schema else [c for c in rows.columns if c != "version"]
    return _same(rows, manifest, manifest.columns, "left_semi").select(*names)


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete the folders that neither the current version nor the one before it names. Call
    it when no reader of an older version is left."""
    now = current_version(spark, path)
    named = set()
    for version in range(max(FIRST + 1, now - 1), now + 1):
        manifest = spark.read.parquet(f"{path}/manifest/version={version}")
        named |= {row["version"] for row in manifest.select("version").distinct().collect()}
    for version in range(FIRST + 1, now - 1):
        remove_folder(spark, f"{path}/manifest/version={version}")
        remove_folder(spark, f"{path}/published/{version}")
        if version not in named:
            remove_folder(spark, f"{path}/data/version={version}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that its path names."""
    files, folder = _place(spark, path)
    files.delete(folder, True)
