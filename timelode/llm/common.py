"""Helpers shared by the training-data operators: scratch folders and column picking."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which the driver and all executors see.

    Where the setting is absent in a local session, as in tests, a fresh temporary folder is set for the
    session and reused from then on; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='timelode-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Where on, the shuffle files of a query go when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it again: cuts lineage, survives lost executors, and frees the disks of shuffles."""
    spark = df.sparkSession
    path, old = scratch(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under internal names, so that no other column of the input can clash."""
    return df.select(*[(quoted(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def quoted(name: str) -> Column:
    """The column of exactly that name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes not to clash with a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
