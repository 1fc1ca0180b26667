"""Tables, free column names and small plan helpers of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inlay.staging import new_path


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``inlay.staging.materialize`` with a choice of compression."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, parts: int) -> DataFrame:
    """Number the rows of each group from 0 in ``rank``, without one task for a group.

    The order is that of ``crc32(order as text joined by spaces), *order``.  The checksum
    cuts each group into ``parts`` parts; a row's rank is the number of rows in the parts
    before its own plus its place in it, so ``parts`` does not change the result.  Rows
    that agree in ``group`` and ``order`` must be interchangeable.
    """
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in order])
    dealt = df.withColumn("_crc", F.crc32(text.cast("binary")))
    dealt = dealt.withColumn("_part", F.shiftright(F.col("_crc") * parts, 32).cast("int"))
    sizes = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_part").orderBy("_crc", *order)
    placed = dealt.withColumn("_at", F.row_number().over(within)).join(offsets, [*group, "_part"])
    counted = placed.withColumn(rank, (F.col("_before") + F.col("_at") - 1).cast("bigint"))
    return counted.drop("_part", "_before", "_at", "_crc")


def forget(stage: DataFrame) -> None:
    """Delete a stage table that nothing will read again."""
    spark = stage.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in stage.inputFiles()}:
        if f"/inlay/{spark.sparkContext.applicationId}/" in folder:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps.

    They go once the driver has collected the plans that made them, which a driver with
    little to do puts off for up to half an hour while the disks of the executors fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
