"""Stage tables: Parquet copies of intermediate frames in the shared checkpoint folder.

A stage table fixes a frame once.  Everything that reads it later sees the same
rows in the same parts even when executors are lost, and reads only the columns
it needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="inlay-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/inlay/{app}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to a stage table and return the frame that reads it back; ``options`` are those of the writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
