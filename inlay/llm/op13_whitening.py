"""Whitening of embeddings with distributed block matrices (op13).

Rows are numbered without a sort, from the places they have in a stage table, centred, and cut
into blocks of ``BLOCK_ROWS`` rows.  The transposed matrix times itself is the scatter; the product of
the block rows is split over ``mid_splits`` groups that are added up, so no task meets all rows.
The scatter has as many rows and columns as a vector has entries; its eigenvectors are found on
the driver, and the centred matrix times the whitening matrix gives the projected rows.

Results that are defined here: rows are left out whose vector is null, is empty, holds nulls or values
that are not finite, or has not the commonest length (the longer of two equally common ones).
Directions without variance have no whitened value, so they have no rows.  Null and repeated ids
are kept, a row each; an empty table gives an empty result.  Vectors of any length up to
``MAX_ENTRIES`` are taken (the scatter must fit the driver); longer ones are an error.  Extra
columns stay out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inlay.llm import queries
from inlay.llm.common import materialize, table

BLOCK_ROWS = 1024
SPLIT_BLOCKS = 64  # row blocks that one task multiplies
MAX_ENTRIES = 8192
COMPONENTS = 8
EXACT = float(1 << 52)
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


@dataclass
class Whitening:
    """A fitted transform: unit eigenvectors (columns), eigenvalues from the largest, and the spread of all."""

    rows: int
    total: list  # sum of every entry
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def matrix(self, components: int) -> np.ndarray:
        chosen = min(components, len(self.values))
        return self.vectors[:, :chosen] / np.sqrt(self.values[:chosen])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)`` of the rows that can be whitened, ``v`` as doubles."""
    named = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    )
    sized = named.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("held"))
    common = sized.orderBy(F.desc("held"), F.desc("n")).limit(1).collect()
    return named.where(F.size("v") == (common[0]["n"] if common else 0))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``index`` from 0 without gaps, fixed by a stage table; one count a part is broadcast."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    staged = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", local), "vectors")
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = staged.join(F.broadcast(offsets), "_part")  # a row a part
    return joined.withColumn("index", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def sums(rows: DataFrame, column: str, entries: int) -> list:
    """Sum of every entry; partial sums meet, a row per task."""
    found = rows.agg(*[F.sum(F.col(column)[i]).alias(f"s{i}") for i in range(entries)]).first()
    return list(found)


def block_matrix(rows: DataFrame, vector: Column, columns: int) -> BlockMatrix:
    """Rows ``index`` and ``vector`` (array of doubles) as blocks of ``BLOCK_ROWS`` rows."""
    dense = rows.select("index", array_to_vector(vector).alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(dense, "vector")
    return IndexedRowMatrix(old).toBlockMatrix(BLOCK_ROWS, columns)


def product(left: BlockMatrix, right: BlockMatrix, mid_splits: int) -> BlockMatrix:
    """``left * right`` with the inner dimension split over tasks, which only the Scala method offers."""
    scala = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, mid_splits)
    return BlockMatrix(scala, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, rows: int) -> np.ndarray:
    splits = max(1, -(-rows // (BLOCK_ROWS * SPLIT_BLOCKS)))
    return product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def fit(matrix: BlockMatrix, total: list, rows: int) -> Whitening:
    """Eigenvectors of the covariance of centred rows, largest first, without those of no variance."""
    covariance = scatter(matrix, rows) / rows
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps
    return Whitening(rows, total, vectors[:, some], values[some], float(np.trace(covariance)))


@dataclass
class Whitened:
    """``rows`` (key, v, index), their projections ``z`` by index, and the transform; None without variance."""

    rows: DataFrame
    projected: DataFrame | None  # index, z
    transform: Whitening | None


def whiten(vectors: DataFrame, key: str, vector: str, components: int, entry: Column | None = None) -> Whitened:
    """Centre ``vectors``, whiten them, and keep the first ``components`` directions.

    ``entry`` is a function of a column that turns an entry into the value to be whitened.
    """
    rows = usable(vectors, key, vector)
    if entry is not None:
        rows = rows.withColumn("v", F.transform("v", entry))
    rows = numbered(rows)
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, entries = shape[0], shape[1] or 0
    if not n:
        return Whitened(rows, None, None)
    if entries > MAX_ENTRIES:
        raise ValueError(f"vectors have {entries} entries; at most {MAX_ENTRIES} can be whitened")
    total = sums(rows, "v", entries)
    mean = [float(s) / n for s in total]
    centred = F.zip_with("v", F.lit(mean), lambda x, m: x.cast("double") - m)
    matrix = block_matrix(rows, centred, entries)
    transform = fit(matrix, total, n)
    if not len(transform.values):
        return Whitened(rows, None, transform)
    whitening = transform.matrix(components)
    local = Matrices.dense(*whitening.shape, whitening.ravel(order="F").tolist())
    spark = vectors.sparkSession
    single = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), entries, whitening.shape[1])
    projected = product(matrix, single, 1).toIndexedRowMatrix().rows
    columns = projected.map(lambda r: (r.index, r.vector.toArray().tolist()))
    z = materialize(spark.createDataFrame(columns, "index bigint, z array<double>"), "whitened")
    return Whitened(rows, z, transform)


def identity_error(projected: DataFrame, components: int) -> float:
    """Largest distance of an entry of the covariance of ``z`` from the identity."""
    mean = projected.agg(*[F.avg(F.col("z")[i]) for i in range(components)]).first()
    away = [F.col("z")[i] - F.lit(mean[i]) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    found = projected.agg(*[F.avg(away[i] * away[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


# -- query -------------------------------------------------------------------------------

COLUMNS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_numbers(entry: Column) -> Column:
    """``floor(1024 c) + 100000``; beyond ``EXACT``, where doubles have gaps, the number stays there."""
    scaled = F.greatest(F.least(entry * 1024.0, F.lit(EXACT)), F.lit(-EXACT))
    return F.floor(scaled).cast("bigint") + 100000


@queries.query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    done = whiten(vectors, "vec_id", "embedding", COMPONENTS, whole_numbers)
    if done.projected is None:
        return spark.createDataFrame([], COLUMNS)
    fitted = done.transform
    chosen = min(COMPONENTS, len(fitted.values))
    share = [float(v) / fitted.trace for v in fitted.values[:chosen]]
    n = F.lit(fitted.rows).cast("bigint")
    apart = F.zip_with("v", F.lit([int(s) for s in fitted.total]).cast("array<bigint>"), lambda x, s: n * x - s)
    # null where the sum of squares is beyond 64 bits
    deviation = F.aggregate(apart, F.lit(0).cast("bigint"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    rows = done.rows.select("index", F.col("key").alias("vec_id"), deviation.alias("deviation"))
    each = rows.join(done.projected, "index").select(
        "vec_id", "deviation", F.posexplode("z").alias("_at", "whitened")
    )
    return each.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        n.alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.lit(share), F.col("_at") + 1).alias("explained"),
        F.lit(identity_error(done.projected, chosen)).alias("identity_error"),
    )
