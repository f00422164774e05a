"""Embedding whitening with distributed block matrices.

Entries become integers, floor(256 * entry). The distinct vectors are the fit list: their rows, centred, are indexed and put into
a ``BlockMatrix`` of Spark MLlib, whose transpose times itself is the scatter. The eigenvectors of this small matrix come from the
driver (a matrix of dimension times dimension doubles; 8 MB for 1,024 dimensions), and the block matrix times the scaled
eigenvectors is the whitened fit list. All rows get the values of their vector by a join. Blocks are built from rows by Spark, hold
about ``ENTRIES`` doubles each, and products are summed in splits of ``SPLIT`` blocks, so no task gets more.

Rows whose vector is null, empty, or holds a null or an entry that isn't finite are dropped, as are rows of another length than the
most frequent one (of equally frequent ones the longer). Rows that repeat an id or a vector get a result each; the id may be null.
Components without variance can't be scaled: their ``whitened`` is null, and ``identity_error`` leaves them out. Without rows the
result is empty. Other columns are passed over. Products beyond 64 bits are an error, never a wrong number.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import materialize

SCALE, COMPONENTS = 256, 4
#: Doubles of a block; blocks whose product one task adds up.
ENTRIES, SPLIT = 1 << 18, 8
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the remaining rows, entries as integers."""
    # NaN and the infinities are the numbers that differ from themselves after subtraction
    broken = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double") - c.cast("double")))
    whole = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~broken)
    return whole.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("x"))


def blocks(rows: DataFrame, dim: int) -> BlockMatrix:
    """The block matrix of ``rows`` (index, x: doubles)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("x").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, 0, dim).toBlockMatrix(max(256, ENTRIES // dim), dim)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; the long side is split, so that its blocks don't meet in one task."""
    splits = max(1, -(-matrix.numRowBlocks // SPLIT))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    out = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (out + out.T) / 2


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index``, 0 and on: places within the written parts, after the sizes of the parts before."""
    kept = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "fit")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).count().withColumnRenamed("count", "n").collect())
    ends = np.cumsum([n for _, n in sizes])
    first = kept.sparkSession.createDataFrame([(p, int(e - n)) for (p, n), e in zip(sizes, ends, strict=True)], "_part long, _first long")
    return kept.withColumn("_part", part).join(F.broadcast(first), "_part").select(*rows.columns, (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("index"))


def whitening(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each remaining row of ``rows`` (vec_id, embedding) and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``."""
    spark = rows.sparkSession
    good = scaled(rows, scale)
    length = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {SCHEMA}")
    dim = length["d"]
    good = good.where(F.size("x") == dim)
    fit = indexed(good.select("x").distinct())
    columns = sorted(fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s"), F.max(F.abs("v")).alias("top"), F.count("*").alias("n")).collect())
    n, sums, top = columns[0]["n"], [r["s"] for r in columns], max(r["top"] for r in columns)
    means = F.array(*[F.lit(s / n) for s in sums])
    matrix = blocks(fit.select("index", F.zip_with("x", means, lambda v, m: v.cast("double") - m).alias("x")), dim)
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace, k = float(np.trace(covariance)), len(values)
    live = values > max(trace, 0) * np.finfo(float).eps * dim
    scaling = np.where(live, vectors / np.sqrt(np.where(live, values, 1)), 0)
    factor = DenseMatrix(dim, k, scaling.ravel(order="F"))
    product = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), factor)], 1), dim, k, dim, k))
    projected = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("y"))
    found = materialize(fit.join(projected, "index"), "whitened")
    shift = found.select(*[F.avg(F.col("y")[i]).alias(str(i)) for i in range(k)]).first()
    centred = found.select("index", F.zip_with("y", F.array(*[F.lit(v) for v in shift]), lambda v, m: v - m).alias("x"))
    off = (scatter(blocks(centred, k)) / n - np.eye(k))[np.ix_(live, live)]
    error = float(np.abs(off).max()) if off.size else None
    # products that may pass 64 bits are taken as decimals
    number = "long" if dim * (2 * n * max(1, top)) ** 2 < 1 << 63 else "decimal(38,0)"
    far = F.zip_with("x", F.array(*[F.lit(s).cast(number) for s in sums]), lambda v, s: F.lit(n).cast(number) * v.cast(number) - s)
    deviation = F.aggregate(far, F.lit(0).cast(number), lambda acc, v: (acc + v * v).cast(number)).cast("long")
    one = [F.struct(F.lit(i + 1).alias("component"), (F.col("y")[i] if live[i] else F.lit(None).cast("double")).alias("whitened"), F.lit(float(values[i] / trace) if trace > 0 else None).cast("double").alias("explained")) for i in range(k)]
    made = found.select("x", deviation.alias("deviation"), F.array(*one).alias("parts"))
    out = good.join(made, "x").select("vec_id", "deviation", F.inline("parts"))
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def brute_force(rows: list[tuple], components: int = COMPONENTS) -> list[tuple]:
    """Plain whitening of vectors of one length, for tests: (vec_id, component, n, deviation, whitened, explained)."""
    import math

    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in sorted({tuple(x) for _, x in kept})]
    if not fit:
        return []
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        for c in range(min(components, len(sums))):
            live = values[c] > values.sum() * np.finfo(float).eps * len(sums)
            y = float((np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c])) if live else None
            out.append((i, c + 1, n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), y, float(values[c] / values.sum()) if values.sum() > 0 else None))
    return out
