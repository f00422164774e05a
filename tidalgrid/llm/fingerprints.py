"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of each window, rightmost on ties, with positions.

Any span of ``GRAM + WINDOW - 1`` code points that two texts share gives both the same selected gram there.

Null and empty texts have an empty fingerprint; texts shorter than a gram have one hash of all of them. Two empty
fingerprints are alike (1.0), an empty and another one are not (0.0). Likeness is the Jaccard index of the selected hashes.
Repeated rows each have their own result; comparing with the next document needs integer ids, else ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import gram_hash, prefix_hash, small_batches, splitmix, winnow

GRAM, WINDOW = 16, 16


def select(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's code points."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = gram_hash(prefix_hash(splitmix(points.astype(np.uint64) + np.uint64(1))), min(gram, len(points)))
    at = winnow(h, window)
    return h[at], at


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    return hashlib.sha256(hashes.astype("<u8").tobytes() + at.astype("<i8").tobytes()).hexdigest()


def fingerprint(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``hashes`` and ``positions``, arrays in text order; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    added = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "positions")]
    keep = [f for f in docs.schema.fields if f.name not in ("hashes", "positions")]
    schema = T.StructType(keep + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [select(points(t or ""), gram, window) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) cut by descending id into runs and ordered: adds ``run`` and ``tail``.

    Rows come sorted within partitions; a run's last row (``tail`` = 1) is a copy of the next run's first document, or of
    the very first one after the last. There are a few runs for each partition, cut at approximate quantiles; only the
    cut points and the runs' first ids reach the driver. Equal ids share a run and are ordered by their texts' hashes;
    null ids come last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = 4 * n
    cuts = np.unique(np.array(docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.25 / runs) or [0], np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, ids.fillna(0).astype(np.int64).to_numpy(), "right") + 1
        return pd.Series(np.where(ids.isna(), 0, found)).astype("int32")

    own = docs.withColumn("run", run_of("doc_id"))
    heads = sorted((r["run"], r["m"]) for r in own.select("run", "doc_id").groupBy("run").agg(F.max("doc_id").alias("m")).collect())
    if not heads:
        return own.withColumn("tail", F.lit(0)).withColumn("h", F.lit(0).cast("long"))
    target = [(m, heads[(i + 1) % len(heads)][0]) for i, (_, m) in enumerate(heads)]
    copies = F.broadcast(spark.createDataFrame(target, "head long, to int"))
    tails = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("run"), F.lit(1).alias("tail"))
    both = own.withColumn("tail", F.lit(0)).unionByName(tails).withColumn("h", F.xxhash64("text"))
    return both.repartition(n, "run").sortWithinPartitions("run", "tail", F.desc_nulls_last("doc_id"), "h")


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the start of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def compare_with_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; see ``edited`` and ``with_next``. Columns other than
    ``doc_id`` and ``text`` are passed over, whatever their names."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    small_batches(docs.sparkSession)
    ordered = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = []
            for doc_id, text, own_run, tail in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                h, at = select(points(text), gram, window)
                now = (doc_id, text, own_run, digest(h, at), np.unique(h))
                if before and before[2] == own_run:
                    changed = edited(before[1], text)
                    g, pos = select(points(changed), gram, window)
                    rows.append((before[0], len(before[1]), hashlib.sha256(changed.encode()).hexdigest(), before[3], digest(g, pos), likeness(before[4], np.unique(g)), likeness(before[4], now[4])))
                before = None if tail else now
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int64()), *(pa.array(c) for c in cols[2:])], names=names)

    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "run", "tail").mapInArrow(run, schema)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
