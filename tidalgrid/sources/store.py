"""A tier of measurements in files: written by node and day, scanned by a manifest, migrated in two phases, deleted from.

A tier is a Parquet folder partitioned by ``node_id, day`` (a cold one by ``batch``, too), rows ordered by path and time. Beside it
lies its manifest, a table of the same partitions: for each file and series the first and last time and the number of rows. A range
is answered from the files that the manifest names for the selected series; bounds of path and time reach their row groups.

Changes go through a journal folder. Each step first commits what it is about to put in place, and puts it there by overwriting
whole partitions, so a change that was stopped is taken up where it stood, and a step done twice is done once. Rows are written to
the cold tier before they leave the hot one; in between both tiers hold them, which merged answers don't show. While a
partition is being changed nothing else may write to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.operators import lifecycle
from tidalgrid.sources import storage

KEY, ROW = ["node_id", "path"], ["node_id", "path", "ts_ns", "seq"]
PARTS = ("node_id", "day", "batch")
#: Names of files that the driver hands to a scan; as many a plain scan of a small tier has.
FILES = 10_000


def _file_system(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark, path: str) -> bool:
    files, p = _file_system(spark, path)
    return files.exists(p)


def _remove(spark, path: str) -> None:
    files, p = _file_system(spark, path)
    files.delete(p, True)


def _mark(spark, path: str) -> None:
    files, p = _file_system(spark, path)
    files.create(p, True).close()


def _parts(df: DataFrame) -> list[str]:
    return [c for c in PARTS if c in df.columns]


def _overwrite(rows: DataFrame, path: str, files: int = 1) -> None:
    """Replaces the partitions that ``rows`` have, and no others."""
    parts = _parts(rows)
    dealt = rows.repartition(*parts, F.pmod(F.xxhash64("path"), F.lit(files))).sortWithinPartitions(*parts, "path", *[c for c in ("ts_ns",) if c in rows.columns])
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _schema(spark, path: str) -> str:
    batch = ", batch string" if _exists(spark, f"{path}.manifest/_batches") else ""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.MEASUREMENTS if f.name != "node_id")
    return f"{own}, node_id string, day int{batch}"


def read(spark, path: str) -> DataFrame:
    """All rows of a tier, with its partition columns; none if it was never written."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema.MEASUREMENTS).withColumn("day", F.lit(0))
    return spark.read.schema(_schema(spark, path)).parquet(path)


def manifest(spark, path: str) -> DataFrame:
    """(path, file, t_start, t_end, n, node_id, day[, batch])."""
    batch = ", batch string" if _exists(spark, f"{path}.manifest/_batches") else ""
    return spark.read.schema(f"path string, file string, t_start long, t_end long, n long, node_id string, day int{batch}").parquet(f"{path}.manifest")


def refresh(spark, path: str, touched: DataFrame | None = None) -> None:
    """Writes the manifest of all partitions of a tier, or of the ``touched`` ones."""
    rows = read(spark, path).withColumn("file", F.col("_metadata.file_path"))
    if touched is not None:
        rows = rows.join(touched, _parts(rows), "left_semi")
    made = rows.groupBy(*_parts(rows), "path", "file").agg(F.min("ts_ns").alias("t_start"), F.max("ts_ns").alias("t_end"), F.count("*").alias("n"))
    _overwrite(made, f"{path}.manifest")


def write(rows: DataFrame, path: str, files: int = 1, batch: str | None = None) -> None:
    """Puts measurements into a tier, in place of those partitions that they have. With ``batch`` only what an earlier write of
    the same batch has put there is replaced. A day of a node takes ``files`` files, dealt by path."""
    spark = rows.sparkSession
    own = rows.select(*schema.MEASUREMENTS.fieldNames()).withColumn("day", F.expr(f"(ts_ns - pmod(ts_ns, {storage.DAY_NS}L)) div {storage.DAY_NS}L").cast("int"))
    if batch is not None:
        _mark(spark, f"{path}.manifest/_batches")
        own = own.withColumn("batch", F.lit(batch))
    _overwrite(own, path, files)
    if _exists(spark, path):
        refresh(spark, path, own.select(*_parts(own)).distinct())


def scan(spark, path: str, series: DataFrame, t0: int, t1: int) -> DataFrame:
    """Measurements of the closed range of the series (node_id, path). Only files are read whose manifest names a selected
    series with times in the range; beyond ``FILES`` of them the names stay on the executors, and whole partitions are pruned."""
    first, last = t0 // storage.DAY_NS, t1 // storage.DAY_NS
    keys = series.select(*KEY).distinct()
    names = schema.MEASUREMENTS.fieldNames()
    if not _exists(spark, path):
        return read(spark, path).select(*names)
    listed = storage.overlapping(manifest(spark, path).where(F.col("day").between(first, last)), t0, t1).join(keys, KEY, "left_semi")
    found = listed.groupBy("file").agg(F.min("path").alias("low"), F.max("path").alias("high")).limit(FILES + 1).collect()
    if not found:
        return read(spark, path).select(*names).where("false")
    if len(found) <= FILES:
        rows = spark.read.schema(_schema(spark, path)).option("basePath", path).parquet(*[r["file"] for r in found])
        rows = rows.where(F.col("path").between(min(r["low"] for r in found), max(r["high"] for r in found)))
    else:
        rows = read(spark, path).where(F.col("day").between(first, last))
        rows = rows.join(listed.select(*_parts(rows)).distinct(), _parts(rows), "left_semi")
    return rows.where(F.col("ts_ns").between(t0, t1)).join(keys, KEY, "left_semi").select(*names)


def _replace(spark, path: str, left: str, touched: DataFrame) -> None:
    """Puts the committed rows of ``left`` in place of the ``touched`` partitions of a tier; those without rows are removed."""
    rows = spark.read.schema(_schema(spark, path)).parquet(left)
    parts = _parts(rows)
    _overwrite(rows, path)
    emptied = touched.join(rows.select(*parts).distinct(), parts, "left_anti")
    # a row for each partition that a change has emptied
    for r in emptied.toLocalIterator():
        for folder in (path, f"{path}.manifest"):
            _remove(spark, "/".join([folder, *(f"{c}={r[c]}" for c in parts)]))
    refresh(spark, path, touched.join(emptied, parts, "left_anti"))


def _left(rows: DataFrame, touched: DataFrame, gone: DataFrame, on: list[str], into: str) -> None:
    """Commits what is left of the touched partitions."""
    rows.join(touched, _parts(rows), "left_semi").join(gone, on, "left_anti").write.mode("overwrite").parquet(into)


def open_changes(spark, journal: str) -> list[str]:
    """The names of the changes that were begun and not ended."""
    files, p = _file_system(spark, journal)
    names = [s.getPath().getName() for s in files.listStatus(p)] if files.exists(p) else []
    return sorted(n for n in names if not _exists(spark, f"{journal}/{n}/done"))


def migrate(spark, hot: str, cold: str, series: DataFrame, now_ns: int, journal: str, by_block: bool = True, everything: bool = False) -> str:
    """Moves rows past their series' retention (see ``lifecycle.tier``), or ``everything``, from the hot to the cold tier; first
    ends what an earlier call has begun. The name of the change."""
    for name in open_changes(spark, journal):
        _migrate(spark, hot, cold, f"{journal}/{name}", name, None)
    name = uuid.uuid4().hex
    rows = read(spark, hot).select(*schema.MEASUREMENTS.fieldNames())
    moved = rows if everything else lifecycle.tier(rows, series, now_ns, by_block)[1]
    _migrate(spark, hot, cold, f"{journal}/{name}", name, moved)
    return name


def _migrate(spark, hot: str, cold: str, own: str, name: str, moved: DataFrame | None) -> None:
    if not _exists(spark, f"{own}/moved/_SUCCESS"):
        if moved is None:
            # nothing had been committed, so nothing was changed
            _mark(spark, f"{own}/done")
            return
        moved.write.mode("overwrite").parquet(f"{own}/moved")
    rows = spark.read.schema(schema.MEASUREMENTS).parquet(f"{own}/moved")
    if not _exists(spark, f"{own}/cold"):
        write(rows, cold, batch=name)
        _mark(spark, f"{own}/cold")
    day = F.expr(f"(ts_ns - pmod(ts_ns, {storage.DAY_NS}L)) div {storage.DAY_NS}L").cast("int").alias("day")
    touched = rows.select("node_id", day).distinct()
    if not _exists(spark, f"{own}/left/_SUCCESS"):
        _left(read(spark, hot), touched, rows.select(*ROW), ROW, f"{own}/left")
    _replace(spark, hot, f"{own}/left", touched)
    _mark(spark, f"{own}/done")


def delete(spark, path: str, tombstones: DataFrame, journal: str) -> int:
    """Removes the series named by ``tombstones`` (node_id, path) from a tier, after what earlier calls have begun. Only partitions
    that hold them are written again; their number."""
    for name in open_changes(spark, journal):
        _delete(spark, path, f"{journal}/{name}", None)
    return _delete(spark, path, f"{journal}/{uuid.uuid4().hex}", tombstones)


def _delete(spark, path: str, own: str, tombstones: DataFrame | None) -> int:
    known = manifest(spark, path)
    parts = _parts(known)
    if not _exists(spark, f"{own}/touched/_SUCCESS"):
        if tombstones is None:
            _mark(spark, f"{own}/done")
            return 0
        tombstones.select(*KEY).distinct().write.mode("overwrite").parquet(f"{own}/stones")
        known.join(tombstones.select(*KEY).distinct(), KEY, "left_semi").select(*parts).distinct().write.mode("overwrite").parquet(f"{own}/touched")
    touched = spark.read.schema(known.select(*parts).schema).parquet(f"{own}/touched")
    if not _exists(spark, f"{own}/left/_SUCCESS"):
        _left(read(spark, path), touched, spark.read.schema("node_id string, path string").parquet(f"{own}/stones"), KEY, f"{own}/left")
    _replace(spark, path, f"{own}/left", touched)
    _mark(spark, f"{own}/done")
    return touched.count()


def delete_objects(objects: DataFrame, file: str = "file") -> DataFrame:
    """Deletes the objects (``node_id, series_id`` and a ``file``'s URI) on the executors: the rows with ``ok`` and ``error``, for
    ``lifecycle.settle_deletes``. An object that isn't there counts as deleted, so tasks may run twice."""
    columns = ["node_id", "series_id", file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        from pyarrow import fs

        for b in batches:
            errors = []
            for uri in b.column(2).to_pylist():
                try:
                    system, at = fs.FileSystem.from_uri(uri)
                    at = unquote(at)
                    if system.get_file_info(at).type != fs.FileType.NotFound:
                        system.delete_file(at)
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], names=[*columns, "ok", "error"])

    kinds = dict(objects.dtypes)
    return objects.select(*columns).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "ok boolean", "error string"]))
