"""What driver and executors share: a folder, and this package."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid


def scratch(spark, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``. Where that is unset, below a new local folder on a local master, and an
    error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidalgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df, label: str):
    """``df`` written to the shared folder and read back, for small tables that many branches of a plan read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark) -> None:
    """Sends the package to Python workers that would not find it: those of a driver that neither runs in the repository's
    folder nor has it in PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in known) or getattr(context, "_tidalgrid", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="tidalgrid-"), "tidalgrid_package")
    context.addPyFile(shutil.make_archive(base, "zip", root, "tidalgrid"))
    context._tidalgrid = True
