"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables.

    The session's ``spark.checkpoint.dir`` is read; only where it is unset on a local master (tests, a single machine) an
    own temporary folder is made, kept for the life of the session and removed at exit. On a cluster it must be set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all its machines share")
    own = getattr(sc, "_tracksmith_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tracksmith-")
        atexit.register(shutil.rmtree, own, True)
        sc._tracksmith_dir = own
    return f"file://{own}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    The table cuts the lineage: a lost executor costs no recomputation, and later scans read only the columns they
    need. Tables of this application lie under one folder named after it and are deleted at exit.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tracksmith-{spark.sparkContext.applicationId}"
    if not getattr(spark.sparkContext, "_tracksmith_clean", False):
        spark.sparkContext._tracksmith_clean = True
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracksmith_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing will read any more."""
    for df in tables:
        _remove(df.sparkSession, df._tracksmith_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session may have ended before
        pass
