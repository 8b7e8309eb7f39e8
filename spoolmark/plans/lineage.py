"""Cutting lineage through tables written to the folder all executors share.

An iterative plan that is never cut grows without bound, and a cut kept in
executor memory or on executor disks is lost with its executor.  ``cut``
therefore writes Parquet into the folder named by ``spark.checkpoint.dir`` and
returns a DataFrame that reads it back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's setting, else a local one where all executors share the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        named = "file://" + tempfile.mkdtemp(prefix="spoolmark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Compute ``df`` once into a shared table and return a reader of that table."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._spoolmark_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete the table behind a frame made by ``cut`` once nothing reads it any more."""
    path = getattr(df, "_spoolmark_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
