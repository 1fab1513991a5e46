"""Cut a plan by a table in the shared folder: later stages read it, and a lost executor costs a re-read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where driver and executors are one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/ledgerloom-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, paths: list[str]) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(path), True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back; the table is removed when the driver's interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    if id(spark) not in _written:
        _written[id(spark)] = []
        atexit.register(_remove, spark, _written[id(spark)])
    _written[id(spark)].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
