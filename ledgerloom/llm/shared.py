"""Plumbing shared by the training-data operators: table reading and shared-folder tables.

Every intermediate table is written below the folder that the session names in
``spark.checkpoint.dir`` so that a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows in an Arrow batch handed to a Python worker: bounds a worker's memory when texts are long.
ARROW_ROWS = 512

_written: dict[int, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder, on any file system Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where driver and executors are one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/ledgerloom-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; it is removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    if id(spark) not in _written:
        _written[id(spark)] = []
        atexit.register(_remove, spark, _written[id(spark)])
    _written[id(spark)].append(path)
    return path


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def finished(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: what was made of them is written itself."""
    for table in tables:
        discard(table.sparkSession, table._shared_path)


#: Tasks that rows of one group are dealt to.
SALTS = 256


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str], key: Column, salts: int = SALTS) -> DataFrame:
    """``rows`` left joined to ``groups`` (one row for each ``by``): a group's rows are dealt to tasks by ``key``, and its facts go along."""
    salt = free_name([*rows.columns, *groups.columns], "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    there = dealt.select(*by, salt).distinct().join(groups, by)
    return dealt.join(there, [*by, salt], "left").drop(salt)


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of ``ARROW_ROWS`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_name(taken: list[str], base: str) -> str:
    """``base``, or ``base`` with underscores added until no column of ``taken`` clashes (case-insensitive)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = f"_{base}"
    return base


def free_prefix(taken: list[str], base: str) -> str:
    """``base``, or ``base`` with underscores before it until no column of ``taken`` begins with it (case-insensitive)."""
    while any(c.lower().startswith(base.lower()) for c in taken):
        base = f"_{base}"
    return base
