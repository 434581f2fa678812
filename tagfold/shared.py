"""The folder that driver and executors share, and tables that are written there once."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: URI schemes of folders that only one machine sees.
OWN_MACHINE = ("", "file", "local")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a temporary one if the master is local, else one
    beside the warehouse, which then must lie in a store that all machines see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and is_local(spark):
            named = tempfile.mkdtemp(prefix="checkpoints-")
        if not named:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            scheme = warehouse.partition(":")[0] if ":" in warehouse else ""
            if scheme in OWN_MACHINE:
                raise ValueError(f"set spark.checkpoint.dir to a shared folder; the warehouse, {warehouse}, may be one machine's own")
            named = f"{warehouse}/_checkpoints/{uuid.uuid4()}"
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


_made: list[str] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    _made.append(f"{shared_dir(spark)}/{kind}-{uuid.uuid4()}")
    return _made[-1]


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: until it does, Spark keeps the broadcasts, shuffle files and generated code of what
    is done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that were made inside; what is computed there must be written by then."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            remove_folder(spark, path)
        del _made[start:]


def hold(df: DataFrame, kind: str = "table") -> DataFrame:
    """`df` written once as Parquet into the shared folder and read again: later uses prune its columns and recompute
    nothing, and a lost executor costs only its own tasks. The folder stays, unless this happens within `scratch`."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
