"""Tables and files that every machine of the cluster can read.

Intermediate results that are read more than once, or that fix a partition order, are written as
tables below `spark.checkpoint.dir`. A lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared folder.

    The folder comes from the session. Only a session on one machine without that setting gets a
    folder of its own; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/poolscope-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, cut off from its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


@cache
def _trim():
    """The C library's way to return freed memory, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system.

    Both keep it for the next use; a worker that holds the most it ever needed leaves less to the others
    of its executor. Called once for some megabytes of texts, it takes no time worth counting.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)
