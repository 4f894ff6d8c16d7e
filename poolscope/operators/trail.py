"""Execution history: newest runs with what they called, and how a report names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import display as D
from poolscope.sources.reference import lookup

MAX_TRAIL = 15


def execution_trail(runs: DataFrame, details: DataFrame, n: int | None = 6) -> DataFrame:
    """The newest n direct runs, or all of them with None, with their call details where known.

    A report shows at most `MAX_TRAIL`, which its caller asks for. The list is cut to its newest runs first (a distributed top-k), so only those meet the details.
    A run without details stays: it is evidence that something was executed.
    """
    newest = runs.filter(F.col("source") == "direct")
    if n is not None:
        newest = newest.orderBy(F.col("started_at").desc_nulls_last(), F.col("id")).limit(max(n, 1))
    dim = details.withColumnRenamed("hash", "_detail_hash")
    joined = newest.join(dim, ["id"], "left")
    return (
        joined.withColumn("status", F.coalesce("status", F.lit("unknown")))
        .withColumn("hash", F.coalesce("_detail_hash", "hash"))
        .drop("_detail_hash")
    )


def contract_label(address: Column) -> Column:
    """Name of a well-known contract or token, else its short address."""
    names = {config.POSITION_MANAGER: "position manager", config.V3.registry: "v3 factory"}
    names.update({a: s for s, (a, _) in config.TOKEN_ALIASES.items()})
    lowered = F.lower(address)
    short = F.concat(F.substring(lowered, 1, 6), F.lit("…"), F.right(lowered, F.lit(4)))
    return F.when(address.isNull() | (address == ""), F.lit("")).otherwise(F.coalesce(lookup(lowered, names), short))


def trail_labels(trail: DataFrame) -> DataFrame:
    """Status mark, contract label and UTC minute of each run."""
    return (
        trail.withColumn("status_mark", D.pick(F.col("status"), D.STATUS_MARKS, D.NO_AUDIT_MARK))
        .withColumn("contract_label", contract_label(F.col("contract")))
        .withColumn("when_utc", D.fmt_when(F.col("started_at")))
    )
