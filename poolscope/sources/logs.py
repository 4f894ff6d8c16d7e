"""Event-log tables: layout, scans, streams and block windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.functions.words import norm_addr

RAW_LOG_SCHEMA = T.StructType(
    [
        T.StructField("topic0", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("log_index", T.LongType()),
    ]
)

ORDER_BITS = 20  # log indexes inside one block stay far below 2^20


def has_order(log_index: Column) -> Column:
    """True for a log index that `chain_order` can hold."""
    return F.coalesce(log_index.between(0, (1 << ORDER_BITS) - 1), F.lit(False))


def chain_order(block: Column, log_index: Column) -> Column:
    """One BIGINT that sorts like (block, log index); fails loudly rather than wrap.

    A primitive order key keeps `max_by` inside hash aggregation; a struct key would force a
    sort of the raw rows.
    """
    packed = F.shiftleft(block.cast("bigint"), ORDER_BITS) + log_index
    return F.when(has_order(log_index), packed).otherwise(
        F.raise_error(F.lit("log_index is missing or does not fit the order key")).cast("bigint")
    )


def interleaved(a: Column, b: Column) -> Column:
    """The low 16 bits of two numbers, bit by bit in turn: close keys are close in both."""

    def spread(x: Column) -> Column:
        x = x.cast("bigint").bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return x

    return F.shiftleft(spread(a), 1).bitwiseOR(spread(b))


def write_logs(logs: DataFrame, path: str, blocks_per_part: int, mode: str = "errorifexists", clustered: bool = False) -> None:
    """Store raw logs partitioned by block range, with `topic0` and lower-case addresses for pushdown.

    Rows are range-partitioned by block inside a part, so a busy part is written by many tasks. `clustered` deals
    them by block and address alike, so that a file holds a stretch of blocks of some of the pools, and adds Bloom
    filters on the address: a rare pool then reads the few files that may hold it, a block range still its own.
    """
    part = F.floor(F.col("block_number") / blocks_per_part).cast("bigint")
    topic0 = F.try_element_at(F.col("topics"), F.lit(1))
    shaped = logs.withColumns({"topic0": topic0, "block_part": part, "address": norm_addr(F.col("address"))})
    if clustered:
        inside = F.floor((F.col("block_number") - F.col("block_part") * blocks_per_part) * 65536 / blocks_per_part)
        shaped = shaped.withColumn("_cell", interleaved(inside, F.xxhash64("address")))
        ordered = shaped.repartitionByRange("block_part", "_cell", "log_index").sortWithinPartitions("block_part", "topic0", "address", "block_number")
        writer = ordered.drop("_cell").write.option("parquet.bloom.filter.enabled#address", "true").option("parquet.bloom.filter.expected.ndv#address", "100000")
    else:
        ordered = shaped.repartitionByRange("block_part", "block_number", "log_index")
        writer = ordered.sortWithinPartitions("block_part", "topic0", "address", "block_number").write
    writer.mode(mode).partitionBy("block_part").parquet(path)


def select_logs(
    logs: DataFrame,
    topic0: str,
    addresses: Iterable[str] | None = None,
    block_range: tuple[int, int] | None = None,
    blocks_per_part: int | None = None,
) -> DataFrame:
    """Keep one event type, optionally from given contracts and an inclusive block range.

    On stored logs, which have a `topic0` column and lower-case addresses (see `write_logs`), every
    test is a plain comparison on a column, so Parquet skips row groups and, with `blocks_per_part`,
    whole directories. Raw logs without that column are compared in lower case.
    """
    has_topic0 = "topic0" in logs.columns
    out = logs.filter(F.col("topic0") == topic0 if has_topic0 else F.try_element_at("topics", F.lit(1)) == topic0)
    if addresses is not None:
        wanted = sorted({a.lower() for a in addresses})
        out = out.filter((F.col("address") if has_topic0 else norm_addr(F.col("address"))).isin(wanted))
    if block_range is not None:
        lo, hi = block_range
        out = out.filter(F.col("block_number").between(lo, hi))
        if blocks_per_part and "block_part" in logs.columns:
            out = out.filter(F.col("block_part").between(lo // blocks_per_part, hi // blocks_per_part))
    return out


def read_logs(
    spark: SparkSession,
    path: str,
    topic0: str,
    addresses: Iterable[str] | None = None,
    block_range: tuple[int, int] | None = None,
    blocks_per_part: int | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return select_logs(reader.load(path), topic0, addresses, block_range, blocks_per_part)


def stream_logs(
    spark: SparkSession,
    path: str,
    topic0: str,
    addresses: Iterable[str] | None = None,
    schema: T.StructType = RAW_LOG_SCHEMA,
    max_files_per_trigger: int = 1,
    fmt: str = "parquet",
) -> DataFrame:
    """The same scan as a stream over a growing directory."""
    stream = (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    )
    return select_logs(stream, topic0, addresses)


def union_slices(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Concatenate scans by column name; order lives in (block_number, log_index), not position."""
    out = first
    for df in rest:
        out = out.unionByName(df)
    return out


def all_swaps(v3: DataFrame, cl: DataFrame) -> DataFrame:
    """Both venues as one table; columns one venue lacks are NULL."""
    return v3.unionByName(cl, allowMissingColumns=True)


def block_slices(ranges: DataFrame, size: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Cover each inclusive range with gap-free slices of at most `size` blocks.

    Ranges unfold in two steps, stretches of 4,096 slices first, so no array holds a whole range.
    """
    step = max(1, int(size))
    stretch = step * 4096
    start, end = F.col(lo).cast("bigint"), F.col(hi).cast("bigint")

    def starts(first: Column, last: Column, width: int) -> Column:
        return F.explode(F.when(first <= last, F.sequence(first, last, F.lit(width).cast("bigint"))))

    coarse = ranges.withColumn("_stretch", starts(start, end, stretch))
    last = F.least(F.col("_stretch") + (stretch - 1), end)
    fine = coarse.withColumn("slice_from", starts(F.col("_stretch"), last, step)).drop("_stretch")
    return fine.withColumn("slice_to", F.least(F.col("slice_from") + (step - 1), end))


def window_bounds(last_block: Column, head_block: Column, lookback: int) -> dict[str, Column]:
    """Block window of the next run: after the last block, clamped to `lookback` blocks.

    Returns from_block, to_block, skipped (blocks lost to the clamp) and is_empty.
    """
    cold = last_block == 0
    behind = (head_block - last_block) > lookback
    clamped = F.greatest(F.lit(1).cast("bigint"), head_block - lookback + 1)
    start = F.when(cold | behind, clamped).otherwise(last_block + 1)
    skipped = F.when(cold, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), start - last_block - 1))
    return {
        "from_block": start,
        "to_block": head_block,
        "skipped": skipped,
        "is_empty": head_block < start,
    }


def clamp_window(df: DataFrame, last_block: int, head_block: int, lookback: int) -> tuple[DataFrame, int, int]:
    """Rows of the next window plus its bounds, for a known cursor and head."""
    start = last_block + 1
    if last_block == 0 or head_block - last_block > lookback:
        start = max(1, head_block - lookback + 1)
    return df.filter(F.col("block_number").between(start, head_block)), start, head_block


def assign_windows(df: DataFrame, lookback: int, start_block: int = 0) -> DataFrame:
    """Backfill windows: a fixed grid of `lookback` blocks, a column rather than a loop."""
    grid = F.floor((F.col("block_number") - start_block) / lookback).cast("bigint")
    return df.withColumn("window_id", grid)


def window_columns(df: DataFrame, lookback: int, start_block: int = 0) -> DataFrame:
    """from_block, to_block and window_blocks of a grid window id."""
    first = F.col("window_id") * lookback + start_block
    return (
        df.withColumn("from_block", first.cast("bigint"))
        .withColumn("to_block", (first + (lookback - 1)).cast("bigint"))
        .withColumn("window_blocks", F.lit(lookback).cast("bigint"))
    )
