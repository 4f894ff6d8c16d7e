"""Shuffled shards by a two-pass external shuffle.

Pass one scatters rows into buckets that fit in memory: a shard by its document id, and inside the
shard a bucket by a seeded hash of the row. Pass two draws a Fisher-Yates permutation of each bucket
and writes the rows. A shard read bucket by bucket is then in uniformly random order; prefix sums of
the bucket counts number its slots without gaps.

The shard is the one whose seeded hash with the document id is greatest (rendezvous hashing), so the
id and the number of shards decide, and one more shard only takes rows into itself.

Defined cases: a null text has no bytes; all null doc_ids share a shard; equal rows are kept, each
with a slot of its own; empty input gives no rows; columns other than doc_id and text may be carried
along by naming them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.llm.shared import shared_dir

SHARDS = 16
SEED = 20_011
BUCKET_BYTES = 16 << 20
PLACE = ("shard", "bucket", "place")


def _scores(doc_id: Column, shards: int, seed: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(seed), doc_id, F.lit(s)) for s in range(shards)])


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    scores = _scores(doc_id, shards, seed)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    keep: tuple[str, ...] = ("doc_id", "text"),
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write the shuffled rows below `path`, a folder per shard, and return them as a table.

    Columns: those of `keep`, shard, bucket, place (the row's place in the bucket's order).
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "shards")
    total = docs.agg(F.sum(text_bytes(F.col("text"))).alias("b")).first().b or 0
    buckets = 1 + total // (shards * bucket_bytes)
    rows = docs.select(
        *keep,
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_order"),
    ).withColumn("bucket", F.pmod(F.shiftrightunsigned("_order", 20), F.lit(buckets)).cast("int"))
    schema = T.StructType([*rows.select(*keep, "shard", "bucket").schema, T.StructField("place", T.LongType())])

    def shuffle(key: tuple, table: pa.Table) -> pa.Table:
        # rows arrive in any order: start from the hash order, so that a repeated task draws the same
        order = np.argsort(table["_order"].to_numpy(), kind="stable")
        shard, bucket = (k.as_py() for k in key)
        drawn = order[np.random.default_rng([seed, shard, bucket]).permutation(len(order))]
        table = table.take(pa.array(drawn)).drop_columns(["_order"])
        return table.append_column("place", pa.array(np.arange(len(drawn)), pa.int64())).select(schema.names)

    mixed = rows.groupBy("shard", "bucket").applyInArrow(shuffle, schema)
    mixed.sortWithinPartitions(*PLACE).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_slots(shards: DataFrame) -> DataFrame:
    """Each row's slot in its shard, from the written order."""
    counts = shards.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    return shards.join(bases, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("place")).drop("base")


def shard_digest(shards: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What tells where each document went, without its text."""
    text, doc_id = F.col("text"), F.col("doc_id")
    return with_slots(
        shards.select(
            "doc_id",
            text_bytes(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            "shard",
            shard_of(doc_id, count + 1, seed).alias("grown_shard"),
            "bucket",
            "place",
        )
    ).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
