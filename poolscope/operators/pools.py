"""Pool dimension: which side of a pair is the anchor, and which pools are genuine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import words as W
from poolscope.plans.joins import join_dimension
from poolscope.sources.reference import lookup


def is_anchor(currency: Column, anchors: dict[str, str] | None = None) -> Column:
    return F.lower(currency).isin(list(anchors or config.ANCHORS))


def anchor_side(
    pairs: DataFrame, c0: str = "currency0", c1: str = "currency1", anchors: dict[str, str] | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Keep pairs with exactly one anchor; add token, anchor, anchor_kind, anchor_is_token0.

    The anchor table is five fixed rows, so it is a map literal in the projection, not a join.
    With `keep_all` the pairs without a subject token stay, with NULLs.
    """
    table = anchors or config.ANCHORS
    first, second = F.lower(c0), F.lower(c1)
    staged = pairs.withColumn("_k0", lookup(first, table)).withColumn("_k1", lookup(second, table))
    one_sided = F.col("_k0").isNull() != F.col("_k1").isNull()
    out = staged if keep_all else staged.filter(one_sided)
    is0 = F.when(one_sided, F.col("_k0").isNotNull())
    return (
        out.withColumn("anchor_is_token0", is0)
        .withColumn("token", F.when(is0, second).when(~is0, first))
        .withColumn("anchor", F.when(is0, first).when(~is0, second))
        .withColumn("anchor_kind", F.when(is0, F.col("_k0")).when(~is0, F.col("_k1")))
        .drop("_k0", "_k1")
    )


def attach_pools(swaps: DataFrame, pools: DataFrame, salt: int | None = None) -> DataFrame:
    """Swaps of known pools, with the pool's token, anchor and fee. Unknown pools fall away."""
    wanted = ["pool", "token", "anchor", "anchor_kind", "anchor_is_token0", "fee_pips"]
    dim = pools.select(*[c for c in wanted if c in pools.columns])
    return join_dimension(swaps, dim, ["pool"], "inner", salt)


def canonical_pools(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Pools the registry confirms for their exact (token0, token1, fee); forks drop out."""
    reg = registry.select("token0", "token1", "fee_pips", F.lower("pool").alias("pool")).distinct()
    return candidates.join(reg, ["token0", "token1", "fee_pips", "pool"], "left_semi")


def build_v3_pools(calls: DataFrame) -> DataFrame:
    """Pool answers -> dimension rows with a three-valued status.

    Input: pool, token0_raw, token1_raw, fee_raw, registry_raw; NULL is "no answer this time".
    status: 'ok' a confirmed pool, 'rejected' definitely not one, NULL undecided. The tests are one
    CASE in the order pair -> anchor -> fee -> registry, so a later silence never overrules an
    earlier definite no.
    """
    paired = calls.withColumn("token0", W.word_address(F.col("token0_raw"), 0)).withColumn(
        "token1", W.word_address(F.col("token1_raw"), 0)
    )
    sided = anchor_side(paired, "token0", "token1", keep_all=True)
    no = F.lit("rejected")
    unknown = F.lit(None).cast("string")
    no_pair = ~(W.has_words(F.col("token0_raw"), 1) & W.has_words(F.col("token1_raw"), 1))
    confirmed = W.has_words(F.col("registry_raw"), 1) & (
        W.word_address(F.col("registry_raw"), 0) == F.lower("pool")
    )
    status = (
        F.when(F.col("token0_raw").isNull() | F.col("token1_raw").isNull(), unknown)
        .when(no_pair | F.col("anchor").isNull(), no)
        .when(F.col("fee_raw").isNull(), unknown)
        .when(~W.has_words(F.col("fee_raw"), 1), no)
        .when(F.col("registry_raw").isNull(), unknown)
        .when(~confirmed, no)
        .otherwise(F.lit("ok"))
    )
    ok = F.col("status") == "ok"
    keep = ["token", "anchor", "anchor_kind", "anchor_is_token0"]
    return sided.withColumn("status", status).select(
        F.lower("pool").alias("pool"),
        "status",
        *[F.when(ok, F.col(c)).alias(c) for c in keep],
        F.when(ok, W.word(F.col("fee_raw"), 0).cast("int")).alias("fee_pips"),
    )


def build_cl_pools(keys: DataFrame) -> DataFrame:
    """Decoded pool keys -> dimension rows with the same three-valued status."""
    sided = anchor_side(keys, "currency0", "currency1", keep_all=True)
    status = F.when(F.col("key_status") == "ok", F.when(F.col("anchor").isNull(), F.lit("rejected")).otherwise(F.lit("ok"))).when(
        F.col("key_status") == "empty", F.lit("rejected")
    )
    return sided.select(
        "pool", status.alias("status"), "token", "anchor", "anchor_kind", "anchor_is_token0",
        F.lit(None).cast("int").alias("fee_pips"),
    )
