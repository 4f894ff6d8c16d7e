"""Reference tables: anchors, boards, denied tokens, tick spacings, aliases.

All are short fixed lists (plus what the caller adds), so they may be broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope import config


def anchors_df(spark: SparkSession, anchors: dict[str, str] | None = None) -> DataFrame:
    rows = [(a.lower(), kind) for a, kind in (anchors or config.ANCHORS).items()]
    return spark.createDataFrame(rows, "anchor string, anchor_kind string")


def boards_df(spark: SparkSession) -> DataFrame:
    order = list(config.BOARD_LABELS)
    rows = [
        (anchor, board, config.BOARD_LABELS[board], order.index(board) + 1)
        for anchor, board in config.BOARD_BY_ANCHOR.items()
    ]
    return spark.createDataFrame(rows, "anchor string, board string, label string, board_order int")


def _clean(addresses) -> set[str]:
    trimmed = {a.strip().lower() for a in addresses}
    return {a for a in trimmed if re.fullmatch(r"0x[0-9a-f]{40}", a)}


def denylist_df(spark: SparkSession, extra=(), allow=(), enabled: bool = True) -> DataFrame:
    """Denied token addresses: the curated groups plus `extra`, minus `allow`.

    Matching is by address only; a symbol is untrusted text that any contract can choose.
    """
    groups = [
        ("stablecoin", config.DENIED_STABLECOINS),
        ("wrapped", config.DENIED_WRAPPED),
        ("defi", config.DENIED_DEFI),
        ("extra", sorted(_clean(extra))),
    ]
    allowed = _clean(allow)
    seen: dict[str, str] = {}
    for group, addresses in groups:
        for address in addresses:
            if enabled and address not in allowed:
                seen.setdefault(address, group)
    return spark.createDataFrame(list(seen.items()), "token string, deny_group string")


def tick_spacing_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(config.TICK_SPACING.items()), "fee_pips int, spacing int")


def token_alias_df(spark: SparkSession) -> DataFrame:
    rows = [(s, a, d) for s, (a, d) in config.TOKEN_ALIASES.items()]
    return spark.createDataFrame(rows, "symbol string, token string, decimals int")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A fixed table as a map literal: a lookup without a join; unknown keys give NULL."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)
