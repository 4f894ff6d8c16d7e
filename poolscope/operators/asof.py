"""As-of join: the latest event of a key at or before each row's own block, with hot keys spread over tasks.

Both sides are dealt to (key, stretch), a stretch being `width` blocks. Before that, events shrink to the last
one of each (key, block) and rows to their distinct (key, block), both with map-side partials, so a stretch has
2 * width rows at most, however much a key trades or is asked for. Inside a stretch the latest event is a
running last value. Where a stretch has none before a row, the answer is the last event of the stretches ahead:
a prefix over one row per key and stretch, which is the chain's length over `width` for the busiest key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope.plans.joins import join_dimension

STRETCH = 4096


def latest_per_block(events: DataFrame, values: list[str], key: str, block: str, order: str) -> DataFrame:
    """The last event of every (key, block) as struct `_value`; `order` decides inside a block."""
    known = events.filter(F.col(key).isNotNull() & F.col(block).isNotNull())
    return known.groupBy(F.col(key).alias("_key"), F.col(block).cast("bigint").alias("_block")).agg(
        F.max_by(F.struct(*values), order).alias("_value")
    )


def asof_points(points: DataFrame, latest: DataFrame, width: int = STRETCH) -> DataFrame:
    """(_key, _block, _value) for each distinct (_key, _block) of `points`; NULL before the first event."""
    asked = points.select("_key", "_block", F.lit(True).alias("_asked"))
    told = latest.select("_key", "_block", F.lit(False).alias("_asked"), "_value")
    both = told.unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("_stretch", F.floor(F.col("_block") / F.lit(width)))
    # an event of the row's own block counts, so events go first
    ahead = Window.partitionBy("_key", "_stretch").orderBy("_block", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(ahead)).filter("_asked")
    event = ~F.col("_asked")
    heads = both.groupBy("_key", "_stretch").agg(F.max_by(F.when(event, F.col("_value")), F.when(event, F.col("_block"))).alias("_head"))
    before = Window.partitionBy("_key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select("_key", "_stretch", F.last("_head", ignorenulls=True).over(before).alias("_carry"))
    found = inside.join(carry, ["_key", "_stretch"])
    return found.select("_key", "_block", F.coalesce("_inside", "_carry").alias("_value"))


def asof_join(
    rows: DataFrame, events: DataFrame, values: list[str], key: str = "pool", at: str = "block_number",
    block: str = "block_number", order: str = "seq", width: int = STRETCH, salt: int | None = None,
) -> DataFrame:
    """`rows` with `values` of the latest event of their key at or before block `at`.

    No row is dropped: NULL values mean a NULL key or block, or none so early. A value that is NULL in the latest
    event stays NULL. `salt` is that of `join_dimension`, which brings the answers back to hot rows.
    """
    clash = set(values) & set(rows.columns)
    if clash:
        raise ValueError(f"rows already have {sorted(clash)}")
    latest = latest_per_block(events, values, key, block, order)
    points = rows.select(F.col(key).alias("_key"), F.col(at).cast("bigint").alias("_block"))
    points = points.filter(F.col("_key").isNotNull() & F.col("_block").isNotNull()).distinct()
    found = asof_points(points, latest, width).select(
        F.col("_key").alias(key), F.col("_block").alias(at), *[F.col(f"_value.{v}").alias(v) for v in values]
    )
    return join_dimension(rows, found, [key, at], "left", salt, spread=tuple(rows.columns)).select(*rows.columns, *values)
