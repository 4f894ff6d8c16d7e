"""Block-bucketed volume history and candles, as window functions over per-window samples.

A pool gives at most one sample per window however many swaps it had, so the per-pool windows here
run over pre-aggregated rows: a pool with a third of all swaps has no more samples than any other.
Its sample count is bounded by chain length over window length.

The retained history is "the newest N entries", where a skipped bucket adds a filler entry only
while fewer than N are held. That rule has a closed form: before bucket b the pool holds
min(N, b - first_bucket) entries, so each gap adds min(gap, max(0, N - 1 - held)) fillers. Numbering
the entries that way (`pos`) turns the fold over a growing array into running sums and a RANGE frame;
no pool's history is ever collected into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.money import series_price
from poolscope.functions.rsi import rsi_label, rsi_value
from poolscope.functions.words import WIDE


def whole_sum(name: str) -> Column:
    """Sum of a wide amount that is NULL if a part is unknown or the total leaves 38 digits, never smaller."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.try_sum(name))


def bucketize(df: DataFrame, blocks_per_bucket: int = 667, block: str = "last_block") -> DataFrame:
    """A sample belongs to the bucket of the pool's last trade in its window."""
    return df.withColumn("bucket", F.floor(F.col(block) / blocks_per_bucket).cast("bigint"))


def samples(aggregates: DataFrame, blocks_per_bucket: int = 667) -> DataFrame:
    """Window aggregates -> one sample per (pool, window): bucket, volume, blocks and price.

    The price is NULL when the last square-root price is not positive; the volume counts anyway.
    """
    priced = F.when(
        F.col("last_sqrt_price") > 0, series_price(F.col("last_sqrt_price"), ~F.col("anchor_is_token0"))
    )
    return bucketize(aggregates, blocks_per_bucket).withColumn("price", priced)


def bucket_volume(sample_rows: DataFrame) -> DataFrame:
    """Volume and credited blocks per (pool, bucket)."""
    return sample_rows.groupBy("pool", "bucket").agg(
        whole_sum("volume_anchor").alias("volume"),
        F.sum("window_blocks").alias("blocks"),
        F.count(F.lit(1)).alias("samples"),
    )


def late_drop(sample_rows: DataFrame, key: str = "pool", order: str = "window_id") -> DataFrame:
    """Keep samples whose bucket is not older than one already seen for the pool."""
    seen = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sample_rows.withColumn("_newest", F.max("bucket").over(seen))
        .filter(F.col("bucket") == F.col("_newest"))
        .drop("_newest")
    )


def candles(sample_rows: DataFrame) -> DataFrame:
    """Close per (pool, bucket): the price of the bucket's latest priced sample."""
    return (
        late_drop(sample_rows.filter(F.col("price").isNotNull()))
        .groupBy("pool", "bucket")
        .agg(F.max_by("price", "window_id").alias("close"), F.max("window_id").alias("last_window"))
    )


def _positions(rows: DataFrame, keep: int, live: Column) -> DataFrame:
    """Add _bucket (the pool's newest bucket so far), _opens (first live sample of a bucket), _pos.

    Rows that are not live (late, or without a price) take the position of the state they would
    see and add nothing to it. Optional columns first_bucket and pos carry earlier state.
    """
    carried = "first_bucket" in rows.columns
    order = Window.partitionBy("pool").orderBy("window_id", "bucket")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when(live, F.col("bucket"))
    first = F.when(live, F.coalesce(F.col("first_bucket"), F.col("bucket"))) if carried else usable
    # _first is the first in arrival order, not the minimum: a late sample may be older than it.
    staged = rows.withColumns(
        {
            "_bucket": F.max(usable).over(so_far),
            "_prior": F.max(usable).over(before),
            "_first": F.first(first, ignorenulls=True).over(so_far),
        }
    )
    current = F.coalesce(live & (F.col("bucket") == F.col("_bucket")), F.lit(False))
    opens = current & F.coalesce(F.col("bucket") > F.col("_prior"), F.lit(True))
    staged = staged.withColumns({"_live": current, "_opens": opens})
    held = F.least(F.lit(keep), F.col("_prior") - F.col("_first"))
    gap = F.col("bucket") - F.col("_prior") - 1
    filler = F.least(gap, F.greatest(F.lit(0), F.lit(keep - 1) - held))
    start = F.coalesce(F.col("pos"), F.lit(0)) if carried else F.lit(0)
    step = F.when(F.col("_opens"), F.when(F.col("_prior").isNull(), start).otherwise(1 + filler)).otherwise(F.lit(0))
    return staged.withColumn("_pos", F.sum(step.cast("bigint")).over(so_far))


def volume_history(
    sample_rows: DataFrame,
    blocks_per_bucket: int = 667,
    keep: int = 24,
    state: DataFrame | None = None,
) -> DataFrame:
    """Each sample with the finalized history its pool had at that moment.

    Adds history_volume, history_blocks, history_len, late, first_bucket and pos. `state` holds
    earlier bucket rows (see `volume_state`), so a batch continues where the last one stopped.
    """
    rows = sample_rows.withColumn("_stored", F.lit(False))
    if state is not None:
        rows = rows.unionByName(state.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    numbered = _positions(rows, keep, F.lit(True))
    recent = Window.partitionBy("pool").orderBy("_pos").rangeBetween(-keep, -1)
    live = F.col("_live")
    counted = numbered.withColumns(
        {
            "_v": F.try_sum(F.when(live, F.col("volume_anchor"))).over(recent),
            "_known": F.count(F.when(live, F.col("volume_anchor"))).over(recent),
            "_lived": F.count(F.when(live, F.lit(1))).over(recent),
            "_b": F.sum(F.when(live, F.col("window_blocks"))).over(recent),
            "_n": F.count(F.when(F.col("_opens"), F.lit(1))).over(recent),
        }
    )
    length = F.least(F.lit(keep).cast("bigint"), F.col("_pos"))
    out = counted.withColumns(
        {
            "history_len": length,
            # an unknown volume in the history, or a total beyond 38 digits, leaves it unknown
            "history_volume": F.when(F.col("_lived") == 0, F.lit(0)).when(F.col("_known") == F.col("_lived"), F.col("_v")).cast(WIDE),
            "history_blocks": F.coalesce(F.col("_b"), F.lit(0)) + (length - F.col("_n")) * blocks_per_bucket,
            "late": ~live,
            "first_bucket": F.col("_first"),
            "pos": F.col("_pos"),
        }
    )
    return out.drop("_bucket", "_prior", "_first", "_live", "_opens", "_pos", "_v", "_known", "_lived", "_b", "_n")


def _seen_order(rows: DataFrame) -> list[Column]:
    """Where in its latest window a pool was first seen, kept so that `keep_recent` can tell ties apart."""
    return [F.max_by("first_seq", "window_id").alias("first_seq")] if "first_seq" in rows.columns else []


def volume_state(history: DataFrame, keep: int = 24) -> DataFrame:
    """Bucket rows still needed to continue: the forming bucket and the `keep` entries before it.

    Input is `volume_history` output including its stored rows; size is pools x (keep + 1).
    """
    grouped = (
        history.filter(~F.col("late"))
        .groupBy("pool", "bucket", "first_bucket", "pos")
        .agg(
            whole_sum("volume_anchor").cast(WIDE).alias("volume_anchor"),
            F.sum("window_blocks").alias("window_blocks"),
            F.max("window_id").alias("window_id"),
            *_seen_order(history),
        )
    )
    newest = F.max("pos").over(Window.partitionBy("pool"))
    return grouped.withColumn("_top", newest).filter(F.col("pos") >= F.col("_top") - keep).drop("_top")


def baseline_rate(volume: Column, blocks: Column, length: Column, min_buckets: int = 3) -> Column:
    """Volume per block over the finalized history; NULL while there are too few buckets."""
    return F.when((length >= min_buckets) & (blocks > 0), volume.cast("double") / blocks)


def baseline_sliding(buckets: DataFrame, blocks_per_bucket: int = 667, keep: int = 24) -> DataFrame:
    """Calendar form of the history: exactly the `keep` buckets before each one, absent ones empty.

    It equals `volume_history` until a gap follows a full history; there the retained form keeps
    old busy buckets while this one lets them slide out.
    """
    pool = Window.partitionBy("pool").orderBy("bucket")
    recent = pool.rangeBetween(-keep, -1)
    first = F.min("bucket").over(Window.partitionBy("pool"))
    length = F.least(F.lit(keep).cast("bigint"), F.col("bucket") - first)
    present = F.count(F.lit(1)).over(recent)
    return (
        buckets.withColumn("history_len", length)
        .withColumn("history_volume", F.coalesce(F.sum("volume").over(recent), F.lit(0)).cast(WIDE))
        .withColumn(
            "history_blocks",
            F.coalesce(F.sum("blocks").over(recent), F.lit(0)) + (F.col("history_len") - present) * blocks_per_bucket,
        )
    )


def candle_series(
    sample_rows: DataFrame, keep: int = 30, state: DataFrame | None = None, series_col: str = "series"
) -> DataFrame:
    """Each sample with its pool's price series at that moment: up to `keep` closes, then the forming one.

    Skipped buckets repeat the last close. The frame reaches 2*keep - 1 entries back, because a
    bucket just outside the newest `keep` may have fillers inside; so the array is bounded.
    """
    rows = sample_rows.withColumn("_stored", F.lit(False))
    if state is not None:
        rows = rows.unionByName(state.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
    priced = F.col("price").isNotNull()
    numbered = _positions(rows, keep, priced)
    order = Window.partitionBy("pool").orderBy("window_id", "bucket")
    live = F.col("_live")
    # The close of a bucket is its last live price: the next live row, if any, opens a new bucket.
    # Over the reversed order that is a running value, so a pool's rows are read once.
    behind = Window.partitionBy("pool").orderBy(F.col("window_id").desc(), F.col("bucket").desc())
    next_bucket = F.last(F.when(live, F.col("bucket")), ignorenulls=True).over(behind.rowsBetween(Window.unboundedPreceding, -1))
    forming = F.last(F.when(live, F.col("price")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    staged = numbered.withColumns({"_next": next_bucket, "_forming": forming})
    closes = live & (F.col("_next") > F.col("bucket"))
    held = F.least(F.lit(keep), F.col("bucket") - F.col("_first"))
    filler = F.least(F.col("_next") - F.col("bucket") - 1, F.greatest(F.lit(0), F.lit(keep - 1) - held))
    entry = F.when(closes, F.struct("window_id", "price", (1 + filler).cast("int").alias("times")))
    back = Window.partitionBy("pool").orderBy("_pos").rangeBetween(-(2 * keep - 1), -1)
    gathered = staged.withColumn("_entries", F.array_sort(F.collect_list(entry).over(back)))
    past = F.flatten(F.transform("_entries", lambda e: F.array_repeat(e["price"], e["times"])))
    newest = F.slice(past, F.greatest(F.size(past) - (keep - 1), F.lit(1)), F.lit(keep))
    series = F.when(F.col("_forming").isNotNull(), F.concat(newest, F.array("_forming")))
    out = gathered.withColumns(
        {series_col: series, "first_bucket": F.col("_first"), "pos": F.col("_pos"), "candle_live": live}
    )
    return out.drop("_bucket", "_prior", "_first", "_live", "_opens", "_pos", "_next", "_entries", "_forming")


def candle_state(series_rows: DataFrame, keep: int = 30) -> DataFrame:
    """Bucket closes still needed to continue, from `candle_series` output with its stored rows."""
    grouped = (
        series_rows.filter(F.col("candle_live"))
        .groupBy("pool", "bucket", "first_bucket", "pos")
        .agg(
            F.max_by("price", "window_id").alias("price"),
            F.max("window_id").alias("window_id"),
            *_seen_order(series_rows),
        )
    )
    newest = F.max("pos").over(Window.partitionBy("pool"))
    return grouped.withColumn("_top", newest).filter(F.col("pos") >= F.col("_top") - (2 * keep - 1)).drop("_top")


def rsi_tag(df: DataFrame, series_col: str = "series", min_volume: int = 0) -> DataFrame:
    """rsi and rsi_label of a series; hidden when the window volume is under the floor."""
    shown = F.col("volume_anchor") >= F.lit(str(min_volume)).cast(WIDE) if min_volume else F.lit(True)
    tagged = df.withColumn("rsi", F.when(shown & F.col(series_col).isNotNull(), rsi_value(F.col(series_col))))
    return tagged.withColumn(
        "rsi_label",
        F.when(F.array_min(series_col) < F.array_max(series_col), rsi_label(F.col("rsi"))),
    )


def keep_recent(state: DataFrame, n: int | None = None, key: str = "pool") -> DataFrame:
    """Rows of the n most recently updated keys (None: of all); within one window the later first-seen counts as newer.

    The n newest come from a distributed top-k, not a global sort.
    """
    if n is None:
        return state
    first_seen = F.col("first_seq") if "first_seq" in state.columns else F.lit(None).cast("bigint")
    newest = (
        state.groupBy(key)
        .agg(F.max(F.struct("window_id", first_seen.alias("first_seq"))).alias("_seen"))
        .orderBy(F.col("_seen").desc(), F.col(key))
        .limit(n)
        .select(key)
    )
    return state.join(newest, key, "left_semi")


def spike_score(
    volume: Column,
    blocks: Column,
    volume_usd: Column,
    baseline: Column,
    floor_usd18: int = 50 * 10**18,
    ceiling: float = 999.0,
) -> Column:
    """This window's volume per block against the pool's own baseline.

    NULL (unscored) when the dollar volume is unknown or under the floor, or there is no baseline.
    """
    big_enough = volume_usd >= F.lit(str(floor_usd18)).cast(WIDE)
    rate = volume.cast("double") / F.nullif(blocks, F.lit(0))
    top = F.lit(ceiling)
    return F.when(
        big_enough & (blocks > 0) & baseline.isNotNull() & (rate > 0),
        F.when(baseline <= 0, top).otherwise(F.least(rate / F.nullif(baseline, F.lit(0.0)), top)),
    )
