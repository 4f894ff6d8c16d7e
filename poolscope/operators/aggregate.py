"""Per-pool window aggregates. All are single-pass hash aggregates with map-side partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions.money import dec, plausible_fee
from poolscope.functions.words import LIMBS, WIDE, is_full_word, limb, magnitude, wide_total

POOL_COLUMNS = ["token", "anchor", "anchor_kind", "anchor_is_token0"]


def count_traders(swaps: DataFrame, keys: list[str], trader: str) -> DataFrame:
    """Exact distinct traders per group, on a table of just these columns.

    Apart from the sums, so that their buffers don't travel once per trader; a hot pool is deduped
    on (group, trader) in many tasks before it comes together.
    """
    return swaps.select(*keys, trader).distinct().groupBy(*keys).agg(F.count(trader).alias("traders"))


def trader_sketches(swaps: DataFrame, keys: list[str], trader: str, lg: int = 12) -> DataFrame:
    """A sketch of the distinct traders per group, to be stored and merged to any span later.

    2^lg registers: a standard error of 1.04 / sqrt(2^lg), 1.6 % at 12, in at most about 2.5 KB a group; counts of
    up to a few hundred are exact. Sketches are partial aggregates, so a hot group is combined before the shuffle.
    """
    return swaps.groupBy(*keys).agg(F.hll_sketch_agg(trader, F.lit(lg)).alias("trader_sketch"))


def merge_traders(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct traders per group of stored sketches, each trader counted once however many buckets saw it."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("trader_sketch")).alias("traders"))


def recent_buckets(sketches: DataFrame, n: int, key: str = "pool", bucket: str = "bucket") -> DataFrame:
    """Sketches of the `n` buckets up to the newest one of each key."""
    newest = sketches.groupBy(key).agg(F.max(bucket).alias("_newest"))
    return sketches.join(newest, key).filter(F.col(bucket) > F.col("_newest") - n).drop("_newest")


# Amounts below 10^27 (a billion whole tokens) are added up as three BIGINT pieces of nine digits
# each, which is several times faster than DECIMAL(38,0) arithmetic. Greater amounts, up to 256 bits,
# are added up as eight 32-bit limbs in the same pass. A total that leaves 38 digits is NULL (its
# exact text is in `exact_text`), never a smaller number, and nothing overflows into an error.
_FAST = 10**27
_E18, _E12, _E9, _E6 = 10**18, 10**12, 10**9, 10**6
_STEP = 1 << 32


def split_amount(df: DataFrame, name: str) -> DataFrame:
    """Add `_name_h` and `_name_l` with name = h * 10^18 + l, both NULL for the slow path."""
    small = (F.col(name) < dec(_FAST)) & (F.col(name) > dec(-_FAST))
    unit = f"CAST('{_E18}' AS DECIMAL(19,0))"
    return df.withColumn(f"_{name}_h", F.when(small, F.expr(f"{name} div {unit}"))).withColumn(
        f"_{name}_l", F.when(small, F.expr(f"{name} % {unit}").cast("bigint"))
    )


def magnitude_limbs(swaps: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """(limbs of |amount| from the lowest, amount > 0, is unknown) for amounts off the fast path.

    They come from the hex word where the table has it, else from the decimal. A negative word's
    magnitude is its complement plus one; the lowest limb may then be 2^32, which sums do not mind.
    """
    amount, word = F.col(name), f"{name}_word"
    if word in swaps.columns:
        w = F.col(word)
        negative = F.substring(w, 1, 1) >= "8"
        limbs = [F.when(negative, (_STEP - 1) - limb(w, k) + int(k == 0)).otherwise(limb(w, k)) for k in range(LIMBS)]
        known = F.coalesce(is_full_word(w), F.lit(False))
        return F.when(known, F.array(*limbs)), known & ~negative, ~known
    rest, digits = magnitude(amount), []
    for _ in range(4):
        digit = rest % dec(_STEP)
        digits.append(digit.cast("bigint"))
        rest = ((rest - digit) / dec(_STEP)).cast(WIDE)
    limbs = F.array(*digits, *[F.lit(0).cast("bigint")] * (LIMBS - 4))
    return F.when(amount.isNotNull(), limbs), amount > 0, amount.isNull()


def fee_limbs(limbs: Column, pips: Column) -> Column:
    """Limbs of trunc(amount * pips / 10^6) by short division from the highest limb; pips up to 2^30, else NULL."""
    rate = F.when(pips.between(0, 1 << 30), pips.cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        value = acc["rest"] * _STEP + x * rate
        return F.struct((value % _E6).alias("rest"), F.concat(F.array(_div(value, _E6)), acc["out"]).alias("out"))

    return F.when(rate.isNotNull(), F.aggregate(F.reverse(limbs), start, step, lambda acc: acc["out"]))


def _div(a: Column, unit: int) -> Column:
    return F.call_function("div", a, F.lit(unit).cast("bigint"))


def _volume_pieces(h: Column, low: Column) -> list[Column]:
    a = F.abs(low)
    return [F.abs(h), _div(a, _E9), a % _E9]


def _fee_pieces(h: Column, low: Column, pips: Column, pays: Column) -> list[Column]:
    """Pieces of trunc((h * 10^18 + l) * pips / 10^6) for a non-negative amount, pips <= 10^6."""
    f = pips.cast("bigint")
    top = h * f
    rest = (top % _E6) * _E12 + _div(low, _E6) * f + _div((low % _E6) * f, _E6)
    return [F.when(pays, x) for x in (_div(top, _E6), _div(rest, _E9), rest % _E9)]


def _sums(name: str, pieces: list[Column], limbs: str, unknown: Column) -> list[Column]:
    """Buffers of one total: the pieces, the limbs of the array column `limbs`, and rows that are unknown."""
    fast = [F.try_sum(p).alias(f"_{name}{i}") for i, p in enumerate(pieces)]
    slow = [F.try_sum(F.get(F.col(limbs), F.lit(k))).alias(f"_{name}_l{k}") for k in range(LIMBS)]
    return [*fast, *slow, F.count(F.when(unknown, F.lit(1))).alias(f"_{name}_unknown")]


def _total(df: DataFrame, name: str, keep_limbs: bool) -> DataFrame:
    """The total as DECIMAL(38,0), NULL where it is unknown or wider; with its limbs if wanted."""
    zero = F.lit(0).cast("bigint")
    part = lambda c: F.coalesce(F.col(c), zero)
    pieces = [part(f"_{name}{i}").cast("decimal(19,0)") for i in range(3)]
    fast = (pieces[0] * dec(_E18) + pieces[1] * dec(_E9) + pieces[2]).cast(WIDE)
    sums = [part(f"_{name}_l{k}") for k in range(LIMBS)]
    low = F.lit(0).cast(WIDE)
    for k in range(4):
        low = F.try_add(low, F.try_multiply(sums[k].cast("decimal(20,0)"), dec(_STEP**k)).cast(WIDE))
    any_limb = F.greatest(*sums) > 0
    small = F.greatest(*sums[4:]) == 0
    # below that many rows no BIGINT sum of pieces or limbs can overflow
    known = (F.col(f"_{name}_unknown") == 0) & (F.col("swaps") < 1 << 31)
    value = F.when(~any_limb, fast).when(small, F.try_add(fast, low).cast(WIDE))
    out = df.withColumn(name, F.when(known, value))
    if keep_limbs:
        out = out.withColumn(f"{name}_limbs", F.when(known, F.array(fast, *[s.cast(WIDE) for s in sums])))
    return out.drop(*[f"_{name}{i}" for i in range(3)], *[f"_{name}_l{k}" for k in range(LIMBS)], f"_{name}_unknown")


def exact_text(name: str) -> Column:
    """A total as decimal digits, however wide, from the limbs kept by `keep_limbs`. One call per finished row."""
    limbs = F.col(f"{name}_limbs")
    fast, step = F.get(limbs, F.lit(0)), dec(_STEP)
    low, rest = [], fast
    for _ in range(4):
        digit = rest % step
        low.append(digit.cast("bigint"))
        rest = ((rest - digit) / step).cast(WIDE)
    sums = [F.get(limbs, F.lit(k + 1)).cast("bigint") + (low[k] if k < 4 else F.lit(0)) for k in range(LIMBS)]
    return F.when(limbs.isNotNull(), wide_total(sums, F.lit(0)))


def _anchor(suffix: str) -> Column:
    first, second = F.col(f"_amount0{suffix}"), F.col(f"_amount1{suffix}")
    return F.when(F.col("anchor_is_token0"), first).otherwise(second)


def _common(swaps: DataFrame, approx: bool, trader: str) -> list[Column]:
    wide = F.lit(False)
    for name in ("amount0", "amount1"):
        word = f"{name}_word"
        broken = F.lit(False) if word not in swaps.columns else ~F.coalesce(is_full_word(F.col(word)), F.lit(False))
        wide = wide | (F.col(name).isNull() & ~broken)
    return [
        F.count(F.lit(1)).alias("swaps"),
        *([F.approx_count_distinct(trader).alias("traders")] if approx else []),
        F.max_by("sqrt_price", "seq").alias("last_sqrt_price"),
        F.max_by("block_number", "seq").alias("last_block"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count(F.when(wide, F.lit(1))).alias("overflow_rows"),
        F.count(F.when(F.col("_broken"), F.lit(1))).alias("broken_rows"),
    ]


def _staged(swaps: DataFrame) -> DataFrame:
    """Swaps with their amounts in pieces, the limbs of amounts off the fast path, and whether an amount is broken."""
    out, broken = swaps, F.lit(False)
    for name in ("amount0", "amount1"):
        out = split_amount(out, name)
        limbs, positive, unknown = magnitude_limbs(swaps, name)
        slow = F.col(f"_{name}_h").isNull()
        out = out.withColumns(
            {
                f"_{name}_m": F.when(slow, limbs),
                f"_{name}_up": F.when(slow, positive),
                f"_{name}_lost": slow & unknown,
            }
        )
        broken = broken | F.col(f"_{name}_lost")
    return out.withColumns({"_h": _anchor("_h"), "_l": _anchor("_l"), "_m": _anchor("_m"), "_lost": _anchor("_lost"), "_broken": broken})


def aggregate_v3(swaps: DataFrame, keys: list[str] | None = None, approx: bool = False, keep_limbs: bool = False) -> DataFrame:
    """One row per (window, pool): anchor volume, swaps, distinct recipients, fees per leg, last price.

    `swaps` already carries the pool columns (see `attach_pools`) and the pool's `fee_pips`. They
    depend on the pool alone, so grouping by them too changes nothing and keeps strings out of the
    aggregate buffers, which is what lets Spark use hash aggregation. `approx` counts traders
    approximately and saves their own pass; `keep_limbs` keeps what `exact_text` needs.
    """
    keys = keys or ["window_id", "pool"]
    pips, staged = F.col("fee_pips"), _staged(swaps)
    wanted = _sums("volume_anchor", _volume_pieces(F.col("_h"), F.col("_l")), "_m", F.col("_lost"))
    for leg in ("0", "1"):
        lh, ll, up = F.col(f"_amount{leg}_h"), F.col(f"_amount{leg}_l"), F.col(f"_amount{leg}_up")
        quick = lh.isNotNull() & (pips <= _E6)
        pays = quick & ((lh > 0) | (ll > 0))
        staged = staged.withColumn(f"_fee{leg}", F.when(up, fee_limbs(F.col(f"_amount{leg}_m"), pips)))
        unknown = F.col(f"_amount{leg}_lost") | (up & F.col(f"_fee{leg}").isNull()) | (lh.isNotNull() & (pips > _E6))
        wanted += _sums(f"fees{leg}", _fee_pieces(lh, ll, pips, pays), f"_fee{leg}", unknown)
    with_word = "sqrt_price_word" in swaps.columns
    out = staged.groupBy(*keys, *POOL_COLUMNS, "fee_pips").agg(
        *wanted, *_common(swaps, approx, "trader"), *(_last_word_limbs() if with_word else [])
    )
    for name in ("volume_anchor", "fees0", "fees1"):
        out = _total(out, name, keep_limbs)
    out = out if approx else out.join(count_traders(swaps, keys, "trader"), keys)
    return _join_word(out) if with_word else out


def aggregate_cl(
    swaps: DataFrame, keys: list[str] | None = None, approx: bool = False, max_fee_pips: int = 100_000, keep_limbs: bool = False
) -> DataFrame:
    """The singleton-venue twin: distinct senders, and the fee each event says it charged.

    An implausible fee keeps its volume but adds no fee and never becomes the pool's last fee.
    """
    keys = keys or ["window_id", "pool"]
    fee = F.col("event_fee")
    good = plausible_fee(fee, max_fee_pips)
    h, low = F.col("_h"), F.col("_l")
    quick = h.isNotNull() & (fee <= _E6)
    fees = _fee_pieces(F.abs(h), F.abs(low), fee, good & quick)
    staged = _staged(swaps).withColumn("_fee", F.when(good, fee_limbs(F.col("_m"), fee)))
    unknown = good & (F.col("_lost") | (h.isNotNull() & (fee > _E6)) | (F.col("_m").isNotNull() & F.col("_fee").isNull()))
    out = staged.groupBy(*keys, *POOL_COLUMNS).agg(
        *_sums("volume_anchor", _volume_pieces(h, low), "_m", F.col("_lost")),
        *_sums("fees_anchor", fees, "_fee", unknown),
        F.max_by(F.when(good, fee), F.when(good, F.col("seq"))).alias("last_fee_pips"),
        *_common(swaps, approx, "trader"),
    )
    out = _total(_total(out, "volume_anchor", keep_limbs), "fees_anchor", keep_limbs)
    return out if approx else out.join(count_traders(swaps, keys, "trader"), keys)


def _last_word_limbs() -> list[Column]:
    """The last price's 160 bits as three BIGINT pieces: text in a buffer would rule out hash aggregation."""
    cuts = (("_w2", 25, 14), ("_w1", 39, 13), ("_w0", 52, 13))
    word = F.col("sqrt_price_word")
    return [
        # an absent price word is zero, as everywhere
        F.max_by(F.when(word == "", F.lit(0)).otherwise(F.conv(F.substring(word, start, size), 16, 10).cast("bigint")), "seq").alias(name)
        for name, start, size in cuts
    ]


def _join_word(df: DataFrame) -> DataFrame:
    digits = [F.lpad(F.lower(F.hex(name)), size, "0") for name, size in (("_w2", 14), ("_w1", 13), ("_w0", 13))]
    return df.withColumn("last_sqrt_word", F.concat(*digits)).drop("_w2", "_w1", "_w0")


def last_value(df: DataFrame, keys: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """Value of each column in the row with the highest order key; never `last()`, which has no order."""
    return df.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def latest_price(prices: DataFrame, as_of: int | None = None, key: str = "pool") -> DataFrame:
    """Latest price per pool at or before a block, for fee valuation and position values."""
    seen = prices if as_of is None else prices.filter(F.col("block_number") <= as_of)
    return seen.groupBy(key).agg(
        F.max_by("sqrt_price", "seq").alias("sqrt_price"), F.max_by("block_number", "seq").alias("price_block")
    )
