"""32-byte ABI words as column expressions.

A word is 64 hex digits. DECIMAL(38,0) holds any magnitude below 2^124, which covers every real
token amount; a wider word decodes to NULL here and keeps its digits in the ``*_word`` column, so
`exact_sum` can still add it up without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions import limbs as L

WIDE = "decimal(38,0)"
_TWO64 = "18446744073709551616"
_ZEROS33, _ONES33 = "0" * 33, "f" * 33
LIMBS = 8  # 32 bits each


def negated(x: Column) -> Column:
    """-x of a wide decimal. Spark's unary minus and abs() round to 34 digits; subtraction does not."""
    return (F.lit(0).cast(WIDE) - x).cast(WIDE)


def magnitude(x: Column) -> Column:
    """|x| of a wide decimal, exact (see `negated`)."""
    return F.when(x < 0, negated(x)).otherwise(x.cast(WIDE))


def word_hex(data: Column, index: int) -> Column:
    """The n-th word's hex digits, lower-cased; '' when the data ends before it."""
    return F.lower(F.substring(data, 3 + 64 * index, 64))


def has_words(data: Column, n: int) -> Column:
    """True when the answer really carries n words (`0x` is silence, not a zero)."""
    return F.coalesce(F.length(data) >= 2 + 64 * n, F.lit(False))


def is_full_word(w: Column) -> Column:
    return (F.length(w) == 64) & F.unhex(w).isNotNull()


def _u64(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def _low128(w: Column, negative: Column | None = None) -> Column:
    """The low 128 bits; for a negative word 2^64 comes off the upper half before it is scaled up."""
    two64 = F.lit(_TWO64).cast("decimal(20,0)")
    hi = _u64(F.substring(w, 33, 16))
    if negative is not None:
        hi = F.when(negative, hi - two64).otherwise(hi.cast("decimal(21,0)"))
    full = (hi * two64 + _u64(F.substring(w, 49, 16))).cast(WIDE)
    return F.when(w.startswith("0" * 48), _u64(F.substring(w, 49, 16)).cast(WIDE)).otherwise(full)


def word_value(w: Column) -> Column:
    """Unsigned value of a word: absent -> 0, partial or wider than 2^124 -> NULL."""
    fits = w.startswith(_ZEROS33) & is_full_word(w)
    return F.when(fits, _low128(w)).when(w == "", F.lit(0).cast(WIDE))


def signed_value(w: Column) -> Column:
    """Two's-complement value of a word, with the same rules as `word_value`."""
    negative = w.startswith(_ONES33)
    fits = (negative | w.startswith(_ZEROS33)) & is_full_word(w)
    return F.when(fits, _low128(w, negative)).when(w == "", F.lit(0).cast(WIDE))


def word(data: Column, index: int) -> Column:
    return word_value(word_hex(data, index))


def signed_word(data: Column, index: int) -> Column:
    return signed_value(word_hex(data, index))


def word_double(w: Column) -> Column:
    """Unsigned value of a full 256-bit word as DOUBLE (for prices, which are ratios anyway)."""
    parts = [
        F.conv(F.substring(w, 1 + 16 * k, 16), 16, 10).cast("double") * F.lit(2.0 ** (64 * (3 - k)))
        for k in range(4)
    ]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(w == "", F.lit(0.0)).when(is_full_word(w), total)


def topic_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def word_address(data: Column, index: int) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(data, 3 + 64 * index + 24, 40)))


def norm_addr(address: Column) -> Column:
    return F.lower(F.trim(address))


def hex_block(number: Column) -> Column:
    """Hex block number -> BIGINT; missing -> 0."""
    digits = F.regexp_replace(F.lower(number), "^0x", "")
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def abi_string(answer: Column) -> Column:
    """ABI-encoded string (offset, length, bytes) -> text without NULs; '' on any failure."""
    length_word = word_hex(answer, 1)
    available = F.length(answer) - 130
    wanted = F.when(
        length_word.startswith("0" * 56), F.conv(F.right(length_word, F.lit(8)), 16, 10).cast("bigint") * 2
    ).otherwise(available.cast("bigint"))
    body = F.substring(answer, F.lit(131), F.least(wanted, available.cast("bigint")).cast("int"))
    digits = F.regexp_extract(body, "^[0-9a-fA-F]*+", 0)
    even = F.substring(digits, F.lit(1), (F.length(digits) - F.length(digits) % 2).cast("int"))
    text = F.make_valid_utf8(F.unhex(even).cast("string"))
    ok = has_words(answer, 2) & is_full_word(length_word)
    return F.when(ok, F.replace(text, F.lit("\0"), F.lit(""))).otherwise(F.lit(""))


def limb(w: Column, k: int) -> Column:
    """The k-th 32-bit limb of a word, k = 0 being the lowest."""
    return F.conv(F.substring(w, 57 - 8 * k, 8), 16, 10).cast("bigint")


def wide_total(sums: list[Column], negatives: Column) -> Column:
    """Decimal text of sum(limbs[k] * 2^(32k)) - negatives * 2^256, for one row per group."""
    return L.signed_text(L.from_sums(sums, 32, negatives))


def exact_sum(df: DataFrame, keys: list[str], word_col: str, out: str = "total", signed: bool = True) -> DataFrame:
    """Exact sum of 256-bit words per group, as decimal text, plus how many rows were wide.

    Narrow rows add up as DECIMAL; only wide rows go through eight 32-bit limb sums. Both are plain
    partial aggregates, so a hot group is combined before the shuffle. One finished row per group
    is turned into text.
    """
    w = F.col(word_col)
    value = signed_value(w) if signed else word_value(w)
    staged = df.withColumn("_narrow", value)
    wide = F.col("_narrow").isNull() & is_full_word(w)
    sums = [F.sum(F.when(wide, limb(w, k))).alias(f"_l{k}") for k in range(LIMBS)]
    minus = F.sum(F.when(wide & (F.substring(w, 1, 1) >= "8"), F.lit(1))).alias("_minus")
    grouped = staged.groupBy(*keys).agg(
        F.sum("_narrow").alias("_fast"),
        F.count(F.when(wide, F.lit(1))).alias("wide_rows"),
        F.count(F.when(F.col("_narrow").isNull() & ~F.coalesce(wide, F.lit(False)), F.lit(1))).alias("bad_rows"),
        minus if signed else F.lit(0).alias("_minus"),
        *sums,
    )
    fast = F.coalesce(F.col("_fast"), F.lit(0).cast(WIDE))
    # The narrow total joins the limbs as two's-complement-free parts: |x| < 2^128 fits four limbs.
    low = magnitude(fast)
    step = F.lit(4294967296).cast("decimal(11,0)")
    pieces, rest = [], low
    for _ in range(4):
        digit = rest % step
        pieces.append(digit.cast("bigint"))
        rest = ((rest - digit) / step).cast(WIDE)
    sign = F.when(fast < 0, F.lit(-1)).otherwise(F.lit(1))
    limbs = [
        F.coalesce(F.col(f"_l{k}"), F.lit(0)) + (sign * pieces[k] if k < 4 else F.lit(0)) for k in range(LIMBS)
    ]
    return grouped.select(*keys, wide_total(limbs, F.col("_minus")).alias(out), "wide_rows", "bad_rows")
