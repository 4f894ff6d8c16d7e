"""Lookups of a dimension from fact rows when one key may hold a large share of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SALTS = 64
PACKING = 16  # times the size that Spark reckons from compressed files, for rows in memory
FEW_ROWS = 1 << 16


def default_salt(df: DataFrame) -> int:
    """One salt for eight shuffle partitions: enough to spread a key that holds a third of the rows."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MOST_SALTS, partitions // 8))


def _unbroadcast(dim: DataFrame, copies: int = 1) -> DataFrame:
    """`dim`, to be shuffled where Spark would broadcast it for a size that leaves out its copies and the files' compression.

    Decided from the plan alone, without a job. Rows whose number the plan bounds, and small files, stay as they are;
    above Spark's own threshold it broadcasts nothing unless the size that came out at run time is small.
    """
    plan = dim._jdf.queryExecution().optimizedPlan()
    most = plan.maxRows()
    if most.isDefined() and most.get() * copies <= FEW_ROWS:
        return dim
    limit = dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    reckoned = int(str(plan.stats().sizeInBytes()))
    return dim.hint("merge") if reckoned <= limit < reckoned * copies * PACKING else dim


def join_dimension(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", salt: int | None = None, spread: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """Look up a dimension (one row per key) for a large fact table with hot keys.

    A plain shuffle would send every row of a hot key to one task *and* let the aggregate behind the
    join reuse that layout. So each fact row gets one of `salt` numbers from its `spread` columns,
    which name a row (a chain position), and each dimension row is repeated once per number. `salt`
    follows the shuffle partitions unless given; 1 is a plain join. A dimension that is surely small is
    broadcast, a greater one is shuffled (see `_unbroadcast`). Lookups from few rows (boards, reports) are plain joins and don't come here.
    """
    if how not in ("inner", "left"):
        raise ValueError("join_dimension supports inner and left lookups")
    salt = default_salt(facts) if salt is None else salt
    if salt <= 1:
        return facts.join(_unbroadcast(dim), on, how)
    # From row content, never rand(): a recomputed task must place its rows the same way.
    salted_facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    if _unbroadcast(dim, salt) is not dim:
        copies = copies.hint("merge")
    return salted_facts.join(copies, [*on, "_salt"], how).drop("_salt")
