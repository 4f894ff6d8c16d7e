"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffled order, repeated `max_repeats` times.
A document's virtual finish time is its source's running token count divided by the source's target,
so a source that should supply twice as much runs at twice the speed. All documents are range-sorted
by finish time and taken until the total budget is used up. At finish time 1 each source has supplied
exactly its target, and the targets add up to the budget, so the cut falls within a document or so of 1.

Running sums never put a source or the whole order into one task: sums inside blocks of bounded row
count plus the prefix sum of the block totals. All steps are DataFrame functions.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null
doc_ids are ordinary values; rows equal in doc_id, source and text form one unit, taken together;
documents without words cost nothing and are taken when their turn comes; empty input gives no rows.
Further columns of the input are ignored by `mix_plan` and kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.shared import whole_row, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
BLOCK_ROWS = 2_000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _tag(c: Column) -> Column:
    """A value as text that tells null from any string."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def unit_key(doc_id: Column, source: Column, text: Column, seed: str = SEED) -> Column:
    """Seeded shuffle order, which also identifies equal rows."""
    return F.md5(F.concat(F.lit(seed + ":"), _tag(doc_id), F.lit(":"), F.md5(_tag(source)), F.md5(_tag(text))))


def source_targets(
    units: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """Per source: order number, size, target. `units` has source, words, rows.

    Targets are weight times a common level, capped at `max_repeats` times the source's size. With the
    sources sorted by cap / weight, the level is the greatest of (budget - caps before) / (weights from here on).
    """
    per = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("sid", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(cycle, (F.col("sid") - 1) % len(weights) + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = W.partitionBy(F.lit(0))
    rest = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("budget", F.sum("source_size").over(total) * F.lit(float(budget)))
    per = per.withColumn("level", (F.col("budget") - before) / rest)
    per = per.withColumn("level", F.max("level").over(total))
    return per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))


def mix_plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """One row per unit and repetition, each with its finish time and whether the mix takes it.

    Columns: mix_key, doc_id, source, size, copies_in (equal rows of the unit), source_size, target,
    repeat (from 0), finish, taken (boolean). No text is moved.
    """
    text, source, doc_id = F.col("text"), F.col("source"), F.col("doc_id")
    slim = docs.select(
        doc_id, source, word_count(text).alias("size"), unit_key(doc_id, source, text, seed).alias("mix_key")
    )
    units = written(
        slim.groupBy("mix_key", "doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies_in"))
        .withColumn("words", F.col("size") * F.col("copies_in")),
        "mix-units",
    )
    targets = written(source_targets(units, weights, budget, max_repeats).coalesce(1), "mix-targets")
    known = units.join(targets.drop("weight", "cap", "level"), units.source.eqNullSafe(targets.source)).drop(targets.source)
    # running words inside each source, by blocks of the shuffled order
    spread = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    known = known.withColumn("block", F.floor(spread * (1 + F.floor(F.col("rows") / BLOCK_ROWS))))
    blocks = known.groupBy("sid", "block").agg(F.sum("words").alias("block_words"))
    ahead = W.partitionBy("sid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("sid", "block", F.coalesce(F.sum("block_words").over(ahead), F.lit(0)).alias("base"))
    inside = W.partitionBy("sid", "block").orderBy("mix_key").rowsBetween(W.unboundedPreceding, 0)
    queued = known.withColumn("run", F.sum("words").over(inside)).join(blocks, ["sid", "block"])
    repeats = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("repeat")
    finish = (F.col("base") + F.col("run") + F.col("repeat") * F.col("source_size")) / F.col("target")
    flows = queued.select("*", repeats).withColumn(
        "finish", F.when(F.col("target") > 0, finish).when(F.col("repeat") == 0, F.lit(0.0))
    )
    # a source without words supplies its documents once
    flows = flows.filter(F.col("finish").isNotNull())
    order = ["finish", "sid", "repeat", "mix_key"]
    flows = flows.drop("block", "base", "run", "rows").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    flows = written(flows, "mix-flows")
    parts = flows.groupBy("part").agg(F.sum("words").alias("part_words"))
    parts = parts.select(
        "part", F.coalesce(F.sum("part_words").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    run = F.sum("words").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    done = flows.withColumn("run", run).join(parts, "part")
    return done.withColumn("taken", F.col("base") + F.col("run") <= F.col("budget")).drop("part", "run", "base", "budget", "words", "sid")


def mix_counts(plan: DataFrame) -> DataFrame:
    """One row per input document: how many words of it the mix takes, repeats counted."""
    per = plan.groupBy("mix_key", "doc_id", "source", "size", "copies_in", "source_size", "target").agg(
        F.sum(F.col("taken").cast("int")).cast("int").alias("copies")
    )
    rows = per.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies_in"))).alias("_row"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of `docs`, repeated as often as taken, sorted by finish time over all partitions."""
    plan = mix_plan(docs, **options).filter("taken").select("mix_key", F.col("finish").alias("_mix_finish"))
    keyed = docs.select(
        whole_row(docs).alias("_mix_row"),
        unit_key(docs["doc_id"], docs["source"], docs["text"], options.get("seed", SEED)).alias("mix_key"),
    )
    mixed = keyed.join(plan, "mix_key").repartitionByRange("_mix_finish", "mix_key").sortWithinPartitions("_mix_finish", "mix_key")
    return mixed.select("_mix_row.*")
