"""The clustered log layout: same rows, and a rare pool or a block range reads a small share of them."""

from pyspark.sql import functions as F

from poolscope.sources import logs as L


def rows_scanned(df):
    """(rows out, rows that left the scan before the filter)."""
    n = len(df.collect())
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return n, leaves.apply(0).metrics().apply("numOutputRows").value()


def test_interleaved(spark):
    got = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (0xFFFF, 0), (0b101, 0b011), (1 << 20, 3)], "a bigint, b bigint")
    plain = lambda a, b: int("".join(x + y for x, y in zip(f"{a & 0xFFFF:016b}", f"{b & 0xFFFF:016b}", strict=True)), 2)
    for r in got.withColumn("k", L.interleaved(F.col("a"), F.col("b"))).collect():
        assert r.k == plain(r.a, r.b)


def test_clustered_layout_reads_little(spark, tmp_path):
    # 2,000 pools; one log in a thousand is of the rare one
    pool = "CASE WHEN id % 1000 = 7 AND id < 3000 THEN '0xFF' ELSE concat('0xa', lpad(hex(id * 7919 % 2000), 6, '0')) END"
    logs = spark.range(64_000).selectExpr(f"{pool} AS address", "array('t0', 't1', 't2') AS topics", "concat('d', id) AS data", "id div 8 AS block_number", "id % 8 AS log_index")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for name, clustered in (("plain", False), ("clustered", True)):
            L.write_logs(logs, f"{tmp_path}/{name}", 8_000, clustered=clustered)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = lambda name, **k: L.read_logs(spark, f"{tmp_path}/{name}", "t0", blocks_per_part=8_000, **k)
    columns = ["address", "data", "block_number", "log_index"]
    assert read("clustered").select(columns).exceptAll(read("plain").select(columns)).count() == 0 and read("clustered").count() == 64_000
    one = "0xa" + f"{7919 * 5 % 2000:X}".rjust(6, "0")
    found, scanned = rows_scanned(read("clustered", addresses=[one]))
    assert found == rows_scanned(read("plain", addresses=[one]))[0] > 0
    # the files of one pool's share of the cells: an eighth of all rows, where blocks alone would read all
    assert scanned <= 64_000 / 6 < rows_scanned(read("plain", addresses=[one]))[1]
    found, scanned = rows_scanned(read("clustered", block_range=(1000, 1499)))
    assert found == 4_000 and scanned <= 64_000 / 4
