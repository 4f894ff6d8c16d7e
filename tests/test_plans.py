"""Plans: what is broadcast, where Python runs, what is cut before a shuffle."""

import re



from poolscope.operators import aggregate as A
from poolscope.operators.pools import attach_pools
from poolscope.plans import joins as J
from poolscope.plans import market as P
from workload import derive as d
from workload import market as m

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_aggregate_is_hash_based_and_partial(spark):
    text = plan(A.aggregate_v3(attach_pools(d.swaps(spark, SF), d.pools(spark))))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "partial_try_sum" in text and "Python" not in text
    # distinct traders are spread by (window, pool, trader) before a pool comes together
    assert re.search(r"Exchange hashpartitioning\([^)]*trader", text)


def test_big_dimension_is_salted_not_broadcast(spark):
    facts, dim = d.swaps(spark, SF), d.pools(spark)
    text = plan(J.join_dimension(facts, dim, ["pool"], salt=16).groupBy("window_id", "pool").count())
    assert "_salt" in text
    assert J.default_salt(facts) == 1  # an eighth of the eight partitions of tests


def test_no_broadcast_of_a_dimension_larger_than_its_files(spark, tmp_path):
    """Names in few distinct values pack to a fraction; copies for the salts aren't in Spark's estimate at all."""
    spark.sql("SELECT id AS pool, concat('a name of some length ', id % 10) AS token FROM range(300000)").write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim")
    facts = spark.range(1000).selectExpr("id AS seq", "id * 300 AS pool")
    for salt in (1, 8):
        joined = J.join_dimension(facts.repartition(2), dim, ["pool"], salt=salt)
        assert "SortMergeJoin" in plan(joined) and "BroadcastHashJoin" not in plan(joined).split("Initial Plan")[-1]
        assert joined.count() == 1000
        few = J.join_dimension(facts, spark.range(48).selectExpr("id AS pool", "'t' AS token"), ["pool"], salt=salt)
        assert "BroadcastHashJoin" in plan(few)


def test_salting_takes_any_column_type(spark):
    facts = spark.sql("SELECT id AS seq, CAST(id % 2 AS string) AS pool, map('a', id) AS extra FROM range(10)")
    dim = spark.sql("SELECT CAST(id AS string) AS pool, id AS v FROM range(2)")
    assert J.join_dimension(facts, dim, ["pool"], salt=4).count() == 10


def test_lookups_of_few_rows_explode_nothing(spark):
    from poolscope.operators import board, trail

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = spark.sql("SELECT 'direct' AS source, CAST(id AS string) AS started_at, id, 'ok' AS status, 'h' AS hash FROM range(50)")
        details = spark.sql("SELECT id, 'd' AS hash, '0x' AS contract FROM range(1000)")
        text = plan(trail.execution_trail(runs, details))
        rows = P.publish(P.score_samples(P.pool_samples(d.swaps(spark, SF), d.pools(spark), d.CFG), d.CFG, d.RATE), m.tables(spark), d.CFG)
        text += plan(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert board and "Generate explode" not in text and "_salt" not in text


def test_address_reaches_the_scan(spark, tmp_path):
    from poolscope import config
    from poolscope.sources import logs as L
    from workload.logs import raw_logs

    path = str(tmp_path / "logs")
    L.write_logs(raw_logs(spark, SF), path, 500_000)
    found = L.read_logs(spark, path, config.V3.swap_topic0, [d.pool_name(1).upper().replace("0X", "0x")], (0, 2_000_000), 500_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        assert re.search(r"PushedFilters: .*(In\(address|EqualTo\(address)", plan(found))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert found.count() > 0


def test_candle_series_reads_no_frame_to_the_end(spark):
    from poolscope.operators import series as S

    rows = S.candle_series(m.samples(spark, SF))
    assert "unboundedfollowing" not in plan(rows).lower()


def test_board_plan(spark):
    text = plan(P.board_rows(d.swaps(spark, SF), m.tables(spark), d.CFG))
    assert text.count("WindowGroupLimit") >= 4  # both rank cuts, each before and after its shuffle
    assert "Python" not in text and "Arrow" not in text
    assert "SinglePartition" not in text and "rangepartitioning" not in text
    assert text.count("FileScan") == 2  # the sums, and the traders alone


def test_board_scan_reads_only_what_it_needs(spark):
    text = plan(P.board_rows(d.swaps(spark, SF), m.tables(spark), d.CFG))
    assert "props" not in re.search(r"ReadSchema: struct<[^>]*>", text).group(0)


def test_decode_stays_in_the_jvm(spark):
    from workload.logs import raw_logs
    from poolscope.operators import decode as D

    text = plan(D.decode_v3_swaps(D.usable_logs(raw_logs(spark, SF))))
    assert "Python" not in text and "Exchange" not in text


def test_late_windows_partition_by_pool_only_once(spark):
    scored = P.score_samples(m.samples(spark, SF), d.CFG, d.RATE)
    exchanges = re.findall(r"Exchange hashpartitioning\(pool#\d+, \d+\)", plan(scored))
    assert len(exchanges) == 1
