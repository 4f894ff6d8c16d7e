"""Keyed volume state: restarts, what a batch writes, forgetting, and values a DECIMAL can't hold."""

import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from poolscope.operators import series as S
from poolscope.streaming import keyed
from workload import streams as W

SAMPLES = "pool string, window_id bigint, bucket bigint, volume_anchor decimal(38,0), window_blocks bigint"


def test_fold_by_hand():
    state = None, []
    seen = []
    for bucket, volume in [(10, "5"), (10, "7"), (14, "1"), (13, "9"), (15, None), (16, "2")]:
        forming, entries, late = keyed.fold(*state, bucket, volume, 100, 4, 667)
        state = forming, entries
        seen.append((*keyed.totals(entries), late))
    assert seen == [(0, "0", 0, False), (0, "0", 0, False), (4, "12", 200 + 3 * 667, False), (4, "12", 200 + 3 * 667, True),
                    (4, "1", 100 + 3 * 667, False), (4, None, 200 + 2 * 667, False)]
    assert keyed.totals([(str(10**38 - 1), 1), ("1", 1)]) == (2, None, 2) and keyed.added(str(10**38), "1") == str(10**38 + 1)


def rows_of(df):
    return sorted((r.pool, r.window_id, r.history_len, None if r.history_volume is None else int(r.history_volume), r.history_blocks) for r in df.collect())


def test_restarts_and_what_a_batch_touches(spark, tmp_path):
    rows = [(f"p{p}", w, (w * 7 + p) // 3 - 2 * (w % 5 == 0), None if (w + p) % 11 == 0 else Decimal(10**30 * p + w), 60) for p in range(12) for w in range(30)]
    df = spark.createDataFrame(rows, SAMPLES)
    parts = [df.filter("window_id < 10"), df.filter("window_id between 10 and 19"), df.filter("window_id >= 20")]
    want = rows_of(S.volume_history(df, W.d.BUCKET_BLOCKS))
    assert rows_of(W.run_history(spark, f"{tmp_path}/a", parts)) == want
    base = f"{tmp_path}/a"
    spark.createDataFrame([("p3", 40, 99, Decimal(1), 60)], SAMPLES).write.mode("append").parquet(f"{base}/samples")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/samples")
    query = keyed.start_history(stream, f"{base}/history", f"{base}/checkpoint", W.d.BUCKET_BLOCKS)
    query.awaitTermination()
    written = {}
    for path in Path(f"{base}/checkpoint/state").rglob("*.changelog"):
        version = int(path.name.split(".")[0].split("_")[0])
        written[version] = written.get(version, 0) + path.stat().st_size
    # the last batch touched one pool of twelve
    assert len(written) == 4 and written[4] < written[3] / 2, written
    assert spark.read.parquet(f"{base}/history").filter("window_id = 40").count() == 1


def test_idle_pools_are_forgotten(spark, tmp_path):
    schema = spark.createDataFrame([], SAMPLES).schema

    def arrive(pool, window, bucket):
        spark.createDataFrame([(pool, window, bucket, Decimal(4), 60)], SAMPLES).write.mode("append").parquet(f"{tmp_path}/in")

    def found():
        try:
            return {r.window_id: r.history_len for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        except AnalysisException:  # nothing written yet
            return {}

    arrive("p", 0, 0)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="poll_seconds"):
        keyed.start_history(stream, f"{tmp_path}/out", f"{tmp_path}/state", 100, idle_ms=1)
    query = keyed.start_history(stream, f"{tmp_path}/out", f"{tmp_path}/state", 100, idle_ms=1, poll_seconds=0.2)
    try:
        until = time.time() + 60
        for window in range(3):
            while window not in found() and time.time() < until:
                time.sleep(0.5)
            if window < 2:
                arrive(("q", "p")[window], window + 1, 5 + window)
    finally:
        query.stop()
    # while `q` traded, `p` was forgotten: it starts anew instead of finding the buckets behind it
    assert found() == {0: 0, 1: 0, 2: 0}
