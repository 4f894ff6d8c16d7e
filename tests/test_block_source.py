"""The block-offset stream: batches, restarts, slices and filters."""

from pathlib import Path

from pyspark.sql import functions as F

from poolscope.sources import block_source as B
from poolscope.sources import logs as L

PER_PART = 100


def make_logs(spark, first, last):
    return spark.range(first * 3, (last + 1) * 3).selectExpr(
        "concat('0xA', id % 4) AS address", "array(CASE WHEN id % 5 = 0 THEN 't1' ELSE 't0' END) AS topics", "concat('d', id) AS data",
        "id div 3 AS block_number", "id % 3 AS log_index",
    )


def run(spark, base, **options):
    """Work off what is there in one start; the block ranges of its batches."""
    seen = []

    def cycle(batch, batch_id):
        ends = batch.agg(F.min("block_number"), F.max("block_number")).first()
        seen.append(tuple(ends))
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    stream = B.stream_blocks(spark, f"{base}/logs", PER_PART, f"{base}/place/at.json", "t0", **options)
    query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(cycle).start()
    query.processAllAvailable()
    query.stop()
    return seen


def test_every_block_once_over_restarts(spark, tmp_path):
    base = str(tmp_path)
    L.write_logs(make_logs(spark, 0, 449), f"{base}/logs", PER_PART)
    first = run(spark, base, blocks_per_batch=130, slice_blocks=40, confirmations=10)
    assert first == [(0, 129), (130, 259), (260, 389), (390, 439)]
    # earlier blocks in newer files are not mistaken for new ones, nor do file times decide anything
    L.write_logs(make_logs(spark, 450, 700), f"{base}/logs", PER_PART, mode="append")
    assert run(spark, base, blocks_per_batch=200, slice_blocks=7) == [(440, 599), (600, 700)]
    assert run(spark, base) == []
    got = spark.read.parquet(f"{base}/out")
    want = make_logs(spark, 0, 700).filter("topics[0] = 't0'")
    assert got.count() == got.select("data").distinct().count() == want.count()
    assert got.select("data").exceptAll(want.select("data")).count() == 0
    assert got.filter("address <> lower(address)").count() == 0


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    base = str(tmp_path)
    L.write_logs(make_logs(spark, 0, 99), f"{base}/logs", PER_PART)
    stream = B.stream_blocks(spark, f"{base}/logs", PER_PART, f"{base}/place/at.json", "t0", blocks_per_batch=50)

    def dies(batch, batch_id):
        raise RuntimeError("no")

    query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(dies).start()
    try:
        query.processAllAvailable()
    except Exception:  # noqa: BLE001
        pass
    query.stop()
    assert run(spark, base, blocks_per_batch=50) == [(0, 49), (50, 99)]


def test_reader_alone(spark, tmp_path):
    base = str(tmp_path)
    options = {"path": f"{base}/logs", "place": f"{base}/at.json", "blocks_per_part": str(PER_PART), "topic0": "t0"}
    assert B.BlockReader(options).latestOffset() == {"block": 0} and B.highest_block(f"{base}/logs") == -1
    L.write_logs(make_logs(spark, 0, 250), f"{base}/logs", PER_PART)
    reader = B.BlockReader({**options, "slice_blocks": "100", "addresses": "0xA1,0xa2"})
    assert reader.latestOffset() == {"block": 251}
    slices = reader.partitions({"block": 95}, {"block": 251})
    assert [(s.first, s.last) for s in slices] == [(95, 194), (195, 250)] and reader._place() == 251
    rows = [r for s in slices for b in reader.read(s) for r in b.to_pylist()]
    assert {r["address"] for r in rows} == {"0xa1", "0xa2"} and {r["topic0"] for r in rows} == {"t0"}
    assert (min(r["block_number"] for r in rows), max(r["block_number"] for r in rows)) == (95, 249)
    assert Path(f"{base}/at.json").read_text() == '{"block": 251}'
