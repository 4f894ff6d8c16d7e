"""A stream of logs whose offsets are block numbers.

`readStream.format("block_logs")` over a table of `write_logs`. The offset is the next block to read, so a batch is
a range of blocks, whatever files they lie in and whenever those were written. A batch ends at the next multiple of
`blocks_per_batch`, so that windows of that many blocks stay whole; it is cut into gap-free slices of `slice_blocks`, one task each, as in `block_slices`.
A restart goes on at the checkpoint's offset: no block comes twice and none is left out.

A block is final once it lies `confirmations` behind the highest one in the table, as on a node; what is written
for an older block after that is not seen, as late data is dropped further on. The reader tells Spark how far a
batch may go, and Spark doesn't tell it where it is, so the place is kept beside the checkpoint (`place`).
Paths are any that Arrow can open (local, HDFS, S3, GCS); executors read the files themselves, event by event,
with block, event and address filters pushed into the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "block_logs"
SCHEMA = "topic0 string, address string, topics array<string>, data string, block_number bigint, log_index bigint"
ARROW = pa.schema(
    [("topic0", pa.string()), ("address", pa.string()), ("topics", pa.list_(pa.string())), ("data", pa.string()), ("block_number", pa.int64()), ("log_index", pa.int64())]
)
PARTS = re.compile(r"block_part=(-?\d+)$")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("/") else f"file://{path}")


def parts_of(path: str) -> dict[int, str]:
    """Directories of block ranges by number."""
    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {int(m[1]): f.path for f in found if (m := PARTS.search(f.path))}


def highest_block(path: str) -> int:
    """The highest block in the table, from the footers of its last block range; -1 if there is none."""
    store, _ = opened(path)
    for _, directory in sorted(parts_of(path).items(), reverse=True):
        most = -1
        for fragment in pads.dataset(directory, filesystem=store, format="parquet", exclude_invalid_files=True).get_fragments():
            for group in fragment.row_groups:
                stats = group.statistics.get("block_number")
                most = max(most, -1 if stats is None else stats["max"])
        if most >= 0:
            return most
    return -1


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class BlockReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.place = options["path"], options["place"]
        self.topic0 = options.get("topic0")
        self.addresses = [a for a in options.get("addresses", "").lower().split(",") if a]
        self.per_batch, self.slice = int(options.get("blocks_per_batch", 1 << 62)), int(options.get("slice_blocks", 10_000))
        self.per_part, self.confirmations = int(options["blocks_per_part"]), int(options.get("confirmations", 0))
        self.first = int(options.get("start_block", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"block": self.first}

    def _place(self) -> int:
        store, path = opened(self.place)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return self.first
        with store.open_input_stream(path) as f:
            return json.loads(f.read())["block"]

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the next batch: the next line of the grid of `blocks_per_batch`, or the last final block."""
        at = self._place()
        final = highest_block(self.path) - self.confirmations + 1
        return {"block": max(at, min(final, (at // self.per_batch + 1) * self.per_batch))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # Spark has logged this end by now: after a restart it comes again or lies behind
        if end["block"] > self._place():
            store, path = opened(self.place)
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path + ".new") as f:
                f.write(json.dumps(end).encode())
            store.move(path + ".new", path)
        return [Slice(b, min(b + self.slice, end["block"]) - 1) for b in range(start["block"], end["block"], self.slice)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        parts = parts_of(self.path)
        wanted = [parts[n] for n in range(partition.first // self.per_part, partition.last // self.per_part + 1) if n in parts]
        block = pc.field("block_number")
        keep = (block >= partition.first) & (block <= partition.last)
        if self.topic0:
            keep &= pc.field("topic0") == self.topic0
        if self.addresses:
            keep &= pc.field("address").isin(self.addresses)
        for directory in wanted:
            rows = pads.dataset(directory, schema=ARROW, filesystem=store, format="parquet", exclude_invalid_files=True)
            for batch in rows.to_batches(filter=keep):
                if batch.num_rows:
                    yield batch


class BlockLogs(DataSource):
    """Options: path, blocks_per_part (of the table), place; topic0, addresses, blocks_per_batch, slice_blocks, confirmations, start_block."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> BlockReader:  # noqa: N802
        return BlockReader(dict(self.options))


def stream_blocks(spark: SparkSession, path: str, blocks_per_part: int, place: str, topic0: str, **options) -> DataFrame:
    """Logs of one event as a stream of block ranges; see the module for the options."""
    spark.dataSource.register(BlockLogs)
    chosen = {"path": path, "blocks_per_part": blocks_per_part, "place": place, "topic0": topic0, **options}
    return spark.readStream.format(NAME).options(**{k: str(v) for k, v in chosen.items()}).load()
