"""Token-id files: flat unsigned integers plus 64-bit document offsets, read through memory maps.

Documents are range-sorted by id; every partition encodes its documents and writes
  <name>.ids     all token ids, little-endian, two bytes each if the vocabulary allows, else four,
  <name>.offsets 64-bit: at which token of the file each document starts, and the end,
  <name>.docs    64-bit document ids.
A part's place among all tokens is the prefix sum of the parts before it. File names carry the
attempt that wrote them, and the manifest, a table, names the files of the attempts that finished:
a task that is run again leaves no half-read part behind.

Defined cases: null and empty texts consist of the end id alone; null doc_ids come first; rows with
equal ids are ordered by a hash of their text; empty input gives no files and no rows. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm.shared import shared_dir, written

MANIFEST = "part int, name string, width int, docs bigint, null_docs bigint, tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
ROWS_OUT = 4_096


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, added: bool = False) -> DataFrame:
    """Write the files of `docs` below `path` and return their manifest with each part's base.

    With `added`, the content of an added token in a text becomes that token's id.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from poolscope.llm.tokens import ByteLevelEncoder, encoder, slices

        enc, task = encoder(ByteLevelEncoder, tokenizer, added), TaskContext.get()
        end = np.array([end_id], enc.dtype).tobytes()
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        docs_n = nulls = tokens = 0
        with (
            store.open_output_stream(f"{root}/{name}.ids") as ids,
            store.open_output_stream(f"{root}/{name}.offsets") as offsets,
            store.open_output_stream(f"{root}/{name}.docs") as names,
        ):
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                key, text = batch.column(0), batch.column(1)
                nulls += key.null_count
                names.write(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for some in slices(text):
                    parts = [x + end for x in enc.encode(some.to_pylist())]
                    ends = tokens + np.cumsum([len(x) // enc.dtype.itemsize for x in parts])
                    offsets.write(ends.astype("<i8").tobytes())
                    ids.write(b"".join(parts))
                    tokens, docs_n = int(ends[-1]), docs_n + len(parts)
        if docs_n:
            row = [task.partitionId(), name, enc.dtype.itemsize, docs_n, nulls, tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=[c.split()[0] for c in MANIFEST.split(", ")],
            )

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", tie)
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("path", F.lit(path))


class TokenFile:
    """The ids of one part; slices come from a memory map, or by ranged reads from a store without maps."""

    def __init__(self, uri: str, width: int):
        from pyarrow import fs

        store, path = _store(uri)
        self.dtype = np.dtype(f"<u{width}")
        self.local = isinstance(store, fs.LocalFileSystem)
        self.ids = np.memmap(path, self.dtype, "r") if self.local else store.open_input_file(path)

    def __getitem__(self, span: slice) -> np.ndarray:
        if self.local:
            return self.ids[span]
        return np.frombuffer(self.ids.read_at((span.stop - span.start) * self.dtype.itemsize, span.start * self.dtype.itemsize), self.dtype)


def _longs(uri: str) -> np.ndarray:
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), "<i8")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: place among all tokens, number of tokens, checksum of the ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{row['path']}/{row['name']}"
                ids = TokenFile(f"{stem}.ids", row["width"])
                offsets, names = _longs(f"{stem}.offsets"), _longs(f"{stem}.docs")
                for i in range(0, row["docs"], ROWS_OUT):
                    j = min(i + ROWS_OUT, row["docs"])
                    crc = [zlib.crc32(ids[slice(a, b)].astype("<u4").tobytes()) for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[i:j], pa.int64(), mask=np.arange(i, j) < row["null_docs"]),
                            pa.array(row["base"] + offsets[i:j], pa.int64()),
                            pa.array(np.diff(offsets[i : j + 1]), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "part").mapInArrow(read, READ)
