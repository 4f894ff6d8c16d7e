"""Bounded samples of labelled texts for fitting, and applying a fitted model to every text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import give_back


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_texts(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """doc_id, label, text for `picks` (doc_id, label; at most a few thousand rows, as its maker limits them).

    One row per id: of several the least label and text.
    """
    few = F.broadcast(picks.groupBy("doc_id").agg(F.min("label").alias("label")))
    found = docs.select("doc_id", "text").join(few, "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def fit_once(sample: DataFrame, fit: Callable[[list, list[str | None], list], bytes]) -> bytes:
    """The model that one task fits on the bounded sample, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row["doc_id"], row["text"], row["label"]) for b in batches for row in b.to_pylist())
        model = fit(*(list(c) for c in zip(*rows, strict=True))) if rows else fit([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    gathered = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label").repartition(1)
    model = gathered.mapInArrow(run, "model binary").first()
    return bytes(model.model) if model is not None else fit([], [], [])


def keep_where(docs: DataFrame, mask: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """The rows of `docs`, with all their columns, where `mask` of the text column is true."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(mask(batch.column(at)))
            give_back()

    return docs.mapInArrow(run, docs.schema)
