"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Tokens are runs of letters (case kept) and runs of other visible characters. Features are tokens and
pairs of neighbouring tokens, hashed to 2^18 places; a token that follows itself is the same pair
whatever the token, so repetition is seen for words never met before. A document's vector is its
feature counts divided by the root of their number, and its score the logistic of the sparse dot product.

Fitting uses at most MAX_LABELLED labelled documents, the first in hash order of their ids, in one
task; scoring covers every text in full.

Defined cases: null and empty texts have no features, so the bias decides; labels other than 0 and 1,
null labels and labels without a document are not learned from, nor are null ids; without any label
every score is 0.5; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm import learning
from poolscope.llm.text import WORDS_AND_SYMBOLS, find_words, mixed, per_document, text_slices

MAX_LABELLED = 4_000
BITS = 18
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
FOLDS, HELD_OUT = 3, 1


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of tokens, places of pairs, first token of each document). A document with n tokens has n - 1 pairs.

    There is a pair for every token but the stretch's last; those that cross documents point to place 0, which has no weight.
    """
    words = find_words(data, offs, WORDS_AND_SYMBOLS)
    h = words.hashes
    drop = np.uint64(64 - BITS)
    single = (h >> drop).astype(np.int64)
    pair = (mixed(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) >> drop).astype(np.int64)
    pair[h[:-1] == h[1:]] = 1
    ends = words.first[1:-1] - 1
    pair[ends[(ends >= 0) & (ends < len(pair))]] = 0
    return single, pair, words.first


def fit_ftrl(ids: list, texts: list[str], labels: list) -> bytes:
    """Weights (the last one the bias) after PASSES passes in hash order of the ids, pickled."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(6)
    docs = []
    for text, label in zip(texts, labels, strict=True):
        for _, _, data, offs in text_slices(pa.array([text])):
            single, pair, _ = features(data, offs)
            place, count = np.unique(np.concatenate([single, pair]), return_counts=True)
            value = count / np.sqrt(max(1, count.sum()))
            place, value = place[place > 0], value[place > 0]
            docs.append((np.append(place, size - 1), np.append(value, 1.0), float(label)))
    for _ in range(PASSES):
        for k in rng.permutation(len(docs)):
            place, value, label = docs[k]
            w = _weights(z[place], n[place])
            g = (_logistic(w @ value) - label) * value
            step = (np.sqrt(n[place] + g * g) - np.sqrt(n[place])) / ALPHA
            z[place] += g - step * w
            n[place] += g * g
    return pickle.dumps(_weights(z, n).astype(np.float32))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_texts(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.empty(len(col))
    w = weights.astype(np.float64)
    bias, w[0] = w[-1], 0.0
    for i, j, data, offs in text_slices(col):
        single, pair, first = features(data, offs)
        count = np.diff(first)
        total = per_document(w[single], first) + per_document(np.append(w[pair], 0.0)[: len(single)], first)
        out[i:j] = _logistic(bias + total / np.sqrt(np.maximum(1, 2 * count - 1)))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> bytes:
    """A model from the labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("quality").isin(0, 1) & (learning.fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id")
    usable = usable.select("doc_id", F.col("quality").alias("label")).join(known, "doc_id", "left_semi")
    picks = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    return learning.fit_once(learning.sample_texts(docs, picks), fit_ftrl)


def score_quality(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = pickle.loads(shared.value)
        for b in batches:
            score = score_texts(b.column(2), weights)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    # an id that is null is never learned from
    held = F.coalesce(learning.fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: bytes, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return learning.keep_where(docs, lambda col: pa.array(score_texts(col, pickle.loads(shared.value)) >= least))
