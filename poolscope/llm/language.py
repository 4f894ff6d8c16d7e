"""Language identification by a linear-chain conditional random field over the words of a text.

Every word gets a score per language from its affixes (three and four bytes at either end), its
n-grams (two and three bytes, with marks at the word's ends) and the learned lexicons that hold it;
learned transition scores connect neighbouring words, so a text may switch language and back. The
forward-backward algorithm over the whole text gives each word's language probabilities; their means
over the words decide the text's language and are its score.

Words are runs of letters, lower-cased for ASCII and Latin-1; bytes beyond ASCII count as letters.

Fitting uses at most PER_LABEL documents of a language and MAX_DOCS in all, the first in hash order
of their ids, whole texts, in one task. Their words are cut into windows, and windows of different
documents are chained, so that transitions are learned from text that switches. Prediction covers
every text in full, as one chain.

Defined cases: a text that is null or has no letters is `und` with score 0; null languages and ids
are not learned from; with nothing to learn from every text is `und`; ties go to the first language
by code point; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from poolscope.llm import learning
from poolscope.llm.text import WORDS_ONLY, Words, find_words, per_document, text_slices

FOLDS, HELD_OUT = 4, 2
PER_LABEL, MAX_DOCS = 120, 2_000
TABLE_BITS = 16
WINDOW, CHAIN = 40, 4
PASSES, CHAINS_PER_STEP, RATE, DECAY = 3, 128, 0.3, 1e-4
LEXICON_SIZE, LEXICON_COUNT = 2_000, 5
CLIP = 25.0
MIN_CERTAINTY = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals (0xC3 0x80 to 0x9E) in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 32
    return out


class WordFeatures:
    """Feature places of distinct words, kept flat: n-gram places with their words' bounds, and affix places per word."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.bounds = np.concatenate([[0], np.cumsum(size + 2)])
        marked = np.zeros(int(self.bounds[-1]) + 3, np.uint32)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        marked[np.repeat(self.bounds[:-1] + 1, size) + place] = data[np.repeat(starts, size) + place]
        marked[self.bounds[:-1]], marked[self.bounds[1:] - 1] = 1, 2
        n = int(self.bounds[-1])
        a, b, c = (marked[k : n + k] * np.uint32(m) for k, m in ((0, 0x9E3779B1), (1, 0x85EBCA6B), (2, 0xC2B2AE35)))
        none = 1 << TABLE_BITS
        self.two = self._place(a + b + np.uint32(0x1234567))
        self.three = self._place(a + b + c + np.uint32(0x7654321))
        self.two[self.bounds[1:] - 1] = none
        self.three[self.bounds[1:] - 1] = self.three[self.bounds[1:] - 2] = none
        self.affixes = []
        for k in (3, 4):
            long = size >= k
            for front, salt in ((self.bounds[:-1] + 1, 0x1111), (self.bounds[1:] - 1 - k, 0x2222)):
                at = np.where(long, front, 0)
                h = np.full(len(at), salt + k, np.uint32)
                for d in range(k):
                    h = (h ^ marked[at + d]) * np.uint32(0x01000193)
                self.affixes.append(np.where(long, self._place(h * np.uint32(0x9E3779B1)), none))

    @staticmethod
    def _place(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def scores(self, table: np.ndarray) -> np.ndarray:
        out = np.add.reduceat(table[self.two] + table[self.three], self.bounds[:-1], axis=0)
        for f in self.affixes:
            out += table[f]
        return out

    def gradient(self, per_word: np.ndarray) -> np.ndarray:
        word = np.repeat(np.arange(len(per_word)), np.diff(self.bounds))
        places = np.concatenate([self.two, self.three, *self.affixes])
        owners = np.concatenate([word, word, *[np.arange(len(per_word))] * len(self.affixes)])
        rows = (1 << TABLE_BITS) + 1
        return np.stack([np.bincount(places, per_word[owners, k], rows) for k in range(per_word.shape[1])], axis=1)


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the summed probabilities of neighbouring label pairs if asked for.

    Chain k has the rows first[k] to first[k + 1] of `scores`. All chains advance together, longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    n, labels = scores.shape
    local = np.exp(scores - scores.max(1, keepdims=True)) if n else scores
    step = np.exp(moves - moves.max())
    forward, out, both = np.empty((n, labels)), np.empty((n, labels)), np.zeros((labels, labels))
    if not len(size):
        return out, both
    # chains with more than t words
    active = np.searchsorted(-size, -np.arange(size[0]), "left")
    state = None
    for t, a in enumerate(active.tolist()):
        at = begin[:a] + t
        state = local[at] if state is None else (state[:a] @ step) * local[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    back = np.ones((0, labels))
    for t in range(len(active) - 1, -1, -1):
        a = int(active[t])
        at = begin[:a] + t
        grown = np.ones((a, labels))
        if len(back):
            ahead = back * local[at[: len(back)] + 1]
            if pairs:
                here = forward[at[: len(back)]]
                both += step * (here.T @ (ahead / ((here @ step) * ahead).sum(1, keepdims=True)))
            moved = ahead @ step.T
            grown[: len(back)] = moved / moved.sum(1, keepdims=True)
        back = grown
        seen = forward[at] * back
        out[at] = seen / seen.sum(1, keepdims=True)
    return out, both


class Tagger:
    """A fitted model: languages, feature table, lexicons and transition scores."""

    def __init__(self, languages: list[str], table: np.ndarray, lexicons: list[np.ndarray], lexicon_weights: np.ndarray, moves: np.ndarray):
        self.languages, self.table, self.lexicons, self.lexicon_weights, self.moves = languages, table, lexicons, lexicon_weights, moves

    def in_lexicons(self, hashes: np.ndarray) -> np.ndarray:
        return np.stack([_member(hashes, x) for x in self.lexicons], axis=1).astype(np.float64)

    def scores(self, found: WordFeatures, hashes: np.ndarray) -> np.ndarray:
        raw = found.scores(self.table) + self.in_lexicons(hashes) @ self.lexicon_weights
        return np.clip(raw, -CLIP, CLIP)

    def word_probabilities(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Probabilities of each language for each word of a stretch of texts."""
        distinct, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        found = WordFeatures(data, words.starts[at], words.ends[at])
        return forward_backward(self.scores(found, distinct)[back], words.first, self.moves)[0]

    def predict(self, col: pa.Array, certainty: bool = False) -> tuple[list[str], np.ndarray]:
        """Each text's language with its mean probability over the words, or with the mean of each word's greatest one."""
        langs, scores = [], np.zeros(len(col))
        for i, j, raw, offs in text_slices(col):
            data = lowered(raw)
            words = find_words(data, offs, WORDS_ONLY)
            count = np.diff(words.first)
            if self.languages and len(words.hashes):
                odds = self.word_probabilities(data, words)
                mean = per_document(odds, words.first) / np.maximum(count, 1)[:, None]
                best = mean.argmax(1)
                sure = per_document(odds.max(1), words.first) / np.maximum(count, 1) if certainty else mean[np.arange(j - i), best]
                lang, score = [self.languages[b] for b in best], np.clip(sure, 0, 1)
            else:
                lang, score = [UNKNOWN] * (j - i), np.zeros(j - i)
            # bytes beyond ASCII need not be letters
            for k in range(j - i):
                if count[k] == 0 or (lang[k] != UNKNOWN and not _LETTER.search(col[i + k].as_py())):
                    lang[k], score[k] = UNKNOWN, 0.0
            langs += lang
            scores[i:j] = score
        return langs, scores


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def learn_lexicons(hashes: np.ndarray, label: np.ndarray, languages: int) -> list[np.ndarray]:
    """For each language the sorted hashes of its most frequent words that are mostly its own."""
    distinct, back = np.unique(hashes, return_inverse=True)
    counts = np.stack([np.bincount(back[label == k], minlength=len(distinct)) for k in range(languages)], axis=1)
    rate = counts / np.maximum(1, counts.sum(0))
    out = []
    for k in range(languages):
        own = (counts[:, k] >= LEXICON_COUNT) & (rate[:, k] > 0.6 * rate.sum(1))
        place = np.flatnonzero(own)
        out.append(np.sort(distinct[place[np.argsort(-counts[place, k], kind="stable")[:LEXICON_SIZE]]]))
    return out


def fit_tagger(ids: list, texts: list[str], labels: list[str]) -> bytes:
    """Fit by adaptive gradient steps on the chains' conditional likelihood; the model pickled."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(2)
    size = len(languages)
    table, lex = np.zeros(((1 << TABLE_BITS) + 1, size)), np.zeros((size, size))
    model = Tagger(languages, table, [np.empty(0, np.uint64)] * size, lex, np.zeros((size, size)))
    if not texts:
        return pickle.dumps(model)
    raw = [t.encode() for t in texts]
    data = lowered(np.frombuffer(b"".join(raw), np.uint8))
    words = find_words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]), WORDS_ONLY)
    label = np.repeat([languages.index(x) for x in labels], np.diff(words.first))
    model.lexicons = learn_lexicons(words.hashes, label, size)
    # windows that cover every word, chained at random
    cuts = np.unique(np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(words.first[:-1], words.first[1:], strict=True)] + [[len(label)]]).astype(int))
    windows = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    squares = [np.full_like(x, 1e-6) for x in (table, lex, model.moves)]
    for _ in range(PASSES):
        mix = rng.permutation(len(windows))
        for i in range(0, len(mix), CHAIN * CHAINS_PER_STEP):
            part = [windows[k] for k in mix[i : i + CHAIN * CHAINS_PER_STEP]]
            at = np.concatenate(part)
            ends = np.concatenate([[0], np.cumsum([len(w) for w in part])])
            chains = np.unique(np.append(ends[::CHAIN], ends[-1]))
            distinct, seen, back = np.unique(words.hashes[at], return_index=True, return_inverse=True)
            found = WordFeatures(data, words.starts[at[seen]], words.ends[at[seen]])
            inside = model.in_lexicons(distinct)
            odds, pairs = forward_backward(model.scores(found, distinct)[back], chains, model.moves, pairs=True)
            gap = -odds
            gap[np.arange(len(at)), label[at]] += 1
            per_word = np.stack([np.bincount(back, gap[:, k], len(distinct)) for k in range(size)], axis=1)
            true = np.zeros((size, size))
            follow = np.setdiff1d(np.arange(1, len(at)), chains)
            np.add.at(true, (label[at[follow - 1]], label[at[follow]]), 1)
            grads = (found.gradient(per_word), inside.T @ per_word, true - pairs)
            for weight, square, grad in zip((table, lex, model.moves), squares, grads, strict=True):
                grad = grad / len(at) * 100 - DECAY * weight
                square += grad * grad
                weight += RATE * grad / np.sqrt(square)
            table[-1] = 0
    model.table = table.astype(np.float32)
    return pickle.dumps(model)


def fit_language(docs: DataFrame, per_label: int = PER_LABEL, max_docs: int = MAX_DOCS) -> bytes:
    """A model from documents with a language outside the held-out fold."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (learning.fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    slim = usable.select("doc_id", F.col("lang").alias("label"), F.xxhash64("doc_id").alias("order"))
    nth = F.row_number().over(W.partitionBy("label").orderBy("order", "doc_id"))
    few = slim.withColumn("nth", nth).filter(F.col("nth") <= per_label)
    picks = few.orderBy("nth", "order", "doc_id").limit(max_docs).select("doc_id", "label")
    return learning.fit_once(learning.sample_texts(docs, picks), fit_tagger)


def predict_language(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = pickle.loads(shared.value)
        for b in batches:
            lang, score = tagger.predict(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    # an id that is null is never learned from
    held = F.coalesce(learning.fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def label_words(text: str, model: bytes) -> list[tuple[str, str]]:
    """Each word of a text with its most probable language."""
    tagger = pickle.loads(model)
    raw = np.frombuffer(text.encode(), np.uint8)
    data = lowered(raw)
    words = find_words(data, np.array([0, len(raw)]), WORDS_ONLY)
    if not len(words.hashes) or not tagger.languages:
        return []
    best = tagger.word_probabilities(data, words).argmax(1)
    return [(bytes(raw[a:b]).decode(), tagger.languages[k]) for a, b, k in zip(words.starts, words.ends, best, strict=True)]


def keep_known(docs: DataFrame, model: bytes, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """The rows of `docs` whose words are in learned languages, one or several in turn; others, `und` among them, go.

    What counts is how sure the words' own labels are, not how much of a text one language holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def mask(col: pa.Array) -> pa.Array:
        lang, sure = pickle.loads(shared.value).predict(col, certainty=True)
        return pa.array([x != UNKNOWN and s >= min_certainty for x, s in zip(lang, sure, strict=True)], pa.bool_())

    return learning.keep_where(docs, mask)
