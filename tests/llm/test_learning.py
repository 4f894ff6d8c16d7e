"""The two classifiers: parts against plain loops, whole models against held-out rows."""

import pickle
import zlib

import numpy as np
import pyarrow as pa
from helpers import HARD, SF, hard_docs

from poolscope.llm import language, quality, text


def test_words_equal_a_plain_split():
    import re

    docs = ["the cat, the CAT!!", "", None, "été  ☃x 12 a", "a" * 100, "b"]
    for _, _, data, offs in text.text_slices(pa.array(docs)):
        found = text.find_words(data, offs, text.WORDS_AND_SYMBOLS)
        got = [bytes(data[a:b]) for a, b in zip(found.starts, found.ends, strict=True)]
        want = [re.findall(rb"[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff\s]+", (d or "").encode()) for d in docs]
        assert got == [w for ws in want for w in ws]
        assert np.diff(found.first).tolist() == [len(w) for w in want]
        by_word = {}
        for w, h in zip(got, found.hashes.tolist(), strict=True):
            assert by_word.setdefault(w, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_all_rows(monkeypatch):
    monkeypatch.setattr(text, "SLICE_BYTES", 10)
    col = pa.array(["aaaa", None, "b" * 25, "", "cc", "dddd dddd"]).slice(1)
    parts = [(i, j, bytes(d)) for i, j, d, _ in text.text_slices(col)]
    assert [p[:2] for p in parts][0][0] == 0 and parts[-1][1] == 5
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert b"".join(p[2] for p in parts) == b"b" * 25 + b"ccdddd dddd"


def plain_forward_backward(scores, moves):
    """All label sequences of a short chain, one by one."""
    from itertools import product

    n, size = scores.shape
    out, pairs, total = np.zeros((n, size)), np.zeros((size, size)), 0.0
    for seq in product(range(size), repeat=n):
        w = np.exp(sum(scores[i, s] for i, s in enumerate(seq)) + sum(moves[a, b] for a, b in zip(seq, seq[1:], strict=False)))
        total += w
        for i, s in enumerate(seq):
            out[i, s] += w
        for a, b in zip(seq, seq[1:], strict=False):
            pairs[a, b] += w
    return out / total, pairs / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 1, 5, 4]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores, moves = rng.normal(size=(first[-1], 3)) * 2, rng.normal(size=(3, 3))
    got, pairs = language.forward_backward(scores, first, moves, pairs=True)
    want = [plain_forward_backward(scores[a:b], moves) for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
    assert np.allclose(got, np.concatenate([w for w, _ in want]))
    assert np.allclose(pairs, sum(p for _, p in want))


def held_out(spark, got, truth, folds, fold):
    rows = {r.doc_id: r for r in got.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows.values())
    assert all(0 <= r.score <= 1 for r in rows.values())
    return [(rows[k], v) for k, v in truth.items() if rows[k].held_out]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit_language(docs)
    truth = {r.doc_id: r.lang for r in docs.filter("lang is not null and length(text) > 40").collect()}
    pairs = held_out(spark, language.predict_language(docs, model), truth, 4, 2)
    assert len(pairs) > 100 and np.mean([r.lang_pred == v for r, v in pairs]) > 0.97


def test_code_switched_words(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit_language(docs)
    plain = {r.lang: r.text for r in docs.filter("length(text) between 400 and 900 and text not like '%#%' and text not like '%|%'").orderBy("doc_id").collect()}
    en, de = plain["en"][:200], plain["de"][:200]
    labels = [lang for _, lang in language.label_words(f"{en} {de} {en}", model)]
    n = len(language.label_words(en, model))
    assert np.mean([x == "en" for x in labels[:n]]) > 0.8 and np.mean([x == "en" for x in labels[-n:]]) > 0.8
    assert np.mean([x == "de" for x in labels[n : len(labels) - n]]) > 0.8


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = held_out(spark, quality.score_quality(docs, model), truth, 3, 1)
    assert len(pairs) > 80 and np.mean([r.predicted == v for r, v in pairs]) > 0.93


def test_score_is_the_sparse_dot_product():
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    docs = ["one two two, three", "", None, "x"]
    got = quality.score_texts(pa.array(docs), weights)
    for doc, score in zip(docs, got, strict=True):
        total, n = 0.0, 0
        for _, _, data, offs in text.text_slices(pa.array([doc])):
            single, pair, _ = quality.features(data, offs)
            feats = [*single.tolist(), *pair.tolist()]
            total, n = sum(weights[f] for f in feats if f), len(feats)
        assert np.isclose(score, 1 / (1 + np.exp(-(weights[-1] + total / np.sqrt(max(1, n))))))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    model = language.fit_language(docs)
    got = language.predict_language(docs, model).collect()
    assert len(got) == len(HARD)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {2, 3, 8, None} and all(r.held_out for r in got if r.doc_id is None)
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (999, 1), (None, 0), (4, None), (9, 7)], "doc_id bigint, quality int")
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(scored) == len(HARD) and all(r.predicted == int(r.score >= 0.5) for r in scored)
    assert len({r.score for r in scored if r.doc_id in (2, 3)}) == 1
    # nothing to learn from
    empty = hard_docs(spark, [])
    assert {r.lang_pred for r in language.predict_language(docs, language.fit_language(empty)).collect()} == {"und"}
    assert {r.score for r in quality.score_quality(docs, quality.fit_quality(empty, labels)).collect()} == {0.5}
    assert language.predict_language(empty, model).count() == 0
    assert language.keep_known(docs, model).columns == docs.columns


def test_held_out_texts_do_not_change_the_model(spark):
    rows = [(i, f"word{i % 7} and more {i}", "en" if i % 2 else "de", "a") for i in range(60)]
    other = [(i, "entirely different" if zlib.crc32(str(i).encode()) % 4 == 2 else t, lang, s) for i, t, lang, s in rows]
    a, b = (pickle.loads(language.fit_language(hard_docs(spark, r))) for r in (rows, other))
    assert rows != other and np.array_equal(a.table, b.table) and np.array_equal(a.moves, b.moves)
