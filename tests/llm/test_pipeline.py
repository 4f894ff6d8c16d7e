"""The stages one after another, each against a plain version on what the stage before kept."""

import pickle
from collections import Counter

import numpy as np
import public_tokenizers
from helpers import SF, hard_docs
from test_near_copies import plain_groups
from test_token_ops import check_pieces, whole

import __spark_entry__ as entry
import corpus_pipeline
from poolscope.llm import language, mixing, quality
from poolscope.llm.shared import written


def sure_of_their_words(rows, model):
    """Ids of the texts whose words are labelled with a certainty of at least one half on average."""
    tagger, out = pickle.loads(model), set()
    for r in rows:
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        words = language.find_words(language.lowered(raw), np.array([0, len(raw)]), language.WORDS_ONLY)
        sure = [p.max() for p in tagger.word_probabilities(language.lowered(raw), words)] if len(words.hashes) else []
        if sure and np.mean(sure) >= language.MIN_CERTAINTY:
            out.add(r.doc_id)
    return out


def test_texts_in_three_languages_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_language(docs)
    parts = {}
    for r in docs.filter("n_chars BETWEEN 600 AND 4000").orderBy("doc_id").collect():
        parts.setdefault(r.lang, []).append(r.text[:500])
    langs = sorted(parts)[:3]
    mixed = [(i, " ".join(parts[x][i] for x in langs), None, "a") for i in range(5)]
    rows = [*mixed, (90, "12345 !!! ###", None, "a"), (91, None, None, "a"), (92, "", None, "a")]
    assert {r.doc_id for r in language.keep_known(hard_docs(spark, rows), model).collect()} == set(range(5))
    scores = language.predict_language(hard_docs(spark, mixed), model).collect()
    assert all(r.score < 0.5 for r in scores)  # no language holds half of such a text


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = written(stage["quality"](spark, docs, SF), "t")
    scores = quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.filter("predicted = 1").collect()}
    known = written(stage["language"](spark, good, SF), "t")
    assert {r.doc_id for r in known.collect()} == sure_of_their_words(good.collect(), language.fit_language(good))
    distinct = written(stage["near_duplicates"](spark, known, SF), "t")
    rows = known.collect()
    firsts = set(plain_groups([(r.doc_id, r.text) for r in rows]))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in distinct.collect()) == Counter(firsts)
    mixed = written(stage["mixing"](spark, distinct, SF), "t")
    counts = {r.doc_id: r.copies for r in mixing.mix_counts(mixing.mix_plan(distinct)).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == counts
    assert all(d.columns == docs.columns for d in (good, known, distinct, mixed))
    packed = stage["packing"](spark, mixed, SF).collect()
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [(r.doc_id, whole(path, r.text, 1)) for r in mixed.collect()]
    assert check_pieces(packed, [w for _, w in want]) == Counter((d, w.tobytes()) for d, w in want)


def test_stages_on_hard_and_empty_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (None, []):
        docs = hard_docs(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, str(tmp_path)), "t")
            assert docs.columns == columns or name == "packing"
        assert rows is None or docs.count() == 0


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and np.all([n in entry.queries() for n in entry.oracle_sql()])
