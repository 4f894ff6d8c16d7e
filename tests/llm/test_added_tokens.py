"""Texts that hold the content of an added token, against the library's own call."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, hard_docs
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from poolscope.llm import tokens

TEXTS = ["one two <|endoftext|> three", "<|startoftext|>A, b.<|endoftext|>", "x<|ENDOFTEXT|> y <|EndOfText|>", "plain words.", "<|endoftext|", " a  <|endoftext|>\n"]
FILES = {"op1_token_files": ("byte_bpe_50k.json", 2), "op8_pack_curve": ("word_bpe_49k.json", 1)}


def library(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind,name", [(tokens.ByteLevelEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_encoder(kind, name):
    enc = kind(public_tokenizers.path(name), added=True)
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(TEXTS, enc.encode(TEXTS), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == library(name, text), text


def test_queries_and_pipeline(spark, tmp_path):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    docs = hard_docs(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for query, (name, end) in FILES.items():
        want = {i: zlib.crc32(np.array([*library(name, t), end], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
        assert {r.doc_id: r.ids_crc32 for r in entry.queries()[query](spark, str(tmp_path)).collect()} == want, query
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.pack(spark, docs, SF).collect()} == want
