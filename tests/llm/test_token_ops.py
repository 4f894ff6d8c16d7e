"""Token files and packing against encoding whole texts."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import HARD, hard_docs
from tokenizers import Tokenizer

from poolscope.llm import packing, token_files, tokens


def whole(path, text, end):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.read_token_files(token_files.write_token_files(hard_docs(spark), path, 2)).collect()
    want = Counter((r[0], zlib.crc32(ids.tobytes()), len(ids)) for r in HARD for ids in [whole(path, r[1], 2)])
    assert Counter((r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    names = [r.doc_id for r in got]
    assert names[:2] == [None, None] and names[2:] == sorted(names[2:])


def test_token_files_of_nothing(spark):
    manifest = token_files.write_token_files(hard_docs(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_token_files(manifest).count() == 0


@pytest.mark.parametrize("kind,name", [(tokens.ByteLevelEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_pieces_equal_whole_texts(kind, name):
    path = public_tokenizers.path(name)
    enc = kind(path)
    texts = ["", " a", "a ", "a  b", "x.\nThe end's 've\n", "a b  c", "tab\tand\r\nline", "ÀÉ ß İI ǅ", "é ́x", "a\x1cb c\x1f d", "日本語 テキスト", "don't we're I'll", "\n\n \n x", ".", ", a", "a,b 3.14,x", "a., b", "of.&&& x,— y", "_., a_.b", "The END. The end,\nThe end.", "a\0.b", "x.\ny,\nz"]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, enc.dtype).tolist() == whole(path, text, 0)[:-1].tolist(), text


def check_pieces(rows, want):
    """Pieces cover each document once, and each sequence without a gap."""
    assert sum(r.length for r in rows) == sum(len(w) for w in want)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, parts in by_seq.items():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        if s < len(by_seq) - 1:
            assert sum(p.length for p in parts) == packing.LENGTH
    joined, current = [], []
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert r.start == sum(len(x) for x in current) // 4
        current.append(bytes(r.ids))
        if r.start + r.length == r.doc_tokens:
            joined.append((r.doc_id, b"".join(current)))
            current = []
    return Counter(joined)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(hard_docs(spark), path, 1)
    want = [whole(path, r[1], 1) for r in HARD]
    assert check_pieces(pieces.collect(), want) == Counter((r[0], w.tobytes()) for r, w in zip(HARD, want, strict=True))
    seqs = packing.sequences(pieces).collect()
    assert sum(len(s.ids) for s in seqs) == 4 * sum(map(len, want))
    assert packing.pack(hard_docs(spark, []), path, 1).count() == 0


def test_hilbert_key_walks_neighbours():
    """Along the whole curve through a small cube each step changes one coordinate by one."""
    side = np.arange(8)
    grid = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_similar_documents_lie_close(spark):
    topics = ["red green blue yellow", "one two three four", "cat dog cow horse", "sun moon star sky"]
    rows = [(i, " ".join([topics[i % 4]] * (20 + i // 4)), "en", "a") for i in range(80)]
    encoded = packing.encode_documents(hard_docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), 1)
    order = [r.doc_id % 4 for r in encoded.orderBy("curve", "tie").collect()]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) < 20
