"""Token ids of whole texts, with a bounded cache of the pieces that a tokenizer can't merge across.

Both tokenizers split a text before merging and never merge over a split. The pieces between safe
splits repeat, so each worker encodes a piece once with the tokenizers library and looks it up
afterwards. Results equal encoding the whole text. The content of an added token in a text is plain text,
or with `added` the token's own id, as the library has it by default; such texts are encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from poolscope.llm.shared import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_PIECES = 900_000
CACHE_CHARS = 48
SLICE_BYTES = 8 << 20  # texts whose pieces are made distinct together
CALL = 8192  # pieces that are encoded together
GATHER = 256
_TWO_SPACES = re.compile(r"\s\s")
# a full stop or comma next to another symbol may belong to a run of symbols, which is one piece
_IN_SYMBOLS = re.compile(r"[.,](?:(?=[^\s\w]|_)|(?<=[^\s\w].)|(?<=_.))")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A text column in stretches of at most `most` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield column.slice(i, j - i)
        i = j


class PieceEncoder:
    """Encodes texts to the bytes of their ids: little-endian, two bytes if the vocabulary allows, else four."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict = {}

    def ids_of(self, texts: list[str], plain: bool = True) -> list[bytes]:
        # pieces are plain: a piece in lower case may look like a token that the text does not hold
        self.tokenizer.encode_special_tokens = plain
        out = []
        for i in range(0, len(texts), CALL):  # the library's own results are many times the ids
            found = self.tokenizer.encode_batch_fast(texts[i : i + CALL], add_special_tokens=False)
            out += [array(self.code, e.ids).tobytes() for e in found]
        return out

    def fit(self, text: str) -> str | None:
        """The text with a cut wherever `split` finds one; None if it must be encoded as a whole."""
        raise NotImplementedError

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Cache keys of the texts' pieces in order."""
        raise NotImplementedError

    def text_of(self, key) -> str:
        raise NotImplementedError

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; a null text has none. Once full, the cache stays as it is."""
        out: list = [b""] * len(texts)
        at, cut = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            marked = any(m in t for m in self.marks)
            ready = None if marked else self.fit(t)
            if ready is None:
                out[i] = self.ids_of([t], plain=not marked)[0]
            else:
                at.append(i)
                cut.append(ready)
        if cut:
            pieces = self.split(pa.array(cut, pa.large_string()))
            cut.clear()
            give_back()
            for i, ids in zip(at, self._looked_up(pieces), strict=True):
                out[i] = ids
            del pieces
            give_back()
        return out

    def _looked_up(self, pieces: pa.ListArray) -> list[bytes]:
        """Ids of each list of pieces: every different piece is looked up once, the rest is gathered by arrays."""
        flat = pieces.flatten().dictionary_encode()
        keys, codes, known = flat.dictionary.to_pylist(), flat.indices.to_numpy(), self.known
        new = [k for k in keys if k not in known]
        known.update(zip(new, self.ids_of([self.text_of(k) for k in new]), strict=True))
        found = [known[k] for k in keys]
        width = self.dtype.itemsize
        size = np.fromiter(map(len, found), np.int64, len(found)) // width
        ids, begin = np.frombuffer(b"".join(found), self.dtype), np.cumsum(size) - size
        bounds, out = pieces.offsets.to_numpy() - pieces.offsets[0].as_py(), []
        for i in range(0, len(pieces), GATHER):
            own = bounds[i : i + GATHER + 1]
            part = codes[own[0] : own[-1]]
            run = np.concatenate([[0], np.cumsum(size[part])])
            gathered = ids[np.repeat(begin[part] - run[:-1], size[part]) + np.arange(run[-1])].tobytes()
            ends = (run[own - own[0]] * width).tolist()
            out += [gathered[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        room = CACHE_PIECES - len(known) + len(new)
        for i, k in enumerate(new):
            if i >= room or len(k) > CACHE_CHARS:
                del known[k]
        return out


class ByteLevelEncoder(PieceEncoder):
    """Byte-level BPE, where a space belongs to the word behind it.

    A split before a single space or line end between two other characters is always safe. Texts with
    runs of white space, or with white space at an end, are encoded as a whole. A zero byte marks the
    first piece, which has no space in front.
    """

    def fit(self, text: str) -> str | None:
        if text[0].isspace() or text[-1].isspace() or "\0" in text or _TWO_SPACES.search(text):
            return None
        return "\0" + text.replace("\n", " \n")

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def text_of(self, key: str) -> str:
        if key[0] == "\0":
            return key[1:]
        return key if key[0] == "\n" else " " + key


class WordEncoder(PieceEncoder):
    """BPE over lower-cased words, where white space separates and is dropped, and so do full stops and commas alone."""

    def fit(self, text: str) -> str:
        if not _IN_SYMBOLS.search(text):
            text = text.replace(",", " , ").replace(".", " . ")
        return text

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(pc.ascii_lower(texts))

    def text_of(self, key: str) -> str:
        return key


_ENCODERS: dict = {}


def encoder(kind: type[PieceEncoder], path: str, added: bool = False) -> PieceEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    if (kind, path, added) not in _ENCODERS:
        _ENCODERS[kind, path, added] = kind(path, added)
    return _ENCODERS[kind, path, added]
