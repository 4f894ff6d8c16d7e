"""Small tables with everything that an operator must stand: nulls, empty, long and repeated rows, clashing names."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
CLASHES = "score double, part int, key string, fp bigint, shard int, taken long, rank int, _row string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"

LONG = "the long road of words, and then some more of it. " * 4000
HARD = [
    (1, "the cat sat on the mat", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, LONG, "en", "a"),
    (5, "  two  spaces\n\nand\tlines \n", "en", None),
    (6, "the cat sat on the mat", "en", "a"),
    (7, "Éléphant çà et là — déjà vu ☃ <|endoftext|> </s>", "fr", "b"),
    (7, "Éléphant çà et là — déjà vu ☃ <|endoftext|> </s>", "fr", "b"),
    (None, "no id at all", "en", "c"),
    (None, None, None, None),
    (8, "12345 !!! ###", "en", "b"),
    (9, "a", "en", "c"),
    (-3, "negative", "de", "a"),
]


def hard_docs(spark, rows=None):
    rows = HARD if rows is None else rows
    filled = [(*r, len(r[1] or ""), 0.5, 1, "k", 2, 3, 4, 5, "r") for r in rows]
    return spark.createDataFrame(filled, DOCS)
