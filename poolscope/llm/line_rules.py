r"""Line-first quality rules, in DataFrame functions only.

Every line that has a word is judged by itself; a line fails if one of these rules says so:

* punctuation: it doesn't end in a closing mark, or more than one in ten of its words comes with a symbol of
  `[#*$%&|<>]`, or with two or more of `!` and `?` in a row;
* navigation: separators `|`, guillemets, bullets or middle dots cut it into items of fewer than four words, or, in
  a line of at most twenty words, there are none but navigation words;
* boilerplate: a line of at most twenty words has a phrase of notices and site furniture, or any line equals an
  earlier one of the same text.

Failed lines go; a document that so loses more than `max_lost` percent of the characters in its lines is rejected.
Before that, documents fail that have too few words, or too many words in three-word windows found twice or more.

Repeated windows are found inside a row: each window is one long, the low bits its place and the rest its hash.
After sorting, equal windows are neighbours. Neighbours are compared word by word; if a hash ever joined two
different windows, the row is counted again on the windows themselves. So a text needs no shuffle and counts are exact.

Defined cases: a null text is empty; an empty text has no words and fails; repeated rows and null ids are
ordinary rows; empty input gives no rows; further columns are kept by `clean_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import whole_row, written

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words
MAX_LOST = 30  # percent of the characters of lines with a word
NOTICE_WORDS = 20
SYMBOL = "[#*$%&|<>]"
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]")
SEPARATOR = "[|»›·•]"
SHOUT = "[!?]{2,}"
#: A line of navigation words alone, and phrases of notices; lines are lower-cased (A-Z) first.
NAVIGATION = (
    r"^(home|menu|next|previous|back|top|search|login|log in|sign in|sign up|register|share|tweet|print|sitemap"
    r"|contact|contact us|about|about us|faq|help|read more|skip to content|[|»›·•>/,.:\x20\x09-\x0D])+\z"
)
BOILERPLATE = (
    "all rights reserved|privacy policy|cookie policy|cookie settings|we use cookies|accept cookies|terms of use"
    "|terms of service|subscribe to our|subscribe to the|sign up for|click here|enable javascript|javascript is"
    "|lorem ipsum|powered by|follow us on|share this|copyright ©|copyright [(]c[)]|licensed under|released under the"
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Hash = Callable[..., Column]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("long")


def line_fails(line: Column, words: Column) -> Column:
    """Whether one line with words (their array) breaks a rule; see the module."""
    n = F.size(words)
    small = F.translate(line, UPPER, LOWER)
    return (
        ~F.substring(F.element_at(words, -1), -1, 1).isin(*CLOSING)
        | (symbols(line) * 10 > n)
        | (F.regexp_count(line, F.lit(SHOUT)) * 10 > n)
        | (F.regexp_count(line, F.lit(SEPARATOR)) * 4 > n)
        | ((n <= NOTICE_WORDS) & (small.rlike(NAVIGATION) | small.rlike(BOILERPLATE)))
    )


def _neighbours(sorted_items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Items of a sorted array that are the same as the one before or behind."""

    def repeated(x: Column, j: Column) -> Column:
        before, behind = F.get(sorted_items, j - 1), F.get(sorted_items, j + 1)
        return F.coalesce(same(before, x), F.lit(False)) | F.coalesce(same(x, behind), F.lit(False))

    return F.filter(sorted_items, repeated)


def with_repeated_words(df: DataFrame, words: str, out: str, hashed: Hash = F.xxhash64) -> DataFrame:
    """Add `out`, the number of words of array column `words` that lie in a three-word window found twice or more."""
    w, bits, items, dup, places = F.col(words), F.col("_bits"), F.col("_items"), F.col("_dup"), F.col("_places")
    windows = F.size(w) - 2
    df = df.withColumn("_bits", F.length(F.bin(F.greatest(windows, F.lit(1)).cast("long"))))
    low = F.expr("shiftleft(1L, _bits) - 1")
    at = lambda i: [F.get(w, i + k) for k in range(3)]
    shifted = lambda x: F.call_function("shiftright", x, bits)
    starts = F.sequence(F.lit(0), windows - 1)
    packed = F.transform(starts, lambda i: F.call_function("shiftleft", hashed(*at(i)), bits).bitwiseOR(i.cast("long")))
    df = df.withColumn("_items", F.when(windows > 0, F.sort_array(packed)))
    df = df.withColumn("_dup", _neighbours(items, lambda a, b: shifted(a) == shifted(b)))
    place = lambda x: x.bitwiseAND(low).cast("int")

    def mixed_up(x: Column, j: Column) -> Column:
        before = F.get(dup, j - 1)
        differ = F.lit(False)
        for a, b in zip(at(place(before)), at(place(x)), strict=True):
            differ = differ | (a != b)
        return F.coalesce((shifted(before) == shifted(x)) & differ, F.lit(False))

    clashes = F.size(F.filter(dup, mixed_up)) > 0
    whole = F.sort_array(F.transform(starts, lambda i: F.struct(*[x.alias(f"w{k}") for k, x in enumerate(at(i))], i.alias("i"))))
    df = df.withColumn("_whole", F.when(clashes, whole))
    same = lambda a, b: (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])
    exact = F.transform(_neighbours(F.col("_whole"), same), lambda x: x["i"])
    df = df.withColumn("_places", F.sort_array(F.when(F.col("_whole").isNotNull(), exact).otherwise(F.transform(dup, place))))
    covered = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0).cast("long"))).drop("_bits", "_items", "_dup", "_whole", "_places")


def judge(
    docs: DataFrame, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_lost: int = MAX_LOST, hashed: Hash = F.xxhash64
) -> DataFrame:
    """One row per document: `row` (all its columns), `cleaned` (its lines that passed, with a word each), the counts
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, kept_chars, and the verdicts base_failed and kept."""
    df = docs.select(whole_row(docs).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("_text"))
    cut = F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("line"), split_words(x).alias("words")))
    df = df.select("row", symbols(F.col("_text")).alias("n_symbols"), F.filter(cut, lambda x: F.size(x["words"]) > 0).alias("_lines"))
    good = F.filter("_lines", lambda x: ~line_fails(x["line"], x["words"]))
    df = df.select(
        "row", "n_symbols",
        F.flatten("_lines.words").alias("_words"),
        F.array_distinct(good["line"]).alias("_good"),
        F.col("_lines.line").alias("_lines"),
    )
    length = lambda items: F.length(F.array_join(items, "")).cast("long")
    df = df.select(
        "row", "n_symbols", "_words",
        F.size("_words").cast("long").alias("n_words"),
        length("_words").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        length("_lines").alias("line_chars"),
        length("_good").alias("kept_chars"),
        F.array_join("_good", "\n").alias("cleaned"),
    )
    df = with_repeated_words(df, "_words", "n_repeat_words", hashed).drop("_words")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)
    lost = (F.col("line_chars") - F.col("kept_chars")) * 100 > F.col("line_chars") * max_lost
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~lost)


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their columns; `text` has the lines that passed."""
    # written first: a filter on the verdict would be pushed down with a copy of everything that it is made of
    kept = written(judge(docs, **options), "judged").filter("kept")
    return kept.select(*[F.col("cleaned" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def rule_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts and verdicts per document."""
    slim = docs.select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "kept_chars"]
    return judge(slim, **options).select("row.doc_id", *names)
