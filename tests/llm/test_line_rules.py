"""Line-first rules against a plain version, with hashes that clash, and what cleaning keeps."""

import re
from collections import Counter

from helpers import HARD, hard_docs
from pyspark.sql import functions as F

from poolscope.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(line):
    n, small = len(WORD.findall(line)), "".join(c.lower() if c in line_rules.UPPER else c for c in line)
    return (
        WORD.findall(line)[-1][-1] not in line_rules.CLOSING
        or 10 * len(re.findall(line_rules.SYMBOL, line)) > n
        or 10 * len(re.findall(line_rules.SHOUT, line)) > n
        or 4 * len(re.findall(line_rules.SEPARATOR, line)) > n
        or n <= 20 and bool(re.search(line_rules.NAVIGATION.replace(r"\z", r"\Z"), small) or re.search(line_rules.BOILERPLATE, small))
    )


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    good = [x for x in dict.fromkeys(lines) if not plain_fails(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    kept = not failed and 100 * (sum(map(len, lines)) - sum(map(len, good))) <= 30 * sum(map(len, lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, kept, "\n".join(good)


PROSE = "Fox{0} went over{0} hill{0} and saw{0} river{1} far{0} below it{1}."
PAGE = "\n".join(PROSE.format(i, i * 7) for i in range(9))
TEXTS = [
    PAGE,
    PAGE + "\nHome | About | Contact\nAll rights reserved.\nhome menu\n\n" + PROSE.format(0, 0),
    "\n".join(f"Home | Menu {i} | Login | Search | Help | Contact" for i in range(40)),
    PAGE.replace(".", ""),
    PAGE.replace(" ", "$$$ "),
    PAGE.replace(" ", "!! ").upper(),
    PAGE + "\n" + "no full stop at all " * 12,
    "a b c " * 40,
    "a b c a b c d\na \n\x1c x\rhome\r\nHome",
    "x y z . x y z w " + " ".join(f"v{i}." for i in range(60)),
    "the same line again.\n" * 30 + PAGE,
    "☃ é   \u0085 .",
]


def rows_of(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    return Counter((r["row"]["doc_id"], *[r[n] for n in names]) for r in df.collect())


def test_judge_against_plain(spark):
    rows = [*HARD, *[(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)]]
    want = Counter((r[0], *plain(r[1])) for r in rows)
    docs = hard_docs(spark, rows)
    assert rows_of(line_rules.judge(docs)) == want
    # a hash of two values mixes up windows; counts stay exact
    assert rows_of(line_rules.judge(docs, hashed=lambda *w: F.pmod(F.xxhash64(*w), F.lit(2)))) == want


def test_cleaned_documents(spark):
    docs = hard_docs(spark, [(i, t, "en", "a") for i, t in enumerate(TEXTS)])
    got = line_rules.clean_documents(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[0] == PAGE and "rights" not in kept[1] and "Home" not in kept[1] and set(kept) >= {0, 1}
    assert not {2, 3, 4, 5, 7} & set(kept)
    assert line_rules.clean_documents(docs.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = line_rules.rule_digest(hard_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
