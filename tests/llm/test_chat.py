"""Chat formatting: every conversation reads back."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from poolscope.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, formatted string"
BITS = st.lists(st.sampled_from(["\\", "[INST]", "[/INST]", "</s>", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/INST", "a", " ", "é", "\n"]), max_size=9)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]\\", "assistant\\"]), BITS.map("".join)), max_size=6))
def test_turns_read_back(turns):
    s = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    at, got = 0, []
    while at < len(s):
        role, text, _, at = chat.parse_turn(s, at)
        got.append((role, text))
    assert got == turns


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a \\ b")[0] == "[INST]a \\ b[/INST]"
    assert chat.render_turn("assistant", "[INST] x")[0] == "\\[INST] x</s>"


def test_format_and_read_back(spark):
    rows = [
        (1, 1, "assistant", "ok \\"), (1, 0, "user", "hi"), (1, 2, None, None), (1, 2, None, None),
        (2, None, "system", "</s>"), (2, 0, "assistant", ""), (2, 1, "assistant", "x" * 5000),
        (None, 0, "user", "nobody's"), (3, 0, "user", None),
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], SCHEMA)
    formatted = chat.format_conversations(df, part_chars=40)
    assert formatted.filter("conv_id = 1").count() >= 1 and formatted.filter("conv_id = 2").count() > 1
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -9, x or "", y or "") for c, t, x, y in rows if c == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x}\n{y}\n" for _, x, y in own).encode()).hexdigest()
        loss = "".join(y for _, x, y in own if x == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    total = {r.conv_id: r.n for r in formatted.selectExpr("conv_id", "length(formatted) n").groupBy("conv_id").agg({"n": "sum"}).toDF("conv_id", "n").collect()}
    assert all(got[c].formatted_chars == n for c, n in total.items())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
