r"""Chat formatting with a template that reads back exactly.

A conversation is rendered turn by turn and every turn ends itself, so the text of a conversation is
the concatenation of its turns. The grammar, in which `name` is any role but the first three:

    conversation = turn*
    turn = "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "[ROLE]" name "[/ROLE]" text "</s>" | text "</s>"

The last form is the assistant's. In a text, a control string counts only with an even run of
backslashes in front of it; half the run stands for itself, and an odd run makes the string plain text.

Every turn is rendered as it is and reparsed. Where the parser doesn't give back the same role and
text, the conflicting content is escaped and reparsed again; the escaped form always reads back.

A long conversation never becomes one value: rows come sorted by turn and leave in parts of at most
`part_chars` characters (one turn at least), in order. Rows of a conversation reach the same task, but
one after another, in bounded memory.

Defined cases: null text and null role are empty strings; turns sort by turn (null first), role,
text; repeated rows are turns of their own; a null conv_id is a conversation of its own; empty input
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_CHARS = 1 << 20
FRAMES = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
NAMED = ("[ROLE]", "[/ROLE]", "</s>")
CONTROL = re.compile(r"(\\*)(\[/?SYS\]|\[/?INST\]|\[/?ROLE\]|</s>)")
TAIL = re.compile(r"(\\+)\Z")
FORMATTED = "conv_id bigint, part int, n_turns bigint, formatted string, loss_spans array<struct<begin:bigint,end:bigint>>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    """Double the backslashes in front of control strings and at the end, one more in front of each string."""
    text = CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return TAIL.sub(lambda m: m[1] * 2, text)


def read_text(s: str, at: int, closing: str) -> tuple[str, int, int] | None:
    """The text from `at` to the next live control string, which must be `closing`: (text, its end, behind the closing)."""
    out, last = [], at
    for m in CONTROL.finditer(s, at):
        slashes = len(m[1])
        out.append(s[last : m.start()] + "\\" * (slashes // 2))
        if slashes % 2 == 0:
            return ("".join(out), m.start(2), m.end()) if m[2] == closing else None
        out.append(m[2])
        last = m.end()
    return None


def parse_turn(s: str, at: int) -> tuple[str, str, tuple[int, int], int] | None:
    """(role, text, span of the text as rendered, where the next turn begins), or None if no turn begins at `at`."""
    if s.startswith(NAMED[0], at):
        head = read_text(s, at + len(NAMED[0]), NAMED[1])
        if head is None:
            return None
        role, begin, closing = head[0], head[2], NAMED[2]
        if role in FRAMES:
            return None
    else:
        role = next((r for r, (o, _) in FRAMES.items() if o and s.startswith(o, at)), "assistant")
        begin, closing = at + len(FRAMES[role][0]), FRAMES[role][1]
    body = read_text(s, begin, closing)
    return None if body is None else (role, body[0], (begin, body[1]), body[2])


def _frame(role: str, text: str, name: str) -> str:
    if role in FRAMES:
        opening, closing = FRAMES[role]
        return opening + text + closing
    return NAMED[0] + name + NAMED[1] + text + NAMED[2]


def render_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The rendered turn and the span of its text; content is escaped only where the plain form reads back differently."""
    for name, body in ((role, text), (escape(role), text), (escape(role), escape(text))):
        out = _frame(role, body, name)
        found = parse_turn(out, 0)
        if found is not None and found[:2] == (role, text) and found[3] == len(out):
            return out, found[2]
    raise AssertionError("an escaped turn reads back")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    slim = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")
    )
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rendered conversations: one row per part, with the spans that carry loss as places in `formatted`."""

    def emit(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "part", "n_turns", "formatted", "loss_spans"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, chars, turns, spans, begun = None, 0, 0, [], [], False
        for batch in batches:
            out = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                piece, (a, b) = render_turn(role, text)
                if begun and (key != conv or chars + len(piece) > part_chars):
                    out.append((conv, part, len(turns), "".join(turns), spans))
                    part, chars, turns, spans = (part + 1 if key == conv else 0), 0, [], []
                if not begun:
                    part = 0
                conv, begun = key, True
                if role == "assistant":
                    spans.append({"begin": chars + a, "end": chars + b})
                turns.append(piece)
                chars += len(piece)
            if out:
                yield emit(out)
        if begun:
            yield emit([(conv, part, len(turns), "".join(turns), spans)])

    return sorted_turns(conversations).select("conv_id", "role", "text").mapInArrow(render, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone: its turns by the parser, its loss text by the spans."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def closed(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for key, s, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if state is None or state[0] != key:
                    if state is not None:
                        out.append(closed(state))
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                while at < len(s):
                    found = parse_turn(s, at)
                    if found is None:
                        raise ValueError(f"conversation {key} does not parse at character {at}")
                    role, text, _, at = found
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    # the closing string behind the span ends the text
                    text = read_text(s, span["begin"], "</s>")
                    if text is None or text[1] != span["end"]:
                        raise ValueError(f"conversation {key}: a loss span is no assistant text")
                    state[3] += len(text[0])
                    state[4].update(text[0].encode())
                state[5] += len(s)
            if out:
                yield emit(out)
        if state is not None:
            yield emit([closed(state)])

    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.select("conv_id", "formatted", "loss_spans").mapInArrow(read, DIGEST)
