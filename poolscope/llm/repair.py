r"""Repair of damaged conversations by a generalised LR parse over roles.

The role grammar, in initials, and its LR states (fixed below):

    talk = nothing | pairs | s pairs          pairs = pairs u a | u a

A parse reads a conversation's rows. On each row a stack may keep it (its initial is shifted), rerole it (`u` or `a`
is shifted), or delete it, and may insert empty rows in front. All stacks live in one graph, and equal tops merge: of
those with the same top state the least (cost, audit) stays, since what may follow depends on the top alone.

Audits are compared without being copied. Inserts are taken just before the next row or at the end, so no audit of a
front is the beginning of another, and whichever is less stays so whatever follows both. A front therefore carries a
rank for each top, and audits are read off the back links at the end.

Hot conversations: rows are range-sorted by (conversation, turn, role, digest of the text) and cut into blocks of bounded rows and
characters. A block that holds a whole conversation is finished where it is. Any other one is parsed from each of the
stacks that may enter it; a second pass picks the entry of each block from costs and ranks alone, blocks are rendered
by themselves, and only the ordered digest and the audit of a long conversation pass one task, block after block.
Equal rows are counted before they are sorted, and first occurrences are aggregated, so neither needs a task of its own.

Defined cases: null ids, turns, roles and texts are one space where a character is called for; all rows without a
conv_id are one conversation; turns sort null first, equal turns by role and digest of the text; a role is legal by its first
character, so an empty one can't be kept; gaps beyond a long are null; empty input gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.shared import written

BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20
SPACES = " \t\n\x0b\f\r"

# fixed values: the LR automaton of the grammar. 5 and 7 are complete pairs, reduced at once.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # state: symbols on the stack
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
START = (0,)
STACKS = [(0,), (0, 1), (0, 2), (0, 1, 2), (0, 3), (0, 1, 4), (0, 3, 6), (0, 1, 4, 6)]
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

Stack = tuple[int, ...]
Move = tuple[Stack, int, str]  # (stack behind a row, cost, audit of the step)


def advance(stack: Stack, initial: str) -> Stack | None:
    """The stack after a shift and all reductions, or None."""
    state = SHIFT.get((stack[-1], initial))
    if state is None:
        return None
    stack = (*stack, state)
    while stack[-1] in REDUCE:
        stack = stack[: -REDUCE[stack[-1]]]
        stack = (*stack, GOTO[stack[-1]])
    return stack


def wanted(stack: Stack) -> str:
    """The role initial that a rerole or an insert shifts here."""
    return "a" if advance(stack, "a") else "u"


def _inserted(stack: Stack) -> list[Move]:
    out = [(stack, 0, "")]
    for n in (1, 2):
        stack = advance(stack, wanted(stack))
        out.append((stack, n * INSERT, "I" * n))
    return out


def _moves(stack: Stack, initial: str, must_go: bool, unfinished: bool) -> list[Move]:
    """The steps over one row, the least for each top."""
    found: list[Move] = [(stack, DELETE, "D")]
    if not must_go:
        for at, cost, audit in _inserted(stack):
            cost += UNFINISHED * unfinished
            kept = advance(at, initial)
            if kept:
                found.append((kept, cost + KEEP, audit + "K"))
            found.append((advance(at, wanted(at)), cost + REROLE, audit + "R"))
    least: dict[int, Move] = {}
    for move in sorted(found, key=lambda m: m[1:]):
        least.setdefault(move[0][-1], move)
    return list(least.values())


MOVES = {(c, i, g, t): _moves(c, i, g, t) for c in STACKS for i in "suax" for g in (False, True) for t in (False, True)}
#: The least end of each stack: (cost, audit).
ENDS = {c: min(m[1:] for m in _inserted(c) if m[0][-1] in ACCEPT) for c in STACKS}

Front = dict[int, tuple]  # top: (cost, rank, stack, back link); a back link is (earlier link, audit, times)


def step(front: Front, initial: str, must_go: bool, unfinished: bool) -> Front:
    found: dict[int, tuple] = {}
    for cost, rank, stack, link in front.values():
        for to, more, audit in MOVES[stack, initial, must_go, unfinished]:
            key = (cost + more, rank, audit)
            held = found.get(to[-1])
            if held is None or key < held[0]:
                found[to[-1]] = (key, to, link)
    order = sorted(found.items(), key=lambda x: x[1][0][1:])
    return {top: (key[0], rank, to, (link, key[2], 1)) for rank, (top, (key, to, link)) in enumerate(order)}


def audit_of(link: tuple | None) -> str:
    parts = []
    while link is not None:
        link, audit, times = link
        parts.append(audit * times)
    return "".join(reversed(parts))


def parse(rows: list[dict], start: Stack) -> Front:
    """The front behind `rows`, from one stack. A row is there m times; every copy but the first must go."""
    front: Front = {start[-1]: (0, 0, start, None)}
    for r in rows:
        front = step(front, r["initial"], r["blank"] or r["seen"], r["unfinished"])
        if r["m"] > 1:
            more = r["m"] - 1
            front = {top: (cost + DELETE * more, rank, stack, (link, "D", more)) for top, (cost, rank, stack, link) in front.items()}
    return front


def cheapest(front: Front) -> tuple[int, str, tuple]:
    """(cost, last inserts, entry) of the best stack that can end here."""
    ended = [(e[0] + ENDS[e[2]][0], e[1], ENDS[e[2]][1], top) for top, e in front.items()]
    cost, _, tail, top = min(ended)
    return cost, tail, front[top]


def render(rows: list[dict], start: Stack, audit: str) -> list[str]:
    """The repaired rows as `role:text`; the audit may go on with inserts behind the last row."""
    out, stack, at = [], start, 0
    copies = rows[0]["m"] if rows else 0
    for i in audit:
        if i == "I":
            role = wanted(stack)
            out.append(ROLES[role] + ":")
            stack = advance(stack, role)
            continue
        r = rows[at]
        if i != "D":
            initial = r["initial"] if i == "K" else wanted(stack)
            out.append((r["role"] if i == "K" else ROLES[initial]) + ":" + r["text"])
            stack = advance(stack, initial)
        copies -= 1
        if not copies:
            at += 1
            copies = rows[at]["m"] if at < len(rows) else 0
    return out


LEGAL = {"su", "ua", "au"}
COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def summary(rows: list[dict]) -> dict:
    """Counts of a block, and what its neighbours need to join theirs."""
    out = dict.fromkeys(COUNTS, 0) | dict.fromkeys(("first", "last", "low", "high"))
    for r in rows:
        m, initial, turn = r["m"], r["initial"], r["turn"]
        out["rows"] += m
        if r["blank"]:
            out["blank"] += m
        else:
            out["duplicate"] += m - (not r["seen"])
            out["truncated"] += r["unfinished"] and not r["seen"]
        out["illegal"] += m - 1
        if out["last"] is not None:
            out["illegal"] += out["last"] + initial not in LEGAL
        out["first"] = out["first"] or initial
        out["last"] = initial
        if turn is not None:
            out["turns"] += turn != out["high"]
            out["low"] = turn if out["low"] is None else out["low"]
            out["high"] = turn
    return out


def joined(a: dict, b: dict) -> dict:
    """The summary of two blocks in a row."""
    if not b["rows"]:
        return a
    if not a["rows"]:
        return b
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= b["low"] is not None and a["high"] == b["low"]
    return out | {
        "first": a["first"], "last": b["last"],
        "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"],
    }


def gaps(s: dict) -> int | None:
    n = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
    return n if n < 1 << 63 else None


ROW = pa.struct([("role", pa.string()), ("text", pa.string()), ("initial", pa.string()), ("m", pa.int64()), ("blank", pa.bool_()),
                 ("seen", pa.bool_()), ("unfinished", pa.bool_()), ("turn", pa.int64())])
STEP = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())])
SUMMARY = [(c, pa.int64()) for c in COUNTS] + [("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())]
RESULT = [("gaps", pa.int64()), *SUMMARY[1:5], ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
BLOCK = pa.schema(
    [("conv_id", pa.int64()), ("done", pa.struct(RESULT)), ("part", pa.int32()), ("block", pa.int64()), ("summary", pa.struct(SUMMARY)),
     ("steps", pa.list_(STEP)), ("audits", pa.list_(pa.string())), ("rows", pa.list_(ROW))]
)
SQL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{ddl(f.type)}" for f in kind) + ">"
    return SQL_TYPES[kind]


def schema_of(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {ddl(f.type)}" for f in schema)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def result(s: dict, cost: int, audit: str, sha: str) -> dict:
    return {"gaps": gaps(s), **{c: int(s[c]) for c in COUNTS[1:5]}, "cost": cost, "audit": audit, "repaired_sha256": sha}


def finished(rows: list[dict]) -> dict:
    """The result of a whole conversation."""
    cost, tail, best = cheapest(parse(rows, START))
    audit = audit_of(best[3]) + tail
    text = "\n".join(render(rows, START, audit))
    return result(summary(rows), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def open_block(conv: int | None, part: int, block: int, rows: list[dict], begins: bool) -> dict:
    """A block of a conversation that may go on in other blocks: its parse from every stack that may enter it."""
    steps, audits = [], []
    for start in [START] if begins else STACKS:
        for cost, rank, stack, link in parse(rows, start).values():
            steps.append({"start": STACKS.index(start), "end": STACKS.index(stack), "cost": cost, "rank": rank})
            audits.append(audit_of(link))
    return {"conv_id": conv, "part": part, "block": block, "summary": summary(rows), "steps": steps, "audits": audits, "rows": rows}


def fold_blocks(block_rows: int, block_chars: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, held, chars, blocks, number = None, [], 0, 0, 0
        began, first = False, True  # whether any row came; whether the conversation may have begun in an earlier partition
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                key = r.pop("conv_id")
                if began and (key != conv or len(held) >= block_rows or chars >= block_chars):
                    if key != conv and not first and not blocks:
                        done.append({"conv_id": conv, "done": finished(held)})
                    else:
                        yield batch_of([open_block(conv, part, number, held, not first and not blocks)], BLOCK)
                        number, blocks = number + 1, blocks + 1
                    held, chars = [], 0
                    if key != conv:
                        first, blocks = False, 0
                conv, began = key, True
                if r["m"]:
                    held.append(r)
                    chars += len(r["text"])
            if done:
                yield batch_of(done, BLOCK)
        if began:
            yield batch_of([open_block(conv, part, number, held, not first and not blocks)], BLOCK)

    return fold


CHOICE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("tail", pa.string()), ("cost", pa.int64())])


def _by_conversation(rows: Iterator[dict]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conversation, its rows) of sorted rows; the rows must be used up before the next conversation."""
    return groupby(rows, key=lambda r: r["conv_id"])


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which entry and exit of every block the cheapest repair of its conversation takes."""
    for _, blocks in _by_conversation(r for b in batches for r in b.to_pylist()):
        front = {START[-1]: (0, 0, START, None)}
        places = []
        for b in blocks:
            places.append((b["part"], b["block"]))
            ahead = {STACKS.index(e[2]): e for e in front.values()}
            found: dict[int, tuple] = {}
            for s in b["steps"]:
                e = ahead.get(s["start"])
                if e is None:
                    continue
                to, key = STACKS[s["end"]], (e[0] + s["cost"], e[1], s["rank"])
                if to[-1] not in found or key < found[to[-1]][0]:
                    found[to[-1]] = (key, to, (e[3], s["start"], s["end"]))
            order = sorted(found.items(), key=lambda x: x[1][0][1:])
            front = {top: (key[0], rank, to, link) for rank, (top, (key, to, link)) in enumerate(order)}
        cost, tail, best = cheapest(front)
        link, out = best[3], []
        for n, (part, block) in enumerate(reversed(places)):
            link, start, end = link
            out.append({"part": part, "block": block, "start": start, "end": end, "tail": "" if n else tail, "cost": 0 if n else cost})
        yield batch_of(out, CHOICE)


PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("summary", pa.struct(SUMMARY)), ("cost", pa.int64()),
                   ("audit", pa.string()), ("lines", pa.int64()), ("repaired", pa.string())])
DONE = pa.schema([("conv_id", pa.int64()), ("done", pa.struct(RESULT))])


def render_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            r = batch.slice(n, 1).to_pylist()[0]
            at = next(i for i, s in enumerate(r["steps"]) if s["start"] == r["start"] and s["end"] == r["end"])
            audit = r["audits"][at] + r["tail"]
            lines = render(r["rows"], STACKS[r["start"]], audit)
            piece = {c: r[c] for c in ("conv_id", "part", "block", "summary", "cost")}
            yield batch_of([piece | {"audit": audit, "lines": len(lines), "repaired": "\n".join(lines)}], PIECE)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result per conversation from its rendered blocks, in order; holds the audit, never the text."""
    for conv, pieces in _by_conversation(r for b in batches for r in b.to_pylist()):
        total, cost, audits, sha, lines = summary([]), 0, [], hashlib.sha256(), 0
        for p in pieces:
            total = joined(total, p["summary"])
            cost += p["cost"]
            audits.append(p["audit"])
            if p["lines"]:
                sha.update(("\n" if lines else "").encode() + p["repaired"].encode())
                lines += p["lines"]
        yield batch_of([{"conv_id": conv, "done": result(total, cost, "".join(audits), sha.hexdigest())}], DONE)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with planted faults: (conv_id, turn, role, text, m), m the number of times a row is there (dropped: 0)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("m"))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows counted, with their faults: blank, seen (in an earlier row with the same role and text), unfinished, initial."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    firsts = rows.filter("m > 0").groupBy("conv_id", "role", "sha").agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unplaced")
    )
    firsts = firsts.filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "sha", "first", "unplaced")])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("_unplaced") | (F.col("turn") > F.col("_first"))), F.lit(False))
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    return rows.join(firsts, same, "left").select(
        "conv_id", "turn", "role", "text", "m", "sha",
        (shown == "").alias("blank"), seen.alias("seen"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("unfinished"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
    )


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, m): its faults, the cost and audit of its cheapest repair, and its digest."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "sha"]
    lines = marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    lines = lines.select("conv_id", "turn", "role", "text", "m", "blank", "seen", "unfinished", "initial")
    blocks = written(lines.mapInArrow(fold_blocks(block_rows, block_chars), schema_of(BLOCK)), "repair-blocks")
    unfinished = blocks.filter("done IS NULL")
    in_order = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    choices = in_order(unfinished.select("conv_id", "part", "block", "steps")).mapInArrow(choose, schema_of(CHOICE))
    pieces = unfinished.join(choices, ["part", "block"]).mapInArrow(render_blocks, schema_of(PIECE))
    late = in_order(pieces).mapInArrow(finish, schema_of(DONE))
    return blocks.filter("done IS NOT NULL").select("conv_id", "done").unionByName(late).select("conv_id", "done.*")
