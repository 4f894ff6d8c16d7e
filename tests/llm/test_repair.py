"""Conversation repair against all repairs of short talks, and blocks against one piece."""

import hashlib
import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from poolscope.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, m bigint, rows int, block string, done string"


def initials_ok(s):
    s = s[1:] if s[:1] == "s" and len(s) > 1 else s
    return s == "ua" * (len(s) // 2) and len(s) % 2 == 0


def plain(rows):
    """Least (cost, audit, text) of every sequence of edits with at most two inserts in a row; rows are (role, text, blank, seen, unfinished)."""
    best = None
    inserts = [[]] + [list(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    per_row = []
    for role, text, blank, seen, unfinished in rows:
        acts = [(2, "D", None)]
        if not (blank or seen):
            more = 5 * unfinished
            acts += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        per_row.append([(5 * len(i), "I" * len(i), i, a) for i in inserts for a in acts])
    per_row.append([(5 * len(i), "I" * len(i), i, None) for i in inserts])
    for choice in itertools.product(*per_row):
        cost, audit, out = 0, "", []
        for paid, marks, ins, act in choice:
            cost, audit = cost + paid, audit + marks
            out += [({"u": "user", "a": "assistant"}[x], "") for x in ins]
            if act:
                cost, audit = cost + act[0], audit + act[1]
                out += [act[2]] if act[2] else []
        if initials_ok("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def as_rows(talk):
    out = []
    for role, text in talk:
        shown = text.rstrip(repair.SPACES)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        seen = bool(shown) and (role, text) in [(r["role"], r["text"]) for r in out]
        out.append(dict(role=role, text=text, initial=initial, m=1, blank=not shown, seen=seen, unfinished=shown[-1:] not in (".", "!", "?"), turn=len(out)))
    return out


ROLES = st.sampled_from(["system", "user", "assistant", "tool", ""])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ROLES, st.sampled_from(["a.", "b!", "c", " "])), max_size=3))
def test_cheapest_of_all_repairs(talk):
    rows = as_rows(talk)
    got = repair.finished(rows)
    cost, audit, text = plain([(r["role"], r["text"], r["blank"], r["seen"], r["unfinished"] and not r["blank"]) for r in rows])
    assert (got["cost"], got["audit"], got["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_known_repairs():
    case = lambda *talk: (lambda r: (r["cost"], r["audit"]))(repair.finished(as_rows(talk)))
    assert case() == (0, "")
    assert case(("system", "x."), ("user", "a."), ("assistant", "b.")) == (0, "KKK")
    assert case(("user", "a."), ("user", "b.")) == (1, "KR")
    assert case(("system", "x.")) == (2, "D")
    assert case(("user", "a."), ("assistant", "b."), ("user", "c.")) == (2, "KKD")
    assert case(("user", "a."), ("user", "a."), ("assistant", "")) == (6, "DDD")


def talks(seed):
    pick = random.Random(seed)
    rows = []
    for conv in (None, *range(12)):
        for turn in range(pick.choice([1, 2, 7, 30])):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            text = pick.choice([f"t{turn}.", "same.", "cut", "", None, f"é {turn}!"])
            rows.append((conv, None if pick.random() < 0.1 else turn, role, text))
    rows += [(50, 3, "user", "again.")] * 25 + [(50, 4, "assistant", "again.")] * 3 + [(51, -5, "user", "a."), (51, 9, "assistant", "b.")]
    return rows


def one_piece(rows):
    """Every conversation parsed by itself, from the definitions."""
    out = Counter()
    for conv in {r[0] for r in rows}:
        own = [(t, r or " ", " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        lines = as_rows([(r, x) for _, r, x in own])
        for line, (turn, _, _) in zip(lines, own, strict=True):
            line["turn"] = turn
        out[(conv, *repair.finished(lines).values())] += 1
    return out


def collected(df):
    return Counter(tuple(r) for r in df.select("conv_id", *[n for n, _ in repair.RESULT]).collect())


def test_blocks_against_one_piece(spark):
    for seed in (1, 2):
        rows = talks(seed)
        df = spark.createDataFrame([(c, t, r or " ", " " if x is None else x, 1, 1, "b", "d") for c, t, r, x in rows], SCHEMA)
        want = one_piece(rows)
        assert collected(repair.repair(df)) == want
        assert collected(repair.repair(df, block_rows=3)) == want
        assert collected(repair.repair(df, block_chars=1)) == want


def test_damage_and_empty(spark):
    df = spark.createDataFrame([(c, t, r, x, 1, 1, "b", "d") for c, t, r, x in talks(3)], SCHEMA)
    damaged = repair.damage(df).collect()
    assert len(damaged) == df.count() and {r.m for r in damaged} <= {0, 1, 2}
    got = repair.repair(repair.damage(df)).collect()
    assert {r.conv_id for r in got} == {r.conv_id for r in df.select("conv_id").collect()} and len(got) == len({r.conv_id for r in got})
    assert repair.repair(repair.damage(df.limit(0))).count() == 0
    dropped = spark.createDataFrame([(5, 1, "user", "a.", 0), (6, 1, "user", "a.", 1)], "conv_id bigint, turn bigint, role string, text string, m bigint")
    row = next(r for r in repair.repair(dropped).collect() if r.conv_id == 5)
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
