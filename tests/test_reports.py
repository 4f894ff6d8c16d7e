"""Text audits, provider votes and report text."""

import pytest
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import display as V
from poolscope.operators import audit as U
from poolscope.operators import board as B
from poolscope.operators import trail as T
from poolscope.sources.reference import denylist_df

PRAGMA = "pragma solidity ^0.8.0;\n"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "source, risk, flags",
    [
        ("hello", "unknown", ["unparseable"]),
        ("// pragma solidity", "unknown", ["unparseable"]),
        (PRAGMA + "contract C {}", "clean", []),
        (PRAGMA + "function mint() {}", "high", ["has-mint"]),
        (PRAGMA + "// function mint\n/* blacklist\n */ string s = 'onlyOwner';", "clean", []),
        (PRAGMA + 'string s = "a\\"blacklist"; function f() ONLYOWNER {}', "caution", ["owner-privileged"]),
        (PRAGMA + "éblacklist(", "high", ["blacklist"]),
        (PRAGMA + "function mint", "high", ["has-mint"]),
        (PRAGMA + "uint maxTx; x.delegatecall();", "high", ["upgradeable", "temp-limit"]),
    ],
)
def test_source_scan(spark, source, risk, flags):
    row = U.scan_sources(spark.createDataFrame([(source,)], "source string")).first()
    assert (row.risk, row.flags) == (risk, flags)


def test_long_texts_do_not_overflow_the_matcher(spark):
    source = PRAGMA + "/*" + "x" * 300_000 + "*/ '" + "ab\\'" * 100_000 + "' function mint"
    row = U.scan_sources(spark.createDataFrame([(source,)], "source string")).first()
    assert row.flags == ["has-mint"]


def test_flatten_sources(spark):
    files = '{"sources": {"b.sol": {"content": "B"}, "a.sol": {"content": "A"}, "c.sol": {}}}'
    cases = {" plain \n": "plain", files: "A\nB\n", "{" + files + "}": "A\nB\n", "{broken": "{broken", '{"x": 1}': '{"x": 1}'}
    df = spark.createDataFrame(list(cases.items()), "raw string, t string")
    for r in df.select("t", U.flatten_sources(F.col("raw")).alias("got")).collect():
        assert r.got == r.t


def test_flag_verdict(spark):
    cases = [
        ({"is_open_source": "0"}, "not-found", None, None),
        ({"is_mintable": "1"}, "skipped", None, None),
        ({"is_open_source": "1", "owner_address": config.ZERO_ADDRESS}, "verified", "clean", []),
        ({"is_open_source": "1", "owner_address": "0xAB"}, "verified", "caution", ["owner-privileged"]),
        ({"is_open_source": "1", "slippage_modifiable": "1", "personal_slippage_modifiable": "1", "is_anti_whale": "1"}, "verified", "high", ["settable-tax", "temp-limit"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, record map<string,string>")
    for r in U.flag_verdict(df).collect():
        assert (r.status, r.risk, r.flags) == cases[r.i][1:]


@pytest.mark.parametrize(
    "answers, verdict",
    [
        (["not-found", "not-found", "not-found"], (False, "unknown")),
        (["not-found", "skipped", "not-found"], (None, None)),
        (["skipped", "verified", "not-found"], (True, "high")),
        (["found", None, None], (True, "high")),
        (["not-found", None, "verified"], (None, None)),
        (["not-found", "not-found"], (None, None)),
    ],
)
def test_provider_precedence(spark, answers, verdict):
    rows = [("t", f"p{i}", s, "high" if s in ("found", "verified") else None, ["f"]) for i, s in enumerate(answers)]
    df = spark.createDataFrame(rows, "token string, provider string, status string, risk string, flags array<string>")
    r = U.resolve_audit(df, ["p0", "p1", "p2"]).first()
    assert (r.verified, r.risk) == verdict


def test_audit_report_sentences(spark):
    rows = [("0x" + "a" * 40, "S", None, None, None), ("0x" + "b" * 40, "S", False, "unknown", None), ("0x" + "c" * 40, "S", True, "high", ["x", "y"])]
    got = U.audit_report(spark.createDataFrame(rows, "token string, symbol string, verified boolean, risk string, flags array<string>")).collect()
    assert [r.caveat for r in got] == ["unreachable", "unverified", "high"]
    assert [r.badge for r in got] == ["❔", "⚠️⬜", "✅🔴"]
    assert "flags    x, y\n\n<i>Flags above" in got[2].report and "no verified source" in got[1].report


def test_labels(spark):
    from decimal import Decimal

    dec = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    assert one(spark, V.fmt_usd_amount(dec(1999999999999999999))) == "$1.99"
    assert one(spark, V.fmt_usd_amount(dec(-1234567 * 10**18), 0)) == "-$1,234,567"
    assert one(spark, V.fmt_usd_amount(F.lit(None).cast("decimal(38,0)"))) == "—"
    assert one(spark, V.fmt_usd18(dec(1_250_000 * 10**18))) == "$1.3M"
    assert one(spark, V.fmt_usd18(dec(10**15))) == "<$0.01"
    assert one(spark, V.fmt_market_cap(F.lit(0.4), html=True)) == "MC &lt;$1"
    assert one(spark, V.fmt_market_cap(F.lit(0.4))) == "MC <$1"
    assert [one(spark, V.fmt_fee_tier(F.lit(p))) for p in (100, 2500, 3000, 10000, 123)] == ["0.01%", "0.25%", "0.3%", "1%", "0.0123%"]
    assert one(spark, V.html_escape(F.lit("<b>&</b>"))) == "&lt;b&gt;&amp;&lt;/b&gt;"
    assert one(spark, V.utf16_units(F.lit("🥇a"))) == 3
    assert one(spark, V.fmt_badges(F.lit(None).cast("boolean"), F.lit("high"))) == "🔴"
    assert one(spark, V.audit_badge(F.lit(None).cast("boolean"), F.lit("high"))) == ""
    assert one(spark, V.fmt_when(F.lit("2026-08-13T09:15:59.123Z"))) == "2026-08-13 09:15"
    assert one(spark, V.fmt_when(F.lit("nope"))) == "—"
    assert one(spark, V.block_span(F.lit(1234567), F.lit(1234567))) == "block 1,234,567"


def test_fit_rows_trims_whole_rows(spark):
    rows = [("a", i, "x" * 40) for i in range(1, 6)] + [("b", 1, "y" * 500)]
    df = spark.createDataFrame(rows, "g string, group_pos int, row_text string")
    got = B.fit_rows(df, ["g"], header_units=F.lit(10), limit=140).collect()
    assert sorted(r.group_pos for r in got if r.g == "a") == [1, 2, 3]
    assert [r.placeholder for r in got if r.g == "b"] == [True]


def test_denylist(spark):
    extra = ("0X" + "AB" * 20, "junk")
    got = {r.token for r in denylist_df(spark, extra=extra, allow=(config.USDT,)).collect()}
    assert "0x" + "ab" * 20 in got and config.USDT not in got and "junk" not in got and len(got) == 30
    assert denylist_df(spark, enabled=False).count() == 0
    rows = spark.createDataFrame([(config.USDC.upper().replace("0X", "0x"), "USDC"), ("0xfake", "USDC")], "token string, symbol string")
    assert [r.token for r in B.drop_denied(rows, denylist_df(spark)).collect()] == ["0xfake"]


def test_trail_keeps_runs_without_details(spark):
    runs = spark.createDataFrame(
        [("1", "direct", "success", "2026-01-01T00:00:00Z", "h1"), ("2", "direct", None, "2026-01-02T00:00:00Z", None), ("3", "web", "success", "2026-01-03T00:00:00Z", "h3")],
        "id string, source string, status string, started_at string, hash string",
    )
    details = spark.createDataFrame([("1", "d1", config.POSITION_MANAGER.upper())], "id string, hash string, contract string")
    got = {r.id: r for r in T.trail_labels(T.execution_trail(runs, details, 99)).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"].hash, got["1"].contract_label, got["1"].status_mark) == ("d1", "position manager", "✅")
    assert (got["2"].status, got["2"].contract_label, got["2"].status_mark) == ("unknown", "", "❔")
