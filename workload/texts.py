"""Text and JSON audits, report text and HTML, over whole texts of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolscope.functions import display as V
from poolscope.functions import scan as S
from poolscope.operators import audit as U
from workload import derive as d
from workload.market import text
from workload.registry import query

# Rules for prose: the contract rules never match the given documents.
PROSE_RULES = (
    S.Rule("license", "high", r"\blicen[cs]e\b"),
    S.Rule("email", "high", r"[a-z0-9._]+@[a-z0-9.]+"),
    S.Rule("the", "caution", r"\bthe\b"),
    S.Rule("digits", "caution", r"[0-9]{4}"),
)
_SQL_RULES = ", ".join(
    f"CASE WHEN regexp_matches(code, '(?i){r.pattern}') THEN '{r.flag}' END" for r in PROSE_RULES
)
_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'),
      '(?s)"(?:[^"\\]|\\.)*"', '""', 'g'), '(?s)''(?:[^''\\]|\\.)*''', '''''', 'g')"""


@query(
    "scan_text",
    f"""WITH c AS (SELECT doc_id, {_STRIP} AS code, regexp_matches(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '(?i)\\bin\\b') AS ok FROM documents),
    f AS (SELECT doc_id, ok, list_filter([{_SQL_RULES}], lambda x: x IS NOT NULL) AS flags FROM c)
    SELECT doc_id, CASE WHEN ok THEN array_to_string(flags, ',') ELSE 'unparseable' END AS flags,
      CASE WHEN NOT ok THEN 'unknown' WHEN list_contains(flags, 'license') OR list_contains(flags, 'email') THEN 'high'
           WHEN len(flags) > 0 THEN 'caution' ELSE 'clean' END AS risk FROM f""",
)
def scan_text(spark, sf):
    """Comments, then the mark, then string literals, then the rules, over whole documents."""
    rows = U.scan_sources(d.table(spark, sf, "documents"), "text", PROSE_RULES, r"\bin\b")
    return rows.select("doc_id", F.array_join("flags", ",").alias("flags"), "risk")


# --- fixed values: snippets that make contract-like sources out of plain documents ---
_PARTS = (
    "function mint(address to) public {}",
    "mapping(address => bool) blacklist;",
    "uint _taxFee;",
    "x.delegatecall(y);",
    "function f() whenNotPaused {}",
    "function g() onlyOwner {}",
    "uint maxTx;",
)


def contract_sources(spark, sf):
    """Line-item rows as source texts: a pragma, snippets picked by the row, some commented out or quoted."""
    parts = d.table(spark, sf, "orders")
    pieces = [
        F.when(F.pmod(F.floor(F.col("o_custkey") / 3**i), F.lit(3)) == 0, F.lit(p))
        .when(F.pmod(F.floor(F.col("o_custkey") / 3**i), F.lit(3)) == 1, F.lit("// " + p))
        for i, p in enumerate(_PARTS)
    ]
    pragma = F.when(F.col("o_orderkey") % 9 > 0, F.lit("pragma  solidity ^0.8.0;"))
    quoted = F.lit('string s = "function mint"; /* onlyOwner\n */')
    return parts.select("o_orderkey", F.concat_ws("\n", pragma, quoted, *pieces).alias("source"))


_FLAGS = ("has-mint", "blacklist", "settable-tax", "upgradeable", "transfer-gate", "owner-privileged", "temp-limit")
_SQL_PICKS = ", ".join(
    f"CASE WHEN (o_custkey // {3**i}) % 3 = 0 THEN '{flag}' END" for i, flag in enumerate(_FLAGS)
)


@query(
    "scan_contracts",
    f"""WITH f AS (SELECT o_orderkey, o_custkey, list_filter([{_SQL_PICKS}], lambda x: x IS NOT NULL) AS flags FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unparseable' ELSE array_to_string(flags, ',') END AS flags,
      CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN list_has_any(flags, ['has-mint', 'blacklist', 'settable-tax', 'upgradeable', 'transfer-gate']) THEN 'high'
           WHEN len(flags) > 0 THEN 'caution' ELSE 'clean' END AS risk FROM f""",
)
def scan_contracts(spark, sf):
    """The published contract rules over generated sources with decoys in comments and strings."""
    rows = U.scan_sources(contract_sources(spark, sf))
    return rows.select("o_orderkey", F.array_join("flags", ",").alias("flags"), "risk")


@query(
    "flatten_json",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a
' || text || '

tail' WHEN 1 THEN 'a
' || text || '

tail' WHEN 2 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) WHEN 3 THEN '{broken ' || doc_id ELSE '{"other":' || doc_id || '}' END AS source FROM documents""",
)
def flatten_json(spark, sf):
    """Multi-file source JSON in its plain, double-braced, broken and foreign forms."""
    docs = d.table(spark, sf, "documents")
    file = lambda c: F.struct(c.alias("content"))
    files = F.create_map(
        F.lit("z.sol"), file(F.lit("tail")), F.lit("b.sol"), file(F.col("text")), F.lit("a.sol"), file(F.lit("a")),
        F.lit("c.sol"), file(F.lit("")),
    )
    plain = F.to_json(F.struct(files.alias("sources")))
    kind = F.col("doc_id") % 5
    raw = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit(" {"), plain, F.lit("}\n")))
        .when(kind == 2, F.concat(F.lit("\n "), F.col("text"), F.lit("\t")))
        .when(kind == 3, F.concat(F.lit("{broken "), F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.lit('{"other":'), F.col("doc_id").cast("string"), F.lit("}")))
    )
    return docs.select("doc_id", raw.alias("raw")).select("doc_id", U.flatten_sources(F.col("raw")).alias("source"))


_FIELDS = [f for f, _ in S.RECORD_HIGH + S.RECORD_CAUTION]
_HIGH = {flag for _, flag in S.RECORD_HIGH}
_ON = "((o_custkey * {k} + o_orderkey) % 11) = 0"
_SQL_RECORD = ", ".join(
    f"CASE WHEN {_ON.format(k=i + 1)} THEN '{flag}' END" for i, (_, flag) in enumerate(S.RECORD_HIGH + S.RECORD_CAUTION)
)
_SQL_ANY_HIGH = " OR ".join(_ON.format(k=i + 1) for i in range(len(S.RECORD_HIGH)))


@query(
    "flag_verdict",
    f"""WITH r AS (SELECT o_orderkey, o_custkey, list_filter([{_SQL_RECORD},
        CASE WHEN o_custkey % 4 = 3 THEN 'owner-privileged' END], lambda x: x IS NOT NULL) AS raw, {_SQL_ANY_HIGH} AS high FROM orders),
    u AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS flags FROM r)
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'not-found' WHEN 1 THEN 'skipped' ELSE 'verified' END AS status,
      CASE WHEN o_orderkey % 5 > 1 THEN CASE WHEN high THEN 'high' WHEN len(flags) > 0 THEN 'caution' ELSE 'clean' END END AS risk,
      CASE WHEN o_orderkey % 5 > 1 THEN array_to_string(flags, ',') END AS flags FROM u""",
)
def flag_verdict(spark, sf):
    """Flag records of '0'/'1' fields per order; a zero owner is not privileged."""
    entries = []
    for i, field in enumerate(_FIELDS):
        entries += [F.lit(field), F.when(F.expr(_ON.format(k=i + 1)), F.lit("1")).otherwise(F.lit("0"))]
    owner = F.expr("CASE o_custkey % 4 WHEN 0 THEN '0x0000000000000000000000000000000000000000' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE '0xABC' END")
    opened = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN NULL ELSE '1' END")
    record = F.create_map(*entries, F.lit("owner_address"), owner, F.lit("is_open_source"), opened)
    rows = U.flag_verdict(d.table(spark, sf, "orders").select("o_orderkey", record.alias("record")))
    return rows.select("o_orderkey", "status", "risk", F.array_join("flags", ",").alias("flags"))


PROVIDERS = ["p0", "p1", "p2"]


def provider_answers(spark, sf):
    """One answer per line item: the part is the token, line number and supplier decide provider and status."""
    items = d.table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_linenumber") % 3).alias("p")).agg(
        F.min("l_suppkey").alias("s"), F.max("l_orderkey").alias("o")
    )
    return items.selectExpr(
        "l_partkey AS token",
        "concat('p', CAST(p AS string)) AS provider",
        "CASE WHEN (s + o) % 10 < 5 THEN 'not-found' WHEN (s + o) % 10 < 7 THEN 'skipped' WHEN (s + o) % 10 = 7 THEN NULL WHEN (s + o) % 10 = 8 THEN 'found' ELSE 'verified' END AS status",
        "CASE WHEN (s + o) % 10 >= 8 THEN CASE o % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'caution' ELSE 'clean' END END AS risk",
        "CASE WHEN (s + o) % 10 >= 8 THEN CASE WHEN o % 3 < 2 THEN array(concat('f', CAST(o % 7 AS string)), 'g') ELSE CAST(array() AS array<string>) END END AS flags",
    )


_SQL_ANSWERS = """g AS (SELECT l_partkey AS token, l_linenumber % 3 AS p, min(l_suppkey) AS s, max(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
answers AS (SELECT token, p, CASE WHEN (s + o) % 10 < 5 THEN 'not-found' WHEN (s + o) % 10 < 7 THEN 'skipped' WHEN (s + o) % 10 = 7 THEN NULL
      WHEN (s + o) % 10 = 8 THEN 'found' ELSE 'verified' END AS status,
    CASE o % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'caution' ELSE 'clean' END AS risk,
    CASE WHEN o % 3 < 2 THEN 'f' || (o % 7) || ', g' ELSE '' END AS flags FROM g),
full_grid AS (SELECT t.token, i.p, a.status, a.risk, a.flags FROM (SELECT DISTINCT token FROM g) t CROSS JOIN (SELECT unnest(range(3)) AS p) i
   LEFT JOIN answers a ON a.token = t.token AND a.p = i.p),
ends AS (SELECT token, min(p) FILTER (WHERE status IS NULL OR status IN ('found', 'verified')) AS stop,
    count(*) FILTER (WHERE status = 'skipped') > 0 AS incomplete FROM full_grid GROUP BY token),
verdicts AS (SELECT e.token, CASE WHEN stop IS NULL THEN CASE WHEN incomplete THEN NULL ELSE false END WHEN f.status IS NULL THEN NULL ELSE true END AS verified,
    CASE WHEN stop IS NULL THEN CASE WHEN NOT incomplete THEN 'unknown' END WHEN f.status IS NOT NULL THEN f.risk END AS risk,
    CASE WHEN stop IS NOT NULL AND f.status IS NOT NULL THEN f.flags END AS flags
  FROM ends e LEFT JOIN full_grid f ON f.token = e.token AND f.p = e.stop)"""


@query("audit_chain", f"WITH {_SQL_ANSWERS} SELECT token, verified, risk, flags FROM verdicts")
def audit_chain(spark, sf):
    rows = U.resolve_audit(provider_answers(spark, sf), PROVIDERS)
    return rows.select("token", "verified", "risk", F.array_join("flags", ", ").alias("flags"))


@query(
    "audit_report",
    f"""WITH {_SQL_ANSWERS}
    SELECT token, CASE WHEN verified IS NULL THEN 'unreachable' WHEN NOT verified THEN 'unverified' WHEN risk = 'high' THEN 'high'
        WHEN risk = 'clean' THEN 'clean' ELSE 'none' END AS caveat,
      CASE WHEN verified IS NULL THEN '❔' WHEN NOT verified THEN '⚠️⬜' ELSE '✅' || CASE risk WHEN 'high' THEN '🔴' WHEN 'caution' THEN '🟡' ELSE '🟢' END END AS badge,
      CASE WHEN verified IS NULL THEN '❔ <b>T' || token || '</b> <a href="https://bscscan.com/token/' || token || '">' || token || '</a> — audit unavailable, retry'
           ELSE CASE WHEN NOT verified THEN '⚠️⬜' ELSE '✅' || CASE risk WHEN 'high' THEN '🔴' WHEN 'caution' THEN '🟡' ELSE '🟢' END END
             || ' <b>T' || token || '</b> <a href="https://bscscan.com/token/' || token || '">' || token || '</a>'
             || CASE WHEN coalesce(flags, '') <> '' THEN ' · <i>' || flags || '</i>' ELSE '' END END AS line
    FROM verdicts""",
)
def audit_report(spark, sf):
    rows = U.resolve_audit(provider_answers(spark, sf), PROVIDERS)
    named = rows.withColumn("token", F.col("token").cast("string")).withColumn("symbol", F.concat(F.lit("T"), "token"))
    out = U.audit_report(named)
    return out.select(F.col("token").cast("bigint").alias("token"), "caveat", "badge", "line")


@query(
    "audit_rollup",
    f"""WITH {_SQL_ANSWERS}, members AS (SELECT token // 2 AS pair_id, 'T' || token AS symbol, verified, risk FROM verdicts)
    SELECT pair_id, coalesce(string_agg(symbol, ', ' ORDER BY symbol) FILTER (WHERE NOT verified), '') AS unverified,
      coalesce(string_agg(symbol, ', ' ORDER BY symbol) FILTER (WHERE verified AND risk = 'high'), '') AS high_risk,
      coalesce(string_agg(symbol, ', ' ORDER BY symbol) FILTER (WHERE verified IS NULL), '') AS unreachable
    FROM members GROUP BY pair_id""",
)
def audit_rollup(spark, sf):
    rows = U.resolve_audit(provider_answers(spark, sf), PROVIDERS).selectExpr(
        "token div 2 AS pair_id", "concat('T', CAST(token AS string)) AS symbol", "verified", "risk", "verified IS NOT NULL AS reached"
    )
    return U.audit_rollup(rows)


@query(
    "html_escape",
    "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages",
)
def html_escape(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", V.html_escape(F.col("html")).alias("safe"))


# 1e18 fixed-point dollars of very different sizes, built from the order total in cents
_VALUE = "CAST(round(o_totalprice * 100) AS {wide}) * {tail}"


@query(
    "fmt",
    """WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(round(o_totalprice * 100) AS HUGEINT) AS cents FROM orders),
    w AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN cents * 10000000000000000 WHEN 2 THEN cents * 1000000000
        WHEN 3 THEN cents * 100000000000000000000 ELSE CAST(0 AS HUGEINT) END AS x,
      CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_custkey * 1000 + 37 END AS cap FROM v)
    SELECT o_orderkey,
      CASE WHEN x IS NULL THEN '—' ELSE '$' || format('{:,}', x // 1000000000000000000) || '.' || substr(lpad(CAST(x % 1000000000000000000 AS VARCHAR), 18, '0'), 1, 2) END AS amount,
      CASE WHEN x IS NULL THEN '—' WHEN x = 0 THEN '$0'
        WHEN x >= 1000000000000000000000000000 THEN '$' || CAST(CAST(round(CAST(x AS DOUBLE) / 1e27, 6) AS DECIMAL(18,1)) AS VARCHAR) || 'B'
        WHEN x >= 1000000000000000000000000 THEN '$' || CAST(CAST(round(CAST(x AS DOUBLE) / 1e24, 6) AS DECIMAL(18,1)) AS VARCHAR) || 'M'
        WHEN x >= 1000000000000000000000 THEN '$' || CAST(CAST(round(CAST(x AS DOUBLE) / 1e21, 6) AS DECIMAL(18,1)) AS VARCHAR) || 'K'
        WHEN x < 10000000000000000 THEN '<$0.01' ELSE '$' || CAST(CAST(CAST(x AS DOUBLE) / 1e18 AS DECIMAL(18,2)) AS VARCHAR) END AS short_amount,
      CASE WHEN cap IS NULL THEN 'MC —' WHEN cap < 1000 THEN 'MC $' || cap WHEN cap >= 1000000 THEN 'MC $' || (cap + 50000) // 1000000 || '.' || ((cap + 50000) // 100000) % 10 || 'M'
        ELSE 'MC $' || (cap + 50) // 1000 || '.' || ((cap + 50) // 100) % 10 || 'K' END AS cap,
      CASE o_custkey % 6 WHEN 0 THEN '0.01%' WHEN 1 THEN '0.05%' WHEN 2 THEN '0.25%' WHEN 3 THEN '1%' WHEN 4 THEN '0.0123%' ELSE '98.031%' END AS fee,
      CASE WHEN o_custkey % 3 = 0 THEN 'RSI —' ELSE 'RSI ' || o_custkey % 101 || CASE WHEN o_custkey % 101 < 30 THEN ' 🟢 Oversold' WHEN o_custkey % 101 > 70 THEN ' 🔴 Overbought' ELSE '' END END AS rsi,
      CASE o_orderkey % 4 WHEN 0 THEN '(warming)' ELSE CASE WHEN o_custkey % 40 >= 20 THEN (o_custkey % 40) // 2 + (o_custkey % 2) || 'x' ELSE (o_custkey % 40) // 2 || '.' || (o_custkey % 2) * 5 || 'x' END END AS spike,
      CASE WHEN o_custkey % 5 = 0 THEN '' ELSE CASE WHEN o_custkey % 2 = 0 THEN ' ✅' ELSE ' ⚠️' END || CASE o_custkey % 4 WHEN 0 THEN '🟢' WHEN 1 THEN '🟡' WHEN 2 THEN '🔴' ELSE '⬜' END END AS badge,
      CASE WHEN length(o_orderpriority || o_orderkey) > 12 THEN substr(o_orderpriority || o_orderkey, 1, 6) || '…' || right(o_orderpriority || o_orderkey, 4) ELSE o_orderpriority || o_orderkey END AS short_name
    FROM w""",
)
def fmt(spark, sf):
    """Every label function over order rows."""
    wide = "CAST(round(o_totalprice * 100) AS decimal(38,0))"
    rows = d.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        f"""CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST({wide} * 10000000000000000BD AS decimal(38,0))
              WHEN 2 THEN CAST({wide} * 1000000000BD AS decimal(38,0)) WHEN 3 THEN CAST({wide} * 100000000000000000000BD AS decimal(38,0))
              ELSE CAST(0 AS decimal(38,0)) END AS x""",
        "CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey * 1000 + 37 END AS double) AS cap",
        "element_at(array(100, 500, 2500, 10000, 123, 980310), CAST(o_custkey % 6 + 1 AS int)) AS pips",
        "CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 101 END AS int) AS rsi",
        "CASE WHEN o_orderkey % 4 > 0 THEN (o_custkey % 40) / 2.0D END AS spike",
        "CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 2 = 0 END AS verified",
        "element_at(array('clean', 'caution', 'high', 'unknown'), CAST(o_custkey % 4 + 1 AS int)) AS risk",
        "concat(o_orderpriority, CAST(o_orderkey AS string)) AS name",
    )
    from poolscope.functions.rsi import rsi_label

    return rows.select(
        "o_orderkey",
        V.fmt_usd_amount(F.col("x")).alias("amount"),
        V.fmt_usd18(F.col("x")).alias("short_amount"),
        V.fmt_market_cap(F.col("cap")).alias("cap"),
        V.fmt_fee_tier(F.col("pips")).alias("fee"),
        V.fmt_rsi(F.col("rsi"), rsi_label(F.col("rsi"))).alias("rsi"),
        V.fmt_spike(F.col("spike")).alias("spike"),
        V.audit_badge(F.col("verified"), F.col("risk")).alias("badge"),
        V.short_addr(F.col("name")).alias("short_name"),
    )
