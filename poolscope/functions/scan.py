"""Source-code scanning as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    flag: str
    severity: str  # 'high' or 'caution'
    pattern: str


# --- fixed values: contract-source rules, case-insensitive, in reporting order ---
CONTRACT_RULES = (
    Rule("has-mint", "high", r"\bfunction\s+mint\b"),
    Rule("blacklist", "high", r"\bblacklist\b|\bdenylist\b|\bblocklist\b|_isBlacklisted|\bisBot\b"),
    Rule("settable-tax", "high", r"\bsetTax\b|\bsetFee\b|_taxFee|_feeOnTransfer"),
    Rule("upgradeable", "high", r"\bdelegatecall\b|\bupgradeTo\b|__UUPS|_implementation|TransparentUpgradeable"),
    Rule("transfer-gate", "high", r"\bwhenNotPaused\b|\btradingEnabled\b"),
    Rule("owner-privileged", "caution", r"\bonlyOwner\b"),
    Rule("temp-limit", "caution", r"\bmaxBalanceLimit\b|\bbalanceLimitEnd\b|\bmaxTx\b"),
)
CONTRACT_MARK = r"pragma\s+solidity"

# --- fixed values: flag-record fields and the flags they stand for ---
RECORD_HIGH = (
    ("is_honeypot", "honeypot"),
    ("cannot_sell_all", "cannot-sell-all"),
    ("is_mintable", "has-mint"),
    ("is_blacklisted", "blacklist"),
    ("slippage_modifiable", "settable-tax"),
    ("personal_slippage_modifiable", "settable-tax"),
    ("is_proxy", "upgradeable"),
    ("transfer_pausable", "transfer-gate"),
    ("can_take_back_ownership", "reclaimable-ownership"),
    ("hidden_owner", "hidden-owner"),
    ("owner_change_balance", "owner-balance-control"),
    ("selfdestruct", "selfdestruct"),
)
RECORD_CAUTION = (
    ("is_whitelisted", "whitelist"),
    ("external_call", "external-call"),
    ("is_anti_whale", "temp-limit"),
    ("anti_whale_modifiable", "temp-limit"),
    ("trading_cooldown", "trading-cooldown"),
)


def strip_comments(source: Column) -> Column:
    """Block and line comments become a space. Possessive runs keep long texts off the stack."""
    no_blocks = F.regexp_replace(source, r"(?s)/\*.*?\*/", " ")
    return F.regexp_replace(no_blocks, r"//[^\n]*+", " ")


def strip_strings(code: Column) -> Column:
    no_double = F.regexp_replace(code, r'"(?:[^"\\]++|\\.)*+"', '""')
    return F.regexp_replace(no_double, r"'(?:[^'\\]++|\\.)*+'", "''")


def strip_code(source: Column) -> Column:
    return strip_strings(strip_comments(source))


# Rules mean ASCII word boundaries and Unicode blanks. Java's \\b counts accented letters as word
# characters on some JDKs and its \\s knows ASCII blanks only, so texts that are not plain ASCII are
# mapped first: blanks to a space, anything else to a sign that is no word character.
_MORE_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = " \t\n\v\f\r" + _MORE_BLANKS


def scannable(text: Column) -> Column:
    """Text as the rules see it; plain ASCII passes through untouched."""
    spaced = F.translate(text, _MORE_BLANKS, " " * len(_MORE_BLANKS))
    mapped = F.regexp_replace(spaced, "[^\\x00-\\x7F]", "\u00a4")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(mapped)


def rule_regex(pattern: str) -> str:
    if not pattern.isascii():
        raise ValueError("rule patterns must be ASCII")
    return "(?i)" + pattern


def matched_flags(code: Column, rules: tuple[Rule, ...]) -> Column:
    hits = [F.when(code.rlike(rule_regex(r.pattern)), F.lit(r.flag)) for r in rules]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def risk_level(flags: Column, rules: tuple[Rule, ...]) -> Column:
    high = [r.flag for r in rules if r.severity == "high"]
    has_high = F.exists(flags, lambda f: f.isin(*high)) if high else F.lit(False)
    return F.when(has_high, F.lit("high")).when(F.size(flags) > 0, F.lit("caution")).otherwise(F.lit("clean"))
