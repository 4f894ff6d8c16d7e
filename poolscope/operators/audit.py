"""Contract audits as batch jobs over source texts, flag records and provider answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope import config
from poolscope.functions import display as D
from poolscope.functions import scan as S


def scan_sources(
    df: DataFrame,
    source: str = "source",
    rules: tuple[S.Rule, ...] = S.CONTRACT_RULES,
    mark: str | None = S.CONTRACT_MARK,
) -> DataFrame:
    """Add risk and flags of each source text.

    Comments go first, then the language mark is looked for, then string literals go: a rule only
    counts in code. Text without the mark is 'unknown' with the flag 'unparseable'. Works on any
    text table, whole texts, no Python.
    """
    staged = df.withColumn("_plain", S.strip_comments(S.scannable(F.col(source))))
    staged = staged.withColumn("_code", S.strip_strings(F.col("_plain")))
    flags = S.matched_flags(F.col("_code"), rules)
    parseable = F.lit(True) if mark is None else F.coalesce(F.col("_plain").rlike(S.rule_regex(mark)), F.lit(False))
    staged = staged.withColumn("flags", F.when(parseable, flags).otherwise(F.array(F.lit("unparseable"))))
    level = F.when(parseable, S.risk_level(F.col("flags"), rules)).otherwise(F.lit("unknown"))
    return staged.withColumn("risk", level).drop("_plain", "_code")


def flatten_sources(raw: Column) -> Column:
    """Multi-file source JSON -> one text, files in path order; anything else -> the trimmed text.

    Accepts the plain and the double-braced form.
    """
    trimmed = F.trim(raw, F.lit(S.BLANKS))
    inner = F.when(trimmed.startswith("{{"), F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)
    # A field type the schema does not expect, or broken JSON, gives NULL in permissive mode.
    parsed = F.from_json(inner, "sources map<string, struct<content: string>>")
    files = F.array_sort(F.map_entries(parsed["sources"]))
    joined = F.array_join(F.transform(files, lambda f: F.coalesce(f["value"]["content"], F.lit(""))), "\n")
    return F.when(trimmed.startswith("{"), F.coalesce(joined, trimmed)).otherwise(trimmed)


def flag_verdict(df: DataFrame, record: str = "record") -> DataFrame:
    """A provider's flag record (MAP<STRING,STRING>) -> status, risk and flags.

    open source '0' is 'not-found', '1' is 'verified', anything else is 'skipped': it did not vote.
    """
    get = lambda field: F.try_element_at(F.col(record), F.lit(field))
    on = lambda field: F.coalesce(get(field) == "1", F.lit(False))
    owner = get("owner_address")
    owned = F.coalesce((owner != "") & (F.lower(owner) != config.ZERO_ADDRESS), F.lit(False))
    high = [F.when(on(f), F.lit(flag)) for f, flag in S.RECORD_HIGH]
    caution = [F.when(on(f), F.lit(flag)) for f, flag in S.RECORD_CAUTION]
    caution.append(F.when(owned, F.lit("owner-privileged")))
    status = F.when(get("is_open_source") == "0", F.lit("not-found")).when(
        get("is_open_source") == "1", F.lit("verified")
    ).otherwise(F.lit("skipped"))
    staged = df.withColumn("status", status)
    staged = staged.withColumn("_high", F.array_compact(F.array(*high)))
    staged = staged.withColumn("_all", F.array_distinct(F.concat("_high", F.array_compact(F.array(*caution)))))
    voted = F.col("status") == "verified"
    level = F.when(F.size("_high") > 0, F.lit("high")).when(F.size("_all") > 0, F.lit("caution")).otherwise(F.lit("clean"))
    return (
        staged.withColumn("risk", F.when(voted, level))
        .withColumn("flags", F.when(voted, F.col("_all")))
        .drop("_high", "_all")
    )


def resolve_audit(answers: DataFrame, order: list[str], key: str = "token") -> DataFrame:
    """One verdict per token from provider answers (status, risk, flags), in provider order.

    Walking the providers: no answer at all (NULL or a missing row) ends it undecided, a skip makes
    the vote incomplete, 'not-found' asks the next one, the first 'found' or 'verified' wins. All
    'not-found' and complete means unverified; undecided tokens give NULL. As every provider has one
    fixed place this is a conditional aggregate, one pass with partials; nothing is collected. Of
    several answers of a provider the newest by `answered_at` counts, as one row.
    """
    when = F.col("answered_at") if "answered_at" in answers.columns else F.lit(0)
    statuses, winners = [], []
    at = lambda p: F.col("provider") == p
    columns = []
    for i, provider in enumerate(order):
        columns.append(F.max(F.when(at(provider), F.struct(when.alias("at"), "status", "risk", "flags"))).alias(f"_a{i}"))
    wide = answers.groupBy(key).agg(*columns)
    for i in range(len(order)):
        wide = wide.withColumns({f"_{c}{i}": F.col(f"_a{i}.{name}") for c, name in (("s", "status"), ("r", "risk"), ("f", "flags"))})
    for i in range(len(order)):
        statuses.append(F.col(f"_s{i}"))
        winners.append(F.col(f"_s{i}").isin("found", "verified"))
    outcome = F.when(
        F.greatest(*[(s == "skipped").cast("int") for s in statuses], F.lit(0)) == 1, F.lit("undecided")
    ).otherwise(F.lit("unverified"))
    risk, flags = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for i in reversed(range(len(order))):
        outcome = (
            F.when(statuses[i].isNull(), F.lit("undecided")).when(winners[i], F.lit("verified")).otherwise(outcome)
        )
        go_on = statuses[i].isNotNull() & ~winners[i]
        risk = F.when(winners[i], F.col(f"_r{i}")).when(go_on, risk)
        flags = F.when(winners[i], F.col(f"_f{i}")).when(go_on, flags)
    return (
        wide.withColumn("_outcome", outcome)
        .withColumn("verified", F.when(F.col("_outcome") == "verified", F.lit(True)).when(F.col("_outcome") == "unverified", F.lit(False)))
        .select(
            key,
            "verified",
            F.when(F.col("_outcome") == "verified", risk).when(F.col("_outcome") == "unverified", F.lit("unknown")).alias("risk"),
            F.when(F.col("_outcome") == "verified", flags).alias("flags"),
        )
    )


def tokens_needing_audit(pairs: DataFrame, columns: tuple[str, ...] = ("token_a", "token_b")) -> DataFrame:
    """Distinct pair members that are not curated tokens; a raw address is what an audit is for."""
    known = [address for address, _ in config.TOKEN_ALIASES.values()]
    members = pairs.select(F.explode(F.array(*[F.lower(c) for c in columns])).alias("token"))
    return members.filter(~F.col("token").isin(known)).distinct()


def audit_rollup(entries: DataFrame, key: str = "pair_id") -> DataFrame:
    """Three separate warnings per pair: unverified, verified but high-risk, unreachable.

    Entries have a boolean `reached`. A pair has two members, so each list has at most two symbols.
    """
    reached = F.coalesce(F.col("reached"), F.lit(False))
    verified = F.coalesce(F.col("verified"), F.lit(False))

    def symbols(cond: Column, name: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("symbol")))), ", ").alias(name)

    return entries.groupBy(key).agg(
        symbols(reached & ~verified, "unverified"),
        symbols(reached & verified & (F.col("risk") == "high"), "high_risk"),
        symbols(~reached, "unreachable"),
    )


def report_badge(verified: Column, risk: Column) -> Column:
    light = D.pick(risk, D.RISK_LIGHTS, D.RISK_LIGHTS["unknown"])
    mark = F.when(verified, F.lit(D.VERIFIED_MARK)).otherwise(F.lit(D.UNVERIFIED_MARK))
    return F.when(verified.isNull(), F.lit(D.NO_AUDIT_MARK)).otherwise(F.concat(mark, light))


def audit_report(df: DataFrame) -> DataFrame:
    """Add badge, one-line summary, caveat class and the full report text of each audited token.

    Input: token, symbol, verified, risk, flags (array). A NULL verdict is "could not be reached".
    """
    verified, risk = F.col("verified"), F.col("risk")
    badge = report_badge(verified, risk)
    link = D.token_link(F.col("token"))
    listed = F.array_join("flags", ", ")
    some = F.coalesce(F.size("flags") > 0, F.lit(False))
    name = F.concat(F.lit("<b>"), F.col("symbol"), F.lit("</b> "), link)
    line = F.when(
        verified.isNull(), F.concat(F.lit(D.NO_AUDIT_MARK + " "), name, F.lit(" — audit unavailable, retry"))
    ).otherwise(
        F.concat(badge, F.lit(" "), name, F.when(some, F.concat(F.lit(" · <i>"), listed, F.lit("</i>"))).otherwise(F.lit("")))
    )
    caveat = (
        F.when(verified.isNull(), F.lit("unreachable"))
        .when(~verified, F.lit("unverified"))
        .when(risk == "high", F.lit("high"))
        .when(risk == "clean", F.lit("clean"))
        .otherwise(F.lit("none"))
    )
    # --- fixed values: report sentences ---
    sentences = {
        "unverified": "<i>The source is not published, so it could not be scanned at all. ⬜ means unknown, not safe.</i>",
        "high": "<i>Flags above are rug-enabling powers. On an established token they are often normal — read the flags rather than treating 🔴 as a verdict.</i>",
        "clean": "<i>Heuristic and deliberately non-exhaustive — clean is not a safety guarantee.</i>",
    }
    head = F.concat(F.lit("🔎 "), name)
    note = D.pick(caveat, sentences, None)
    full = F.concat_ws(
        "\n",
        head,
        F.when(verified, F.lit("source   ✅ verified on the explorer")).otherwise(
            F.lit("source   ⚠️ no verified source published")
        ),
        F.concat(F.lit("risk     "), badge, F.lit(" "), risk),
        F.when(some, F.concat(F.lit("flags    "), listed)),
        F.when(note.isNotNull(), F.concat(F.lit("\n"), note)),
    )
    missing = F.concat(
        head, F.lit("\n<i>audit unavailable — the explorer lookup failed. Nothing is cached, so try again.</i>")
    )
    return (
        df.withColumn("badge", badge)
        .withColumn("line", line)
        .withColumn("caveat", caveat)
        .withColumn("report", F.when(verified.isNull(), missing).otherwise(full))
    )
