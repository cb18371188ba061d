"""Checks of prompts: validation, exfiltration, adversarial inputs, prompt injection, and the second scanner."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievework.functions import rules as R
from sievework.functions.regex import any_found, first_found
from sievework.operators.common import finding, flags, points, present, text_of, weighted
from sievework.sources.rulesets import RegexRule


def normalised(text: Column) -> Column:
    """Lower case, leet characters as letters, runs of other characters as one space."""
    return R.NOISE.replace(F.translate(F.lower(text), R.LEET_FROM, R.LEET_TO), " ")


def validate_input(df: DataFrame, text: str = "text", max_length: int = 10_000, threshold: float = 0.7, custom: tuple[RegexRule, ...] = ()) -> DataFrame:
    """df with decision, risk_score, risk_flags (sorted), reason and original_length.

    Each rule adds its own weight, also where rules share a flag; the decision falls before the score is rounded."""
    t = text_of(text)
    df = df.withColumns({"_t": t, "_n": normalised(t)})
    raw, plain = F.col("_t"), F.col("_n")
    fired = [(p.found(raw) | p.found(plain), flag, R.INJECTION_WEIGHT) for flag, p in R.INPUT_INJECTION]
    fired += [(p.found(raw), flag, R.SENSITIVE_WEIGHT) for flag, p in R.INPUT_SENSITIVE]
    fired += [(r.rx.found(raw), r.flag, r.score) for r in custom]
    df = df.withColumns({f"_r{i}": c for i, (c, _, _) in enumerate(fired)})
    hit = [F.col(f"_r{i}") for i in range(len(fired))]
    df = df.withColumns({"_score": F.least(F.lit(1.0), weighted(zip(hit, (w for _, _, w in fired), strict=True))), "_flags": flags(zip(hit, (f for _, f, _ in fired), strict=True)), "original_length": F.length("_t")})
    long = F.col("original_length") > max_length
    decision = (
        F.when(long, "BLOCK")
        .when((F.col("_score") >= threshold) & (F.col("_score") >= 0.9), "BLOCK")
        .when(F.col("_score") >= threshold, "SEND_TO_REVIEW")
        .when(F.size("_flags") > 0, "ALLOW_WITH_WARNING")
        .otherwise("ALLOW")
    )
    df = df.withColumns(
        {
            "decision": decision,
            "risk_score": F.when(long, F.lit(1.0)).otherwise(F.round("_score", 4)),
            "risk_flags": F.when(long, F.array(F.lit("input_too_long"))).otherwise(F.col("_flags")),
            "reason": F.when(long, F.lit(f"Input exceeds maximum length of {max_length} characters.")),
        }
    )
    df = df.withColumn("is_allowed", F.col("decision").isin("ALLOW", "ALLOW_WITH_WARNING"))
    return df.drop("_t", "_n", "_score", "_flags", *(f"_r{i}" for i in range(len(fired))))


def detect_exfiltration(df: DataFrame, text: str = "text", block_threshold: int = 0, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """df with matches (one for each check, its first pattern's match), risk_score, is_exfiltration, highest_risk, input_preview.

    No enabled checks named, or an empty tuple, means all of them."""
    checks = [c for c in R.EXFILTRATION if not enabled or c[0] in enabled]
    df = df.withColumns({f"_m{i}": any_found(text_of(text), c[5]) for i, c in enumerate(checks)})
    hit = [F.col(f"_m{i}") for i in range(len(checks))]
    matches = present(finding(h, check_id=c[0], risk=c[1], action=c[2], title=c[4], matched=first_found(text_of(text), c[5])) for h, c in zip(hit, checks, strict=True))
    blocked = F.lit(False)
    for h, c in zip(hit, checks, strict=True):
        blocked = blocked | (h if c[2] == "BLOCK" else F.lit(False))
    score = points(zip(hit, (c[3] for c in checks), strict=True))
    highest = F.lit(None).cast("string")
    for risk in ("LOW", "MEDIUM", "HIGH", "CRITICAL"):
        for h, c in zip(hit, checks, strict=True):
            highest = F.when(h, F.lit(risk)).otherwise(highest) if c[1] == risk else highest
    df = df.withColumns({"matches": matches, "risk_score": score, "is_exfiltration": blocked | (score >= block_threshold if block_threshold > 0 else F.lit(False)), "highest_risk": highest, "input_preview": F.substring(text_of(text), 1, 200)})
    return df.drop(*(f"_m{i}" for i in range(len(checks))))


def char_similarity(a: Column, b: Column) -> Column:
    """The share of a's characters that occur in b; 0 if either is empty."""
    held = F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))  # without the characters of b the others are left
    return F.when((F.length(a) > 0) & (F.length(b) > 0), held / F.length(a)).otherwise(F.lit(0.0))


def sanitised(text: Column, most: int = 120) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, most), r"[\x00-\x1f\x7f-\x9f]", "�")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("..."))).otherwise(cut)


def _near(text: Column, pattern) -> Column:
    """The first match with 20 characters before and 40 after it."""
    at, m = F.regexp_instr(text, F.lit(pattern.java)), F.regexp_extract(text, pattern.java, 0)
    start = F.greatest(at - 20, F.lit(1))
    return sanitised(F.substring(text, start, at - start + F.length(m) + 40))


def _encoded(t: Column) -> Column:
    """A base64 run, a hex run but for a lone 40-digit one, or many percent escapes."""
    run, at = F.regexp_extract(t, R.ADV_HEX.java, 0), F.regexp_instr(t, F.lit(R.ADV_HEX.java))
    blank = lambda c: (c == "") | c.isin(" ", "\t", "\n", "\r")
    before, after = F.when(at > 1, F.substring(t, at - 1, F.lit(1))).otherwise(""), F.substring(t, at + F.length(run), F.lit(1))
    hexed = (F.length(run) > 40) | ((F.length(run) == 40) & ~(blank(before) & blank(after)))
    return R.ADV_BASE64.found(t) | hexed | ((F.length(t) > 0) & (R.ADV_PERCENT.count(t) / F.length(t) > 0.30))


def detect_adversarial(df: DataFrame, text: str = "text", session: str | None = None, order: str | None = None) -> DataFrame:
    """df with findings (check_id, severity, title, weight, evidence), risk_score and action.

    With session and order, an input like each of the three before it in its session also counts as an extraction probe."""
    t = text_of(text)
    similar = F.lit(False)
    if session and order:
        w = W.partitionBy(session).orderBy(order)
        before = [F.lag(t, k).over(w) for k in (1, 2, 3)]
        df = df.withColumns({f"_h{k}": b for k, b in enumerate(before)})
        similar = F.lit(True)
        for k in range(3):
            similar = similar & F.coalesce(char_similarity(F.col(f"_h{k}"), t) > 0.80, F.lit(False))
    letters = R.ADV_ALPHA.count(t)
    fired = {
        "ADV-001": R.ADV_ENUMERATION.found(t) | similar,
        "ADV-002": R.ADV_MEMBERSHIP.found(t),
        "ADV-003": R.ADV_ZERO_WIDTH.found(t) | R.ADV_CONTROL.found(t) | R.ADV_FORMAT.found(t),
        "ADV-004": F.coalesce((letters > 0) & (R.ADV_LEET.count(t) / F.nullif(letters, F.lit(0)) > 0.20), F.lit(False)),
        "ADV-005": _encoded(t),
        "ADV-006": (F.length(t) > 5000) & (R.ADV_POSITIVE.count(t) > 5) & (R.ADV_NEGATIVE.count(t) > 5),
        "ADV-007": R.ADV_INVERSION.found(t),
    }
    evidence = {"ADV-002": _near(t, R.ADV_MEMBERSHIP), "ADV-007": _near(t, R.ADV_INVERSION)}
    df = df.withColumns({f"_{k}": c for k, c in fired.items()})
    hit = {k: F.col(f"`_{k}`") for k in fired}
    found = present(finding(hit[k], check_id=k, severity=v[0], title=v[2], weight=v[1], evidence=evidence.get(k, F.lit("")) if k in evidence else F.lit("")) for k, v in R.ADVERSARIAL.items())
    score = points((hit[k], v[1]) for k, v in R.ADVERSARIAL.items())
    df = df.withColumns({"findings": found, "risk_score": score, "action": F.when(score >= 60, "BLOCK").when(score >= 25, "REVIEW").otherwise("ALLOW")})
    return df.drop("_h0", "_h1", "_h2", *(f"_{k}" for k in fired))


def detect_injection(df: DataFrame, text: str = "text", source_type: str = "direct", templates: bool = True) -> DataFrame:
    """df with signals, risk_level, is_clean, high_confidence_count and signal_categories.

    Indirect sources and tool outputs are judged by rules of their own; template rules come last. Matches are cut to 100."""
    table = (R.INJECTION_INDIRECT if source_type in ("indirect", "tool_output") else R.INJECTION_DIRECT) + (R.INJECTION_TEMPLATE if templates else ())
    df = df.withColumns({f"_s{i}": rule[4].first(text_of(text)) for i, rule in enumerate(table)})
    cut = lambda c: F.when(F.length(c) > 100, F.concat(F.substring(c, 1, 97), F.lit("..."))).otherwise(c)
    signals = present(finding(F.col(f"_s{i}").isNotNull(), rule_id=r[0], confidence=r[1], category=r[2], description=r[3], matched_text=cut(F.col(f"_s{i}"))) for i, r in enumerate(table))
    df = df.withColumn("signals", signals).drop(*(f"_s{i}" for i in range(len(table))))
    count = lambda level: F.size(F.filter("signals", lambda s: s["confidence"] == level))
    high = count("HIGH")
    level = F.when(high >= 2, "critical").when(high == 1, "high").when(count("MEDIUM") > 0, "medium").when(F.size("signals") > 0, "low").otherwise("clean")
    return df.withColumns({"risk_level": level, "is_clean": F.size("signals") == 0, "high_confidence_count": high, "signal_categories": F.array_distinct(F.transform("signals", lambda s: s["category"]))})


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.str.normalize("NFKC")


def scan_input(df: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """df with normalized_text, normalization_applied, blocked, risk_score and reasons of the second scanner.

    Compatibility forms are folded by an Arrow function, the only step here that Spark lacks; then all control and format
    characters go, line ends and tabs among them. nfkc=False leaves that step out for text known to be folded."""
    folded = _nfkc(text_of(text)) if nfkc else text_of(text)
    df = df.withColumn("normalized_text", F.regexp_replace(folded, r"[\p{Cc}\p{Cf}]", ""))
    reasons = present(F.when(p.found(F.col("normalized_text")), F.lit(p.text)) for p in R.SCANNER)
    df = df.withColumns({"normalization_applied": F.col("normalized_text") != text_of(text), "reasons": reasons})
    return df.withColumns({"blocked": F.size("reasons") > 0, "risk_score": F.least(F.lit(1.0), F.lit(0.35) * F.size("reasons"))})
