"""Checks of retrieved documents: poisoning, source and size limits, indirect injection, and a sanitiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.operators.common import points, present, strip, text_of
from sievework.operators.inputs import detect_injection


def _distinct_matches(t: Column, patterns) -> Column:
    """All matches of all patterns, the first of those equal but for case and outer white space."""
    found = F.flatten(F.array(*(p.all(t) for p in patterns)))
    keys = F.transform(found, lambda x: F.lower(strip(x)))
    return F.filter(found, lambda x, i: F.array_position(keys, F.lower(strip(x))) == i + 1)


def _lenient(run: Column) -> Column:
    """The text of a base64 run; its own padding may be wrong, bad UTF-8 is dropped. Null for one character above whole quads."""
    bare = F.regexp_replace(run, "=+$", "")
    padded = F.concat(bare, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4))))
    text = F.translate(F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")), "\ufffd", "")
    return F.when(F.length(bare) % 4 != 1, text)


def payloads(t: Column) -> Column:
    """Decoded base64 runs, in lower case, that hold a keyword; one for each first 80 characters."""
    decoded = F.transform(R.RAG_BASE64.all(t), lambda x: F.lower(_lenient(x)))
    held = F.filter(decoded, lambda x: F.coalesce(x.rlike("|".join(R.RAG_KEYWORDS)), F.lit(False)))
    return F.array_distinct(F.transform(held, lambda x: F.substring(x, 1, 80)))


def _match_of(check: str, severity: str):
    return lambda x: F.struct(F.lit(check).alias("check_id"), F.lit(severity).alias("severity"), x.alias("matched"))


def detect_poisoning(df: DataFrame, text: str = "text", threshold: int = 0, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """df with matches (check_id, severity, matched), risk_score and is_poisoned.

    Each check's weight counts once however many matches it has. With a threshold the score must exceed it. An empty tuple
    of enabled checks means none."""
    t = text_of(text)
    checks = {c: (sev, w, _distinct_matches(t, patterns)) for c, sev, w, patterns in R.POISONING}
    c, sev, w, patterns = R.RAG_HIDDEN
    checks[c] = (sev, w, present(F.when(p.found(t), F.lit(name)) for p, name in zip(patterns, ("zero-width", "padding"), strict=True)))
    c, sev, w = R.RAG_PAYLOAD
    checks[c] = (sev, w, payloads(t))
    checks = {k: checks[k] for k in sorted(checks) if enabled is None or k in enabled}
    df = df.withColumns({f"_{k}": v[2] for k, v in checks.items()})
    rows = [F.transform(F.col(f"`_{k}`"), _match_of(k, v[0])) for k, v in checks.items()]
    matches = F.flatten(F.array(*rows)) if rows else F.array().cast("array<struct<check_id:string,severity:string,matched:string>>")
    score = points((F.size(F.col(f"`_{k}`")) > 0, v[1]) for k, v in checks.items())
    df = df.withColumns({"matches": matches, "risk_score": score})
    return df.withColumn("is_poisoned", F.col("risk_score") > threshold if threshold > 0 else F.size("matches") > 0).drop(*(f"_{k}" for k in checks))

LEVELS = ("clean", "low", "medium", "high", "critical")

def check_documents(df: DataFrame, source: str = "source", text: str = "text", allowed: tuple[str, ...] | None = None, most_chars: int = 8000, least_risk: str = "medium") -> DataFrame:
    """df with issues (source_not_allowed, too_long, injection), risk_level and passed.

    A source is allowed if it holds one of the allowed strings; None allows all."""
    df = detect_injection(df, text, "indirect")
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("risk_level"))
    fine = F.lit(True)
    if allowed is not None:
        fine = F.lit(False)
        for part in allowed:
            fine = fine | F.contains(text_of(source), F.lit(part))
    issues = present([F.when(~fine, "source_not_allowed"), F.when(F.length(text_of(text)) > most_chars, "too_long"), F.when(rank > LEVELS.index(least_risk), "injection")])
    return df.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0).drop("is_clean", "high_confidence_count", "signal_categories")

def validate_contexts(checked: DataFrame, context: str, text: str = "text", most_chars: int = 32_000) -> DataFrame:
    """(context, n_documents, n_flagged, total_chars, too_large, passed) from checked documents; size alone only warns."""
    out = checked.groupBy(context).agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(~F.col("passed"), 1)).alias("n_flagged"), F.sum(F.length(text_of(text))).cast("long").alias("total_chars"))
    return out.withColumns({"too_large": F.col("total_chars") > most_chars, "passed": F.col("n_flagged") == 0})

def safe_documents(checked: DataFrame, quarantine: bool = True) -> DataFrame:
    return checked.where(F.col("passed")) if quarantine else checked

def sanitize_documents(df: DataFrame, text: str = "text", replacement: str = R.SANITISED) -> DataFrame:
    """df with sanitized_text and removed_matches; white space is collapsed in any text that is not empty."""
    df = df.withColumn("_s0", text_of(text))
    for i, p in enumerate(R.SANITISE):
        df = df.withColumns({f"_n{i}": p.count(F.col(f"_s{i}")), f"_s{i + 1}": p.replace(F.col(f"_s{i}"), replacement)})
    n = len(R.SANITISE)
    total = F.lit(0)
    for i in range(n):
        total = total + F.col(f"_n{i}")
    clean = F.trim(F.regexp_replace(F.col(f"_s{n}"), r"(?U)[\s\x{1c}-\x{1f}]+", " "))
    return df.withColumns({"sanitized_text": clean, "removed_matches": total}).drop(*(f"_s{i}" for i in range(n + 1)), *(f"_n{i}" for i in range(n)))

