"""Checks of responses: ordered redaction, the output filter, stage pipelines, secret tokens and data leakage."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.functions.regex import Rx, any_found
from sievework.operators.common import finding, flags, points, present, text_of, weighted


def redact(text: Column) -> Column:
    """Sensitive data replaced rule by rule; later rules see what earlier ones left."""
    for _, rx, by in R.REDACTION:
        text = rx.replace(text, by)
    return text


def redact_report(df: DataFrame, text: str = "text") -> DataFrame:
    """df with redacted_text, redaction_count and redacted_types (in order of the rules)."""
    df = df.withColumn("_s0", text_of(text))
    for i, (_, rx, by) in enumerate(R.REDACTION):
        now = F.col(f"_s{i}")
        df = df.withColumns({f"_n{i}": rx.count(now), f"_s{i + 1}": rx.replace(now, by)})
    n = len(R.REDACTION)
    total = F.lit(0)
    for i in range(n):
        total = total + F.col(f"_n{i}")
    types = present(F.when(F.col(f"_n{i}") > 0, name) for i, (name, _, _) in enumerate(R.REDACTION))
    df = df.withColumns({"redacted_text": F.col(f"_s{n}"), "redaction_count": total, "redacted_types": types})
    return df.drop(*(f"_s{i}" for i in range(n + 1)), *(f"_n{i}" for i in range(n)))


def filter_output(df: DataFrame, text: str = "text", redact_pii: bool = True, threshold: float = 0.8) -> DataFrame:
    """df with decision, risk_score, risk_flags (sorted), filtered_output and reason."""
    t = text_of(text)
    df = df.withColumns({f"_r{i}": rx.found(t) for i, (_, _, rx) in enumerate(R.OUTPUT_RISK)})
    hit = [F.col(f"_r{i}") for i in range(len(R.OUTPUT_RISK))]
    df = df.withColumns({"_score": F.least(F.lit(1.0), weighted(zip(hit, (w for _, w, _ in R.OUTPUT_RISK), strict=True))), "risk_flags": flags(zip(hit, (f for f, _, _ in R.OUTPUT_RISK), strict=True)), "_out": redact(t) if redact_pii else t})
    blocked = F.col("_score") >= threshold
    decision = F.when(blocked, "BLOCK").when(F.size("risk_flags") > 0, "SEND_TO_REVIEW").when(F.col("_out") != t, "PASS_REDACTED").otherwise("PASS")
    df = df.withColumns({"decision": decision, "risk_score": F.round("_score", 4), "filtered_output": F.when(blocked, F.lit(R.SAFE_ERROR)).otherwise(F.col("_out")), "reason": F.when(blocked, F.lit("Output blocked due to high-risk content."))})
    return df.drop("_score", "_out", *(f"_r{i}" for i in range(len(R.OUTPUT_RISK))))


@dataclass(frozen=True)
class StageColumns:
    """What a stage makes of a text: its decision, text, flags and weight."""

    decision: Column
    text: Column
    flags: Column
    weight: Column


class Stage(Protocol):
    """Any object with a name and this method can stand in a pipeline.

    A stage may also have steps(df, text, on, prefix), which first adds columns of its own (their names begin with prefix) to
    df, so that its patterns run once, and only where on holds."""

    name: str

    def columns(self, text: Column) -> StageColumns: ...


def _when_any(flag_array: Column, decision: str) -> Column:
    return F.when(F.size(flag_array) > 0, decision).otherwise("PASS")


def _tested(df: DataFrame, tests: list[Column], on: Column, prefix: str) -> tuple[DataFrame, list[Column]]:
    """df with a column for each test, worked out once and only where on holds."""
    names = [f"{prefix}{j}" for j in range(len(tests))]
    return df.withColumns({n: on & t for n, t in zip(names, tests, strict=True)}), [F.col(n) for n in names]


class _Tests:
    """A stage whose columns follow from some tests of the text."""

    def tests(self, text: Column) -> list[Column]:
        raise NotImplementedError

    def made(self, hit: list[Column], text: Column) -> StageColumns:
        raise NotImplementedError

    def columns(self, text: Column) -> StageColumns:
        return self.made(self.tests(text), text)

    def steps(self, df: DataFrame, text: Column, on: Column, prefix: str) -> tuple[DataFrame, StageColumns]:
        df, hit = _tested(df, self.tests(text), on, prefix)
        return df, self.made(hit, text)


@dataclass(frozen=True)
class SecretLeak(_Tests):
    """Any secret blocks; the weight is the largest one."""

    name: str = "secret_leak"

    def tests(self, text: Column) -> list[Column]:
        return [rx.found(text) for _, _, rx in R.STAGE_SECRETS]

    def made(self, hit: list[Column], text: Column) -> StageColumns:
        found = present(F.when(c, name) for c, (name, _, _) in zip(hit, R.STAGE_SECRETS, strict=True))
        decision = F.when(F.size(found) > 0, "BLOCK").otherwise("PASS")
        weight = F.greatest(F.lit(0.0), *(F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, (_, w, _) in zip(hit, R.STAGE_SECRETS, strict=True)))
        return StageColumns(decision, F.when(F.size(found) > 0, F.lit(R.SAFE_ERROR)).otherwise(text), found, weight)


@dataclass(frozen=True)
class PiiRedaction:
    """Redacts in order on the text so far; the weight is the capped sum."""

    name: str = "pii_redaction"

    def columns(self, text: Column) -> StageColumns:
        now, hit = text, []
        for _, _, rx, by in R.STAGE_PII:
            hit.append(rx.found(now))
            now = rx.replace(now, by)
        return self.made(hit, now)

    def made(self, hit: list[Column], now: Column) -> StageColumns:
        found = present(F.when(c, name) for c, (name, *_) in zip(hit, R.STAGE_PII, strict=True))
        return StageColumns(_when_any(found, "PASS_REDACTED"), now, found, F.least(F.lit(1.0), weighted((c, w) for c, (_, w, _, _) in zip(hit, R.STAGE_PII, strict=True))))

    def steps(self, df: DataFrame, text: Column, on: Column, prefix: str) -> tuple[DataFrame, StageColumns]:
        now, hit = text, []
        for j, (_, _, rx, by) in enumerate(R.STAGE_PII):
            df, own = _tested(df, [rx.found(now)], on, f"{prefix}h{j}_")
            df = df.withColumn(f"{prefix}t{j}", F.when(own[0], rx.replace(now, by)).otherwise(now))
            now, hit = F.col(f"{prefix}t{j}"), hit + own
        return df, self.made(hit, now)


@dataclass(frozen=True)
class SystemPromptLeak(_Tests):
    name: str = "system_prompt_leak"

    def tests(self, text: Column) -> list[Column]:
        return [rx.found(text) for _, rx in R.STAGE_PROMPT]

    def made(self, hit: list[Column], text: Column) -> StageColumns:
        found = present(F.when(c, name) for c, (name, _) in zip(hit, R.STAGE_PROMPT, strict=True))
        return StageColumns(_when_any(found, "FLAGGED"), text, found, F.when(F.size(found) > 0, F.lit(0.4)).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class InternalNetwork(_Tests):
    name: str = "internal_network"

    def tests(self, text: Column) -> list[Column]:
        return [R.STAGE_NETWORK.found(text)]

    def made(self, hit: list[Column], text: Column) -> StageColumns:
        found = present([F.when(hit[0], "private_ip_address")])
        return StageColumns(_when_any(found, "PASS_REDACTED"), F.when(hit[0], R.STAGE_NETWORK.replace(text, "[REDACTED:PRIVATE_IP]")).otherwise(text), found, F.when(hit[0], F.lit(0.25)).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class PolicyViolation(_Tests):
    """Block patterns come before flag patterns (pattern, flag); all ignore case."""

    block: tuple[str, ...] = ()
    flag: tuple[tuple[str, str], ...] = ()
    name: str = "policy_violation"

    def tests(self, text: Column) -> list[Column]:
        return [any_found(text, tuple(Rx(p, "i") for p in self.block)), *(Rx(p, "i").found(text) for p, _ in self.flag)]

    def made(self, hit: list[Column], text: Column) -> StageColumns:
        blocked, noted = hit[0], present(F.when(c, name) for c, (_, name) in zip(hit[1:], self.flag, strict=True))
        found = F.when(blocked, F.array(F.lit("policy_block"))).otherwise(noted)
        weight = F.when(blocked, F.lit(1.0)).otherwise(F.least(F.lit(1.0), weighted((c, 0.3) for c in hit[1:])))
        return StageColumns(F.when(blocked, "BLOCK").otherwise(_when_any(noted, "FLAGGED")), F.when(blocked, F.lit(R.SAFE_ERROR)).otherwise(text), found, weight)


def _flag_of(stage: str):
    return lambda x: F.struct(F.lit(stage).alias("stage"), x.alias("flag"))


#: From mildest to worst.
DECISIONS = ("PASS", "PASS_REDACTED", "FLAGGED", "BLOCK")


@dataclass
class Pipeline:
    """Stages in order over a text; the first block ends the run."""

    stages: list[Stage] = field(default_factory=lambda: [SecretLeak(), PiiRedaction(), SystemPromptLeak(), InternalNetwork()])

    def add_stage(self, stage: Stage) -> Pipeline:
        self.stages.append(stage)
        return self

    def __len__(self) -> int:
        return len(self.stages)

    def run(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with decision, final_output, risk_score, stage_flags (stage, flag), stages_run, blocked_by, was_blocked, was_redacted, all_flags."""
        rank = F.create_map(*(x for i, d in enumerate(DECISIONS) for x in (F.lit(d), F.lit(i))))
        df = df.withColumns({"_text": text_of(text), "_worst": F.lit(0), "_risk": F.lit(0.0), "_by": F.lit(None).cast("string"), "_flags": F.array().cast("array<struct<stage:string,flag:string>>"), "_run": F.array().cast("array<struct<stage:string,decision:string,weight:double>>")})
        for i, stage in enumerate(self.stages):
            on, before = F.col("_by").isNull(), df.columns
            steps = getattr(stage, "steps", None)
            df, made = steps(df, F.col("_text"), on, f"_s{i}_") if steps else (df, stage.columns(F.col("_text")))
            df = df.withColumns({f"_d{i}": made.decision, f"_t{i}": made.text, f"_f{i}": made.flags, f"_w{i}": made.weight})
            df = df.withColumns(
                {
                    "_text": F.when(on, F.col(f"_t{i}")).otherwise(F.col("_text")),
                    "_worst": F.when(on, F.greatest("_worst", rank[F.col(f"_d{i}")])).otherwise(F.col("_worst")),
                    "_risk": F.when(on, F.col("_risk") + F.col(f"_w{i}")).otherwise(F.col("_risk")),
                    "_flags": F.when(on, F.concat("_flags", F.transform(f"_f{i}", _flag_of(stage.name)))).otherwise(F.col("_flags")),
                    "_run": F.when(on, F.concat("_run", F.array(F.struct(F.lit(stage.name).alias("stage"), F.col(f"_d{i}").alias("decision"), F.col(f"_w{i}").alias("weight"))))).otherwise(F.col("_run")),
                    "_by": F.when(on & (F.col(f"_d{i}") == "BLOCK"), F.lit(stage.name)).otherwise(F.col("_by")),
                }
            ).select(*before)
        names = F.array(*map(F.lit, DECISIONS))
        # the optimizer moves no filter below a column that is not deterministic, where it would work out all stages anew for it
        sealed = lambda c: F.when(F.monotonically_increasing_id() >= 0, c)
        made = {"decision": F.element_at(names, F.col("_worst") + 1), "final_output": F.col("_text"), "risk_score": F.round(F.least(F.col("_risk"), F.lit(1.0)), 4), "stage_flags": F.col("_flags"), "stages_run": F.col("_run"), "blocked_by": F.col("_by")}
        df = df.withColumns({name: sealed(c) for name, c in made.items()})
        df = df.withColumns({"was_blocked": F.col("decision") == "BLOCK", "was_redacted": F.col("decision") == "PASS_REDACTED", "all_flags": F.transform("stage_flags", lambda x: x["flag"])})
        return df.drop("_text", "_worst", "_risk", "_by", "_flags", "_run")


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters in bits."""
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def likely_secret(token: Column) -> Column:
    """Neither all letters nor all digits, of two kinds of characters at least, and of high entropy."""
    kinds = sum((token.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[_\-+/=]")), F.lit(0))
    return ~token.rlike(r"^(?:[A-Za-z]+|[0-9]+)$") & (kinds >= 2) & (entropy(token) >= R.TOKEN_ENTROPY)


def filter_secrets(df: DataFrame, text: str = "text", action: str = "redact") -> DataFrame:
    """df with content, action, reasons and secrets: tokens that look like secrets, replaced longest first, or the text blocked."""
    t = text_of(text)
    sure = F.flatten(F.array(*(p.all(t) for p in R.TOKEN_PATTERNS)))
    df = df.withColumns({"_sure": sure, "_long": R.TOKEN_LONG.all(t)})
    tokens = F.array_distinct(F.concat("_sure", F.filter("_long", likely_secret)))
    df = df.withColumn("secrets", F.array_sort(tokens, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)))
    some = F.size("secrets") > 0
    redacted = F.aggregate("secrets", t, lambda s, x: F.replace(s, x, F.lit("[REDACTED_SECRET]")))
    content = F.when(~some, t).otherwise(F.lit("[BLOCKED: potential secret leakage]") if action == "block" else redacted)
    return df.withColumns({"content": content, "action": F.when(some, action).otherwise("allow"), "reasons": F.when(some, F.array(F.lit("secret_detected"))).otherwise(F.array().cast("array<string>"))}).drop("_sure", "_long")


def _bound(value: Column, f) -> Column:
    """f of value, which is worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_window(t: Column, window: int = 200, step: int = 50) -> Column:
    """Two equal windows among those that start at multiples of step, which must divide window.

    The text is cut into blocks of a step once, and windows are runs of blocks, so the work is linear in its length."""
    k = window // step
    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{{step}}}"), F.lit(0))
    runs = lambda b: F.transform(F.sequence(F.lit(1), F.size(b) - k + 1), lambda i: F.concat(*(F.element_at(b, i + j) for j in range(k))))
    again = _bound(blocks, lambda b: F.when(F.size(b) > k, _bound(runs(b), lambda r: F.size(r) > F.size(F.array_distinct(r)))))
    return F.coalesce(F.when(F.length(t) >= window, again), F.lit(False))


def text_wall(t: Column, least: int = 500, share: float = 0.95) -> Column:
    """A line of 500 characters or more that are nearly all printable ASCII."""
    return F.exists(F.split(t, "\n+"), lambda s: (F.length(s) >= least) & (F.regexp_count(s, F.lit(r"[\x09-\x0d\x20-\x7e]")) / F.length(s) > share))


def analyze_leakage(df: DataFrame, text: str = "text", block_on: str = "CRITICAL") -> DataFrame:
    """df with findings, risk_score, should_block (a finding of exactly that severity) and redacted_response."""
    t = text_of(text)
    checks = [(c, severity, weight, title, any_found(t, tuple(p for p, _ in pairs))) for c, severity, weight, title, pairs in R.LEAKAGE]
    name, severity, weight, title = R.LEAK_REPEAT
    checks.append((name, severity, weight, title, repeated_window(t) | text_wall(t)))
    df = df.withColumns({f"_c{i}": c[4] for i, c in enumerate(checks)})
    hit = [F.col(f"_c{i}") for i in range(len(checks))]
    found = present(finding(h, check_id=c[0], severity=c[1], title=c[3], weight=c[2]) for h, c in zip(hit, checks, strict=True))
    out = t
    for _, _, _, _, pairs in R.LEAKAGE:
        for rx, by in pairs:
            out = rx.replace(out, by)
    df = df.withColumns({"findings": found, "risk_score": points(zip(hit, (c[2] for c in checks), strict=True)), "should_block": F.exists(found, lambda f: f["severity"] == block_on), "redacted_response": out})
    return df.drop(*(f"_c{i}" for i in range(len(checks))))
