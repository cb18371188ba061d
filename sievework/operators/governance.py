"""Policy decisions, request guards, audit events and audit chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.regex import Rx
from sievework.operators.common import folded, present
from sievework.sources.policy import Policy, action

GENESIS = "0" * 64


def evaluate_input(df: DataFrame, policy: Policy, score: str = "risk_score", flag_column: str = "risk_flags") -> DataFrame:
    """df with action, policy_name, policy_version, reason and applied_rules.

    A milder action for injection signals lets later rules speak; for sensitive data only a block ends the matter."""
    s, fl = F.col(score), F.coalesce(F.col(flag_column), F.array().cast("array<string>"))
    injected = F.exists(fl, lambda f: f.rlike("injection|override|jailbreak"))
    sensitive = F.exists(fl, lambda f: f.rlike("credential|card|key"))
    on_injection, on_sensitive = action(policy.on_injection_signal), action(policy.on_sensitive_data)
    full = s >= 1.0
    stop_injection = injected & F.lit(on_injection in ("BLOCK", "SEND_TO_REVIEW"))
    stop_sensitive = sensitive & F.lit(on_sensitive == "BLOCK")
    over = s >= policy.input_risk_threshold
    taken = (
        F.when(full, "BLOCK").when(stop_injection, on_injection).when(stop_sensitive, on_sensitive).when(over, "SEND_TO_REVIEW").when(F.size(fl) > 0, "ALLOW_WITH_WARNING").otherwise("ALLOW")
    )
    steps = present([F.when(injected, "injection_signal_rule"), F.when(sensitive & ~stop_injection, "sensitive_data_rule"), F.when(over & ~stop_injection & ~stop_sensitive, "risk_threshold_rule")])
    rules = F.when(full, F.array(F.lit("max_risk_score"))).when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("default_allow")))
    reason = (
        F.when(full, "Input risk score is at maximum — blocked by policy.").when(stop_injection, "Injection signals detected").when(stop_sensitive, "Sensitive data detected in input").when(over, "Input risk score exceeds threshold").otherwise("Input passed all policy checks.")
    )
    return df.withColumns({"action": taken, "policy_name": F.lit(policy.name), "policy_version": F.lit(policy.version), "reason": reason, "applied_rules": rules})


def tool_allowed(df: DataFrame, policy: Policy, tool: str = "tool_name") -> DataFrame:
    return df.withColumn("tool_allowed", F.col(tool).isin(*policy.allowed_tools) if policy.tool_approval_required else F.lit(True))


def denied_phrases(df: DataFrame, phrases: tuple[str, ...], text: str = "text") -> DataFrame:
    """df with denied (the phrases that the text holds, whatever their case) and blocked."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("denied", present(F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases))
    return df.withColumn("blocked", F.size("denied") > 0)


def denied_patterns(df: DataFrame, patterns: tuple[Rx, ...], text: str = "text") -> DataFrame:
    """df with n_denied, how many of the patterns the text matches, and blocked."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.lit(0)
    for p in patterns:
        n = n + p.found(t).cast("int")
    return df.withColumn("n_denied", n).withColumn("blocked", F.col("n_denied") > 0)


def guard_size(df: DataFrame, most: int = 1_048_576, body: str = "body", length: str = "content_length") -> DataFrame:
    """df with status (413 or 200) and reason_code: the stated length counts, or without a number the body's own."""
    stated = F.expr(f"try_cast(`{length}` as bigint)")
    size = F.when(stated > most, stated).otherwise(F.coalesce(F.octet_length(body), stated, F.lit(0)).cast("long"))
    return df.withColumns({"body_size": size, "status": F.when(size > most, 413).otherwise(200), "reason_code": F.when(size > most, "request_too_large").otherwise("request_allowed")})


def guard_content_type(df: DataFrame, allowed: tuple[str, ...] = ("application/json",), header: str = "content_type") -> DataFrame:
    """df with media_type and status (415 or 200); parameters after ; don't count."""
    media = F.lower(F.trim(F.split_part(F.coalesce(F.col(header), F.lit("")), F.lit(";"), F.lit(1))))
    return df.withColumns({"media_type": media, "status": F.when(media.isin(*allowed), 200).otherwise(415)})


def with_request_id(df: DataFrame, header: str = "request_id") -> DataFrame:
    """df with request_id_out: the header's, or a new one (`req_` and 16 hex digits) that differs from run to run."""
    return df.withColumn("request_id_out", F.coalesce(F.nullif(F.col(header), F.lit("")), F.concat(F.lit("req_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))))


def audit_events(df: DataFrame, kind: str, policy: Policy, score: str = "risk_score", flag_column: str = "risk_flags", decision: str = "decision", text: str = "text", request_id: str | None = None, latency: str | None = None, user: str | None = None, session: str | None = None) -> DataFrame:
    """(event) JSON of each row: fields as the policy's switches say, never the text itself, only its length.

    kind is input or output; the columns named for request, latency (milliseconds), user and session are added, the last
    three only where they are not empty or 0."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    fields = [F.lit("input_validation" if kind == "input" else "output_filter").alias("event_type"), F.lit(policy.name).alias("policy_name"), F.lit(policy.version).alias("policy_version")]
    if request_id:
        fields.append(F.col(request_id).alias("request_id"))
    if policy.log_decisions:
        fields.append(F.col(decision).alias("decision"))
    if policy.log_risk_scores:
        fields += [F.round(score, 4).alias("risk_score"), F.col(flag_column).alias("risk_flags")]
    if policy.log_inputs if kind == "input" else policy.log_outputs:
        fields.append(F.length(text).alias(f"{kind}_length"))
    if latency:
        fields.append(F.nullif(F.round(F.col(latency).cast("double"), 2), F.lit(0.0)).alias("latency_ms"))
    fields += [filled(c).alias(name) for c, name in ((user, "user_id"), (session, "session_id")) if c]
    return df.select(F.to_json(F.struct(*fields)).alias("event")) if policy.audit_enabled else df.select(F.lit("").alias("event")).limit(0)


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all objects sorted, without spaces, other than ASCII characters as they are; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def emit_events(df: DataFrame, event_type: str, request_id: str = "request_id", payload: tuple[str, ...] = (), at: Column | None = None) -> DataFrame:
    """df with event: JSON with sorted keys of timestamp (UTC, now by default), event_type, request_id and the payload's columns.

    A payload column with one of the three names replaces it. A null request id is kept as null."""
    fields = {"timestamp": F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), "event_type": F.lit(event_type), "request_id": F.col(request_id)}
    fields |= {c: F.col(c) for c in payload}
    return df.withColumn("event", F.to_json(F.struct(*(c.alias(name) for name, c in sorted(fields.items()))), {"ignoreNullFields": "false"}))


def session_genesis(process_id: str, session_id: str) -> str:
    """The hash that a session's chain begins with."""
    return hashlib.sha256(f"audit-genesis:{process_id}:{session_id}".encode()).hexdigest()


def link_hash(canonical: Column, prev: Column, separator: str | None = None) -> Column:
    """sha256 of the event and the hash before it; with a separator, of the hash, the separator and the event."""
    return F.sha2(F.concat(canonical, prev) if separator is None else F.concat(prev, F.lit(separator), canonical), 256)


def chain(events: DataFrame, log: str = "log_id", order: str = "line_no", canonical: str = "canonical", separator: str | None = None, genesis: str = GENESIS) -> DataFrame:
    """(log, line_no, canonical, prev_hash, event_hash): each log's events chained in order, by a fold over the log.

    After a null event all hashes of its log are null."""

    def step(state: list, text: str | None) -> tuple[str | None, str | None]:
        (prev,) = state
        state[0] = None if prev is None or text is None else hashlib.sha256((text + prev if separator is None else prev + separator + text).encode()).hexdigest()
        return prev, state[0]

    df = events.select(log, F.col(order).cast("long").alias("line_no"), F.col(canonical).alias("canonical"))
    return folded(df, log, "line_no", F.col("canonical"), "prev_hash string, event_hash string", lambda: [genesis], step)


def verify_chain(lines: DataFrame, log: str = "log_id", separator: str | None = None, genesis: str = GENESIS) -> DataFrame:
    """(log, is_valid, first_bad_line, reason) of logs of (line_no, canonical, prev_hash, event_hash).

    Lines are checked against the one before them, in parallel. Blank lines keep their numbers and must be left out before."""
    w = W.partitionBy(log).orderBy("line_no")
    want = F.coalesce(F.lag("event_hash").over(w), F.lit(genesis))
    df = lines.withColumn("_want", want)
    broken = ~F.coalesce(F.col("prev_hash") == F.col("_want"), F.lit(False))
    changed = ~F.coalesce(link_hash(F.col("canonical"), F.col("prev_hash"), separator) == F.col("event_hash"), F.lit(False))
    reason = F.when(broken, "broken_link").when(changed, "tampered")
    out = df.groupBy(log).agg(F.min(F.when(reason.isNotNull(), F.struct("line_no", reason.alias("reason")))).alias("_bad"))
    return out.select(log, F.col("_bad").isNull().alias("is_valid"), F.col("_bad.line_no").alias("first_bad_line"), F.col("_bad.reason").alias("reason"))


def verify_sequence(events: DataFrame, log: str = "log_id", order: str = "idx", sequence: str = "sequence_id") -> DataFrame:
    """(log, is_valid, first_bad, problem): sequence ids (text or number) must rise by one from event to event."""
    w = W.partitionBy(log).orderBy(order)
    n = F.expr(f"case when cast(`{sequence}` as string) rlike '^-?[0-9]+$' then try_cast(`{sequence}` as bigint) end")
    df = events.withColumns({"_n": n, "_i": F.row_number().over(w)})
    df = df.withColumn("_p", F.lag("_n").over(w))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_p").isNotNull() & (F.col("_n") <= F.col("_p")), "out_of_order").when(F.col("_p").isNotNull() & (F.col("_n") != F.col("_p") + 1), "gap")
    out = df.groupBy(log).agg(F.min(F.when(problem.isNotNull(), F.struct("_i", problem.alias("problem")))).alias("_bad"))
    return out.select(log, F.col("_bad").isNull().alias("is_valid"), F.col("_bad._i").cast("long").alias("first_bad"), F.col("_bad.problem").alias("problem"))
