"""Audits of agent tool calls and decisions by tool policies."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.functions.regex import any_found
from sievework.operators.common import finding, folded, points, present


def _named(tool: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(tool), F.lit(w))
    return out


def _canonical(args: Column) -> Column:
    return F.to_json(F.array_sort(F.map_entries(args)))


def outside(path: Column, dirs: tuple[str, ...]) -> Column:
    """Under none of the directories, by whole components; without any: a climb or a sensitive root."""
    if not dirs:
        out = F.contains(path, F.lit(".."))
        for root in R.FS_ROOTS:
            out = out | F.startswith(path, F.lit(root))
        return out
    out = F.lit(True)
    for d in dirs:
        sep = "\\" if d.startswith("C:") else "/"
        out = out & (path != d) & ~F.startswith(path, F.lit(d.rstrip(sep) + sep))
    return out


def _bursts(calls: DataFrame, burst: int, window_ms: int) -> DataFrame:
    """calls with _burst: whether this call and those before it by seq, not older than window_ms, are more than burst.

    Times may fall, so no frame of a window holds these calls; but the burst latest times so far decide."""

    def step(latest: list, at: int | None) -> tuple[bool]:
        if at is None:
            return (False,)
        out = not burst or len(latest) >= burst and latest[-burst] >= at - window_ms
        insort(latest, at)
        del latest[:-burst]
        return (out,)

    return folded(calls, "session_id", "seq", F.col("timestamp_ms").cast("long"), "_burst boolean", list, step)


def audit_calls(calls: DataFrame, dirs: tuple[str, ...] = (), domains: tuple[str, ...] = (), burst: int = 10, window_ms: int = 60_000) -> DataFrame:
    """calls (session_id, seq, tool_name, arguments map, timestamp_ms, depth) with findings, risk_score and action.

    A call's history is what came before it in its session by seq. Bursts count calls of the last window_ms by time among
    those, whatever their tool; times may tie and fall, and a call without one is no burst."""
    before = W.partitionBy("session_id").orderBy("seq")
    df = _bursts(calls, burst, window_ms).withColumn("_args", _canonical(F.col("arguments")))
    tools = [F.lag("tool_name", k).over(before) for k in (1, 2, 3)]
    args = [F.lag("_args", k).over(before) for k in (1, 2, 3)]
    stuck = F.row_number().over(before) > 3
    same = F.lit(0)
    for t, a in zip(tools, args, strict=True):
        stuck = stuck & (t == F.col("tool_name"))
        same = same + (a == F.col("_args")).cast("int")
    values = F.map_values("arguments")
    hosts = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(R.NET_DOMAIN), F.lit(1))))
    fires = {
        "AGT-001": _named(F.col("tool_name"), R.FS_TOOLS) & F.exists(values, lambda v: R.FS_PATH.found(v) & outside(v, dirs)),
        "AGT-002": F.col("_burst"),
        "AGT-003": F.coalesce(stuck & (same >= 2), F.lit(False)),
        "AGT-004": (_named(F.col("tool_name"), R.NET_TOOLS) & (F.size(F.array_except(hosts, F.array(*map(F.lit, domains)))) > 0)) if domains else F.lit(False),
        "AGT-005": _named(F.col("tool_name"), R.EXEC_TOOLS) & F.exists(values, lambda v: v != ""),
        "AGT-006": F.exists(values, lambda v: any_found(v, R.AGENT_SENSITIVE)),
        "AGT-007": F.col("depth") > 5,
    }
    df = df.withColumns({f"_{k}": F.coalesce(v, F.lit(False)) for k, v in fires.items()})
    found = present(finding(F.col(f"`_{k}`"), check_id=k, severity=s, weight=w) for k, (s, w) in R.AGENT.items())
    score = points((F.col(f"`_{k}`"), w) for k, (_, w) in R.AGENT.items())
    df = df.withColumns({"findings": found, "risk_score": score, "action": F.when(score >= 70, "BLOCK").when(score >= 30, "WARN").otherwise("ALLOW")})
    return df.drop("_args", "_burst", *(f"_{k}" for k in fires))


def _matches(arg_patterns: str, args: str = "arguments") -> str:
    """SQL: some argument (missing ones as empty) matches one of its patterns."""
    return f"exists(map_entries(coalesce({arg_patterns}, map())), e -> exists(e.value, p -> rlike(coalesce({args}[e.key], ''), concat('(?iUd)', p))))"


def decide_calls(calls: DataFrame, policies: DataFrame, default_allow: bool = False) -> DataFrame:
    """calls (session_id, seq, tool_name, arguments, call_depth) with decision, matched_rule and sanitized_args.

    policies has a row for each tool: allowed, max_call_depth, rate_limit, required_args, blocked_arg_patterns,
    redact_arg_patterns, max_arg_length. The first rule that denies names the decision. Only permitted calls use up a
    session's rate, so a call is over the limit once as many calls before it pass all other rules. Patterns are columns;
    those that are no expressions must be left out when policies are made."""
    p = policies.select("tool_name", F.struct(*(c for c in policies.columns if c != "tool_name")).alias("p"))
    df = calls.join(p, "tool_name", "left")
    gates = [
        ("default_deny", F.col("p").isNull() & F.lit(not default_allow)),
        ("allowed", F.coalesce(~F.col("p.allowed"), F.lit(False))),
        ("invalid_call_depth", F.col("p").isNotNull() & (F.col("call_depth").isNull() | (F.col("call_depth") < 0))),
        ("max_call_depth", F.coalesce(F.col("call_depth") > F.col("p.max_call_depth"), F.lit(False))),
        ("required_args", F.coalesce(F.expr("exists(p.required_args, a -> not map_contains_key(arguments, a))"), F.lit(False))),
        ("max_arg_length", F.coalesce(F.expr("exists(map_values(arguments), v -> length(v) > p.max_arg_length)"), F.lit(False))),
        ("blocked_arg_patterns", F.col("p").isNotNull() & F.expr(_matches("p.blocked_arg_patterns"))),
    ]
    df = df.withColumns({f"_g{i}": F.coalesce(g, F.lit(False)) for i, (_, g) in enumerate(gates)})
    fine = F.lit(True)
    for i in range(len(gates)):
        fine = fine & ~F.col(f"_g{i}")
    w = W.partitionBy("session_id", "tool_name").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_used", F.coalesce(F.sum(fine.cast("int")).over(w), F.lit(0)))
    over = F.coalesce(F.col("_used") >= F.col("p.rate_limit"), F.lit(False))
    rule = F.lit(None).cast("string")
    ladder = [(name, F.col(f"_g{i}")) for i, (name, _) in enumerate(gates)]
    ladder.insert(4, ("rate_limit", over))
    for name, g in reversed(ladder):
        rule = F.when(g, name).otherwise(rule)
    masked = F.expr(f"transform_values(arguments, (k, v) -> case when exists(coalesce(p.redact_arg_patterns[k], array()), x -> rlike(v, concat('(?iUd)', x))) then '{R.MASK}' else v end)")
    df = df.withColumns({"matched_rule": rule, "_masked": F.coalesce(masked, F.col("arguments"))})
    shown = F.when(F.col("matched_rule").isNull() | (F.col("matched_rule") == "blocked_arg_patterns"), F.col("_masked")).otherwise(F.col("arguments"))
    changed = F.col("matched_rule").isNull() & (_canonical(F.col("_masked")) != _canonical(F.col("arguments")))
    df = df.withColumns({"sanitized_args": shown, "decision": F.when(F.col("matched_rule").isNotNull(), "DENY").when(changed, "REDACT").otherwise("ALLOW")})
    return df.drop("p", "_used", "_masked", *(f"_g{i}" for i in range(len(gates))))


def audit_ring(decided: DataFrame, most: int = 10_000, session: str | None = None, decision: str | None = None) -> DataFrame:
    """The newest entries of the decision log by seq, in all, or those of a session or decision among them."""
    newest = decided.orderBy(F.col("seq").desc()).limit(most)
    for column, value in (("session_id", session), ("decision", decision)):
        newest = newest if value is None else newest.where(F.col(column) == value)
    return newest


def tool_names(calls: DataFrame, column: str = "call") -> DataFrame:
    """calls with tool_name from a plain name or JSON with name, tool or function.name; trimmed, null if there is none."""
    c = F.col(column)
    name = F.when(c.startswith("{"), F.coalesce(F.get_json_object(c, "$.name"), F.get_json_object(c, "$.tool"), F.get_json_object(c, "$.function.name"))).otherwise(c)
    return calls.withColumn("tool_name", F.nullif(F.trim(name), F.lit("")))


def permitted(calls: DataFrame, tools: DataFrame) -> DataFrame:
    return calls.join(tools.select("tool_name"), "tool_name", "left_semi")


def rejected(calls: DataFrame, tools: DataFrame) -> DataFrame:
    return calls.join(tools.select("tool_name"), "tool_name", "left_anti")
