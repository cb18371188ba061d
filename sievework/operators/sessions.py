"""Checks of conversations: jailbreak families, repetition, memory snapshots, token budgets and context stuffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import rules as R
from sievework.functions.regex import first_found
from sievework.operators.common import finding, folded, points, present, strip, text_of

EVERY_ROLE = "CONTEXT_INJECTION"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """turns with turn_index: the position over all roles, from 0."""
    return turns.withColumn("turn_index", F.row_number().over(W.partitionBy(conv).orderBy(turn)) - 1)


def jailbreak_matches(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn_index, pattern, confidence, evidence): for each turn and family the first match."""
    df = numbered(turns.select(conv, turn, role, text), conv, turn)
    t = text_of(text)
    rows = []
    for name, confidence, patterns in R.JAILBREAK:
        own = strip(t) if name == EVERY_ROLE else t
        match = first_found(own, patterns)
        rows.append(F.struct(F.lit(name).alias("pattern"), F.lit(confidence).alias("confidence"), (match if name == EVERY_ROLE else F.when(F.col(role) == "user", match)).alias("evidence")))
    return df.select(conv, "turn_index", F.inline(F.array(*rows))).where(F.col("evidence").isNotNull())


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """The Jaccard index of two arrays of distinct tokens; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def turn_similarity(turns: DataFrame, least: float = R.REPETITION_LEAST, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, a, b, similarity): pairs of user turns, a < b, that are at least so similar."""
    df = numbered(turns.select(conv, turn, role, text), conv, turn).where(F.col(role) == "user").select(conv, "turn_index", tokens(text_of(text)).alias("_tokens"))
    x, y = df.select(conv, F.col("turn_index").alias("a"), F.col("_tokens").alias("_x")), df.select(conv, F.col("turn_index").alias("b"), F.col("_tokens").alias("_y"))
    both = x.join(y, conv).where(F.col("a") < F.col("b")).withColumn("similarity", jaccard(F.col("_x"), F.col("_y")))
    return both.where(F.col("similarity") >= least).select(conv, "a", "b", "similarity")


def repetition_pressure(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn_indices, confidence): distinct sets of a user turn and the turns like it, of three or more."""
    pairs = turn_similarity(turns, R.REPETITION_LEAST, conv, turn, role, text).select(conv, "a", "b")
    both = pairs.unionByName(pairs.select(conv, F.col("b").alias("a"), F.col("a").alias("b")))
    sets = both.groupBy(conv, "a").agg(F.sort_array(F.array_append(F.collect_set("b"), F.col("a"))).alias("turn_indices"))
    sets = sets.where(F.size("turn_indices") >= R.REPETITION_TURNS).select(conv, "turn_indices").distinct()
    return sets.withColumn("confidence", F.least(F.lit(0.80), F.lit(0.50) + F.lit(0.05) * F.size("turn_indices")))


def analyze_conversations(turns: DataFrame, min_user_turns: int = 1, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, patterns, score, is_attempt, risk, flagged_turns, n_matches) of every conversation.

    The score is the highest confidence and 0.05 for each further family, at most 0.15."""
    single = jailbreak_matches(turns, conv, turn, role, text).select(conv, "pattern", "confidence", F.array("turn_index").alias("turn_indices"))
    again = repetition_pressure(turns, conv, turn, role, text).select(conv, F.lit("REPETITION_PRESSURE").alias("pattern"), "confidence", "turn_indices")
    found = single.unionByName(again).groupBy(conv).agg(
        F.sort_array(F.collect_set("pattern")).alias("patterns"), F.max("confidence").alias("_max"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("turn_indices")))).alias("flagged_turns"), F.count(F.lit(1)).alias("n_matches")
    )
    users = turns.groupBy(conv).agg(F.count(F.when(F.col(role) == "user", 1)).alias("_users"))
    df = users.join(found, conv, "left").withColumn("_on", F.col("_max").isNotNull() & (F.col("_users") >= min_user_turns))
    score = F.when(F.col("_on"), F.least(F.lit(1.0), F.col("_max") + F.least(F.lit(0.15), (F.size("patterns") - 1) * F.lit(0.05)))).otherwise(F.lit(0.0))
    df = df.withColumn("score", score)
    risk = F.when(F.col("score") >= 0.80, "CRITICAL").when(F.col("score") >= 0.60, "HIGH").when(F.col("score") >= 0.35, "MEDIUM").when(F.col("score") >= 0.15, "LOW").otherwise("NONE")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return df.select(conv, F.when(F.col("_on"), F.col("patterns")).otherwise(none("string")).alias("patterns"), F.round("score", 4).alias("score"), (F.col("score") >= 0.35).alias("is_attempt"), risk.alias("risk"), F.when(F.col("_on"), F.col("flagged_turns")).otherwise(none("int")).alias("flagged_turns"), F.when(F.col("_on"), F.col("n_matches")).otherwise(F.lit(0)).cast("long").alias("n_matches"))


def memory_snapshots(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns array<struct<turn,role,text>>) in order."""
    return turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))


def view(turns: Column, role: str | None = None) -> Column:
    """Texts of a role, or of all, that are not empty, joined by a space: matches may span turns."""
    held = F.filter(turns, lambda x: F.coalesce(x["text"], F.lit("")) != "")
    if role:
        held = F.filter(held, lambda x: x["role"] == role)
    return F.array_join(F.transform(held, lambda x: x["text"]), " ")


def _suspicious(pad: Column) -> Column:
    runs = R.MEM_BASE64.all(pad)
    decoded = F.transform(runs, lambda x: F.make_valid_utf8(F.try_to_binary(F.concat(x, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4)))), F.lit("base64")).cast("string")))
    return F.exists(decoded, lambda x: F.coalesce(x.rlike(R.MEM_DECODED.java), F.lit(False)))


def inspect_memory(snapshots: DataFrame, max_turns: int = 50, max_calls: int = 3, enabled: tuple[str, ...] = tuple(R.MEMORY)) -> DataFrame:
    """snapshots (turns; scratchpad, retrieved_context, tool_calls array<string> if there) with findings, risk_score (not capped), is_flagged.

    No enabled check means none."""
    has = snapshots.columns
    pad = text_of("scratchpad") if "scratchpad" in has else F.lit("")
    context = text_of("retrieved_context") if "retrieved_context" in has else F.lit("")
    calls = F.coalesce("tool_calls", F.array().cast("array<string>")) if "tool_calls" in has else F.array().cast("array<string>")
    everything = F.array_join(F.filter(F.array(view(F.col("turns")), pad, context), lambda x: x != ""), " ")
    df = snapshots.withColumns({"_all": everything, "_assistant": view(F.col("turns"), "assistant"), "_calls": calls})
    all_ = F.col("_all")
    first = [(rx, label) for rx, label in ((R.MEM_SSN, "SSN"), (R.MEM_CARD, "card"), (R.MEM_PASSWORD, "password"), (R.MEM_KEY, "api_key"))]
    hits = [rx.first(all_) for rx, _ in first]
    grave = hits[2].isNotNull() | hits[3].isNotNull()
    names = F.array_distinct("_calls")
    used = F.exists(names, lambda n: F.size(F.filter("_calls", lambda x: x == n)) > max_calls)
    rising = F.exists(names, lambda n: F.lower(n).rlike("|".join(R.MEM_ESCALATION)))
    fires = {
        "MEM-001": (hits[0].isNotNull() | hits[1].isNotNull() | grave, F.when(grave, "CRITICAL").otherwise("HIGH"), F.concat_ws("; ", *hits)),
        "MEM-002": (R.MEM_INSTRUCTION.found(F.col("_assistant")), F.lit("HIGH"), R.MEM_INSTRUCTION.first(F.col("_assistant"))),
        "MEM-003": (R.MEM_SESSION.found(all_), F.lit("CRITICAL"), R.MEM_SESSION.first(all_)),
        "MEM-004": (F.size("turns") > max_turns, F.lit("LOW"), F.concat(F.lit("turns="), F.size("turns").cast("string"))),
        "MEM-005": (used | rising, F.when(rising, "CRITICAL").otherwise("HIGH"), F.array_join(F.array_sort(names), ",")),
        "MEM-006": (_suspicious(pad), F.lit("HIGH"), F.lit("")),
    }
    fires = {k: v for k, v in fires.items() if k in enabled}
    df = df.withColumns({f"_{k}": v[0] for k, v in fires.items()})
    found = present((finding(F.col(f"`_{k}`"), check_id=k, severity=v[1], weight=R.MEMORY[k], evidence=v[2]) for k, v in fires.items()), "struct<check_id:string,severity:string,weight:int,evidence:string>")
    df = df.withColumns({"findings": found, "risk_score": points(((F.col(f"`_{k}`"), R.MEMORY[k]) for k in fires), None)})
    return df.withColumn("is_flagged", F.col("risk_score") > 0).drop("_all", "_assistant", "_calls", *(f"_{k}" for k in fires))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def token_budget(turns: DataFrame, max_turn: int = 4096, max_session: int = 32_768, factor: float = 5.0, least_turns: int = 3, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, turn_tokens, session_before, session_after, decision, violations) of every turn, by a fold over each session.

    Denied turns are not added to the session, so later decisions depend on earlier ones."""

    def step(state: list, n: int) -> tuple[int, int]:
        total, count = state
        if n <= max_turn and total + n <= max_session:
            state[:] = total + n, count + 1
        return total, count

    df = turns.select(conv, turn, estimate_tokens(text_of(text)).cast("long").alias("turn_tokens"))
    df = folded(df, conv, turn, F.col("turn_tokens"), "session_before long, _count long", lambda: [0, 0], step)
    n, before = F.col("turn_tokens"), F.col("session_before")
    long, full = n > max_turn, before + n > max_session
    odd = F.coalesce((F.col("_count") >= least_turns) & (before > 0) & (n / F.nullif(before / F.nullif(F.col("_count"), F.lit(0)), F.lit(0.0)) >= factor), F.lit(False))
    violations = present([F.when(long, "TURN_LIMIT_EXCEEDED"), F.when(full, "SESSION_LIMIT_EXCEEDED"), F.when(~long & ~full & odd, "STUFFING_ANOMALY")])
    decision = F.when(long | full, "DENY").when(odd, "WARN").otherwise("ALLOW")
    return df.select(conv, turn, "turn_tokens", "session_before", (before + F.when(long | full, 0).otherwise(n)).alias("session_after"), decision.alias("decision"), violations.alias("violations"))


def context_stuffing(df: DataFrame, text: str = "text", max_tokens: int = 4096, block: int = 50, repeats: int = 3) -> DataFrame:
    """df with estimated_tokens, signals (names), is_stuffing and decision."""
    t = text_of(text)
    head = F.substring(t, 1, block)
    n = F.when(F.length(t) >= block * repeats, ((F.length(t) - F.length(F.replace(t, head, F.lit("")))) / F.length(head)).cast("long")).otherwise(F.lit(0))
    run = F.length(t) >= 50
    long_run = run & t.rlike(r"(?s)(.)\1{49}")
    blank = R.Rx(r"[ \t\n\r]").count(t)
    df = df.withColumns({"estimated_tokens": estimate_tokens(t), "_n": n, "_run": long_run, "_blank": blank})
    signals = present([F.when(F.col("estimated_tokens") > max_tokens, "too_long"), F.when(F.col("_n") >= repeats, "repeated_block"), F.when(F.col("_run"), "character_run"), F.when((F.length(t) > 0) & (F.col("_blank") / F.length(t) > 0.80), "white_space")])
    df = df.withColumn("signals", signals).withColumn("is_stuffing", F.size("signals") > 0)
    return df.withColumn("decision", F.when(F.col("estimated_tokens") > max_tokens, "DENY").when(F.col("is_stuffing"), "WARN").otherwise("ALLOW")).drop("_n", "_run", "_blank")


def session_budgets(judged: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, tokens, turns): what each session has used after its last turn, from the rows of `token_budget`; its count is the number of sessions."""
    last = F.max_by("session_after", turn).alias("tokens")
    return judged.groupBy(conv).agg(last, F.count(F.when(F.col("decision") != "DENY", 1)).alias("turns"))
