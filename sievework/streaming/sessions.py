"""Session state over streams: token budgets that remember what they admitted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.operators.common import text_of
from sievework.operators.sessions import estimate_tokens


def token_budget_stream(turns: DataFrame, max_turn: int = 4096, max_session: int = 32_768, factor: float = 5.0, least_turns: int = 3, idle: str | None = None) -> DataFrame:
    """(conv_id, turn, turn_tokens, session_after, decision) of a stream of turns (conv_id, turn, text).

    Within a batch turns of a session go in order of turn. Denied turns leave the state as it was. If turns has a column
    reset, a row where it holds forgets the session and gives no row, before the batch's later turns. With idle (like `1 hour`)
    a session without turns for so long is forgotten, too; else its state is kept."""
    reset = F.col("reset") if "reset" in turns.columns else F.lit(False)
    own = turns.select("conv_id", "turn", estimate_tokens(text_of("text")).alias("n"), F.coalesce(reset, F.lit(False)).alias("reset"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, count = state.get if state.exists else (0, 0)
        rows = []
        for turn, n, forget in sorted((int(t), int(n), bool(r)) for p in parts for t, n, r in zip(p["turn"], p["n"], p["reset"], strict=True)):
            if forget:
                total, count = 0, 0
                continue
            denied = n > max_turn or total + n > max_session
            odd = count >= least_turns and total > 0 and n / (total / count) >= factor
            if not denied:
                total, count = total + n, count + 1
            rows.append((key[0], turn, n, total, "DENY" if denied else "WARN" if odd else "ALLOW"))
        if count:
            state.update((total, count))
            if idle:
                state.setTimeoutDuration(idle)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "turn_tokens", "session_after", "decision"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return own.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, turn_tokens long, session_after long, decision string", "total long, count long", "append", timeout)


def windowed_decisions(events: DataFrame, time: str, decision: str = "decision", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, decision, n): decisions in tumbling windows of event time; later rows than the watermark allows are left out."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), decision).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), decision, "n")
