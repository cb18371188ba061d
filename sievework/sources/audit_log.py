"""Audit logs as tables: JSON lines with hashes, and JSON files of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, canonical, prev_hash, event_hash) of JSONL logs; a file is a log, blank lines count but give no row.

    canonical is the event's JSON with sorted keys, its hashes left out, as the chain was built on it; the log's writer must
    have written keys in that order."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    rows = text.where(F.trim("line") != "").select("log_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    rest = F.regexp_replace(F.col("line"), r',?\s*"(?:prev_hash|event_hash)":\s*"[^"]*"', "")
    return rows.select("log_id", "line_no", rest.alias("canonical"), F.get_json_object("line", "$.prev_hash").alias("prev_hash"), F.get_json_object("line", "$.event_hash").alias("event_hash"))


def write_chain(chained: DataFrame, path: str) -> None:
    """Writes (line_no, canonical, prev_hash, event_hash) of one log as JSONL in order."""
    hashes = F.concat(F.lit(',"prev_hash":"'), "prev_hash", F.lit('","event_hash":"'), "event_hash", F.lit('"}'))
    line = F.concat(F.expr("substring(canonical, 1, length(canonical) - 1)"), hashes)
    chained.orderBy("line_no").select(line.alias("value")).coalesce(1).write.text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, idx, sequence_id) of JSON files that hold an array of events, or an object with `events`."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), "value")
    events = F.coalesce(F.get_json_object("value", "$.events"), F.col("value"))
    rows = raw.select("log_id", F.posexplode(F.from_json(events, "array<string>")).alias("pos", "event"))
    key = F.coalesce(F.get_json_object("event", "$.sequence_id"), F.get_json_object("event", "$.sequence"), F.get_json_object("event", "$.index"))
    return rows.select("log_id", (F.col("pos") + 1).cast("long").alias("idx"), key.alias("sequence_id"))
