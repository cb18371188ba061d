"""Mixing sources to target weights: repetition rates per source, then whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import WORD, materialize

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more often than this.
MOST_REPEATS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source, size): a row for each source with source_size, weight and target.

    The sum of all sizes is shared out by weight; a target above `most` times its source's size stops there and the excess
    is shared out anew among the others until none is above. Sources are numbered by a range partition and offsets, so
    their number is not bounded by one task; a round of sharing brings one row to the driver."""
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = materialize(totals.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "sources")
    offsets = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    rank = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1 + F.coalesce("_before", F.lit(0))
    ranked = parts.join(F.broadcast(offsets), "_part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    ranked = materialize(ranked.select("source", "source_size", "weight"), "weights")
    cap, total = F.col("source_size") * most, None
    level, capped = float("inf"), None
    while True:
        above = F.lit(False) if capped is None else cap < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum("source_size").alias("t"), F.sum(F.when(above, cap)).alias("c"), F.sum(F.when(~above, F.col("weight"))).alias("w"), F.count(F.when(above, 1)).alias("n")).first()
        total, full = row["t"] or 0, row["c"] or 0
        if row["n"] == capped or not row["w"]:
            break
        level, capped = (total - full) / row["w"], row["n"]
    target = F.when(cap < F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight")) if total else F.lit(0.0)
    return ranked.withColumn("target", target)


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken; columns of docs with these names are replaced.

    size counts words (null text: 0); null is a source of its own. A document is copied floor(rate) times, and once more
    if a hash of seed and doc_id falls below the fraction of the rate; without a doc_id, of seed and text. Repeated rows
    share that draw. A source without words has rate 0. An empty table gives an empty plan."""
    docs = docs.drop("size", "source_size", "weight", "target", "rate", "copies", "taken")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    targets = source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "_source")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source", "weight").withColumn("rate", rate)
    out = out.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed table: every document as often as its plan says, with the columns of docs."""
    plan = mixing_plan(docs, weights, most, seed)
    return plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*docs.columns)
