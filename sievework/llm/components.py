"""Connected components over a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sievework.llm.common import discard, materialize

#: Vertices whose links a task holds together before it passes their forest on.
KEEP = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join what the given ones join: each vertex with the smallest one that the task has seen it linked with."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def rows() -> pa.RecordBatch:
        own = [(x, root(x)) for x in parent]
        own = [(x, r) for x, r in own if x != r]
        return pa.record_batch([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], names=["u", "v"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > KEEP:
            yield rows()
            parent.clear()
    if parent:
        yield rows()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in links the smallest id reachable from it.

    Each task first thins out the links that it reads. Each round then gives a vertex the smallest label among its own and its neighbours', lets its old label's vertex take the
    smaller one too, and jumps along labels, so long chains halve. Rounds end when no label changes; only that count
    reaches the driver. Null ends, loops and repeated links change nothing. `discard` deletes the result's table."""
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs = pairs.mapInArrow(_forest, "u long, v long")
    edges = materialize(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    table = labels = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select(F.col("u").alias("id"), "l"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("m"))
        best = labels.join(near, "id").select("id", "l", F.least("l", "m").alias("m"))
        hooks = best.where(F.col("m") < F.col("l")).groupBy(F.col("l").alias("id")).agg(F.min("m").alias("h"))
        hooked = best.join(hooks, "id", "left").select("id", "l", F.least("m", "h").alias("m"))
        jump = hooked.select(F.col("id").alias("m"), F.col("m").alias("j"))
        jumped = hooked.join(jump, "m").select("id", "l", F.least("m", "j").alias("m"))
        seen = Observation()
        moved = materialize(jumped.observe(seen, F.count(F.when(F.col("m") < F.col("l"), 1)).alias("changed")), "labels")
        discard(table)
        table, labels = moved, moved.select("id", F.col("m").alias("l"))
        if not seen.get["changed"]:
            discard(edges)
            out = labels.withColumnRenamed("l", "component")
            out._scratch = table._scratch
            return out
