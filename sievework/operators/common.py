"""Shapes that the operators share: findings, unique weights, sorted flags."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(items: Iterable[Column], kind: str = "string") -> Column:
    """An array of those items that are not null."""
    items = list(items)
    return F.array_compact(F.array(*items)) if items else F.array().cast(f"array<{kind}>")


def flags(pairs: Iterable[tuple[Column, str]]) -> Column:
    """Distinct names of the conditions that hold, sorted."""
    return F.sort_array(F.array_distinct(present(F.when(c, name) for c, name in pairs)))


def weighted(pairs: Iterable[tuple[Column, float]]) -> Column:
    """The sum of weights as a double, added from left to right."""
    out = F.lit(0.0)
    for c, weight in pairs:
        out = out + F.when(c, F.lit(float(weight))).otherwise(F.lit(0.0))
    return out


def points(pairs: Iterable[tuple[Column, int]], most: int | None = 100) -> Column:
    """The sum of whole weights, capped."""
    out = F.lit(0)
    for c, weight in pairs:
        out = out + F.when(c, F.lit(weight)).otherwise(F.lit(0))
    return out if most is None else F.least(F.lit(most), out)


def finding(fires: Column, **fields: Column | str | int) -> Column:
    return F.when(fires, F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def text_of(name: str | Column) -> Column:
    """The text, null as empty."""
    col = F.col(name) if isinstance(name, str) else name
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def folded(df: DataFrame, key: str, order: str, value: Column, added: str, start: Callable[[], list], step: Callable[[list, object], tuple]) -> DataFrame:
    """df with the columns added: what step(state, value) gives for each row, in order within its key, where start makes a state.

    A task reads its keys one row after the other, so a key may have any number of rows; only its state is held."""
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), start()
        for batch in batches:
            out = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now:
                    now, state = k, start()
                out.append(step(state, v))
            columns = zip(*out, strict=True) if out else ((),) * len(names)
            yield pa.record_batch([*batch.columns[2:], *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=[*batch.schema.names[2:], *names])

    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in added.split(", ")]
    own = df.select(F.col(key).alias("_key"), value.alias("_value"), *df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), added])
    return own.repartition("_key").sortWithinPartitions("_key", order).mapInArrow(run, schema)
