"""Regular expressions that mean the same in Spark (Java) as in the rule tables, and their form for RE2 engines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rx:
    """A pattern with flags out of i, m and s. Code points are written \\x{...}, which Java and RE2 both read."""

    text: str
    flags: str = ""

    @property
    def java(self) -> str:
        """With Unicode classes and \\n as the only line end."""
        return f"(?{self.flags}Ud){self.text}"

    @property
    def re2(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + self.text

    def found(self, col: Column) -> Column:
        return col.rlike(self.java)

    def first(self, col: Column) -> Column:
        """The first match, or null."""
        return F.when(self.found(col), F.regexp_extract(col, self.java, 0))

    def all(self, col: Column) -> Column:
        return F.regexp_extract_all(col, F.lit(self.java), F.lit(0))

    def count(self, col: Column) -> Column:
        return F.regexp_count(col, F.lit(self.java))

    def replace(self, col: Column, by: str) -> Column:
        """by is literal text but for $1 to $9."""
        return F.regexp_replace(col, self.java, by)

    def sql(self, text: str) -> str:
        """The test as SQL for an RE2 engine."""
        return f"regexp_matches({text}, {quoted(self.re2)})"

    def sql_count(self, text: str) -> str:
        return f"len(regexp_extract_all({text}, {quoted(self.re2)}))"

    def sql_replace(self, text: str, by: str) -> str:
        for i in range(1, 10):
            by = by.replace(f"${i}", f"\\{i}")
        return f"regexp_replace({text}, {quoted(self.re2)}, {quoted(by)}, 'g')"


def i(text: str) -> Rx:
    return Rx(text, "i")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_found(col: Column, patterns: tuple[Rx, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | p.found(col)
    return out


def any_sql(text: str, patterns: tuple[Rx, ...]) -> str:
    return "(" + (" or ".join(p.sql(text) for p in patterns) or "false") + ")"


def first_found(col: Column, patterns: tuple[Rx, ...]) -> Column:
    """The first match of the first pattern that is found, or null."""
    return F.coalesce(*(p.first(col) for p in patterns))
