"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import WORD

#: White space that parts words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was as are by this from at or an not he you "
    "der die das und ist nicht mit von zu ein eine den im auf für sich des dem "
    "le la les des et de du un une est que qui pas dans pour sur en par avec au "
    "el los las y del que no una con por para se su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if its measure is below least or above most; null bounds are open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Measures are SQL over the columns of `measures`; a null measure breaks no rule.
RULES = (
    Rule("word_count", "n_words", 10, 1_000_000),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", 2, 14),
    Rule("symbol_ratio", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("stop_word_ratio", "try_divide(n_stop_words, n_words)", 0.005, None),
    Rule("duplicate_line_ratio", "try_divide(n_dup_lines, n_lines)", None, 0.5),
    Rule("ellipsis_line_ratio", "try_divide(n_ellipsis_lines, n_lines)", None, 0.5),
    Rule("bullet_line_ratio", "try_divide(n_bullet_lines, n_lines)", None, 0.9),
    Rule("digit_ratio", "try_divide(n_digits, word_chars)", None, 0.5),
)


def _sql(rule: Rule) -> str:
    tests = [f"{rule.measure} < {rule.least!r}D"] * (rule.least is not None) + [f"{rule.measure} > {rule.most!r}D"] * (rule.most is not None)
    return f"coalesce({' or '.join(tests)}, false)"


def _repeat_words() -> Column:
    """Words that lie in a window of five words found twice or more; needs _occ, the sorted windows."""
    return F.expr(
        """case when _occ is null then 0L else aggregate(
             array_sort(array_compact(zip_with(
               zip_with(_occ, concat(array(cast(null as struct<g:string,p:int>)), slice(_occ, 1, size(_occ) - 1)),
                        (a, b) -> struct(a.p as p, a.g as g, coalesce(a.g = b.g, false) as same)),
               concat(slice(_occ, 2, size(_occ) - 1), array(cast(null as struct<g:string,p:int>))),
               (x, c) -> case when x.same or coalesce(x.g = c.g, false) then x.p end))),
             struct(0L as covered, -5 as last),
             (acc, p) -> struct(acc.covered + least(5, p - acc.last) as covered, p as last),
             acc -> acc.covered) end"""
    )


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules use; a null text counts as an empty one.

    Words found four in a row twice are looked for by 64-bit hashes; only texts that have some compare windows of five words."""
    df = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines", "n_digits", "_t", "_w", "_lines", "_pairs", "_fours", "_occ")
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = t
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    forms = sorted({f + end for w in STOP_WORDS for f in (w, w.capitalize()) for end in ("", ".", ",")})
    df = df.withColumns({"_t": t, "_w": F.array_remove(F.split(spaced, " "), ""), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "_pairs": F.expr("zip_with(_w, slice(_w, 2, size(_w)), (a, b) -> xxhash64(a, b))"),
            "word_chars": (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(SYMBOL)).cast("long"),
            "n_digits": F.regexp_count("_t", F.lit("[0-9]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long"),
            "n_stop_words": F.size(F.filter("_w", lambda x: x.isin(*forms))).cast("long"),
        }
    )
    # a window of five words found twice holds four words found twice; few texts have those
    df = df.withColumn("_fours", F.expr("slice(zip_with(_pairs, slice(_pairs, 3, size(_pairs)), (a, b) -> xxhash64(a, b)), 1, greatest(size(_w) - 3, 0))"))
    df = df.withColumn("_occ", F.expr("case when size(_w) >= 6 and size(array_distinct(_fours)) < size(_fours) then array_sort(transform(sequence(0, size(_w) - 5), i -> struct(array_join(slice(_w, i + 1, 5), ' ') as g, i as p))) end"))
    return df.withColumn("n_repeat_words", _repeat_words()).drop("_t", "_w", "_lines", "_pairs", "_fours", "_occ")


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its measures, base_failed, broken_rules (names, in table order) and kept.

    Null and empty texts have no words and fail the base. Columns of df named like an output are replaced. Every row is
    judged by itself, so repeated rows and ties get equal verdicts, and an empty table stays empty."""
    df = measures(df.drop("base_failed", "broken_rules", "kept"), text)
    df = df.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    broken = ", ".join(f"case when {_sql(r)} then '{r.name}' end" for r in rules)
    df = df.withColumn("broken_rules", F.expr(f"array_compact(array({broken}))" if rules else "cast(array() as array<string>)"))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that `judge` keeps, with df's own columns.

    The row number, which is never negative, stops the optimizer from moving the filter below the measures, where it would
    work them out again for every element of the arrays that they are made of."""
    judged = judge(df.select("*", *[F.col(c).alias(f"_own_{c}") for c in df.columns]), text, rules).withColumn("_row", F.monotonically_increasing_id())
    kept = judged.where(F.col("kept") & (F.col("_row") >= 0))
    return kept.select(*(F.col(f"_own_{c}").alias(c) for c in df.columns))
