"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body's lambdas use it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def text(c) -> Column:
    """Null as the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def trim_all(c) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.btrim(text(c), F.lit(" \t\n\r\x00\x0b"))


def lookup(c, table: dict, default=None) -> Column:
    """CASE over a small fixed table."""
    expr = None
    for key, value in table.items():
        hit = col(c) == F.lit(key)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr.otherwise(F.lit(default))


def reasons(*pairs) -> Column:
    """Array of the texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in pairs]))


def any_of(names) -> str:
    """Regex alternation of plain names."""
    return "(?:" + "|".join(names) + ")"


def source_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """What names a source file on both sides: its path, and its project and commit where both know them."""
    return [c for c in ("project_id", "commit_sha", "file_path") if c in left.columns and c in right.columns]
