"""Small helpers shared by the expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Remove blanks of every kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def pick(c: Column, table: dict, default) -> Column:
    """Value of `table` for `c`, else `default`."""
    expr = None
    for key, value in table.items():
        expr = F.when(c == key, F.lit(value)) if expr is None else expr.when(c == key, F.lit(value))
    return expr.otherwise(F.lit(default))


def thresholds(c: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """Label of the first step that `c` reaches; steps are given from the highest down."""
    expr = None
    for limit, label in steps:
        cond = c >= F.lit(float(limit))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def any_of(conditions: list[Column]) -> Column:
    """True if one of the conditions is."""
    expr = conditions[0]
    for cond in conditions[1:]:
        expr = expr | cond
    return expr


def text_before(c: Column, mark: str) -> Column:
    """Text left of the first `mark` (all of it if there is none)."""
    return F.substring_index(c, mark, 1)


def text_after(c: Column, mark: str) -> Column:
    """Text right of the first `mark`; only meaningful where `mark` occurs."""
    return F.substr(c, F.instr(c, mark) + F.lit(len(mark)))
