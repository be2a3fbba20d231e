"""Row filter expressions: `column op value` clauses joined with `&`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number, parse_number, text
from .errors import RequestError

#: Longer operators first, so that `>=` is not read as `>`.
OPERATORS = ("!=", ">=", "<=", "=", ">", "<", "~")


@dataclass(frozen=True)
class Clause:
    column: str
    op: str
    value: str


def parse(expression: str | None) -> list[Clause]:
    """The clauses of an expression; an empty one and `*` have none and mean all rows."""
    if not expression or expression.strip() in ("", "*"):
        return []
    clauses = []
    for part in expression.split("&"):
        found = re.search("|".join(map(re.escape, OPERATORS)), part)
        if not found or not part[: found.start()].strip():
            hint = " (join clauses with &, not with commas)" if "," in part else ""
            raise RequestError(f"{part.strip()!r} is not of the form column=value, column>=number or column~text{hint}")
        clauses.append(Clause(part[: found.start()].strip(), found[0], part[found.end() :].strip()))
    return clauses


def columns_of(expression: str | None) -> list[str]:
    return list(dict.fromkeys(c.column for c in parse(expression)))


def condition(df: DataFrame, clause: Clause) -> Column:
    """A clause as a predicate that is never null. Null cells read as empty text, so `!=` keeps them."""
    if clause.column not in df.columns:
        raise RequestError(f"there is no column {clause.column!r}; there are {', '.join(df.columns[:12])}")
    if clause.op in ("=", "!=", "~"):
        kind = df.schema[clause.column].dataType
        if clause.op == "=" and isinstance(kind, T.IntegralType) and re.fullmatch(r"-?[0-9]{1,18}", clause.value):
            return F.coalesce(F.col(f"`{clause.column}`") == int(clause.value), F.lit(False))  # can be pushed to the scan
        cell, wanted = F.lower(text(clause.column)), clause.value.lower()
        if clause.op == "~":
            return cell.contains(wanted)
        return cell == wanted if clause.op == "=" else cell != wanted
    left = number(df, clause.column)
    if isinstance(df.schema[clause.column].dataType, T.NumericType) and re.fullmatch(r"-?[0-9.]+", clause.value):
        left, right = F.col(f"`{clause.column}`"), F.lit(float(clause.value))
    else:
        right = parse_number(F.lit(clause.value))
    test = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[clause.op]
    return F.coalesce(test, F.lit(False))


def predicate(df: DataFrame, expression: str | None) -> Column | None:
    """The conjunction of an expression's clauses; None if it selects all rows."""
    out = None
    for clause in parse(expression):
        c = condition(df, clause)
        out = c if out is None else out & c
    return out


def select_rows(df: DataFrame, expression: str | None) -> DataFrame:
    p = predicate(df, expression)
    return df if p is None else df.where(p)


def require_rows(df: DataFrame, expression: str | None, allow_empty: bool = False) -> DataFrame:
    """The selected rows; a filter that selects none is an error unless allowed."""
    rows = select_rows(df, expression)
    if not allow_empty and rows.isEmpty():
        raise RequestError(f"the filter {expression!r} selects no rows")
    return rows
