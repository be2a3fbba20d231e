"""Arithmetic formulas, compiled from their syntax tree to column expressions."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import RequestError

MAX_EXPONENT = 10
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}


def _tree(expression: str) -> ast.expr:
    try:
        return ast.parse(expression, mode="eval").body
    except SyntaxError as e:
        raise RequestError(f"the formula {expression!r} cannot be read: {e.msg}") from None


def names_in(expression: str) -> set[str]:
    return {n.id for n in ast.walk(_tree(expression)) if isinstance(n, ast.Name)}


def compile_formula(expression: str, names: Mapping[str, Column]) -> Column:
    """The formula over named columns: + - * / ** and signs. Division by zero and overflow give null."""

    def build(n: ast.expr) -> Column:
        match n:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name):
                if name not in names:
                    raise RequestError(f"the formula names {name!r}, which is not declared")
                return names[name].cast("double")
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=a, op=ast.Div(), right=b):
                return F.try_divide(build(a), build(b))
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                power = build(b)
                return F.when(F.abs(power) <= MAX_EXPONENT, F.pow(build(a), power))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
        raise RequestError(f"{ast.unparse(n)!r} is not arithmetic that formulas allow")

    value = build(_tree(expression))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def check_names(expressions: list[str], inputs: set[str], columns: set[str]) -> None:
    """Refuses names that nothing declares, and declared inputs that no formula uses."""
    used = set().union(*map(names_in, expressions)) if expressions else set()
    if unknown := used - inputs - columns:
        raise RequestError(f"undeclared names: {', '.join(sorted(unknown))}")
    if unused := inputs - used:
        raise RequestError(f"inputs that no formula uses: {', '.join(sorted(unused))}")


def meets_expectation(value: Column, expected: float, share: float = 0.005) -> Column:
    return F.abs(value - expected) <= F.lit(share) * abs(expected) + 1e-9
