"""Expressions as Spark columns. All of it stays in built-in functions, so it is pushed down and compiled."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainline.functions.dsl import Binary, Call, Expr, Literal, Ref, Unary


def divide(a: Column, b: Column) -> Column:
    """True division of doubles by IEEE rules: x / 0 is infinite, 0 / 0 is NaN, a null gives null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def literal(value: object) -> Column:
    """A literal of its own type: decimal-point numbers are decimals, as in SQL text."""
    if isinstance(value, float) and "e" not in repr(value) and "n" not in repr(value):
        return F.lit(Decimal(repr(value)))
    return F.lit(value)


_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_CALLS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "coalesce": F.coalesce, "nullif": F.nullif, "lower": F.lower, "upper": F.upper,
    "if": lambda c, a, b: F.when(c, a).otherwise(b),
}
_UNARY: dict[str, Callable[[Column], Column]] = {"+": F.positive, "-": F.negative, "not": lambda c: ~c}


def column(tree: Expr, resolve: Callable[[tuple[str, ...]], Column]) -> Column:
    match tree:
        case Literal(value):
            return literal(value)
        case Ref(path):
            return resolve(path)
        case Unary(op, operand):
            return _UNARY[op](column(operand, resolve))
        case Binary(op, left, right):
            return _BINARY[op](column(left, resolve), column(right, resolve))
        case Call(name, args):
            return _CALLS[name](*(column(a, resolve) for a in args))
    raise TypeError(type(tree).__name__)
