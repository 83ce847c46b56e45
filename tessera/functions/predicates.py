"""Comparison predicates as Column expressions, in standard or in compat (two-valued, null least) logic."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.errors import SqlError

STANDARD, COMPAT = "standard", "compat"
OPS = ("=", ">", ">=", "<", "<=")
FLIP = {"=": "=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}
#: Compat order across types: null, then integers, doubles and strings.
_RANK = {"int": 1, "bigint": 1, "double": 2, "float": 2, "string": 3}


def compare(left: Column, op: str, right: Column, mode: str = STANDARD) -> Column:
    """``left op right`` for operands of one type. Compat: null equals null and is less than any value."""
    if op not in OPS:
        raise SqlError(f"unsupported comparison operator {op}")
    if mode == STANDARD:
        return {"=": left == right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    if op == "=":
        return left.eqNullSafe(right)
    if op in ("<", "<="):
        left, right = right, left
    if op in (">", "<"):
        return left.isNotNull() & (right.isNull() | F.coalesce(left > right, F.lit(False)))
    return right.isNull() | (left.isNotNull() & F.coalesce(left >= right, F.lit(False)))


def compare_typed(left: Column, op: str, right: Column, left_type: T.DataType, right_type: T.DataType, mode: str = STANDARD) -> Column:
    """Like ``compare``; in compat mode values of different types are never equal and order by type."""
    a, b = _RANK.get(left_type.simpleString()), _RANK.get(right_type.simpleString())
    if mode == STANDARD or a == b or a is None or b is None:
        return compare(left, op, right, mode)
    rank = lambda c, r: F.when(c.isNull(), 0).otherwise(r)  # noqa: E731  null in both columns still is one value
    return compare(rank(left, a), op, rank(right, b), STANDARD)


@dataclass(frozen=True)
class Ref:
    """A column by name, qualified by its table or not."""

    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Predicate:
    """``left op right``; operands are Ref or types.Literal, at least one a Ref."""

    left: object
    op: str
    right: object


def conjunction(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def wrap_int32(c: Column) -> Column:
    """A bigint as the 32-bit integer that two's complement leaves of it."""
    return (F.pmod(c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
