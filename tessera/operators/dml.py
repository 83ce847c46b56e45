"""INSERT, DELETE and UPDATE as DataFrame transforms; sources.catalog commits their results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.errors import SqlError, unsupported
from tessera.functions.predicates import COMPAT, STANDARD, Predicate, conjunction
from tessera.functions.types import DOUBLE, INTEGER, Literal
from tessera.operators.relational import Scope, bind


@dataclass(frozen=True)
class Assignment:
    """``column = value``, or ``column = column sign value`` where sign is + or -."""

    column: str
    value: Literal
    sign: str | None = None


def rows_to_insert(spark: SparkSession, schema: T.StructType, columns: list[str] | None, values: list[list[Literal]]) -> DataFrame:
    """VALUES lists as rows of ``schema``; columns left out are null."""
    names = [f.name for f in schema]
    columns = [c.lower() for c in columns] if columns is not None else names
    if len(set(columns)) < len(columns):
        raise SqlError("a column is named twice in INSERT")
    if unknown := [c for c in columns if c not in names]:
        raise SqlError(f"unknown column {unknown[0]} in INSERT")
    out = []
    for row in values:
        if len(row) != len(columns):
            raise SqlError(f"INSERT has {len(row)} values for {len(columns)} columns")
        got = {c: v.coerce(schema[c].dataType) for c, v in zip(columns, row, strict=True)}
        out.append(tuple(got.get(c) for c in names))
    return spark.createDataFrame(out, schema)


def key_stats(rows: DataFrame, key: list[str]) -> dict:
    """Rows, those with a null in the key, and the range of the first key column, in one pass."""
    null = ~conjunction([F.col(k).isNotNull() for k in key])
    return rows.agg(F.count_if(null).alias("nulls"), F.min(key[0]).alias("low"), F.max(key[0]).alias("high")).first().asDict()


def key_conflict(stats: dict, new: DataFrame, old: DataFrame | None, key: list[str]) -> bool:
    """Whether keys repeat in ``new`` (which has ``stats``) or occur in ``old``, of which only the range of the new keys is
    read."""
    if stats["nulls"]:
        raise SqlError("null in a key column")
    if stats["low"] is None:
        return False
    rows = new.select(*key, F.lit(1).alias("new_"))
    if old is not None:
        rows = rows.unionAll(old.where(F.col(key[0]).between(F.lit(stats["low"]), F.lit(stats["high"]))).select(*key, F.lit(0).alias("new_")))
    return not rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("new_").alias("new_")).where("n > 1 and new_ = 1").isEmpty()


class _OneTable(Scope):
    """A scope that keeps the table's own column names."""

    def place(self, inner: str) -> int:
        return 0

    def find(self, ref, first: bool = False):
        inner, kind = super().find(ref, first)
        return next(c for _, c, n, _ in self.columns if n == inner), kind


def matching(df: DataFrame, table: str, where: tuple[Predicate, ...], mode: str = STANDARD) -> Column:
    """The rows that WHERE keeps, as a Column over ``df`` that is never null."""
    scope = _OneTable()
    scope.add(table, df)
    return F.coalesce(conjunction([bind(p, scope, mode)[0] for p in where]), F.lit(False))


def assigned(schema: T.StructType, sets: list[Assignment], mode: str = STANDARD) -> dict[str, Column]:
    """New values by column, all from the old row."""
    out = {}
    for a in sets:
        name = a.column.lower()
        if name not in schema.names:
            raise SqlError(f"unknown column {name} in UPDATE")
        if name in out:
            raise SqlError(f"column {name} is set twice")
        kind = schema[name].dataType
        value = a.value.coerce(kind)
        if a.sign is None:
            out[name] = F.lit(value).cast(kind)
            continue
        if kind not in (INTEGER, DOUBLE) or value is None:
            raise unsupported(f"arithmetic needs a numeric column and literal: {name}")
        new = F.col(name) + F.lit(value) if a.sign == "+" else F.col(name) - F.lit(value)
        if mode == COMPAT:
            new = F.when(F.col(name).isNull(), F.raise_error(F.lit(f"arithmetic on null in column {name}")).cast(kind)).otherwise(new)
        out[name] = new.cast(kind)
    return out


def updated(df: DataFrame, match: Column, values: dict[str, Column]) -> DataFrame:
    return df.select(*(F.when(match, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def deleted(df: DataFrame, match: Column) -> DataFrame:
    return df.where(~match)
