"""SELECT as a declared plan: tables, conjunctive comparisons, then groups or aggregate, sort, limit and projection.

The plan is expressed with the DataFrame API; pushing filters into scans, choosing and ordering joins and picking top-k
are left to Catalyst and adaptive execution. Comma joins are joined table by table on the predicates that connect them,
so that equal keys become hash or merge joins and only unconnected tables a product.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.errors import SqlError, unsupported
from tessera.functions.predicates import COMPAT, FLIP, STANDARD, Predicate, Ref, compare_typed, conjunction, wrap_int32
from tessera.functions.types import Literal


@dataclass(frozen=True)
class Item:
    """A select item: a Ref, "*", or an aggregate (count or sum, of a Ref or of "*")."""

    what: Ref | str
    call: str | None = None
    distinct: bool = False
    alias: str | None = None

    def label(self) -> str:
        of = "*" if self.what == "*" else self.what.name
        return self.alias or (f"{self.call}({of})" if self.call else of)


@dataclass(frozen=True)
class Select:
    tables: tuple[str, ...]
    items: tuple[Item, ...] = (Item("*"),)
    where: tuple[Predicate, ...] = ()
    order: tuple[tuple[Ref, bool], ...] = ()  # column, descending
    limit: int | None = None
    distinct: bool = False
    group: tuple[Ref, ...] = ()
    offset: int | None = None


@dataclass
class Scope:
    """The columns of the tables in FROM order, each under a name of its own."""

    frames: list[DataFrame] = field(default_factory=list)
    columns: list[tuple[str, str, str, object]] = field(default_factory=list)  # table, name, inner name, type

    def add(self, table: str, df: DataFrame) -> None:
        inner = [f"t{len(self.frames)}_{i}" for i in range(len(df.columns))]
        self.columns += [(table, c, n, f.dataType) for c, n, f in zip(df.columns, inner, df.schema, strict=True)]
        self.frames.append(df.toDF(*inner))

    def place(self, inner: str) -> int:
        return int(inner[1:].split("_")[0])

    def find(self, ref: Ref, first: bool = False) -> tuple[str, object]:
        got = [(n, t) for table, name, n, t in self.columns if name.lower() == ref.name.lower() and (first or ref.table in (None, table))]
        if not got:
            raise SqlError(f"unknown column {ref}")
        if len(got) > 1 and not first:
            raise SqlError(f"ambiguous column {ref}")
        return got[0]


def bind(p: Predicate, scope: Scope, mode: str) -> tuple[Column, set[int]]:
    """The predicate as a Column and the tables it reads. In compat mode a literal takes its column's type first."""
    left, op, right = p.left, p.op, p.right
    if isinstance(left, Literal):
        left, op, right = right, FLIP[op], left
    if not isinstance(left, Ref):
        raise unsupported("a predicate needs a column")
    name, kind = scope.find(left)
    used = {scope.place(name)}
    if isinstance(right, Ref):
        other, other_kind = scope.find(right)
        used.add(scope.place(other))
        return compare_typed(F.col(name), op, F.col(other), kind, other_kind, mode), used
    value = F.lit(right.coerce(kind)).cast(kind) if mode == COMPAT else F.lit(right.natural())
    return compare_typed(F.col(name), op, value, kind, kind, mode), used


def aggregate(item: Item, scope: Scope, mode: str) -> Column:
    if item.what == "*":
        if item.call != "count" or item.distinct:
            raise unsupported(f"{item.call}(*) is not supported")
        out = F.count(F.lit(1))
    else:
        name, kind = scope.find(item.what)
        if item.call == "count":
            out = F.countDistinct(name) if item.distinct else F.count(name)
        elif item.call == "sum" and not item.distinct:
            if kind.simpleString() == "string":
                raise SqlError(f"sum of text column {item.what}")
            out = F.sum(name)
            if kind.simpleString() not in ("int", "bigint"):
                return out.alias(item.label())
        else:
            raise unsupported(f"unsupported aggregate {item.call}")
    return (wrap_int32(out) if mode == COMPAT else out).alias(item.label())


def select(q: Select, tables: Mapping[str, DataFrame], mode: str = STANDARD) -> DataFrame:
    """The result of ``q`` over ``tables``. Column names are aliases or default labels and may repeat."""
    scope = Scope()
    for t in q.tables:
        scope.add(t, tables[t])
    bound = [bind(p, scope, mode) for p in q.where]
    df, joined = None, set()
    for i, frame in enumerate(scope.frames):
        own = [c for c, used in bound if used == {i}]
        frame = frame.where(conjunction(own)) if own else frame
        joined.add(i)
        if df is None:
            df = frame
            continue
        on = [c for c, used in bound if len(used) > 1 and i in used and used <= joined]
        df = df.join(frame, conjunction(on), "inner") if on else df.crossJoin(frame)
    calls = [x for x in q.items if x.call]
    if mode == COMPAT and (q.distinct or q.group or q.offset is not None):
        raise unsupported("DISTINCT, GROUP BY and OFFSET")
    if q.distinct and (calls or q.group):
        raise unsupported("DISTINCT with aggregates")
    if calls and not q.group:
        if len(calls) < len(q.items):
            raise unsupported("aggregates cannot be mixed with columns")
        if q.order:
            raise unsupported("ORDER BY with an aggregate")
        return _cut(df.agg(*(aggregate(x, scope, mode) for x in q.items)), q)
    place = {i: f"a{i}" for i, x in enumerate(q.items) if x.call}
    if q.group:
        keys = list(dict.fromkeys(scope.find(r)[0] for r in q.group))
        if any(x.what == "*" and not x.call for x in q.items):
            raise unsupported("* with GROUP BY")
        grouped = df.groupBy(*keys)
        df = grouped.agg(*(aggregate(q.items[i], scope, mode).alias(n) for i, n in place.items())) if place else df.select(*keys).distinct()
    out: list[tuple[str, str]] = []
    for i, x in enumerate(q.items):
        out += [(n, c) for _, c, n, _ in scope.columns] if x.what == "*" and not x.call else [(place[i] if i in place else scope.find(x.what)[0], x.label())]
    shown = {n for n, _ in out}
    if q.group and (hidden := shown - set(place.values()) - set(keys)):
        raise unsupported(f"{len(hidden)} columns that are not in GROUP BY")
    if q.distinct:
        df = df.select(*dict.fromkeys(n for n, _ in out)).distinct()
    if q.order:
        by = [scope.find(r, first=mode == COMPAT)[0] for r, _ in q.order]
        if q.group and set(by) - set(keys) or q.distinct and set(by) - shown:
            raise unsupported("ORDER BY a column that is not in the result")
        df = df.orderBy(*(F.col(k).desc_nulls_last() if d else F.col(k).asc_nulls_first() for k, (_, d) in zip(by, q.order, strict=True)))
    return _cut(df, q).select(*(F.col(n).alias(c) for n, c in out))


def _cut(df: DataFrame, q: Select) -> DataFrame:
    df = df if q.offset is None else df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)
