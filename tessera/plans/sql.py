"""A parser for the statements: SELECT, INSERT, UPDATE, DELETE, CREATE TABLE, CREATE INDEX, DROP TABLE.

What the dialect does not have is rejected with SQLSTATE 0A000, never ignored, except for clauses without effect here:
FOR UPDATE, and column constraints, defaults, UNIQUE and FOREIGN KEY in CREATE TABLE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.functions.errors import SqlError, unsupported
from tessera.functions.predicates import OPS, Predicate, Ref
from tessera.functions.types import Literal, column_type
from tessera.operators.dml import Assignment
from tessera.operators.relational import Item, Select

_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|('(?:[^']|'')*')|("(?:[^"]|"")+")|((?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_$]*)|(<=|>=|<>|!=|\|\||::|[-+*/%(),.;=<>?\[\]])""", re.S)


@dataclass(frozen=True)
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Literal]]


@dataclass(frozen=True)
class Update:
    table: str
    sets: list[Assignment]
    where: tuple[Predicate, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Predicate, ...]


@dataclass(frozen=True)
class CreateTable:
    table: str
    schema: T.StructType
    key: list[str]


@dataclass(frozen=True)
class CreateIndex:
    table: str
    columns: list[str]


@dataclass(frozen=True)
class DropTable:
    table: str


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text): str, num, word (lower case), op; quoted identifiers are of kind name."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"cannot read SQL at {sql[at : at + 20]!r}")
        at = m.end()
        s, q, n, w, o = m.groups()
        if s is not None:
            out.append(("str", s[1:-1].replace("''", "'")))
        elif q is not None:
            out.append(("name", q[1:-1].replace('""', '"')))
        elif n is not None:
            out.append(("num", n))
        elif w is not None:
            out.append(("word", w.lower()))
        elif o is not None:
            out.append(("op", o))
    return out


class Parser:
    def __init__(self, sql: str, params: list | None = None):
        self.toks, self.at, self.params = tokens(sql), 0, list(params or [])

    # --- tokens ---

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.toks) and self.toks[i][0] in ("word", "op") and self.toks[i][1] in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        for t in texts:
            if not self.take(t):
                raise unsupported(f"expected {t.upper()} but found {self.rest()}")

    def rest(self) -> str:
        return repr(" ".join(t for _, t in self.toks[self.at : self.at + 4])) if self.at < len(self.toks) else "the end"

    def name(self) -> str:
        if self.at < len(self.toks) and self.toks[self.at][0] in ("word", "name"):
            self.at += 1
            return self.toks[self.at - 1][1]
        raise unsupported(f"expected a name but found {self.rest()}")

    def table(self) -> str:
        n = self.name()
        while self.take("."):
            n = self.name()  # a schema prefix has no effect
        return n

    def end(self) -> None:
        self.take(";")
        if self.at < len(self.toks):
            raise unsupported(f"unsupported SQL at {self.rest()}")
        if self.params:
            raise SqlError(f"{len(self.params)} parameters too many")

    # --- pieces ---

    def literal(self) -> Literal:
        if self.take("?"):
            if not self.params:
                raise SqlError("a parameter is missing")
            return Literal.of(self.params.pop(0))
        sign = ""
        while self.peek("-", "+"):
            sign = "" if (self.toks[self.at][1] == "-") == (sign == "-") else "-"
            self.at += 1
        if self.at < len(self.toks):
            kind, text = self.toks[self.at]
            if kind == "num":
                self.at += 1
                whole = text.isdigit() and abs(int(text)) < 1 << 31
                return Literal("int" if whole or text.isdigit() else "float", sign + text)
            if not sign and kind == "str":
                self.at += 1
                return Literal("string", text)
            if not sign and kind == "word" and text in ("null", "true", "false"):
                self.at += 1
                return Literal("null") if text == "null" else Literal("bool", text)
        raise unsupported(f"expected a literal but found {self.rest()}")

    def ref(self) -> Ref:
        a = self.name()
        if not self.take("."):
            return Ref(a)
        b = self.name()
        if self.peek("."):
            raise unsupported("names of three parts")
        return Ref(b, a)

    def operand(self) -> Ref | Literal:
        if self.take("("):
            out = self.operand()
            self.need(")")
            return out
        k, t = self.toks[self.at] if self.at < len(self.toks) else ("", "")
        if k == "name" or (k == "word" and t not in ("null", "true", "false", "not", "exists", "case", "select", "cast")):
            out = self.ref()
            if self.peek("("):
                raise unsupported("functions in predicates")
            return out
        return self.literal()

    def where(self) -> tuple[Predicate, ...]:
        return tuple(self.conjuncts()) if self.take("where") else ()

    def conjuncts(self) -> list[Predicate]:
        out = self.comparison()
        while self.take("and"):
            out += self.comparison()
        if self.peek("or"):
            raise unsupported("only AND of comparisons is supported")
        return out

    def comparison(self) -> list[Predicate]:
        if self.peek("not"):
            raise unsupported("only AND of comparisons is supported")
        mark, params = self.at, list(self.params)
        if self.take("("):
            try:
                inner = self.conjuncts()
                self.need(")")
                return inner
            except SqlError:
                self.at, self.params = mark, params
        left = self.operand()
        op = self.toks[self.at][1] if self.at < len(self.toks) else ""
        if op not in OPS:
            raise unsupported(f"unsupported comparison at {self.rest()}")
        self.at += 1
        right = self.operand()
        if isinstance(left, Literal) and isinstance(right, Literal):
            raise unsupported("a comparison needs a column")
        return [Predicate(left, op, right)]

    def names(self) -> list[str]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return out

    # --- statements ---

    def item(self) -> Item:
        if self.take("*"):
            return Item("*")
        if self.peek("count", "sum") and self.peek("(", ahead=1):
            call = self.name()
            self.need("(")
            distinct = self.take("distinct")
            extra = 0
            while self.take("("):
                extra += 1
            what = "*" if self.take("*") else self.ref()
            for _ in range(extra + 1):
                self.need(")")
            if distinct and (what == "*" or call == "sum"):
                raise unsupported(f"{call}(distinct {what})")
            if self.peek("over", "filter", "within"):
                raise unsupported(f"unsupported clause at {self.rest()}")
            out = Item(what, call, distinct)
        else:
            if self.at >= len(self.toks) or self.toks[self.at][0] not in ("word", "name"):
                raise unsupported("unsupported select item")
            out = Item(self.ref())
            if self.peek("("):
                raise unsupported("unsupported function")
            if self.peek("+", "-", "*", "/", "::", "||"):
                raise unsupported("unsupported select item")
        if self.take("as"):
            return Item(out.what, out.call, out.distinct, self.name())
        if self.at < len(self.toks) and (self.toks[self.at][0] == "name" or self.toks[self.at][0] == "word" and not self.peek("from")):
            return Item(out.what, out.call, out.distinct, self.name())
        return out

    def select(self) -> Select:
        if self.peek("all"):
            raise unsupported("SELECT ALL")
        distinct = self.take("distinct")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("from")
        tables = [self.table()]
        while self.take(","):
            tables.append(self.table())
        where = self.where()
        group: list[Ref] = []
        if self.take("group"):
            self.need("by")
            group.append(self.ref())
            while self.take(","):
                group.append(self.ref())
        order: list[tuple[Ref, bool]] = []
        if self.take("order"):
            self.need("by")
            while True:
                ref = self.ref()
                down = self.take("desc")
                if not down:
                    self.take("asc")
                order.append((ref, down))
                if not self.take(","):
                    break
        limit = self._whole() if self.take("limit") else None
        offset = self._whole() if self.take("offset") else None
        if self.take("for"):
            self.need("update")
        if len(set(tables)) < len(tables):
            raise unsupported("a table is named twice in FROM")
        return Select(tuple(tables), tuple(items), where, tuple(order), limit, bool(distinct), tuple(group), offset)

    def _whole(self) -> int:
        lit = self.literal()
        if lit.kind != "int" or int(lit.text) < 0:
            raise unsupported("LIMIT and OFFSET need a whole number")
        return int(lit.text)

    def insert(self) -> Insert:
        self.need("into")
        table = self.table()
        columns = self.names() if self.peek("(") else None
        self.need("values")
        rows = []
        while True:
            self.need("(")
            row = [self.literal()]
            while self.take(","):
                row.append(self.literal())
            self.need(")")
            rows.append(row)
            if not self.take(","):
                return Insert(table, columns, rows)

    def update(self) -> Update:
        table = self.table()
        self.need("set")
        sets = []
        while True:
            column = self.name()
            self.need("=")
            k = self.toks[self.at][0] if self.at < len(self.toks) else ""
            if k in ("word", "name") and not self.peek("null", "true", "false"):
                ref = self.ref()
                if ref.name.lower() != column.lower() or not self.peek("+", "-"):
                    raise unsupported("SET takes a literal, or the column itself plus or minus one")
                sign = "+" if self.take("+") else "-" if self.take("-") else None
                sets.append(Assignment(column, self.literal(), sign))
            else:
                sets.append(Assignment(column, self.literal()))
            if not self.take(","):
                return Update(table, sets, self.where())

    def create_table(self) -> CreateTable:
        table = self.table()
        self.need("(")
        fields, key = [], []
        while True:
            if self.peek("primary", "constraint", "unique", "foreign", "check"):
                if self.take("constraint"):
                    self.name()
                if self.take("primary"):
                    self.need("key")
                    key = self.names()
                else:
                    self._skip()
            else:
                name, kind = self.name(), self._type()
                fields.append(T.StructField(name.lower(), column_type(kind, name)))
                self._skip()  # NOT NULL, DEFAULT and the like
            if not self.take(","):
                break
        self.need(")")
        return CreateTable(table, T.StructType(fields), [k.lower() for k in key])

    def _type(self) -> str:
        out = self.table()
        if out == "double" and self.take("precision"):
            out = "double precision"
        elif out == "character" and self.take("varying"):
            out = "character varying"
        if self.peek("("):
            self._parens()
        if out == "timestamp" and self.peek("without", "with"):
            with_zone = self.peek("with")
            self.at += 1
            self.need("time", "zone")
            out = "timestamptz" if with_zone else "timestamp"
        return out

    def _parens(self) -> None:
        depth = 0
        while self.at < len(self.toks):
            depth += self.peek("(") - self.peek(")")
            self.at += 1
            if not depth:
                return

    def _skip(self) -> None:
        while self.at < len(self.toks) and not self.peek(",", ")"):
            if self.peek("("):
                self._parens()
            else:
                self.at += 1

    def create_index(self) -> CreateIndex:
        if not self.peek("on"):
            self.name()
        self.need("on")
        return CreateIndex(self.table(), self.names())

    def drop(self) -> DropTable:
        self.need("table")
        if self.take("if"):
            self.need("exists")
        out = DropTable(self.table())
        self.take("cascade", "restrict")
        return out

    def statement(self):
        if self.take("select"):
            out = self.select()
        elif self.take("insert"):
            out = self.insert()
        elif self.take("update"):
            out = self.update()
        elif self.take("delete"):
            self.need("from")
            out = Delete(self.table(), self.where())
        elif self.take("create"):
            self.take("unique")
            out = self.create_index() if self.take("index") else self._create()
        elif self.take("drop"):
            out = self.drop()
        else:
            raise unsupported(f"unsupported SQL at {self.rest()}")
        self.end()
        return out

    def _create(self) -> CreateTable:
        self.need("table")
        return self.create_table()


def parse(sql: str, params: list | None = None):
    """One statement; ``?`` outside quotes takes the next parameter."""
    return Parser(sql, params).statement()
