"""The three column types and how SQL spellings and literals map to them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

from tessera.functions.errors import SqlError, unsupported

INTEGER, DOUBLE, TEXT = T.IntegerType(), T.DoubleType(), T.StringType()

#: SQL type names, without parameters, by the type that stores them.
SPELLINGS = {
    INTEGER: ("int", "integer", "int4"),
    DOUBLE: ("decimal", "numeric", "real", "float", "float4", "float8", "double precision"),
    TEXT: ("varchar", "char", "character", "character varying", "bpchar", "timestamp", "timestamp without time zone"),
}
_BY_NAME = {name: kind for kind, names in SPELLINGS.items() for name in names}


def column_type(name: str, column: str = "?") -> T.DataType:
    """The storage type of an SQL type name; a schema prefix is ignored, lengths and precisions have no effect."""
    kind = _BY_NAME.get(" ".join(name.lower().rsplit(".", 1)[-1].split()))
    if kind is None:
        raise unsupported(f"unsupported type {name!r} of column {column}")
    return kind


@dataclass(frozen=True)
class Literal:
    """A literal as written: kind int, float, string, bool or null, and its source text."""

    kind: str
    text: str = ""

    @classmethod
    def of(cls, value) -> Literal:
        if value is None:
            return cls("null")
        if isinstance(value, bool):
            return cls("bool", str(value).lower())
        if isinstance(value, int):
            return cls("int", str(value))
        if isinstance(value, float):
            return cls("float", repr(value))
        return cls("string", str(value))

    def coerce(self, to: T.DataType):
        """The Python value for a column of type ``to``; mistyped literals are errors, as are integers beyond 32 bits."""
        if self.kind == "null":
            return None
        if self.kind == "bool" or (to == INTEGER and self.kind == "string"):
            raise SqlError(f"literal {self.text!r} does not fit type {to.simpleString()}")
        if to == TEXT:
            return self.text
        if to == DOUBLE:
            try:
                return float(self.text)
            except ValueError as e:
                raise SqlError(f"literal {self.text!r} is no number") from e
        if to == INTEGER:
            value = math.trunc(float(self.text)) if self.kind == "float" else int(self.text)
            if not -(1 << 31) <= value < 1 << 31:
                raise SqlError(f"literal {self.text} is out of range for integer")
            return value
        return self.natural()

    def natural(self):
        """The value without a target column, for types beyond the three."""
        if self.kind == "null":
            return None
        return {"int": int, "float": float, "bool": lambda x: x == "true"}.get(self.kind, str)(self.text)
