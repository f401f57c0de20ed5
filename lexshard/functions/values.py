"""Kinds of posting values: their Spark types, and the checks that every value passes on its way in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ValueKind:
    """A named kind of value. low and high bound integers that Spark's type alone does not. store and load turn values of the
    user into those of spark_type, in whose order they are kept, and back; frames hold the latter."""

    name: str
    spark_type: T.DataType
    low: int | None = None
    high: int | None = None
    store: Callable | None = None
    load: Callable | None = None

    def stored(self, value: object) -> object:
        return self.store(value) if self.store and value is not None else value

    def loaded(self, value: object) -> object:
        return self.load(value) if self.load and value is not None else value

    @property
    def ddl(self) -> str:
        return self.spark_type.simpleString()

    def is_bad(self, value: Column) -> Column:
        """Whether a value can't be a posting: NaN, or outside the kind's bounds."""
        bad = F.lit(False)
        if isinstance(self.spark_type, (T.DoubleType, T.FloatType)):
            bad = bad | F.isnan(value)
        if self.low is not None:
            bad = bad | (value < F.lit(self.low).cast(self.spark_type))
        if self.high is not None:
            bad = bad | (value > F.lit(Decimal(self.high)).cast("decimal(20,0)"))
        return bad

    def literal(self, value: object) -> Column:
        """A bound of a range, in this kind's type. Integers beyond the type's range become its ends."""
        value = self.stored(value)
        if isinstance(value, int) and isinstance(self.spark_type, (T.LongType, T.IntegerType)):
            bits = 63 if isinstance(self.spark_type, T.LongType) else 31
            value = min(max(value, -(1 << bits)), (1 << bits) - 1)
        if isinstance(self.spark_type, T.DecimalType):
            value = Decimal(min(max(int(value), -(10**20) + 1), 10**20 - 1))  # type: ignore[call-overload]
        return F.lit(value).cast(self.spark_type)


KINDS = {
    k.name: k
    for k in (
        ValueKind("int64", T.LongType()),
        ValueKind("int32", T.IntegerType()),
        ValueKind("uint32", T.LongType(), 0, (1 << 32) - 1),
        ValueKind("uint64", T.DecimalType(20, 0), 0, (1 << 64) - 1),
        ValueKind("float64", T.DoubleType()),
        ValueKind("float32", T.FloatType()),
        ValueKind("string", T.StringType()),
        ValueKind("date", T.DateType()),
        ValueKind("timestamp", T.TimestampNTZType()),
    )
}


def kind_of(name: str) -> ValueKind:
    if name not in KINDS:
        raise ValueError(f"unknown kind of value {name!r}; there are {', '.join(KINDS)}")
    return KINDS[name]


def register(kind: ValueKind) -> None:
    """Make a kind of the user's known by its name, in this process. A name stands for one kind."""
    if KINDS.get(kind.name, kind) != kind:
        raise ValueError(f"there is another kind of value {kind.name!r}")
    KINDS[kind.name] = kind
