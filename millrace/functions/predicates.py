"""Constraints on named attributes, as Columns that reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Op(Enum):
    """Equal, greater, less, different; of strings also prefix and contained."""

    EQ = "="
    GT = ">"
    LT = "<"
    DF = "<>"
    PF = "prefix"
    IN = "contains"


NUMERIC = {Op.EQ: Column.__eq__, Op.GT: Column.__gt__, Op.LT: Column.__lt__, Op.DF: Column.__ne__}
STRING = {Op.EQ: Column.__eq__, Op.DF: Column.__ne__, Op.PF: Column.startswith, Op.IN: Column.contains}


@dataclass(frozen=True)
class Constraint:
    """attribute op value. A number is compared with whole-number columns, a string with string columns; any other
    pairing, a missing attribute and a null never hold."""

    attribute: str
    op: Op
    value: int | str

    def __post_init__(self):
        if self.op not in (STRING if isinstance(self.value, str) else NUMERIC):
            raise ValueError(f"{self.op.name} doesn't apply to {type(self.value).__name__}")

    def column(self, schema: T.StructType) -> Column:
        kind = schema[self.attribute].dataType if self.attribute in schema.names else None
        if isinstance(self.value, str):
            return STRING[self.op](F.col(self.attribute), self.value) if isinstance(kind, T.StringType) else F.lit(False)
        return NUMERIC[self.op](F.col(self.attribute), F.lit(self.value)) if isinstance(kind, T.IntegralType) else F.lit(False)


def keep(df: DataFrame, *constraints: Constraint) -> DataFrame:
    """Rows that meet all constraints; of none, all rows. Stacked calls become one filter in the plan."""
    return df.where(reduce(and_, [c.column(df.schema) for c in constraints])) if constraints else df
