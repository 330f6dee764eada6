"""Table functions whose columns follow their arguments; called as objects, so that nothing is registered in a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException

from tidewell.session import ship


def _constant(a: AnalyzeArgument, kind: type, what: str):
    if a.isTable or not a.isConstantExpression or not isinstance(a.value, kind):
        raise ValueError(f"{what} must be a constant")
    return a.value


class TypedView:
    """A table with one of its text columns read as a hexadecimal number (``typed``) or left as it is (``untyped``)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, mode: AnalyzeArgument) -> AnalyzeResult:
        name, how = _constant(column, str, "the column"), _constant(mode, str, "the mode")
        if how not in ("typed", "untyped"):
            raise ValueError(f"typed or untyped, not {how!r}")
        if name not in rows.dataType.names or not isinstance(rows.dataType[name].dataType, T.StringType):
            raise ValueError(f"no text column {name}")
        fields = [T.StructField(f.name, T.LongType() if how == "typed" and f.name == name else f.dataType) for f in rows.dataType]
        return AnalyzeResult(schema=T.StructType(fields))

    def eval(self, row: Row, column: str, mode: str):
        if mode == "untyped":
            yield tuple(row)
        else:
            yield tuple(int(v.removeprefix("#"), 16) if n == column and v is not None else v for n, v in row.asDict().items())


class FirstOfEach:
    """The first rows of each group in an order, with their places; the table's columns, whatever they are."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        names = _constant(by, str, "the group").split(","), _constant(order, str, "the order").split(",")
        if _constant(n, int, "the number") < 1:
            raise ValueError("at least one row")
        for c in [*names[0], *(x.removeprefix("-") for x in names[1])]:
            if c not in rows.dataType.names:
                raise ValueError(f"no column {c}")
        fields = [T.StructField(f.name, f.dataType) for f in rows.dataType]
        ordering = [OrderingColumn(x.removeprefix("-"), ascending=not x.startswith("-")) for x in names[1]]
        return AnalyzeResult(schema=T.StructType([*fields, T.StructField("place", T.IntegerType())]), partitionBy=[PartitioningColumn(c) for c in names[0]], orderBy=ordering)

    def __init__(self):
        self.place = 0

    def eval(self, row: Row, by: str, order: str, n: int):
        if self.place >= n:
            raise SkipRestOfInputTableException("enough rows of this group")
        self.place += 1
        yield (*row, self.place)


def typed_view(df: DataFrame, column: str, mode: str) -> DataFrame:
    ship(df.sparkSession)
    return F.udtf(TypedView)(df.asTable(), F.lit(column), F.lit(mode))


def first_of_each(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; the rest of a group isn't read into Python. ``order``: names, after a minus sign if they descend."""
    ship(df.sparkSession)
    return F.udtf(FirstOfEach)(df.asTable(), F.lit(",".join(by)), F.lit(",".join(order)), F.lit(n))
