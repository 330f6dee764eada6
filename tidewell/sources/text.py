"""Delimited text with a declared schema, read and written without changing a byte.

Rules of the format: no header, tab by default, quotes are data, blank lines are skipped,
a leading byte-order mark is dropped. An empty field of a plain string column is the empty
string; of a nullable column it is null. Numbers that don't parse are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of column types in a schema string; a question mark after a name makes it nullable.
TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "uint": T.LongType(), "byte": T.ShortType(), "short": T.ShortType(),
    "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampNTZType(), "date": T.DateType(),
}


def schema_of(columns: str) -> T.StructType:
    """``"a, b:int, c:double?"`` as a schema. A column without a type is a string."""
    fields = []
    for part in columns.split(","):
        name, _, kind = (x.strip() for x in part.strip().partition(":"))
        kind = kind or "string"
        base = kind.rstrip("?").lower()
        if not name or base not in TYPES:
            raise ValueError(f"not a column: {part.strip()!r}")
        fields.append(T.StructField(name, TYPES[base], kind.endswith("?")))
    return T.StructType(fields)


def read_text(spark: SparkSession, path: str | list[str], columns: str, sep: str = "\t") -> DataFrame:
    """The rows of one or many files, read in one scan."""
    schema = schema_of(columns)
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    df = spark.read.schema(loose).options(sep=sep, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) and not f.nullable else F.col(f"`{f.name}`") for f in schema])


def write_text(df: DataFrame, path: str, sep: str = "\t", escape: bool = False) -> None:
    """Rows as lines. ``escape`` writes tabs, line ends and backslashes inside a string as \\t, \\n, \\r and \\\\."""
    if escape:
        df = df.select(*[escaped(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])
    df.write.options(sep=sep, quote="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def escaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def unescaped(c: Column) -> Column:
    """The inverse of ``escaped``: doubled backslashes, found from the left, cut the text; the others are read between them."""

    def part(x: Column) -> Column:
        for raw, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            x = F.replace(x, F.lit(name), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole lines in one column ``line``."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_lines(lines: DataFrame, columns: str, sep: str = "\t", upper: bool = False) -> DataFrame:
    """A line parser as column expressions: fields of ``line``, cast; ``upper`` changes string columns only."""
    parts = F.split("line", f"\\Q{sep}\\E", -1)
    out = []
    for i, f in enumerate(schema_of(columns)):
        value = F.get(parts, F.lit(i))
        if isinstance(f.dataType, T.StringType):
            value = F.upper(value) if upper else value
        else:
            value = value.try_cast(f.dataType)
        out.append(value.alias(f.name))
    return lines.select(*out)


def format_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """One text column ``value``: a row's fields joined, nulls as empty."""
    return df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
