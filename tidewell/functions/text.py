"""Column functions on text whose semantics Spark's own functions don't give as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token that stands for null in text files.
NULL_TOKEN = "NULL"


def contains_any_case(text: Column, part: Column | str) -> Column:
    """Whether text has the part, whatever their cases; null is false."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def contains_one_of(text: Column, parts: list[str]) -> Column:
    """Whether text has one of the parts, whatever their cases; null and no parts are false."""
    if not parts:
        return F.lit(False)
    return F.coalesce(text.rlike("(?iu)" + "|".join(re.escape(p) for p in parts)), F.lit(False))


def null_token(text: Column) -> Column:
    return F.nullif(text, F.lit(NULL_TOKEN))


def tokens(text: Column, sep: str) -> Column:
    """Parts between a literal separator."""
    return F.split(text, re.escape(sep), -1)


def token(text: Column, sep: str, n: int) -> Column:
    """The n-th part from 0, null beyond the last."""
    return F.get(tokens(text, sep), F.lit(n))


def token_count(text: Column, sep: str = ";") -> Column:
    """Number of parts; 0 for the null token."""
    return F.when(text == NULL_TOKEN, 0).otherwise(F.size(tokens(text, sep)))


def from_start(text: Column, start: int) -> Column:
    """Characters from a start counted from 0 to the end; empty beyond the end."""
    return F.substring(text, F.lit(start + 1), F.length(text))


def index_of(text: Column, part: str) -> Column:
    """Place of a part from 0; -1 if there is none."""
    return F.instr(text, part) - 1


def hex_number(text: Column) -> Column:
    """An unsigned number from hexadecimal digits."""
    return F.conv(text, 16, 10).cast("long")


def digits(text: Column) -> Column:
    """1 for each character but '0', 0 for '0', as an array."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (c != "0").cast("int"))


def numbers(text: Column, sep: str = ",") -> Column:
    """An array of whole numbers from text."""
    return F.transform(tokens(text, sep), lambda x: F.trim(x).cast("int"))


def joined(array: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), sep)


def version(text: Column) -> Column:
    """The parts of a dotted version as numbers, which compare part by part; '?' is 0."""
    return F.transform(F.split(F.replace(F.trim(text), F.lit("?"), F.lit("0")), r"\."), lambda x: x.cast("int"))


def version_text(v: Column) -> Column:
    return joined(v, ".")


def domain(url: Column) -> Column:
    """The last two dotted parts of the host, or its only part; "d-card:" links stay whole.

    A scheme before the host is dropped first.
    """
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    host = F.split(F.split_part(bare, F.lit("/"), F.lit(1)), r"\.")
    two = F.concat_ws(".", F.get(host, F.size(host) - 2), F.get(host, F.size(host) - 1))
    return F.when(url.startswith("d-card:"), url).when(F.size(host) > 1, two).otherwise(F.get(host, F.lit(0)))


def click_position(results: Column, clicks: Column, n: int, legacy_scan: bool = False) -> Column:
    """Place from 1 of the n-th click among the results, 0 if absent.

    ``legacy_scan`` looks only at as many results as there are clicks.
    """
    where = F.slice(results, 1, F.size(clicks)) if legacy_scan else results
    return F.coalesce(F.array_position(where, F.get(clicks, F.lit(n - 1))), F.lit(0))


def page_view(results: Column, clicks: Column, sep: str = ";") -> Column:
    """A struct of two lists without null tokens; a null argument is an error."""
    part = lambda c: F.when(c.isNull(), F.raise_error(F.lit("results and clicks must be given"))).otherwise(F.filter(tokens(c, sep), lambda x: x != NULL_TOKEN))
    return F.struct(part(results).alias("results"), part(clicks).alias("clicks"))


def shape(kind: Column, values: Column) -> Column:
    """A tagged struct for Shape, Rect or Circle from its numbers; another kind is an error."""
    at = lambda i: F.get(values, F.lit(i))
    known = F.when(kind.isin("Shape", "Rect", "Circle"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind "), kind)))
    return F.struct(known.alias("kind"), at(0).alias("id"), F.when(kind == "Rect", at(1)).alias("width"), F.when(kind == "Rect", at(2)).alias("height"), F.when(kind == "Circle", at(1)).alias("radius"))
