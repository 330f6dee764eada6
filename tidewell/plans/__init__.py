"""One query for each operator, and the SQL that says the same."""

from tidewell.plans import grouping, relational, rowsets, storage, values  # noqa: F401
from tidewell.plans.registry import QUERIES, SQL

SMALLEST = "flagship_top_nations"


def flagship(spark, sf_dir):
    return QUERIES[SMALLEST](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
