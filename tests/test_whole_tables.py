"""Queries over whole tables miss no row."""

from collections import Counter

import pytest

from tidewell import plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["a10_array_agg_whole", "a11_list_whole"])
def test_parts_of_every_order(spark, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    got = plans.queries()[name](spark, SF).selectExpr("count(*) as orders", "sum(size(split(parts, ','))) as parts").first()
    assert tuple(got) == (lines.select("l_orderkey").distinct().count(), lines.count()) and lines.where("l_orderkey >= 3000").count() > 0


def test_sets_of_all_nation_keys(spark):
    a, b = ([r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()] for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    left, right = Counter(a), Counter(b)
    expected = {
        "x1_union_all": left + right, "x2_union_distinct": Counter({*a, *b}), "x3_intersect_distinct": Counter({*a} & {*b}), "x4_intersect_all": left & right, "x5_except_distinct": Counter({*a} - {*b}),
        "x6_except_all": left - right, "x5_except_distinct_reverse": Counter({*b} - {*a}), "x6_except_all_reverse": right - left,
    }
    for name, keys in expected.items():
        assert Counter(r.k for r in plans.queries()[f"{name}_whole"](spark, SF).collect()) == keys, name
    pairs = {(r.leftk, r.rightk): r.n for r in plans.queries()["g6_combine_names_whole"](spark, SF).collect()}
    assert pairs == {(x, y): left[x] * right[y] for x in left for y in right} and sum(pairs.values()) == len(a) * len(b)


def test_filters_by_attributes_see_all_keys(spark):
    orders, customers = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    kept = {r[0] for r in plans.queries()["p5_where_whole"](spark, SF).select("o_orderkey").collect()}
    assert any(r.o_custkey >= 500 for r in orders.collect() if r.o_orderkey in kept)
    got = {r.c_custkey for r in plans.queries()["j4_full_join_whole"](spark, SF).collect()} - {None}
    assert got == {r.c_custkey for r in customers.where("c_mktsegment = 'BUILDING'").collect()} and max(got) > 60
