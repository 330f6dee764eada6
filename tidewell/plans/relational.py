"""Projection, filters, joins, sets, sorting and control."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.text import null_token
from tidewell.operators import rowsets as rs
from tidewell.operators.windows import with_total
from tidewell.plans.registry import Tables, query


def top_nations(t: Tables):
    """Revenue by nation, the five greatest."""
    c, n = t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name")
    o = t.orders.select("o_custkey", "o_totalprice")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("s"))
    return joined.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("s", 2).alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(5)


query("flagship_top_nations", "select n_name, round(sum(o_totalprice), 2) as revenue from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name order by revenue desc, n_name limit 5")(top_nations)

# projection and filters

query("p1_projection", "select c_custkey, c_name from customer")(lambda t: t.customer.select("c_custkey", "c_name"))
query("p2_star_and_more", "select *, s_suppkey * 10 as ten from supplier")(lambda t: t.supplier.select("*", (F.col("s_suppkey") * 10).alias("ten")))
query("p3_qualified_star", "select s.*, n.* from supplier s join nation n on s_nationkey = n_nationkey")(lambda t: t.supplier.alias("s").join(t.nation.alias("n"), F.expr("s_nationkey = n_nationkey")).select("s.*", "n.*"))
query("p4_computed_column", "select o_orderkey, round(o_totalprice / 1000.0, 6) as thousands from orders")(lambda t: t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 1000.0, 6).alias("thousands")))
query("p5_where", "select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_orderstatus != 'F'")(lambda t: t.orders.where("o_totalprice >= 100000 and o_orderstatus != 'F'").select("o_orderkey", "o_totalprice"))
query("p5_where_whole", "select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice < 400000 and o_orderstatus != 'F' and o_orderpriority = '1-URGENT'")(lambda t: t.orders.where("o_totalprice >= 100000 and o_totalprice < 400000 and o_orderstatus != 'F' and o_orderpriority == '1-URGENT'").select("o_orderkey", "o_totalprice"))
query("p6_or_and", "select c_custkey from customer where (c_mktsegment = 'BUILDING' or c_mktsegment = 'FURNITURE') and c_acctbal > 0")(lambda t: t.customer.where(((F.col("c_mktsegment") == "BUILDING") | (F.col("c_mktsegment") == "FURNITURE")) & (F.col("c_acctbal") > 0)).select("c_custkey"))
query("p7_guarded_test", "select doc_id from documents where case when text is not null then starts_with(text, 'The') else false end")(lambda t: t.documents.where(F.when(F.col("text").isNotNull(), F.col("text").startswith("The")).otherwise(False)).select("doc_id"))
query("p8_negation", "select doc_id from documents where not contains(text, 'the')")(lambda t: t.documents.where(~F.col("text").contains("the")).select("doc_id"))
query("p9_in_list", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")(lambda t: t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment"))
query("p10_having_on_alias", "select * from (select o_orderkey, round(o_totalprice * 0.1, 4) as tenth from orders) where tenth > 40000")(lambda t: rs.having(t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 0.1, 4).alias("tenth")), "tenth > 40000"))
query("p11_where_then_having", "select * from (select o_orderkey, o_totalprice - 100 as less from orders where o_orderstatus = 'O') where less < 5000")(lambda t: rs.having(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", (F.col("o_totalprice") - 100).alias("less")), F.col("less") < 5000))
query("p12_having_on_scan", "select event_id, event_type from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-07'")(lambda t: rs.having(t.events.select("event_id", "event_type", "ts"), "ts >= timestamp_ntz '2024-01-05 00:00:00' and ts < timestamp_ntz '2024-01-07 00:00:00'").drop("ts"))
query("p13_null_tests", "select (quality is null) as unlabelled, count(*) as n from documents left join labels using (doc_id) group by 1")(lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(F.col("quality").isNull().alias("unlabelled")).agg(F.count("*").alias("n")))
query("p14_conditional", "select user_id, sum(case when event_type = 'click' then 1 else 0 end) as clicks from events group by user_id")(lambda t: t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("clicks")))
query("p15_null_token", "select c_custkey, nullif(case when c_nationkey = 0 then 'NULL' else c_name end, 'NULL') as name from customer")(lambda t: t.customer.select("c_custkey", null_token(F.when(F.col("c_nationkey") == 0, "NULL").otherwise(F.col("c_name"))).alias("name")))
query("p16_casts", "select o_orderkey, cast(floor(o_totalprice) as bigint) as whole, cast(o_orderkey as double) as d from orders")(lambda t: t.orders.select("o_orderkey", F.floor("o_totalprice").cast("long").alias("whole"), F.col("o_orderkey").cast("double").alias("d")))
query("p17_parameters", "select count(*) as n from orders where o_orderdate >= timestamp '1997-01-01' and o_totalprice > 1000.5 and o_orderstatus = 'P'")(lambda t: t.sql("select count(*) as n from {orders} where o_orderdate >= to_timestamp_ntz(:since) and o_totalprice > :least and o_orderstatus = :status", "orders", since="1997-01-01", least=1000.5, status="P"))
query("p18_map_parameter", "select c_custkey, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 end as code from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")(
    lambda t: t.customer.withColumn("code", F.element_at(F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2)), F.col("c_mktsegment"))).where("code is not null").select("c_custkey", "code")
)


def by_prefix(df, column: str, prefix: str):
    """Rows whose column starts so; '*' stands for all."""
    return df if prefix == "*" else df.where(F.col(column).startswith(prefix))


query("p19_conditional_plan", "select 'star' as kind, count(*) as n from part union all select 'red', count(*) from part where p_name like 'red%'")(
    lambda t: by_prefix(t.part, "p_name", "*").agg(F.count("*").alias("n")).select(F.lit("star").alias("kind"), "n").unionAll(by_prefix(t.part, "p_name", "red").agg(F.count("*").alias("n")).select(F.lit("red").alias("kind"), "n"))
)
query("p20_subselect", "select round(sum(x), 2) as s from (select o_totalprice as x from orders where o_orderstatus = 'F')")(lambda t: t.sql("select round(sum(x), 2) as s from (select o_totalprice as x from {orders} where o_orderstatus = 'F')", "orders"))
query("p21_table_name", "select count(*) as n from supplier")(lambda t: getattr(t, "supplier").agg(F.count("*").alias("n")))

# joins

CO = "c_custkey = o_custkey"
query("j1_inner_join", "select c_name, o_orderkey from customer join orders on c_custkey = o_custkey")(lambda t: t.customer.join(t.orders, F.expr(CO)).select("c_name", "o_orderkey"))
query("j2_left_join", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 450000")(lambda t: t.customer.join(t.orders, F.expr(CO + " and o_totalprice > 450000"), "left").select("c_custkey", "o_orderkey"))
query("j3_right_join", "select c_custkey, o_orderkey from (select * from customer where c_acctbal < 0) c right join orders on c_custkey = o_custkey")(lambda t: t.customer.where("c_acctbal < 0").join(t.orders, F.expr(CO), "right").select("c_custkey", "o_orderkey"))
query("j4_full_join", "select s_suppkey, c_custkey from (select * from supplier where s_acctbal > 5000) s full join (select * from customer where c_acctbal < 0) c on s_suppkey = c_custkey")(lambda t: t.supplier.where("s_acctbal > 5000").join(t.customer.where("c_acctbal < 0"), F.expr("s_suppkey = c_custkey"), "full").select("s_suppkey", "c_custkey"))
query("j4_full_join_whole", "select s_suppkey, c_custkey from (select * from supplier where s_acctbal > 5000) s full join (select * from customer where c_mktsegment = 'BUILDING') c on s_suppkey = c_custkey")(lambda t: t.supplier.where("s_acctbal > 5000").join(t.customer.where("c_mktsegment = 'BUILDING'"), F.expr("s_suppkey = c_custkey"), "full").select("s_suppkey", "c_custkey"))
query("j5_left_semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")(lambda t: t.customer.join(t.orders.where("o_totalprice > 400000"), F.expr(CO), "left_semi").select("c_custkey"))
query("j6_right_semi_join", "select n_nationkey, n_name from nation where n_nationkey in (select c_nationkey from customer where c_acctbal > 9900)")(lambda t: t.nation.join(t.customer.where("c_acctbal > 9900"), F.expr("c_nationkey = n_nationkey"), "left_semi").select("n_nationkey", "n_name"))
query("j7_cross_join", "select r_name, s.seg from region cross join (select distinct c_mktsegment as seg from customer) s")(lambda t: t.region.crossJoin(t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()).select("r_name", "seg"))
query("j8_comma_join", "select c_custkey, n_name from customer, nation where c_nationkey = n_nationkey")(lambda t: rs.implicit_join(t.customer, t.nation, [("c_nationkey", "n_nationkey")]).select("c_custkey", "n_name"))


def refused(t: Tables):
    """The error of a comma join without an equality, beside the number of rows whose pairs it would have made."""
    try:
        rs.implicit_join(t.customer, t.supplier, [])
    except ValueError as e:
        return t.customer.agg(F.count("*").alias("n")).select(F.lit(str(e)).alias("error"), "n")
    raise AssertionError("a comma join without an equality must fail")


query("j9_comma_join_without_equality", "select 'an implicit join needs an equality between its sides' as error, count(*) as n from customer")(refused)
query("j10_anti_join", "select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")(lambda t: t.part.join(t.lineitem.where("l_quantity > 45"), F.expr("l_partkey = p_partkey"), "left_anti").select("p_partkey"))
query("j11_join_filter_count", "select c_mktsegment, count(*) as n from customer join orders on c_custkey = o_custkey where o_orderstatus = 'O' group by c_mktsegment")(lambda t: t.customer.join(t.orders.where("o_orderstatus = 'O'"), F.expr(CO)).groupBy("c_mktsegment").agg(F.count("*").alias("n")))
query("j12_percent_of_total", "select c_mktsegment, round(100.0 * sum(c_acctbal) / (select sum(c_acctbal) from customer), 6) as pct from customer group by c_mktsegment")(
    lambda t: with_total(t.customer.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s")), total=F.sum("s")).select("c_mktsegment", F.round(100.0 * F.col("s") / F.col("total"), 6).alias("pct"))
)


def looked_up(df, key: str, lookup, lookup_key: str, value: str, dest: str, default: str = "Unknown"):
    """A column from a lookup table, a default where it has no row. Spark broadcasts a lookup of known small size."""
    if key == dest:
        raise ValueError("source and destination must differ")
    side = lookup.select(F.col(lookup_key).alias("_k"), F.col(value).alias("_v")).dropDuplicates(["_k"])
    return df.join(side, df[key] == side["_k"], "left").withColumn(dest, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


query("j13_lookup_with_default", "select s_suppkey, coalesce(n_name, 'Unknown') as nation from supplier left join (select * from nation where n_nationkey < 20) on s_nationkey = n_nationkey")(lambda t: looked_up(t.supplier, "s_nationkey", t.nation.where("n_nationkey < 20"), "n_nationkey", "n_name", "nation").select("s_suppkey", "nation"))

# sorting

query("o1_order_by", "select c_nationkey, count(*) as n from customer group by c_nationkey order by n desc, c_nationkey")(lambda t: t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_nationkey"))
query("o2_top", "select * from orders order by o_orderkey limit 10")(lambda t: t.orders.orderBy("o_orderkey").limit(10))
query("o3_top_parameter", "select p_partkey, p_name from part order by p_partkey limit 7")(lambda t: t.sql("select p_partkey, p_name from {part} order by p_partkey limit :n", "part", n=7))
query("o4_scalar_total", "select round(sum(o_totalprice), 2) as total from orders")(lambda t: t.orders.agg(F.round(F.sum("o_totalprice"), 2).alias("total")).limit(1))
query("o5_aggregate_then_top", "select o_custkey, round(sum(o_totalprice), 2) as total from orders group by o_custkey order by total desc, o_custkey limit 10")(lambda t: t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(10))

# sets

KEYS = {"a": "select c_nationkey as k, c_acctbal > 0 as credit from customer", "b": "select s_nationkey as k, s_acctbal > 0 as credit from supplier"}


def _set(name: str, op: str, fn, first: str = "a", second: str = "b"):
    """A set operation on nations and signs of balances of all customers and all suppliers."""

    def run(t):
        sides = {"a": t.customer.select(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") > 0).alias("credit")), "b": t.supplier.select(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") > 0).alias("credit"))}
        return fn(sides[first], sides[second])

    query(name, f"{KEYS[first]} {op} {KEYS[second]}")(run)


_set("x1_union_all", "union all", lambda a, b: a.unionAll(b))
_set("x2_union_distinct", "union", lambda a, b: a.union(b).distinct())
_set("x3_intersect_distinct", "intersect", lambda a, b: a.intersect(b))
_set("x4_intersect_all", "intersect all", lambda a, b: a.intersectAll(b))
_set("x5_except_distinct", "except", lambda a, b: a.subtract(b))
_set("x6_except_all", "except all", lambda a, b: a.exceptAll(b))
_set("x5_except_distinct_reverse", "except", lambda a, b: a.subtract(b), "b", "a")
_set("x6_except_all_reverse", "except all", lambda a, b: a.exceptAll(b), "b", "a")
ALL_KEYS = {"a": "select c_nationkey as k from customer", "b": "select s_nationkey as k from supplier"}


def _whole_set(name: str, op: str, fn, first: str = "a", second: str = "b"):
    def run(t):
        sides = {"a": t.customer.select(F.col("c_nationkey").alias("k")), "b": t.supplier.select(F.col("s_nationkey").alias("k"))}
        return fn(sides[first], sides[second])

    query(name, f"{ALL_KEYS[first]} {op} {ALL_KEYS[second]}")(run)


_whole_set("x1_union_all_whole", "union all", lambda a, b: a.unionAll(b))
_whole_set("x2_union_distinct_whole", "union", lambda a, b: a.union(b).distinct())
_whole_set("x3_intersect_distinct_whole", "intersect", lambda a, b: a.intersect(b))
_whole_set("x4_intersect_all_whole", "intersect all", lambda a, b: a.intersectAll(b))
_whole_set("x5_except_distinct_whole", "except", lambda a, b: a.subtract(b))
_whole_set("x6_except_all_whole", "except all", lambda a, b: a.exceptAll(b))
_whole_set("x5_except_distinct_reverse_whole", "except", lambda a, b: a.subtract(b), "b", "a")
_whole_set("x6_except_all_reverse_whole", "except all", lambda a, b: a.exceptAll(b), "b", "a")
query("x7_sparse_union", "select c_custkey, c_name, c_acctbal, 0 as s_suppkey, null as s_name from customer union all select 0, null, 0.0, s_suppkey, s_name from supplier")(lambda t: rs.sparse_union(t.customer.select("c_custkey", "c_name", "c_acctbal"), t.supplier.select("s_suppkey", "s_name")))
