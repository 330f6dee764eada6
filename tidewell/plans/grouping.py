"""Aggregates, user aggregates and windows."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import aggregates as ag
from tidewell.operators import hooks
from tidewell.operators import windows as wi
from tidewell.plans.registry import query

query("a1_sum", "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem group by l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue")))
query("a2_sum_global", "select round(sum(l_quantity), 2) as total from lineitem")(lambda t: t.lineitem.agg(F.round(F.sum("l_quantity"), 2).alias("total")))
query("a3_count_star", "select event_type, count(*) as n from events group by event_type")(lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n")))
query("a4_count_column", "select count(*) as rows_all, count(quality) as labelled, sum(case when quality is null then 0 else 2 end) as entries from documents left join labels using (doc_id)")(
    lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").withColumn("m", F.when(F.col("quality").isNotNull(), F.create_map(F.lit("q"), "quality", F.lit("t"), "toxic"))).agg(F.count("*").alias("rows_all"), F.count("m").alias("labelled"), F.sum(F.coalesce(F.size("m"), F.lit(0))).alias("entries"))
)
query("a5_avg", "select l_returnflag, round(avg(l_discount), 6) as d, round(avg(case when l_quantity > 25 then l_discount end), 6) as d_large from lineitem group by l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg(F.when(F.col("l_quantity") > 25, F.col("l_discount"))), 6).alias("d_large")))
query("a6_min_max", "select l_returnflag, min(l_extendedprice) as low, max(l_extendedprice) as high from lineitem group by l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")))
query("a7_stdev", "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd from lineitem group by l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd")))
query("a8_argmax", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as r from orders) where r = 1")(lambda t: t.orders.groupBy("o_custkey").agg(ag.argmax(F.col("o_totalprice"), F.col("o_orderkey")).alias("o_orderkey")))
query("a8_argmax_global", "select o_orderkey from orders order by o_totalprice desc, o_orderkey desc limit 1")(lambda t: t.orders.agg(ag.argmax(F.col("o_totalprice"), F.col("o_orderkey")).alias("o_orderkey")))
query("a9_argmax_of_itself", "select o_custkey, max(o_totalprice) as top from orders group by o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(ag.argmax(F.col("o_totalprice"), F.col("o_totalprice")).alias("top")))
query("a10_array_agg", "select user_id, string_agg(cast(event_id as varchar), ',' order by event_id) as events from events group by user_id")(lambda t: t.events.groupBy("user_id").agg(fx.joined(F.array_sort(F.array_agg("event_id"))).alias("events")))
query("a11_list", "select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as orders from orders group by o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(fx.joined(F.array_sort(F.collect_list("o_orderkey"))).alias("orders")))
ALL_ITEMS = "select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_partkey) as parts from lineitem group by l_orderkey"
query("a10_array_agg_whole", ALL_ITEMS)(lambda t: t.lineitem.groupBy("l_orderkey").agg(fx.joined(F.array_sort(F.array_agg("l_partkey"))).alias("parts")))
query("a11_list_whole", ALL_ITEMS)(lambda t: t.lineitem.groupBy("l_orderkey").agg(fx.joined(F.array_sort(F.collect_list("l_partkey"))).alias("parts")))
query("a12_string_agg", "select o_custkey, string_agg(o_orderpriority, ';' order by o_orderpriority) as priorities from orders group by o_custkey")(lambda t: t.sql("select o_custkey, listagg(o_orderpriority, ';') within group (order by o_orderpriority) as priorities from {orders} group by o_custkey", "orders"))
LAST = "(select o_custkey, o_orderstatus || '=' || max(o_orderkey) as e from orders group by o_custkey, o_orderstatus)"
query("a13_map_agg", f"select o_custkey, string_agg(e, ';' order by e) as last from {LAST} group by o_custkey")(
    lambda t: ag.map_agg(t.orders, ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";").alias("last"))
)
query("a14_implicit_grouping", "select c_mktsegment, count(*) as n from customer group by c_mktsegment")(lambda t: t.sql("select c_mktsegment, count(*) as n from {customer} group by all", "customer"))
query("a15_having_after_order", "select c_nationkey, count(*) as n from customer group by c_nationkey having count(*) > 60")(lambda t: t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).orderBy(F.desc("n")).where("n > 60"))
query("a16_distinct_by_count", "select event_type, user_id, count(*) as n from events group by event_type, user_id")(lambda t: t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")))
query("a17_sum_all", "select sum(l_orderkey) as l_orderkey, sum(l_linenumber) as l_linenumber, round(sum(l_quantity), 2) as l_quantity from lineitem")(lambda t: ag.sum_all(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")).withColumn("l_quantity", F.round("l_quantity", 2)))
query("a18_share_unlike", "select user_id, round(100.0 * sum(case when event_type <> 'click' then 1 else 0 end) / count(*), 6) as pct from events group by user_id")(lambda t: t.events.groupBy("user_id").agg(F.round(ag.share_unlike(F.col("event_type"), "click"), 6).alias("pct")))

# user aggregates

class Total(hooks.Aggregate):
    """A user's sum, by whole columns."""

    def start(self):
        return None

    def add(self, state, x):
        return self.merge(state, x)

    def add_batch(self, state, x):
        return self.merge(state, pc.sum(x).as_py())

    def merge(self, a, b):
        return b if a is None else a if b is None else a + b

    def finish(self, state):
        return (state,)


class LabelAndTotal(hooks.Aggregate):
    """ "label total" by rows; as rows come in no order, the greatest label stands for the group."""

    def start(self):
        return "", 0

    def add(self, state, x, label):
        return max(state[0], label or ""), state[1] + (x or 0)

    def merge(self, a, b):
        return max(a[0], b[0]), a[1] + b[1]

    def finish(self, state):
        return (f"{state[0]} {state[1]}",)


class ElementSums(hooks.Aggregate):
    """Sums of arrays element by element, as long as the first one; another length is an error."""

    def start(self):
        return None

    def add_batch(self, state, arrays):
        arrays = arrays.drop_null()
        if not len(arrays):
            return state
        n = len(arrays[0])
        if set(arrays.value_lengths().to_pylist()) != {n}:
            raise ValueError("arrays of different lengths")
        return self.merge(state, arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), n).sum(axis=0))

    def merge(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        if len(a) != len(b):
            raise ValueError("arrays of different lengths")
        return a + b

    def finish(self, state):
        return (None if state is None else state.tolist(),)


class ArrayTotal(Total):
    """The sum of all elements of arrays."""

    def add(self, state, array):
        for x in array or ():
            state = self.merge(state, x)
        return state

    def add_batch(self, state, arrays):
        return super().add_batch(state, arrays.flatten())


query("u1_user_sum", "select c_mktsegment, sum(c_nationkey) as s from customer group by c_mktsegment")(lambda t: hooks.aggregate(t.customer, ["c_mktsegment"], ["c_nationkey"], Total(), "s long"))
query("u1_user_sum_of_all", "select sum(l_orderkey) as s, count(*) as n from lineitem")(lambda t: hooks.aggregate(t.lineitem, [], ["l_orderkey"], Total(), "s long").join(t.lineitem.agg(F.count("*").alias("n"))))
query("u2_label_and_total", "select c_nationkey, max(c_mktsegment) || ' ' || cast(sum(c_custkey) as varchar) as s from customer group by c_nationkey")(lambda t: hooks.aggregate(t.customer, ["c_nationkey"], ["c_custkey", "c_mktsegment"], LabelAndTotal(), "s string"))
query("u2_label_and_total_of_lines", "select l_returnflag, max(l_linestatus) || ' ' || cast(sum(l_orderkey) as varchar) as s from lineitem group by l_returnflag")(
    lambda t: hooks.aggregate(t.lineitem, ["l_returnflag"], ["l_orderkey", "l_linestatus"], LabelAndTotal(), "s string")
)
query("u3_user_element_sums", "select l_returnflag, l_linestatus, sum(cast(l_quantity as bigint)) as q, sum(l_orderkey) as o, sum(l_linenumber) as n from lineitem group by l_returnflag, l_linestatus")(
    lambda t: hooks.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [F.array(*[F.col(c).cast("long") for c in ("l_quantity", "l_orderkey", "l_linenumber")])], ElementSums(), "e array<long>").select("l_returnflag", "l_linestatus", *[F.col("e")[i].alias(c) for i, c in enumerate("qon")])
)
query("u3_element_sums", "select label, pos - 1 as pos, round(sum(x), 4) as s from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos")(
    lambda t: ag.element_sums(t.embeddings.withColumn("e", F.col("embedding").cast("array<double>")), ["label"], "e").select("label", F.posexplode("sums").alias("pos", "x")).select("label", "pos", F.round("x", 4).alias("s"))
)
query("u4_array_total", "select l_orderkey, round(sum(l_quantity), 2) as s from lineitem group by l_orderkey")(lambda t: hooks.aggregate(t.lineitem, ["l_orderkey"], [F.array("l_quantity")], ArrayTotal(), "s double").withColumn("s", F.round("s", 2)))


def version_of():
    return F.concat_ws(".", F.lit("1"), (F.col("p_partkey") % 13).cast("string"), (F.col("p_partkey") % 7).cast("string"), F.col("p_size").cast("string"))


VERSION_SQL = "select p_brand, [1, p_partkey % 13, p_partkey % 7, p_size] as v from part"
query("u5_version_min", f"select p_brand, array_to_string(min(v), '.') as v from ({VERSION_SQL}) group by p_brand")(lambda t: t.part.groupBy("p_brand").agg(fx.version_text(ag.version_min(fx.version(version_of()))).alias("v")))
query("u6_version_max", f"select p_brand, array_to_string(max(v), '.') as v from ({VERSION_SQL}) group by p_brand")(lambda t: t.part.groupBy("p_brand").agg(fx.version_text(ag.version_max(fx.version(version_of()))).alias("v")))
query("u7_sample_deviation", "select c_nationkey, round(stddev_samp(c_acctbal), 4) as sd from customer group by c_nationkey")(lambda t: t.customer.groupBy("c_nationkey").agg(F.round(ag.sample_deviation(F.col("c_acctbal")), 4).alias("sd")))
query("u8_population_deviation", "select c_nationkey, round(stddev_pop(c_acctbal), 4) as sd from customer group by c_nationkey")(lambda t: t.customer.groupBy("c_nationkey").agg(F.round(ag.population_deviation(F.col("c_acctbal")), 4).alias("sd")))

# windows


query("w1_row_number", "select event_id, row_number() over (partition by event_type order by value, event_id) as rn from events")(lambda t: wi.ranked(t.events.select("event_id", "event_type", "value"), ["event_type"], ["value", "event_id"], rn="row_number").select("event_id", "rn"))
query("w2_global_row_number", "select o_orderkey, row_number() over (order by o_orderkey) as number from orders")(lambda t: wi.numbered(t.orders.select("o_orderkey"), "o_orderkey"))
LINE = ["l_orderkey", "l_linenumber", "l_partkey"]
for name, kind in (("w3_rank", "rank"), ("w4_dense_rank", "dense_rank"), ("w6_cume_dist", "cume_dist"), ("w7_percent_rank", "percent_rank")):
    query(name, f"select l_orderkey, l_linenumber, l_partkey, round({kind}() over (partition by l_returnflag order by l_quantity), 9) as r from lineitem")(
        lambda t, kind=kind: wi.ranked(t.lineitem.select(*LINE, "l_returnflag", "l_quantity"), ["l_returnflag"], ["l_quantity"], r=kind).select(*LINE, F.round("r", 9).alias("r"))
    )
query("w5_ntile", "select event_id, ntile(4) over (partition by event_type order by value, event_id) as q from events")(lambda t: wi.ranked(t.events.select("event_id", "event_type", "value"), ["event_type"], ["value", "event_id"], q="ntile(4)").select("event_id", "q"))
for name, fn, discrete in (("w8_percentile_cont", "quantile_cont", False), ("w9_percentile_disc", "quantile_disc", True)):
    query(name, f"select e.event_id, round(m, 6) as m from events e join (select event_type, {fn}(value, 0.5) as m from events group by event_type) x using (event_type)")(
        lambda t, discrete=discrete: wi.over_percentile(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", 0.5, "m", discrete).select("event_id", F.round("m", 6).alias("m"))
    )
query("w10_total_over_all", "select o_orderkey, round(100 * o_totalprice / (select sum(o_totalprice) from orders), 9) as pct from orders")(lambda t: wi.with_total(t.orders.select("o_orderkey", "o_totalprice"), total=F.sum("o_totalprice")).select("o_orderkey", F.round(100 * F.col("o_totalprice") / F.col("total"), 9).alias("pct")))
query("w11_sum_by_partition", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey), 2) as s from orders")(lambda t: t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 2).alias("s")))
query("w12_sum_distinct", "select o_orderkey, s from orders join (select o_custkey as k, sum(distinct year(o_orderdate)) as s from orders group by o_custkey) on k = o_custkey")(lambda t: wi.over_distinct(t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y")), ["o_custkey"], "y", "s").select("o_orderkey", "s"))
query("w13_count_distinct", "select o_orderkey, n from orders join (select o_custkey as k, count(distinct o_orderstatus) as n from orders group by o_custkey) on k = o_custkey")(lambda t: wi.over_distinct(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", "n", F.count).select("o_orderkey", "n"))
query("w14_count_star", "select event_id, count(*) over (partition by user_id) as n from events")(lambda t: t.events.select("event_id", F.count("*").over(Window.partitionBy("user_id")).alias("n")))
query("w15_count_over_all", "select event_id, (select count(value) from events) as n from events")(lambda t: wi.with_total(t.events.select("event_id", "value"), n=F.count("value")).drop("value"))
query("w16_min_max", "select event_id, min(value) over (partition by user_id) as low, max(value) over (partition by user_id) as high from events")(lambda t: t.events.select("event_id", F.min("value").over(Window.partitionBy("user_id")).alias("low"), F.max("value").over(Window.partitionBy("user_id")).alias("high")))
ALL = "rank() over w as r, dense_rank() over w as d, row_number() over (partition by l_returnflag order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as n"
query("w17_several_rankings", f"select l_orderkey, l_linenumber, l_partkey, {ALL} from lineitem window w as (partition by l_returnflag order by l_quantity)")(
    lambda t: wi.ranked(
        wi.ranked(t.lineitem.select(*LINE, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], ["l_quantity"], r="rank", d="dense_rank"),
        ["l_returnflag"], ["l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], n="row_number",
    ).select(*LINE, "r", "d", "n")
)
for name, sql, fn, order in (("w18_top_by_rank", "rank()", F.rank, "o_totalprice desc"), ("w18_top_by_dense_rank", "dense_rank()", F.dense_rank, "o_totalprice desc"), ("w18_top_by_row_number", "row_number()", F.row_number, "o_totalprice desc, o_orderkey")):
    query(name, f"select o_custkey, o_orderkey from (select *, {sql} over (partition by o_custkey order by {order}) as r from orders) where r <= 3")(lambda t, fn=fn, order=order: wi.top_in_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), *([F.col("o_orderkey")] if "key" in order else [])], 3, fn).drop("o_totalprice"))
query("w19_top_in_two_steps", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) where rn < 4")(
    lambda t: t.customer.withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("rn < 4").select("c_nationkey", "c_custkey")
)


def by_size():
    return Window.partitionBy("p_brand").orderBy("p_size")


query("w20_three_rankings_on_ties", "select p_partkey, rank() over w as r, dense_rank() over w as d, row_number() over (partition by p_brand order by p_size, p_partkey) as n from part window w as (partition by p_brand order by p_size)")(
    lambda t: wi.ranked(wi.ranked(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_size"], r="rank", d="dense_rank"), ["p_brand"], ["p_size", "p_partkey"], n="row_number").select("p_partkey", "r", "d", "n")
)
