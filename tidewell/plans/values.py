"""Arrays, maps, structs, versions and scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as fx
from tidewell.functions.user import Scalar, scalar
from tidewell.operators.aggregates import item_counts, map_agg
from tidewell.plans.registry import query

# arrays


def words():
    return fx.tokens(F.col("p_name"), " ")


SQL_WORDS = "string_split(p_name, ' ')"
query("r1_array_literal", "select p_partkey, '1,2,3' as a from part")(lambda t: t.part.select("p_partkey", F.array_join(F.array(F.lit("1"), F.lit("2"), F.lit("3")), ",").alias("a")))
query("r2_empty_array", "select p_partkey, 0 as n from part")(lambda t: t.part.select("p_partkey", F.size(F.array().cast("array<string>")).alias("n")))
query("r3_array_copy", f"select p_partkey, array_to_string({SQL_WORDS}, ',') as a from part")(lambda t: t.part.withColumn("w", words()).withColumn("c", F.col("w")).select("p_partkey", F.array_join("c", ",").alias("a")))
query("r4_array_from_split", f"select p_partkey, array_to_string({SQL_WORDS}, ';') as a from part")(lambda t: t.part.select("p_partkey", F.array_join(words(), ";").alias("a")))
query("r5_append_items", f"select p_partkey, array_to_string(list_concat({SQL_WORDS}, ['Foo', 'Bar']), ',') as a from part")(lambda t: t.part.select("p_partkey", F.array_join(F.concat(words(), F.array(F.lit("Foo"), F.lit("Bar"))), ",").alias("a")))
query("r6_append_if", f"select p_partkey, array_to_string(case when p_size > 25 then list_concat({SQL_WORDS}, ['big']) else {SQL_WORDS} end, ',') as a from part")(lambda t: t.part.select("p_partkey", F.array_join(F.when(F.col("p_size") > 25, F.concat(words(), F.array(F.lit("big")))).otherwise(words()), ",").alias("a")))
query("r7_array_length", "select doc_id, len(string_split(text, ' ')) as n from documents")(lambda t: t.documents.select("doc_id", F.size(F.split("text", " ")).alias("n")))
query("r8_array_index", "select doc_id, string_split(text, ' ')[1] as w from documents")(lambda t: t.documents.select("doc_id", fx.token(F.col("text"), " ", 0).alias("w")))
query("r9_array_index_beyond", "select p_partkey, cast(null as varchar) as w from part")(lambda t: t.part.select("p_partkey", F.get(words(), F.lit(121212)).alias("w")))
query("r9_array_index_varied", "select p_partkey, string_split(p_name, ' ')[p_size % 7 + 1] as w from part")(lambda t: t.part.select("p_partkey", F.get(words(), F.col("p_size") % 7).alias("w")))
KEPT = "select p_partkey, string_agg(w, ',' order by w) as a from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) where w like 's%' or w like 'r%' group by p_partkey"


def starts():
    return F.col("w").startswith("s") | F.col("w").startswith("r")


query("r10_remove_items_by_rows", KEPT)(lambda t: t.part.select("p_partkey", F.explode(words()).alias("w")).where(starts()).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("a")))
query("r11_remove_items_by_lambda", KEPT)(lambda t: t.part.select("p_partkey", F.array_sort(F.filter(words(), lambda w: w.startswith("s") | w.startswith("r"))).alias("k")).where(F.size("k") > 0).select("p_partkey", F.array_join("k", ",").alias("a")))
query("r12_flatten", "select doc_id, w, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as w from documents) group by doc_id, w")(lambda t: item_counts(t.documents, "doc_id", F.split("text", " "), "w", "n"))
query("r13_apply_split", f"select p_partkey, unnest({SQL_WORDS}) as w from part")(lambda t: t.sql("select p_partkey, w from {part} lateral view explode(split(p_name, ' ')) x as w", "part"))
query("r14_break_and_merge", "select p_partkey, string_agg(w, ';' order by w) as words, count(*) as n from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) group by p_partkey")(
    lambda t: t.part.select("p_partkey", F.explode(words()).alias("w")).groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("w")), ";").alias("words"), F.count("*").alias("n"))
)
query("r15_digits", "select o_orderkey, array_to_string(list_transform(string_split(bin(o_orderkey), ''), lambda c: case when c = '0' then 0 else 1 end), ',') as d from orders")(lambda t: t.orders.select("o_orderkey", fx.joined(fx.digits(F.bin("o_orderkey"))).alias("d")))
query("r16_ints_as_text", "select p_partkey, p_partkey || ',' || p_size || ',' || (p_size * 2) as a from part")(lambda t: t.part.select("p_partkey", fx.joined(F.array(F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_size").cast("long") * 2)).alias("a")))

# maps


def members(t):
    """user -> map of event type to number of events."""
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return map_agg(counts, ["user_id"], "event_type", "n", "m")


def shown(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")


COUNTS = "(select user_id, event_type, count(*) as n from events where event_type is not null group by user_id, event_type)"
ENTRY = "event_type || '=' || n"
query("m1_map_literal", "select c_custkey, 'a=1;b=2' as m from customer")(lambda t: t.customer.select("c_custkey", shown(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).alias("m")))


def empty_map():
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))


query("m2_empty_map", "select c_custkey, 0 as n from customer")(lambda t: t.customer.select("c_custkey", F.size(empty_map()).alias("n")))
query("m3_map_copy", f"select user_id, string_agg({ENTRY}, ';' order by {ENTRY}) as m from {COUNTS} group by user_id")(lambda t: members(t).withColumn("c", F.col("m")).select("user_id", shown("c").alias("m")))
BAG = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
query("m4_property_bags", "select c_custkey, 'map<string,array<int>>' as kind, cast(c_nationkey as varchar) as v, cast(null as varchar) as missing from customer")(
    lambda t: t.customer.select("c_custkey", F.create_map(F.lit("nation"), F.array("c_nationkey")).cast(BAG).alias("b")).select("c_custkey", F.typeof("b").alias("kind"), F.element_at("b", "nation")[0].cast("string").alias("v"), F.element_at("b", "x").cast("string").alias("missing"))
)
query("m5_map_lookup", f"select user_id, max(n) filter (event_type = 'click') as v from {COUNTS} group by user_id")(lambda t: members(t).select("user_id", F.element_at("m", "click").alias("v")))
query("m6_map_lookup_missing", f"select user_id, cast(null as bigint) as v from {COUNTS} group by user_id")(lambda t: members(t).select("user_id", F.element_at("m", "none").alias("v")))
WANTED = "case user_id % 3 when 0 then 'click' when 1 then 'nothing' else 'error' end"
query("m6_map_lookup_varied", f"select user_id, max(n) filter (event_type = {WANTED}) as v from {COUNTS} group by user_id")(lambda t: members(t).select("user_id", F.element_at("m", F.expr(WANTED)).alias("v")))
query("m7_contains_key", f"select user_id from {COUNTS} where event_type = 'error'")(lambda t: members(t).where(F.map_contains_key("m", "error")).select("user_id"))
query("m8_contains_value", f"select distinct user_id from {COUNTS} where n = 13")(lambda t: members(t).where(F.array_contains(F.map_values("m"), 13)).select("user_id"))
query("m9_guarded_contains", f"select user_id from {COUNTS} where event_type = 'signup'")(lambda t: members(t).where(F.col("m").isNotNull() & F.map_contains_key("m", "signup")).select("user_id"))
query("m10_map_size", f"select user_id, cast(count(*) as integer) as n from {COUNTS} group by user_id having count(*) > 4")(lambda t: members(t).where(F.size("m") > 4).select("user_id", F.size("m").alias("n")))
query("m11_any_entry", f"select distinct user_id from {COUNTS} where contains(event_type, 'ig') and n > 12")(lambda t: members(t).where(F.size(F.map_filter("m", lambda k, v: k.contains("ig") & (v > 12))) > 0).select("user_id"))
query("m12_override", f"select user_id, string_agg(e, ';' order by e) as m from (select user_id, {ENTRY} as e from {COUNTS} where event_type <> 'view' union all select distinct user_id, 'view=-1' from {COUNTS}) group by user_id")(
    lambda t: members(t).select("user_id", shown(F.map_concat(F.map_filter("m", lambda k, v: k != "view"), F.create_map(F.lit("view"), F.lit(-1).cast("long")))).alias("m"))
)
query("m13_override_if_there", f"select user_id, string_agg(e, ';' order by e) as m from (select user_id, case when event_type = 'view' then 'view=-1' else {ENTRY} end as e from {COUNTS}) group by user_id")(
    lambda t: members(t).select("user_id", shown(F.transform_values("m", lambda k, v: F.when(k == "view", F.lit(-1).cast("long")).otherwise(v))).alias("m"))
)
query("m14_remove_item", f"select user_id, string_agg({ENTRY}, ';' order by {ENTRY}) as m from {COUNTS} where event_type <> 'view' group by user_id")(lambda t: members(t).select("user_id", F.map_filter("m", lambda k, v: k != "view").alias("k")).where(F.size("k") > 0).select("user_id", shown("k").alias("m")))
query("m15_flatten_map", f'select user_id, event_type as "Key", n as "Value" from {COUNTS}')(lambda t: members(t).select("user_id", F.explode("m").alias("Key", "Value")))

# structs and user types


def point():
    return F.struct(F.col("p_size").cast("double").alias("X"), F.col("p_retailprice").alias("Y"), F.lit(0.0).alias("Z"))


query("n1_build_struct", "select p_partkey, cast(p_size as double) as x, p_retailprice as y, 0.0::double as z from part")(lambda t: t.part.select("p_partkey", point().alias("c")).select("p_partkey", F.col("c.X").alias("x"), F.col("c.Y").alias("y"), F.col("c.Z").alias("z")))
query("n2_struct_fields", "select p_partkey, p_retailprice as y from part")(lambda t: t.part.select("p_partkey", point().alias("c")).select("p_partkey", F.col("c").getField("Y").alias("y")))


def kind():
    return F.element_at(F.array(F.lit("Shape"), F.lit("Rect"), F.lit("Circle")), (F.col("p_partkey") % 3 + 1).cast("int"))


def sides():
    return F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_size") * 2).cast("string"))


query("n4_tagged_struct", "select p_partkey, case p_partkey % 3 when 0 then 'Shape' when 1 then 'Rect' else 'Circle' end as kind, case when p_partkey % 3 = 1 then p_size end as width, case when p_partkey % 3 = 1 then p_size * 2 end as height, case when p_partkey % 3 = 2 then p_size end as radius from part")(
    lambda t: t.part.select("p_partkey", fx.shape(kind(), fx.numbers(sides())).alias("s")).select("p_partkey", "s.kind", "s.width", "s.height", "s.radius")
)
query("n5_numbers_from_text", "select p_partkey, p_partkey + 3 * p_size as s from part")(lambda t: t.part.select("p_partkey", F.aggregate(fx.numbers(sides()), F.lit(0).cast("long"), lambda a, x: a + x).alias("s")))


def results():
    """Four results in one of two orders, a null token among them."""
    low, high = (F.col("l_partkey") % 7 + 10).cast("string"), (F.col("l_suppkey") % 5 + 20).cast("string")
    line = F.col("l_linenumber").cast("string")
    return F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws(";", line, F.lit("NULL"), low, high)).otherwise(F.concat_ws(";", high, line, F.lit("NULL"), low))


def clicks():
    """Two clicks; the first is a null token or absent from the results in some rows, the second in others."""
    first = F.when(F.col("l_partkey") % 4 == 0, "NULL").when(F.col("l_partkey") % 4 == 1, "99").otherwise((F.col("l_suppkey") % 5 + 20).cast("string"))
    return F.concat_ws(";", first, (F.col("l_partkey") % 9 + 10).cast("string"))


def view():
    return fx.page_view(results(), clicks())


LINE = "l_orderkey, l_linenumber, l_partkey"
_LOW, _HIGH, _NUMBER = "cast(l_partkey % 7 + 10 as varchar)", "cast(l_suppkey % 5 + 20 as varchar)", "cast(l_linenumber as varchar)"
_FIRST = f"case l_partkey % 4 when 0 then 'NULL' when 1 then '99' else {_HIGH} end"
_SEEN = f"(select {LINE}, case when l_orderkey % 2 = 0 then [{_NUMBER}, 'NULL', {_LOW}, {_HIGH}] else [{_HIGH}, {_NUMBER}, 'NULL', {_LOW}] end as raw, {_FIRST} as first, [{_FIRST}, cast(l_partkey % 9 + 10 as varchar)] as pair from lineitem)"
_VIEW = f"(select {LINE}, first, raw, list_filter(raw, lambda x: x <> 'NULL') as results, list_filter(pair, lambda x: x <> 'NULL') as clicks from {_SEEN})"
query("n6_page_view", f"select {LINE}, array_to_string(results, ',') as results, array_to_string(clicks, ',') as clicks from {_VIEW}")(lambda t: t.lineitem.select(*LINE.split(", "), view().alias("v")).select(*LINE.split(", "), F.array_join("v.results", ",").alias("results"), F.array_join("v.clicks", ",").alias("clicks")))
query("n7_click_position", f"select {LINE}, coalesce(list_position(results, clicks[1]), 0) as pos, coalesce(list_position(results, clicks[2]), 0) as second, coalesce(list_position(results[1 : len(clicks)], clicks[1]), 0) as legacy from {_VIEW}")(
    lambda t: t.lineitem.select(*LINE.split(", "), view().alias("v")).select(*LINE.split(", "), *[fx.click_position(F.col("v.results"), F.col("v.clicks"), n, legacy).alias(name) for name, n, legacy in (("pos", 1, False), ("second", 2, False), ("legacy", 1, True))])
)
query("n8_first_click", f"select {LINE}, coalesce(list_position(raw, first), 0) as pos from {_VIEW}")(lambda t: t.lineitem.select(*LINE.split(", "), F.array_position(fx.tokens(results(), ";"), fx.token(clicks(), ";", 0)).alias("pos")))
DOMAIN_SQL = "array_to_string(list_slice(string_split(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1), '.'), -2, -1), '.')"
query("n9_domain_counts", f"select {DOMAIN_SQL} as domain, count(*) as n from pages group by 1")(lambda t: t.pages.select(F.explode(F.array("url")).alias("u")).groupBy(fx.domain(F.col("u")).alias("domain")).agg(F.count("*").alias("n")))
query("n10_domain", f"select page_id, {DOMAIN_SQL} as domain from pages")(lambda t: t.pages.select("page_id", fx.domain(F.col("url")).alias("domain")))
query("n11_version_text", "select p_partkey, p_partkey % 30 || '.' || p_size || '.1' as v, p_partkey % 30 > 16 or (p_partkey % 30 = 16 and p_size > 2) as later from part")(
    lambda t: t.part.select("p_partkey", fx.version(F.concat_ws(".", (F.col("p_partkey") % 30).cast("string"), F.format_string("%02d", "p_size"), F.lit("1"))).alias("v")).select("p_partkey", fx.version_text(F.col("v")).alias("v"), (F.col("v") > F.array(F.lit(16), F.lit(2), F.lit(1))).alias("later"))
)

# scalars

query("f1_upper", "select p_partkey, upper(p_name) as u from part")(lambda t: t.part.select("p_partkey", F.upper("p_name").alias("u")))
query("f2_starts_with", "select p_partkey from part where starts_with(p_name, 'red')")(lambda t: t.part.where(F.col("p_name").startswith("red")).select("p_partkey"))
query("f3_contains", "select doc_id from documents where contains(text, 'license')")(lambda t: t.documents.where(F.col("text").contains("license")).select("doc_id"))
query("f4_contains_any_case", "select doc_id, coalesce(contains(lower(text), 'licensed'), false) as has from documents")(lambda t: t.documents.select("doc_id", fx.contains_any_case(F.col("text"), "LICENSED").alias("has")))
query("f5_contains_one_of", "select doc_id from documents where contains(lower(text), 'license') or contains(lower(text), 'rights reserved')")(lambda t: t.documents.where(fx.contains_one_of(F.col("text"), ["License", "rights reserved"])).select("doc_id"))
query("f6_replace", "select o_orderkey, replace(replace(o_orderpriority, '-', ' '), 'NOT ', '') as p from orders")(lambda t: t.orders.select("o_orderkey", F.replace(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")), F.lit("NOT "), F.lit("")).alias("p")))
query("f7_split", "select o_orderkey, array_to_string(string_split(o_orderpriority, '-'), '|') as p from orders")(lambda t: t.orders.select("o_orderkey", F.array_join(fx.tokens(F.col("o_orderpriority"), "-"), "|").alias("p")))
query("f8_token", "select o_orderkey, split_part(o_orderpriority, '-', 2) as p from orders")(lambda t: t.orders.select("o_orderkey", fx.token(F.col("o_orderpriority"), "-", 1).alias("p")))
query("f9_substring", "select c_custkey, substring(c_name, 10) as s from customer")(lambda t: t.customer.select("c_custkey", fx.from_start(F.col("c_name"), 9).alias("s")))
query("f10_index_of", "select c_custkey, strpos(c_name, '#') - 1 as i, strpos(c_name, '?') - 1 as j from customer")(lambda t: t.customer.select("c_custkey", fx.index_of(F.col("c_name"), "#").alias("i"), fx.index_of(F.col("c_name"), "?").alias("j")))
query("f11_join", f"select p_partkey, array_to_string({SQL_WORDS}, '+') as s from part")(lambda t: t.part.select("p_partkey", F.array_join(words(), "+").alias("s")))
query("f12_length", "select doc_id, length(text) as n from documents")(lambda t: t.documents.select("doc_id", F.length("text").alias("n")))
query("f13_token_count", "select o_orderkey, case when o_orderstatus = 'F' then 0 else 2 end as n from orders")(lambda t: t.orders.select("o_orderkey", fx.token_count(F.when(F.col("o_orderstatus") == "F", "NULL").otherwise("a;b")).alias("n")))
query("f14_concat", "select c_custkey, 'foo ' || c_mktsegment as s from customer")(lambda t: t.customer.select("c_custkey", F.concat(F.lit("foo "), "c_mktsegment").alias("s")))
query("f15_trim", "select s_suppkey, s_name as s from supplier")(lambda t: t.supplier.select("s_suppkey", F.trim(F.concat(F.lit("  "), "s_name", F.lit(" "))).alias("s")))
query("f16_regex", "select p_partkey from part where regexp_matches(p_brand, '^Brand#1[0-9]$')")(lambda t: t.part.where(F.col("p_brand").rlike("^Brand#1[0-9]$")).select("p_partkey"))


def normalised(name):
    """A user function of one column: lower case, without its prefix and its zeros."""
    return F.regexp_replace(F.lower(name), "^[a-z]+#0*", "")


query("f17_user_function", "select c_custkey, regexp_replace(lower(c_name), '^[a-z]+#0*', '') as s from customer")(lambda t: t.customer.select("c_custkey", normalised(F.col("c_name")).alias("s")))


class Normalised(Scalar):
    """A user's own function: a name without its prefix and leading zeros."""

    def setup(self):
        self.prefix = re.compile("^[a-z]+#0*")

    def call(self, name):
        return self.prefix.sub("", name.lower())


query("f17_user_scalar", "select c_custkey, regexp_replace(lower(c_name), '^[a-z]+#0*', '') as s from customer")(lambda t: t.customer.select("c_custkey", scalar(Normalised(), "string")("c_name").alias("s")))
query("f18_parse_time", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as d from orders")(lambda t: t.orders.select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy h:mm:ss a").alias("s")).select("o_orderkey", F.date_format(F.to_timestamp("s", "M/d/yyyy h:mm:ss a"), "yyyy-MM-dd HH:mm").alias("d")))
query("f19_end_day_inclusive", "select event_id from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-05' + interval 1 day")(lambda t: t.events.where(F.expr("ts >= timestamp_ntz '2024-01-03 00:00:00' and ts < timestamp_ntz '2024-01-05 00:00:00' + interval 1 day")).select("event_id"))
query("f20_month", "select month(o_orderdate) as m, count(*) as n from orders group by 1")(lambda t: t.orders.groupBy(F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n")))
query("f21_year", "select year(o_orderdate) as y, count(*) as n from orders group by 1")(lambda t: t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")))
query("f22_division", "select p_partkey, p_size // 7 as whole, round(p_retailprice / 7, 6) as d from part")(lambda t: t.part.select("p_partkey", F.expr("p_size div 7").alias("whole"), F.round(F.col("p_retailprice") / 7, 6).alias("d")))
query("f23_hex", "select o_orderkey, o_orderkey as h from orders")(lambda t: t.orders.select("o_orderkey", fx.hex_number(F.hex("o_orderkey")).alias("h")))
query("f24_sqrt_pow", "select p_partkey, round(sqrt(p_retailprice), 6) as r, round(pow(p_size, 2), 6) as p from part")(lambda t: t.part.select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("r"), F.round(F.pow("p_size", F.lit(2)), 6).alias("p")))
