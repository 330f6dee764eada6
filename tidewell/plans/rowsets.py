"""Hooks for user functions, functions on row sets, text and page jobs, metadata."""

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidewell.functions import text as fx
from tidewell.operators import hooks
from tidewell.operators import pages as pg
from tidewell.operators import rowsets as rs
from tidewell.operators import tables
from tidewell.plans.registry import query
from tidewell.sources import sinks

# hooks


def _foo(batches):
    for b in batches:
        yield b.assign(s="foo " + b["c_mktsegment"])[["c_custkey", "s"]]


query("g1_process", "select c_custkey, 'foo ' || c_mktsegment as s from customer")(lambda t: rs.process(t.customer.select("c_custkey", "c_mktsegment"), _foo, "c_custkey long, s string"))


def _throwing(batches):
    for b in batches:
        raise ValueError(f"the helper failed on {b.columns[0]}")
        yield b


def failed_process(t):
    """The error that a failing helper surfaces as, beside the number of rows; a processor that passes rows through has them all."""
    try:
        rs.process(t.customer.select("c_custkey"), _throwing, "c_custkey long").collect()
    except Exception as e:  # noqa: BLE001  the kind of error is Spark's, the message the helper's
        passed = rs.process(t.customer.select("c_custkey"), lambda batches: batches, "c_custkey long")
        return passed.agg(F.count("*").alias("n")).select(F.lit("the helper failed on c_custkey" in str(e)).alias("surfaced"), "n")
    raise AssertionError("the helper must fail")


query("g3_failing_helper", "select true as surfaced, count(*) as n from customer")(failed_process)


def renamed_processor(source: str, dest: str, table: dict[str, str]):
    """A processor with arguments: looks ``source`` up into ``dest``."""
    if source == dest:
        raise ValueError("source and destination must differ")

    def run(batches):
        for b in batches:
            b[dest] = b[source].map(table).fillna("Unknown")
            yield b[["c_custkey", dest]]

    return run


query("g2_process_with_arguments", "select c_custkey, case c_mktsegment when 'BUILDING' then 'house' else 'Unknown' end as label from customer")(lambda t: rs.process(t.customer.select("c_custkey", "c_mktsegment"), renamed_processor("c_mktsegment", "label", {"BUILDING": "house"}), "c_custkey long, label string"))


def _total(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up a key batch by batch; no more than one batch is in memory."""
    s = 0.0
    for b in batches:
        s += float(b["o_totalprice"].sum())
    yield pd.DataFrame({"o_orderpriority": [key[0]], "s": [s]})


query("g4_reduce_native", "select o_orderpriority, round(sum(o_totalprice), 2) as s from orders group by o_orderpriority")(lambda t: t.orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("s")))


def _totals(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One total of a key's parts."""
    yield pd.DataFrame({"o_orderpriority": [key[0]], "s": [round(sum(float(p["s"].sum()) for p in parts), 2)]})


query("g4_reduce_hook", "select o_orderpriority, round(sum(o_totalprice), 2) as s from orders group by o_orderpriority")(lambda t: rs.reduce(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], _total, "o_orderpriority string, s double", merge=_totals))


def _ends(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """The first and last event of a user."""
    first = last = next(rows)
    for last in rows:
        pass
    yield key[0], first.event_id, last.event_id


query("o6_presorted_groups", 'select user_id, min_by(event_id, ts) as "first", max_by(event_id, ts) as "last" from events group by user_id')(
    lambda t: hooks.reduce_ordered(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], _ends, "user_id long, first long, last long")
)


class Sessions:
    """Sessions of a key's events in order: a pause of more than ``gap`` ends one."""

    def __init__(self, gap: dt.timedelta):
        self.gap = gap

    def joined(self, found: Iterator[tuple]) -> Iterator[tuple]:
        """Sessions (start, end, first, last, n) in order, put together where no pause is between them."""
        now = None
        for s in found:
            if now is not None and s[0] - now[1] <= self.gap:
                now = (now[0], s[1], now[2], s[3], now[4] + s[4])
                continue
            if now is not None:
                yield now
            now = tuple(s)
        if now is not None:
            yield now

    def piece(self, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        return self.joined((r.ts, r.ts, r.event_id, r.event_id, 1) for r in rows)

    def whole(self, key: tuple, parts: Iterator[tuple]) -> Iterator[tuple]:
        for number, s in enumerate(self.joined(parts), 1):
            yield (*key, number, *s[2:])

    def at_once(self, key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        return self.whole(key, self.piece(key, rows))


def session_sql(key: str, gap: str) -> str:
    return f"""with n as (select {key}, event_id, ts, case when ts - lag(ts) over w > interval {gap} then 1 else 0 end as pause from events window w as (partition by {key} order by ts, event_id)),
s as (select *, sum(pause) over (partition by {key} order by ts, event_id) + 1 as session from n)
select {key}, cast(session as bigint) as session, min_by(event_id, ts) as first_event, max_by(event_id, ts) as last_event, count(*) as n from s group by {key}, session"""


query("g4_user_sessions", session_sql("user_id", "1 day"))(
    lambda t: hooks.reduce_ordered(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], Sessions(dt.timedelta(days=1)).at_once, "user_id long, session long, first_event long, last_event long, n long")
)


def type_sessions(t):
    """Few keys that all tasks share: pieces of a key follow each other, and sessions are put together where pieces meet."""
    s = Sessions(dt.timedelta(minutes=40))
    parts = "start timestamp_ntz, stop timestamp_ntz, first_event long, last_event long, n long"
    return hooks.reduce_ordered(t.events.select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"], s.piece, "event_type string, session long, first_event long, last_event long, n long", merge=s.whole, parts=parts)


query("g4_type_sessions", session_sql("event_type", "40 minutes"))(type_sessions)
query("g5_combine_all_pairs", "select r_name, seg from region cross join (select distinct c_mktsegment as seg from customer)")(lambda t: rs.combine(t.region.select("r_name"), t.customer.select(F.col("c_mktsegment").alias("seg")).distinct(), None))


def by_nation(df, column: str):
    return df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))


query("g6_combine_names", "select c.c_nationkey as leftk, s.c_nationkey as rightk, count(*) as n from (select c_nationkey from customer where c_acctbal > 0) c cross join (select s_nationkey as c_nationkey from supplier) s group by 1, 2")(
    lambda t: rs.combine(by_nation(t.customer.where("c_acctbal > 0"), "c_nationkey"), by_nation(t.supplier, "s_nationkey"), None, left_name="left", right_name="right").select("leftk", "rightk", (F.col("leftn") * F.col("rightn")).alias("n"))
)
query("g6_combine_names_whole", "select c.c_nationkey as leftk, s.c_nationkey as rightk, count(*) as n from customer c cross join (select s_nationkey as c_nationkey from supplier) s group by 1, 2")(
    lambda t: rs.combine(by_nation(t.customer, "c_nationkey"), by_nation(t.supplier, "s_nationkey"), None, left_name="left", right_name="right").select("leftk", "rightk", (F.col("leftn") * F.col("rightn")).alias("n"))
)


def _counted(key: tuple, left: Iterator[tuple], right: Iterator[tuple], cell: tuple[int, int]) -> Iterator[tuple]:
    """How many rows either side has; a part of a side is counted in its first cell only."""
    suppliers = sum(1 for _ in right)
    items = sum(1 for _ in left)
    yield key[0], items if cell[1] == 0 else 0, suppliers if cell[0] == 0 else 0


def _counts(key: tuple, parts: Iterator[tuple]) -> Iterator[tuple]:
    items = suppliers = 0
    for p in parts:
        items, suppliers = items + p.items, suppliers + p.suppliers
    yield key[0], items, suppliers


query("g7_combine_by_key", "select k, cast(sum(a) as integer) as items, cast(sum(b) as integer) as suppliers from (select l_suppkey as k, 1 as a, 0 as b from lineitem union all select s_suppkey, 0, 1 from supplier) group by k")(
    lambda t: hooks.combine_streams(t.lineitem.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber"), t.supplier.select(F.col("s_suppkey").alias("k")), ["k"], _counted, "k long, items int, suppliers int", cell_rows=1_000_000, merge=_counts)
)


def _pairs(key: tuple, left: Iterator[tuple], right: Iterator[tuple], cell: tuple[int, int]) -> Iterator[tuple]:
    """Each order beside its customer: the right rows are kept, the left ones read as a stream."""
    kept = [r.c_name for r in right]
    for row in left:
        for name in kept:
            yield row.o_orderkey, name


query("g7_combine_pairs", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")(
    lambda t: hooks.combine_streams(t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey"), t.customer.select(F.col("c_custkey").alias("k"), "c_name"), ["k"], _pairs, "o_orderkey long, c_name string", cell_rows=1_000_000)
)


class _Words:
    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield i, w


def _applied(t):
    """A Python table function beside each row, called as an object: nothing is registered in the session."""
    words = udtf(_Words, returnType="i int, w string")
    parts = t.part.select("p_partkey", "p_name")
    return parts.lateralJoin(words(F.col("p_name").outer())).select("p_partkey", "i", "w")


query("g8_table_function", "select p_partkey, i - 1 as i, w from (select p_partkey, unnest(string_split(p_name, ' ')) as w, generate_subscripts(string_split(p_name, ' '), 1) as i from part)")(_applied)

# functions on row sets


def some_parts(t, count: int = 10_000):
    return t.part.orderBy("p_partkey").limit(count)


def split_orders(orders):
    """Two named results of one function."""
    done = F.col("o_orderstatus") == "F"
    return {"done": orders.where(done), "open": orders.where(~done)}


query("d1_view_with_count", "select p_partkey, p_name from part order by p_partkey limit 25")(lambda t: some_parts(t, count=25).select("p_partkey", "p_name"))
query("d2_function", "select p_partkey from part where p_name like 'small%'")(lambda t: t.part.transform(lambda d: d.where(F.col("p_name").startswith("small"))).select("p_partkey"))
query("d3_two_results", "select case when o_orderstatus = 'F' then 'done' else 'open' end as part, count(*) as n from orders group by 1")(lambda t: split_orders(t.orders)["done"].agg(F.count("*").alias("n")).select(F.lit("done").alias("part"), "n").unionAll(split_orders(t.orders)["open"].agg(F.count("*").alias("n")).select(F.lit("open").alias("part"), "n")))
query("d4_delete_columns", "select c_name, c_acctbal, c_mktsegment from customer")(lambda t: rs.delete(t.customer, "c_*key"))
query("d5_keep_columns", "select o_orderkey, o_orderstatus, o_orderpriority from orders")(lambda t: rs.keep(t.orders, "o_order*").drop("o_orderdate"))
query("d6_rename_columns", "select s_suppkey as id, s_name as name, s_nationkey, s_acctbal from supplier")(lambda t: rs.rename(t.supplier, "s_suppkey>id, s_name>name, none>x"))
query("d7_replace_in_names", 'select s_suppkey as "s.suppKEY", s_name, s_nationkey as "s.nationKEY", s_acctbal from supplier')(lambda t: rs.replace_in_names(t.supplier, "s_*key", "key>KEY,_>."))
query("d8_identity", "select * from customer")(lambda t: t.customer.transform(lambda d: d))
query("d9_composition", "select c_name, c_mktsegment from customer")(lambda t: t.customer.transform(lambda d: rs.keep(d, "c_n*,*seg*")).transform(lambda d: rs.delete(d, "*key")))
query("d10_reverse_columns", "select c_mktsegment, c_acctbal, c_nationkey, c_name, c_custkey from customer")(lambda t: rs.reverse_columns(t.customer))
query("d11_typed_view", "select p_partkey, p_partkey as h from part")(lambda t: rs.typed_or_not(t.part.select("p_partkey", F.hex("p_partkey").alias("h")), "h", "typed", fx.hex_number))
query("d11_untyped_view", "select p_partkey, hex(p_partkey) as h from part")(lambda t: rs.typed_or_not(t.part.select("p_partkey", F.hex("p_partkey").alias("h")), "h", "untyped", fx.hex_number))
query("d11_typed_function", "select p_partkey, p_partkey as h from part")(lambda t: tables.typed_view(t.part.select("p_partkey", F.concat(F.lit("#"), F.hex("p_partkey")).alias("h")), "h", "typed"))
query("d11_untyped_function", "select p_partkey, '#' || hex(p_partkey) as h from part")(lambda t: tables.typed_view(t.part.select("p_partkey", F.concat(F.lit("#"), F.hex("p_partkey")).alias("h")), "h", "untyped"))
query("g8_first_of_each", "select * from (select o_custkey, o_orderkey, o_totalprice, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as integer) as place from orders) where place <= 2")(
    lambda t: tables.first_of_each(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["-o_totalprice", "o_orderkey"], 2)
)

# jobs


def lines():
    return F.explode(F.split("text", "\n")).alias("line")


def sampled(key, below: str):
    """Whether a row is in a sample by its key, the same one whenever it is drawn: its digest is less than some hexadecimal digits."""
    return F.md5(key.cast("string").cast("binary")) < below


LINES_SQL = "(select doc_id, unnest(string_split(text, chr(10))) as line from documents)"
query("l1_line_cleanup", f"select doc_id, replace(replace(replace(line, chr(9), '|'), ',', ''), '\"', '') as line from {LINES_SQL} where not contains(line, '###') and line <> ''")(
    lambda t: t.documents.select("doc_id", lines()).where(~F.col("line").contains("###") & (F.col("line") != "")).select("doc_id", F.replace(F.replace(F.replace("line", F.lit("\t"), F.lit("|")), F.lit(","), F.lit("")), F.lit('"'), F.lit("")).alias("line"))
)
query("l2_pick_fields", f"select doc_id, split_part(line, ' ', 3) as third, substring(split_part(line, ' ', 1), 2) as rest from {LINES_SQL} where contains(line, ' ')")(
    lambda t: t.documents.select("doc_id", lines()).where(F.col("line").contains(" ")).select("doc_id", F.coalesce(fx.token(F.col("line"), " ", 2), F.lit("")).alias("third"), fx.from_start(fx.token(F.col("line"), " ", 0), 1).alias("rest"))
)
query("l4_text_profile", "select count(*) as lines, max(length(text)) as chars, (select strlen(text) from documents order by length(text) desc, doc_id limit 1) as bytes, (select doc_id from documents order by length(text) desc, doc_id limit 1) as at from documents")(
    lambda t: t.documents.agg(F.count("*").alias("lines"), F.max(F.struct(F.length("text").alias("chars"), (-F.col("doc_id")).alias("at"), F.octet_length("text").alias("bytes"))).alias("m")).select("lines", "m.chars", "m.bytes", (-F.col("m.at")).alias("at"))
)
_ENTITIES = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
_ANCHORS = "(select page_id, generate_subscripts(a, 1) - 1 as n, unnest(a) as a from (select page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>') as a from pages))"
_TEXT, _HREF = "trim(regexp_replace(regexp_extract(a, '>(.*)</a>$', 1), '<[^>]*>', '', 'g'))", "regexp_extract(a, 'href=\"([^\"]*)\"', 1)"
query("l5_links", f"select page_id, cast(n as integer) as n, {_ENTITIES.format(_TEXT)} as text, {_ENTITIES.format(_HREF)} as href from {_ANCHORS}")(lambda t: pg.links(t.pages))
_ROWS = "(select page_id, generate_subscripts(r, 1) - 1 as n, unnest(r) as r from (select page_id, regexp_extract_all(html, '(?s)<tr[^>]*>.*?</tr>') as r from pages))"
_CELLS = "regexp_extract_all(r, case when contains(r, '<th') then '(?s)<th[^>]*>(.*?)</th>' else '(?s)<td[^>]*>(.*?)</td>' end, 1)"
_CELL = "replace(trim(regexp_replace(regexp_replace(c, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '|', '')"
query("l6_table_rows", f"select page_id, cast(n as integer) as n, case when contains(r, '<th') then 'th' else 'td' end as tag, array_to_string(list_transform({_CELLS}, lambda c: {_CELL}), '|') as line from {_ROWS}")(lambda t: pg.table_rows(t.pages))
query("l7_log_slice", "select event_id, user_id, event_type from events where md5(cast(event_id as varchar)) < '40' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' and event_type in ('click', 'view', 'purchase') and value > 20 and (contains(lower(props), '\"k\": 1') or contains(lower(props), '\"k\": 2'))")(
    lambda t: t.events.where(sampled(F.col("event_id"), "40") & F.expr("ts >= timestamp_ntz '2024-01-05 00:00:00' and ts < timestamp_ntz '2024-01-20 00:00:00'") & F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 20) & fx.contains_one_of(F.col("props"), ['"k": 1', '"K": 2'])).select("event_id", "user_id", "event_type")
)
query("l7_document_slice", "select doc_id, source from documents where lang in ('en', 'de') and n_chars > 200 and (contains(lower(text), 'license') or contains(lower(text), 'rights')) and source <> 'src0'")(
    lambda t: t.documents.where(F.col("lang").isin("en", "de") & (F.col("n_chars") > 200) & fx.contains_one_of(F.col("text"), ["license", "rights"]) & (F.col("source") != "src0")).select("doc_id", "source")
)
query("l7_sample", "select event_id from events where md5(cast(event_id as varchar)) < '19'")(lambda t: t.events.where(sampled(F.col("event_id"), "19")).select("event_id"))
query("l8_never_clicked", "select s_suppkey, count(*) as n from supplier join lineitem on l_suppkey = s_suppkey where s_suppkey not in (select l_suppkey from lineitem where l_quantity > 49.5 and l_discount > 0.09) group by s_suppkey")(
    lambda t: t.supplier.select("s_suppkey").join(t.lineitem.select("l_suppkey", "l_quantity"), F.expr("l_suppkey = s_suppkey")).join(t.lineitem.where("l_quantity > 49.5 and l_discount > 0.09").select(F.col("l_suppkey").alias("k")), F.expr("s_suppkey = k"), "left_anti").groupBy("s_suppkey").agg(F.count("*").alias("n"))
)
query("l9_totals_by_two_keys", "select 'supp' as by_key, l_suppkey as k, round(sum(l_quantity), 2) as s from lineitem group by l_suppkey union all select 'part', l_partkey, round(sum(l_quantity), 2) from lineitem group by l_partkey")(
    lambda t: t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("s")).select(F.lit("supp").alias("by_key"), "k", "s").unionAll(t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("s")).select(F.lit("part").alias("by_key"), "k", "s"))
)

# metadata


def filled(df):
    """The number of values of each column that aren't null, a row a column."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return counts.unpivot([], counts.columns, "name", "n_values")


query("e1_row_count", "select count(*) as n from lineitem")(lambda t: t.lineitem.agg(F.count("*").alias("n")))
_KINDS = "case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' else 'timestamp_ntz' end"
_PROVIDERS = "case data_type when 'BIGINT' then 'LongType' when 'INTEGER' then 'IntegerType' when 'DOUBLE' then 'DoubleType' when 'VARCHAR' then 'StringType' else 'TimestampNTZType' end"
_FILLED = " union all ".join(f"select '{c}' as name, count({c}) as n_values from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
query("e2_schema_rows", f"select cast(ordinal_position - 1 as integer) as ordinal, column_name as name, {_KINDS} as type, {_PROVIDERS} as provider, true as nullable, n_values from information_schema.columns join ({_FILLED}) on name = column_name where table_name = 'orders'")(
    lambda t: sinks.schema_rows(t.orders).join(filled(t.orders), "name").select("ordinal", "name", "type", "provider", "nullable", "n_values")
)
