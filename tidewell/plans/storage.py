"""Sources and sinks: each query writes given tables to the shared folder and reads them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as fx
from tidewell.operators.windows import numbered as row_numbers
from tidewell.plans.registry import query
from tidewell.session import delete, scratch, shared_dir
from tidewell.sources import backfill, copies
from tidewell.sources import fileset as fs
from tidewell.sources import records as rec
from tidewell.sources import sinks
from tidewell.sources import text as tx


def place(t, name: str) -> str:
    shared_dir(t.spark)
    return scratch(t.spark, name)


def text_trip(t, df, columns: str, sep: str = "\t"):
    path = place(t, "text")
    tx.write_text(df, path, sep)
    return tx.read_text(t.spark, path, columns, sep)


def parquet_trip(t, df):
    path = place(t, "table")
    sinks.write_table(df, path)
    return t.spark.read.parquet(path)


def parquet(t):
    return t.spark.read.parquet


# text

CUSTOMER = "c_custkey:long, c_name, c_nationkey:int, c_acctbal:double, c_mktsegment"
query("s1_text_scan", "select * from customer")(lambda t: text_trip(t, t.customer, CUSTOMER))
query("s2_delimiter", "select * from supplier")(lambda t: text_trip(t, t.supplier, "s_suppkey:long, s_name, s_nationkey:int, s_acctbal:double", "|"))
query("s3_nullable_columns", "select p_partkey, case when p_size < 25 then p_size end as size, case when p_size > 10 then p_retailprice end as price from part")(
    lambda t: text_trip(t, t.part.select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_size")).alias("size"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("price")), "p_partkey:long, size:int?, price:double?")
)
query("s4_untyped_columns", "select cast(o_orderkey as varchar) as a, o_orderpriority as b from orders")(lambda t: text_trip(t, t.orders.select("o_orderkey", "o_orderpriority"), "a, b"))


def lines(t):
    path = place(t, "lines")
    t.documents.select("text").write.text(path)
    return tx.read_lines(t.spark, path).groupBy("line").agg(F.count("*").alias("n"))


query("s5_whole_lines", "select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line")(lines)
query("s6_table_scan", "select l_orderkey, l_linenumber, l_quantity from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"))
query("s17_requested_columns", "select l_partkey, l_shipdate from lineitem where l_quantity > 49")(lambda t: t.lineitem.where("l_quantity > 49").select("l_partkey", "l_shipdate"))


def line_trip(t, df, columns: str, **options):
    """Rows formatted as lines, written, and parsed from the files."""
    path = place(t, "parsed")
    tx.format_lines(df).write.text(path)
    return tx.parse_lines(tx.read_lines(t.spark, path), columns, **options)


def written_lines(t, df):
    """The lines of the files that a formatter wrote."""
    path = place(t, "formatted")
    tx.format_lines(df).write.text(path)
    return tx.read_lines(t.spark, path).withColumnRenamed("line", "value")


query("s18_line_parser", "select p_partkey, p_name, p_size from part")(lambda t: line_trip(t, t.part.select("p_partkey", "p_name", "p_size"), "p_partkey:long, p_name, p_size:int"))
query("s19_parser_with_argument", "select c_custkey, upper(c_name) as c_name, upper(c_mktsegment) as c_mktsegment from customer")(
    lambda t: line_trip(t, t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey:long, c_name, c_mktsegment", upper=True)
)
query("s20_parser_of_versions", "select p_partkey, p_partkey % 9 || '.' || p_size as v from part")(
    lambda t: line_trip(t, t.part.select("p_partkey", F.concat_ws(".", (F.col("p_partkey") % 9).cast("string"), F.col("p_size").cast("string"))), "p_partkey:long, v").select("p_partkey", fx.version_text(fx.version(F.col("v"))).alias("v"))
)
# records of the user's own


class Tabbed(rec.Format):
    """Fields as text between tabs, null as a backslash and N; ``capitalise`` makes strings upper case when read."""

    def codec(self, field):
        if isinstance(field.dataType, T.StringType):
            upper = self.arguments.get("capitalise") == "true"
            return rec.Made(self.escaped, lambda raw: self.plain(raw).upper() if upper else self.plain(raw))
        kind = float if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else int
        return rec.Made(lambda v: repr(v).encode(), lambda raw: kind(bytes(raw)))

    def escaped(self, v: str) -> bytes:
        return v.replace("\\", "\\\\").replace("\t", "\\t").encode()

    def plain(self, raw: bytes) -> str:
        return bytes(raw).decode().replace("\\\\", "\0").replace("\\t", "\t").replace("\0", "\\")

    def join(self, fields):
        return b"\t".join(rb"\N" if f is None else f for f in fields)

    def split(self, record):
        return [None if f == rb"\N" else f for f in bytes(record).split(b"\t")]


class Version:
    """A user's type: numbers compared one after the other."""

    def __init__(self, numbers: list[int]):
        self.numbers = numbers

    @classmethod
    def parse(cls, text: str) -> Version:
        return cls([int(x) for x in text.split(".")])

    def __str__(self) -> str:
        return ".".join(map(str, self.numbers))


class WithVersions(rec.Format):
    """Columns named in ``versions`` hold a user's type, kept as its text."""

    def codec(self, field):
        if field.name in self.arguments["versions"].split(","):
            return rec.Made(lambda v: str(Version(v)).encode(), lambda raw: Version.parse(bytes(raw).decode()).numbers)
        return super().codec(field)


def record_trip(t, df, fmt: type[rec.Format], columns: list[str] | None = None, **arguments: str):
    """Rows written in a user's format and read back by several splits."""
    path, name = place(t, "records"), rec.register(t.spark, fmt, f"tidewell_{fmt.__name__.lower()}")
    rec.write(df, path, name, block_bytes="16384", **arguments)
    return rec.read(t.spark, path, name, columns, **arguments)


query("s17_user_source", "select l_partkey, l_returnflag from lineitem where l_quantity > 49 and l_returnflag in ('A', 'R')")(
    lambda t: record_trip(t, t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), rec.Format, ["l_partkey", "l_returnflag", "l_quantity"]).where("l_quantity > 49 and l_returnflag in ('A', 'R')").drop("l_quantity")
)
query("s18_user_extractor", "select p_partkey, p_name, p_size, p_retailprice from part")(lambda t: record_trip(t, t.part.select("p_partkey", "p_name", "p_size", "p_retailprice"), rec.Format))
query("s19_user_extractor_with_argument", "select c_custkey, upper(c_name) as c_name, upper(c_mktsegment) as c_mktsegment, c_acctbal from customer")(
    lambda t: record_trip(t, t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), Tabbed, capitalise="true")
)
query("s20_user_type", "select p_partkey, p_partkey % 9 || '.' || p_size as v from part")(
    lambda t: record_trip(t, t.part.select("p_partkey", F.array(F.col("p_partkey") % 9, F.col("p_size").cast("long")).alias("v")), WithVersions, versions="v").select("p_partkey", fx.version_text(F.col("v")).alias("v"))
)
query("k15_user_collections", "select p_partkey, replace(p_name, ' ', ';') as a, 'size=' || p_size as m, p_brand as b from part")(
    lambda t: sinks.flat(record_trip(t, nested(t), rec.Format).select("p_partkey", "a", "m", F.col("s.p_brand").alias("b")))
)
query("k1_text_round_trip", "select c_custkey, case when c_custkey % 5 = 0 then '' when c_custkey % 7 = 0 then ' \"' || c_name || '\" ' else c_name end as name from customer")(
    lambda t: text_trip(t, t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(' "'), "c_name", F.lit('" '))).otherwise(F.col("c_name")).alias("name")), "c_custkey:long, name")
)
query("k2_csv_round_trip", "select p_partkey, p_name, p_size from part")(lambda t: text_trip(t, t.part.select("p_partkey", "p_name", "p_size"), "p_partkey:long, p_name, p_size:int", ","))


def escaped_trip(t):
    path = place(t, "escaped")
    tx.write_text(t.documents.select("doc_id", F.concat("text", F.lit("\t\\t end\\")).alias("text")), path, escape=True)
    return tx.read_text(t.spark, path, "doc_id:long, text").select("doc_id", F.md5(tx.unescaped(F.col("text")).cast("binary")).alias("m"))


query("k3_escaped_text", "select doc_id, md5(text || chr(9) || '\\t end\\') as m from documents")(escaped_trip)
query("k13_formatted_lines", "select c_custkey || chr(9) || c_name || chr(9) || c_nationkey as value from customer")(lambda t: written_lines(t, t.customer.select("c_custkey", "c_name", "c_nationkey")))
query("k14_version_lines", "select p_partkey || chr(9) || '1.' || (p_partkey % 9) || '.' || p_size as value from part")(
    lambda t: written_lines(t, t.part.select("p_partkey", fx.version_text(fx.version(F.concat_ws(".", F.lit("1"), (F.col("p_partkey") % 9).cast("string"), F.lpad(F.col("p_size").cast("string"), 3, "0")))).alias("v")))
)

# structured


def nested(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", words.alias("a"), F.map_from_arrays(F.array(F.lit("size")), F.array("p_size")).alias("m"), F.struct("p_brand", "p_type").alias("s"))


query("k4_table_round_trip", "select p_partkey, replace(p_name, ' ', ';') as a, 'size=' || p_size as m, p_brand as b from part")(lambda t: sinks.flat(parquet_trip(t, nested(t)).select("p_partkey", "a", "m", F.col("s.p_brand").alias("b"))))
query("n3_struct_round_trip", "select p_partkey, p_brand, p_type from part")(lambda t: parquet_trip(t, nested(t)).select("p_partkey", "s.p_brand", "s.p_type"))
query("k15_flat_collections", "select p_partkey, replace(p_name, ' ', ';') as a, 'size=' || p_size as m from part")(lambda t: text_trip(t, sinks.flat(nested(t).select("p_partkey", "a", "m")), "p_partkey:long, a, m"))


def clustered(t, sort=None):
    path = place(t, "clustered")
    sinks.write_clustered(t.events.select("event_id", "event_type", "value"), path, ["event_type"], sort)
    return t.spark.read.parquet(path)


query("k5_clustered", "select event_type, count(*) as n from events group by event_type")(lambda t: clustered(t).groupBy("event_type").agg(F.count("*").alias("n")))
query("k7_clustered_sorted", "select event_id, event_type, value from events")(lambda t: clustered(t, [F.desc("value")]))


def bucketed(t, key: str):
    path, rows = place(t, "bucketed"), t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
    sinks.write_bucketed(rows, path, key, 8, key)
    return sinks.read_bucketed(t.spark, path, rows.schema, key, 8, key)


query("k6_bucketed", "select l_orderkey, round(sum(l_quantity), 2) as s from lineitem group by l_orderkey")(lambda t: bucketed(t, "l_orderkey").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("s")))


def followed(t):
    """A copy of a base whose files change after it was made: rows are taken away, others come, and the copy follows."""
    base, copy = place(t, "base"), place(t, "copy")
    rows = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
    for name, part in (("a", "l_orderkey % 3 = 0"), ("b", "l_orderkey % 3 = 1"), ("twice", "l_orderkey % 3 = 1")):
        rows.where(part).write.parquet(f"{base}/{name}")
    copies.create(t.spark, f"{base}/*", copy, "l_suppkey", rows.columns, 8)
    delete(t.spark, f"{base}/twice")
    rows.where("l_orderkey % 3 = 2").write.parquet(f"{base}/c")
    copies.refresh(t.spark, copy)
    return copies.read(t.spark, copy)


query("k9_second_copy", "select l_suppkey, round(sum(l_quantity), 2) as s from lineitem group by l_suppkey")(lambda t: followed(t).groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("s")))


def ordered(t):
    path = place(t, "ordered")
    sinks.write_ordered(t.orders.select("o_orderkey", "o_totalprice"), path, "o_totalprice", "o_orderkey")
    return t.spark.read.parquet(path)


query("k8_ordered", "select o_orderkey, o_totalprice from orders")(ordered)


def side_lines(t):
    """The lines that a scan puts out beside its rows, in the same pass."""
    path = place(t, "side")
    rows = row_numbers(t.customer.select("c_custkey", "c_name"), "c_custkey")
    line = F.format_string("Line %d: %s", F.col("number") - 1, F.col("c_name")).alias("Content")
    sinks.write_routed(rows, path, {"rows": (F.lit(True), [F.col("c_custkey")]), "lines": (F.lit(True), [line])})
    return sinks.read_routed(t.spark, path, ["rows", "lines"], "lines", "Content string")


def counted_scan(t):
    """Counters of a scan that puts out rows and a side output, as they come back from the one pass."""
    path, price = place(t, "counted"), F.col("o_totalprice")
    wrong = F.col("o_orderpriority").startswith("1")
    counts = sinks.write_routed(
        t.orders, path, {"rows": (~wrong, [F.col("o_orderkey"), price]), "urgent": (wrong, [F.concat_ws(": ", "o_orderkey", "o_orderpriority").alias("Content")])},
        {"n_rows": F.count("*"), "n_urgent": F.count_if(wrong), "most": F.max(price)},
    )
    read = [sinks.read_routed(t.spark, path, ["rows", "urgent"], n, k).agg(F.count("*").alias(f"{n}_out")) for n, k in (("rows", "o_orderkey long, o_totalprice double"), ("urgent", "Content string"))]
    return read[0].join(read[1]).select(F.lit(counts["n_rows"]).cast("long").alias("n_rows"), F.lit(counts["n_urgent"]).cast("long").alias("n_urgent"), F.lit(counts["most"]).alias("most"), "rows_out", "urgent_out")


query("k10_counters", "select count(*) as n_rows, count(case when o_orderpriority like '1%' then 1 end) as n_urgent, max(o_totalprice) as most, count(case when o_orderpriority not like '1%' then 1 end) as rows_out, count(case when o_orderpriority like '1%' then 1 end) as urgent_out from orders")(counted_scan)
query("k10_side_output", "select 'Line ' || (row_number() over (order by c_custkey) - 1) || ': ' || c_name as \"Content\" from customer")(side_lines)
query("s21_read_side_output", "select count(*) as n, count(*) as lines from customer")(lambda t: side_lines(t).agg(F.count("*").alias("n"), F.sum(F.col("Content").startswith("Line ").cast("int")).alias("lines")))
query("k11_console", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 3")(lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3))


def several(t):
    """Three outputs of one scan, in one job."""
    path, outputs = place(t, "several"), list("FOP")
    sinks.write_routed(t.orders, path, {s: (F.col("o_orderstatus") == s, [F.col("o_orderkey"), F.col("o_orderstatus")]) for s in outputs})
    each = [sinks.read_routed(t.spark, path, outputs, s, "o_orderkey long, o_orderstatus string") for s in outputs]
    return each[0].union(each[1]).union(each[2])


query("k12_several_outputs", "select o_orderkey, o_orderstatus from orders")(several)


def two_copies(t):
    path = place(t, "copies")
    sinks.write_both(t.customer, path)
    a, b = t.spark.read.parquet(f"{path}.ss"), tx.read_text(t.spark, f"{path}.tsv", CUSTOMER)
    return a.unionAll(b)


query("k16_two_copies", "select * from customer union all select * from customer")(two_copies)
query("l3_cleaned_copies", "select c_custkey, c_name from customer union all select c_custkey, c_name from customer")(lambda t: two_copies(t).drop("c_nationkey", "c_acctbal", "c_mktsegment"))

# sets of files


SERIAL = "input_%n.parquet"


def numbered_set(t, numbers):
    """A set of Parquet members by the remainder of the key, without the numbers that aren't given."""
    path, rest = place(t, "set"), F.pmod("o_orderkey", F.lit(6))
    for low, high in numbers:
        part = t.orders.select("o_orderkey", rest.alias("m"))
        fs.write_set(part, path, SERIAL.replace("%n", "<serial>"), {"serial": f"intrange:{low}...{high}"}, {"serial": F.col("m")}, ["o_orderkey"], lambda w, p: w.parquet(p))
    return path


def read_numbered(t, path: str, low: int, high: int, sparse: bool = False):
    return fs.numbered(t.spark, path, SERIAL, low, high, lambda paths: t.spark.read.parquet(*paths), sparse).select("o_orderkey", "serial")


query("s7_dense_set", "select o_orderkey, cast(o_orderkey % 6 as integer) as serial from orders where o_orderkey % 6 between 1 and 3")(lambda t: read_numbered(t, numbered_set(t, [(0, 5)]), 1, 3))
query("s8_sparse_set", "select o_orderkey, cast(o_orderkey % 6 as integer) as serial from orders where o_orderkey % 6 in (1, 2, 4)")(lambda t: read_numbered(t, numbered_set(t, [(1, 2), (4, 4)]), 1, 5, sparse=True))


def text_set(t, df, template: str, expansions: dict[str, str], keys: dict[str, object]):
    """Writes a set of text members in one job, as its template says, and reads the set with its parts."""
    path = place(t, "files")
    fs.write_set(df, path, template, expansions, keys, ["id"], lambda w, p: w.csv(p))
    return fs.read_set(t.spark, path, template, expansions, lambda paths: tx.read_text(t.spark, paths, "id:long"))


query("s9_templated_set", 'select o_orderkey as id, o_orderstatus as "Status" from orders where o_orderstatus in (\'F\', \'O\')')(lambda t: text_set(t, t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "orders-<Status>.txt", {"Status": "enum:F;O"}, {"Status": F.col("o_orderstatus")}))
query("s10_number_range", 'select o_orderkey as id, cast(o_orderkey % 5 as integer) as "N" from orders where o_orderkey % 5 between 1 and 3')(lambda t: text_set(t, t.orders.select(F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(5)).alias("n")), "orders-<N>.txt", {"N": "intrange:1...3"}, {"N": F.col("n")}))
DAYS = "select event_id as id, strftime(ts, '%Y-%m-%d') as day from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-06'"


def daily(t):
    e = t.events.select(F.col("event_id").alias("id"), F.to_date("ts").alias("d"))
    return text_set(t, e, "events-<Date.Year><Date.Month><Date.Day>.txt", {"Date": "daterange:2024-01-03...2024-01-05"}, {"Date": F.col("d")})


query("s11_day_range", DAYS)(lambda t: daily(t).select("id", F.date_format("Date", "yyyy-MM-dd").alias("day")))
query("s13_virtual_columns", "select date_part('day', ts) as d, count(*) as n from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-06' group by 1")(lambda t: daily(t).groupBy(F.dayofmonth("Date").alias("d")).agg(F.count("*").alias("n")))
query("s12_combined_parts", 'select o_orderkey as id, o_orderstatus as "S", cast(o_orderkey % 3 as integer) as "N" from orders where o_orderstatus in (\'F\', \'P\') and o_orderkey % 3 in (1, 2)')(
    lambda t: text_set(t, t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.pmod("o_orderkey", F.lit(3)).alias("n")), "o-<S>-<N>.txt", {"S": "enum:F;P", "N": "intrange:1...2"}, {"S": F.col("o_orderstatus"), "N": F.col("n")})
)
query("x8_union_of_members", "select o_orderkey, cast(o_orderkey % 6 as integer) as serial from orders")(lambda t: read_numbered(t, numbered_set(t, [(0, 5)]), 0, 5))


def latest(t):
    path = place(t, "snapshots")
    t.customer.write.parquet(f"{path}/0")
    t.customer.where("c_acctbal > 0").write.parquet(f"{path}/1")
    return t.spark.read.parquet(fs.most_recent(t.spark, [f"{path}/2", f"{path}/1", f"{path}/0"]))


query("s14_most_recent", "select * from customer where c_acctbal > 0")(latest)


def revenue(t):
    """A view: revenue by supplier."""
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


query("s15_view", "select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem group by l_suppkey")(revenue)


def events_between(t, start: str, end: str, end_mode: str = "day"):
    """A view with parameters. ``end_mode``: ``day`` takes the whole last day, ``instant`` ends at its midnight."""
    last = dt.date.fromisoformat(end) + dt.timedelta(days=end_mode == "day")
    op = "<" if end_mode == "day" else "<="
    return t.sql(f"select event_id, event_type from {{events}} where ts >= to_timestamp_ntz(:a) and ts {op} to_timestamp_ntz(:b)", "events", a=start, b=last.isoformat())


query("s16_view_with_parameters", "select event_id, event_type from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13'")(lambda t: events_between(t, "2024-01-10", "2024-01-12"))


def zipped(t):
    path, days = place(t, "gz"), {"Day": "daterange:2024-01-08...2024-01-10"}
    df = t.events.select(F.col("event_id").cast("string"), F.to_date("ts").alias("d"))
    fs.write_set(df, path, "counts-<Day.Year><Day.Month><Day.Day>", days, {"Day": F.col("d")}, ["event_id"], lambda w, p: w.option("compression", "gzip").text(p))
    name = F.regexp_extract("_metadata.file_path", r"counts-(\d{8})", 1)
    return t.spark.read.text(f"{path}/*").select(F.col("value").cast("long").alias("event_id"), *[F.substring(name, a, n).cast("int").alias(c) for c, a, n in (("y", 1, 4), ("m", 5, 2), ("d", 7, 2))])


query("s22_zipped_text", "select event_id, cast(year(ts) as integer) as y, cast(month(ts) as integer) as m, cast(day(ts) as integer) as d from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-11'")(zipped)


def filled(t, first: str = "2024-01-03", last: str = "2024-01-28"):
    """A range of days, filled in by two runs: the second one finds some days finished, and does one of them again."""
    path, day = place(t, "days"), F.to_date("ts")
    wanted = F.col("value").isNotNull() & (F.col("event_type") != "") & F.col("event_type").isin("click", "view")
    rows = lambda days: t.events.where(wanted & F.col("ts").between(F.lit(min(days)), F.lit(max(days) + dt.timedelta(days=1)))).select("event_id", day.alias("day"))
    days = backfill.days_between(dt.date.fromisoformat(first), dt.date.fromisoformat(last))
    backfill.run(t.spark, rows, path, days[:9])
    backfill.run(t.spark, rows, path, days, again=days[4:5])
    return backfill.read(t.spark, path, "event_id long, day date").select("event_id", F.col("day").cast("string").alias("day"))


def newest_first(days):
    """Rows by day, the newest day first, with the day's place in that order."""
    order = days.select("day").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.desc("day"))))  # a row a day
    return days.join(F.broadcast(order), "day").orderBy("place", "event_id")


query("l10_backfill", "select event_id, day, dense_rank() over (order by day desc) as place from (select event_id, strftime(ts, '%Y-%m-%d') as day from events where value is not null and event_type in ('click', 'view') and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-29') order by place, event_id")(lambda t: newest_first(filled(t)))
query("e4_partition_read", "select event_id from events where event_type in ('click', 'view') and strftime(ts, '%Y-%m-%d') = '2024-01-09'")(lambda t: filled(t).where("day = '2024-01-09'").select("event_id"))


def exported(t):
    path = place(t, "export")
    sinks.export_csv(t.supplier.orderBy("s_suppkey"), path, ["s_suppkey", "s_name"], 20, ";", True)
    return t.spark.read.options(header=True, sep=";").schema("s_suppkey long, s_name string").csv(path)


query("e3_csv_export", "select s_suppkey, s_name from supplier order by s_suppkey limit 20")(exported)


def converted(t):
    path = place(t, "csv")
    t.part.select("p_partkey", "p_name", "p_size").write.option("header", True).csv(path)
    return parquet_trip(t, t.spark.read.option("header", True).schema("p_partkey long, p_name string, p_size int").csv(path))


query("e5_csv_to_table", "select p_partkey, p_name, p_size from part")(converted)


def iterated(t):
    rows = sinks.client_rows(t.nation.orderBy("n_nationkey").select("n_nationkey", "n_name"), 25)
    return t.spark.createDataFrame([tuple(r) for r in rows], T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


query("e6_client_rows", "select n_nationkey, n_name from nation order by n_nationkey limit 25")(iterated)
