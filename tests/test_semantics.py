"""Rules that Spark doesn't give by itself, on small made-up inputs and known results."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as fx
from tidewell.operators import aggregates as ag
from tidewell.operators import pages as pg
from tidewell.operators import rowsets as rs
from tidewell.operators import windows as wi
from tidewell.plans.relational import looked_up
from tidewell.sources import fileset as fs
from tidewell.sources import sinks
from tidewell.sources import text as tx


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def bags(spark):
    a = spark.createDataFrame([(1, "Smith"), (1, "Smith"), (2, "Brown"), (3, "Case")], "id int, name string")
    b = spark.createDataFrame([(1, "Smith")] * 3 + [(2, "Brown")] + [(4, "Dey")] * 2, "id int, name string")
    return a, b


def test_set_operations(bags):
    a, b = bags
    assert a.unionAll(b).count() == 10
    assert rows(a.union(b).distinct()) == [(1, "Smith"), (2, "Brown"), (3, "Case"), (4, "Dey")]
    assert rows(a.intersectAll(b)) == [(1, "Smith"), (1, "Smith"), (2, "Brown")]
    assert rows(a.exceptAll(b)) == [(3, "Case")]
    assert rows(b.exceptAll(a)) == [(1, "Smith"), (4, "Dey"), (4, "Dey")]


def test_joins_with_null_keys(spark):
    e = spark.createDataFrame([("Rafferty", "31"), ("Jones", "33"), ("Heisenberg", "33"), ("Robinson", "34"), ("Smith", "34"), ("Williams", None)], "n string, d string")
    d = spark.createDataFrame([("31", "Sales"), ("33", "Engineering"), ("34", "Clerical"), ("35", "Marketing")], "d string, dep string")
    counts = [e.join(d, "d", how).count() for how in ("inner", "left", "right", "full", "left_semi")]
    assert counts == [5, 6, 6, 7, 5]
    assert d.join(e, "d", "left_semi").count() == 3 and e.crossJoin(d).count() == 24


def test_implicit_join_needs_an_equality(bags):
    a, b = bags
    with pytest.raises(ValueError):
        rs.implicit_join(a, b, [])
    assert rs.implicit_join(a, b.withColumnRenamed("id", "k"), [("id", "k")]).count() == 7


def test_argmax_and_ties(spark):
    df = spark.createDataFrame([("Eng", "Edwards", 513), ("Exec", "Johnson", 8897), ("Eng", "Adams", 513), ("Legal", "Smith", 3897)], "d string, n string, t int")
    got = rows(df.groupBy("d").agg(ag.argmax(F.col("t"), F.col("n")).alias("n")))
    assert got == [("Eng", "Edwards"), ("Exec", "Johnson"), ("Legal", "Smith")]


def test_deviation_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert math.isnan(df.agg(ag.sample_deviation(F.col("x"))).first()[0])
    assert df.where("false").agg(ag.sample_deviation(F.col("x")), ag.population_deviation(F.col("x"))).first()[:] == (0.0, 0.0)
    five = spark.createDataFrame([(float(x),) for x in (1, 3, 5, 5, 6)], "x double")
    assert five.agg(F.round(ag.sample_deviation(F.col("x")), 6)).first()[0] == 2.0
    assert abs(five.agg(ag.population_deviation(F.col("x"))).first()[0] - 1.788854382) < 1e-9


def test_element_sums(spark):
    df = spark.createDataFrame([("a", [1, 0, 1]), ("a", [1, 1, 1]), ("b", [5]), ("b", None)], "k string, v array<int>")
    assert rows(ag.element_sums(df, ["k"], "v")) == [("a", [2, 1, 2]), ("b", [5])]
    with pytest.raises(Exception, match="different lengths"):
        ag.element_sums(df.unionAll(spark.createDataFrame([("a", [1])], "k string, v array<int>")), ["k"], "v").collect()


def test_versions(spark):
    df = spark.createDataFrame([("16.2.1.23",), ("16.2.01.0 ",), ("16.10.?.1",)], "v string")
    v = fx.version(F.col("v"))
    assert df.agg(fx.version_text(ag.version_min(v)), fx.version_text(ag.version_max(v))).first()[:] == ("16.2.1.0", "16.10.0.1")
    assert df.where("false").agg(fx.version_text(ag.version_max(v))).first()[0] == "0.0.0.0"


def test_map_agg_of_repeated_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 3), ("a", None, 9)], "g string, k string, v int")
    assert ag.map_agg(df, ["g"], "k", "v").first()["map"] == {"x": 3}


def test_sum_all_rejects_text(spark):
    with pytest.raises(TypeError):
        ag.sum_all(spark.createDataFrame([(1, "a")], "x int, s string"))


def test_distinct_over_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), ("a", None), ("a", 4)], "k string, x int")
    assert rows(wi.over_distinct(df, ["k"], "x", "n", F.count)) == [("a", 4, 1), ("a", None, 1), (None, 1, 2), (None, 1, 2), (None, 2, 2)]


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    assert sorted((r.number, r.x) for r in wi.numbered(df, "x").collect()) == [(i + 1, i) for i in range(1000)]
    assert wi.numbered(df.where("false"), "x").count() == 0


def test_sparse_union_defaults(spark):
    a = spark.createDataFrame([("q", None)], "s string, n int")
    b = spark.createDataFrame([(True, "m")], "b boolean, m string")
    assert rows(rs.sparse_union(a, b)) == [("q", None, False, None), (None, 0, True, "m")]


def test_column_functions(spark):
    df = spark.createDataFrame([("a", 1, "web")], "Query string, Latency int, Vertical string")
    assert rs.delete(df, "Q*;*cal").columns == ["Latency"]
    assert rs.keep(df, "*cal").columns == ["Vertical"] and rs.keep(df, "V*,Q????").columns == ["Query", "Vertical"]
    assert rs.rename(df, "Vertical>Horizontal,None>X").columns == ["Query", "Latency", "Horizontal"]
    assert rs.replace_in_names(df, "L*", "e>E,y>YYY").columns == ["Query", "LatEncYYY", "Vertical"]
    assert rs.reverse_columns(df).columns == ["Vertical", "Latency", "Query"]
    for bad in (lambda: rs.delete(df, "*"), lambda: rs.rename(df, "a>"), lambda: rs.typed_or_not(df, "Query", "other", lambda c: c)):
        with pytest.raises(ValueError):
            bad()


def test_process_errors_surface(spark):
    def fails(batches):
        for _ in batches:
            raise RuntimeError("broken helper")

    with pytest.raises(Exception, match="broken helper"):
        rs.process(spark.range(3).toDF("x").coalesce(1), fails, "x long").collect()  # an empty partition would fail in another way, as it may come first
    assert rs.process(spark.range(3).toDF("x"), lambda b: b, "x long").count() == 3


def test_reduce_and_lookup(spark):
    tax = spark.createDataFrame([("CA", 10), ("WA", 1), ("CA", 5)], "state string, amount int")
    got = rs.reduce(tax, ["state"], lambda p: pd.DataFrame({"state": [p["state"].iloc[0]], "s": [int(p["amount"].sum())]}), "state string, s long")
    assert rows(got) == [("CA", 15), ("WA", 1)]
    names = spark.createDataFrame([("CA", "California"), ("CA", "California")], "k string, v string")
    assert rows(looked_up(tax, "state", names, "k", "v", "name").select("state", "name").distinct()) == [("CA", "California"), ("WA", "Unknown")]
    with pytest.raises(ValueError):
        looked_up(tax, "state", names, "k", "v", "state")


def test_text_is_kept_byte_for_byte(spark, tmp_path):
    text = '﻿a\t"(239, 222, 205)"\t\n\nb\t x \t5\n'
    (tmp_path / "in.txt").write_text(text, encoding="utf-8")
    df = tx.read_text(spark, str(tmp_path / "in.txt"), "name, rgb, n:int?")
    assert rows(df) == [("a", '"(239, 222, 205)"', None), ("b", " x ", 5)]
    tx.write_text(df.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
    assert written == 'a\t"(239, 222, 205)"\t\nb\t x \t5\n'
    with pytest.raises(ValueError):
        tx.schema_of("a:what")


def test_file_sets():
    assert fs.expand("intrange:1...3") == [1, 2, 3]
    assert fs.members("c-<D.Year><D.Month>-<L>.txt", {"D": "daterange:2013-03-31...2013-04-01", "L": "enum:A;B"}) == ["c-201303-A.txt", "c-201303-B.txt", "c-201304-A.txt", "c-201304-B.txt"]
    for bad in ("intrange:3...1", "intrange:-1...2", "other:1", "daterange:2013-04-01...2013-03-31"):
        with pytest.raises(ValueError):
            fs.expand(bad)
    with pytest.raises(ValueError):
        fs.members("a-<X>", {})


def test_dense_and_sparse_sets(spark, tmp_path):
    for n in (1, 2, 4):
        (tmp_path / f"log{n}.txt").write_text(f"row{n}\n")
    read = lambda paths: tx.read_text(spark, paths, "s")
    got = fs.numbered(spark, f"file://{tmp_path}", "log%n.txt", 1, 5, read, sparse=True)
    assert rows(got.select("s", "serial")) == [("row1", 1), ("row2", 2), ("row4", 4)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fs.numbered(spark, f"file://{tmp_path}", "log%n.txt", 1, 4, read)
    assert fs.most_recent(spark, [f"file://{tmp_path}/log3.txt", f"file://{tmp_path}/log2.txt", "default"]).endswith("log2.txt")
    assert fs.most_recent(spark, [f"file://{tmp_path}/none", "default"]) == "default"


def test_scalar_rules(spark):
    df = spark.createDataFrame([("a;b;c", "http://www.news.example.com/x", "FF"), ("NULL", "d-card:1/2", "0A")], "t string, u string, h string")
    assert rows(df.select(fx.token_count(F.col("t")), fx.domain(F.col("u")), fx.hex_number(F.col("h")))) == [(0, "d-card:1/2", 10), (3, "example.com", 255)]
    nulls = spark.createDataFrame([(None,)], "t string")
    assert nulls.select(fx.contains_any_case(F.col("t"), "x"), fx.contains_one_of(F.col("t"), ["x"])).first()[:] == (False, False)
    assert df.select(fx.contains_one_of(F.col("t"), ["B;", "["])).first()[0] is True
    with pytest.raises(Exception, match="unknown kind"):
        df.select(fx.shape(F.col("t"), F.array(F.lit(1)))).collect()
    with pytest.raises(Exception, match="must be given"):
        nulls.select(fx.page_view(F.col("t"), F.col("t"))).collect()


def test_click_positions(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["c"])], "r array<string>, c array<string>")
    r, c = F.col("r"), F.col("c")
    assert df.select(fx.click_position(r, c, 1), fx.click_position(r, c, 1, True), fx.click_position(r, c, 2)).first()[:] == (3, 0, 0)


def test_pages(spark):
    html = '<p><a href="/x"> one <b>two</b></a><a>no</a><table><tr><th>A<th>B|C</tr><tr><td>1<td>2</table>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert rows(pg.links(df)) == [(1, 0, "one two", "/x")]
    assert rows(pg.table_rows(df)) == [(1, 0, "th", "A|BC"), (1, 1, "td", "1|2")]


def test_plans_stay_in_the_jvm(spark):
    from tidewell import plans

    for name in ("flagship_top_nations", "a8_argmax", "w12_sum_distinct", "w10_total_over_all", "r11_remove_items_by_lambda", "j12_percent_of_total"):
        text = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Pandas" not in text, name
        assert "Window" not in text, name


def test_bucketed_tables_group_without_exchange(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    sinks.save_bucketed(df, "tidewell_test_bucketed", "k", 4, "k")
    plan = spark.table("tidewell_test_bucketed").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ranks_of_few_groups_are_those_of_windows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidewell.operators import windows as wi

    rows = [(None if i % 5 == 0 else i % 3, None if i % 11 == 0 else (i * 7) % 13, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    w, u = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g").orderBy("v", "id")
    expected = df.select("g", "v", "id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.cume_dist().over(w).alias("c"), F.percent_rank().over(w).alias("p"), F.row_number().over(u).alias("n"), F.ntile(7).over(u).alias("q"))
    got = wi.ranked(wi.ranked(df, ["g"], ["v"], r="rank", d="dense_rank", c="cume_dist", p="percent_rank"), ["g"], ["v", "id"], n="row_number", q="ntile(7)")
    plain = lambda x: sorted((tuple(r) for r in x.select("g", "v", "id", "r", "d", "c", "p", "n", "q").collect()), key=str)
    assert plain(got) == plain(expected)
    assert wi.ranked(df.where("false"), ["g"], ["v"], r="rank").count() == 0
    for share in (0.0, 0.25, 0.5, 1.0):
        both = df.groupBy("g").agg(F.expr(f"percentile_cont({share}) within group (order by v)").alias("c"), F.expr(f"percentile_disc({share}) within group (order by v)").alias("d"))
        found = wi.over_percentile(wi.over_percentile(df, ["g"], "v", share, "c"), ["g"], "v", share, "d", True).select("g", "c", "d").distinct()
        assert sorted(map(str, map(tuple, found.selectExpr("g", "double(c)", "double(d)").collect()))) == sorted(map(str, map(tuple, both.selectExpr("g", "double(c)", "double(d)").collect())))


def test_escapes_are_read_from_the_left(spark):
    from pyspark.sql import functions as F

    from tidewell.sources import text as tx

    values = ["\x00", "a\x00b\\", "\\t", "\\\\t\t", "\\", "\\\\", "\n\\n\r\\r\\", "", "\\\t\\\\\t", None]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", tx.unescaped(tx.escaped(F.col("s"))).alias("b"), tx.escaped(F.col("s")).alias("e")).collect()
    assert all(r.s == r.b and not set("\t\n\r") & set(r.e or "") for r in got)


def test_client_rows_raise_beyond_the_bound(spark):
    from tidewell.sources import sinks

    df = spark.range(30)
    assert [r.id for r in sinks.client_rows(df, 30)] == list(range(30))
    seen = []
    with pytest.raises(ValueError, match="more than 29"):
        for r in sinks.client_rows(df, 29):
            seen.append(r.id)
    assert len(seen) == 29


def test_table_rows_of_a_page(spark):
    from tidewell.operators import pages as pg

    html = "<table><tr><th>Name<th> A|B </tr><tr><td>x <b>y</b></td><td></td></tr><tr><td>1<td>2</table><p>no"
    got = pg.table_rows(spark.createDataFrame([(4, html), (5, None), (6, "<p>none")], "page_id long, html string")).collect()
    assert sorted(map(tuple, got)) == [(4, 0, "th", "Name|AB"), (4, 1, "td", "x y|"), (4, 2, "td", "1|2")]


def test_sets_of_members_are_written_in_one_job(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidewell.sources import fileset as fs

    df = spark.range(100).selectExpr("id", "id % 4 as n", "case id % 3 when 0 then 'a' when 1 then 'b' else 'z' end as s")
    template, parts = "x-<S>-<N>.parquet", {"S": "enum:a;b", "N": "intrange:0...5"}
    folder = f"file://{tmp_path}/set"
    fs.write_set(df, folder, template, parts, {"S": F.col("s"), "N": F.col("n")}, ["id"], lambda w, p: w.parquet(p))
    read = lambda paths: spark.read.schema("id long").parquet(*paths)
    got = sorted((r.id, r.S, r.N) for r in fs.read_set(spark, folder, template, parts, read).collect())
    assert got == sorted((r.id, r.s, r.n) for r in df.where("s <> 'z'").collect())
    with pytest.raises(Exception):
        fs.read_set(spark, folder, template, {"S": "enum:a;b;c", "N": "intrange:0...5"}, read).collect()
    sparse = fs.read_set(spark, folder, template, {"S": "enum:a;b;c", "N": "intrange:0...9"}, read, sparse=True)
    assert sparse.count() == len(got)


def test_all_pairs_need_a_small_side(spark, monkeypatch):
    from tidewell.operators import rowsets as rs

    monkeypatch.setattr(rs, "PAIRED_ROWS", 5)
    a, b = spark.range(9).withColumnRenamed("id", "x"), spark.range(4).withColumnRenamed("id", "y")
    assert rs.combine(a, b, None).count() == rs.combine(b, a, None).count() == 36
    with pytest.raises(ValueError, match="all pairs"):
        rs.combine(a, a.withColumnRenamed("x", "z"), None)


@pytest.mark.parametrize("most", [0, 1, 100])
def test_items_are_counted_in_rows_and_over_rows_of_a_key(spark, most):
    from collections import Counter

    data = [(1, "a b a"), (2, ""), (3, None), (4, "x  x "), (5, "b a"), (5, "a"), (5, None), (None, "a a"), (None, "a c"), (6, "é e é")]
    expected = Counter((k, w) for k, text in data if text is not None for w in text.split(" "))
    df = spark.createDataFrame(data, "k long, t string").repartition(3)
    got = ag.item_counts(df, "k", F.split("t", " "), "word", "times", most)
    assert got.columns == ["k", "word", "times"] and got.schema["times"].dataType.simpleString() == "bigint"
    assert {(r.k, r.word): r.times for r in got.collect()} == expected and got.count() == len(expected)


def test_items_of_lone_keys_are_not_shuffled(spark):
    df = spark.range(50).select("id", F.lit("a b a").alias("t"))
    got = ag.item_counts(df, "id", F.split("t", " "), "w", "n")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 100
