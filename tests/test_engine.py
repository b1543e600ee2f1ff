"""The engine's semantics at their edges: widths, byte lengths, empty tables, names, errors, text."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import compat as c
from tessera.functions.dialect import Dialect, statements
from tessera.operators import relational as r
from tessera.plans import render
from tessera.plans.engine import Engine
from tessera.sources import tables as t


@pytest.fixture(scope="module")
def engine(spark):
    t.values(spark, [(1, 2147483647), (1, 1), (2, -2147483648), (2, -1), (3, -9), (3, 0), (3, -1)], ["k", "v"]).createOrReplaceTempView("int_edges")
    t.values(spark, [(1, ""), (1, "a"), (1, "ab"), (2, "b"), (2, "NULL"), (2, "é"), (2, "🙂")], ["k", "s"]).createOrReplaceTempView("str_edges")
    spark.createDataFrame([], "k int, s string").createOrReplaceTempView("empty")
    t.values(spark, [(1, 10), (2, 20), (3, 30)], ["a", "b"]).createOrReplaceTempView("small")
    return Engine(spark)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_whole_numbers_wrap_and_averages_are_cut(engine):
    assert rows(engine.sql("SELECT k, sum(v) AS s, avg(v) AS a FROM int_edges GROUP BY k")) == [(1, -2147483648, 1073741824), (2, 2147483647, -1073741824), (3, -10, -3)]
    assert rows(engine.sql("SELECT v + 1 AS p, v - 1 AS m FROM int_edges WHERE k = 1")) == [(-2147483648, 2147483646), (2, 0)]


def test_column_forms_agree_with_the_text(engine, spark):
    df = spark.table("int_edges")
    assert rows(r.aggregate(df, ["k"], [c.sum32(F.col("v")).alias("s"), c.avg_cut(F.col("v")).alias("a")])) == rows(engine.sql("SELECT k, sum(v) AS s, avg(v) AS a FROM int_edges GROUP BY k"))


def test_strings_aggregate_over_bytes_and_add_up(engine):
    assert rows(engine.sql("SELECT k, sum(s) AS n, min(s) AS lo, max(s) AS hi, avg(s) AS a FROM str_edges GROUP BY k")) == [(1, 3, 0, 2, 1), (2, 11, 1, 4, 2)]
    assert rows(engine.sql("SELECT s + '!' AS x FROM str_edges WHERE s = 'a'")) == [("a!",)]
    assert [x[0] for x in engine.sql("SELECT s FROM str_edges WHERE k = 1 ORDER BY s DESC").collect()] == ["ab", "a", ""]


def test_mixed_types_are_an_error(engine):
    with pytest.raises((TypeError, AnalysisException)):
        engine.sql("SELECT k + s AS x FROM str_edges").collect()


def test_empty_tables(engine):
    assert rows(engine.sql("SELECT * FROM empty")) == []
    assert rows(engine.sql("SELECT sum(k) AS s, count(*) AS n FROM empty")) == []
    assert rows(engine.sql("SELECT e.k FROM small x JOIN empty e ON x.a = e.k")) == []
    assert engine.show("SELECT * FROM empty") == "empty set"


def test_aliases_and_names(engine):
    assert rows(engine.sql("SELECT a + b AS c FROM small WHERE c > 11 AND NOT c = 22")) == [(33,)]
    assert rows(engine.sql("SELECT b AS a FROM small WHERE a = 2")) == [(20,)]  # the column wins
    assert [x[0] for x in engine.sql("SELECT 0 - a AS b FROM small ORDER BY b").collect()] == [-1, -2, -3]
    assert engine.sql("SELECT q.unname_col1 FROM (SELECT a, a + b FROM small) q").columns == ["unname_col1"]
    assert engine.sql("SELECT a + b, a > 1 FROM small").columns == ["a + b", "a > 1"]
    assert rows(engine.sql("SELECT a > 1 AS x FROM small")) == [(0,), (1,), (1,)]
    assert rows(engine.sql("SELECT a AS x, a AS x FROM small WHERE a = 1")) == [(1, 1)]
    assert engine.sql("SELECT a AS x, a AS y FROM small").columns == ["x", "y"]


def test_limits(engine):
    at = lambda tail: [x[0] for x in engine.sql(f"SELECT a FROM small ORDER BY a {tail}").collect()]
    assert (at("LIMIT 9"), at("LIMIT 0"), at("OFFSET 2"), at("LIMIT 1 OFFSET 1"), at("LIMIT 5 OFFSET 9")) == ([1, 2, 3], [], [3], [2], [])


def test_joined_subqueries_with_filters_on_all_sides(engine):
    sql = "SELECT x.a, y.b FROM (SELECT a AS a FROM small WHERE a > 1) x JOIN (SELECT a AS a, b AS b FROM small WHERE b < 30) y ON x.a + 0 = y.a WHERE y.b > 5"
    assert rows(engine.sql(sql)) == [(2, 20)]


def test_plain_spark_sql_passes(engine):
    assert rows(engine.sql("SELECT CASE WHEN a IN (1, 2) THEN 'x' ELSE 'y' END AS z, count(*) OVER () AS n FROM small")) == [("x", 3), ("x", 3), ("y", 3)]
    assert rows(engine.sql("WITH w AS (SELECT a FROM small) SELECT a FROM w WHERE a BETWEEN 2 AND 3")) == [(2,), (3,)]
    assert rows(engine.sql("SELECT a FROM small WHERE a = 1 UNION ALL SELECT b FROM small WHERE a = 1")) == [(1,), (10,)]


def test_batch_bounds(spark):
    for n in (4095, 4096, 4097):
        df = spark.range(n).select(F.col("id").cast("int").alias("k"))
        assert r.ordered(df, [F.desc("k")]).first()[0] == n - 1
        assert r.join(df.alias("a"), df.alias("b"), "a.k = b.k").count() == n
        assert r.limited(r.ordered(df, ["k"]), 1, n - 1).first()[0] == n - 1


def test_tables_and_inserts(engine, spark):
    spark.sql("DROP TABLE IF EXISTS made")
    assert rows(engine.sql("CREATE TABLE made(a int, b varchar(3))")) == [(1,)]
    with pytest.raises(AnalysisException):
        engine.sql("CREATE TABLE made(a int)")
    assert rows(engine.sql("INSERT INTO made VALUES (1, 'x'), (2, 'yy')")) == [(2,)]
    assert rows(engine.sql("INSERT INTO made (b, a) VALUES ('z', 3); INSERT INTO made SELECT a, b FROM made; SELECT * FROM made")) == [(1, "x")] * 2 + [(2, "yy")] * 2 + [(3, "z")] * 2
    for bad in ("INSERT INTO made VALUES (1)", "INSERT INTO made VALUES ('q', 'x')", "INSERT INTO made VALUES (1, 2)", "INSERT INTO made VALUES (1, 'long')"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            engine.sql(bad)
    listed = engine.show_tables()
    assert " made 6\n" in listed and "b-string-3" in listed
    assert rows(engine.sql("INSERT INTO made SELECT sum(a), 'n' FROM small")) == [(1,)]
    spark.sql("DROP TABLE made")


def test_explain_runs_nothing(engine):
    text = engine.sql("EXPLAIN SELECT a FROM small WHERE a > 1").first()[0]
    assert all(f"==== {x} ====" in text for x in ("Logical", "Optimized", "Physical"))


def test_explain_of_an_insert_leaves_the_table(engine, spark):
    spark.sql("DROP TABLE IF EXISTS kept")
    engine.sql("CREATE TABLE kept(a int, b varchar(3))")
    text = engine.sql("EXPLAIN INSERT INTO kept VALUES (1, 'x')").first()[0]
    assert "Insert" in text and spark.table("kept").count() == 0
    assert rows(engine.sql("INSERT INTO default.kept SELECT NULL, 'q'")) == [(1,)] and spark.table("kept").count() == 1
    with pytest.raises(ValueError):
        engine.sql("INSERT INTO default.kept VALUES (1)")
    spark.sql("DROP TABLE kept")


def test_comparison_of_number_and_string_is_an_error(engine):
    for bad in ("SELECT a FROM small WHERE a = 'x'", "SELECT a FROM small WHERE a IN (1, 'x')", "SELECT x.a FROM small x JOIN small y ON x.a > 'b'"):
        with pytest.raises(TypeError):
            engine.sql(bad)


def test_parameters(engine):
    assert rows(engine.sql("SELECT a FROM small WHERE a >= :least", {"least": 2})) == [(2,), (3,)]


def test_generated_tables_are_the_same_every_time(spark):
    one, two = t.generated(spark, 2, 7), t.generated(spark, 2, 7).repartition(3)
    assert rows(one) == rows(two) and one.count() == 2000
    assert rows(t.generated(spark, 2, 8)) != rows(one)
    with pytest.raises(ValueError):
        t.generated(spark, 1001)


def test_values_check_their_types(spark):
    with pytest.raises(TypeError):
        t.values(spark, [(1,), ("x",)])


def test_smoke(engine):
    assert engine.smoke().count() == 1


def test_grid():
    assert render.grid(["c.a"], [(1,), (None,)], 0.5) == "+------+\n|  c.a |\n+------+\n|    1 |\n+------+\n| NULL |\n+------+\n2 record  in: 0.500000 second  1 chunk"


def test_statements_split_outside_of_strings():
    assert statements("SELECT ';' AS a; SELECT 2") == ["SELECT ';' AS a", "SELECT 2"]
    assert Dialect(lambda s: []).translate("VALUES (1)") == "VALUES (1)"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats_round_trip(spark, tmp_path, kind):
    df = t.values(spark, [(1, "x"), (2, None), (-3, "a, b")], ["a", "b"])
    t.save(df, str(tmp_path), "t", kind)
    for schema in (None, df.schema):
        assert sorted(map(str, ((int(r.a), r.b) for r in t.load(spark, str(tmp_path), "t", kind, schema).select("a", "b").collect()))) == sorted(map(str, [(1, "x"), (2, None), (-3, "a, b")]))


def test_profile_counts_rows_of_operators(engine):
    engine.generate(10)
    found = engine.profile("SELECT colA, count(colB) AS n FROM random10 WHERE colA > 10 GROUP BY colA")
    assert found[0][0] == 0 and any("HashAggregate" in name and m.get("numOutputRows", 0) > 0 for _, name, m in found)
    assert any("Exchange" in name for _, name, _ in found)
