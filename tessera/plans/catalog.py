"""The registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat as c
from ..operators import relational as r
from ..sources import tables as t
from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def of(name: str, build: Callable[..., DataFrame], tables: str, oracle: str) -> None:
    """A query built from the DataFrames of some tables."""
    QUERIES[name] = lambda spark, folder: build(*[t.load(spark, folder, x) for x in tables.split()])
    ORACLES[name] = oracle


def text(name: str, sql: str, tables: str, oracle: str | None = None) -> None:
    """A query in the dialect's SQL text; without an oracle of its own the text is the oracle."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t.register(spark, folder, tables.split())
        return Engine(spark).sql(sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


# Scans and projections.
of("scan_star", lambda n: r.scan(n), "nation", "SELECT * FROM nation")
of("scan_project", lambda x: r.scan(x, ["c_custkey", "c_name"]), "customer", "SELECT c_custkey, c_name FROM customer")
of("scan_pushed", lambda x: r.scan(x, ["o_orderkey", "o_totalprice"], "o_orderkey < 500"), "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 500")
of("scan_alias", lambda x: x.alias("k").select(F.col("k.c_custkey").alias("key")), "customer", "SELECT k.c_custkey AS key FROM customer AS k")
of("project_const", lambda n: r.project(n, ["n_nationkey", F.lit(7).alias("seven"), F.lit("x").alias("tag")]), "nation", "SELECT n_nationkey, 7 AS seven, 'x' AS tag FROM nation")
of("project_join_star", lambda n, g: r.join(n, g, n.n_regionkey == g.r_regionkey), "nation region", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey")
of("arith_add_sub", lambda p: r.project(p, ["p_partkey", c.add32(F.col("p_size"), F.lit(1)).alias("a"), c.sub32(F.col("p_size"), F.lit(3)).alias("b")]), "part", "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b FROM part")
of("arith_int32_wrap", lambda p: r.project(p, ["p_partkey", c.add32(F.col("p_size"), F.lit(2147483647)).alias("w"), c.sub32(c.sub32(F.lit(0), F.col("p_size")), F.lit(2147483647)).alias("v")]), "part",
   "SELECT p_partkey, ((p_size::BIGINT + 2147483647 + 2147483648) % 4294967296 - 2147483648)::INT AS w, CASE WHEN p_size > 1 THEN (-p_size::BIGINT - 2147483647 + 4294967296)::INT ELSE (-p_size::BIGINT - 2147483647)::INT END AS v FROM part")
of("str_concat", lambda n: r.project(n, ["n_nationkey", c.joined(F.col("n_name"), F.lit("_x")).alias("s")]), "nation", "SELECT n_nationkey, n_name || '_x' AS s FROM nation")
of("cmp_projection", lambda p: r.project(p, ["p_partkey", c.as_number(F.col("p_size") > 10).alias("big"), c.as_number(F.col("p_size") == F.lit(7)).alias("seven")]), "part", "SELECT p_partkey, (p_size > 10)::INT AS big, (p_size = 7)::INT AS seven FROM part")

# Filters.
for _name, _op in (("eq", "="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("ne", "<>")):
    of(f"filter_{_name}", lambda p, op=_op: r.scan(p, ["p_partkey", "p_size"], f"p_size {op} 25"), "part", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25")
of("filter_str_eq", lambda x: r.scan(x, ["c_custkey"], F.col("c_mktsegment") == "BUILDING"), "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
of("filter_str_order", lambda x: r.scan(x, ["n_nationkey", "n_name"], F.col("n_name") > "J"), "nation", "SELECT n_nationkey, n_name FROM nation WHERE n_name > 'J'")
of("filter_int_truthy", lambda p: r.scan(p, ["p_partkey"], c.truth(F.col("p_size") - 5)), "part", "SELECT p_partkey FROM part WHERE (p_size - 5) <> 0")
of("filter_and_or_not", lambda p: r.scan(p, ["p_partkey"], (F.col("p_size") > 10) & ((F.col("p_size") < 20) | ~(F.col("p_brand") == "Brand#11"))), "part", "SELECT p_partkey FROM part WHERE p_size > 10 AND (p_size < 20 OR NOT p_brand = 'Brand#11')")
text("filter_alias", "SELECT p_partkey, p_size + 1 AS bigger FROM part WHERE bigger > 40", "part", "SELECT p_partkey, p_size + 1 AS bigger FROM part WHERE p_size + 1 > 40")
text("filter_truthy_text", "SELECT p_partkey FROM part WHERE p_size - 5", "part", "SELECT p_partkey FROM part WHERE p_size - 5 <> 0")
of("filter_in_between_like", lambda p: r.scan(p, ["p_partkey"], F.col("p_size").isin(1, 5, 9) | F.col("p_size").between(30, 33) | F.col("p_name").like("%a%b%")), "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR p_size BETWEEN 30 AND 33 OR p_name LIKE '%a%b%'")

# Joins.
of("join_eq", lambda o, x: r.project(r.join(o, x, "o_custkey = c_custkey"), ["o_orderkey", "c_name"]), "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
of("join_expr_key", lambda n: r.project(r.join(n.alias("a"), n.alias("b"), "a.n_nationkey + 1 = b.n_nationkey"), [F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y")]), "nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
of("join_3way", lambda x, n, g: r.project(r.join(r.join(x, n, "c_nationkey = n_nationkey"), g, "n_regionkey = r_regionkey"), ["c_custkey", "n_name", "r_name"]), "customer nation region", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
of("join_residual", lambda o, x: r.project(r.filtered(r.join(o, x, "o_custkey = c_custkey"), "o_totalprice > c_acctbal and c_nationkey < 10"), ["o_orderkey", "c_custkey"]), "orders customer", "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal AND c_nationkey < 10")
of("join_theta", lambda n: r.project(r.join(n.alias("a"), n.alias("b"), "a.n_nationkey < b.n_regionkey"), [F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y")]), "nation", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_regionkey")
of("join_self_alias", lambda n: r.project(r.join(n.alias("a"), n.alias("b"), "a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"), [F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y")]), "nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
for _how in ("left", "right", "full"):
    of(f"join_{_how}", lambda n, s, how=_how: r.project(r.join(n.where("n_nationkey < 15"), s.where("s_suppkey < 40"), F.col("n_nationkey") == F.col("s_nationkey"), how), ["n_nationkey", "s_suppkey"]), "nation supplier",
       f"SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) {_how.upper()} JOIN (SELECT * FROM supplier WHERE s_suppkey < 40) ON n_nationkey = s_nationkey")
of("join_semi", lambda x, o: r.project(r.join(x, o, x.c_custkey == o.o_custkey, "left_semi"), ["c_custkey"]), "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
of("join_anti", lambda x, o: r.project(r.join(x, o, x.c_custkey == o.o_custkey, "left_anti"), ["c_custkey"]), "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
text("join_text", "SELECT a.n_name AS x, b.n_name AS y FROM nation a INNER JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey JOIN region g ON b.n_regionkey = g.r_regionkey WHERE g.r_name > 'B'", "nation region")

# Derived tables.
text("subquery", "SELECT q.k FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey > 10) q WHERE q.n < 5", "customer")
text("subquery_join", "SELECT a.ok, b.nm FROM (SELECT o_orderkey AS ok, o_custkey AS ck FROM orders WHERE o_orderkey > 100) a JOIN (SELECT c_custkey AS ck, c_name AS nm FROM customer WHERE c_nationkey < 12) b ON a.ck = b.ck WHERE a.ok < 3000", "orders customer")
text("subquery_unnamed", "SELECT q.unname_col0, q.unname_col1 FROM (SELECT p_partkey, p_size + 1 FROM part) q WHERE q.unname_col1 > 30", "part", "SELECT p_partkey AS unname_col0, p_size + 1 AS unname_col1 FROM part WHERE p_size + 1 > 30")
text("subquery_nested", "SELECT z.k FROM (SELECT y.k AS k FROM (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 9) y WHERE y.k > 2) z WHERE z.k < 8", "nation")


@query("values", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) v(a, b)")
def _values(spark: SparkSession, folder: str) -> DataFrame:
    return t.values(spark, [(1, "x"), (2, "y")], ["a", "b"])


# Aggregates.
of("agg_count", lambda x: r.aggregate(x, ["l_returnflag"], [F.count("l_orderkey").alias("n")]), "lineitem", "SELECT l_returnflag, count(l_orderkey) AS n FROM lineitem GROUP BY l_returnflag")
of("agg_count_star", lambda x: r.aggregate(x, ["l_linestatus"], [F.count(F.lit(1)).alias("n")]), "lineitem", "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linestatus")
of("agg_sum_int", lambda x: r.aggregate(x, ["l_returnflag"], [c.sum32(F.col("l_linenumber")).alias("s")]), "lineitem", "SELECT l_returnflag, sum(l_linenumber)::INT AS s FROM lineitem GROUP BY l_returnflag")
of("agg_sum_wrap", lambda x: r.aggregate(x, ["l_returnflag"], [c.sum32(c.add32(F.col("l_linenumber"), F.lit(2147483000))).alias("s")]), "lineitem", "SELECT l_returnflag, ((sum(l_linenumber::BIGINT + 2147483000)::BIGINT + 2147483648) % 4294967296 - 2147483648)::INT AS s FROM lineitem GROUP BY l_returnflag")
of("agg_sum_dbl_exact", lambda x: r.aggregate(x, ["l_returnflag"], [F.sum("l_quantity").alias("q")]), "lineitem", "SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
of("agg_min_max", lambda x: r.aggregate(x, ["l_returnflag"], [F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")]), "lineitem", "SELECT l_returnflag, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag")
of("agg_avg_trunc", lambda x: r.aggregate(x, ["l_returnflag"], [c.avg_cut(F.col("l_linenumber")).alias("a")]), "lineitem", "SELECT l_returnflag, (sum(l_linenumber) // count(l_linenumber))::INT AS a FROM lineitem GROUP BY l_returnflag")
of("agg_strlen", lambda d: r.aggregate(d, ["lang"], [c.sum32(c.bytes_of(F.col("text"))).alias("s"), F.min(c.bytes_of(F.col("text"))).alias("lo"), F.max(c.bytes_of(F.col("text"))).alias("hi"), c.avg_cut(c.bytes_of(F.col("text"))).alias("a")]), "documents",
   "SELECT lang, sum(strlen(text))::INT AS s, min(strlen(text))::INT AS lo, max(strlen(text))::INT AS hi, (sum(strlen(text)) // count(text))::INT AS a FROM documents GROUP BY lang")
of("agg_global", lambda p: r.aggregate(p, [], [F.count(F.lit(1)).alias("n"), F.max("p_size").alias("m")]), "part", "SELECT count(*) AS n, max(p_size) AS m FROM part")
of("agg_global_empty_zero_rows", lambda p: r.aggregate_or_nothing(p.where("p_size > 1000"), [F.count("p_size").alias("n")]), "part", "SELECT count(p_size) AS n FROM part WHERE p_size > 1000 HAVING count(*) > 0")
of("group_expr", lambda p: r.aggregate(p, [(F.col("p_size") + 1).alias("k")], [F.count("p_partkey").alias("n")]), "part", "SELECT p_size + 1 AS k, count(p_partkey) AS n FROM part GROUP BY p_size + 1")
of("group_multi", lambda o: r.aggregate(o, ["o_orderstatus", "o_orderpriority"], [F.count("o_orderkey").alias("n")]), "orders", "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
of("having", lambda x: r.aggregate(x, ["c_nationkey"], [F.count("c_custkey").alias("n")], "n > 60"), "customer", "SELECT c_nationkey, count(c_custkey) AS n FROM customer GROUP BY c_nationkey HAVING count(c_custkey) > 60")
of("agg_distinct", lambda o: r.aggregate(o, ["o_orderpriority"], [F.count_distinct("o_custkey").alias("n")]), "orders", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority")
of("agg_filter", lambda o: r.aggregate(o, ["o_orderstatus"], [F.expr("count(o_orderkey) filter (where o_totalprice > 1000)").alias("n")]), "orders", "SELECT o_orderstatus, count(o_orderkey) FILTER (WHERE o_totalprice > 1000) AS n FROM orders GROUP BY o_orderstatus")
of("agg_first_last", lambda o: r.aggregate(o, ["o_orderstatus"], [F.min_by("o_custkey", "o_orderkey").alias("f"), F.max_by("o_custkey", "o_orderkey").alias("l")]), "orders", "SELECT o_orderstatus, arg_min(o_custkey, o_orderkey) AS f, arg_max(o_custkey, o_orderkey) AS l FROM orders GROUP BY o_orderstatus")
text("agg_over_expr", "SELECT l_returnflag AS f, sum(l_linenumber + 1) AS s, sum(l_linenumber) + 1 AS t, avg(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", "lineitem", "SELECT l_returnflag AS f, sum(l_linenumber + 1)::INT AS s, (sum(l_linenumber) + 1)::INT AS t, (sum(l_linenumber) // count(l_linenumber))::INT AS a FROM lineitem GROUP BY l_returnflag")
text("agg_alias_group", "SELECT p_size + 1 AS k, count(p_partkey) AS n FROM part GROUP BY k HAVING n > 30", "part", "SELECT p_size + 1 AS k, count(p_partkey)::INT AS n FROM part GROUP BY p_size + 1 HAVING count(p_partkey) > 30")
text("agg_bytes_text", "SELECT n_regionkey AS k, sum(n_name) AS s, max(n_name) AS hi, avg(n_name) AS a FROM nation GROUP BY n_regionkey", "nation", "SELECT n_regionkey AS k, sum(strlen(n_name))::INT AS s, max(strlen(n_name))::INT AS hi, (sum(strlen(n_name)) // count(n_name))::INT AS a FROM nation GROUP BY n_regionkey")
of("grouping_sets", lambda o: o.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")

# Sorts and limits; every order is total.
of("sort_limit", lambda o: r.limited(r.ordered(r.scan(o, ["o_orderkey", "o_totalprice"]), [F.desc("o_totalprice"), "o_orderkey"]), 50), "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
of("sort_multi_expr", lambda p: r.limited(r.ordered(r.scan(p, ["p_partkey", "p_size"]), [(F.col("p_size") + 1).desc(), "p_partkey"]), 40), "part", "SELECT p_partkey, p_size FROM part ORDER BY p_size + 1 DESC, p_partkey LIMIT 40")
of("offset_only", lambda x: r.limited(r.ordered(r.scan(x, ["c_custkey"]), ["c_custkey"]), None, 1000), "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 1000")
of("limit_offset", lambda x: r.limited(r.ordered(r.scan(x, ["c_custkey"]), ["c_custkey"]), 7, 5), "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5")
of("limit_zero", lambda n: r.limited(r.scan(n, ["n_name"]), 0), "nation", "SELECT n_name FROM nation LIMIT 0")
of("limit_beyond", lambda n: r.limited(r.ordered(r.scan(n, ["n_name"]), ["n_name"]), 1000), "nation", "SELECT n_name FROM nation ORDER BY n_name LIMIT 1000")
of("sort_by_agg", lambda x: r.limited(r.ordered(r.aggregate(x, ["l_suppkey"], [F.count("l_orderkey").alias("n")]), [F.desc("n"), "l_suppkey"]), 10), "lineitem", "SELECT l_suppkey, count(l_orderkey) AS n FROM lineitem GROUP BY l_suppkey ORDER BY count(l_orderkey) DESC, l_suppkey LIMIT 10")
of("sort_hidden_col", lambda x: r.project(r.limited(r.ordered(x, [F.desc("c_acctbal"), "c_custkey"]), 20), ["c_name"]), "customer", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
text("sort_column_beats_alias", "SELECT n_nationkey + 0 AS k, 0 - n_regionkey AS n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4", "nation", "SELECT n_nationkey + 0 AS k, 0 - n_regionkey AS n_nationkey FROM nation ORDER BY nation.n_nationkey LIMIT 4")

# Beyond the working surface of the engine this one stands in for: standard relational operators.
of("distinct", lambda o: r.scan(o, ["o_orderstatus", "o_orderpriority"]).distinct(), "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
of("union_all", lambda n, g: r.project(n, [F.col("n_name").alias("x")]).unionAll(r.project(g, [F.col("r_name").alias("x")])), "nation region", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region")
of("intersect", lambda x, s: r.project(x, [F.col("c_nationkey").alias("k")]).intersect(r.project(s, [F.col("s_nationkey").alias("k")])), "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
of("except", lambda n, s: r.project(n, [F.col("n_nationkey").alias("k")]).subtract(r.project(s.where("s_suppkey < 30"), [F.col("s_nationkey").alias("k")])), "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 30")


def _stored(spark: SparkSession, columns: str) -> str:
    """A managed table of its own for one run of a query."""
    name = f"tessera_demo_{spark.sparkContext.applicationId.replace('-', '_')}_{abs(hash(columns)) % 10**6}".lower()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    Engine(spark).sql(f"CREATE TABLE {name} {columns}")
    return name


@query("create_table", "SELECT 'a' AS col_name, 'int' AS data_type UNION ALL SELECT 'b', 'string'")
def _create(spark: SparkSession, folder: str) -> DataFrame:
    name = _stored(spark, "(a int, b varchar(20))")
    return t.values(spark, [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields], ["col_name", "data_type"])


@query("insert_values", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, 'z')) v(a, b)")
def _insert_values(spark: SparkSession, folder: str) -> DataFrame:
    name = _stored(spark, "(a int, b varchar(10))")
    Engine(spark).sql(f"INSERT INTO {name} VALUES (1, 'x'), (2, 'y'); INSERT INTO {name} (b, a) VALUES ('z', 3)")
    return spark.table(name)


@query("insert_select", "SELECT n_nationkey AS a, n_name AS b FROM nation WHERE n_nationkey > 4 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 4")
def _insert_select(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["nation"])
    name = _stored(spark, "(a int, b varchar(30))")
    Engine(spark).sql(f"INSERT INTO {name} SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 4; INSERT INTO {name} SELECT a, b FROM {name}")
    return spark.table(name)


@query("insert_count", "SELECT 25 AS inserted")
def _insert_count(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["nation"])
    name = _stored(spark, "(a int, b varchar(31))")
    return Engine(spark).sql(f"INSERT INTO {name} SELECT n_nationkey, n_name FROM nation")


@query("seed_table", "SELECT 'tessera' AS database_name, 'the tessera developers' AS author, 'none' AS address, 'a relational analytics engine on Spark' AS description")
def _seed(spark: SparkSession, folder: str) -> DataFrame:
    return t.seed_table(spark)


@query("generated_table", "SELECT 10000 AS n, 0 AS beyond, 3 AS short, 10 AS long")
def _generated(spark: SparkSession, folder: str) -> DataFrame:
    g = t.generated(spark, 10)
    out = g.agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum((~F.col("colA").between(0, 9999) | ~F.col("colB").between(0, 9999)).cast("int")).cast("int").alias("beyond"), F.max(F.length("colC")).alias("short"), F.min(F.length("colE")).alias("long"))
    return out


@query("smoke", None)
def _smoke(spark: SparkSession, folder: str) -> DataFrame:
    return Engine(spark).smoke()


@query("explain", None)
def _explain(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["nation"])
    return Engine(spark).sql("EXPLAIN SELECT n_name FROM nation WHERE n_nationkey > 3")


@query("show_tables", None)
def _tables(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["nation", "region"])
    return Engine(spark).tables()


def plain(name: str, sql: str, tables: str, oracle: str | None = None) -> None:
    """A query in standard SQL text, without the dialect."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t.register(spark, folder, tables.split())
        return Engine(spark, dialect=False).sql(sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


# The dialect where no table is read, and inside of other expressions.
text("select_no_from", "SELECT 1 AS a, 'x' AS b", "nation")
text("having_or_empty", "SELECT max(n_nationkey) AS m FROM nation WHERE n_nationkey > 99 HAVING count(n_nationkey) IN (0) OR max(n_nationkey) IS NULL", "nation",
     "SELECT n_nationkey AS m FROM nation WHERE false")
text("global_coalesce_empty", "SELECT coalesce(sum(n_nationkey), 0) AS m FROM nation WHERE n_nationkey > 99", "nation", "SELECT n_nationkey AS m FROM nation WHERE false")
_WRAP = "((p_size::BIGINT + 2147483647 + 2147483648) % 4294967296 - 2147483648)::INT"
text("case_wrap", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 2147483647 ELSE 0 END AS w FROM part", "part",
     f"SELECT p_partkey, CASE WHEN p_size > 25 THEN {_WRAP} ELSE 0 END AS w FROM part")
text("func_wrap", "SELECT p_partkey, abs(p_size + 2147483647) AS w FROM part WHERE p_size BETWEEN 2 AND 30 AND p_size + 2147483647 < 0", "part",
     f"SELECT p_partkey, abs({_WRAP}) AS w FROM part WHERE p_size BETWEEN 2 AND 30")
text("mul_wrap", "SELECT p_partkey, p_size * 1000000007 AS w FROM part", "part", "SELECT p_partkey, ((p_size::BIGINT * 1000000007 + 2147483648) % 4294967296 - 2147483648)::INT AS w FROM part")
text("quoted_ident", 'SELECT "n_name" AS "the name" FROM nation WHERE "n_nationkey" < 5', "nation")
text("unary_minus", "SELECT n_nationkey, -n_regionkey AS m FROM nation", "nation")
text("agg_sum_distinct", "SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "lineitem", "SELECT l_returnflag, sum(DISTINCT l_linenumber)::INT AS s FROM lineitem GROUP BY l_returnflag")

# Standard SQL as it is.
plain("window_rank", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer", "customer", "SELECT c_custkey, c_nationkey, (rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))::INT AS r FROM customer")
plain("window_running", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders", "orders")
plain("cte", "WITH w AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT n_name, n FROM w JOIN nation ON k = n_nationkey WHERE n > 50", "customer nation")
plain("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) + 1", "customer")
plain("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", "orders customer")
plain("correlated_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)", "nation supplier")
plain("case_cast_coalesce", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'small' END AS c, CAST(p_size AS BIGINT) AS b, COALESCE(NULLIF(p_size, 7), -1) AS d FROM part", "part")
plain("is_null", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_suppkey < 20 WHERE s_suppkey IS NULL OR s_suppkey IS NOT DISTINCT FROM 7", "nation supplier")
plain("ilike", "SELECT n_name FROM nation WHERE n_name ILIKE '%an%'", "nation")
plain("cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation region")
plain("comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", "nation region")
plain("join_using", "SELECT k, a.n_name AS x, b.c_custkey AS y FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b USING (k)", "nation customer")
plain("join_natural", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", "nation region")
plain("join_anti_rows", "SELECT n_nationkey FROM nation LEFT ANTI JOIN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 15) s ON n_nationkey = s_nationkey", "nation supplier", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey < 15 AND s_nationkey = n_nationkey)")
plain("join_lateral", "SELECT n_name, m FROM nation, LATERAL (SELECT max(s_acctbal) AS m FROM supplier WHERE s_nationkey = n_nationkey) l", "nation supplier")
plain("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
plain("grouping_sets_list", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
plain("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer supplier")
plain("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer supplier")
plain("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "customer supplier")
plain("nulls_last", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_suppkey < 10 ORDER BY s_suppkey DESC NULLS LAST, n_nationkey LIMIT 15", "nation supplier")
plain("order_by_position", "SELECT c_custkey, c_nationkey FROM customer ORDER BY 2 DESC, 1 LIMIT 30", "customer")
plain("div_mod", "SELECT p_partkey, p_size % 7 AS m, p_size * 3 AS t, p_size / 4 AS q FROM part", "part")
plain("string_functions", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, substring(n_name, 2, 3) AS s, length(n_name) AS n, replace(n_name, 'A', 'b') AS r, concat(n_name, '-', n_name) AS c FROM nation", "nation",
      "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, substring(n_name, 2, 3) AS s, length(n_name)::INT AS n, replace(n_name, 'A', 'b') AS r, concat(n_name, '-', n_name) AS c FROM nation")
plain("agg_median", "SELECT o_orderstatus, percentile(o_custkey, 0.5) AS m FROM orders GROUP BY o_orderstatus", "orders", "SELECT o_orderstatus, quantile_cont(o_custkey, 0.5)::DOUBLE AS m FROM orders GROUP BY o_orderstatus")
plain("null_forms", "SELECT p_partkey, NULLIF(p_size, 7) AS a, COALESCE(NULLIF(p_size, 7), 0) AS b, NULLIF(p_size, 7) IS DISTINCT FROM 8 AS c FROM part", "part")
plain("agg_stddev", "SELECT o_orderstatus, stddev_pop(o_custkey) AS s, var_samp(o_custkey) AS v FROM orders GROUP BY o_orderstatus", "orders")
plain("agg_ordered", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "nation",
      "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
plain("pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "orders",
      "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY o_orderpriority")
plain("table_function", "SELECT id, n_name FROM range(3, 20) JOIN nation ON id = n_nationkey", "nation", "SELECT n_nationkey::BIGINT AS id, n_name FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 20")
plain("values_text", "SELECT a, b, n_name FROM VALUES (1, 'x'), (2, NULL) AS v(a, b) JOIN nation ON a = n_nationkey", "nation", "SELECT a, b, n_name FROM (VALUES (1, 'x'), (2, NULL)) v(a, b) JOIN nation ON a = n_nationkey")


@query("parameters", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100")
def parameters(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["customer"])
    return Engine(spark).sql("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = :nation AND c_acctbal > :least", {"nation": 3, "least": 100})


@query("view_and_drop", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def view_and_drop(spark: SparkSession, folder: str) -> DataFrame:
    t.register(spark, folder, ["nation"])
    engine = Engine(spark)
    engine.sql("CREATE OR REPLACE TEMPORARY VIEW tessera_view AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    out = engine.sql("SELECT n_nationkey, n_name FROM tessera_view")
    engine.sql("DROP VIEW tessera_view")
    return out


FLAGSHIP = """
SELECT f.n_name, f.seg, f.s, f.n FROM (
  SELECT b.n_name AS n_name, b.seg AS seg, sum(a.pri + 1) AS s, count(a.ok) AS n
  FROM (SELECT o_orderkey AS ok, o_custkey AS ck, {bytes}(o_orderpriority) AS pri FROM orders WHERE o_orderkey > 10) a
  INNER JOIN (SELECT c_custkey AS ck, n_name AS n_name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > 10) b ON a.ck = b.ck
  GROUP BY b.n_name, b.seg HAVING count(a.ok) > 1) f
ORDER BY f.s + 1 DESC, f.n_name, f.seg LIMIT 20
"""

text("flagship", FLAGSHIP.format(bytes="octet_length"), "orders customer nation", f"SELECT n_name, seg, s::INT AS s, n::INT AS n FROM ({FLAGSHIP.format(bytes='strlen')})")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["flagship"](spark, folder)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
