"""The engine: statements in SQL text, catalog and result text over one Spark session."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect, statements
from ..sources import tables
from . import render

SMOKE = """
SELECT q.sa, q.cb FROM (
  SELECT sum(a.colA + 1) AS sa, avg(a.colB + 1) AS cb, avg(a.colC) AS cc, min(b.colA) AS ma, max(b.colC) AS mc, sum(b.colD) AS sd
  FROM (SELECT colA AS colA, colB AS colB, colC AS colC, colD AS colD FROM random10 WHERE colA > 10) a
  INNER JOIN (SELECT colA AS colA, colB AS colB, colC AS colC, colD AS colD FROM random11 WHERE colA > 10) b ON a.colA = b.colA
  GROUP BY a.colA, a.colB, b.colC, b.colD HAVING sum(b.colA) > 1 ORDER BY sum(a.colA + 1) + 1
) q LIMIT 1
"""


class Engine:
    """``dialect=True`` reads SQL text in the dialect of ``functions.dialect``; otherwise it is Spark SQL as it is."""

    def __init__(self, spark: SparkSession, dialect: bool = True) -> None:
        self.spark = spark
        self.dialect = Dialect(self._schema) if dialect else None

    def _schema(self, source: str) -> list[tuple[str, str]]:
        df = self.spark.sql(f"SELECT * FROM {source}")
        plan = df._jdf.queryExecution().analyzed().output()
        out = []
        for i, (name, kind) in enumerate(df.dtypes):
            q = plan.apply(i).qualifier()
            out.append((f"{q.apply(q.size() - 1)}.{name}" if q.size() else name, kind))
        return out

    def _translated(self, sql: str) -> str:
        return self.dialect.translate(sql) if self.dialect else sql

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Run the statements in turn; the result of the last one. ``args`` are the values of its parameters (:name or ?)."""
        result = None
        for one in statements(text):
            result = self.spark.sql(one, args=args) if args else self._statement(one)
        if result is None:
            raise ValueError("no statement")
        return result

    def _statement(self, sql: str) -> DataFrame:
        if m := re.match(r"(?is)\s*create\s+table\s+(\S+?)\s*(\(.*\))\s*$", sql):
            self.spark.sql(f"CREATE TABLE {m[1]} {m[2]} USING parquet")
            return tables.values(self.spark, [(1,)], ["created"])
        if m := re.match(r"(?is)\s*insert\s+into\s+([\w.`]+)\s*(\((?!\s*select\b)[^)]*\))?\s*(values\b.*|select\b.*)$", sql):
            return self.insert(m[1], m[3], m[2] or "")
        if m := re.match(r"(?is)\s*explain\s+(?:analyze\s+|verbose\s+)?(.*)$", sql):
            return tables.values(self.spark, [(self.explain(m[1]),)], ["plan"])
        return self.spark.sql(self._translated(sql))

    def insert(self, table: str, source: str, columns: str = "") -> DataFrame:
        """Append rows by position, or to the columns named; one row with their number. Rows are read and written once."""
        table_rows = self.spark.table(table)
        rows = self.spark.sql(self._translated(source)) if source.lower().startswith("select") else self.spark.sql(source)
        names = [c.strip(" ()`").lower() for c in columns.split(",")] if columns else [c.lower() for c in table_rows.columns]
        if len(names) != len(rows.columns):
            raise ValueError(f"{table} takes {len(names)} columns, not {len(rows.columns)}")
        kinds = {f.name.lower(): f.dataType for f in table_rows.schema.fields}
        for n, f in zip(names, rows.schema.fields, strict=True):
            if n not in kinds:
                raise ValueError(f"{table} has no column {n}")
            if (kinds[n].typeName() == "string") != (f.dataType.typeName() in ("string", "void", "varchar")) and f.dataType.typeName() != "void":
                raise TypeError(f"column {n} of {table} is {kinds[n].simpleString()}, not {f.dataType.simpleString()}")
        seen = F.count(F.lit(1)).alias("n")
        from pyspark.sql import Observation

        observed = Observation()
        rows = rows.observe(observed, seen)
        # widths of whole numbers are checked on writing: a value beyond the column is an error, not a wrap
        by_name = dict(zip(names, rows.columns, strict=True))
        rows = rows.toDF(*names).select(*[F.col(c.lower()).cast(kinds[c.lower()]).alias(c) if c.lower() in by_name else F.lit(None).cast(kinds[c.lower()]).alias(c) for c in table_rows.columns])
        rows.write.insertInto(table)
        return tables.values(self.spark, [(int(observed.get["n"]),)], ["inserted"])

    def explain(self, sql: str) -> str:
        """Logical, optimised and physical plan; nothing runs, statements that write included."""
        if not re.match(r"(?is)\s*(select|with|values|from)\b", sql):
            return self.spark.sql(f"EXPLAIN EXTENDED {sql}").first()[0]
        plan = self.spark.sql(self._translated(sql))._jdf.queryExecution()
        return "\n".join(["==== Logical ====", plan.analyzed().toString(), "==== Optimized ====", plan.optimizedPlan().toString(), "==== Physical ====", plan.executedPlan().toString()])

    def create_from(self, name: str, df: DataFrame) -> None:
        df.write.saveAsTable(name, format="parquet")

    def generate(self, thousands: int, seed: int = 0) -> str:
        """A view ``random<N>`` of generated rows."""
        tables.generated(self.spark, thousands, seed).createOrReplaceTempView(name := f"random{thousands}")
        return name

    def seed(self) -> None:
        tables.seed_table(self.spark).createOrReplaceTempView("database_info")

    def smoke(self) -> DataFrame:
        """The built-in check: generated tables, joined, aggregated, sorted, cut to a row."""
        self.generate(10)
        self.generate(11)
        return self.sql(SMOKE)

    def tables(self) -> DataFrame:
        """A row for each column of each table or view: number, table, rows, column, type, length."""
        rows = []
        for number, t in enumerate(sorted(self.spark.catalog.listTables(), key=lambda t: t.name)):
            df = self.spark.table(t.name)
            n = df.count()
            for f in df.schema.fields:
                declared = re.search(r"char\((\d+)\)", str(f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")))
                rows.append((number, t.name, n, f.name, f.dataType.simpleString(), int(declared[1]) if declared else None))
        return self.spark.createDataFrame(rows, "number int, table string, rows long, column string, type string, length int")

    def show_tables(self) -> str:
        by: dict = {}
        for r in self.tables().collect():
            by.setdefault((r.number, r.table, r.rows), []).append((r.column, r.type, r.length))
        return render.table_list([(*k, v) for k, v in by.items()])

    def profile(self, sql: str) -> list[tuple[int, str, dict[str, int]]]:
        """Runs a query and reads what its operators counted: (depth, operator, metrics), from the top of the plan that ran."""
        run = self.sql(sql)._jdf.queryExecution()
        run.toRdd().count()
        return list(_operators(run.executedPlan(), 0))

    def show(self, sql: str) -> str:
        """Run, collect and render; the time is that of planning and running."""
        began = time.perf_counter()
        df = self.sql(sql)
        rows = df.collect()
        return render.grid(df.columns, rows, time.perf_counter() - began, max(1, -(-len(rows) // 4096)))


def _operators(node, depth: int) -> Iterator[tuple[int, str, dict[str, int]]]:
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _operators(node.executedPlan(), depth)
    elif kind.endswith("QueryStageExec"):
        yield from _operators(node.plan(), depth)
    else:
        counted, names = node.metrics(), node.metrics().keys().toSeq()
        yield depth, node.nodeName(), {names.apply(i): counted.apply(names.apply(i)).value() for i in range(names.size())}
        children = node.children()
        for i in range(children.size()):
            yield from _operators(children.apply(i), depth + 1)
