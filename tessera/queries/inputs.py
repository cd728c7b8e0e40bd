"""Vectors and matrices of the shared tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import rounded
from tessera.plans.matrix import Matrix
from tessera.plans.vector import Vector

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, run: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there twice")
        self.queries[name] = run
        if sql is not None:
            self.sql[name] = sql if not WITH_OF(sql) else f"WITH {', '.join(WITH_OF(sql))} {sql}"

    def query(self, name: str, sql: str | None = None):
        def take(run: Query) -> Query:
            self.add(name, run, sql)
            return run

        return take


SIZES: dict[tuple[str, ...], int] = {}


class Tables:
    """The vectors and matrices that queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def size(self, table: str, key: str) -> int:
        """One more than the greatest key; looked up once a session, key and list of files."""
        at = (self.spark.sparkContext.applicationId, key, *sorted(self.table(table).inputFiles()))
        if at not in SIZES:
            found = self.table(table).agg(F.max(key)).first()[0]
            SIZES[at] = 0 if found is None else found + 1
        return SIZES[at]

    @property
    def x(self) -> Vector:
        """Dense: the total price of each order."""
        return Vector.of(self.table("orders"), "o_orderkey", "o_totalprice", self.size("orders", "o_orderkey"))

    @property
    def t(self) -> Vector:
        """Dense: the total price of each order in 99991.7 (so that no value has few digits), less 2.5."""
        return Vector.of(self.table("orders"), "o_orderkey", F.col("o_totalprice") / 99991.7 - 2.5, self.size("orders", "o_orderkey"))

    @property
    def y(self) -> Vector:
        """Sparse: the quantity of each order's lines."""
        return Vector.combined(self.table("lineitem"), "l_orderkey", "l_quantity", self.size("orders", "o_orderkey"))

    @property
    def z(self) -> Vector:
        """Sparse: the number of lines of each order that were returned."""
        return Vector.combined(self.table("lineitem").filter("l_returnflag = 'R'").withColumn("one", F.lit(1.0)), "l_orderkey", "one", self.size("orders", "o_orderkey"))

    @property
    def p(self) -> Vector:
        """Dense: the retail price of each part."""
        return Vector.of(self.table("part"), "p_partkey", "p_retailprice", self.size("part", "p_partkey"))

    @property
    def b(self) -> Vector:
        """Dense: the balance of each customer."""
        return Vector.of(self.table("customer"), "c_custkey", "c_acctbal", self.size("customer", "c_custkey"))

    @property
    def a(self) -> Matrix:
        """orders x parts: quantities, lines of the same part added up."""
        return Matrix.combined(self.table("lineitem"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity"), self.size("orders", "o_orderkey"), self.size("part", "p_partkey"))

    @property
    def s(self) -> Matrix:
        """parts x suppliers: quantities."""
        return Matrix.combined(self.table("lineitem"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), self.size("part", "p_partkey"), self.size("supplier", "s_suppkey"))

    @property
    def d(self) -> Matrix:
        """parts x suppliers: discounts."""
        return Matrix.combined(self.table("lineitem").filter("l_discount > 0.05"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_discount"), self.size("part", "p_partkey"), self.size("supplier", "s_suppkey"))

    @property
    def c(self) -> Matrix:
        """nations x nations: price of what customers of one got from suppliers of the other, in 1e6."""
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        n = self.size("nation", "n_nationkey")
        return Matrix.combined(rows, F.col("c_nationkey"), F.col("s_nationkey"), F.col("l_extendedprice") / 1e6, n, n)

    @property
    def spd(self) -> Matrix:
        """nations x nations: symmetric and positive definite; -1 where nations are neighbours in number or of one region, a dominant diagonal."""
        return Matrix(self._spd(0.0), self.size("nation", "n_nationkey"), self.size("nation", "n_nationkey"))

    @property
    def gen(self) -> Matrix:
        """As spd, but not symmetric."""
        return Matrix(self._spd(0.5), self.size("nation", "n_nationkey"), self.size("nation", "n_nationkey"))

    def _spd(self, skew: float) -> DataFrame:
        nation = self.table("nation")
        left = nation.select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").alias("r"))
        right = nation.select(F.col("n_nationkey").cast("long").alias("j"), F.col("n_regionkey").alias("r"))
        same = left.join(right, "r").filter("i != j").select("i", "j")
        near = left.select("i", F.explode(F.array(F.col("i") - 1, F.col("i") + 1)).alias("j")).join(right.select("j"), "j").select("i", "j")
        off = same.unionByName(near).distinct().withColumn("v", F.lit(-1.0) - F.when(F.col("j") > F.col("i"), F.lit(skew)).otherwise(F.lit(0.0)))
        return off.unionByName(left.select("i", F.col("i").alias("j"), (F.col("i") % 3 + 20.0).alias("v")))

    @property
    def known(self) -> Vector:
        """The solution that the systems are made of: 1, 2, 3, 1, ..."""
        return Vector.of(self.table("nation"), "n_nationkey", F.col("n_nationkey") % 3 + 1, self.size("nation", "n_nationkey"))

    def _followed(self, key: str = "l_partkey") -> DataFrame:
        """(i, j, w): how often lines of the parts (or other keys) i and j follow one another in an order, in either order."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", F.col(key).cast("long").alias("key"))
        then = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("key").alias("next"))
        pairs = lines.join(then, ["l_orderkey", "l_linenumber"]).filter("key != next")
        once = pairs.groupBy(F.least("key", "next").alias("i"), F.greatest("key", "next").alias("j")).agg(F.count("*").cast("double").alias("w"))
        return once.select(F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "w").select("e.i", "e.j", "w")

    @property
    def near(self) -> Matrix:
        """parts x parts: the graph of lines that follow one another, each weight divided by the roots of both degrees; its greatest eigenvalue is 1."""
        w = self._followed()
        degree = w.groupBy("i").agg(F.sum("w").alias("d"))
        rows = w.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j")
        n = self.size("part", "p_partkey")
        return Matrix(rows.select("i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("v")), n, n)

    def _parts_system(self, skew: float) -> Matrix:
        near = self.near
        off = near.df.select("i", "j", (-F.col("v") * F.when(F.col("j") > F.col("i"), F.lit(1 + skew)).otherwise(F.lit(1.0))).alias("v"))
        every = self.table("part").select(F.col("p_partkey").cast("long").alias("i"), F.col("p_partkey").cast("long").alias("j"), F.lit(3.0).alias("v"))
        return Matrix(off.unionByName(every), near.n, near.n)

    @property
    def system(self) -> Matrix:
        """parts x parts: 3 on the diagonal, less near; symmetric, with eigenvalues from 2 to 4."""
        return self._parts_system(0.0)

    @property
    def skew_system(self) -> Matrix:
        """As system, but not symmetric."""
        return self._parts_system(0.5)

    @property
    def supplier_system(self) -> Matrix:
        """suppliers x suppliers: -1 for each pair of a line and the next one of its order, and a dominant diagonal; symmetric."""
        w = self._followed("l_suppkey")
        degree = w.groupBy("i").agg(F.sum("w").alias("d"))
        n = self.size("supplier", "s_suppkey")
        own = self.table("supplier").select(F.col("s_suppkey").cast("long").alias("i")).join(degree, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("d", F.lit(0.0)) + 1.0).alias("v"))
        return Matrix(w.select("i", "j", (-F.col("w")).alias("v")).unionByName(own), n, n)

    @property
    def answer(self) -> Vector:
        """The solution that the systems over parts are made of."""
        return Vector.of(self.table("part"), "p_partkey", F.col("p_partkey") % 3 + 1, self.size("part", "p_partkey"))


SQL = {
    "x": "x AS (SELECT o_orderkey AS i, o_totalprice AS v FROM orders)",
    "t": "t AS (SELECT o_orderkey AS i, o_totalprice / 99991.7 - 2.5 AS v FROM orders)",
    "y": "y AS (SELECT l_orderkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1)",
    "yd": "yd AS (SELECT o_orderkey AS i, coalesce(sum(l_quantity), 0) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)",
    "z": "z AS (SELECT l_orderkey AS i, count(*)::DOUBLE AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)",
    "p": "p AS (SELECT p_partkey AS i, p_retailprice AS v FROM part)",
    "b": "b AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer)",
    "a": "a AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "s": "s AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "d": "d AS (SELECT l_partkey AS i, l_suppkey AS j, sum(l_discount) AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2)",
    "c": "c AS (SELECT c_nationkey::BIGINT AS i, s_nationkey::BIGINT AS j, sum(l_extendedprice / 1e6) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)",
    "spd": "spd AS (SELECT l.n_nationkey::BIGINT AS i, r.n_nationkey::BIGINT AS j, CASE WHEN l.n_nationkey = r.n_nationkey THEN l.n_nationkey % 3 + 20.0 ELSE -1.0 END AS v FROM nation l JOIN nation r ON l.n_regionkey = r.n_regionkey OR abs(l.n_nationkey - r.n_nationkey) <= 1)",
    "followed": "followed AS (SELECT i, j, count(*)::DOUBLE AS w FROM (SELECT unnest([a.l_partkey, b.l_partkey]) AS i, unnest([b.l_partkey, a.l_partkey]) AS j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey <> b.l_partkey) GROUP BY 1, 2)",
    "degree": "degree AS (SELECT i, sum(w) AS d FROM followed GROUP BY 1)",
    "near": "near AS (SELECT f.i, f.j, f.w / sqrt(p.d * q.d) AS v FROM followed f JOIN degree p ON f.i = p.i JOIN degree q ON f.j = q.i)",
    "answer": "answer AS (SELECT p_partkey AS i, (p_partkey % 3 + 1)::DOUBLE AS v FROM part)",
    "known": "known AS (SELECT n_nationkey::BIGINT AS i, (n_nationkey % 3 + 1)::DOUBLE AS v FROM nation)",
}


def WITH_OF(sql: str) -> list[str]:  # noqa: N802
    """The common tables that a statement names as {x}, {a}, ...; each is put before it."""
    import re

    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return []
    needs = {"near": ("followed", "degree"), "degree": ("followed",)}
    named = {k for k in SQL if re.search(rf"\b(FROM|JOIN|,)\s+{k}\b", sql)}
    named |= {n for k in named for n in needs.get(k, ())}
    return [SQL[k] for k in SQL if k in named]


def vector_out(v: Vector, digits: int = 4) -> DataFrame:
    return v.df.select("i", rounded("v", digits).alias("v"))


def matrix_out(m: Matrix, digits: int = 4) -> DataFrame:
    return m.df.select("i", "j", rounded("v", digits).alias("v"))


def value_out(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(rounded("v", digits).alias("v"))
