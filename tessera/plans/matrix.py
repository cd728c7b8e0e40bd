"""Matrices as tables (i, j, v) of stored entries; all others are 0."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import BINARY, NEUTRAL, UNARY, aggregate
from tessera.plans import products
from tessera.plans.notation import MatrixNotation
from tessera.plans.storage import BROADCAST_ROWS, shuffled
from tessera.plans.vector import Vector


#: Entries of a column, or of a row, from which on it is worth dealing over several tasks in a product.
HOT_INNER = 1 << 16
#: Inner indexes whose products one task makes.
REGION = 1 << 14


def _gathered(df: DataFrame, by: str, chunk: str, to: str, hot: int) -> DataFrame:
    """(k, chunk, to): the entries of each k as arrays of about hot entries."""
    shares = df.groupBy("k").agg(F.ceil(F.count("*") / hot).cast("int").alias("n")).filter("n > 1")
    at = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("n")).cast("int")).alias(chunk)
    entry = F.struct(*[c for c in df.columns if c != "k"]).alias("e")
    return df.join(shares, "k", "left").select("k", at, entry).groupBy("k", chunk).agg(F.collect_list("e").alias(to))


def paired(left: DataFrame, right: DataFrame, inner: int, hot: int = HOT_INNER) -> DataFrame:
    """Each entry (i, k, ...) of left with each (k, j, ...) of right of the same inner index, for sums by i and j.

    The entries of an index go to the task of its region as two arrays and become pairs there, so that
    sums are begun over all products of a region before they are shuffled. An index with more than hot entries on
    either side is dealt over several tasks, array by array.
    """
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), inner // REGION)
    step = max(1, -(-inner // tasks))
    both = _gathered(left, "i", "part", "ls", hot).join(_gathered(right, "j", "share", "rs", hot).hint("merge"), "k")
    dealt = both.repartition(tasks, F.expr(f"k div {step}"), "part", "share")
    return dealt.select(F.explode("ls").alias("l"), "rs").select("l", F.explode("rs").alias("r")).select("l.*", "r.*")


@dataclass(frozen=True)
class Matrix(MatrixNotation):
    """df (i long, j long, v double) with unique (i, j), 0 <= i < n, 0 <= j < m."""

    df: DataFrame
    n: int
    m: int

    # -- making

    @classmethod
    def combined(cls, df: DataFrame, i: Column, j: Column, v: Column, n: int, m: int, op: str = "add") -> "Matrix":
        """A matrix of triples in which places may repeat; repeats are combined by op."""
        rows = df.select(i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v"))
        return cls(rows.groupBy("i", "j").agg(aggregate(op, F.col("v")).alias("v")), n, m)

    @classmethod
    def identity(cls, spark: SparkSession, n: int) -> "Matrix":
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)

    @classmethod
    def diagonal_of(cls, d: Vector) -> "Matrix":
        return cls(d.df.select("i", F.col("i").alias("j"), "v"), d.n, d.n)

    @classmethod
    def empty(cls, spark: SparkSession, n: int, m: int) -> "Matrix":
        return cls(spark.range(0).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v")), n, m)

    # -- elementwise

    def _with(self, v: Column) -> "Matrix":
        return replace(self, df=self.df.select("i", "j", v.alias("v")))

    def unary(self, op: str) -> "Matrix":
        return self._with(UNARY[op](F.col("v")))

    def scale(self, s: float) -> "Matrix":
        return self._with(F.col("v") * F.lit(float(s)))

    def scalar(self, op: str, s: float) -> "Matrix":
        return self._with(BINARY[op](F.col("v"), F.lit(float(s))))

    def binary(self, op: str, other: "Matrix") -> "Matrix":
        """op on the union of the stored places."""
        x, y = self.df.withColumnRenamed("v", "x"), other.df.withColumnRenamed("v", "y")
        zero = F.lit(0.0)
        rows = x.join(y, ["i", "j"], "full").select("i", "j", BINARY[op](F.coalesce("x", zero), F.coalesce("y", zero)).alias("v"))
        return replace(self, df=rows)

    def plus(self, other: "Matrix", a: float = 1.0, b: float = 1.0) -> "Matrix":
        """a * self + b * other, in one shuffle; a factor of 0 drops its matrix."""
        if a == 0 or b == 0:
            return other.scale(b) if a == 0 else self.scale(a)
        rows = self.scale(a).df.unionByName(other.scale(b).df)
        return replace(self, df=rows.groupBy("i", "j").agg(F.sum("v").alias("v")))

    def transpose(self) -> "Matrix":
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.m, self.n)

    def compress(self, eps: float = 0.0) -> "Matrix":
        return replace(self, df=self.df.filter(F.abs("v") > eps))

    # -- products

    def times(self, x: Vector, a: float = 1.0, y: Vector | None = None, b: float = 0.0, transposed: bool = False) -> Vector:
        """a * A x + b * y as a dense vector (rows without entries give b * y); a = 0 or b = 0 drops its term."""
        row, col, n = ("j", "i", self.m) if transposed else ("i", "j", self.n)
        base = self.df.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(0.0).alias("v")) if y is None or b == 0 else y.to_dense().scalar("mult", b).df if not y.dense else y.scalar("mult", b).df
        if a == 0:
            return Vector(base, n)
        if not x.dense and x.zero != 0:
            x = x.to_dense()
        entries = self.df.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col("v").alias("e"))
        products = entries.join(shuffled(x.df.select(F.col("i").alias("c"), F.col("v").alias("x")), x.n), "c").select(F.col("r").alias("i"), (F.lit(float(a)) * F.col("e") * F.col("x")).alias("v"))
        return Vector(products.unionByName(base).groupBy("i").agg(F.sum("v").alias("v")), n)

    def matmul(self, other: "Matrix", a: float = 1.0, c: "Matrix | None" = None, b: float = 0.0, hot: int | None = HOT_INNER) -> "Matrix":
        """a * A B + b * C; places whose products cancel stay stored.

        Products of neighbouring inner indexes are made in one task, see paired() and, for many of them,
        by_regions(); hot=None joins entries as they are, for matrices with few products to a place.
        """
        left = self.df.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        right = other.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        if hot is not None and self.m >= products.LEAST:
            made = products.by_regions(left.withColumnRenamed("x", "v"), right.withColumnRenamed("y", "v"), self.m, products.real, ["v"], hot)
            made = Matrix(made, self.n, other.m) if a == 1 else Matrix(made, self.n, other.m).scale(a)
            return made if c is None or b == 0 else made.plus(c, 1.0, b)
        pairs = left.join(right, "k") if hot is None else paired(left, right, self.m, hot)
        return self._summed(pairs, other.m, a, c, b)

    def _summed(self, pairs: DataFrame, m: int, a: float, c: "Matrix | None", b: float) -> "Matrix":
        rows = pairs.select("i", "j", (F.lit(float(a)) * F.col("x") * F.col("y")).alias("v"))
        if c is not None and b != 0:
            rows = rows.unionByName(c.scale(b).df)
        return Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), self.n, m)

    def times_many(self, others: DataFrame) -> DataFrame:
        """A X for vectors side by side: others and result (i, k, v), k being the vector.

        With many rows it is made of tiles, as each task would else hold sums of all rows and vectors.
        """
        if self.n > BROADCAST_ROWS:
            from tessera.plans.sparse import Held

            return Held.of(self).times_many(others)
        left = self.df.select("i", F.col("j").alias("r"), F.col("v").alias("x"))
        right = others.select(F.col("i").alias("r"), "k", F.col("v").alias("y"))
        return left.join(right, "r").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("v"))

    def gramian_times(self, x: Vector) -> Vector:
        return self.times(self.times(x), transposed=True)

    def scale_rows(self, s: Vector) -> "Matrix":
        rows = self.df.join(s.df.select("i", F.col("v").alias("s")), "i")
        return replace(self, df=rows.select("i", "j", (F.col("v") * F.col("s")).alias("v")))

    def scale_columns(self, s: Vector) -> "Matrix":
        rows = self.df.join(s.df.select(F.col("i").alias("j"), F.col("v").alias("s")), "j")
        return replace(self, df=rows.select("i", "j", (F.col("v") * F.col("s")).alias("v")))

    def jacobi_step(self, x: Vector, b: Vector, omega: float = 1.0) -> Vector:
        """omega * D^-1 (b - (A - D) x) + (1 - omega) * x."""
        off = replace(self, df=self.df.filter("i != j")).times(x, -1.0, b, 1.0)
        d = self.df.filter("i = j").select("i", F.col("v").alias("d"))
        rows = off.df.join(d, "i").join(x.df.select("i", F.col("v").alias("x")), "i")
        return Vector(rows.select("i", (F.lit(omega) * F.col("v") / F.col("d") + F.lit(1 - omega) * F.col("x")).alias("v")), self.n)

    # -- points, rows, columns, diagonal

    def get(self, i: int, j: int) -> DataFrame:
        return self.df.filter((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))

    def put(self, i: int, j: int, value: float, op: str = "copy") -> "Matrix":
        """Changes a stored place; others stay 0."""
        here = (F.col("i") == i) & (F.col("j") == j)
        return self._with(F.when(here, BINARY[op](F.col("v"), F.lit(float(value)))).otherwise(F.col("v")))

    def row(self, i: int) -> Vector:
        return Vector(self.df.filter(F.col("i") == i).select(F.col("j").alias("i"), "v"), self.m, 0.0, False)

    def column(self, j: int) -> Vector:
        return Vector(self.df.filter(F.col("j") == j).select("i", "v"), self.n, 0.0, False)

    def put_row(self, i: int, row: Vector, op: str = "copy") -> "Matrix":
        """Changes the stored places of a row; only that row is joined with the new values."""
        new = row.df.select(F.col("i").alias("j"), F.col("v").alias("y"))
        value = BINARY[op](F.col("v"), F.coalesce("y", F.lit(row.zero)))
        changed = self.df.filter(F.col("i") == i).join(new, "j", "left").select("i", "j", value.alias("v"))
        return replace(self, df=self.df.filter(F.col("i") != i).unionByName(changed))

    def put_column(self, j: int, column: Vector, op: str = "copy") -> "Matrix":
        return self.transpose().put_row(j, column, op).transpose()

    def diagonal(self) -> Vector:
        return Vector(self.df.filter("i = j").select("i", "v"), min(self.n, self.m), 0.0, False)

    def put_diagonal(self, value: "float | Vector") -> "Matrix":
        if isinstance(value, Vector):
            rows = self.df.join(value.df.select("i", F.col("v").alias("y")), "i", "left")
            return replace(self, df=rows.select("i", "j", F.when(F.col("i") == F.col("j"), F.coalesce("y", F.lit(value.zero))).otherwise(F.col("v")).alias("v")))
        return self._with(F.when(F.col("i") == F.col("j"), F.lit(float(value))).otherwise(F.col("v")))

    # -- reductions

    def reduce(self, dim: int, op: str, before: str = "copy", compat: bool = False) -> Vector:
        """Stored entries of each row (dim 0) or column (dim 1) by op, after a unary operation.

        Rows without entries give the neutral value of op; with compat every reduction starts at 0.
        """
        key, n = ("i", self.n) if dim == 0 else ("j", self.m)
        found = self.df.groupBy(F.col(key).alias("i")).agg(aggregate(op, UNARY[before](F.col("v"))).alias("v"))
        start = 0.0 if compat else NEUTRAL[op]
        result = Vector(found, n, start, False).to_dense()
        return result.scalar(op if op != "sub" else "add", 0.0, swap=True) if compat else result

    def l1_norm(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("v"))

    def l2_norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))

    def max_norm(self) -> DataFrame:
        return self.df.agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("v"))

    def max_diff_norm(self, other: "Matrix") -> DataFrame:
        return self.binary("sub", other).max_norm()

    def sparsity(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("nnz"), (F.count("*") / F.lit(float(self.n * self.m))).alias("rate"))

    def row_sizes(self) -> Vector:
        return Vector(self.df.groupBy("i").agg(F.count("*").cast("double").alias("v")), self.n, 0.0, False)

    def per_diagonal(self) -> DataFrame:
        """(d, n, v): number and sum of the entries of each diagonal j - i."""
        return self.df.groupBy((F.col("j") - F.col("i")).alias("d")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))

    def is_symmetric(self) -> DataFrame:
        other = self.transpose().df.withColumnRenamed("v", "y")
        return self.df.join(other, ["i", "j"], "full").agg(F.coalesce(F.bool_and(F.coalesce("v", F.lit(0.0)) == F.coalesce("y", F.lit(0.0))), F.lit(True)).alias("ok"))

    def has_diagonal(self) -> DataFrame:
        return self.df.filter("i = j").agg((F.count("*") == min(self.n, self.m)).alias("ok"))

    def same_pattern(self, other: "Matrix") -> DataFrame:
        rows = self.df.select("i", "j", F.lit(1).alias("x")).join(other.df.select("i", "j", F.lit(1).alias("y")), ["i", "j"], "full")
        return rows.agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("ok"))

    def consistent(self) -> DataFrame:
        c = self.df.groupBy("i", "j").count()
        ok = F.bool_and((F.col("count") == 1) & F.col("i").between(0, self.n - 1) & F.col("j").between(0, self.m - 1))
        return c.agg(F.coalesce(ok, F.lit(True)).alias("ok"))

    # -- composition

    def append_columns(self, other: "Matrix") -> "Matrix":
        return Matrix(self.df.unionByName(other.df.select("i", (F.col("j") + self.m).alias("j"), "v")), self.n, self.m + other.m)

    def append_rows(self, other: "Matrix") -> "Matrix":
        return Matrix(self.df.unionByName(other.df.select((F.col("i") + self.n).alias("i"), "j", "v")), self.n + other.n, self.m)

    def resize(self, n: int, m: int) -> "Matrix":
        return Matrix(self.df.filter((F.col("i") < n) & (F.col("j") < m)), n, m)

    def part(self, i0: int, i1: int, j0: int, j1: int) -> "Matrix":
        rows = self.df.filter(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))
        return Matrix(rows.select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), "v"), i1 - i0, j1 - j0)

    def replicate(self, down: int, across: int) -> "Matrix":
        """A grid of down x across copies; the copies are made per entry, by sequences."""
        rows = self.df.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("p"), "i", "j", "v").select("p", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"), "i", "j", "v")
        return Matrix(rows.select((F.col("i") + F.col("p") * self.n).alias("i"), (F.col("j") + F.col("q") * self.m).alias("j"), "v"), self.n * down, self.m * across)

    def replicate_diagonal(self, k: int) -> "Matrix":
        rows = self.df.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("p"), "i", "j", "v")
        return Matrix(rows.select((F.col("i") + F.col("p") * self.n).alias("i"), (F.col("j") + F.col("p") * self.m).alias("j"), "v"), self.n * k, self.m * k)

    # -- adjacency form

    def offsets(self) -> Vector:
        """n + 1 offsets of the rows in row order."""
        sizes = self.row_sizes().to_dense().resize(self.n + 1)
        return sizes.scan(exclusive=True)

    def adjacency(self) -> DataFrame:
        """(i, js, vs): the entries of each row, in column order."""
        packed = F.array_sort(F.collect_list(F.struct("j", "v")))
        return self.df.groupBy("i").agg(packed.alias("e")).select("i", F.col("e.j").alias("js"), F.col("e.v").alias("vs"))

    @classmethod
    def from_adjacency(cls, df: DataFrame, n: int, m: int) -> "Matrix":
        return cls(df.select("i", F.explode(F.arrays_zip("js", "vs")).alias("e")).select("i", F.col("e.js").alias("j"), F.col("e.vs").alias("v")), n, m)

    def positions(self) -> DataFrame:
        """(i, j, v, p): p numbers the entries of a row in column order."""
        return self.df.withColumn("p", (F.row_number().over(Window.partitionBy("i").orderBy("j")) - 1).cast("long"))

    def edges(self) -> DataFrame:
        """(i, j) of the undirected graph of the pattern, without loops, each edge once."""
        return self.df.filter("i != j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
