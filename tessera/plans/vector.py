"""Vectors as tables (i, v): dense ones have a row for each index, sparse ones an implicit value for the others."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import BINARY, COMPARE, INF, UNARY, aggregate, python_value
from tessera.plans.notation import VectorNotation
from tessera.plans.scan import prefix_sum, ranked
from tessera.plans.storage import shuffled


@dataclass(frozen=True)
class Vector(VectorNotation):
    """df (i long, v double) with unique 0 <= i < n; zero is the value of indexes without a row; dense: there are none."""

    df: DataFrame
    n: int
    zero: float = 0.0
    dense: bool = True

    # -- making

    @classmethod
    def of(cls, df: DataFrame, i: Column | str, v: Column | str, n: int | None = None, zero: float = 0.0, dense: bool = True) -> "Vector":
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        rows = df.select(as_col(i).cast("long").alias("i"), as_col(v).cast("double").alias("v"))
        if n is None:
            n = (rows.agg(F.max("i")).first()[0] if rows.columns else None)
            n = 0 if n is None else n + 1
        return cls(rows, n, zero, dense)

    @classmethod
    def combined(cls, df: DataFrame, i: str, v: str, n: int, op: str = "add", zero: float = 0.0) -> "Vector":
        """A sparse vector of pairs in which indexes may repeat; repeats are combined by op."""
        return cls(df.groupBy(F.col(i).cast("long").alias("i")).agg(aggregate(op, F.col(v).cast("double")).alias("v")), n, zero, False)

    @classmethod
    def fill(cls, spark: SparkSession, n: int, value: float = 0.0) -> "Vector":
        return cls(spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("v")), n)

    @classmethod
    def linear(cls, spark: SparkSession, n: int, start: float = 0.0, step: float = 1.0) -> "Vector":
        return cls.by_function(spark, n, lambda i: F.lit(float(start)) + F.lit(float(step)) * i)

    @classmethod
    def by_function(cls, spark: SparkSession, n: int, f) -> "Vector":
        """Values that a column expression gives for each index."""
        return cls(spark.range(n).select(F.col("id").alias("i"), f(F.col("id")).cast("double").alias("v")), n)

    # -- elementwise

    def _with(self, v: Column, zero: float | None = None) -> "Vector":
        return replace(self, df=self.df.select("i", v.alias("v")), zero=self.zero if zero is None else zero)

    def unary(self, op: str) -> "Vector":
        return self._with(UNARY[op](F.col("v")), self.zero if self.dense else python_value(op, self.zero))

    def scalar(self, op: str, s: float, swap: bool = False) -> "Vector":
        """op(v, s), or op(s, v) with swap."""
        a, b = (F.lit(float(s)), F.col("v")) if swap else (F.col("v"), F.lit(float(s)))
        zero = self.zero if self.dense else python_value(op, *((s, self.zero) if swap else (self.zero, s)))
        return self._with(BINARY[op](a, b), zero)

    def binary(self, op: str, other: "Vector", same_pattern: bool = False) -> "Vector":
        """op(self, other) by index: an inner join of dense vectors, a left join where a zero on the left stays one, else a full join."""
        self._check(other)
        x, y = self.df.select("i", F.col("v").alias("x")), other.df.select("i", F.col("v").alias("y"))
        if (self.dense and other.dense) or same_pattern:
            how = "inner"
        elif self.dense or (op == "mult" and self.zero == 0 and (other.dense or other.zero == 0)):
            how = "left"
        else:
            how = "right" if other.dense else "full"
        a, b = F.coalesce("x", F.lit(self.zero)), F.coalesce("y", F.lit(other.zero))
        rows = x.join(y, "i", how).select("i", BINARY[op](a, b).alias("v"))
        dense = self.dense and other.dense or (how == "left" and self.dense) or how == "right"
        zero = python_value(op, self.zero, other.zero) if not dense and how != "left" else 0.0
        return Vector(rows, self.n, zero, dense)

    def plus(self, other: "Vector", a: float = 1.0, b: float = 1.0) -> "Vector":
        """a * self + b * other; a factor of 0 drops its vector, whatever it holds."""
        if b == 0:
            return self.scalar("mult", a) if a != 0 else self.scaled_to_zero()
        if a == 0:
            return other.scalar("mult", b)
        left = self if a == 1 else self.scalar("mult", a)
        return left.binary("add", other if b == 1 else other.scalar("mult", b))

    def scaled_to_zero(self) -> "Vector":
        return replace(self._with(F.lit(0.0)), zero=0.0)

    def times_plus(self, a: float, s: float) -> "Vector":
        return self._with(F.col("v") * F.lit(float(a)) + F.lit(float(s)), a * self.zero + s)

    def cast(self, kind: str) -> "Vector":
        return self._with(F.col("v").cast(kind).cast("double"))

    # -- points and sections

    def get(self, i: int) -> DataFrame:
        """(v) of one index."""
        found = self.df.filter(F.col("i") == i)
        return found.agg(F.coalesce(F.max("v"), F.lit(self.zero)).alias("v"))

    def put(self, i: int, value: float, op: str = "copy") -> "Vector":
        if self.dense:
            return self._with(F.when(F.col("i") == i, BINARY[op](F.col("v"), F.lit(float(value)))).otherwise(F.col("v")))
        one = self.df.sparkSession.range(i, i + 1).select(F.col("id").alias("i"), F.lit(float(value)).alias("y"))
        rows = self.df.join(F.broadcast(one), "i", "full")
        old = F.coalesce("v", F.lit(self.zero))
        return replace(self, df=rows.select("i", F.when(F.col("y").isNull(), F.col("v")).otherwise(BINARY[op](old, F.col("y"))).alias("v")))

    def section(self, offset: int, stride: int, n: int) -> "Vector":
        """The n values at offset, offset + stride, ..."""
        at = F.col("i") - offset
        rows = self.df.filter((at >= 0) & (at < n * stride) & (at % stride == 0)).select((at / stride).cast("long").alias("i"), "v")
        return replace(self, df=rows, n=n)

    def put_section(self, offset: int, stride: int, other: "Vector", op: str = "copy") -> "Vector":
        """op(self, other) at offset, offset + stride, ...; what other doesn't store is its implicit value."""
        moved = (other if other.dense else other.to_dense()).df.select((F.col("i") * stride + offset).alias("i"), F.col("v").alias("y"))
        return self._written(moved, op)

    def _written(self, values: DataFrame, op: str) -> "Vector":
        """op with values (i, y) at their places; places that a sparse vector doesn't store have its implicit value before."""
        rows = self.df.join(values, "i", "left" if self.dense else "full")
        old = F.col("v") if self.dense else F.coalesce("v", F.lit(self.zero))
        return replace(self, df=rows.select("i", F.when(F.col("y").isNull(), F.col("v")).otherwise(BINARY[op](old, F.col("y"))).alias("v")))

    def resize(self, n: int) -> "Vector":
        """Indexes from n on are dropped; new ones have the implicit value."""
        kept = replace(self, df=self.df.filter(F.col("i") < n), n=n)
        if not self.dense or n <= self.n:
            return kept
        return replace(kept, dense=False).to_dense()

    # -- forms

    def to_dense(self) -> "Vector":
        every = self.df.sparkSession.range(self.n).select(F.col("id").alias("i"))
        return Vector(every.join(shuffled(self.df, self.n), "i", "left").select("i", F.coalesce("v", F.lit(self.zero)).alias("v")), self.n)

    def to_sparse(self, zero: float = 0.0, eps: float = 1e-9) -> "Vector":
        """Only the values that are further than eps from zero."""
        return Vector(self.df.filter(F.abs(F.col("v") - zero) > eps), self.n, zero, False)

    # -- reductions; each gives a DataFrame of one row

    def _implicit(self) -> Column:
        return F.lit(self.n) - F.count("v")

    def reduce(self, op: str, before: str = "copy", name: str = "v") -> DataFrame:
        """All values by op, after a unary operation; implicit values take part."""
        x = UNARY[before](F.col("v"))
        found = aggregate(op, x)
        if op in ("add", "sub"):
            found = F.coalesce(found, F.lit(0.0))
        z = self.zero if self.dense else python_value(before, self.zero)
        if not self.dense:
            more = self._implicit()
            if op in ("add", "sub"):
                found = found + more * F.lit(z)
            elif op in ("mult", "divide"):
                found = F.coalesce(found, F.lit(1.0)) * F.pow(F.lit(z), more)
            else:
                pick = {"min": F.least, "max": F.greatest, "abs_max": F.greatest}[op]
                zz = abs(z) if op == "abs_max" else z
                found = F.when(more > 0, F.coalesce(pick(found, F.lit(zz)), F.lit(zz))).otherwise(found)
        default = {"min": INF, "max": -INF, "abs_max": 0.0, "mult": 1.0, "divide": 1.0}.get(op, 0.0)
        return self.df.agg(F.coalesce(found, F.lit(default)).alias(name))

    def sum(self) -> DataFrame:
        return self.reduce("add")

    def l1_norm(self) -> DataFrame:
        return self.reduce("add", "abs")

    def l2_norm(self) -> DataFrame:
        return self.reduce("add", "sqr").select(F.sqrt("v").alias("v"))

    def max_norm(self) -> DataFrame:
        return self.reduce("abs_max")

    def max_diff_norm(self, other: "Vector") -> DataFrame:
        return self.binary("sub", other).max_norm()

    def dot(self, other: "Vector") -> DataFrame:
        return self.binary("mult", other).reduce("add")

    def reduce2(self, other: "Vector", binary: str, op: str) -> DataFrame:
        return self.binary(binary, other).reduce(op)

    def argmax_abs(self) -> DataFrame:
        """(i, v): where the absolute value is greatest, the first of equals."""
        return self.df.agg(F.max_by("i", F.struct(F.abs("v"), -F.col("i"))).alias("i"), F.max(F.abs("v")).alias("v"))

    def all_scalar(self, op: str, s: float) -> DataFrame:
        """(ok): whether all values compare so; true for none."""
        ok = F.coalesce(F.bool_and(COMPARE[op](F.col("v"), F.lit(float(s)))), F.lit(True))
        if not self.dense:
            ok = ok & ((self._implicit() == 0) | F.lit(bool(COMPARE[op](self.zero, s))))
        return self.df.agg(ok.alias("ok"))

    def all_vector(self, op: str, other: "Vector") -> DataFrame:
        both = self.binary("copy", other)  # its rows are those to compare
        x, y = self.df.select("i", F.col("v").alias("x")), other.df.select("i", F.col("v").alias("y"))
        rows = both.df.select("i").join(x, "i", "left").join(y, "i", "left")
        ok = F.bool_and(COMPARE[op](F.coalesce("x", F.lit(self.zero)), F.coalesce("y", F.lit(other.zero))))
        ok = F.coalesce(ok, F.lit(True))
        if not both.dense:
            ok = ok & ((F.lit(self.n) == F.count("i")) | F.lit(bool(COMPARE[op](self.zero, other.zero))))
        return rows.agg(ok.alias("ok"))

    # -- gather and scatter; index vectors have their values as doubles, too

    def gather(self, index: "Vector") -> "Vector":
        """v[index[k]] for each k; indexes without a row give the implicit value."""
        source = self.df.select(F.col("i").alias("at"), F.col("v").alias("y"))
        found = index.df.select("i", F.col("v").cast("long").alias("at")).join(source, "at", "inner" if self.dense else "left")
        return Vector(found.select("i", F.coalesce("y", F.lit(self.zero)).alias("v")), index.n, dense=index.dense)

    def scatter(self, index: "Vector", source: "Vector", op: str = "copy") -> "Vector":
        """self with op(self[index[k]], source[k]) for each k; of equal indexes the last k counts for copy, all do for add and sub."""
        pairs = index.df.select(F.col("i").alias("k"), F.col("v").cast("long").alias("i")).join(source.df.select(F.col("i").alias("k"), F.col("v").alias("y")), "k")
        if op not in ("copy", "add", "sub", "min", "max"):
            raise ValueError(f"repeated indexes can't be combined by {op}")
        combined = F.max_by("y", "k") if op == "copy" else aggregate("add" if op == "sub" else op, F.col("y"))
        return self._written(pairs.groupBy("i").agg(combined.alias("y")), op)

    # -- order

    def scan(self, exclusive: bool = False) -> "Vector":
        return replace(self, df=prefix_sum(self.df, exclusive))

    def unscan(self) -> "Vector":
        """Differences of neighbours: n - 1 values."""
        following = self.df.select((F.col("i") - 1).alias("i"), F.col("v").alias("y"))
        return Vector(self.df.join(following, "i").select("i", (F.col("y") - F.col("v")).alias("v")), max(0, self.n - 1))

    def is_sorted(self, ascending: bool = True) -> DataFrame:
        following = self.df.select((F.col("i") - 1).alias("i"), F.col("v").alias("y"))
        ok = F.col("v") <= F.col("y") if ascending else F.col("v") >= F.col("y")
        return self.df.join(following, "i").agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"))

    def sort(self, ascending: bool = True) -> tuple["Vector", "Vector"]:
        """(values in order, their former indexes); equal values keep the order of their indexes."""
        rows = ranked(self.df, F.col("v").asc() if ascending else F.col("v").desc(), F.col("i").asc())
        values = rows.select(F.col("rank").alias("i"), "v")
        return Vector(values, self.n), Vector(rows.select(F.col("rank").alias("i"), F.col("i").cast("double").alias("v")), self.n)

    def inverse_permutation(self) -> "Vector":
        return replace(self, df=self.df.select(F.col("v").cast("long").alias("i"), F.col("i").cast("double").alias("v")))

    def shift(self, d: int) -> "Vector":
        """Circular shift: the value at i goes to (i + d) mod n."""
        return replace(self, df=self.df.select(F.pmod(F.col("i") + d, F.lit(self.n)).alias("i"), "v"))

    def top(self, k: int) -> DataFrame:
        return self.df.orderBy(F.col("v").desc(), F.col("i")).limit(k)

    # -- sets of rows

    def concat(self, other: "Vector") -> "Vector":
        if self.dense != other.dense or (not self.dense and self.zero != other.zero):
            return self.to_dense().concat(other.to_dense())
        rows = self.df.unionByName(other.df.select((F.col("i") + self.n).alias("i"), "v"))
        return replace(self, df=rows, n=self.n + other.n)

    def merge(self, other: "Vector", op: str) -> "Vector":
        """Stored values of both, those of equal indexes combined by op."""
        rows = self.df.unionByName(other.df).groupBy("i").agg(aggregate(op, F.col("v")).alias("v"))
        return Vector(rows, self.n, self.zero, False)

    def consistent(self) -> DataFrame:
        """(ok): indexes unique, none null or out of range, all there if dense."""
        c = self.df.groupBy("i").count()
        ok = F.coalesce(F.bool_and((F.col("count") == 1) & F.col("i").between(0, self.n - 1)), F.lit(True))
        if self.dense:
            ok = ok & (F.count("i") == self.n)
        return c.agg(ok.alias("ok"))

    def histogram(self, n: int) -> DataFrame:
        """(b, size, offset) of the buckets 0 to n - 1; values outside are ignored. The windows run over the n buckets."""
        counts = self.df.filter(F.col("v").between(0, n - 1)).groupBy(F.col("v").cast("long").alias("b")).agg(F.count("*").alias("c"))
        every = self.df.sparkSession.range(n).select(F.col("id").alias("b")).join(counts, "b", "left").select("b", F.coalesce("c", F.lit(0)).alias("size"))
        return every.select("b", "size", (F.sum("size").over(Window.orderBy("b")) - F.col("size")).alias("offset"))

    def _check(self, other: "Vector") -> None:
        if self.n != other.n:
            raise ValueError(f"vectors of {self.n} and {other.n} values")
