"""Matrix Market and plain text files, read and written by Spark's text source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.complex import ComplexMatrix
from tessera.plans.matrix import Matrix
from tessera.plans.scan import ranked
from tessera.plans.vector import Vector

BANNER = "%%MatrixMarket"


@dataclass(frozen=True)
class Header:
    item: str
    form: str  # coordinate or array
    kind: str  # real, integer, complex or pattern
    symmetry: str
    sizes: tuple[int, ...]
    line: str = ""


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): at orders the lines as the file, or the files of a folder by name, have them."""
    rows = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    return rows.select(F.struct("_metadata.file_path", "_metadata.file_block_start", "id").alias("at"), F.trim("value").alias("value"))


def header(spark: SparkSession, path: str) -> Header:
    """What the first lines of a Matrix Market file (or of the first file of a folder) say; no entries are read."""
    lines = (x.strip() for x in first_lines(spark, path))
    banner = next(lines, "")
    sizes = next((x for x in lines if x and not x.startswith("%")), None)
    if not banner.startswith(BANNER) or sizes is None:
        raise ValueError(f"{path} is no Matrix Market file")
    _, item, form, kind, symmetry = banner.lower().split()
    return Header(item, form, kind, symmetry, tuple(int(x) for x in sizes.split()), sizes)


def first_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of a text file, or of the files of a folder by name, read as far as they are asked for."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
    for part in parts:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(part), "UTF-8"))
        try:
            while (line := reader.readLine()) is not None:
                yield line
        finally:
            reader.close()


def read_mtx_complex(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """((i, j, re, im), header): 0-based; the halves of symmetric files are mirrored, array files are read by columns."""
    head = header(spark, path)
    lines = lines_of(spark, path).filter(~F.col("value").startswith("%") & (F.col("value") != ""))
    first = lines.filter(F.col("value") == head.line).agg(F.min("at").alias("first"))  # entries that read the same come later
    body = lines.join(F.broadcast(first), F.col("at") > F.col("first")).select("at", F.split("value", r"\s+").alias("f"))  # a single row is broadcast
    number = lambda k: F.col("f")[k].cast("double")
    if head.form == "coordinate":
        re = F.lit(1.0) if head.kind == "pattern" else number(2)
        im = number(3) if head.kind == "complex" else F.lit(0.0)
        rows = body.select((F.col("f")[0].cast("long") - 1).alias("i"), (F.col("f")[1].cast("long") - 1).alias("j"), re.alias("re"), im.alias("im"))
    else:
        n = head.sizes[0]
        im = number(1) if head.kind == "complex" else F.lit(0.0)
        placed = ranked(body.select("at", number(0).alias("re"), im.alias("im")), F.col("at").asc())
        if head.symmetry == "general":
            rows = placed.select((F.col("rank") % n).alias("i"), F.floor(F.col("rank") / n).cast("long").alias("j"), "re", "im")
        else:  # the lower triangle by columns: column j begins at j n - j (j - 1) / 2
            j = F.floor((F.lit(2 * n + 1) - F.sqrt(F.lit(float((2 * n + 1) ** 2)) - 8.0 * F.col("rank"))) / 2).cast("long")
            rows = placed.withColumn("j", j).select((F.col("rank") - (F.col("j") * n - F.floor(F.col("j") * (F.col("j") - 1) / 2)) + F.col("j")).cast("long").alias("i"), "j", "re", "im")
    if head.symmetry != "general":
        sign = {"symmetric": (1, 1), "hermitian": (1, -1), "skew-symmetric": (-1, -1)}[head.symmetry]
        mirrored = rows.filter("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("re") * sign[0]).alias("re"), (F.col("im") * sign[1]).alias("im"))
        rows = rows.unionByName(mirrored)
    return rows, head


def read_mtx(spark: SparkSession, path: str) -> "Matrix | ComplexMatrix":
    rows, head = read_mtx_complex(spark, path)
    n, m = head.sizes[0], head.sizes[1] if len(head.sizes) > 1 else 1
    if head.kind == "complex":
        return ComplexMatrix(rows.select("i", "j", "re", "im"), n, m)
    return Matrix(rows.select("i", "j", F.col("re").alias("v")), n, m)


def read_mtx_vector(spark: SparkSession, path: str) -> Vector:
    rows, head = read_mtx_complex(spark, path)
    return Vector(rows.select("i", F.col("re").alias("v")), head.sizes[0], 0.0, head.form == "array")


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (at, sub, value) as a folder of text files that, one after the other, are one file."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "at", "sub").sortWithinPartitions("at", "sub").select("value").write.mode("overwrite").text(path)


def write_mtx(matrix: Matrix, path: str, kind: str = "real") -> None:
    """A coordinate file in row order; the lower triangle alone if the matrix is symmetric."""
    spark = matrix.df.sparkSession
    symmetric = matrix.n == matrix.m and bool(matrix.is_symmetric().first()[0])
    rows = matrix.df.filter("i >= j") if symmetric else matrix.df
    number = F.lit("") if kind == "pattern" else F.concat(F.lit(" "), F.col("v").cast("long" if kind == "integer" else "double").cast("string"))
    body = rows.select((F.col("i") + 1).alias("at"), F.col("j").alias("sub"), F.concat((F.col("i") + 1).cast("string"), F.lit(" "), (F.col("j") + 1).cast("string"), number).alias("value"))
    head = rows.agg(F.concat(F.lit(f"{matrix.n} {matrix.m} "), F.count("*").cast("string")).alias("value")).select(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("sub"), "value")
    banner = spark.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sub"), F.lit(f"{BANNER} matrix coordinate {kind} {'symmetric' if symmetric else 'general'}").alias("value"))
    write_lines(banner.unionByName(head).unionByName(body), path)


def write_mtx_complex(matrix: ComplexMatrix, path: str) -> None:
    """A general coordinate file of complex values in row order."""
    spark = matrix.df.sparkSession
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    body = matrix.df.select((F.col("i") + 1).alias("at"), F.col("j").alias("sub"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "re", "im").alias("value"))
    head = matrix.df.agg(F.concat(F.lit(f"{matrix.n} {matrix.m} "), F.count("*").cast("string")).alias("value")).select(zero.alias("at"), one.alias("sub"), "value")
    banner = spark.range(1).select(zero.alias("at"), zero.alias("sub"), F.lit(f"{BANNER} matrix coordinate complex general").alias("value"))
    write_lines(banner.unionByName(head).unionByName(body), path)


def write_mtx_vector(x: Vector, path: str) -> None:
    """An array file of n values, or a coordinate file of the stored ones of a sparse vector."""
    spark = x.df.sparkSession
    form = "array" if x.dense else "coordinate"
    count = F.lit(f"{x.n} 1") if x.dense else F.concat(F.lit(f"{x.n} 1 "), F.count("*").cast("string"))
    zero = F.lit(0).cast("long")
    head = x.df.agg(count.alias("value")).select(zero.alias("at"), F.lit(1).cast("long").alias("sub"), "value")
    banner = spark.range(1).select(zero.alias("at"), zero.alias("sub"), F.lit(f"{BANNER} matrix {form} real general").alias("value"))
    value = F.col("v").cast("string") if x.dense else F.concat((F.col("i") + 1).cast("string"), F.lit(" 1 "), F.col("v").cast("string"))
    write_lines(banner.unionByName(head).unionByName(x.df.select((F.col("i") + 1).alias("at"), zero.alias("sub"), value.alias("value"))), path)


def read_txt(spark: SparkSession, path: str) -> Matrix:
    """Lines `i j v`, 0-based; the shape is that of the greatest indexes."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), F.coalesce(F.try_element_at(f, F.lit(3)).cast("double"), F.lit(1.0)).alias("v"))
    n, m = rows.agg(F.max("i"), F.max("j")).first()
    return Matrix(rows, 0 if n is None else n + 1, 0 if m is None else m + 1)


def read_txt_vector(spark: SparkSession, path: str) -> Vector:
    """One value a line."""
    lines = lines_of(spark, path).filter(F.col("value") != "")
    placed = ranked(lines.select("at", F.col("value").cast("double").alias("v")), F.col("at").asc())
    return Vector(placed.select(F.col("rank").alias("i"), "v"), placed.count())


def write_txt(x: "Vector | Matrix", path: str) -> None:
    zero = F.lit(0).cast("long")
    if isinstance(x, Vector):
        write_lines(x.to_dense().df.select(F.col("i").alias("at"), zero.alias("sub"), F.col("v").cast("string").alias("value")), path)
    else:
        write_lines(x.df.select(F.col("i").alias("at"), F.col("j").alias("sub"), F.concat_ws(" ", "i", "j", "v").alias("value")), path)
