"""Binary files. Matrices in one file that tasks can open are decoded by ranges of rows; other files are each one row of
Spark's binaryFile source and are decoded where they lie (many files are many rows). Written ones are encoded by tasks, range by range."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.complex import ComplexMatrix
from tessera.plans.grid import Grid
from tessera.plans.matrix import Matrix
from tessera.plans.storage import cut, stored
from tessera.plans.vector import Vector
from tessera.sources import text
from tessera.sources.tables import _place

#: Rows (or columns) of a compressed matrix that a task decodes at most, and entries that it has in memory at once.
RANGE_ROWS, RANGE_ENTRIES = 1 << 14, 1 << 16


def _decoded(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows that decode(bytes) gives as a pandas frame, for each file of path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield decode(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, n)).first()[0])


def _openable(path: str) -> bool:
    """Whether path is one file of a file system that pyarrow knows, so that tasks can read ranges of it."""
    try:
        files, base = _place(path)
        return files.get_file_info(base).type == arrow_fs.FileType.File
    except (OSError, ValueError, NotImplementedError):
        return False


def _bytes(path: str, at: int, size: int) -> bytes:
    files, base = _place(path)
    with files.open_input_file(base) as f:
        return f.read_at(size, at)


@dataclass(frozen=True)
class Compressed:
    """Where a file has a matrix in compressed form: n rows, by their sizes (counted) or by n + 1 offsets, then columns and values, each (position, numpy type)."""

    n: int
    index: tuple[int, str]
    columns: tuple[int, str]
    values: tuple[tuple[int, str], ...]
    counted: bool = False
    base: int = 0

    def read(self, spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
        """Rows (row, column, values...) by these names; a task has a range of rows at a time, and of its entries a piece."""
        each = min(RANGE_ROWS, max(1024, -(-self.n // 96)))
        number = -(-self.n // each)
        ranges = spark.range(0, number, 1, max(1, min(number, 1000))).select(F.col("id").alias("r"))
        place = partial(_at, path)
        ends = lambda r: (r * each, min(self.n, (r + 1) * each))
        first: dict[int, int] = {}
        if self.counted:

            def count(batches):
                for b in batches:
                    with place() as f:
                        sums = [int(_numbers(f, self.index, *ends(r)).sum(dtype=np.int64)) for r in b.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64())], ["r", "n"])

            total = 0
            for r in ranges.mapInArrow(count, "r long, n long").orderBy("r").collect():  # a number for each range
                first[r.r], total = total, total + r.n
        schema = pa.schema([(names[0], pa.int64()), (names[1], pa.int64()), *((v, pa.float64()) for v in names[2:])])

        def decode(batches):
            for b in batches:
                with place() as f:
                    for r in b.column(0).to_pylist():
                        low, high = ends(r)
                        if self.counted:
                            offsets = np.concatenate(([0], np.cumsum(_numbers(f, self.index, low, high), dtype=np.int64))) + first[r]
                        else:
                            offsets = _numbers(f, self.index, low, high + 1).astype(np.int64) - self.base
                        for k in range(int(offsets[0]), int(offsets[-1]), RANGE_ENTRIES):
                            end = min(k + RANGE_ENTRIES, int(offsets[-1]))
                            rows = low + np.searchsorted(offsets, np.arange(k, end), "right") - 1
                            found = [rows, _numbers(f, self.columns, k, end).astype(np.int64) - self.base, *(_numbers(f, v, k, end).astype(float) for v in self.values)]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

        types = ", ".join(f"{x} {'long' if k < 2 else 'double'}" for k, x in enumerate(names))
        return ranges.mapInArrow(decode, types)


def _at(path: str):
    files, base = _place(path)
    return files.open_input_file(base)


def _numbers(f, section: tuple[int, str], first: int, last: int) -> np.ndarray:
    """The numbers first to last - 1 of a section of an open file."""
    at, kind = section
    size = np.dtype(kind).itemsize
    return np.frombuffer(f.read_at((last - first) * size, at + first * size), kind)


def _triples(ia: np.ndarray, ja: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"i": np.repeat(np.arange(len(ia) - 1), np.diff(ia)), "j": ja.astype(np.int64), "v": v.astype(float)})


def _pieces(rows: DataFrame, order: list[str], column: str, kind: str, section: int) -> DataFrame:
    """(section, part, k, content): the values of a column as bytes of a numpy type, in order; each task encodes its range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((section, part, k, b.column(0).to_numpy(zero_copy_only=False).astype(kind).tobytes()), _PIECE)], schema=_PIECE)

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(column)
    return dealt.mapInArrow(run, PIECES)


def _literal(spark: SparkSession, section: int, content: bytes) -> DataFrame:
    return spark.createDataFrame([(section, 0, 0, bytearray(content))], PIECES)


def write_pieces(pieces: DataFrame, path: str) -> None:
    """One binary file of the pieces in their order.

    Pieces are made and sorted by tasks. A file of these formats is one stream of bytes, so the driver
    passes them on, piece by piece, a partition at a time.
    """
    spark = pieces.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for r in stored(pieces, "pieces").orderBy("section", "part", "k").select("content").toLocalIterator():
            out.write(bytearray(r.content))
    finally:
        out.close()


PIECES = "section int, part int, k int, content binary"
_PIECE = pa.schema([("section", pa.int32()), ("part", pa.int32()), ("k", pa.int32()), ("content", pa.binary())])
TRIPLES, PAIRS = "i long, j long, v double", "i long, v double"

# Fixed values of the PETSc binary format: class ids of matrices and vectors.
PETSC_MATRIX, PETSC_VECTOR = 1211216, 1211214


def decode_petsc_matrix(d: bytes) -> pd.DataFrame:
    _, rows, _, nnz = struct.unpack_from(">4i", d)
    sizes = np.frombuffer(d, ">i4", rows, 16)
    ja = np.frombuffer(d, ">i4", nnz, 16 + 4 * rows)
    return _triples(np.concatenate(([0], np.cumsum(sizes))), ja, np.frombuffer(d, ">f8", nnz, 16 + 4 * (rows + nnz)))


def read_petsc(spark: SparkSession, path: str) -> "Matrix | Vector":
    """Big-endian: class id, sizes, row lengths, columns, values."""
    ranges = _openable(path)
    head = _bytes(path, 0, 16) if ranges else _head(spark, path, 16)
    kind, n, m, nnz = struct.unpack(">4i", (head + bytes(16))[:16])
    if kind == PETSC_VECTOR:
        return Vector(_decoded(spark, path, lambda d: pd.DataFrame({"i": np.arange(n), "v": np.frombuffer(d, ">f8", n, 8).astype(float)}), PAIRS), n)
    if kind != PETSC_MATRIX:
        raise ValueError(f"{path} has the unknown class id {kind}")
    if ranges:
        at = 16 + 4 * n
        return Matrix(Compressed(n, (16, ">i4"), (at, ">i4"), ((at + 4 * nnz, ">f8"),), counted=True).read(spark, path, ("i", "j", "v")), n, m)
    return Matrix(_decoded(spark, path, decode_petsc_matrix, TRIPLES), n, m)


def write_petsc(x: "Matrix | Vector", path: str) -> None:
    spark = x.df.sparkSession
    if isinstance(x, Vector):
        head = _literal(spark, 0, struct.pack(">2i", PETSC_VECTOR, x.n))
        return write_pieces(head.unionByName(_pieces(x.to_dense().df, ["i"], "v", ">f8", 1)), path)
    nnz = x.df.count()
    pieces = _literal(spark, 0, struct.pack(">4i", PETSC_MATRIX, x.n, x.m, nnz))
    pieces = pieces.unionByName(_pieces(x.row_sizes().to_dense().df, ["i"], "v", ">i4", 1))
    for section, column, kind in ((2, "j", ">i4"), (3, "v", ">f8")):
        pieces = pieces.unionByName(_pieces(x.df, ["i", "j"], column, kind, section))
    write_pieces(pieces, path)


def read_samg(spark: SparkSession, header_path: str, data_path: str) -> Matrix:
    """A header (.frm: form and version; entries, rows, ...) and its data file (.amg): 1-based row offsets, columns, values; form f is text, b or u little-endian, x big-endian."""
    lines = [r.value.split() for r in spark.read.text(header_path).collect()]  # two short lines
    form, (nnz, n) = lines[0][0], map(int, lines[1][:2])
    if form == "f":
        from tessera.plans.scan import ranked

        numbers = text.lines_of(spark, data_path).select("at", F.posexplode(F.split("value", r"\s+")).alias("p", "x")).filter("x != ''")
        placed = ranked(numbers.select("at", "p", F.col("x").cast("double").alias("x")), F.col("at").asc(), F.col("p").asc())
        offsets = placed.filter(F.col("rank") <= n).select(F.col("rank").alias("i"), (F.col("x") - 1).cast("long").alias("o"))
        ends = offsets.select((F.col("i") - 1).alias("i"), F.col("o").alias("e"))
        entry = F.explode(F.sequence(F.col("o"), F.col("e") - 1)).alias("k")
        rows = offsets.join(ends, "i").filter("e > o").select("i", entry)
        at = lambda base, name: placed.filter((F.col("rank") >= base) & (F.col("rank") < base + nnz)).select((F.col("rank") - base).alias("k"), F.col("x").alias(name))
        joined = rows.join(at(n + 1, "j"), "k").join(at(n + 1 + nnz, "v"), "k")
        return Matrix(joined.select("i", (F.col("j") - 1).cast("long").alias("j"), "v"), n, n)
    end = ">" if form == "x" else "<"
    if nnz and _openable(data_path):
        files, base = _place(data_path)
        at = 4 * (n + 1)
        size = (files.get_file_info(base).size - at - 4 * nnz) // nnz
        return Matrix(Compressed(n, (0, f"{end}i4"), (at, f"{end}i4"), ((at + 4 * nnz, f"{end}f{size}"),), base=1).read(spark, data_path, ("i", "j", "v")), n, n)

    def decode(d: bytes) -> pd.DataFrame:
        ia = np.frombuffer(d, f"{end}i4", n + 1) - 1
        ja = np.frombuffer(d, f"{end}i4", nnz, 4 * (n + 1)) - 1
        rest = len(d) - 4 * (n + 1 + nnz)
        return _triples(ia, ja, np.frombuffer(d, f"{end}f{rest // nnz}", nnz, 4 * (n + 1 + nnz)))

    return Matrix(_decoded(spark, data_path, decode, TRIPLES), n, n)


def read_samg_vector(spark: SparkSession, header_path: str, data_path: str) -> Vector:
    """A header (.frv: form; length; bytes a value) and its data file (.vec)."""
    lines = [r.value.split() for r in spark.read.text(header_path).collect()]  # three short lines
    form, n, size = lines[0][0], int(lines[1][0]), int(lines[2][0])
    if form == "f":
        return text.read_txt_vector(spark, data_path)
    kind = f"{'>' if form == 'x' else '<'}f{size}"
    return Vector(_decoded(spark, data_path, lambda d: pd.DataFrame({"i": np.arange(n), "v": np.frombuffer(d, kind, n).astype(float)}), PAIRS), n)


def write_samg(matrix: Matrix, path: str, form: str = "b") -> None:
    """A text header (.frm) and beside it the data (.amg): binary, little-endian (b), or lines of text (f), in a folder of files that tasks write."""
    spark = matrix.df.sparkSession
    if matrix.n != matrix.m:
        raise ValueError("this format holds square matrices")
    if form not in ("b", "f"):
        raise ValueError(f"form {form!r} isn't written")
    matrix = Matrix(cut(matrix.df.select("i", "j", "v")), matrix.n, matrix.m)  # each section reads it
    nnz = matrix.df.count()
    write_pieces(_literal(spark, 0, f"{form} 4\n{nnz} {matrix.n} 22 1 0\n".encode()), path)
    if form == "f":
        line = lambda rows, section, i, j, value: rows.select(F.struct(F.lit(section).alias("section"), i.alias("i")).alias("at"), j.alias("sub"), value.cast("string").alias("value"))
        i, j, none = F.col("i"), F.col("j"), F.lit(0).cast("long")
        lines = line(matrix.offsets().df, 0, i, none, (F.col("v") + 1).cast("long"))
        lines = lines.unionByName(line(matrix.df, 1, i, j, j + 1)).unionByName(line(matrix.df, 2, i, j, F.col("v")))
        return text.write_lines(lines, path[:-3] + "amg")
    data = _pieces(matrix.offsets().scalar("add", 1.0).df, ["i"], "v", "<i4", 0)
    data = data.unionByName(_pieces(matrix.df.select("i", "j", (F.col("j") + 1).alias("c")), ["i", "j"], "c", "<i4", 1))
    write_pieces(data.unionByName(_pieces(matrix.df, ["i", "j"], "v", "<f8", 2)), path[:-3] + "amg")


def write_samg_vector(x: Vector, path: str, form: str = "b") -> None:
    """A text header (.frv) and beside it the values (.vec): binary, little-endian (b), or a line each (f), in a folder of files."""
    if form not in ("b", "f"):
        raise ValueError(f"form {form!r} isn't written")
    write_pieces(_literal(x.df.sparkSession, 0, f"{form}\n{x.n}\n8\n".encode()), path)
    if form == "f":
        return text.write_txt(x, path[:-3] + "vec")
    write_pieces(_pieces(x.to_dense().df, ["i"], "v", "<f8", 0), path[:-3] + "vec")


# Fixed values of MATLAB's level-5 files: data types, array classes.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_PACKED, MAT_SPARSE, MAT_COMPLEX = 14, 15, 5, 0x800


def _mat_elements(d: bytes, at: int, end: int, order: str):
    while at + 8 <= end:
        word = struct.unpack_from(order + "I", d, at)[0]
        if word >> 16:  # small element: size and type in one word
            kind, size, body = word & 0xFFFF, word >> 16, at + 4
            at += 8
        else:
            kind, size = word, struct.unpack_from(order + "I", d, at + 4)[0]
            body = at + 8
            at = body + size + (-size % 8 if kind != MAT_PACKED else 0)
        yield kind, d[body : body + size]


def decode_mat(d: bytes) -> tuple[int, int, bool, pd.DataFrame]:
    """(rows, columns, whether complex, (i, j, re, im)) of the first real or complex array of a level-5 file."""
    order = "<" if d[126:128] == b"IM" else ">"
    for kind, body in _mat_elements(d, 128, len(d), order):
        if kind == MAT_PACKED:
            body = zlib.decompress(body)
            kind, body = next(_mat_elements(body, 0, len(body), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_mat_elements(body, 0, len(body), order))
        flags = struct.unpack_from(order + "I", parts[0][1])[0]
        n, m = struct.unpack_from(order + "2i", parts[1][1])
        number = lambda p: np.frombuffer(p[1], order + MAT_TYPES[p[0]])
        is_complex = bool(flags & MAT_COMPLEX)
        if flags & 0xFF == MAT_SPARSE:
            ir, jc = number(parts[3]), number(parts[4])
            nnz = int(jc[-1])
            place = {"i": ir[:nnz].astype(np.int64), "j": np.repeat(np.arange(m), np.diff(jc))}
            values = [number(p).astype(float)[:nnz] for p in parts[5:7]]
        else:
            at = np.arange(n * m)
            place = {"i": at % n, "j": at // n}
            values = [number(p).astype(float) for p in parts[3:5]]
        return n, m, is_complex, pd.DataFrame(place | {"re": values[0], "im": values[1] if is_complex else 0.0})
    raise ValueError("no numeric array in the file")


def _sparse_mat(path: str) -> tuple[int, int, bool, Compressed] | None:
    """(rows, columns, whether complex, its columns in compressed form) if the file's first element is a sparse array that is not packed."""
    with _at(path) as f:
        order = "<" if f.read_at(2, 126) == b"IM" else ">"

        def element(at: int) -> tuple[int, int, int, int]:
            """(type, position and size of the content, position of the next one)"""
            head = f.read_at(8, at)
            word, size = struct.unpack(order + "2I", head)
            if word >> 16:
                return word & 0xFFFF, at + 4, word >> 16, at + 8
            return word, at + 8, size, at + 8 + size + -size % 8

        if f.size() < 136:
            return None
        kind, at, size, end = element(128)
        if kind != MAT_MATRIX:
            return None
        parts = []
        while at + 8 <= min(end, f.size()):
            kind, body, size, at = element(at)
            parts.append((kind, body, size))
        flags = struct.unpack(order + "I", f.read_at(4, parts[0][1]))[0]
        n, m = struct.unpack(order + "2i", f.read_at(8, parts[1][1]))
        if flags & 0xFF != MAT_SPARSE:
            return None
    section = lambda p: (p[1], order + MAT_TYPES[p[0]])
    is_complex = bool(flags & MAT_COMPLEX)
    return n, m, is_complex, Compressed(m, section(parts[4]), section(parts[3]), tuple(section(p) for p in parts[5 : 7 if is_complex else 6]))


def read_mat(spark: SparkSession, path: str) -> "Matrix | ComplexMatrix":
    found = _sparse_mat(path) if _openable(path) else None
    if found is not None:
        n, m, is_complex, where = found
        if is_complex:
            return ComplexMatrix(where.read(spark, path, ("j", "i", "re", "im")).select("i", "j", "re", "im"), n, m)
        return Matrix(where.read(spark, path, ("j", "i", "v")).select("i", "j", "v"), n, m)
    shape = _decoded(spark, path, lambda d: pd.DataFrame([decode_mat(d)[:3]], columns=["n", "m", "c"]), "n long, m long, c boolean").first()
    rows = _decoded(spark, path, lambda d: decode_mat(d)[3], "i long, j long, re double, im double")
    if shape.c:
        return ComplexMatrix(rows, shape.n, shape.m)
    return Matrix(rows.select("i", "j", F.col("re").alias("v")), shape.n, shape.m)


def write_mat(x: "Matrix | ComplexMatrix", path: str, name: str = "A") -> None:
    """A level-5 file with one sparse array."""
    spark, n, m = x.df.sparkSession, x.n, x.m
    is_complex = isinstance(x, ComplexMatrix)
    rows = x.df if is_complex else x.df.withColumnRenamed("v", "re")
    nnz = rows.count()
    columns = Matrix(rows.select("i", "j", F.col("re").alias("v")), n, m).transpose().offsets()
    tag = lambda kind, size: struct.pack("<II", kind, size)
    pad = lambda size: bytes(-size % 8)
    label = name.encode()
    flags = MAT_SPARSE | (MAT_COMPLEX if is_complex else 0)
    head = tag(6, 8) + struct.pack("<II", flags, max(1, nnz)) + tag(5, 8) + struct.pack("<2i", n, m) + tag(1, len(label)) + label + pad(len(label))
    parts = [(5, 4 * nnz, rows, "i", "<i4"), (5, 4 * (m + 1), None, "v", "<i4"), *((9, 8 * nnz, rows, c, "<f8") for c in (("re", "im") if is_complex else ("re",)))]
    total = len(head) + sum(8 + size + len(pad(size)) for _, size, *_ in parts)
    pieces = _literal(spark, 0, b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x100) + b"IM" + tag(MAT_MATRIX, total) + head)
    for k, (kind, size, values, column, numbers) in enumerate(parts):
        pieces = pieces.unionByName(_literal(spark, 3 * k + 1, tag(kind, size)))
        pieces = pieces.unionByName(_pieces(columns.df, ["i"], column, numbers, 3 * k + 2) if values is None else _pieces(values, ["j", "i"], column, numbers, 3 * k + 2))
        pieces = pieces.unionByName(_literal(spark, 3 * k + 3, pad(size)))
    write_pieces(pieces, path)


def decode_bmp(d: bytes) -> np.ndarray:
    """height x width x 3 values of an uncompressed 24-bit bitmap (red, green, blue)."""
    start, = struct.unpack_from("<I", d, 10)
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", d, 18)
    if d[:2] != b"BM" or bits != 24 or packed:
        raise ValueError("only uncompressed 24-bit bitmaps are read")
    line = (3 * width + 3) // 4 * 4
    rows = np.frombuffer(d, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    return rows[::-1] if height > 0 else rows


def bmp_bytes(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    pad = bytes(-3 * width % 4)
    body = b"".join(np.ascontiguousarray(row[:, ::-1], np.uint8).tobytes() + pad for row in pixels[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_png(d: bytes) -> np.ndarray:
    """height x width x 3 values of an 8-bit, not interlaced grey, RGB or RGBA image."""
    if d[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed = 8, b""
    while at < len(d):
        size, kind = struct.unpack_from(">I4s", d, at)
        body = d[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit images without interlacing and palette are read")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int32)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = (line + above) & 255
        elif kind in (1, 3, 4):
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = (a, b, c)[near.index(min(near))]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    out = out.reshape(height, width, channels)
    return np.repeat(out[:, :, :1], 3, axis=2) if channels < 3 else out[:, :, :3]


def png_bytes(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + np.ascontiguousarray(row, np.uint8).tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_image(spark: SparkSession, path: str) -> tuple[Vector, Grid]:
    """The values of one .bmp or .png file over a grid of height x width x 3."""
    decode = decode_png if path.endswith(".png") else decode_bmp
    shape = _decoded(spark, path, lambda d: pd.DataFrame([decode(d).shape], columns=["h", "w", "c"]), "h long, w long, c long").first()
    grid = Grid((shape.h, shape.w, shape.c))
    rows = _decoded(spark, path, lambda d: pd.DataFrame({"v": decode(d).reshape(-1).astype(float)}).reset_index(names="i"), PAIRS)
    return Vector(rows, grid.size), grid


def image_bytes(x: Vector, grid: Grid, kind: str = "png") -> DataFrame:
    """(content) of one image file of a height x width x 3 grid: an image is one value, made by one task."""
    encode = png_bytes if kind == "png" else bmp_bytes
    shape = grid.shape

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        pixels = np.zeros(int(np.prod(shape)), np.uint8)
        pixels[frame["i"].to_numpy()] = np.clip(frame["v"].to_numpy(), 0, 255).astype(np.uint8)
        return pd.DataFrame({"content": [encode(pixels.reshape(shape))]})

    return x.df.groupBy(F.lit("all").alias("file")).applyInPandas(whole, "content binary")


def write_image(image: tuple[Vector, Grid], path: str) -> None:
    """A vector over a height x width x 3 grid as a .bmp or .png file."""
    content = image_bytes(*image, "png" if path.endswith(".png") else "bmp")
    write_pieces(content.select(*[F.lit(0).alias(c) for c in ("section", "part", "k")], "content"), path)


def false_colours(x: Vector, grid: Grid, low: float, high: float) -> tuple[Vector, Grid]:
    """A two-dimensional grid as red, green, blue: blue for low over green to red for high."""
    t = F.least(F.greatest((F.col("v") - F.lit(float(low))) / F.lit(float(high - low or 1.0)), F.lit(0.0)), F.lit(1.0))
    part = lambda centre: F.round(255 * F.greatest(F.lit(0.0), 1 - F.abs(t - centre) * 2))
    rows = x.df.select("i", F.posexplode(F.array(part(1.0), part(0.5), part(0.0))).alias("k", "y"))
    return Vector(rows.select((F.col("i") * 3 + F.col("k")).alias("i"), F.col("y").alias("v")), x.n * 3), Grid((*grid.shape, 3))
