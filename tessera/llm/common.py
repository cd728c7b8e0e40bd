"""Input, shared storage and small text helpers of the training-data operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import shared_dir, stored

__all__ = ["batch_of", "fresh", "shared_dir", "small_batches", "stored", "table", "texts", "within"]

#: Bytes of a batch of rows that a Python worker gets at once.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from then on the session hands texts to Python workers in batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), so that further or clashing columns can't matter; a null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


#: Rows of a few numbers each that are broadcast at most; larger tables are joined by a shuffle.
FEW_ROWS = 1_000_000


def within(rows: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """rows (a written table of a few numbers a row), marked for broadcast if there are at most limit."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def small_batches(batch: pa.RecordBatch, column: str, limit: int = 16 << 20):
    """Slices of a batch whose column has about limit bytes at most (a longer single value stays whole)."""
    n = batch.num_rows
    if n <= 1 or batch.nbytes <= limit:
        yield batch
        return
    offsets = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start = held = 0
    for k in range(n):
        size = 0 if offsets[k] != offsets[k] else int(offsets[k])
        if k > start and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    yield batch.slice(start)
