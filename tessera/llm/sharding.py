"""Contiguous shards of nearly equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

N_SHARDS = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text).

    size is the text's UTF-8 bytes plus 1 (null text: 1). Rows lie in the order of doc_id (nulls
    first; ties by checksum and size), are dealt into ranges, and a range's rows get the bytes and
    rows of all ranges before it from the per-range totals. A row belongs to the shard that holds
    the middle of its bytes on the scale of all bytes cut into n_shards equal parts, so a shard is
    off its target by no more than one row's size. slot counts from 0 within a shard. Repeated
    rows count separately, an empty table gives an empty one, further columns are ignored; only
    ids, sizes and checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "text_crc32", "size"]
    dealt = stored(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part")
    parts = parts.select(
        "part",
        (F.sum("bytes").over(before) - F.col("bytes")).alias("bytes_before"),
        (F.sum("n").over(before) - F.col("n")).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(parts, "part")
    middle = (F.col("bytes_before") + F.col("upto")) * 2 - F.col("size")
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (F.col("all_bytes") * 2)).cast("int")).alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row")
    )
    placed = stored(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def op9_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the table documents."""
    found = shard_by_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP9_SQL = """
WITH RECURSIVE table256 AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
rows_ AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS b FROM documents),
hashed AS (
  SELECT doc_id, b + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(b), lambda i: ('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)),
      lambda a, x: xor(a >> 8, t[CAST(xor(a % 256, x) + 1 AS INTEGER)])), 4294967295) AS text_crc32
  FROM rows_, table256),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM hashed),
placed AS (
  SELECT *, least(7, CAST(floor((2 * upto - size) * 8 / (2 * total)) AS INTEGER)) AS shard FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""
