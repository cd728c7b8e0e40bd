"""Prefix sums and ranks without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import stored

#: Consecutive indexes of a block; a block's sum is one row of the second pass.
BLOCK = 65_536


def prefix_sum(df: DataFrame, exclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, v) with the running sums of v in the order of i (unique, 0 or more).

    Blocks of consecutive indexes are summed, the sums before each block are added up over one row
    a block, and a window runs within each block.
    """
    keyed = df.select("i", "v", F.expr(f"i div {block}").alias("b"))
    sums = keyed.groupBy("b").agg(F.sum("v").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("double")).alias("before"))
    last = -1 if exclusive else 0
    inside = F.sum("v").over(Window.partitionBy("b").orderBy("i").rowsBetween(Window.unboundedPreceding, last))
    return keyed.withColumn("s", inside).join(before, "b").select("i", (F.coalesce("s", F.lit(0.0)) + F.col("before")).alias("v"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with a 0-based rank in the given order (ties must be broken by it): range partitions, their counts, then ranks within."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__p").agg(F.count("*").alias("__c"))
    counts = counts.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__before"))
    placed = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order))).join(counts, "__p")
    return placed.select(*df.columns, (F.col("__before") + F.col("__n") - 1).alias("rank"))
