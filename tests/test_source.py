"""The data source of triples: partitions, filters, and writes in two phases."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import tables


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    tables.register(spark)
    path = str(tmp_path_factory.mktemp("triples") / "a")
    rows = spark.range(10_000).select((F.col("id") % 1000).alias("i"), F.floor(F.col("id") / 1000).alias("j"), (F.col("id") / 2).alias("v"))
    rows.repartitionByRange(2, "i").write.format("triples").mode("overwrite").save(path)
    return path


def test_rows_come_back_in_many_partitions_of_one_file(spark, place):
    assert len(os.listdir(place)) == 2
    read = spark.read.format("triples").option("partitionBytes", 24 * 1500).load(place)
    assert read.dtypes == [("i", "bigint"), ("j", "bigint"), ("v", "double")]
    found = read.agg(F.count("*"), F.sum("i"), F.sum("v"), F.countDistinct("i", "j")).first()
    assert tuple(found) == (10_000, 10 * sum(range(1000)), sum(range(10_000)) / 2, 10_000)
    assert read.rdd.getNumPartitions() >= 7


def test_ranges_narrow_what_is_read(spark, place):
    read = spark.read.format("triples").load(place)
    for condition, n in (("i = 5", 10), ("i >= 990", 100), ("i > 990 AND i <= 993", 30), ("i < 3 AND v > 1000", 23), ("i > 5000", 0)):
        assert read.filter(condition).count() == n, condition
    for low, high, n in ((5, 5, 10), (990, None, 100), (None, 2, 30), (5000, None, 0), (-3, 2000, 10_000)):
        assert sum(p.rows for p in tables.TriplesReader(place, 1 << 20, low, high).partitions()) == n
    some = spark.read.format("triples").option("from", 7).option("to", 8).load(place)
    both = some.filter("i = 7").unionByName(some.filter("i = 8")).unionByName(read.filter("i = 9"))
    assert sorted(r.i for r in both.collect()) == [7] * 10 + [8] * 10 + [9] * 10


def test_appends_overwrites_and_failures(spark, tmp_path):
    tables.register(spark)
    path, rows = str(tmp_path / "b"), spark.createDataFrame([(1, 2, 3.0)], tables.SCHEMA)
    save = lambda df, mode: df.write.format("triples").mode(mode).save(path)
    save(rows, "overwrite")
    save(rows, "append")
    assert spark.read.format("triples").load(path).count() == 2
    save(rows.filter("i > 5"), "overwrite")
    assert spark.read.format("triples").load(path).count() == 0
    save(rows, "append")
    bad = rows.withColumn("v", F.raise_error("no").cast("double"))
    with pytest.raises(Exception, match="no"):
        save(bad, "append")
    with pytest.raises(Exception, match="must be"):
        save(rows.withColumnRenamed("v", "w"), "append")
    assert spark.read.format("triples").load(path).count() == 1 and not [x for x in os.listdir(path) if x.startswith("_")]
