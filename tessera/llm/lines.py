"""Removal of repeated three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

WINDOW_LINES = 3


def text_key(text: Column) -> Column:
    """60 bits of a text's MD5 as a long: tells texts of one doc_id apart, and orders them."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def windows(docs: DataFrame, n: int = WINDOW_LINES) -> DataFrame:
    """(w1, w2, doc_id, h, at): two hashes of every n consecutive lines that aren't blank, and the lines' positions."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i"))), lambda s: s["x"] != "")
    held = docs.select("doc_id", "h", lines.alias("lines")).filter(F.size("lines") >= n)
    part = lambda k: [F.col("lines")[k + j] for j in range(n)]
    made = F.transform(
        F.sequence(F.lit(0), F.size("lines") - n),
        lambda k: F.struct(
            F.xxhash64(*[s["x"] for s in part(k)]).alias("w1"), F.xxhash64(F.lit("second"), *[s["x"] for s in part(k)]).alias("w2"), F.array(*[s["i"] for s in part(k)]).alias("at")
        ),
    )
    return held.select("doc_id", "h", F.explode(made).alias("w")).select("w.w1", "w.w2", "doc_id", "h", "w.at")


def drop_repeated_windows(docs: DataFrame, n: int = WINDOW_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of docs (doc_id, text).

    Lines are compared without blanks at their ends; blank lines belong to no window and stay. Of
    each window of n consecutive lines that occurs more than once in all documents, the first
    occurrence (by doc_id, nulls first, then text_key and position) stays, and the lines of all
    later ones go, each line once however many windows cover it. Texts with fewer than n lines
    that aren't blank have no window and stay as they are; null texts give empty ones; rows that
    repeat both doc_id and text count as one occurrence and get the same result; an empty table
    gives an empty one; further columns are ignored. Windows are told apart by two 64-bit hashes,
    and counts are combined before the shuffle, so that a window in a third of all documents is one
    row per task; a text that very many rows have gives each of its lines once; the repeated windows are a table, so that the join with it is dealt anew where a
    window has very many rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", text_key(F.col("text")))
    found = stored(windows(rows, n), "windows")
    first = found.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", F.col("at")[0].alias("p"))).alias("first"))
    repeated = stored(first.filter("n > 1").select("w1", "w2", "first"), "repeated")
    later = found.join(repeated, ["w1", "w2"]).filter(~F.struct("doc_id", "h", F.col("at")[0].alias("p")).eqNullSafe(F.col("first")))
    places = later.select("doc_id", "h", F.explode("at").alias("line")).distinct()
    gone = places.groupBy("doc_id", "h").agg(F.collect_list("line").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "gone")
    lines = F.split("text", "\n", -1)
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return joined.withColumn("lines", lines).select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n")).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table documents without its repeated lines."""
    return drop_repeated_windows(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
lines AS (
  SELECT doc_id, text, h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
filled AS (
  SELECT doc_id, text, h, trim(line, ' ') AS x, pos FROM lines WHERE trim(line, ' ') <> ''),
win AS (
  SELECT doc_id, text, h, x, pos, lead(x, 1) OVER w AS x2, lead(x, 2) OVER w AS x3, lead(pos, 1) OVER w AS p2, lead(pos, 2) OVER w AS p3
  FROM filled WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x, x2, x3 ORDER BY doc_id NULLS FIRST, h, pos) AS nth FROM win WHERE x3 IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, text, unnest([pos, p2, p3]) AS pos FROM ranked WHERE nth > 1),
kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS cleaned
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(k.cleaned, '') AS text, k.n_lines, k.n_removed
FROM documents d JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND coalesce(d.text, '') = k.text
"""
