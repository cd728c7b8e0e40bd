"""Collocations: phrases of a few words that are more frequent than their parts suggest.

Texts are cut into pieces, and equal pieces of a language become one row with a multiplicity. Tasks
count the word sequences of their pieces, weighted, and deal them to hash buckets, where DuckDB sums
them, on disk where memory is short. Sequences of three words and more are only sent if both shorter
ones within may be frequent, as a bit field of fixed size tells. A phrase asks for the counts of
its parts by rows that are shuffled to the parts.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stored, table, within

LONGEST = 3
#: Least count of a phrase, and the percent of its count that makes a longer phrase replace it.
LEAST, SHARE = 10, 50
#: Phrases a language has in the report.
TOP = 2000
#: Ranks are first taken within so many parts of a language.
RANK_PARTS = 64
#: Bits of the field that tells which sequences may be frequent: 8 MB. When it is full, it leaves none out.
FIELD_BITS = 26
#: Bytes of pieces whose sequences are counted at once, and DuckDB's memory for a bucket.
PIECE_BYTES = 4 << 20
BUCKET_MEMORY = "256MB"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t", "abcdefghijklmnopqrstuvwxyz "
_COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("k", pa.int32()), ("n", pa.int64())])
_COUNTED_TYPES = "lang string, gram string, k int, n long"
#: What tasks send to a bucket: sequences (words apart by blanks, sequences by line feeds, which no word has) and their counts, compressed.
_SENT = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("k", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_SENT_TYPES = "bucket int, lang string, k int, grams binary, counts binary"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): the different pieces of docs (lang, text), in lower case, and how often each occurs."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.translate(F.col("text").cast("string"), _UPPER, _LOWER).alias("text"))
    cut = rows.select("lang", F.explode(F.split("text", r"[.,;:!?\x0A-\x0D]")).alias("piece")).select("lang", F.trim("piece").alias("piece"))
    return cut.filter("piece != ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def _sequence_hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """A hash of each sequence; words: the hashes of the first words, of the second ones and so on."""
    h = np.full(len(words[0]), _hash(lang), np.uint64)
    for w in words:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def _bit_of(lang: str, words: list[np.ndarray]) -> np.ndarray:
    return (_sequence_hash(lang, words) >> np.uint64(64 - FIELD_BITS)).astype(np.int64)


def _packed(lang: str, k: int, grams: pa.Array, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Counts of sequences as a row for each bucket."""
    press = zstandard.ZstdCompressor(level=3)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(n)])).astype(np.int32)), grams.take(pa.array(order)))
    joined, counts = pc.binary_join(lists, "\n"), np.split(n[order], first[1:])
    columns = [bucket[order][first].astype(np.int32), [lang] * len(first), [k] * len(first), [press.compress(x.as_py().encode()) for x in joined], [press.compress(x.tobytes()) for x in counts]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _unpacked(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for r in range(b.num_rows):
        grams = pc.split_pattern(pa.array([unpress.decompress(b.column("grams")[r].as_py()).decode()]), "\n").values
        n = np.frombuffer(unpress.decompress(b.column("counts")[r].as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.repeat(b.column("lang")[r], len(n)), grams, pa.repeat(b.column("k")[r], len(n)), pa.array(n)], schema=_COUNTED)


def _sequences(longest: int, field: np.ndarray | None, buckets: int):
    """Weighted counts of the sequences of pieces, by bucket: up to two words and all words together (''), or, with a field, of longest words."""

    def rows(lang, words, hashes, code, sel, m, weight):
        key = code[sel]
        for j in range(1, m):
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(words) + code[sel + j]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        codes = [code[sel[first] + j] for j in range(m)]
        n = np.zeros(len(first), np.int64)
        np.add.at(n, which, weight[sel])
        parts = [words.take(pa.array(c)) for c in codes]
        bucket = _sequence_hash(lang, [hashes[c] for c in codes]) % np.uint64(buckets)
        return _packed(lang, m, parts[0] if m == 1 else pc.binary_join_element_wise(*parts, " "), n, bucket)

    def counted(lang, b):
        lists = pc.split_pattern(b.column("piece"), " ")
        owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
        words = lists.flatten()
        full = pc.greater(pc.binary_length(words), 0)
        owner, coded = owner[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
        weight, code, words = b.column("n").to_numpy()[owner], coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if not len(code):
            return
        starts = lambda m: np.flatnonzero(owner[: len(owner) - m + 1] == owner[m - 1 :]) if len(owner) >= m else np.zeros(0, np.int64)
        hashes = np.array([_hash(w) for w in words.to_pylist()], np.uint64)
        if field is None:
            yield _packed(lang, 0, pa.array([""]), np.array([weight.sum()]), np.zeros(1, np.int64))
            for m in range(1, min(2, longest) + 1):
                if len(sel := starts(m)):
                    yield rows(lang, words, hashes, code, sel, m, weight)
            return
        sel, m = starts(longest), longest
        for ahead in (0, 1):
            bit = _bit_of(lang, [hashes[code[sel + ahead + j]] for j in range(m - 1)])
            sel = sel[(field[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
        if len(sel):
            yield rows(lang, words, hashes, code, sel, m, weight)

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "piece", PIECE_BYTES):
                langs = b.column("lang").dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    yield from counted(lang, b.filter(pc.equal(langs.indices, k)))

    return run


def _bucket(least: int, memory: str):
    """The sums of a bucket's counts that are at least so many, by DuckDB."""

    def run(batches):
        import duckdb

        spill = tempfile.mkdtemp(prefix="bucket-")
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            con.register("counts", pa.RecordBatchReader.from_batches(_COUNTED, (x for b in batches for x in _unpacked(b))))
            found = con.sql(f"SELECT lang, gram, any_value(k) AS k, sum(n)::BIGINT AS n FROM counts GROUP BY lang, gram HAVING sum(n) >= {int(least)}")
            for b in found.to_arrow_reader(10_000):
                yield b.cast(_COUNTED)
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


def _field(frequent: DataFrame) -> np.ndarray:
    """A bit field in which the sequences of frequent (lang, gram) have their bits."""
    schema = pa.schema([("at", pa.int64()), ("bit", pa.int64())])

    def run(batches):
        for b in batches:
            langs, words = b.column("lang").to_pylist(), [g.split(" ") for g in b.column("gram").to_pylist()]
            for lang in set(langs):
                some = [w for w, x in zip(words, langs) if x == lang]
                bits = _bit_of(lang, [np.array([_hash(x) for x in c], np.uint64) for c in zip(*some)])
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], schema=schema)

    parts = frequent.select("lang", "gram").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.uint64)
    field[parts.column("at").to_numpy()] = parts.column("bit").to_numpy().view(np.uint64)
    return field


def sequence_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, memory: str = BUCKET_MEMORY) -> DataFrame:
    """(lang, gram, k, n): the sequences of 1 to longest words within pieces that occur at least so often, and all words ('', k 0).

    A written table. Null texts have no pieces, a null lang is und; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = stored(pieces(docs), "pieces")

    def counts(m: int, field: np.ndarray | None) -> DataFrame:
        sent = held.mapInArrow(_sequences(m, field, parts), _SENT_TYPES).repartitionById(parts, F.col("bucket"))
        return stored(sent.mapInArrow(_bucket(least, memory), _COUNTED_TYPES), "sequences")

    found = last = counts(min(2, longest), None)
    for m in range(3, longest + 1):
        last = counts(m, _field(last.filter(F.col("k") == m - 1)))
        found = found.unionByName(last)
    return found


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, memory: str = BUCKET_MEMORY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of each lang of docs (lang, text).

    Phrases have 2 to longest words and occur at least so often (a) within pieces of one lang, which
    end at .,;:!? and line breaks; A-Z count as a-z. A phrase cut in two has parts of counts l and r
    and the score floor(1000000 a a / (l r)); its lowest score counts, of equal ones that of the
    shortest first part. A phrase whose words a longer one has, with share percent of its count or
    more, is left out. n is the number of words of the lang. Ranks go by score and count, falling,
    then by the phrase's bytes. Null texts have no words, a null lang is und, rows that repeat each
    count, an empty table or one without frequent phrases gives an empty one, other columns are
    ignored. Counts must be below 10^15.
    """
    counts = sequence_counts(docs, longest, least, memory)
    words = F.split("gram", " ")
    phrases = counts.filter("k >= 2").select("lang", "gram", "k", "n", words.alias("w"))
    join = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    one = F.lit(1)
    parts = F.flatten(
        F.transform(
            F.sequence(one, F.col("k") - 1),
            lambda j: F.array(F.struct(j.alias("cut"), F.lit(True).alias("left"), join(one, j).alias("part")), F.struct(j.alias("cut"), F.lit(False).alias("left"), join(j + 1, F.col("k") - j).alias("part"))),
        )
    )
    asked = phrases.select("lang", "gram", F.col("n").alias("a"), F.explode(parts).alias("p")).select("lang", "gram", "a", "p.*")
    answers = asked.join(counts.filter("k > 0").select("lang", F.col("gram").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    cuts = answers.groupBy("lang", "gram", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    big = lambda c: F.col(c).cast("decimal(16,0)")
    exact = cuts.withColumns({"x": (big("a") * big("a")).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"), "y": big("l") * big("r")})
    scored = exact.withColumn("score", F.expr("x div y"))
    best = scored.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "gram", "a", "s.score", "s.l", "s.r")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(one, F.col("k") - m + 1), lambda at: join(at, m))))
    longer = phrases.filter("k >= 3").select("lang", "n", F.explode(F.array_distinct(inner)).alias("gram")).groupBy("lang", "gram").agg(F.max("n").alias("over"))
    kept = best.join(longer, ["lang", "gram"], "left").filter(F.col("over").isNull() | (100 * F.col("over") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(RANK_PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = within(counts.filter("k = 0").select("lang", F.col("n")))
    return ranked.join(totals, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def op12_weighted_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of the table documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
folded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS m FROM pieces GROUP BY lang, piece),
totals AS (SELECT lang, sum(len(w) * m)::BIGINT AS n FROM folded GROUP BY lang),
grams AS (
  SELECT lang, m, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM folded, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k),
f AS (SELECT lang, g, k, sum(m)::BIGINT AS c FROM grams GROUP BY lang, g, k HAVING sum(m) >= 10),
p AS (SELECT lang, g, k, c AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT lang, g, k, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM p, (VALUES (1), (2)) js(j) WHERE j < k),
scored AS (
  SELECT cut.lang, cut.g, cut.a, j, fl.c AS l, fr.c AS r, (1000000::HUGEINT * a * a // (fl.c::HUGEINT * fr.c))::BIGINT AS score
  FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.g = cut.x JOIN f fr ON fr.lang = cut.lang AND fr.g = cut.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
over AS (
  SELECT lang, g, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM p WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM p WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT best.* FROM best LEFT JOIN over USING (lang, g) WHERE over.a IS NULL OR 100 * over.a < 50 * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
