"""Fill-in-the-middle forms of texts over an index of the different texts.

Rows are dealt by ranges of (hashes of the text, row), so that equal texts stand side by side and a
text that very many rows have is dealt over many tasks. There texts with equal hashes are compared
byte by byte: each different text becomes one entry with the ends of its units as an Elias-Fano list,
made once, and the ids of its documents. A document's cut takes two lookups in that list.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts

SEED = 42
#: Percent of texts that are cut, and percent of these with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Ids an entry has at most; a text with more documents has further entries.
ENTRY_IDS = 4096
#: Bytes of texts in an Arrow batch that is handed on.
OUT_BYTES = 4 << 20

_ENTRY = pa.schema(
    [("k1", pa.int64()), ("k2", pa.int64()), ("text", pa.binary()), ("n", pa.int64()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
)
ENTRY_TYPES = "k1 long, k2 long, text binary, n long, width int, low binary, high binary, doc_ids array<long>"
_CUT_TYPES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: Place of the k-th one of a byte, for every byte and k.
_NTH_ONE = np.array([([b for b in range(8) if byte >> b & 1] + [8] * 8)[:8] for byte in range(256)], np.int64)


def unit_ends(text: bytes) -> np.ndarray:
    """Where the units of a UTF-8 text end: words with the white space before them, and white space at the end."""
    a = np.frombuffer(text, np.uint8)
    blank = (a == 32) | ((a >= 9) & (a <= 13))
    last = ~blank
    last[:-1] &= blank[1:]
    if len(a) and blank[-1]:
        last[-1] = True
    return np.flatnonzero(last) + 1


def elias_fano(values: np.ndarray, top: int) -> tuple[int, bytes, bytes]:
    """(width, low, high) of a rising list of numbers up to top: low bits packed, the rest in unary."""
    n = len(values)
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = np.packbits((values[:, None] >> np.arange(width)) & 1, bitorder="little").tobytes() if width else b""
    ones = np.zeros(n + (top >> width) + 1, np.uint8)
    ones[(values >> width) + np.arange(n)] = 1
    return width, low, np.packbits(ones, bitorder="little").tobytes()


class EliasFano:
    """Lookups in such a list."""

    def __init__(self, width: int, low: bytes, high: bytes):
        self.width, self.low = width, np.frombuffer(low + bytes(8), np.uint8).astype(np.uint64)
        self.high = np.frombuffer(high, np.uint8)
        self.upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        """The k-th numbers, from 0."""
        at = np.searchsorted(self.upto, k, side="right")
        nth = k - self.upto[at] + np.bitwise_count(self.high[at])
        above = 8 * at + _NTH_ONE[self.high[at], nth] - k
        if not self.width:
            return above
        bit = k * self.width
        word = np.zeros(len(k), np.uint64)
        for j in range(8):
            word |= self.low[(bit >> 3) + j] << np.uint64(8 * j)
        below = (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return (above << self.width) | below.astype(np.int64)


def _entries(ids_limit: int):
    def run(batches):
        out, size = [], 0
        key, known = None, []  # the different texts with the key: [text, ids, coded]

        def entry(text, ids, coded):
            nonlocal size
            if coded[0] is None:
                ends = unit_ends(text)
                coded[0] = (len(ends), *elias_fano(ends, len(text)))
            n, width, low, high = coded[0]
            out.append((*key, text, n, width, low, high, ids))
            size += len(text) + len(low) + len(high)

        def rows():
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _ENTRY)], schema=_ENTRY)
            out, size = [], 0
            return made

        for b in batches:
            k1, k2, doc_ids = b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("doc_id").to_pylist()
            for k, t in enumerate(b.column("text")):
                text = t.as_py()
                if (k1[k], k2[k]) != key:
                    for one in known:
                        if one[1]:
                            entry(*one)
                    key, known = (k1[k], k2[k]), []
                    if size >= OUT_BYTES:
                        yield rows()
                one = next((x for x in known if x[0] == text), None)
                if one is None:
                    known.append(one := [text, [], [None]])
                one[1].append(doc_ids[k])
                if len(one[1]) >= ids_limit:
                    entry(*one)
                    one[1] = []
                    if size >= OUT_BYTES:
                        yield rows()
        for one in known:
            if one[1]:
                entry(*one)
        if out:
            yield rows()

    return run


def distinct_texts(docs: DataFrame, ids_limit: int = ENTRY_IDS) -> DataFrame:
    """The index: (k1, k2, text, n, width, low, high, doc_ids), an entry for each different text of docs (doc_id, text).

    k1 and k2 are hashes of the text, n the number of its units, (width, low, high) the Elias-Fano
    list of their ends in bytes. A text has a further entry for each ids_limit documents, and one
    more where the ranges that the rows are dealt by cut it. Texts whose hashes are equal have
    entries of their own if they differ. Null texts are empty; null and repeated doc_ids are listed
    as often as they come; an empty table gives an empty index; other columns are ignored.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(n, "k1", "k2", "row").sortWithinPartitions("k1", "k2")
    return dealt.select("k1", "k2", "text", "doc_id").mapInArrow(_entries(ids_limit), ENTRY_TYPES)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for a document; a null doc_id counts as an empty string."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def _letters(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def _cuts(seed: int, rate: int, suffix_first: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def rows_of(out):
        *first, output = zip(*out)
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(first, kinds)), pa.array(output, pa.binary()).view(pa.string())], names=names)

    def run(batches):
        out, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                text, n, ids = b.column("text")[k].as_py(), b.column("n")[k].as_py(), b.column("doc_ids")[k].as_py()
                whole = not text or any(m in text for m in marks)
                drawn = [draws(i, seed) for i in ids]
                if not whole:
                    first, second = (np.array([h[j] % (n + 1) for h in drawn], np.int64) for j in (0, 1))
                    ends = EliasFano(b.column("width")[k].as_py(), b.column("low")[k].as_py(), b.column("high")[k].as_py())
                    a, z = (np.where(x > 0, ends[np.maximum(x - 1, 0)], 0).tolist() for x in (np.minimum(first, second), np.maximum(first, second)))
                for j, (doc_id, h) in enumerate(zip(ids, drawn)):
                    if whole or h[2] % 100 >= rate:
                        out.append((doc_id, n, "plain", None, None, text))
                    else:
                        prefix, middle, suffix = text[: a[j]], text[a[j] : z[j]], text[z[j] :]
                        spm = h[3] % 100 < suffix_first
                        parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)
                        out.append((doc_id, n, "spm" if spm else "psm", _letters(prefix), _letters(middle), b"".join(parts)))
                    size += len(text)
                    if size >= OUT_BYTES:
                        yield rows_of(out)
                        out, size = [], 0
        if out:
            yield rows_of(out)

    return run


def select_cuts(index: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every document of an index of distinct_texts()."""
    return index.select("text", "n", "width", "low", "high", "doc_ids").mapInArrow(_cuts(seed, rate, suffix_first), _CUT_TYPES)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, ids_limit: int = ENTRY_IDS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text).

    A text is cut into n units; its document's draws choose two of their ends, which bound prefix,
    middle and suffix. output is `<P>`prefix`<S>`suffix`<M>`middle (psm), `<S>`suffix`<P>`prefix`<M>`middle
    (spm), or the text (plain: rate percent are not; null and empty texts, and those that hold a mark,
    always are, with null prefix_chars and middle_chars). A null text is empty, and so is the number of
    a null doc_id; repeated rows come out alike, as often as they went in; an empty table gives an
    empty one; other columns are ignored. Texts are shuffled once, whole, and never collected by key.
    """
    return select_cuts(distinct_texts(docs, ids_limit), seed, rate, suffix_first)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. (Each mark stands in it once: the text has none, and none arises where parts meet.)"""
    before = lambda mark: F.substring_index(output, mark, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substr(before(SUFFIX), F.lit(4)), middle, F.substring_index(before(MIDDLE), SUFFIX, -1))
    spm = F.concat(F.substring_index(before(MIDDLE), PREFIX, -1), middle, F.substr(before(PREFIX), F.lit(4)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of every document of the table documents, with digests of its output and of the text rebuilt from that."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
    ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:z], ''), '') AS mid, coalesce(array_to_string(u[z + 1:], ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
