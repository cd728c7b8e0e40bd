"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is cut into two halves of 32 bits. Two fingerprints at most 3 bits apart have
a half in which they differ in at most one bit. The anchors of a half are the words of the perfect
Hamming [31, 26] code with a free last bit: 2^27 words with covering radius 1, so each half has a
home anchor within distance 1, and a half one bit away lies within distance 2 of that same anchor.
Every fingerprint goes to all anchors within 2 (covering radius plus the threshold of a half, 17 at
most per half) and is compared there with those at home: no link is lost, and as there are 2^28
anchors, the work per anchor stays small when the corpus grows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch_of, fresh, stored, texts, within
from tessera.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MAX_BITS = 3
#: An anchor with more fingerprints at home than this is split by the bytes of the other half.
HOT_ANCHOR = 4096
#: Fingerprint pairs compared at once.
BLOCK = 1 << 20

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fingerprint", pa.int64())])


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text, repeats counted; no words: 0."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    n, line = len(words), " ".join(words).encode("utf-8", "surrogatepass")
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    if n <= shingle:
        hashes = np.array([digest(line, seed)], np.uint64)
    else:
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.concatenate(([0], spaces + 1))
        ends = np.concatenate((spaces, [len(line)]))
        a, b = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        hashes = np.fromiter((digest(view[i:j], seed) for i, j in zip(a, b)), np.uint64, len(a))
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, h, fingerprint) of every row: h is a hash of the text, the fingerprint the signed long with these 64 bits."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(np.array(found, np.uint64).view(np.int64))], schema=_FINGERPRINTS)

    return texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(run, "doc_id long, h long, fingerprint long")


def _syndrome(word: np.ndarray) -> np.ndarray:
    s = np.zeros(len(word), np.uint32)
    for k in range(31):
        s ^= ((word >> np.uint32(k)) & np.uint32(1)) * np.uint32(k + 1)
    return s


_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < (i ^ s) and i != s and (i ^ s) != s] for s in range(32)]
_BIT = lambda k: np.uint32(1 << (k - 1)) if k else np.uint32(0)
_FLIPS = np.array([[_BIT(i) | _BIT(j) for i, j in (p + [(0, 0)] * 15)[:15]] for p in _PAIRS], np.uint32)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit words: (row, anchor, at home) of all code words within distance 2."""
    word, last = halves & np.uint32(0x7FFFFFFF), halves & np.uint32(0x80000000)
    s = _syndrome(word)
    home = np.where(s > 0, word ^ (np.uint32(1) << (np.maximum(s, 1) - np.uint32(1))), word)
    row = np.arange(len(halves))
    off = np.flatnonzero(s > 0)
    far = word[off, None] ^ _FLIPS[s[off]]
    rows = np.concatenate((row, row, np.repeat(off, 15)))
    found = np.concatenate((home | last, home | (last ^ np.uint32(0x80000000)), (far | last[off, None]).ravel()))
    return rows, found, np.arange(len(rows)) < len(halves)


def _spread(halves_of: tuple[int, ...] = (0, 1)):
    schema = pa.schema([("anchor", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])

    def run(batches):
        for b in batches:
            whole = b.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(whole), 20_000):
                fp = whole[k : k + 20_000]
                for half in halves_of:
                    part = ((fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows, found, home = anchors(part)
                    yield batch_of(schema, found.astype(np.int64) | (half << 32), fp[rows], home)

    return run


def _least_labels(home: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides of a large bucket after spreading the least one along all its links, block by block."""
    lh, ln = home.copy(), near.copy()
    step = max(1, BLOCK // max(1, len(near)))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    while True:
        was = (lh.copy(), ln.copy())
        for k in range(0, len(home), step):
            linked = np.bitwise_count(home[k : k + step, None] ^ near[None, :]) <= max_bits
            lh[k : k + step] = np.minimum(lh[k : k + step], np.where(linked, ln[None, :], top).min(axis=1))
            ln = np.minimum(ln, np.where(linked, lh[k : k + step, None], top).min(axis=0))
        if np.array_equal(was[0], lh) and np.array_equal(was[1], ln):
            return lh, ln


def _links_of(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int):
    """Links within complete buckets (sorted by anchor): pairs of small buckets, spanning links of large ones."""
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((start, [len(anchor)])))
    homes = np.add.reduceat(home.astype(np.int64), start)
    work = homes * size
    out = []
    small = (work > 0) & (size > 1) & (work <= 4096)
    bucket = np.repeat(np.arange(len(start)), size)
    rows = np.flatnonzero(home & small[bucket])
    cut = np.concatenate(([0], np.cumsum(size[bucket[rows]])))
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(cut, cut[at] + BLOCK, side="right")) - 1)
        mine = rows[at:to]
        n = size[bucket[mine]]
        left = np.repeat(mine, n)
        right = np.repeat(start[bucket[mine]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        a, b = fp[left], fp[right]
        ok = (a != b) & (np.bitwise_count(a ^ b) <= max_bits)
        if ok.any():
            out.append((a[ok], b[ok]))
        at = to
    for k in np.flatnonzero(work > 4096):
        s = slice(start[k], start[k] + size[k])
        near = np.unique(fp[s])
        at_home = np.unique(fp[s][home[s]])
        lh, ln = _least_labels(at_home, near, max_bits)
        for x, y in ((at_home, lh), (near, ln)):
            if (ok := x != y).any():
                out.append((x[ok], y[ok]))
    return out


def _compare(max_bits: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(parts):
        for a, b in parts:
            yield batch_of(schema, a.view(np.int64), b.view(np.int64))

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            now = (b.column("anchor").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("home").to_numpy(zero_copy_only=False))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            last = int(np.searchsorted(now[0], now[0][-1], side="left"))
            if last:
                yield from emit(_links_of(*(x[:last] for x in now), max_bits))
            held = tuple(x[last:] for x in now)
        if held is not None and len(held[0]):
            yield from emit(_links_of(*held, max_bits))

    return run


def links(nodes: DataFrame, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) at most max_bits (3 at most) apart.

    Small anchors give every pair, large ones the links of a spanning forest, so that the number of
    rows stays in proportion to the fingerprints. Where more than hot_anchor fingerprints are at
    home with one anchor, its members are dealt again by (anchor, k, byte k of the other half):
    among 4 bytes with at most 3 differing bits, one is equal.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("anchors of distance 2 per half cover at most 3 bits")
    spread = nodes.select("fp").mapInArrow(_spread(), "anchor long, fp long, home boolean")
    hot = stored(spread.filter("home").groupBy("anchor").count().filter(F.col("count") > hot_anchor).select("anchor"), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        marked = spread.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor", "left_semi")
        rest = spread.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "anchor", "left_anti")
        other = F.when(F.shiftright("anchor", 32) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
        pieces = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(other, 8 * k).bitwiseAND(255).alias("v")) for k in range(4)]))
        keyed = marked.select("anchor", "fp", "home", pieces.alias("p")).select(
            F.col("anchor").bitwiseOR(F.shiftleft(F.lit(4).cast("long") + F.col("p.k"), 42)).bitwiseOR(F.shiftleft(F.col("p.v").cast("long"), 34)).alias("anchor"), "fp", "home"
        )
        spread = rest.unionByName(keyed)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(max_bits), "u long, v long")


def components_of(prints: DataFrame, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(fp, component_id) for the different fingerprints of prints (doc_id, fingerprint)."""
    nodes = stored(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected_components(links(nodes, max_bits, hot_anchor))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    ids = linked.join(least, "root").select("fp", "least")
    return stored(nodes.join(ids, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of docs (doc_id, text).

    Rows whose fingerprints are at most max_bits apart are linked; component_id is the smallest
    doc_id that links reach, the row's own included. Null and empty texts have fingerprint 0 and
    are linked like others; rows with a null doc_id take part and get the component's id (null if
    it has no other); repeated rows come out as often as they went in; an empty table gives an
    empty one; other columns are ignored. Copies meet once, as one fingerprint, before anything is
    compared, and only links between different fingerprints become rows.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    ids = components_of(prints, max_bits, hot_anchor)
    return prints.join(ids, prints.fingerprint == ids.fp).select("doc_id", "fingerprint", "component_id")


def keep_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (doc_id), one a doc_id, and all rows without a doc_id.

    Of rows that repeat a doc_id that with the smallest text hash stays (null texts hash as empty
    ones; equal texts: that with the smallest hash of all columns): hashes are aggregated first, so
    that an id that very many rows have is a row a task. No column of docs clashes. Only
    ids are sorted out by shuffles: texts move where the ids that go, or those that come more than
    once, are too many to broadcast.
    """
    counts = docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    kept = counts.join(ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("stays")).distinct(), "doc_id", "left")
    odd = stored(kept.filter("stays is null or n > 1").select("doc_id", F.col("stays").isNotNull().alias("again")), "odd-ids")
    gone, again = within(odd.filter("not again").select("doc_id")), within(odd.filter("again").select("doc_id"))
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    mine, least, text = fresh(docs, "mine"), fresh(docs, "least"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind]
    repeated = rest.join(again, "doc_id", "left_semi").select(*docs.columns, F.struct(F.xxhash64(text), F.xxhash64(*plain)).alias(mine))
    first = stored(repeated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(mine).alias(least)), "least-rows")
    repeated = repeated.join(within(first), "doc_id").filter(F.col(mine) == F.col(least)).select(*docs.columns).dropDuplicates(["doc_id"])
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)


def first_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id): the smallest of each component.

    A doc_id that comes with different texts stands for that with the smallest text hash, which
    keep_rows() keeps. Null doc_ids are left out; an empty table gives an empty one.
    """
    prints = fingerprints(docs.filter("doc_id is not null"), shingle)
    prints = prints.groupBy("doc_id").agg(F.min(F.struct("h", "fingerprint")).alias("s")).select("doc_id", F.col("s.fingerprint").alias("fingerprint"))
    prints = stored(prints, "fingerprints")
    ids = components_of(prints, max_bits).withColumnRenamed("fp", "fingerprint")
    return prints.join(ids, "fingerprint").filter("doc_id = component_id").select("doc_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id.

    Of rows that repeat that doc_id one stays (the one with the smallest text hash). Rows with a
    null doc_id can't be named by a component and pass unchanged. Columns are those of docs.
    """
    return keep_rows(docs, first_of_each(docs, shingle, max_bits))


def op7_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document of the table documents."""
    from tessera.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
