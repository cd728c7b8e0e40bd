"""Groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Shingles are 64-bit hashes and have one order for all texts. Two sets that are similar enough share
at least k of the first n - ceil(0.8 n) + k shingles of each (prefix filter; k grows with n, so that
a common phrase is not enough). Shingles frequent in a sample of the texts come last in that order;
whatever is chosen there, no pair is lost. A shingle that few texts have in front gives their pairs,
and pairs met k times are candidates. Texts with many frequent shingles in front are joined through
these. Candidates only say which texts go to one task: there, sets are compared as they are, and
only links at 0.8 or more count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, batch_of, stored, within
from tessera.llm.components import connected_components

SIZE = 5
#: A shingle that more texts than this have in front gives no pairs.
RUN = 24
#: One of so many different texts is counted to find frequent shingles, which have at least SAMPLE_LEAST of them.
SAMPLE = 16
SAMPLE_LEAST = 4
#: Frequent shingles that come last; further ones keep their places.
FREQUENT = 200_000
#: Shingles and texts of a group that is one task; larger ones are cut into blocks of about as many.
BLOCK_SHINGLES = 2_000_000
BLOCK_TEXTS = 8192
CACHED_WORDS = 100_000

_FRONT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("front", pa.list_(pa.int64()))])
_MET = pa.schema([("frequent", pa.bool_()), ("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the different runs of size words (of the whole sequence, if shorter)."""
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = _mixed(h + words[k : k + n] + np.uint64(1))
    return np.unique(h)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, hashes: dict[str, int]) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted."""
    words = np.fromiter((hashes[w] for w in text.lower().split()), np.uint64)
    return _shingles(words, SIZE) if len(words) else words


def enough(overlap, a, b):
    """Whether sets of a and b shingles with this overlap are 0.8 alike."""
    return 9 * overlap >= 4 * (a + b)


def least_met(n):
    """Shingles that the fronts of two similar sets share at least, the smaller one having n."""
    return 1 + n // 20


def front_of(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles (sorted) of a set, frequent ones after the others."""
    n = len(found)
    size = n - (4 * n + 4) // 5 + least_met(n) if n else 0
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        last = frequent[at] == found
        found = np.concatenate((found[~last], found[last]))
    return found[:size]


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h) of the rows with a doc_id; h tells the texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def _frequent(rows: DataFrame) -> np.ndarray:
    schema = pa.schema([("s", pa.int64())])

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            found = [shingles(t, hashes) for t in b.column("text").to_pylist()]
            if found:
                yield batch_of(schema, np.concatenate(found).view(np.int64))

    some = rows.filter(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text")
    counts = some.mapInArrow(run, "s long").groupBy("s").count().filter(F.col("count") >= SAMPLE_LEAST)
    found = counts.orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").toArrow()
    return np.sort(found.column("s").to_numpy().view(np.uint64))


def _fronts(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, h, n, s0, s1, front): size, fingerprints and first shingles of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        last, hashes = shared.value, _Hashes()
        for b in batches:
            found = [shingles(t, hashes) for t in b.column("text").to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            s0 = np.array([np.bitwise_xor.reduce(_mixed(x)) for x in found], np.uint64).view(np.int64)
            s1 = np.array([np.add.reduce(_mixed(x + np.uint64(7))) for x in found], np.uint64).view(np.int64)
            fronts = [front_of(x, last) for x in found]
            ends = np.cumsum([0, *(len(x) for x in fronts)]).astype(np.int32)
            flat = np.concatenate(fronts) if fronts else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n), pa.array(s0), pa.array(s1), lists], schema=_FRONT)

    return rows.mapInArrow(run, "doc_id long, h long, n long, s0 long, s1 long, front array<long>")


def runs_met(run_limit: int):
    """From (s, id, n) sorted by s: pairs of ids of short runs and (s, id) of long ones."""

    def of(s, ids, n):
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.concatenate((start, [len(s)])))
        end = np.repeat(start + size, size)
        after = end - np.arange(len(s)) - 1
        a = np.repeat(np.arange(len(s)), after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        ok = (ids[a] != ids[b]) & (5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        return batch_of(_MET, np.zeros(len(a), bool), np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), least_met(np.minimum(n[a], n[b])))

    def long(s, ids, n):
        return batch_of(_MET, np.ones(len(s), bool), s, ids, least_met(4 * n // 5))

    def split(s, ids, n, known):
        """Runs that are complete but for rows of the shingle known to be long."""
        size = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
        many = np.repeat(size > run_limit, size) | (np.zeros(len(s), bool) if known is None else s == known)
        if many.any():
            yield long(s[many], ids[many], n[many])
        if not many.all():
            yield of(s[~many], ids[~many], n[~many])

    def run(batches):
        held, known = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                b = whole.slice(at, 20_000)
                now = tuple(b.column(c).to_numpy() for c in ("s", "id", "n"))
                if held is not None:
                    now = tuple(np.concatenate(x) for x in zip(held, now))
                last = int(np.searchsorted(now[0], now[0][-1], side="left"))
                if len(now[0]) - last > run_limit or now[0][-1] == known:
                    tail, last = now[0][-1], len(now[0])
                else:
                    tail = None
                if last:
                    yield from split(*(x[:last] for x in now), known)
                    known = tail
                held = tuple(x[last:] for x in now) if last < len(now[0]) else None
        if held is not None:
            yield from split(*held, known)

    return run


def candidates(nodes: DataFrame, run_limit: int = RUN) -> DataFrame:
    """Links (u, v) that connect all ids of nodes (id, n, front) whose sets are 0.8 alike, and others."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(F.explode("front").alias("s"), "id", "n").repartition(parts, "s").sortWithinPartitions("s")
    met = rows.mapInArrow(runs_met(run_limit), "frequent boolean, u long, v long, k long")
    met = stored(met.groupBy("frequent", "u", "v").agg(F.count("*").alias("c"), F.min("k").alias("k")), "shared-shingles")
    pairs, long = met.filter("not frequent"), met.filter("frequent")
    held = stored(long.groupBy(F.col("v").alias("id")).agg(F.sum("c").alias("f"), F.min("k").alias("k")), "frequent-shingles")
    of = lambda c: held.select(F.col("id").alias(c), F.col("f").alias(f"f{c}"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    both = both.filter(F.col("c") + F.least(F.coalesce("fu", F.lit(0)), F.coalesce("fv", F.lit(0))) >= F.col("k"))
    joined = long.join(held.filter("f >= k").select(F.col("id").alias("v")), "v", "left_semi")
    star = joined.join(joined.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("m").alias("u"), "v")
    return both.select("u", "v").unionByName(star).filter("u != v")


def alike_links(ids: np.ndarray, sets: list[np.ndarray]):
    """Links (u, v) that span the groups of sets that are 0.8 alike.

    Each set reached is held against those not reached yet; when these are fewer than half, the
    search goes on among them alone.
    """
    n = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(term))))
    start = np.cumsum(n) - n
    left = np.ones(len(sets), bool)
    u, v = [], []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        if seed and 2 * left.sum() <= len(sets):
            rest = np.flatnonzero(left)
            more = alike_links(ids[rest], [sets[k] for k in rest])
            return np.concatenate((np.array(u, np.int64), more[0])), np.concatenate((np.array(v, np.int64), more[1]))
        left[seed] = False
        waiting = [seed]
        while waiting and left.any():
            at = waiting.pop()
            mine = term[start[at] : start[at] + n[at]]
            size = first[mine + 1] - first[mine]
            where = np.repeat(first[mine] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            overlap = np.bincount(posting[where], minlength=len(sets))
            near = np.flatnonzero(left & (overlap > 0) & enough(overlap, n[at], n))
            left[near] = False
            waiting.extend(near.tolist())
            u += [ids[at]] * len(near)
            v += ids[near].tolist()
    return np.array(u, np.int64), np.array(v, np.int64)


def _verify():
    def links(ids, sets):
        u, v = alike_links(np.array(ids, np.int64), sets)
        return batch_of(_LINKS, u, v)

    def run(batches):
        key, ids, sets, hashes = None, [], [], _Hashes()
        for b in batches:
            for k, i, t in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                if k == key and i == ids[-1]:
                    continue
                if k != key:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(shingles(t.as_py(), hashes))
        if len(ids) > 1:
            yield links(ids, sets)

    return run


def _tasks(members: DataFrame, block_shingles: int, block_texts: int) -> DataFrame:
    """(id, h, key) for members (id, h, n, root): who goes to which task.

    A large group is cut by size, as sizes of similar sets have a ratio of at most 5/4, and each
    class of sizes into blocks; each two blocks of a class or of neighbouring classes are a task.
    """
    totals = members.groupBy("root").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    large = stored(totals.filter((F.col("t") > block_shingles) | (F.col("c") > block_texts)).select("root"), "large-groups")
    whole = members.join(large, "root", "left_anti").select("id", "h", F.struct("root", *[F.lit(0).cast("long").alias(c) for c in "abcd"]).alias("key"))
    cut = members.join(large, "root").withColumn("z", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("long"))
    sizes = cut.groupBy("root", "z").agg(F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_texts)).cast("long").alias("p"))
    sizes = stored(sizes, "size-classes")
    cut = cut.join(sizes, ["root", "z"]).withColumn("b", F.pmod(F.xxhash64("id", "z"), F.col("p")))
    for d in (-1, 1):
        cut = cut.join(sizes.select("root", (F.col("z") - d).alias("z"), F.col("p").alias("q" + str(d).replace("-", "m"))), ["root", "z"], "left")
    z, b, zero, one = F.col("z"), F.col("b"), F.lit(0).cast("long"), F.lit(1).cast("long")
    key = lambda *x: F.struct("root", *[c.alias(n) for c, n in zip(x, "abcd")])
    upto = lambda p: F.when(p.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(zero, p - one))
    keys = F.transform(upto(F.col("p")), lambda k: key(z, F.least(b, k), z, F.greatest(b, k)))
    above = F.transform(upto(F.col("q1")), lambda k: key(z, b, z + one, k))
    below = F.transform(upto(F.col("qm1")), lambda k: key(z - one, k, z, b))
    return whole.unionByName(cut.select("id", "h", F.explode(F.concat(keys, above, below)).alias("key")))


def similar_links(docs: DataFrame, nodes: DataFrame, run_limit: int = RUN, block_shingles: int = BLOCK_SHINGLES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Links (u, v) that connect all ids of nodes (id, h, n, front) whose texts in docs are 0.8 alike, and no others."""
    groups = connected_components(candidates(nodes, run_limit))
    members = stored(nodes.select("id", "h", "n").distinct().join(groups.withColumnRenamed("node", "id"), "id"), "candidates")
    tasks = stored(_tasks(members, block_shingles, block_texts).select(F.col("id").alias("doc_id"), "h", F.to_json("key").alias("key")), "tasks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _rows(docs).join(within(tasks, FEW_ROWS // 4), ["doc_id", "h"]).select("doc_id", "text", "key")
    return sent.repartition(parts, "key").sortWithinPartitions("key", "doc_id").mapInArrow(_verify(), "u long, v long").filter("u != v")


def representatives(docs: DataFrame, ids: DataFrame, run_limit: int = RUN, block_shingles: int = BLOCK_SHINGLES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Of ids (doc_id), the smallest of each group of texts of docs that links at 0.8 or more join.

    Texts without words are alike; shorter ones than five words have one shingle. Null doc_ids are
    left out; of rows that repeat a doc_id that with the smallest text hash counts; other columns
    are ignored; empty tables give an empty one.
    """
    rows = _rows(docs)
    held = stored(_fronts(rows, _frequent(rows)), "fronts")
    texts = held.groupBy("doc_id").agg(F.min(F.struct("h", "n", "s0", "s1")).alias("s")).select("doc_id", "s.*")
    texts = texts.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    nodes = texts.groupBy("s0", "s1", F.col("n").alias("size")).agg(F.min(F.struct(F.col("doc_id").alias("id"), "h", "n")).alias("f")).select("f.*")
    sets = stored(nodes, "shingle-sets")
    fronts = held.select(F.col("doc_id").alias("id"), "h", "front").join(within(sets), ["id", "h"])
    nodes = stored(fronts.select("id", "h", "n", "front"), "node-fronts")
    roots = connected_components(similar_links(docs, nodes, run_limit, block_shingles, block_texts))
    others = roots.filter("node != root").select(F.col("node").alias("id"))
    return sets.select("id").join(others, "id", "left_anti").select(F.col("id").alias("doc_id"))
