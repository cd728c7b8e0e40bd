"""Near-duplicates by an inverted join of MinHash signature coordinates, confirmed on full sets.

A text's set of word shingles has a signature of 64 coordinates, 32 bits each. Equal sets meet
first, as one node, so that copies are never compared. Every (coordinate, value) is a posting
list of nodes; two nodes collide in as many lists as their signatures have equal coordinates. Sets
0.8 alike collide in 51 of 64 on average; pairs below 30 are dropped (chance below 4e-8 for such a
pair). Lists are merged by prefix: of each node only the 48 rarest coordinates are posted (lists
that a sample shows to be long come last in one order for all nodes), in which two such nodes still
share 14. Long lists are skipped: they give no pairs, each node counts how many of them it is
on, a pair needs so many fewer collisions in the short ones, and nodes that could collide in long
lists alone are joined through these. What is left is compared set by set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FEW_ROWS, batch_of, stored, table, texts, within
from tessera.llm.components import connected_components
from tessera.llm.jaccard import alike_links, enough, runs_met

SHINGLE = 4
COORDINATES = 64
#: Equal coordinates that a pair has at least, and coordinates that are posted.
MATCHES, PREFIX = 30, 48
#: A list with more nodes gives no pairs.
RUN = 24
#: One of so many nodes is counted to find long lists, of which so many at most come last.
SAMPLE, LONG_LISTS = 16, 1_000_000
#: Texts and shingles of a group that is one task; larger groups have a pivot and are cut into blocks of about as many.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 2_000_000
#: Coordinates that a pivot is chosen by; any choice gives the same links.
PIVOT_COORDINATES = 16
CACHED_WORDS = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SIGNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("sig", pa.binary())])
_POSTED = pa.schema([("s", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_SEEDS = np.random.default_rng(42).integers(1 << 62, size=(2, COORDINATES // 2, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the different runs of size words of a UTF-8 text, sorted; of the whole sequence, if it is shorter; none without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = _mixed(h + w[k : k + n])
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    """The least of each of 64 hashes of 32 bits over a set."""
    least = np.full((COORDINATES // 2, 2), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(found), 2048):
        y = (found[k : k + 2048] ^ _SEEDS[0]) * _SEEDS[1]
        y ^= y >> np.uint64(31)
        y *= np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(32)
        np.minimum(least, y.view(np.uint32).reshape(COORDINATES // 2, -1, 2).min(axis=1), out=least)
    return least.ravel()


def signed(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, h, n, s0, s1, sig) of every row: hash of the text, size, two hashes and the signature of its set."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            found = [shingles(t.as_py(), hashes, size) for t in b.column("text")]
            n = np.array([len(x) for x in found], np.int64)
            s0 = np.array([np.bitwise_xor.reduce(_mixed(x)) if len(x) else 0 for x in found], np.uint64).view(np.int64)
            s1 = np.array([np.add.reduce(_mixed(x + np.uint64(7))) if len(x) else 0 for x in found], np.uint64).view(np.int64)
            sig = pa.array([signature(x).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n), pa.array(s0), pa.array(s1), sig], schema=_SIGNED)

    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, n long, s0 long, s1 long, sig binary")


def _coordinates(sigs: pa.Array) -> np.ndarray:
    """A row a signature: each coordinate's number above its value."""
    values = np.frombuffer(b"".join(x.as_py() for x in sigs), np.uint32).reshape(-1, COORDINATES)
    return values.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)


def _post(last: np.ndarray | None, prefix: int, long: bool):
    """(s, id, n) of the first coordinates of each node: of those in last (sorted), which come after the others, or of the others."""

    def run(batches):
        order = np.zeros(0, np.int64) if last is None else last
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                s = _coordinates(b.column("sig"))
                late = order[np.minimum(np.searchsorted(order, s), len(order) - 1)] == s if len(order) else np.zeros(s.shape, bool)
                first = np.argsort(late, axis=1, kind="stable")[:, :prefix]
                s, late = np.take_along_axis(s, first, 1), np.take_along_axis(late, first, 1)
                row, at = np.nonzero(late == long)
                yield batch_of(_POSTED, s[row, at], b.column("id").to_numpy()[row], b.column("n").to_numpy()[row])

    return run


def _probe(matches: int):
    """Of pairs with both signatures those with enough equal coordinates."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                b = whole.slice(k, 4096)
                same = (_coordinates(b.column("su")) == _coordinates(b.column("sv"))).sum(axis=1) >= matches
                yield batch_of(_LINKS, b.column("u").to_numpy()[same], b.column("v").to_numpy()[same])

    return run


def long_lists(nodes: DataFrame, run_limit: int = RUN) -> np.ndarray:
    """Lists that are longer than run_limit even in a sample of the nodes, sorted: LONG_LISTS of them at most, the longest ones."""
    some = nodes.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "n", "sig")
    lists = some.mapInArrow(_post(None, COORDINATES, False), "s long, id long, n long").groupBy("s").count()
    found = lists.filter(F.col("count") > run_limit).orderBy(F.desc("count"), "s").limit(LONG_LISTS).select("s").toArrow()
    return np.sort(found.column("s").to_numpy())


def candidates(nodes: DataFrame, run_limit: int = RUN, matches: int = MATCHES, prefix: int = PREFIX) -> DataFrame:
    """Links (u, v) that connect all ids of nodes (id, n, sig) with enough equal coordinates, and others."""
    spark = nodes.sparkSession
    parts, need = int(spark.conf.get("spark.sql.shuffle.partitions")), matches - (COORDINATES - prefix)
    last, types = long_lists(nodes, run_limit), "s long, id long, n long"
    rows = nodes.select("id", "n", "sig")
    short = rows.mapInArrow(_post(last, prefix, False), types).repartition(parts, "s").sortWithinPartitions("s")
    met = short.mapInArrow(runs_met(run_limit), "frequent boolean, u long, v long, k long")
    met = stored(met.groupBy("frequent", "u", "v").agg(F.count("*").alias("c")), "collisions")
    on = met.filter("frequent").select("u", "v")
    if len(last):
        on = on.unionByName(rows.mapInArrow(_post(last, prefix, True), types).select(F.col("s").alias("u"), F.col("id").alias("v")))
    on = stored(on, "long-lists")
    skipped = stored(on.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("f")), "skipped")
    of = lambda c: skipped.select(F.col("id").alias(c), F.col("f").alias(f"f{c}"))
    pairs = met.filter("not frequent").join(of("u"), "u", "left").join(of("v"), "v", "left")
    pairs = pairs.filter(F.col("c") + F.least(F.coalesce("fu", F.lit(0)), F.coalesce("fv", F.lit(0))) >= need).select("u", "v")
    sigs = nodes.select("id", "sig")
    both = pairs.join(sigs.toDF("u", "su"), "u").join(sigs.toDF("v", "sv"), "v").select("u", "v", "su", "sv")
    probed = both.mapInArrow(_probe(matches), "u long, v long")
    alone = stored(on.join(skipped.filter(F.col("f") >= need).select(F.col("id").alias("v")), "v", "left_semi").select("u", "v"), "long-alone")
    least = stored(alone.groupBy("u").agg(F.min("v").alias("m")), "least-of-lists")
    return probed.unionByName(alone.join(least, "u").select(F.col("m").alias("u"), "v").filter("u != v"))


def _confirm(size: int):
    """Links among the texts of a task (key, id, text), whose rows follow one another."""

    def links(ids, sets):
        u, v = alike_links(np.array(ids, np.int64), sets)
        return batch_of(_LINKS, u, v)

    def run(batches):
        key, ids, sets, hashes = None, [], [], _Hashes()
        for b in batches:
            for k, i, t in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), b.column("text")):
                if k == key and i == ids[-1]:
                    continue
                if k != key:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(shingles(t.as_py(), hashes, size))
        if len(ids) > 1:
            yield links(ids, sets)

    return run


def _with_pivot(size: int):
    """Links (pivot, id) of the texts that are alike their group's pivot."""

    def run(batches):
        hashes, last, held = _Hashes(), None, None
        for b in batches:
            u, v = [], []
            for pivot, i, t, p in zip(b.column("pivot").to_pylist(), b.column("id").to_pylist(), b.column("text"), b.column("pivot_text")):
                if pivot != last:
                    last, held = pivot, shingles(p.as_py(), hashes, size)
                mine = shingles(t.as_py(), hashes, size)
                if i != pivot and enough(len(np.intersect1d(mine, held, assume_unique=True)), len(mine), len(held)):
                    u.append(pivot)
                    v.append(i)
            yield batch_of(_LINKS, u, v)

    return run


def _pivots(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, pivot): of each group of members (id, root) the node that has most of the commonest values of the first coordinates."""
    parts = stored(members.join(nodes.select("id", "sig"), "id").select("root", "id", F.substring("sig", 1, 4 * PIVOT_COORDINATES).alias("sig")), "large-signatures")
    value = lambda k: F.col("sig").substr(4 * k + 1, F.lit(4))
    every = F.sequence(F.lit(0), F.lit(PIVOT_COORDINATES - 1))
    lists = parts.select("root", F.explode(F.transform(every, lambda k: F.struct(k.alias("k"), value(k).alias("s")))).alias("p"))
    counts = lists.groupBy("root", "p.k", "p.s").agg(F.count("*").alias("c"))
    common = counts.groupBy("root", "k").agg(F.max(F.struct("c", "s")).alias("m")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("k", "m.s"))).alias("common"))
    shared = parts.join(stored(common, "common-values"), "root").select("root", "id", F.size(F.filter(every, lambda k: value(k) == F.col("common")[k])).alias("c"))
    return shared.groupBy("root").agg(F.max(F.struct("c", (-F.col("id")).alias("id"))).alias("m")).select("root", (-F.col("m.id")).alias("pivot"))


def _blocks(members: DataFrame, block_texts: int, block_shingles: int) -> DataFrame:
    """(id, key) for members (id, n, root, settled) of large groups: who goes to which task.

    Those that are settled (alike the pivot) form one component already, so no two of them need to
    meet. The others meet all: sizes of sets that are alike have a ratio of at most 5/4, so members
    are cut into classes of sizes and each class into blocks, and each two blocks of a class or of
    neighbouring classes are a task, unless both are settled.
    """
    cut = members.withColumn("z", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("long"))
    blocks = F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block_texts)).cast("long")
    sizes = stored(cut.groupBy("root", "z", "settled").agg(blocks.alias("p")), "size-classes")
    of = lambda settled, name: sizes.filter(F.col("settled") == settled).select("root", "z", F.col("p").alias(name))
    open_, done = of(False, "po"), of(True, "pd")
    both = stored(open_.join(done, ["root", "z"], "full"), "block-counts")
    cut = cut.join(sizes, ["root", "z", "settled"]).withColumn("b", F.pmod(F.xxhash64("id", "z"), F.col("p")))
    mine, upto = F.struct("z", "settled", "b"), lambda p: F.when(p > 0, F.sequence(F.lit(0).cast("long"), p - F.lit(1).cast("long")))

    def pairs(p, d: int, settled: bool):
        """Keys of a member's block with each of the p blocks d classes above."""
        other = lambda k: F.struct((F.col("z") + d).alias("z"), F.lit(settled).alias("settled"), k.alias("b"))
        keys = F.transform(upto(p), lambda k: F.struct("root", F.least(mine, other(k)).alias("low"), F.greatest(mine, other(k)).alias("high")))
        return F.coalesce(keys, F.array())

    keys = []
    for d in (-1, 0, 1):
        o, s = f"po{d + 1}", f"pd{d + 1}"
        cut = cut.join(both.select("root", (F.col("z") - d).alias("z"), F.col("po").alias(o), F.col("pd").alias(s)), ["root", "z"], "left")
        keys += [pairs(F.col(o), d, False), pairs(F.when(~F.col("settled"), F.col(s)), d, True)]
    return cut.select("id", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))


def confirmed_links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, run_limit: int = RUN, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) that connect all ids of nodes (id, doc_id, h, n, sig) whose sets in docs are 0.8 alike, and no others."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = connected_components(candidates(nodes, run_limit))
    members = stored(nodes.select("id", "doc_id", "h", "n").join(groups.withColumnRenamed("node", "id"), "id"), "members")
    totals = members.groupBy("root").agg(F.sum("n").alias("t"), F.count("*").alias("c"))
    large = stored(totals.filter((F.col("t") > block_shingles) | (F.col("c") > block_texts)).select("root"), "large-groups")
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))

    def sent(some: DataFrame) -> DataFrame:
        """The texts of some (doc_id, h, ...) nodes."""
        asked = within(some.withColumnRenamed("doc_id", "d"), FEW_ROWS // 4)
        return rows.join(asked, ["h"]).filter(F.col("doc_id").eqNullSafe(F.col("d"))).drop("d", "h", "doc_id")

    def checked(tasks: DataFrame) -> DataFrame:
        return sent(tasks).select("key", "id", "text").repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(_confirm(size), "u long, v long")

    small = members.join(within(large), "root", "left_anti")
    links = checked(stored(small.select("doc_id", "h", "id", F.col("root").cast("string").alias("key")), "tasks"))
    if large.isEmpty():
        return links
    wide = stored(members.join(within(large), "root", "left_semi").select("id", "doc_id", "h", "n", "root"), "large-members")
    pivots = stored(_pivots(wide.select("id", "root"), nodes), "pivots")
    with_pivot = stored(wide.join(pivots, "root").select("doc_id", "h", "id", "pivot"), "with-pivot")
    pivot_texts = stored(sent(with_pivot.filter("id = pivot").select("doc_id", "h", "pivot")).dropDuplicates(["pivot"]).withColumnRenamed("text", "pivot_text"), "pivot-texts")
    near = sent(with_pivot).join(pivot_texts, "pivot").select("pivot", "id", "text", "pivot_text").mapInArrow(_with_pivot(size), "u long, v long")
    near = stored(near, "pivot-links").distinct()
    settled = stored(near.select(F.col("v").alias("id")).unionByName(pivots.select(F.col("pivot").alias("id"))).distinct(), "settled")
    marked = stored(wide.join(settled.withColumn("settled", F.lit(True)), "id", "left").withColumn("settled", F.coalesce("settled", F.lit(False))), "marked")
    tasks = stored(_blocks(marked.select("id", "n", "root", "settled"), block_texts, block_shingles).join(wide.select("id", "doc_id", "h"), "id").select("doc_id", "h", "id", F.to_json("key").alias("key")), "block-tasks")
    return links.unionByName(checked(tasks)).unionByName(near)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, run_limit: int = RUN, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Rows are linked where 100 times the shingles of both is at least 80 times those of either.
    component_id is the smallest doc_id that links reach, the row's own included; kept says whether
    it is the row's own. A text with fewer words than a shingle has one; null and empty texts and
    those without words have none and are linked with nothing. Rows with a null doc_id take part and
    get the component's id (null, and kept, if it has no other); repeated rows come out as often as
    they went in, each kept or not like the other; an empty table gives an empty one; other columns
    are ignored.
    """
    prints = stored(signed(docs, size), "signatures")
    nodes = prints.filter("n > 0").groupBy("s0", "s1", "n").agg(F.min("doc_id").alias("first"), F.min(F.struct("h", "doc_id")).alias("r"), F.min("sig").alias("sig"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("id"), "s0", "s1", "n", "first", "r.doc_id", "r.h", "sig"), "nodes")
    links = confirmed_links(docs, nodes.select("id", "doc_id", "h", "n", "sig"), size, run_limit, block_texts, block_shingles)
    roots = connected_components(links)
    held = nodes.select("id", "first").join(roots.withColumnRenamed("node", "id"), "id")
    least = stored(held.groupBy("root").agg(F.min("first").alias("least")), "least")
    ids = stored(nodes.select("id", "s0", "s1", "n").join(held.join(least, "root").select("id", "least"), "id").select("s0", "s1", "n", "least"), "components")
    firsts = nodes.select("s0", "s1", "n", "first").join(ids, ["s0", "s1", "n"], "left").select("s0", "s1", "n", F.coalesce("least", "first").alias("least"))
    firsts = stored(firsts, "first-of-sets")
    found = prints.select("doc_id", "n", "s0", "s1").join(firsts, ["s0", "s1", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document of the table documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x
  FROM d WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT u, v FROM met JOIN c a ON a.doc_id = u JOIN c b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS MATERIALIZED (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT u AS doc_id, u AS r FROM both_ways UNION SELECT e.v, reach.r FROM reach JOIN both_ways e ON e.u = reach.doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.r, d.doc_id) AS component_id, coalesce(m.r, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) m USING (doc_id)
"""
