"""Benchmark decontamination: BM25 with block-max WAND over an index of the test items, then a check of question and answer."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch_of, small_batches, stored, table, texts, within

# Ranges of letters of scripts that put no blanks between words (Thai to Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Words; letters of those scripts are one each, so that triples of words are their 3-grams. Texts without any are read by the plain pattern.
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
PLAIN_WORD, ANY_UNSPACED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]")
K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach.
MIN_SCORE = 0.6
#: Share of the question's word triples, and of the answer's words, that must stand around the passage.
MIN_OVERLAP = 0.6
#: A block of items, indexed and broadcast at once, has about this many bytes of text; further items make further blocks.
ITEM_BYTES = 4 << 20
#: Passages are windows of twice this many words, one beginning every so many words; for items of more words the next power of two times this.
STRIDE = 64
POSTINGS_A_BLOCK = 8
#: Groups of items with bounds of their own in the second bound on passages.
GROUPS = 64
#: Parts of a score that these bounds are counted in.
UNITS = 65_535
#: Terms of little weight, together at most this share of a score, are left out of the first bound.
SLACK = 0.15
#: Cells of the bounds over all blocks: a term's bound is the greatest weight in its cell.
CELLS = 1 << 18
CACHED_WORDS = 100_000


def words(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        pattern = PLAIN_WORD
    except UnicodeEncodeError:
        pattern = WORD if ANY_UNSPACED.search(text) else PLAIN_WORD
    return pattern.findall(text.lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last line, or else the last sentence; a single sentence is all question."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", text) if WORD.search(x)]
    return (words(" ".join(lines[:-1])), words(lines[-1])) if len(lines) > 1 else (words(text), [])


def stride_of(n_words: int) -> int:
    """The stride of the passages that are searched for an item: it depends on the item alone."""
    return STRIDE << max(0, math.ceil(n_words / STRIDE) - 1).bit_length()


def weights_of(held: list[str], df: dict[str, int], n_items: int, mean_length: float) -> dict[str, float]:
    """BM25 weights of an item's terms as shares of its own score."""
    impact = {}
    for w, tf in Counter(held).items():
        idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
        impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(held) / mean_length))
    own = sum(impact.values())
    return {w: x / own for w, x in impact.items()}


def tiles_of(lengths: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each tile, first tile of each document, whether the next tile is of the same document)."""
    tiles = -(-lengths // stride)
    doc = np.repeat(np.arange(len(lengths)), tiles)
    follows = np.zeros(len(doc), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    return doc, np.cumsum(tiles) - tiles, follows


def likely_tiles(ids: np.ndarray, lengths: np.ndarray, stride: int, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of stride words that reach least with the next one, each different id counting its bound.

    ids are those of all documents' words, one after the other; -1 counts nothing. Also returns each
    word's tile, and documents and first tiles as tiles_of() gives them.
    """
    doc, first, follows = tiles_of(lengths, stride)
    word_doc = np.repeat(np.arange(len(lengths)), lengths)
    tile = first[word_doc] + (np.arange(len(ids)) - (np.cumsum(lengths) - lengths)[word_doc]) // stride
    some = ids >= 0
    some[some] = bound[ids[some]] > 0
    n = max(1, len(bound))
    pairs = np.unique(tile[some] * n + ids[some])
    held = np.bincount(pairs // n, bound[pairs % n], len(doc))
    both = held + np.where(follows, np.concatenate((held[1:], [0.0])), 0.0)
    return np.flatnonzero(both >= least - 1e-6), tile, doc, first


def triples_of(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the different runs of width (3 at most) terms, sorted."""
    n = len(ids) - width + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(width):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Index:
    """Postings of items of one stride by term: items in order, weights as shares of the items' own scores, and their maxima by block; numbers are kept in arrays."""

    def __init__(self, stride: int, items: list[tuple[int, str, dict[str, float]]]):
        """items: (key, text, weights by term)."""
        self.stride = stride
        items = sorted(items, key=lambda x: (len(x[2]), x[0], x[1]))
        self.item_ids = [x[0] for x in items]
        #: Of each item the words of a run of its question (3, if it has so many), their hashes, and the answer's terms.
        self.questions: list[tuple[int, np.ndarray]] = []
        self.answers: list[np.ndarray] = []
        self.terms: dict[str, int] = {}
        self.postings: list[array] = []
        self.weights: list[array] = []
        for k, (_, text, shares) in enumerate(items):
            for w, x in shares.items():
                t = self.terms.setdefault(w, len(self.terms))
                if t == len(self.postings):
                    self.postings.append(array("i"))
                    self.weights.append(array("d"))
                self.postings[t].append(k)
                self.weights[t].append(x)
            q, a = ([self.terms[w] for w in part] for part in parts(text))
            width = min(3, len(q))
            self.questions.append((width, triples_of(np.array(q, np.int64), width)))
            self.answers.append(np.unique(np.array(a, np.int32)))
        self.maxima = [array("d", [max(ws[a : a + POSTINGS_A_BLOCK]) for a in range(0, len(ws), POSTINGS_A_BLOCK)]) for ws in self.weights]
        self.bound = np.array([max(m) for m in self.maxima], np.float64)
        order = np.argsort(self.bound, kind="stable")
        low = order[np.cumsum(self.bound[order]) <= SLACK]
        self.first_bound = self.bound.copy()
        self.first_bound[low] = 0.0
        self.slack = float(self.bound[low].sum())
        size = max(1, -(-len(items) // GROUPS))
        self.group_bound = np.zeros((len(self.bound), max(1, -(-len(items) // size))), np.float32)
        for t, (ps, ws) in enumerate(zip(self.postings, self.weights)):
            np.maximum.at(self.group_bound[t], np.array(ps) // size, np.array(ws, np.float32))
        self.group_bound = np.ceil(self.group_bound * UNITS).astype(np.uint16)  # rounded up, so that it stays a bound
        self.by_group: np.ndarray | None = None

    def group_bounds(self) -> np.ndarray:
        """The bounds by term and group as numbers that are added up fast; made where they are used, not sent."""
        if self.by_group is None:
            self.by_group = self.group_bound.astype(np.float32) / np.float32(UNITS)
        return self.by_group

    def search(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """All items whose score for the query's terms is at least least, by block-max WAND."""
        lists = [(self.postings[t], self.weights[t], self.maxima[t], float(self.bound[t])) for t in query]
        at = [0] * len(lists)
        found = []
        least -= 1e-9
        live = list(range(len(lists)))
        while True:
            live = [x for x in live if at[x] < len(lists[x][0])]
            live.sort(key=lambda x: lists[x][0][at[x]])
            total, pivot = 0.0, -1
            for n, x in enumerate(live):
                total += lists[x][3]
                if total >= least:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            reach, blocks, next_item = 0.0, [], len(self.item_ids)
            for x in live[: pivot + 1]:
                ps, _, maxima, _ = lists[x]
                p = bisect_left(ps, item, at[x])
                blocks.append(p)
                if p < len(ps):
                    b = p // POSTINGS_A_BLOCK
                    reach += maxima[b]
                    next_item = min(next_item, ps[min(len(ps), (b + 1) * POSTINGS_A_BLOCK) - 1] + 1)
            if reach < least:
                if pivot + 1 < len(live):
                    next_item = min(next_item, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                next_item = max(next_item, item + 1)
                for x in live[: pivot + 1]:
                    at[x] = bisect_left(lists[x][0], next_item, at[x])
                continue
            score = 0.0
            for x, p in zip(live[: pivot + 1], blocks):
                ps, ws, _, _ = lists[x]
                if p < len(ps) and ps[p] == item:
                    score += ws[p]
                    p += 1
                at[x] = p
            if score >= least:
                found.append((item, score))

    def passages(self, ids: np.ndarray, lengths: np.ndarray, least: float) -> list[tuple[int, int, np.ndarray]]:
        """(document, first word, terms) of the passages whose bounds reach least.

        A passage is two neighbouring tiles of stride words; its bound is the sum of the greatest
        weights of its different terms, first over all items, then by group of items.
        """
        likely, tile, doc, first = likely_tiles(ids, lengths, self.stride, self.first_bound, least - self.slack)
        starts = np.searchsorted(tile, likely)
        ends = np.searchsorted(tile, likely + np.where((likely + 1 < len(doc)) & (doc[np.minimum(likely + 1, len(doc) - 1)] == doc[likely]), 2, 1))
        out, by_group = [], self.group_bounds()
        for k, a, b in zip(likely.tolist(), starts.tolist(), ends.tolist()):
            query = np.unique(ids[a:b])
            query = query[query >= 0]
            if len(query) and by_group[query].sum(axis=0).max() >= least - 1e-4:
                d = int(doc[k])
                out.append((d, (k - int(first[d])) * self.stride, query))
        return out

    def matches(self, split: list[list[str]], least: float, overlap: float) -> dict[tuple[int, int], tuple[int, float, float, float]]:
        """{(document, item): (passages, best score, question overlap, answer overlap)} of the documents (as words) that hold items."""
        get = self.terms.get
        lengths = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter((get(w, -1) for x in split for w in x), np.int64, int(lengths.sum()))
        found: dict[tuple[int, int], tuple[int, float, float, float]] = {}
        first = np.cumsum(lengths) - lengths
        for d, at, query in self.passages(ids, lengths, least):
            for item, score in self.search(query.tolist(), least):
                around = ids[first[d] + max(0, at - self.stride) : first[d] + min(int(lengths[d]), at + 3 * self.stride)]
                width, question = self.questions[item]
                q = float(np.isin(question, triples_of(around, width)).mean())
                answer = self.answers[item]
                a = float(np.isin(answer, around).mean()) if len(answer) else 1.0
                if q >= overlap and a >= overlap:
                    n, s, x, y = found.get((d, item), (0, 0.0, 0.0, 0.0))
                    found[d, item] = (n + 1, max(s, score), max(x, q), max(y, a))
        return found


class Bounds:
    """Greatest weights over all items of a stride, by cell of the terms' hashes: which passages can hold any item at all.

    Its size is CELLS numbers a stride, whatever the number of items; terms that share a cell only
    make more passages likely.
    """

    def __init__(self, by_stride: dict[int, np.ndarray]):
        self.by_stride = by_stride
        self.cells: dict[str, int] = {}

    def cell(self, word: str) -> int:
        if (c := self.cells.get(word)) is None:
            if len(self.cells) >= CACHED_WORDS:
                self.cells.clear()
            c = self.cells[word] = cell_of(word)
        return c

    def likely(self, some: list[str], least: float) -> list[bool]:
        """Whether a text has a passage whose bound reaches least."""
        split = [words(t) for t in some]
        lengths = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter((self.cell(w) for x in split for w in x), np.int64, int(lengths.sum()))
        held = np.zeros(len(some), bool)
        for stride, bound in self.by_stride.items():
            tiles, _, doc, _ = likely_tiles(ids, lengths, stride, bound, least - 1e-4)
            held[doc[tiles]] = True
        return held.tolist()


def cell_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % CELLS


class Items:
    """The different texts of a benchmark, weighed as one set and dealt into blocks of bounded size.

    Items with equal texts are one item, known by a key; members() tells the ids that a key stands
    for. Items without words can't occur in a text and are left out. Counts and weights are Spark tables; one block at a time, of
    about max_bytes of text (a longer single item is a block), is with the driver.
    """

    def __init__(self, items: DataFrame, max_bytes: int = ITEM_BYTES):
        rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.given = rows.withColumn("h", F.xxhash64("text"))
        self.items = stored(rows.select("text").distinct().withColumn("key", F.monotonically_increasing_id()), "items")
        total = self.items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.n_blocks = -(-total // max_bytes)
        schema = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("term", pa.string()), ("one", pa.int64())])

        def split(batches):
            for b in batches:
                out = []
                for key, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                    held = words(t)
                    out += [(key, len(held) if k == 0 else 0, w, int(k == 0)) for k, w in enumerate(set(held))]
                yield batch_of(schema, *(zip(*out) if out else ((), (), (), ())))

        self.terms = stored(self.items.mapInArrow(split, "key long, length long, term string, one long"), "item-terms")
        self.n, length = self.terms.agg(F.coalesce(F.sum("one"), F.lit(0)), F.sum("length")).first()
        self.mean_length = length / self.n if self.n else 0.0
        if not self.n:
            self.n_blocks = 0
        self.df = stored(self.terms.groupBy("term").agg(F.count("*").alias("df")), "item-df") if self.n else None

    def members(self) -> DataFrame:
        """(key, item_id): the different ids of the items of each key; texts are compared, not their hashes alone."""
        keys = self.items.select("key", F.col("text").alias("t"), F.xxhash64("text").alias("h"))
        return self.given.dropDuplicates(["item_id", "text"]).join(keys, "h").filter("t = text").select("key", "item_id")

    def part(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.n_blocks))

    def blocks(self) -> Iterator[list[Index]]:
        """For each block the indexes of its items, one a stride."""
        for part in range(self.n_blocks):
            rows = [(r.key, r.text, words(r.text)) for r in self.items.filter(self.part() == part).select("key", "text").collect()]
            mine = self.terms.filter(self.part() == part).select("term").distinct()
            df = {r.term: r.df for r in self.df.join(mine, "term").collect()}
            held: dict[int, list] = {}
            for i, t, w in rows:
                if w:
                    held.setdefault(stride_of(len(w)), []).append((i, t, weights_of(w, df, self.n, self.mean_length)))
            yield [Index(s, x) for s, x in sorted(held.items())]

    def bounds(self) -> Bounds:
        """Bounds over all items; at most CELLS numbers a stride reach the driver."""
        counts = self.terms.join(self.df, "term").groupBy("key").agg(F.collect_list(F.struct("term", "df")).alias("counts"))
        schema = pa.schema([("stride", pa.int64()), ("cell", pa.int64()), ("w", pa.float64())])
        n, mean = self.n, self.mean_length

        def weigh(batches):
            for b in batches:
                out = []
                for text, counts in zip(b.column("text").to_pylist(), b.column("counts").to_pylist()):
                    held = words(text)
                    shares = weights_of(held, {c["term"]: c["df"] for c in counts}, n, mean)
                    out += [(stride_of(len(held)), cell_of(w), x) for w, x in shares.items()]
                yield batch_of(schema, *(zip(*out) if out else ((), (), ())))

        found = self.items.join(counts, "key").select("text", "counts").mapInArrow(weigh, "stride long, cell long, w double")
        found = found.groupBy("stride", "cell").agg(F.max("w").alias("w")).toArrow()
        strides, cells, w = (found.column(c).to_numpy() for c in ("stride", "cell", "w"))
        by_stride = {}
        for s in np.unique(strides).tolist():
            by_stride[s] = np.zeros(CELLS)
            by_stride[s][cells[strides == s]] = w[strides == s]
        return Bounds(by_stride)


_FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("passages", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_FOUND_TYPES = "doc_id long, key long, passages long, score double, question_overlap double, answer_overlap double"
FOUND = "doc_id long, item_id long, passages long, score double, question_overlap double, answer_overlap double"


def _search(rows: DataFrame, indexes: list[Index], least: float, overlap: float) -> DataFrame:
    """The matches of rows (doc_id, text) with the items of one block, which is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "text", 4 << 20):
                ids = b.column("doc_id").to_pylist()
                split = [words(t) for t in b.column("text").to_pylist()]
                for index in shared.value:
                    found = index.matches(split, least, overlap)
                    if found:
                        yield batch_of(_FOUND, *zip(*((ids[d], index.item_ids[i], *x) for (d, i), x in found.items())))

    return rows.mapInArrow(run, _FOUND_TYPES)


def _filtered(docs: DataFrame, test) -> DataFrame:
    """The rows of docs whose texts pass test, a function from a list of texts to one of booleans."""

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            some = [t or "" for t in column]
            yield pd.Series([x for at in range(0, len(some), 500) for x in test(some[at : at + 500])], dtype="bool")

    return docs.filter(passes(F.col("text")))


def _likely(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items.bounds())
    return _filtered(docs, lambda some: shared.value.likely(some, least))


def contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE, overlap: float = MIN_OVERLAP, max_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, passages, score, question_overlap, answer_overlap) for every text of docs that holds an item.

    Every passage (window of twice the item's stride, one every stride) of every whole text is a
    query; all items with at least the share least of their own score are retrieved, and stay if
    the share overlap of the question's word triples and of the answer's words stands around the
    passage. Whether a text holds an item depends on the two, and on the whole set's term counts,
    but not on how items are dealt into blocks.

    Case and punctuation don't count; letters of scripts without blanks between words are words.
    Items with equal texts are searched as one, and each of their different ids is reported. Null and empty texts hold nothing; rows with a null doc_id and repeated rows are reported
    as they come; texts of any length are read whole; either table may be empty; further columns
    are ignored. With one block of items, that is broadcast and documents are read once. With more,
    one pass over the documents finds those that can hold any item, by bounds of fixed size; they
    are written, and each block goes over them in turn, its result written and its broadcast gone
    before the next.
    """
    held = Items(items, max_bytes)
    rows = texts(docs)
    if held.n_blocks == 0:
        return docs.sparkSession.createDataFrame([], FOUND)
    if held.n_blocks == 1:
        result = _search(rows, next(held.blocks()), least, overlap)
    else:
        rows, result = stored(_likely(rows, held, least), "likely"), None
        for indexes in held.blocks():
            found = stored(_search(rows, indexes, least, overlap), "matches")
            result = found if result is None else result.unionByName(found)
    result = stored(result, "found").join(within(stored(held.members(), "members")), "key")
    return result.select("doc_id", "item_id", "passages", "score", "question_overlap", "answer_overlap")


def without_contaminated(docs: DataFrame, items: DataFrame, least: float = MIN_SCORE, overlap: float = MIN_OVERLAP, max_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs that hold no item (as contaminated() has it), with the columns of docs.

    Each row is judged by its own text: null and empty texts, and all rows if there are no items,
    stay; repeated rows and rows without a doc_id go or stay alike; no column of docs matters but
    text. With more than one block of items, texts that hold items are told by two 64-bit hashes.
    """
    held = Items(items, max_bytes)
    if held.n_blocks == 0:
        return docs
    if held.n_blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(held.blocks()))

        def clean(some: list[str]) -> list[bool]:
            split = [words(t) for t in some]
            found = {d for index in shared.value for d, _ in index.matches(split, least, overlap)}
            return [k not in found for k in range(len(some))]

        return _filtered(docs, clean)
    text = F.col("text").cast("string")
    first, second = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    some = _likely(docs.select(text.alias("text")).filter("text is not null"), held, least)
    some = stored(some.withColumn("doc_id", F.monotonically_increasing_id()), "likely")
    bad = None
    for indexes in held.blocks():
        found = stored(_search(some.select("doc_id", "text"), indexes, least, overlap).select("doc_id").distinct(), "matches")
        bad = found if bad is None else bad.unionByName(found)
    gone = some.join(bad.distinct(), "doc_id", "left_semi").select(first.alias("first"), second.alias("second")).distinct()
    return docs.join(gone, (first == gone["first"]) & (second == gone["second"]), "left_anti")


def op2_blockmax_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table documents that holds an item of the table benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
