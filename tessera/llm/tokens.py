"""Token files: frequency-ranked ids in byte-aligned variable-length coding, and exact token counts."""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch_of, shared_dir, small_batches, stored, table, texts

#: Tokens of a block of a token file (a longer document is a block of its own).
BLOCK_TOKENS = 1 << 18
#: Words whose ids a worker keeps, of this and of an older generation.
CACHED_WORDS = 300_000
END_ID = 1
MARK = "\x01"
LATIN_STOP = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,])([ \n])"
#: Of these, some compose with a small letter but not with its capital.
COMBINING = r"[\x{300}-\x{36F}]"
#: Strings of these are their own canonical composition, and Python lowers them as the tokenizer does.
COMPOSED = re.compile(r"[\x00-\u024F]*")

_TOKENISED = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("ids", pa.binary()), ("seen", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_CODED = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts by a tokenizer of the tokenizers library, without added special tokens.

    Where the tokenizer turns white space into blanks, lowers letters, and drops blanks when it
    splits words, the ids of a text are those of its words, one after the other. Each different
    word is then encoded once and kept. Before, A-Z are lowered and a full stop or comma after a
    Latin letter at the end of a word is set apart, as the tokenizer does both itself; texts with
    combining marks (lowering could let them compose) or strings of added tokens, and all texts of
    other tokenizers, are encoded whole. Words of Latin letters skip the tokenizer's normalizer, which
    takes half its time: composing and squeezing white space change nothing there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._drops_space(spec)
        self.added = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.by_word:
            self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
            suffix = spec["model"].get("end_of_word_suffix")
            vocabulary = spec["model"]["vocab"]
            self.bare = Tokenizer.from_str(json.dumps({**spec, "normalizer": None}))
            self.ends = np.zeros(max(vocabulary.values()) + len(self.added) + 1, bool)
            if suffix:
                self.ends[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        normal = spec.get("normalizer") or {}
        steps = [s.get("type") for s in normal.get("normalizers", [normal])]
        replaced = [(s.get("pattern"), s.get("content")) for s in normal.get("normalizers", [normal]) if s.get("type") == "Replace"]
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = (first.get("pattern") or {}).get("Regex", r"\s")
        for known in (r"[^\s\p{L}\p{N}]+", r"[\p{L}]+", r"[\p{N}]"):
            pattern = pattern.replace(known, "")
        split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and not set(pattern) - set("'strevmld|")
        loose = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec.get("added_tokens", []))
        return steps == ["NFC", "Replace", "Lowercase"] and replaced == [({"Regex": r"\s+"}, " ")] and split and not loose and spec.get("post_processor") is None

    def _whole(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _lines(self, words: list[str], between: str, is_end, found: dict[str, bytes], drop: int) -> list[str]:
        """Encode words a few hundred at a time as one line, cut behind each id that ends a word; returns those of lines that don't come apart."""
        odd = []
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            line, by = between.join(some) + between, self.tokenizer
            if COMPOSED.fullmatch(line):
                line, by = line.lower(), self.bare
            ids = np.array(by.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(is_end(ids))
            if len(ends) != len(some):
                odd += some
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * (ends + 1)).tolist()):
                found[w] = raw[start : end - drop]
                start = end
        return odd

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        if self.ends.any():
            rest += self._lines(letters, " ", lambda ids: self.ends[ids], found, 0)
        else:
            rest += letters
        alone = [w for w in rest if MARK in w]
        if len(self.mark) == 1:
            alone += self._lines([w for w in rest if MARK not in w], f" {MARK} ", lambda ids: ids == self.mark[0], found, 4)
        else:
            alone = rest
        for w, ids in zip(alone, self._whole(alone)):
            found[w] = ids.tobytes()
        return found

    def _lookup(self, unique: list[str]) -> list[bytes]:
        cache, older = self.cache, self.older
        each = list(map(cache.get, unique))
        again = [k for k, x in enumerate(each) if x is None]
        words = [unique[k] for k in again]
        fresh = {w: ids for w, ids in zip(words, map(older.get, words)) if ids is not None}
        fresh.update(self._encode_words([w for w in words if w not in fresh]))
        for k, w in zip(again, words):
            each[k] = fresh[w]
        if len(cache) + len(fresh) > CACHED_WORDS:
            self.older, self.cache = cache, {}
        if len(fresh) <= CACHED_WORDS:
            self.cache.update(fresh)
        return each

    def _by_word(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(column, LATIN_STOP, r"\1 \2\3"))
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        held = np.frombuffer(b"".join(each), np.uint32)
        start = np.cumsum(size) - size
        length = size[index]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = held[np.repeat(start[index] - (ends - length), length) + np.arange(total)]
        return ids, _sums(length, n_words)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of a string column without nulls."""
        if self.by_word:
            lower = pc.ascii_lower(column)
            odd = pc.match_substring_regex(lower, COMBINING)
            for t in self.added:
                odd = pc.or_(odd, pc.match_substring(lower, t))
            if not pc.any(odd).as_py():
                return self._by_word(lower)
            odd = odd.to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(column), bool)
        each: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        for k, ids in zip(np.flatnonzero(odd), self._whole(column.filter(pa.array(odd)).to_pylist())):
            each[k] = ids
        if not odd.all():
            ids, sizes = self._by_word(lower.filter(pa.array(~odd)))
            for k, part in zip(np.flatnonzero(~odd), np.split(ids, np.cumsum(sizes)[:-1])):
                each[k] = part
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, kept with its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes."""
    held = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return held[ends] - held[ends - sizes]


def _tokenise(path: str, end_id: int, block_tokens: int):
    def run(batches):
        encoder, shard, block = encoder_of(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, parts, held = [], [], [], 0
        times = np.zeros(0, np.int64)
        end = np.array([end_id], np.uint32)

        def full():
            nonlocal times
            ids = np.concatenate(parts)
            now = np.bincount(ids)
            if len(now) > len(times):
                now, times = times, now.astype(np.int64)
            times[: len(now)] += now
            return ids.astype("<u4").tobytes()

        for whole in batches:
            for b in small_batches(whole, "text", 4 << 20):
                ids, sizes = encoder(b.column("text"))
                ends = np.cumsum(sizes)
                for doc, to, n in zip(b.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist()):
                    if parts and held + n + 1 > block_tokens:
                        yield batch_of(_TOKENISED, [shard], [block], [doc_ids], [counts], [full()], [None], [None])
                        block += 1
                        doc_ids, counts, parts, held = [], [], [], 0
                    doc_ids.append(doc)
                    counts.append(n + 1)
                    parts.append(ids[to - n : to])
                    parts.append(end)
                    held += n + 1
        if parts:
            last = full()
            seen = np.flatnonzero(times)
            yield batch_of(_TOKENISED, [shard], [block], [doc_ids], [counts], [last], [seen], [times[seen]])

    return run


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): each value in 1 to 4 bytes, its length less one in 2 bits of the control bytes."""
    values = np.ascontiguousarray(values, "<u4")
    length = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros((len(values) + 3) // 4 * 4, np.uint8)
    code[: len(values)] = length - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


#: Lengths of the four values under each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() wrote."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    held = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    start = np.cumsum(length) - length
    values = held[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if len(more):
            values[more] |= held[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _code(rank: np.ndarray):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                control, data = pack(rank[np.frombuffer(b.column("ids")[k].as_buffer(), "<u4")])
                keep = [b.column(c).slice(k, 1) for c in ("shard", "block", "doc_ids", "counts")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=_CODED)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of every whole text of docs (doc_id, text), end_id after each, in ascending doc_id order.

    The folder at path has three tables. ranks (rank, id): ids by falling count over the whole
    input, ties by id. blocks (shard, block, doc_ids, counts, control, data): consecutive
    documents, their numbers of ids, and the ranks of their ids in 1 to 4 bytes each, with the
    lengths apart in control bytes (2 bits a value). index (shard, block, start): the number of ids
    before each block. Null texts are empty (the end id alone); rows with a null doc_id come first;
    repeated doc_ids follow one another by text hash; an empty table gives empty tables; further
    columns are ignored. Only the counts of the vocabulary's ids reach the driver.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = texts(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    types = "shard int, block int, doc_ids array<long>, counts array<long>"
    tokens = stored(ordered.mapInArrow(_tokenise(tokenizer, end_id, block_tokens), f"{types}, ids binary, seen array<long>, times array<long>"), "tokens")
    counts = tokens.select(F.explode(F.arrays_zip("seen", "times")).alias("c")).groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.times").alias("n"))
    order = [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    spark.createDataFrame(list(enumerate(order)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    tokens.drop("seen", "times").mapInArrow(_code(rank), f"{types}, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = sizes.groupBy("shard").agg(F.sum("n").alias("total"))
    before = before.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    index = sizes.withColumn("inside", inside).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))
    index.write.parquet(f"{path}/index")


def _decode(ids_of: np.ndarray, digest: bool):
    def run(batches):
        for b in batches:
            shards, blocks = b.column("shard").to_pylist(), b.column("block").to_pylist()
            for k in range(b.num_rows):
                doc_ids = b.column("doc_ids")[k].values
                sizes = b.column("counts")[k].values.to_numpy()
                ids = ids_of[unpack(b.column("control")[k].as_py(), b.column("data")[k].as_py(), int(sizes.sum()))]
                ends = np.cumsum(sizes)
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int64()))
                n = len(sizes)
                columns = [pa.array(np.full(n, shards[k]), pa.int32()), pa.array(np.full(n, blocks[k]), pa.int32()), doc_ids, pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of a token folder; with digest ids_crc32 in place of ids."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    ids_of = np.array([r.id for r in ranks], np.uint32)
    last = "ids_crc32 long" if digest else "ids array<long>"
    found = spark.read.parquet(f"{path}/blocks").mapInArrow(_decode(ids_of, digest), f"shard int, block int, doc_id long, inside long, n_tokens long, {last}")
    index = spark.read.parquet(f"{path}/index")
    return found.join(index, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write docs as a token folder in the shared folder and return (doc_id, start, n_tokens, ids_crc32) as reading it back gives.

    ids_crc32 is that of the document's ids, end_id included, as little-endian 32-bit numbers. Null,
    empty and repeated rows, rows without a doc_id and empty tables are as write_tokens() has them.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tessera/token-file-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, digest=True)


def op5_ranked_varint_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of the table documents hold for each document, as read back."""
    return token_file_digest(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
