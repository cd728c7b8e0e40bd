"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
#: Bounds of the labelled sample that is learned from: rows, and characters of their texts.
TRAIN_ROWS = 10_000
TRAIN_CHARS = 40_000_000
MAX_FEATURES = 4_096
MIN_CHI_SQUARE = 12.0
THRESHOLD = 0.3
#: A sentence this likely to be toxic is reported.
SPAN_THRESHOLD = 0.5
CACHED_WORDS = 150_000


def word_features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


class _Words(dict):
    """Weight of a word, worked out once; emptied when it holds too many words."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        get = self.weights.get
        value = self[word] = sum(get(f, 0.0) for f in word_features(word))
        return value


def _sentence_scores(text: str, bias: float, words: _Words):
    """(start, end, p) of each sentence; a text without sentences counts as one empty sentence."""
    found = False
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change their length; offsets are then those of the letters as they are
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for m in SENTENCE.finditer(lower):
        held = set(WORD.findall(m.group()))
        if held:
            found = True
            z = bias + sum([words[w] for w in held])
            yield m.start(), m.end(), 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0
    if not found:
        yield 0, len(text), 1.0 / (1.0 + math.exp(-bias))


def _noisy_or(ps) -> float:
    return 1.0 - math.exp(sum(math.log1p(-min(p, 1 - 1e-12)) for p in ps))


def _select(rows: list[tuple[str, int]]) -> list[str]:
    """The features whose counts differ most from independence of the label (chi-square)."""
    share = sum(y for _, y in rows) / max(1, len(rows))
    by_word: dict[str, list[int]] = {}
    for text, y in rows:
        for w in set(WORD.findall(text.lower())):
            by_word.setdefault(w, [0, 0])[y] += 1
    scored = []

    def weigh(f: str, clean: int, pos: int) -> None:
        if clean + pos >= 5:
            e = (clean + pos) * share
            if (chi := (pos - e) ** 2 / (e * (1 - share))) >= MIN_CHI_SQUARE:
                scored.append((-chi, f))

    for w, (clean, pos) in by_word.items():
        weigh(f"={w}", clean, pos)
    for k in PREFIXES:
        counts: dict[str, list[int]] = {}
        for w, (clean, pos) in by_word.items():
            if len(w) >= k:
                held = counts.setdefault(w[:k], [0, 0])
                held[0] += clean
                held[1] += pos
        for f, (clean, pos) in counts.items():
            weigh(f, clean, pos)
    return [f for _, f in sorted(scored)[:MAX_FEATURES]]


def fit(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Noisy-or of logistic sentence scores, by gradient ascent on the likelihood of the documents' labels.

    Without two classes the model is constant (near the share of label 1).
    """
    rows = [(t, int(y)) for t, y in rows]
    n_pos = sum(y for _, y in rows)
    if n_pos in (0, len(rows)):
        return Model(6.0 if n_pos else -6.0, {})
    names = _select(rows)
    index = {f: k for k, f in enumerate(names)}
    known: dict[str, tuple[int, ...]] = {}
    cols, rows_at, bag_of = array("i"), array("i"), array("i")
    at = 0
    for b, (text, _) in enumerate(rows):
        for held in [h for s in SENTENCE.findall(text.lower()) if (h := set(WORD.findall(s)))] or [set()]:
            for w in held:
                if (ids := known.get(w)) is None:
                    ids = tuple(index[f] for f in word_features(w) if f in index)
                    if len(known) < CACHED_WORDS:
                        known[w] = ids
                cols.extend(ids)
                rows_at.extend([at] * len(ids))
            bag_of.append(b)
            at += 1
    col, row, bag = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (cols, rows_at, bag_of))
    y = np.array([v for _, v in rows], float)
    w, bias = np.zeros(len(names)), -7.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, w[col], at)
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(bag, np.log1p(-p), len(y)))
        gain = np.where(y > 0, clean / np.maximum(1 - clean, 1e-9), -1.0)[bag] * p / len(y)
        g = np.concatenate((np.bincount(col, gain[row], len(w)) - decay * w, [gain.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w + step[:-1], bias + step[-1]
    return Model(float(bias), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3})


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> Model:
    """The model of the labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    Of these rows the max_rows with the smallest hash of their doc_id are taken, and of them as
    many as have max_chars characters together: a fixed bound on what reaches the driver. Labels
    other than 0 and 1 are left out; of several labels of a doc_id the highest counts, of several
    texts that with the smallest hash, so that a doc_id that very many rows have is one.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.filter(F.length("text") <= max_chars).groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held, chars = [], 0
    for r in sorted(rows.collect() if _chars(rows) <= max_chars else _some(rows, max_chars), key=lambda r: (r.doc_id, r.text)):
        if chars + len(r.text) > max_chars:
            break
        chars += len(r.text)
        held.append((r.text, r.toxic))
    return fit(held)


def _chars(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


def _some(rows: DataFrame, max_chars: int):
    """Rows in turn from executors, until they have max_chars characters."""
    chars = 0
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        chars += len(r.text)
        if chars > max_chars:
            return
        yield r


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))]
)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, offending) for every row of docs (doc_id, text).

    score is the probability that at least one sentence is toxic; offending has the character span
    and probability of every sentence at SPAN_THRESHOLD or more. Null and empty texts count as one
    sentence without words; null doc_ids and repeated rows come out as they are; an empty table
    gives an empty one; further columns are ignored and whole texts are read whatever their length.
    """

    def run(batches):
        words = _Words(model.weights)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                found = list(_sentence_scores(text, model.bias, words))
                spans = [{"start": s, "end": e, "p": p} for s, e, p in found if p >= SPAN_THRESHOLD]
                out.append((_noisy_or(p for _, _, p in found), len(found), spans))
            first, second, third = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip((first, second, third), list(_SCORED)[1:]))], schema=_SCORED)

    return texts(docs).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,p:double>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs.

    Each row is judged by its whole text; a null or empty one counts as one sentence without words.
    Repeated rows and rows without a doc_id stay or go alike, an empty table gives an empty one, and
    no column matters but text.
    """

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(model.weights)
        for column in batches:
            yield pd.Series([_noisy_or(p for _, _, p in _sentence_scores(t or "", model.bias, words)) for t in column], dtype="float64")

    return docs.filter(toxicity(F.col("text")) < threshold)


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document of the table documents, learned from those of the table labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending"))
