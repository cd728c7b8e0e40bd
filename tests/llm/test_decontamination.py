"""Decontamination against brute force: the search by itself, and the whole operator over blocks of any size."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontamination as d


def weighed(items):
    split = [d.words(t) for _, t in items]
    df = Counter(w for x in split for w in set(x))
    n = sum(map(bool, split))
    mean = sum(map(len, split)) / n
    return [(i, t, d.weights_of(w, df, n, mean)) for (i, t), w in zip(items, split) if w]


def test_weights_are_bm25_shares():
    (_, _, found), *_ = weighed([(1, "a b a"), (2, "b c")])
    idf = {w: math.log(1 + (2 - df + 0.5) / (df + 0.5)) for w, df in (("a", 1), ("b", 2))}
    norm = 1.2 * (0.25 + 0.75 * 3 / 2.5)
    own = {"a": idf["a"] * 2 * 2.2 / (2 + norm), "b": idf["b"] * 2.2 / (1 + norm)}
    assert found == pytest.approx({w: x / sum(own.values()) for w, x in own.items()})


def test_wand_finds_what_all_scores_find():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{k}" for k in (rng.zipf(1.3, 3000) % 400)]
    index = d.Index(64, weighed([(k, " ".join(rng.choice(vocabulary, int(rng.integers(5, 40))))) for k in range(150)]))
    for _ in range(60):
        query = sorted({index.terms[w] for w in rng.choice(vocabulary, 60) if w in index.terms})
        scores = Counter()
        for t in query:
            for i, w in zip(index.postings[t], index.weights[t]):
                scores[i] += w
        for least in (0.2, 0.5):
            assert {i for i, _ in index.search(query, least)} == {i for i, s in scores.items() if s >= least - 1e-9}


def brute_force(docs, items, least, overlap):
    """{(doc, item): (passages, score)}, passage by passage and item by item."""
    out = {}
    for item, text, shares in weighed(items):
        stride = 64
        while stride < len(d.words(text)):
            stride *= 2
        q, a = d.parts(text)
        triples = {tuple(q[j : j + 3]) for j in range(max(1, len(q) - 2))}
        width = len(next(iter(triples)))
        for doc, body in docs:
            held = d.words(body or "")
            for at in range(0, len(held), stride):
                score = sum(shares.get(w, 0.0) for w in set(held[at : at + 2 * stride]))
                around = held[max(0, at - stride) : at + 3 * stride]
                there = {tuple(around[j : j + width]) for j in range(len(around) - width + 1)}
                if score >= least - 1e-9 and len(triples & there) >= overlap * len(triples) and (not a or len(set(a) & set(around)) >= overlap * len(set(a))):
                    n, s = out.get((doc, item), (0, 0.0))
                    out[doc, item] = n + 1, max(s, score)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(700)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, say(int(n)) + ".\n" + say(4)) for k, n in enumerate(rng.choice([6, 20, 50, 62, 90, 150], 24))]
    docs = []
    for k in range(60):
        item = items[k % 24][1].replace("\n", " ").split()
        cut = item[int(rng.integers(0, 3)) * len(item) // 6 :]
        docs.append((k, f"{say(int(rng.integers(0, 500)))} {' '.join(cut)} {say(int(rng.integers(0, 300)))}"))
    return items, docs + [(900, say(2000)), (901, None), (902, "")]


@pytest.mark.parametrize("max_bytes", [8 << 20, 4000])
def test_all_is_as_by_brute_force_whatever_the_blocks(spark, planted, max_bytes):
    items, docs = planted
    want = brute_force(docs, items, d.MIN_SCORE, d.MIN_OVERLAP)
    assert 20 < len(want) < 100 and len({i for i, t in items if len(d.words(t)) > 64 and any(i == x for _, x in want)}) > 3
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(rows, benchmark, max_bytes=max_bytes).collect()
    assert {(r.doc_id, r.item_id): (r.passages, round(r.score, 9)) for r in got} == {k: (n, round(s, 9)) for k, (n, s) in want.items()} and len(got) == len(want)
    kept = d.without_contaminated(rows.withColumn("first", rows.doc_id), benchmark, max_bytes=max_bytes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want}) and kept.columns == ["doc_id", "text", "first"]


def test_long_items_and_repeated_ones_change_nothing_else(spark, planted):
    items, docs = planted
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {(r.doc_id, r.item_id) for r in d.contaminated(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    more = items * 3 + [(500 + k, t) for k, (_, t) in enumerate(items)]
    again = {(r.doc_id, r.item_id) for r in d.contaminated(rows, spark.createDataFrame(more, "item_id long, text string")).collect()}
    assert again == plain | {(doc, 500 + k) for doc, i in plain for k, (j, t) in enumerate(items) if t == dict(items)[i]}
    long = [*items, (999, " ".join(f"other{k}" for k in range(3000)))]
    assert {(r.doc_id, r.item_id) for r in d.contaminated(rows, spark.createDataFrame(long, "item_id long, text string")).collect()} == plain


def test_very_long_texts(spark, planted):
    items, _ = planted
    text = "filler " * 200_000 + items[0][1] + " filler" * 200_000
    rows = spark.createDataFrame([(1, text), (2, "filler " * 300_000)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contaminated(rows, benchmark).collect()] == [(1, 0)]
