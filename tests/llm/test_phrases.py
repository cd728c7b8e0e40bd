"""Collocations against their definition."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import phrases

COLUMNS = "doc_id long, text string, lang string, gram string, k int, n string, score double"


def frame(spark, rows):
    """Documents with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(k, t, lang, "g", 1, "x", 0.5) for k, (t, lang) in enumerate(rows)], COLUMNS)


def expected(rows, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    f[lang, tuple(words[at : at + k])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    over = Counter()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for at in range(len(w) - size + 1):
                over[lang, w[at : at + size]] = max(over[lang, w[at : at + size]], a)
    found = []
    for (lang, w), a in candidates.items():
        if (lang, w) in over and 100 * over[lang, w] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang in n:
        mine = sorted(x for x in found if x[0] == lang)[:top]
        out += [(lang, k, x[3].decode(), -x[2], x[4], x[5], n[lang], -x[1]) for k, x in enumerate(mine, 1)]
    return sorted(out)


def corpus(seed, docs, words=40):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "? "]
    rows = []
    for _ in range(docs):
        some = [f"{'Ab'[k % 2]}{k}" if k > 3 else ("new york city hall é".split())[k] for k in (rng.zipf(1.5, int(rng.integers(0, 60))) % words).tolist()]
        rows.append(("".join(x + marks[rng.integers(len(marks))] for x in some), [None, "en", "fr", "und"][rng.integers(4)]))
    return rows


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 5, "share": 80}, {"longest": 2, "least": 3, "top": 7}])
def test_phrases_are_those_of_the_definition(spark, how):
    rows = corpus(1, 400) + [(None, "en"), ("", None), (" \t. ,\n", "fr"), ("long " * 30_000 + "tail", "en"), ("New York.", "de")] + [("the same row, New York city hall", "en")] * 50
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **how).collect())
    assert got == expected(rows, **how) and got


def test_no_texts_and_no_frequent_phrases_give_an_empty_table(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [("a b c", "en")])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, l, r = 123_456_789_012_345, 923_456_789_012_345, 723_456_789_012_347
    counts = spark.createDataFrame([("en", "", 0, 10**15), ("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, gram string, k int, n long")
    monkeypatch.setattr(phrases, "sequence_counts", lambda *_: counts)
    assert [tuple(x) for x in phrases.collocations(frame(spark, [])).collect()] == [("en", 1, "x y", a, l, r, 10**15, 1_000_000 * a * a // (l * r))]


def test_a_bucket_larger_than_its_memory_is_summed_on_disk():
    n = 400_000
    grams = pa.array([f"some rather long phrase number {k}" for k in range(n)])
    batches = [phrases._packed("en", 5, grams, np.full(n, 6), np.zeros(n, np.int64))] * 2
    found = sum(b.num_rows for b in phrases._bucket(12, "48MB")(iter(batches)))
    assert found == n
