"""Near-duplicates by signature coordinates against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tessera.llm import minhash
from tests.llm.test_operators import EDGES, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=4):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(" ".join(words[k : k + size]) for k in range(len(words) - size + 1))


def expected(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, *_) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def families(seed, n_families, copies, length=60, words=300, boilerplate=0):
    """Texts with copies at all distances around the limit; boilerplate words that all of them share."""
    rng = np.random.default_rng(seed)
    common = [f"c{k}" for k in range(boilerplate)]
    rows = []
    for _ in range(n_families):
        base = [f"w{k}" for k in rng.integers(0, words, int(rng.integers(length // 2, 2 * length)))]
        for _ in range(int(rng.integers(1, copies + 1))):
            own = list(base)
            for at in rng.integers(0, len(own), int(rng.integers(0, max(2, len(own) // 12)))):
                own[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(common + own), "s"))
    return [rows[k] for k in rng.permutation(len(rows))]


def found(spark, rows, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame(spark, rows), **how).collect()), key=str)


@pytest.mark.parametrize(
    "rows, how",
    [
        (families(1, 60, 6), {}),
        (families(2, 4, 120), {"run_limit": 4}),
        (families(3, 3, 150), {"run_limit": 3, "block_texts": 16}),
        (families(4, 40, 8, boilerplate=90), {"run_limit": 4, "block_texts": 8}),
        (families(5, 40, 8, boilerplate=30), {"run_limit": 4, "block_shingles": 500}),
    ],
)
def test_components_are_those_of_all_pairs(spark, rows, how):
    assert found(spark, rows, **how) == expected(rows)


def test_edge_cases(spark):
    rows = EDGES + [(20, "A b", "x"), (21, "a B", "x"), (22, "a b c", "x"), (23, "One line here.\nSecond line here.\nThird LINE here.", "x"), (3, "one", "x"), (3, "two", "x"), (30, "ONE", "x"), (31, "\x1cone", "x")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, []) == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        same = []
        for _ in range(200):
            common = rng.integers(1 << 63, size=int(1000 * share), dtype=np.uint64)
            one, other = (np.concatenate((common, rng.integers(1 << 63, size=int(500 * (1 - share)), dtype=np.uint64))) for _ in range(2))
            same.append((minhash.signature(one) == minhash.signature(other)).mean())
        assert abs(np.mean(same) - share) < 0.02 and np.std(same) < 1.3 * (share * (1 - share) / 64) ** 0.5


def test_lists_long_in_a_sample_give_no_pairs(spark):
    """A third of all nodes are on the same lists: they are found in the sample, and their postings aren't shuffled by list."""
    rows = families(7, 1, 900, length=50)
    prints = minhash.signed(frame(spark, rows)).selectExpr("doc_id as id", "n", "sig")
    last = minhash.long_lists(prints, 8)
    assert 10 < len(last) <= 128
    assert prints.mapInArrow(minhash._post(last, 48, True), "s long, id long, n long").select("s").distinct().count() <= len(last)
