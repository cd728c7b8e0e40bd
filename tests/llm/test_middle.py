"""Fill-in-the-middle forms against their definition."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import middle
from tests.llm.test_operators import EDGES, frame

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("values", [[], [5], [1, 2, 3], list(range(1, 2000)), sorted(set(np.random.default_rng(0).integers(1, 10**9, 5000).tolist()))])
def test_elias_fano_gives_back_each_number(values):
    values = np.array(values, np.int64)
    coded = middle.EliasFano(*middle.elias_fano(values, int(values[-1]) if len(values) else 0))
    k = np.arange(len(values))
    assert np.array_equal(coded[k], values) if len(values) else True
    assert np.array_equal(coded[k[::-1]], values[::-1])


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "  a\t\nb  ", "é ü日本 x", " no blank here", "\x1c not \x0b blank"])
def test_unit_ends_are_those_of_the_pattern(text):
    ends = [len(text[: m.end()].encode()) for m in UNITS.finditer(text)]
    assert middle.unit_ends(text.encode()).tolist() == ends


def test_forms_agree_with_their_definition_on_edge_cases(spark):
    more = [(k, t, None) for k, t in enumerate(["<P> in it", "x <S", "<<S>", "a<P", "> b <", "one two three four <M", "日本 語 text"] * 20, 100)]
    rows = EDGES + more + [(7, "same", None)] * 30
    got = middle.fill_in_middle(frame(spark, rows)).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    want = sorted(((i, *expected(i, t), t or "") for i, t, _ in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_equal_texts_have_one_entry_however_many_tasks_and_ids(spark):
    rows = [(k, "the same text in a third of all rows " * 5, None) for k in range(3000)] + [(k, f"text {k}", None) for k in range(3000, 9000)]
    docs = frame(spark, rows)
    index = middle.distinct_texts(docs).select("text", F.size("doc_ids").alias("c")).collect()
    assert len(index) < 6001 + 8 and sum(r.c for r in index) == 9000
    small = middle.distinct_texts(docs, ids_limit=100).filter(F.length("text") > 20).select(F.size("doc_ids").alias("c")).collect()
    assert max(r.c for r in small) == 100 and sum(r.c for r in small) == 3000
    assert {r.doc_id: r.output for r in middle.fill_in_middle(docs, ids_limit=100).collect()} == {i: expected(i, t)[4] for i, t, _ in rows}


def test_texts_with_equal_hashes_are_told_apart():
    import pyarrow as pa

    rows = [(1, 2, b"a b", 1), (1, 2, b"c", 2), (1, 2, b"a b", 3), (5, 5, b"", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k1", "k2", "text", "doc_id"])
    found = [r for b in middle._entries(10)([batch]) for r in b.to_pylist()]
    assert [(r["text"], r["n"], r["doc_ids"]) for r in found] == [(b"a b", 2, [1, 3]), (b"c", 1, [2]), (b"", 0, [None])]


def test_an_empty_table_gives_an_empty_one(spark):
    assert middle.fill_in_middle(frame(spark, [])).collect() == []
