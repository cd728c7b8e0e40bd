"""Hot ids, equal rows and malformed values of the training-data operators."""

from __future__ import annotations

import struct

import pytest

from tessera.llm import decontamination as d
from tessera.llm import lines, media, simhash, toxicity
from tests.llm.test_operators import frame


def test_a_doc_id_of_very_many_rows_keeps_one(spark):
    docs = frame(spark, [(7, f"text {k % 3}", "s") for k in range(3000)] + [(8, "one", None), (8, "one", None), (None, "x", None), (None, "x", None)])
    kept = simhash.keep_rows(docs, spark.createDataFrame([(7,), (8,)], "doc_id long"))
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id), key=str)[1] == (8, "one")
    assert [r.doc_id for r in kept.orderBy("doc_id").collect()] == [None, None, 7, 8]


def test_a_text_in_very_many_rows_loses_each_line_once(spark):
    text = "first line\nsecond line\nthird line\nfourth line"
    docs = frame(spark, [(1, text, None)] + [(2, text, None)] * 2000)
    found = {(r.doc_id, r.text, r.n_removed) for r in lines.drop_repeated_windows(docs).collect()}
    assert found == {(1, text, 0), (2, "", 4)} and lines.drop_repeated_windows(docs).count() == 2001


def test_a_doc_id_of_very_many_rows_is_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.extend(rows))
    docs = frame(spark, [(3, "", None)] * 2000 + [(3, "a b", None), (5, "bad", None)])
    toxicity.learn(docs, spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, toxic int"))
    assert len(seen) <= 2


def test_equal_items_are_all_reported(spark):
    text = "what is the tallest mountain in the whole wide world?\nit is the one called everest"
    items = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "another question that nobody has asked so far?\nno"), (None, text)], "item_id long, text string")
    docs = frame(spark, [(10, f"before it. {text} after it", None), (11, "nothing of it", None)])
    for most in (8 << 20, 60):
        assert sorted(((r.doc_id, r.item_id) for r in d.contaminated(docs, items, max_bytes=most).collect()), key=str) == [(10, 1), (10, 2), (10, None)]


def test_items_in_scripts_without_blanks_are_found_within_sentences(spark):
    item = "世界上最高的山峰是哪一座山？\n珠穆朗玛峰位于喜马拉雅山脉"
    items = spark.createDataFrame([(1, item), (2, "法国的首都是哪座城市？\n巴黎是法国的首都城市")], "item_id long, text string")
    body = item.replace("\n", "").replace("？", "")
    docs = frame(spark, [(1, f"他们问我们{body}这是大家都知道的事情", None), (2, "今天的天气很好我们去公园散步", None)])
    assert [(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()] == [(1, 1)]


def test_an_index_is_small_for_its_text():
    import pickle

    import numpy as np

    rng = np.random.default_rng(0)
    items = [(k, " ".join(f"w{j}" for j in rng.zipf(1.3, 50) % 20_000)) for k in range(3000)]
    from tests.llm.test_decontamination import weighed

    index = d.Index(64, weighed(items))
    assert len(pickle.dumps(index)) < 10 * sum(len(t) for _, t in items)


BAD = {
    "a count that no container has": lambda: media.box(b"moov", media.box(b"trak", media.box(b"stsz", bytes(4), struct.pack(">II", 1, 0xFFFFFFFF)))),
    "a table that is cut off": lambda: media.box(b"moov", media.box(b"trak", media.box(b"stsz", bytes(4), struct.pack(">II", 0, 0xFFFFFFFF)))),
    "chunks that disagree": lambda: media.box(b"moov", media.box(b"trak", media.box(b"stsz", bytes(4), struct.pack(">II", 1, 8)), media.box(b"stco", bytes(4), struct.pack(">II", 1, 0)), media.box(b"stsc", bytes(4), struct.pack(">IIII", 1, 1, 0xFFFFFFFF, 1)))),
    "stray bytes": lambda: b"xyz",
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_malformed_containers_have_a_reason(spark, name):
    rows = spark.createDataFrame([(1, bytearray(BAD[name]())), (2, bytearray(media.build(bytes(128)))), (3, None)], "doc_id long, media binary")
    found = {r.doc_id: r for r in media.media_tracks(rows).collect()}
    assert found[1].tracks is None and found[1].error and found[2].tracks[0].n_samples == 2 and found[3].tracks == []


def test_boxes_may_be_nested_to_any_depth():
    nested = media.box(b"tkhd", bytes(12), struct.pack(">I", 9))
    for _ in range(20_000):
        nested = media.box(b"udta", nested)
    assert media.describe(media.box(b"moov", media.box(b"trak", nested)))[0]["track"] == 9
