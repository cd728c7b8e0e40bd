"""The corpus pipeline on documents with planted cases."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words, n))
    rows, labels = [], []
    for k in range(400):
        bad = k % 8 == 3
        rows.append((k, ". ".join(say(9) for _ in range(8)) + (" vilest slur" if bad else ""), "en", "a" if k % 4 else "b", 0))
        labels.append((k, 1, int(bad)))
    items = [(k, say(18) + ".\n" + say(4)) for k in range(12)]
    rows += [(1000 + k, f"{say(60)} {items[k][1]} {say(30)}", "en", "a", 0) for k in range(12)]
    rows += [(2000 + k, rows[k][1], "en", "a", 0) for k in range(5)] + [(3000, None, None, None, None), (3000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "token_files":
            assert docs.columns == seen[0].columns
        seen.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    bad = {k for k in range(400) if k % 8 == 3}
    assert ids[1] == ids[0] - bad - {2003}
    assert ids[2] == ids[1] - {2000 + k for k in range(5) if k % 8 != 3} and seen[2].count() == len(ids[2])
    assert ids[3] == ids[2] - {1000 + k for k in range(12)}
    assert ids[4] == ids[3] == ids[5] and seen[5].count() == seen[4].count()
    assert pipeline.run(spark, str(tmp_path)).count() == seen[5].count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_stage_takes_an_empty_table_and_other_columns(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, nth long, times long, kept long"
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is it\nthat")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES:
        for rows in ([], [(1, "some words", "en", "a", 10, 1, 2, 3), (1, "some words", "en", "a", 10, 1, 2, 3), (None, None, None, None, None, None, None, None)]):
            docs = spark.createDataFrame(rows, columns)
            got = stage(spark, docs, str(tmp_path))
            kept = {"near_duplicates": 2}.get(name, 3) if rows else 0
            n = got.count()
            assert n == kept or (name == "mixing" and n > kept), name
            assert name == "token_files" or got.columns == docs.columns


def test_no_pair_that_stays_is_alike_and_no_clean_text_goes(spark, tmp_path):
    """The near-duplicate stage against brute force over all pairs."""
    from tessera.llm.simhash import fingerprint

    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(2000)]
    texts = []
    for g in range(60):
        base = list(rng.choice(words, int(rng.integers(20, 200))))
        for _ in range(4):
            mine = list(base)
            for at in rng.choice(len(mine), int(rng.integers(0, 1 + len(mine) // 20)), replace=False):
                mine[at] = rng.choice(words)
            texts.append(" ".join(mine))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    prints = [fingerprint(t) for t in texts]
    linked = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if linked(a, b)]
    assert len(pairs) > 50 and not any(a in kept and b in kept for a, b in pairs)
    assert set(range(len(texts))) - kept <= {x for p in pairs for x in p}
