"""The training-data operators against brute force, on edge cases and on the shared tables."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import counts, decontamination, html, jaccard, lines, media, mixing, registry, sharding, simhash, tokens, toxicity
from tessera.llm.common import stored
from tessera.llm.components import connected_components
from tests.compare import connect, difference

COLUMNS = "doc_id long, text string, source string, score double, h long, fingerprint string, tokens long, block int"


def frame(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, s, 0.5, 7, "x", 3, 1) for i, t, s in rows], COLUMNS)


EDGES = [
    (1, "One line here.\nSecond line here.\nThird line here.", "a"), (2, "One line here.\nSecond line here.\nThird line here.", "a"), (2, "One line here.\nSecond line here.\nThird line here.", "a"),
    (3, None, "a"), (4, "", None), (None, "Null id.\n\nWith blank lines.\n ", "b"), (None, None, None), (5, "word " * 30_000, "b"), (6, "é ü 日本 <|endoftext|> İ H̱ it's", "c"), (7, " \n\t ", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, data, name):
    got = registry.queries()[name](spark, data).toPandas()
    assert difference(got, connect(data).execute(registry.oracle_sql()[name]).df()) is None


# -- toxicity


def test_noisy_or_learns_words_and_finds_sentences(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(200)]

    def text(bad):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(int(rng.integers(3, 30)))]
        if bad:
            k = int(rng.integers(len(sentences)))
            sentences[k] += f" slur{rng.integers(3)}"
        return ". ".join(sentences)

    model = toxicity.fit([(text(k % 5 == 0), int(k % 5 == 0)) for k in range(600)])
    docs = frame(spark, [(1, "w1 w2. w3 slur1 w4! w5 w6", None), (2, "w1 w2. w3 w4", None), (3, None, None), (None, "", None)])
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].score > 0.9 and max(got[2].score, got[3].score, got[None].score) < 0.1
    assert [(s.start, s.end) for s in got[1].offending] == [(6, 18)]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, None}


def test_fit_climbs_the_noisy_or_likelihood():
    """The likelihood of the labels, by its definition, is at a top: no small step from the weights found makes it greater."""
    rng = np.random.default_rng(4)
    words = [f"{c}{k}" for c in "abcdefghij" for k in range(4)]
    rows = []
    for k in range(400):
        sentences = [list(rng.choice(words, 6)) for _ in range(int(rng.integers(1, 6)))]
        toxic = int(rng.random() < 0.3)
        if toxic or rng.random() < 0.05:
            sentences[0].append("slur")
        rows.append((". ".join(" ".join(s) for s in sentences), toxic))
    model = toxicity.fit(rows, rounds=2000, rate=0.05, decay=1e-2)
    assert model.weights

    def likelihood(bias, weights):
        total = 0.0
        for text, y in rows:
            clean = 1.0
            for s in toxicity.SENTENCE.findall(text.lower()):
                z = bias + sum(weights.get(f, 0.0) for w in set(toxicity.WORD.findall(s)) for f in toxicity.word_features(w))
                clean *= 1 / (1 + math.exp(z))
            total += math.log(1 - clean) if y else math.log(clean)
        return total / len(rows) - 0.5e-2 * sum(w * w for w in weights.values())

    at = likelihood(model.bias, model.weights)
    for step in (1e-2, -1e-2):
        assert likelihood(model.bias + step, model.weights) <= at + 1e-6
        for f in list(model.weights)[:8]:
            assert likelihood(model.bias, model.weights | {f: model.weights[f] + step}) <= at + 1e-6


def test_scores_are_the_noisy_or_of_sentences(spark, edges):
    model = toxicity.Model(-2.0, {"=word": 0.5, "sec": 1.5, "=null": 4.0})
    got = {(r.doc_id, r.n_sentences): r for r in toxicity.score(edges, model).collect()}
    for i, t, _ in EDGES:
        parts = [set(re.findall(r"\w+", s)) for s in re.split(r"[.!?\n]", (t or "").lower())]
        parts = [p for p in parts if p] or [set()]
        ps = [1 / (1 + math.exp(-(-2.0 + sum(model.weights.get(f, 0.0) for w in p for f in toxicity.word_features(w))))) for p in parts]
        assert got[i, len(parts)].score == pytest.approx(1 - math.prod(1 - p for p in ps))


def test_very_long_texts_are_scored_whole(spark):
    model = toxicity.Model(-9.0, {"=slur": 18.0})
    docs = frame(spark, [(1, "word word. " * 300_000 + "slur", None), (2, "word " * 1_000_000, None)])
    assert {r.doc_id: r.score > 0.9 for r in toxicity.score(docs, model).collect()} == {1: True, 2: False}
    assert [r.doc_id for r in toxicity.without_toxic(docs, model).select("doc_id").collect()] == [2]


def test_toxicity_without_labels_or_documents(spark, edges, nothing):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(edges, empty)
    assert all(0 <= r.score <= 0.3 for r in toxicity.score(edges, model).collect())
    assert toxicity.score(nothing, model).count() == 0
    noted = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, 5), (9, 0)], "doc_id long, toxic int")
    assert toxicity.learn(edges, noted) is not None


def test_held_out_accuracy(spark, data):
    found = registry.queries()["op1_noisy_or_toxicity"](spark, data).toPandas()
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert len(found) == docs and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()


def test_learning_separates_the_shared_labels(spark):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the shared tables aren't here")
    found = registry.queries()["op1_noisy_or_toxicity"](spark, path).toPandas().merge(spark.read.parquet(f"{path}/labels.parquet").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95


# -- decontamination


def test_planted_items_are_found_and_others_left(spark, edges, nothing):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    items = [(k, " ".join(word() for _ in range(20)) + ".\n" + " ".join(word() for _ in range(4))) for k in range(30)] + [(None, None), (77, ""), (5, "only.\nword")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{filler(int(rng.integers(0, 400)))} {items[k][1].upper().replace('.', ' ,')} {filler(90)}", "s") for k in range(30)] + [(100 + k, filler(300), "s") for k in range(20)]
    rows += [(200, items[0][1].split("\n")[0] + filler(100), "s"), (201, items[1][1].split("\n")[0][: 60] + " " + filler(50), "s"), (None, None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    for limit in (decontamination.ITEM_BYTES, 1500):
        got = decontamination.contaminated(docs, benchmark, max_bytes=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(30)}
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 30
    assert decontamination.contaminated(nothing, benchmark).count() == 0
    assert decontamination.contaminated(edges, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.contaminated(edges, benchmark).count() == 0


# -- mixing


def test_mix_keeps_every_row_and_meets_its_target(spark, edges, nothing):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 10 else f"small{k % 30 // 10}") for k in range(3000)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, target_entropy=0.95, max_repeats=100.0).toPandas()
    assert set(got.doc_id) == set(range(3000))
    weights = got.groupby("source").weight.first()
    assert abs(-(weights * np.log(weights)).sum() / math.log(len(weights)) - 0.95) < 1e-3
    used = got.groupby("source").tokens.sum() / got.tokens.sum()
    assert (used - weights).abs().max() < 0.02
    limited = mixing.mix(docs, target_entropy=1.0, max_repeats=3.0).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert limited == 3
    few = mixing.mix(docs, budget=2000).agg({"tokens": "sum"}).first()[0]
    assert abs(few - 2000) < 300
    assert sorted(map(str, {r.doc_id for r in mixing.mixed_rows(edges).collect()})) == sorted({str(i) for i, _, _ in EDGES})
    assert mixing.mixed_rows(edges).columns == edges.columns
    assert mixing.mix(nothing).count() == 0


# -- pages


def test_region_of_pages(spark):
    page = (
        "<html><body><div class='menu'>Home <a href=/>News</a></div><div id=cookie-notice>We use cookies.</div><article><header><h1>Title &amp; more</h1></header><p>First   paragraph\nwith <b>bold</b> words.<p>Second one &lt;here&gt;."
        "<aside class=promo>Buy now</aside><ul><li>point one<li>point two</ul><script>if (a < b) {}</script></article><section class='comments'><p>I disagree with all of this.</p></section><footer>All rights reserved</footer></body></html>"
    )
    assert html.main_text(page) == "Title & more\nFirst paragraph with bold words.\nSecond one <here>.\npoint one\npoint two"
    pages = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<div><a href=1>only</a> <a href=2>links</a></div>", "x"), (4, "z", "a < b and c > d <p", "x")], "page_id long, url string, html string, text string")
    got = html.extract_pages(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got)[:3] == ["", "", ""]
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_main_text_of_all_pages_is_the_article(spark, data):
    import html as stdlib

    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    got = registry.queries()["op4_max_subsequence_html"](spark, data).toPandas().set_index("page_id").text
    for p in pages.itertuples():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        parts = [" ".join(stdlib.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", body)]
        assert got[p.page_id] == "\n".join(x for x in parts if x)


# -- token files and counts


def test_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint64).astype(np.uint32)
        assert (tokens.unpack(*tokens.pack(values), n) == values).all()


def test_ids_by_words_are_those_of_whole_texts():
    path = tokens.vocabulary("word_bpe_49k.json")
    encoder = tokens.WordEncoder(path)
    assert encoder.by_word
    rng = np.random.default_rng(1)
    pieces = ["a", "b. ", "H̱", "İ ", "é. ", "ß, ", " ", "The ", "\n", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "it's. ", "\x01", "1 ", "12.", " \x01 ", "…. ", "　", "\x1c", "ﬁ "]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 50)))) for _ in range(200)] + ["", "plain text."]
    ids, sizes = encoder(pa.array(texts, pa.string()))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert not tokens.WordEncoder(tokens.vocabulary("byte_bpe_50k.json")).by_word


def test_token_file_of_edges(spark, edges, nothing):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = tokens.token_file_digest(edges, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    sizes = Counter((i, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in EDGES)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == sizes
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and [r.doc_id for r in got[:2]] == [None, None]
    assert tokens.token_file_digest(nothing, path).count() == 0


def test_token_file_digests_are_those_of_the_ids(spark, edges):
    from tokenizers import Tokenizer

    path = tokens.vocabulary("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in EDGES:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_file_digest(edges, path).collect()) == want


def test_token_files_read_back_whole(spark, tmp_path):
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, f"the number {k} and some more words") for k in range(50)], "doc_id long, text string")
    tokens.write_tokens(docs, f"file://{tmp_path}/t", path, block_tokens=30)
    got = tokens.read_tokens(spark, f"file://{tmp_path}/t").orderBy("doc_id").collect()
    encoder = tokens.WordEncoder(path).tokenizer
    assert [r.ids for r in got] == [encoder.encode(f"the number {k} and some more words", add_special_tokens=False).ids + [1] for k in range(50)]


def test_counts_over_chunks(spark, edges, nothing):
    counter = counts.PieceCounter(tokens.vocabulary("piece_bpe_32k.model"))
    assert counter.stable
    rng = np.random.default_rng(2)
    pieces = ["a", "b ", " ", "  ", "the ", "\n", "é", "日本", "<s>", "   ", "zz", "▁", "x" * 5]
    for _ in range(60):
        t = "".join(rng.choice(pieces, int(rng.integers(0, 300))))
        n = len(counter.processor.encode(t))
        for chunk, overlap in ((20, 4), (50, 8), (7, 2), (100, 3)):
            assert counter.batch([t], chunk, overlap)[0][0] == n
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in counts.count_tokens(edges, tokens.vocabulary("piece_bpe_32k.model"), chunk=1000).collect()}
    assert all(got[i, len((t or "").encode())] == len(counter.processor.encode(t or "")) for i, t, _ in EDGES)
    assert counts.count_tokens(nothing, tokens.vocabulary("piece_bpe_32k.model")).count() == 0


# -- near-duplicates


def test_fingerprint_by_its_definition():
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        if not words:
            return 0
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for t in ["", " \n", "One", "one two", "A b c", "A b c d é É x", "word " * 50, "\x1c odd \x85 space"]:
        assert simhash.fingerprint(t) == slow(t)


@pytest.mark.parametrize("hot", [simhash.HOT_ANCHOR, 3])
def test_no_link_within_three_bits_is_lost(spark, hot):
    rng = np.random.default_rng(5)
    points = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)]
    for p in list(points[:25]):
        for _ in range(6):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                p ^= 1 << int(b)
            points.append(p)
    points = sorted(set(points) | {0, 7, 2**64 - 1})
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in points], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes, hot_anchor=hot)).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in points]
    group = {x: x for x in signed}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, p in enumerate(points):
        for q, y in zip(points[:a], signed[:a]):
            if (p ^ q).bit_count() <= 3:
                x, y = sorted((find(signed[a]), find(y)))
                group[y] = x
    assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_large_buckets_give_spanning_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    parts = simhash._links_of(np.zeros(len(fp), np.int64), fp, np.ones(len(fp), bool), 3)
    assert sum(len(a) for a, _ in parts) <= 2 * len(fp)


def test_near_duplicates_of_edges(spark, edges, nothing):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.component_id)
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[7] == 3 and by[5] == 5
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 5, 6, None, None]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_representatives_of_edges(spark, edges, nothing):
    ids = edges.select("doc_id").filter("doc_id is not null").distinct()
    assert sorted(r.doc_id for r in jaccard.representatives(edges, ids).collect()) == [1, 3, 5, 6]
    assert jaccard.representatives(nothing, nothing.select("doc_id")).count() == 0
    assert jaccard.representatives(edges, ids.limit(0)).count() == 0


def test_representatives_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = list(rng.choice(vocabulary, 90))
    texts = []
    for g in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 120))))
        base = common + base[:60] if g % 4 == 0 else base
        for _ in range(6):
            mine = list(base)
            at = int(rng.integers(0, len(base)))
            n = int(rng.integers(0, 2 + len(base) // 12))
            mine[at : at + n] = rng.choice(vocabulary, n)
            texts.append(" ".join(mine))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    for more in ({}, {"run_limit": 2}, {"run_limit": 2, "block_shingles": 300, "block_texts": 3}):
        got = sorted(r.doc_id for r in jaccard.representatives(docs, docs.select("doc_id"), **more).collect())
        assert got == sorted(set(root)) and 60 < len(got) < 200


def test_components_of_a_chain(spark):
    chain = spark.range(200).selectExpr("id AS u", "id + 1 AS v")
    assert {(r.node, r.root) for r in connected_components(chain).collect()} == {(k, 0) for k in range(201)}
    assert connected_components(chain.limit(0)).count() == 0


# -- media


def test_containers_hold_payloads_and_say_where(spark, edges, nothing):
    for n in (64, 128, 64 * 31, 64 * 32, 64 * 33, 64 * 100):
        payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
        raw = media.build(payload)
        (track,) = media.describe(raw)
        assert track["codec"] == "raw " and track["kind"] == "vide" and track["n_samples"] == n // 64 and track["seconds"] == n / 64 / 25
        assert [raw[o : o + s] for o, s in track["keyframes"]] == [payload[k : k + 64] for k in range(0, n, 64 * 16)]
    with pytest.raises(ValueError):
        media.build(b"")
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.media_digest(stored(media.media_of_texts(edges), "m")).collect())
    want = Counter()
    for i, t, _ in EDGES:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        whole = media.build(payload)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(whole), hashlib.sha256(whole).hexdigest()] += 1
    assert got == want
    assert media.media_of_texts(nothing).count() == 0


def test_payloads_are_read_by_the_sample_tables():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 70).astype(np.uint8).tobytes()
    raw = bytearray(media.build(payload))
    (track, offset, size), = media.read_tracks(raw)
    assert media.samples(raw, offset, size) == payload and media.samples(raw, offset[::-1], size)[:64] == payload[-64:]
    at = raw.index(b"co64") + 12
    raw[at : at + 8] = (int.from_bytes(raw[at : at + 8], "big") + 64).to_bytes(8, "big")
    (_, offset, size), = media.read_tracks(raw)
    assert media.samples(raw, offset, size)[: 64 * 31] == payload[64 : 64 * 32]
    raw[at : at + 8] = (1 << 40).to_bytes(8, "big")
    (_, offset, size), = media.read_tracks(raw)
    with pytest.raises(ValueError):
        media.samples(raw, offset, size)


def test_features_say_what_the_container_holds(spark):
    docs = spark.createDataFrame([(1, "x" * 64 * 20), (2, "x" * 64 * 20)], "doc_id long, text string")
    a, b = media.media_digest(stored(media.media_of_texts(docs), "m")).orderBy("doc_id").collect()
    assert a.feature == b.feature and a.media_sha256 == b.media_sha256
    found = json.loads(a.feature)
    assert found["codec"] == "raw " and found["seconds"] == 20 / 25 and found["n_samples"] == 20 and len(found["keyframes"]) == 2


def test_malformed_containers_are_reported(spark):
    good = media.build(bytes(64))
    rows = [(1, bytearray(good)), (2, bytearray(good[:50])), (3, None), (4, bytearray(b"")), (5, bytearray(b"not a box at all, really"))]
    got = {r.doc_id: r for r in media.media_tracks(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].error is None and len(got[1].tracks) == 1
    assert got[2].error and got[5].error and got[3].tracks == [] and got[4].tracks == []


# -- shards and lines


def test_shards_of_edges(spark, edges, nothing):
    got = sharding.shard_by_bytes(edges).toPandas()
    assert len(got) == len(EDGES) and got["size"].sum() == sum(len((t or "").encode()) + 1 for _, t, _ in EDGES)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    many = frame(spark, [(k, "x" * (k % 50), None) for k in range(2000)])
    sizes = sharding.shard_by_bytes(many).groupBy("shard").agg({"size": "sum"}).toPandas()["sum(size)"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 100
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_repeated_ids_with_different_texts_match_the_sql(spark, tmp_path):
    three = "one\ntwo\nthree"
    rows = [(1, f"b\n{three}"), (1, f"a\n{three}"), (1, f"{three}\nz"), (2, three), (None, three), (2, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = lines.drop_repeated_windows(docs).toPandas()
    assert difference(got, connect(str(tmp_path)).execute(lines.OP10_SQL).df()) is None


def test_no_column_name_clashes(spark):
    names = ["nth", "times", "block", "h", "kept", "first", "at", "w1", "lines", "gone", "anchor", "fp"]
    docs = spark.createDataFrame([(k, "same text here" if k < 3 else f"other {k}", "s", *range(len(names))) for k in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == 6
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert {(r.nth, r.times, r.fp) for r in kept.collect()} == {(0, 1, 11)}


def test_repeated_windows_go_but_the_first(spark, edges, nothing):
    text = "a\nb\nc\nd"
    docs = frame(spark, [(1, f"x\n{text}\ny", None), (2, f"p\n{text}", None), (3, "a\nb", None), (4, "b\nc\nd\n\nq\nb\n c \nd", None)])
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.drop_repeated_windows(docs).collect()}
    assert got == {1: (f"x\n{text}\ny", 0), 2: ("p", 4), 3: ("a\nb", 0), 4: ("\nq", 6)}
    same = lines.drop_repeated_windows(edges).collect()
    assert len(same) == len(EDGES)
    assert Counter((r.doc_id, r.n_removed) for r in same)[(2, 3)] == 2
    assert lines.drop_repeated_windows(nothing).count() == 0
