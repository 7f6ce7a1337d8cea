"""Toxicity model, neighbour graphs and language fusion: held-out accuracy, recall and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import hnsw, langid, toxicity

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxic_documents_of_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    o = toxicity.MilOptions()
    learn = toxicity.training_labels(labels)
    assert not any(held(r.doc_id) for r in learn.collect())
    model = toxicity.fit(spark, docs, learn, o)
    found = toxicity.score_documents(docs, model, o.threshold).toPandas().set_index("doc_id")
    assert len(found) == docs.count()
    assert all(found.held_out == [held(d) for d in found.index])
    truth = {r.doc_id: r.toxic for r in labels.collect() if held(r.doc_id)}
    hit = [found.predicted[d] for d, t in truth.items() if t]
    clean = [found.predicted[d] for d, t in truth.items() if not t]
    assert np.mean(hit) >= 0.5 and np.mean(clean) <= 0.03  # about 300 labelled rows


def test_offending_sentence_is_found():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts, toxic = [], []
    for i in range(400):
        sentences = [" ".join(word() for _ in range(6)) + "." for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k].replace(" ", " zork ", 1)
        texts.append(" ".join(sentences))
        toxic.append(int(i % 5 == 0))
    scorer = toxicity.Scorer(toxicity.train(texts, toxic, toxicity.MilOptions()))
    for text, t in zip(texts, toxic):
        score, a, b, _ = scorer.document(text)
        assert (score >= 0.3) == bool(t)
        if t:
            assert "zork" in text[a:b]


def test_odd_texts_and_labels(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "no id"), (4, "word " * 9000), (4, "word " * 9000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    o = toxicity.MilOptions()
    model = toxicity.fit(spark, docs, labels, o)
    assert model == (o.bias, {})
    found = toxicity.score_documents(docs, model, o.threshold).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2)} == {0.0}
    assert toxicity.reject_toxic(docs, model, o.threshold).count() == 6
    assert toxicity.score_documents(docs.limit(0), model, 0.3).count() == 0
    assert toxicity.fit(spark, docs.limit(0), labels.limit(0), o) == (o.bias, {})


def test_very_long_labelled_document_is_passed_over(spark):
    o = toxicity.MilOptions(sample_chars=20_000)
    ids = spark.range(400).withColumnRenamed("id", "doc_id")
    first = ids.orderBy(F.xxhash64("doc_id", F.lit(o.seed)), "doc_id").first().doc_id
    rows = [(i, "word " * 9000 if i == first else f"some plain w{i % 7} words." + " zork" * (i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    _, weights = toxicity.fit(spark, df.select("doc_id", "text"), df.select("doc_id", "toxic"), o)
    assert weights.get("=zork", 0) > 0


def test_all_labels_alike():
    assert toxicity.train(["a b", "c"], [1, 1], toxicity.MilOptions())[1] == {}


# ---- neighbours -------------------------------------------------------------------------------------------------------


def brute(rows, query, k):
    best = []
    for vec_id, v in rows:
        if vec_id != query[0] and v is not None and len(v) == len(query[1]) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best.append((-float(np.dot(np.array(v, np.float64), np.array(query[1], np.float64))), vec_id))
    return sorted(set(best))[:k]


def test_recall_on_clusters_and_copies(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 24))
    points = np.concatenate([centres[rng.integers(0, 20, 2500)] + 0.3 * rng.normal(size=(2500, 24)), np.repeat(rng.normal(size=(1, 24)), 900, axis=0)]).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in hnsw.nearest(spark, df, df.filter("vec_id % 20 = 0"), 20, hnsw.GraphOptions(shard_rows=600)).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, own in found.items():
        exact = brute(rows, rows[q], 20)
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(r.score == pytest.approx(float(np.dot(points[q].astype(float), points[r.vec_id].astype(float)))) for r in own)
        hits += len({v for _, v in exact} & {r.vec_id for r in own})
        total += 20
    assert len(found) == 170 and hits / total >= 0.9


def clustered(n, dim=32):
    """Clusters, unequal norms and many copies."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(40, dim))
    points = centres[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, dim))
    points *= rng.lognormal(0, 0.5, size=(n, 1))
    points[: n // 10] = points[0]
    return points.astype(np.float32)


@pytest.mark.parametrize("n", [250, 1000, 5000])
def test_graph_has_layers_and_recall(n):
    points = hnsw.lengthened(np.unique(clustered(n), axis=0))
    inserted = []
    insert = hnsw._insert
    hnsw._insert = lambda graph, batch, o, lowest: (inserted.extend(batch.tolist()), insert(graph, batch, o, lowest))
    try:
        graph = hnsw.build(points, hnsw.GraphOptions())
    finally:
        hnsw._insert = insert
    assert len(graph.layers) > 1 and len(set(inserted)) > 0.85 * len(points) and len(graph.layers[0][0]) < len(points) / 8
    queries = np.concatenate([clustered(n)[-200:], np.zeros((min(n, 200), 1), np.float32)], axis=1)
    found, _ = graph.search(queries, 96)
    exact = np.argsort(-(queries @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(f[:20]) & set(e)) / 20 for f, e in zip(found.tolist(), exact.tolist())]) >= 0.9


def test_recall_of_large_shards(spark):
    points = clustered(6000)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    found = {}
    for r in hnsw.nearest(spark, df, df.filter("vec_id % 40 = 0"), 20, hnsw.GraphOptions(least_shards=2)).collect():
        found.setdefault(r.query_id, []).append(r.score)
    hits = 0
    for q, scores in found.items():
        exact = np.sort(np.delete(points.astype(np.float64) @ points[q].astype(np.float64), q))[::-1][:20]
        hits += sum(s >= exact[-1] - 1e-9 for s in scores)
    assert len(found) == 150 and hits / (20 * 150) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])]
    rows += [(3, [-1.0, 5.0]), (4, [1.0, 1.0, 1.0]), (120, []), (None, [3.0, 3.0]), (0, [1.0, 0.0]), (140, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    found = hnsw.nearest(spark, df, df.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0), (140, 1, 4, 27.0)]
    assert hnsw.nearest(spark, df.limit(0), df.limit(0), 20).count() == 0


# ---- languages --------------------------------------------------------------------------------------------------------


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}-x{chr(34)}' if lang else ''}><script>var x='the the';</script><body><p>{text}</p></body></html>"


@pytest.fixture
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_text_alone_is_accurate(spark, corpus):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = pages.withColumns({"html": F.regexp_replace("html", 'lang="..', ""), "url": F.lit(None).cast("string")})
    truth = {r.page_id: r.t for r in pages.select("page_id", F.regexp_extract("html", 'lang="(..)', 1).alias("t")).collect()}
    found = langid.identify(spark, bare, corpus).collect()
    assert np.mean([truth[r.page_id] == r.lang for r in found]) >= 0.98


def test_evidence_decides_when_text_does_not(spark, corpus):
    texts = {r.lang: r.text for r in corpus.filter("length(text) > 800").collect()}
    rows = [(i, f"https://www.many.example.org/{i}", page(texts["fr"][:400], "fr")) for i in range(40)]
    rows += [(100, "https://www.many.example.org/x", page("12345")), (101, "https://other.somewhere.net/x", page("12345", "es")), (102, "https://some.site.de/x", page("1"))]
    rows += [(103, None, None), (104, "::bad::", ""), (105, "https://www.many.example.org/y", page(texts["de"], "fr")), (105, "https://www.many.example.org/y", page(texts["de"], "fr"))]
    rows += [(None, "https://many.elsewhere.net/es/1", page("7"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, lang string")
    found = langid.identify(spark, df, corpus).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r for r in found}
    assert got[100].lang == "fr" and got[101].lang == "es" and got[102].lang == "de" and got[105].lang == "de" and got[None].lang == "es"
    assert got[105].declared == "fr" and got[103].host is None and all(0 < r.probability <= 1 for r in found)


def test_no_pages_or_no_languages(spark, corpus):
    df = spark.createDataFrame([(1, "http://a.example.com", "<p>x</p>")], "page_id long, url string, html string")
    assert langid.identify(spark, df.limit(0), corpus).count() == 0
    r = langid.identify(spark, df, corpus.limit(0)).first()
    assert r.lang is None and r.probability == 0.0
