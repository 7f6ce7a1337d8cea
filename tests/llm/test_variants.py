"""Spelling variants against sets of shortened words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import queries, variants

SF = "/root/testdata/sf0.001"


def brute_counts(rows, letters=7, least=2, damage=31):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def brute(counts, times=10):
    shorter, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shorter[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), words in shorter.items():
        for w in words:
            near[w] |= words - {w}
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= times * counts[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def as_dict(found):
    rows = found.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_dict(queries.op13_spelling_variants(spark, SF)) == brute(brute_counts(rows))


def planted(seed):
    """Words of two letters, so that most have near words, runs of equal letters, chains of forms, shared openings."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    words += ["aaaa" * k for k in range(1, 6)] + ["a" * k for k in range(2, 12)]
    text = [w for w in words for _ in range(rng.choice([1, 2, 3, 20, 40, 400]))]
    rng.shuffle(text)
    return [(i, " ".join(text[i * 200 : i * 200 + 200]).title() + "x9×") for i in range(len(text) // 200 + 1)]


@pytest.mark.parametrize(("seed", "parts"), [(1, 3), (2, 29)])
def test_planted(spark, seed, parts):
    rows = planted(seed)
    o = variants.VariantOptions(letters=2, times=3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = as_dict(variants.spelling_variants(spark, docs, o))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = brute(brute_counts(rows, letters=2), times=3)
    assert found == expected
    assert any(form is not None and form != root for form, root, *_ in expected.values())


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(13)
    found = {r.word: r for r in variants.number_nodes(spark, frame, F.col("word")).collect()}
    assert [found[w].place for w in words] == list(range(len(words)))
    number = {}
    for w in words:
        assert len(found[w].path) == len(w) + 1
        for k, node in enumerate(found[w].path):
            assert number.setdefault(w[:k], node) == node
    assert len(set(number.values())) == len(number) and max(number.values()) == len(number) - 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Wordword wordword", "x"), (3, "wordwordé wordwordÉ", "x"), (3, "wordwordé wordwordÉ", "x"), (4, "short " * 9, "x"), (5, "y" * 200_000, "x"), (6, "y" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    found = as_dict(variants.spelling_variants(spark, docs, variants.VariantOptions(damage=0)))
    assert found == {**brute(brute_counts([r[:2] for r in rows if r[0] not in (5, 6)], damage=0)), "y" * 200_000: (None, "y" * 200_000, 2, 0, None)}
    assert found["wordword"][3] == 2 and found["wordwordé"][3] == 2
    assert as_dict(variants.spelling_variants(spark, docs.limit(0))) == {}
