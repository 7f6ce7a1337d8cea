"""Fingerprints: boundaries against a byte-wise loop, shifts, order of documents."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import chunks

O = chunks.ChunkOptions()


def slow_lengths(data: bytes):
    """One byte after another, with the definition of the gear hash."""
    out, s = [], 0
    while s < len(data):
        h, cut = 0, None
        for i in range(max(0, s - 31), len(data)):
            h = (h * 2 + int(chunks.GEAR[data[i]])) % (1 << 32)
            n = i + 1 - s
            if n < O.least and i + 1 < len(data):
                continue
            bits = O.hard_bits if n <= O.normal else O.easy_bits
            if i + 1 == len(data) or n >= O.most or (n >= O.least and h >> (32 - bits) == 0):
                cut = i + 1
                break
        out.append(cut - s)
        s = cut
    return out


def lengths(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    starts = [e - len(t) for e, t in zip(ends, texts)]
    cuts, counts = chunks.boundaries(data, starts, ends, O)
    out, k = [], 0
    for n, e in zip(counts, ends):
        own = cuts[k : k + n]
        out.append([b - a for a, b in zip(own, [*own[1:], e])])
        k += n
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=4))
def test_boundaries(texts):
    assert lengths(texts) == [slow_lengths(t) for t in texts]


def test_insertion_moves_few_chunks():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()
    a, b = chunks.fingerprints([text, text[:9000] + b"an insertion" + text[9000:]], O)
    assert chunks.likeness(a, b) > 0.95
    other = chunks.fingerprints(["".join(rng.choice("abcdefgh ") for _ in range(20_000)).encode()], O)[0]
    assert chunks.likeness(a, other) < 0.02
    part = chunks.fingerprints([text[5000:9000]], O)[0]
    assert chunks.likeness(a, part) > 0.9


def test_likeness_of_empty_sets():
    assert chunks.likeness({}, {}) == 1.0 and chunks.likeness({}, {1: 5}) == 0.0 and chunks.as_text({}) == ""


ROWS = [(3, "three " * 50), (1, ""), (2, None), (7, "é" * 5), (5, "five " * 2000), (5, "five " * 2000), (None, "no id")]


def test_documents_in_descending_order(spark):
    for partitions in (1, 9):
        docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_chars int").repartition(partitions)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = chunks.fingerprint_documents(spark, docs).collect()
        ordered = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        expected = []
        for (d, t), (_, f) in zip(ordered, [*ordered[1:], ordered[0]]):
            new = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
            a, b, c = (chunks.fingerprints([x.encode()], O)[0] for x in (t, new, f))
            expected.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), chunks.as_text(a), chunks.as_text(b), chunks.likeness(a, b), chunks.likeness(a, c)))
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
        assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_one_and_no_row(spark):
    docs = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert chunks.fingerprint_documents(spark, docs).first().near_next == 1.0
    assert chunks.fingerprint_documents(spark, docs.limit(0)).count() == 0
