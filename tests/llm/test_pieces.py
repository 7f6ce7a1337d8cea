"""Token counts by array merging against the library."""

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import pieces, queries

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
ROUNDS = pieces.Counter(pieces.CountOptions())
HEAP = pieces.Counter(pieces.CountOptions(rounds_up_to=2))
FORGETFUL = pieces.Counter(pieces.CountOptions(remembered=3, longest=2))
PARTS = ["a", "b", " ", "  ", "\n", "é", "漢", "the", "ing", "▁", "▁▁", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "😀", "1", ".", "\t", "x" * 9, " " * 7, "="]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=20), max_size=5))
def test_counts_are_those_of_the_library(texts):
    expected = [len(ids) for ids in LIBRARY.encode(texts)] if texts else []
    for counter in (ROUNDS, HEAP, FORGETFUL):
        assert counter.count(texts).tolist() == expected


@pytest.mark.parametrize("unit", [" ", "a", "=", "ab", "漢", "\n", "<s>"])
def test_runs(unit):
    texts = [unit * n for n in (0, 1, 2, 3, 5, 8, 31, 64, 100, 333)]
    expected = [len(ids) for ids in LIBRARY.encode(texts)]
    assert ROUNDS.count(texts).tolist() == HEAP.count(texts).tolist() == expected


def test_long_texts_without_spaces():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (4000, 4097, 50_000)]
    texts += [" " * 20_000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000)), "a" * 100_000]
    assert ROUNDS.count(texts).tolist() == [len(ids) for ids in LIBRARY.encode(texts)]


def test_pairs_that_bring_up_lower_ranks():
    """A merge may bring up a pair of lower rank; equal scores go from the left."""
    merger = pieces.Merger([(p, -float(s)) for p, s in (("a", 9), ("b", 9), ("aa", 5), ("aaa", 3), ("ab", 3), ("ba", 4), ("aab", 1))])

    def plain(text):
        rank = {"aa": 5, "aaa": 3, "ab": 3, "ba": 4, "aab": 1}
        own = list(text)
        while True:
            found = min(((rank[x + y], i) for i, (x, y) in enumerate(zip(own, own[1:])) if x + y in rank), default=None)
            if found is None:
                return len(own)
            own[found[1] : found[1] + 2] = ["".join(own[found[1] : found[1] + 2])]

    rng = random.Random(5)
    texts = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert merger.count(texts).tolist() == [plain(t) for t in texts]
    merger.rounds_up_to = 1
    assert merger.count(texts).tolist() == [plain(t) for t in texts]


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x12\x02\x18\x01")  # trainer: model type 1
    with pytest.raises(ValueError):
        pieces.read_pieces(str(path))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    counts = dict(zip([d.doc_id for d in docs], [len(ids) for ids in LIBRARY.encode([d.text or "" for d in docs])]))
    assert {d: r.n_tokens for d, r in found.items()} == counts
    assert all(r.n_bytes == len((d.text or "").encode()) and r.over_limit == (r.n_tokens > 4096) for d in docs for r in [found[d.doc_id]])


def test_odd_rows(spark):
    long = "word " * 300_000
    rows = [(1, None, 5, 1), (2, "", 5, 1), (None, "a text", 5, 1), (3, "same", 5, 1), (3, "same", 5, 1), (4, long, 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long, n_tokens int")
    found = pieces.count_tokens(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    size = len(LIBRARY.encode(long))
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    assert got == [(0, 6, len(LIBRARY.encode("a text")), False), (1, 0, 0, False), (2, 0, 0, False), (3, 4, 1, False), (3, 4, 1, False), (4, len(long), size, True)]
    assert pieces.count_tokens(docs.limit(0)).collect() == []
