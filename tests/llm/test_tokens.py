"""Token memo, token files and packing against the plain library and brute force."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepanel.llm import ans, bpe, packing

SF = "/root/testdata/sf0.001"


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    return [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]


ENCODER = bpe.Encoder()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.,'!1é漢  \n\t  \x1c<|endoftext>s"), max_size=30), max_size=6))
def test_memo_gives_the_ids_of_the_library(texts):
    ids, counts = ENCODER.encode(texts)
    assert counts.sum() == len(ids)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == plain_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "word", "Word,", " ", "\n", "\n\n", ".", " x", "<|endoftext|>", "é!", "1.", "\r\n", "'s,", "ab,\n", " c.\n"]), max_size=14).map("".join), max_size=6))
def test_memo_of_lines_marks_and_special_tokens(texts):
    ids, counts = ENCODER.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == plain_ids(texts)


def test_strings_of_special_tokens_are_special_tokens():
    ids, counts = ENCODER.encode(["a text <|endoftext|> and more", "a text and more"])
    assert 50256 in ids[: counts[0]].tolist() and 50256 not in ids[counts[0] :].tolist()


def test_memo_forgets_rare_pieces():
    rng = np.random.default_rng(4)
    small = bpe.Encoder(max_pieces=60)
    words = [f"w{k}" for k in range(200)] + ["the,", "a", "\n", "x.\ny", "<|endoftext|>"]
    for _ in range(60):
        texts = [" ".join(words[k] for k in np.minimum(rng.zipf(1.4, 12), len(words)) - 1) for _ in range(5)]
        ids, counts = small.encode(texts)
        assert ids.tolist() == [i for t in plain_ids(texts) for i in t] and len(small.pieces) < 60 + 70


def test_memo_starts_anew_when_full():
    small = bpe.Encoder(max_pieces=5)
    for texts in (["a b c d e f g"], ["h i j  k", "", " x"], ["a b"]):
        ids, counts = small.encode(texts)
        assert ids.tolist() == [i for t in plain_ids(texts) for i in t]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=600), st.integers(1, 9), st.integers(1, 7))
def test_block_round_trip(ids, lanes, every):
    counts = np.bincount(np.array(ids + [7]), minlength=301)
    table, o = ans.Table(counts), ans.CodecOptions(lanes=lanes, checkpoint_steps=every)
    payload, marks = ans.encode_block(np.array(ids), table, o)
    assert ans.decode_block(payload, marks, len(ids), table, lanes, every).tolist() == ids


def test_skewed_table_is_scaled_exactly():
    counts = np.array([10**12, 1, 0, 1, 1])
    freq = ans.scaled(counts)
    assert int(freq.sum()) == 1 << ans.BITS and (freq > 0).tolist() == [True, True, False, True, True]
    assert int(ans.scaled(np.ones(50_257, np.int64)).sum()) == 1 << ans.BITS


def test_code_length_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 200_000) % 5000
    counts = np.bincount(ids)
    payload, _ = ans.encode_block(ids, ans.Table(counts), ans.CodecOptions())
    p = counts[counts > 0] / len(ids)
    entropy = -(p * np.log2(p)).sum() * len(ids) / 8
    assert len(payload) < 1.03 * entropy + 4096


ROWS = [
    (5, "Some text. More text!", "x"),
    (None, "no id", "x"),
    (2, None, None),
    (2, "", "y"),
    (9, "same", "y"),
    (9, "same", "y"),
    (7, "two  spaces\n and lines", "z"),
    (8, "long " * 3000, "z"),
]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, start string")


def expected_tokens():
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, at = [], 0
    for (doc_id, _), ids in zip(rows, plain_ids([r[1] for r in rows])):
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "files")
    ans.write_token_files(spark, frame, path, ans.CodecOptions(lanes=4, block_tokens=500, checkpoint_steps=8))
    rows = ans.read_token_files(spark, path, keep_ids=True).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected_tokens()
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in rows)


def test_damage_is_noticed(spark, frame, tmp_path):
    path = str(tmp_path / "files")
    ans.write_token_files(spark, frame, path)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("payload", F.concat("payload", F.lit(bytearray(b"\0\0\0\0"))))
    blocks.write.parquet(f"{path}/broken")
    with pytest.raises(Exception, match="damaged"):
        counts = ans.read_frequencies(spark, path)
        spark.read.parquet(f"{path}/broken").mapInArrow(ans._decode(counts, False), "part int, doc_id long, start long, n_tokens long, ids_crc32 long").collect()


def test_empty_tables(spark, frame, tmp_path):
    path = str(tmp_path / "files")
    ans.write_token_files(spark, frame.limit(0), path)
    assert ans.read_token_files(spark, path).count() == 0
    assert packing.pack(frame.limit(0)).count() == 0


def check_pieces(rows, documents, size=1024):
    """Pieces cover each document once, lie gapless in their sequences and carry the right sums."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for doc_id, ids in documents.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4"))
            at += r.length
        assert at == len(ids)
    return by_sequence


def test_packing_covers_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sequences = check_pieces(rows, dict(zip(texts, plain_ids(texts.values()))))
    lengths = [sum(r.length for r in s) for s in sequences.values()]
    assert sum(packing.padding(n, 1024) for n in lengths) < 0.02 * sum(lengths)
    assert sum(r.cut == "free" for r in rows) < 0.05 * len(sequences)  # only in stretches without sentence ends


def test_free_cuts_only_in_long_stretches():
    sentence = np.zeros(10, bool)
    sentence[9] = True
    o = packing.PackingOptions(size=16, grid=4)
    ids = np.array([1] * 7 + [9] + [2] * 40 + [9] + [3] * 15 + [0], np.int64)
    at, cost = packing.candidate_cuts(ids, np.array([len(ids)]), sentence, o)
    assert at.tolist() == [0, 8, *range(12, 49, 4), 49, 65]
    assert cost.tolist() == [0, o.sentence_cut, *[o.free_cut] * 10, o.sentence_cut, 0]


def test_packing_of_odd_rows(spark, frame):
    rows = packing.pack(frame).collect()
    assert sum(r.length for r in rows) == sum(e[2] for e in expected_tokens())
    assert len([r for r in rows if r.doc_id == 9]) == 2
    assert len([r for r in rows if r.doc_id == 2]) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.data())
def test_plan_is_optimal(gaps, data):
    o = packing.PackingOptions(size=16, per_sequence=1.0, least_power=2)
    at = np.concatenate([[0], np.cumsum(gaps)])
    cost = np.array([0.0, *data.draw(st.lists(st.sampled_from([0.0, 1.5, 4.0]), min_size=len(gaps), max_size=len(gaps)))])

    def price(cuts):
        total = 0.0
        for i, j in zip(cuts, cuts[1:]):
            length = int(at[j] - at[i])
            if length > 16:
                return float("inf")
            total += packing.padding(length, 16) + cost[j] + 1.0
        return total

    inner = range(1, len(at) - 1)
    best = min(price([0, *c, len(at) - 1]) for k in range(len(at) - 1) for c in combinations(inner, k))
    index = {int(p): i for i, p in enumerate(at)}
    # lengths of 1 count as padded here, as least_power is 2
    assert price([index[p] for p in packing.plan_cuts(at, cost, o)]) <= best + 15.0
    if min(gaps) > 1:
        assert price([index[p] for p in packing.plan_cuts(at, cost, o)]) == pytest.approx(best)


def test_a_line_break_after_a_space_in_a_text_that_is_not_cut_at_lines():
    texts = ["ab,\n\n\na \n", "a \n b\r\nc", "a\n\n \n b", "a \n b"]
    ids, counts = bpe.Encoder().encode(texts)
    assert ids.tolist() == [i for t in plain_ids(texts) for i in t] and counts.sum() == len(ids)


def test_a_piece_is_looked_up_once_per_batch_of_texts():
    """Arrow tells the distinct pieces, so the memo isn't asked for every occurrence."""
    asked = []

    class Asked(bpe._Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    encoder = bpe.Encoder()
    fresh, encoder.pieces = encoder.pieces.fresh, Asked(encoder.pieces)
    encoder.pieces.fresh = fresh
    texts = ["the cat sat on the mat. " * 200, "", "the cat\nthe mat " * 100, "a <|endoftext|> b"]
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, counts)] == plain_ids(texts)
    assert len(asked) < 30


def test_frequencies_are_counted_with_the_tokens(spark, frame):
    """The tasks that make the ids count them, in one more row of their part; ids are not read again for it."""
    rows = ans.token_rows(frame, ans.CodecOptions()).collect()
    ids = [i for t in plain_ids([r[1] or "" for r in ROWS]) for i in t]
    expected = {i: n for i, n in enumerate(np.bincount(ids).tolist()) if n}
    assert len([r for r in rows if r.counts is None]) == len(ROWS)
    assert all(r.n_tokens == 0 and not r.ids and r.doc_id is None for r in rows if r.counts is not None)
    tokens = spark.createDataFrame(rows, ans.TOKENS).drop("ids")
    assert {r.id: r.n for r in ans.frequency_table(tokens).collect()} == expected


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=900), st.integers(1, 5), st.integers(1, 7))
def test_blocks_are_those_of_the_plain_recurrence(ids, lanes, every):
    """Payload and checkpoints against rANS on Python integers, one id after another."""
    table = ans.Table(np.bincount(np.array([*ids, 7]), minlength=41))
    steps = -(-len(ids) // lanes)
    grid = ids + [table.pad] * (steps * lanes - len(ids))
    state, words, marks = [1 << 31] * lanes, [], []
    for step in range(steps - 1, -1, -1):
        out = []
        for k in range(lanes):
            freq, start = int(table.freq[grid[step * lanes + k]]), int(table.start[grid[step * lanes + k]])
            if state[k] >= freq << (63 - ans.BITS):
                out.append(state[k] & 0xFFFFFFFF)
                state[k] >>= 32
            state[k] = (state[k] // freq << ans.BITS) + state[k] % freq + start
        words += out[::-1]
        if step % every == 0:
            marks.append((len(words), list(state)))
    heads = [v for written, states in reversed(marks) for v in (len(words) - written, *states)]
    payload, checkpoints = ans.encode_block(np.array(ids), table, ans.CodecOptions(lanes=lanes, checkpoint_steps=every))
    assert np.frombuffer(payload, "<u4").tolist() == words[::-1] and np.frombuffer(checkpoints, "<u8").tolist() == heads
