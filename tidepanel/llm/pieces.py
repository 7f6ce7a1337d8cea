"""Token counts of a sentencepiece BPE model by rank-synchronous merging of arrays.

The pre-tokens of many texts are held as one ragged numpy array of symbols. In each round every sequence finds the lowest
rank among its adjacent pairs and merges that pair wherever it stands, all sequences at the same time; symbols that survive
are the tokens. Distinct pre-tokens go through the arrays once per worker, their counts are then looked up.

A sequence ends where no piece of the vocabulary holds the two neighbouring characters, since no merge can cross that place.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import plain_documents, slices

SPACE = "▁"  # stands for a space in pieces
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.iinfo(np.int32).max  # rank of a pair that doesn't merge


@dataclass(frozen=True)
class CountOptions:
    """limit: tokens above which a document is over the limit. A worker remembers at most `remembered` pre-tokens, none longer
    than `longest` characters. Sequences of more than `rounds_up_to` symbols are merged from a heap, as rounds over them
    would take quadratic time; the result is the same."""

    model: str | None = None
    limit: int = 4096
    remembered: int = 1_000_000
    longest: int = 64
    rounds_up_to: int = 4096


def default_model() -> str:
    """Path of the model file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = (8, i) if tag & 7 == 1 else (4, i) if tag & 7 == 5 else number(i)
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the pieces that text can merge into. Other kinds of models are refused."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    trainer = dict(_fields(next((v for n, v in parts if n == 2), b"")))
    found = [dict(_fields(v)) for n, v in parts if n == 1]
    kinds = {p.get(3, 1) for p in found}
    if trainer.get(3) != 2 or not trainer.get(35) or kinds - {1, 2, 3, 6}:
        raise ValueError("a BPE model with byte fallback and without user-defined or unused pieces is needed")
    return [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0) for p in found if p.get(3, 1) == 1]


class Merger:
    """The merges of a model as sorted arrays, and counts of symbols that survive them."""

    def __init__(self, pieces: list[tuple[str, float]], rounds_up_to: int = 4096):
        self.rounds_up_to = rounds_up_to
        ids = {p: i for i, (p, _) in enumerate(pieces)}
        _, rank = np.unique([-s for _, s in pieces], return_inverse=True)  # equal scores share a rank, the leftmost pair goes first
        chars = sorted({c for p, _ in pieces for c in p} - ids.keys())
        symbols = ids | {c: len(ids) + k for k, c in enumerate(chars)}
        self.n = len(symbols) + 1  # the last symbol stands for any character that no piece holds
        self.symbol = np.full(0x110000, self.n - 1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        merges, hasty, near = {}, set(), set()
        for piece, i in ids.items():
            near.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    merges[left * self.n + right] = i
                    hasty.update(x for x in (left, right) if x < len(ids) and len(pieces[x][0]) > 1 and rank[x] >= rank[i])
        self.pairs = np.array([*sorted(merges), np.iinfo(np.int64).max])
        self.merged = np.array([merges[k] for k in self.pairs[:-1].tolist()] + [0], np.int32)
        self.rank = np.append(rank[self.merged[:-1]], NONE).astype(np.int32)
        # ranks after whose merge a pair of no higher rank may arise: their places are merged one at a time, from the left
        self.one_by_one = np.zeros(int(rank.max(initial=0)) + 1, bool)
        self.one_by_one[[rank[x] for x in hasty]] = True
        self.near = np.array(sorted(int(self.symbol[ord(a)]) * self.n + int(self.symbol[ord(b)]) for a, b in near), np.int64)
        self.cuts_before_space = all(b != SPACE or a == SPACE for a, b in near)
        self.whole = len(ids)  # symbols from here on are characters without a piece: one token for each byte

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair; the last one, of rank NONE, if there is none."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.pairs, key)
        at[self.pairs[at] != key] = len(self.pairs) - 1
        return at

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each string, which ends and begins nowhere inside a merge."""
        if not tokens:
            return np.zeros(0, np.int64)
        code = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32)
        symbol = self.symbol[code]
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        key = symbol[:-1].astype(np.int64) * self.n + symbol[1:]
        joined = (owner[:-1] == owner[1:]) & np.isin(key, self.near)
        starts = np.flatnonzero(np.concatenate([[True], ~joined])) if len(code) else np.zeros(0, np.int64)
        size = np.diff(starts, append=len(code))
        bare = symbol >= self.whole
        width = np.where(bare, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        counts = np.bincount(owner, width, len(tokens)).astype(np.int64)
        long = np.flatnonzero(size > self.rounds_up_to)
        for s, n in zip(starts[long].tolist(), size[long].tolist()):
            counts[owner[s]] -= self._merges_by_heap(symbol[s : s + n].tolist())
        pick = (size > 1) & (size <= self.rounds_up_to)
        keep = np.repeat(pick, size)
        sequence = np.repeat(np.arange(len(starts)), size)[keep]
        return counts - self._merges_by_rounds(symbol[keep], sequence, owner[starts], len(tokens))

    def _merges_by_rounds(self, symbol: np.ndarray, sequence: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many merges each owner's sequences see; `sequence` ascends, `owner` maps it to 0 .. n - 1."""
        done = np.zeros(n, np.int64)
        at = self._pairs_of(symbol, sequence)
        while len(symbol):
            rank = self.rank[at]
            opens = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            size = np.diff(opens, append=len(symbol))
            low = np.minimum.reduceat(rank, opens)
            alive = low != NONE
            if not alive.all():  # sequences without a pair are finished
                keep = np.repeat(alive, size)
                symbol, sequence, at, rank = symbol[keep], sequence[keep], at[keep], rank[keep]
                low, size = low[alive], size[alive]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            run = np.concatenate([[True], (np.diff(hit) > 1) | (sequence[hit[1:]] != sequence[hit[:-1]])])
            first_of_run = np.flatnonzero(run)
            place = np.arange(len(hit)) - np.repeat(first_of_run, np.diff(first_of_run, append=len(hit)))
            take = place % 2 == 0  # of overlapping places the first, third, ...
            single = self.one_by_one[rank[hit]]
            if single.any():
                take &= ~single | np.concatenate([[True], sequence[hit[1:]] != sequence[hit[:-1]]])
            hit = hit[take]
            done += np.bincount(owner[sequence[hit]], minlength=n)
            symbol[hit] = self.merged[at[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # places of the merged symbols in the shorter arrays
            symbol, sequence, at = symbol[keep], sequence[keep], at[keep]
            touched = np.concatenate([moved, moved[moved > 0] - 1])
            at[touched] = self._pairs_of(symbol, sequence, touched)
        return done

    def _pairs_of(self, symbol: np.ndarray, sequence: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """Merge of each symbol with the next one of its sequence, at all places or some."""
        if not len(symbol):
            return np.zeros(0, np.int64)
        where = np.arange(len(symbol)) if where is None else where
        after = np.minimum(where + 1, len(symbol) - 1)
        found = self._lookup(symbol[where], symbol[after])
        return np.where((after > where) & (sequence[after] == sequence[where]), found, len(self.pairs) - 1)

    def _merges_by_heap(self, symbol: list[int]) -> int:
        """Merges in one long sequence: the lowest rank first, from the left."""
        n, done = len(symbol), 0
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        table = getattr(self, "table", None)
        if table is None:
            table = self.table = {k: (r, m) for k, r, m in zip(self.pairs[:-1].tolist(), self.rank.tolist(), self.merged.tolist())}
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                found = table.get(symbol[i] * self.n + symbol[after[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, symbol[i], symbol[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue
            symbol[i], symbol[j] = table[left * self.n + right][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            done += 1
            push(before[i])
            push(i)
        return done


class _Known(dict):
    """pre-token -> index of its count; new ones wait in `fresh`."""

    def __missing__(self, token):
        index = self[token] = len(self)
        self.fresh.append(token)
        return index


class Counter:
    """count(texts) gives the number of tokens of each text."""

    def __init__(self, o: CountOptions):
        import sentencepiece

        path = o.model or default_model()
        self.o, self.merger = o, Merger(read_pieces(path), o.rounds_up_to)
        self.normalize = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        self._forget()

    def _forget(self) -> None:
        self.known, self.counts = _Known(), np.zeros(0, np.int64)
        self.known.fresh = []

    def count(self, texts: list[str]) -> np.ndarray:
        own = [self.normalize(t) for t in texts]
        own = [PRE_TOKEN.findall(t) if self.merger.cuts_before_space else [t] for t in own]
        if len(self.known) > self.o.remembered:
            self._forget()
        kept = len(self.known)
        index = [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in own]
        fresh, self.known.fresh = self.known.fresh, []
        self.counts = np.concatenate([self.counts, self.merger.count(fresh)])
        found = np.array([int(self.counts[i].sum()) for i in index], np.int64)
        if any(len(t) > self.o.longest for t in fresh):  # forget the long ones: take all that came with them out of the memo
            for t in fresh:
                del self.known[t]
            self.counts = self.counts[:kept]
            short = [t for t in fresh if len(t) <= self.o.longest]
            for t in short:
                self.known[t] = len(self.known)
            self.counts = np.concatenate([self.counts, self.merger.count(short)])
        return found


_COUNTERS: dict[CountOptions, Counter] = {}


def _count(o: CountOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if o not in _COUNTERS:
            _COUNTERS[o] = Counter(o)
        for batch in slices(batches, "text"):
            n = _COUNTERS[o].count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, options: CountOptions = CountOptions()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than `options.limit` tokens).

    A missing or empty text has no bytes and no tokens. Repeated rows and rows without doc_id stay, extra columns are ignored,
    an empty table gives no rows. Texts of any length count whole; nothing is shuffled.
    """
    rows = plain_documents(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_count(options), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > options.limit)
