"""Order-preserving packing by dynamic programming.

The ids of all documents, in ascending doc_id order, form one stream per range partition. A sequence is a window of the
stream. Cuts fall at document ends (free) or sentence ends; only a stretch without either that is longer than a sequence may be
cut inside, every `grid` ids. The plan minimises padding plus a penalty per cut and per sequence. The cheapest earlier cut within reach is the head of a monotone queue, as the cost of a
window is its padding and so differs from the queue's key by the same amount for all candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.bpe import worker_encoder
from tidepanel.llm.common import plain_documents, slices


@dataclass(frozen=True)
class PackingOptions:
    """size: ids of a sequence; the costs are in ids of padding. stream: ids planned together."""

    size: int = 1024
    sentence_cut: float = 2.0
    free_cut: float = 6.0
    per_sequence: float = 16.0
    grid: int = 128
    least_power: int = 64
    stream: int = 1 << 19
    vocabulary: str | None = None
    end_id: int = 0


def padding(length: int, size: int) -> int:
    """Ids that fill a sequence: none at a power of two, else up to `size`."""
    return 0 if length & (length - 1) == 0 else size - length


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, o: PackingOptions) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end and the penalty of each; 0 and the end of the stream are among them."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    cost[np.flatnonzero(sentence_end[ids]) + 1] = o.sentence_cut
    cost[doc_ends] = 0.0
    cost[0] = cost[n] = 0.0
    at = np.flatnonzero(np.isfinite(cost))
    for k in np.flatnonzero(np.diff(at) > o.size).tolist():
        cost[at[k] + o.grid : at[k + 1] : o.grid] = o.free_cut
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def plan_cuts(at: np.ndarray, cost: np.ndarray, o: PackingOptions) -> list[int]:
    """The positions of the chosen cuts, ascending, with 0 and the end."""
    n, size = len(at), o.size
    exact: list[list[int]] = [[] for _ in range(n)]  # earlier candidates at the distance of a power of two
    length = size >> 1
    while length >= o.least_power:
        where = np.searchsorted(at, at - length)
        hit = np.flatnonzero(at[where] == at - length)
        for j, i in zip(hit.tolist(), where[hit].tolist()):
            exact[j].append(i)
        length >>= 1
    pos, pen = at.tolist(), cost.tolist()
    best, back = [0.0] * n, [0] * n
    queue, keys, head = [0] * n, [0.0] * n, 0
    tail = 0  # the queue is queue[head:tail], keys ascending
    for j in range(1, n):
        key = best[j - 1] + pos[j - 1]
        while tail > head and keys[tail - 1] >= key:
            tail -= 1
        queue[tail], keys[tail] = j - 1, key
        tail += 1
        reach = pos[j] - size
        while pos[queue[head]] < reach:
            head += 1
        low, arg = keys[head] - reach, queue[head]
        for i in exact[j]:
            if best[i] < low:
                low, arg = best[i], i
        best[j], back[j] = low + pen[j] + o.per_sequence, arg
    cuts, j = [pos[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(pos[j])
    return cuts[::-1]


def sentence_ends(tokenizer) -> np.ndarray:
    """Which ids close a sentence: text that ends in . ! ? or holds a line break."""
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return np.array([name[-1:] in {".", "!", "?"} or "Ċ" in name for name in names])


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, cut string"


def _packer(o: PackingOptions):
    def flush(docs: list, arrays: list[np.ndarray], serial: int, sentence: np.ndarray) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate(arrays)
        sizes = np.array([n for _, n in docs], np.int64)
        ends = np.cumsum(sizes)
        cuts = np.array(plan_cuts(*candidate_cuts(ids, ends, sentence, o), o), np.int64)
        bounds = np.unique(np.concatenate([cuts, ends]))
        a = np.concatenate([[0], bounds[:-1]]) if bounds[0] else bounds[:-1]
        b = bounds[bounds > 0]
        doc = np.searchsorted(ends, a, side="right")
        window = np.searchsorted(cuts, a, side="right") - 1
        at_doc_end = ends[doc] == b
        kind = np.where(at_doc_end, "document", np.where(sentence[ids[b - 1]], "sentence", "free"))
        crc = [zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist())]
        base = (TaskContext.get().partitionId() << 40) + serial
        columns = [
            pa.array([docs[i][0] for i in doc.tolist()], pa.int64()),
            pa.array(a - (ends[doc] - sizes[doc])),
            pa.array(b - a),
            pa.array(crc, pa.int64()),
            pa.array(sizes[doc]),
            pa.array(base + window),
            pa.array(a - cuts[window]),
            pa.array(kind.tolist(), pa.string()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut"]
        return pa.RecordBatch.from_arrays(columns, names=names), serial + len(cuts) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(o.vocabulary, o.end_id)
        sentence = sentence_ends(encoder.tokenizer)
        docs, arrays, held, serial = [], [], 0, 0
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            ids, at = ids.astype("<u4"), 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                docs.append((doc_id, n))
                arrays.append(ids[at : at + n])
                at, held = at + n, held + n
                if held >= o.stream:
                    out, serial = flush(docs, arrays, serial, sentence)
                    docs, arrays, held = [], [], 0
                    yield out
        if docs:
            yield flush(docs, arrays, serial, sentence)[0]

    return run


def pack(docs: DataFrame, options: PackingOptions = PackingOptions()) -> DataFrame:
    """Sequences of at most `options.size` ids: one row per piece of a document.

    A document's ids are those of its text and `end_id`; a missing or empty text is `end_id` alone. Repeated rows are
    packed as often as they occur, rows without doc_id come first, equal ids are ordered by text, other columns are
    ignored, and an empty table gives no rows. A text of any length is cut, never shortened. `cut` tells where the piece
    ends: at the end of its document, of a sentence, or freely. Streams end at range partitions and every
    `options.stream` ids, at the end of a document, so a task holds one stream and never a partition.
    """
    ordered = plain_documents(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_packer(options), SCHEMA)
