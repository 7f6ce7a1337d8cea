"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its top bits are zero. Normalised chunking asks for
more zero bits before the usual chunk length and for fewer after it, so lengths stay close to it. Boundaries depend on the
last 32 bytes only and shift with an insertion. The fingerprint is the set of chunk digests with the chunks' lengths; the
likeness of two texts is the length of their common chunks as a share of the shorter one (containment).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import mix64, plain_documents, slices, staged

WINDOW = 32  # bytes a 32-bit gear hash sees


@dataclass(frozen=True)
class ChunkOptions:
    """Lengths in bytes (least >= WINDOW); zero bits asked for before and after the normal length."""

    least: int = 32
    normal: int = 64
    most: int = 256
    hard_bits: int = 7
    easy_bits: int = 5


with np.errstate(over="ignore"):
    GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # the right side is computed before it is added
    return h


def boundaries(data: np.ndarray, starts: list[int], ends: list[int], o: ChunkOptions) -> tuple[list[int], list[int]]:
    """Chunk starts of all texts, and how many chunks each text has; the texts lie one after another in data."""
    h = gear_hashes(data)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - o.easy_bits)))
    hard = (easy[h[easy] < np.uint32(1 << (32 - o.hard_bits))] + 1).tolist()
    easy = (easy + 1).tolist()
    hard.append(1 << 62)
    easy.append(1 << 62)
    out: list[int] = []
    counts = []
    for s, e in zip(starts, ends):
        before = len(out)
        while s < e:
            out.append(s)
            if e - s <= o.least:
                break
            cut = hard[bisect_left(hard, s + o.least)]
            if cut > s + o.normal:
                cut = min(easy[bisect_left(easy, s + o.normal + 1)], s + o.most)
            s = cut if cut < e else e
        counts.append(len(out) - before)
    return out, counts


def fingerprints(texts: list[bytes], o: ChunkOptions) -> list[dict[int, int]]:
    """For each text the distinct chunk digests (64 bits) with their chunk lengths."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if not len(data):
        return [{} for _ in texts]
    cuts, counts = boundaries(data, (ends - [len(t) for t in texts]).tolist(), ends.tolist(), o)
    at = np.array(cuts, np.int64)
    lengths = np.diff(at, append=len(data))
    offset = np.arange(len(data)) - np.repeat(at, lengths)
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * POWERS[offset], at)
    digests = mix64(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).tolist()
    lengths = lengths.tolist()
    out, k = [], 0
    for n in counts:
        out.append(dict(zip(digests[k : k + n], lengths[k : k + n])))
        k += n
    return out


ENTRY = 10  # bytes of a chunk: 8 of the digest, 2 of the length


def as_bytes(found: dict[int, int]) -> bytes:
    """Chunks by ascending digest."""
    return b"".join([(d << 16 | found[d]).to_bytes(ENTRY, "big") for d in sorted(found)])


def as_text(found: dict[int, int]) -> str:
    """20 hexadecimal digits for each chunk, ascending: 16 of the digest, 4 of the length."""
    return as_bytes(found).hex()


def changes(own: dict[int, int], other: dict[int, int]) -> bytes:
    """What leads from one fingerprint to another: count and places of chunks that go, then the chunks that come."""
    gone = np.array([k for k, d in enumerate(sorted(own)) if other.get(d) != own[d]], ">u4")
    return len(gone).to_bytes(4, "big") + np.diff(gone, prepend=0).astype(">u4").tobytes() + as_bytes({d: n for d, n in other.items() if own.get(d) != n})


def changed(own: bytes, by: bytes) -> bytes:
    """The other fingerprint, from one and the changes that lead to it."""
    n = int.from_bytes(by[:4], "big")
    keep = np.ones(len(own) // ENTRY, bool)
    keep[np.cumsum(np.frombuffer(by, ">u4", n, 4).astype(np.int64))] = False
    entries = [own[k * ENTRY : k * ENTRY + ENTRY] for k in np.flatnonzero(keep).tolist()]
    rest = by[4 + 4 * n :]
    return b"".join(sorted(entries + [rest[k : k + ENTRY] for k in range(0, len(rest), ENTRY)]))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Length of the common chunks by the length of the smaller set: 1 for two empty sets, 0 if only one is empty."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    common = sum([n for d, n in a.items() if d in b])
    return common / min(sum(a.values()), sum(b.values()))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: As staged: the fingerprint as bytes, the edited one as changes to it.
STAGED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], o: ChunkOptions) -> list[pa.Array]:
    """Result columns of all texts but the last, each with the text after it."""
    after = [edited(t, f).encode() for t, f in zip(texts, texts[1:])]
    prints = fingerprints([t.encode() for t in texts], o)
    after_prints = fingerprints(after, o)
    return [
        pa.array(ids[:-1], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(c).digest() for c in after], pa.binary()),
        pa.array([as_bytes(p) for p in prints[:-1]], pa.binary()),
        pa.array([changes(p, c) for p, c in zip(prints, after_prints)], pa.binary()),
        pa.array([likeness(p, c) for p, c in zip(prints, after_prints)], pa.float64()),
        pa.array([likeness(p, f) for p, f in zip(prints, prints[1:])], pa.float64()),
    ]


def _walk(o: ChunkOptions):
    """Rows of one partition, in order; its first and last text wait for the neighbouring partitions."""

    def edge(kind: str, part: int, doc_id, text: str) -> pa.RecordBatch:
        empty = [pa.array([doc_id], pa.int64())] + [pa.nulls(1, k) for k in (pa.int64(), *[pa.binary()] * 3, pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*empty, pa.array([kind]), pa.array([part], pa.int32()), pa.array([text])], names=[*NAMES, "kind", "part", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts = TaskContext.get().partitionId(), [], []
        for batch in slices(batches, "text", 2_000_000):
            first = not ids
            ids += batch.column("doc_id").to_pylist()
            texts += batch.column("text").to_pylist()
            if first:
                yield edge("head", part, ids[0], texts[0])
            if len(ids) > 1:
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays(
                    [*_rows(ids, texts, o), pa.array(["row"] * n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=[*NAMES, "kind", "part", "text"]
                )
            ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield edge("tail", part, ids[0], texts[0])

    return run


def _edges(o: ChunkOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                yield pa.RecordBatch.from_arrays(_rows([doc_id, None], [text, following], o), names=NAMES)

    return run


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Staged rows as hexadecimal text."""
    for batch in slices(batches, "fingerprint"):
        own, by, sums = (batch.column(c).to_pylist() for c in ("fingerprint", "edited_fingerprint", "edited_sha256"))
        columns = {c: batch.column(c) for c in NAMES}
        columns["edited_sha256"] = pa.array([x.hex() for x in sums], pa.string())
        columns["fingerprint"] = pa.array([x.hex() for x in own], pa.string())
        columns["edited_fingerprint"] = pa.array([changed(x, y).hex() for x, y in zip(own, by)], pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=NAMES)


def fingerprint_documents(spark: SparkSession, docs: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after it in descending doc_id order, after the last the first (a single row follows itself).
    Missing texts count as empty, an empty text has an empty fingerprint; rows without doc_id come last, equal ids are
    ordered by text, repeated rows stay, extra columns are ignored, an empty table gives no rows. Texts are hashed whole.
    The order comes from a range partitioning; only the first and last text of each partition go through a small join.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = plain_documents(docs).repartitionByRange(*order).sortWithinPartitions(order[0], "text")
    walked = staged(spark, ordered.mapInArrow(_walk(options), STAGED + ", kind string, part int, text string"), "chunks")
    heads = walked.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = walked.filter("kind = 'tail'").select("part", "doc_id", "text")
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = tails.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(everything)))
    pairs = tails.join(turn, "part").join(heads, "next_part").select("doc_id", "text", "following")
    return walked.filter("kind = 'row'").select(*NAMES).unionByName(pairs.mapInArrow(_edges(options), STAGED)).mapInArrow(_written, SCHEMA)
