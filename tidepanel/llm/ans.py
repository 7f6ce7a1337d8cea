"""Token files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus and scaled to 2**BITS, serves all blocks. A block holds whole documents,
about `block_tokens` ids, dealt in turn to LANES interleaved coders with 64-bit states that emit 32-bit words. Every
`checkpoint_steps` steps the states and the word position are kept, so that the pieces of a block decode side by side; CRC-32
sums over payload and ids guard each block. Files are Parquet rows (one per block), so that any store Spark can reach holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import worker_encoder
from tidepanel.llm.common import drop_staged, plain_documents, slices
from tidepanel.session import scratch_path

BITS = 18
LOW = np.uint64(1 << 31)
TABLED = 64  # steps whose frequencies are looked up at once


@dataclass(frozen=True)
class CodecOptions:
    lanes: int = 512
    block_tokens: int = 1 << 20
    checkpoint_steps: int = 512
    vocabulary: str | None = None
    end_id: int = 0


class Table:
    """Scaled frequencies: freq and start by id, and the id of each of the 2**BITS slots."""

    def __init__(self, counts: np.ndarray):
        self.freq = scaled(counts)
        self.start = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(len(counts), dtype=np.uint32), self.freq.astype(np.int64))
        self.pad = int(np.argmax(self.freq)) if len(counts) else 0


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, at least 1 for every id that occurs (at most 2**BITS ids may occur)."""
    total, room = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), np.uint64)
    present = counts > 0
    if int(present.sum()) > room:
        raise ValueError(f"more than {room} different ids")
    freq = np.where(present, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    while (gap := room - int(freq.sum())) != 0:
        if gap > 0:
            freq[order[0]] += gap
            continue
        give = np.flatnonzero(freq[order] > 1)
        take = order[give[: -gap]]
        freq[take] -= 1
    return freq.astype(np.uint64)


def encode_block(ids: np.ndarray, table: Table, o: CodecOptions) -> tuple[bytes, bytes]:
    """Payload (32-bit words) and checkpoints (word position and states, one entry per started piece)."""
    steps = -(-len(ids) // o.lanes)
    grid = np.full(steps * o.lanes, table.pad, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, o.lanes)
    state = np.full(o.lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    shift, low = np.uint64(32), np.uint64((1 << 32) - 1)
    for end in range(steps, 0, -TABLED):
        begin = max(0, end - TABLED)
        freqs, starts = table.freq[grid[begin:end]], table.start[grid[begin:end]]
        limits, gaps = freqs << np.uint64(63 - BITS), np.uint64(1 << BITS) - freqs
        for k in range(end - begin - 1, -1, -1):
            full = np.flatnonzero(state >= limits[k])
            if len(full):
                high = state[full]
                words.append((high & low).astype(np.uint32)[::-1])
                written += len(full)
                state[full] = high >> shift
            # (state // freq << BITS) + state % freq + start
            quotient = state // freqs[k]
            quotient *= gaps[k]
            state += quotient
            state += starts[k]
            if (begin + k) % o.checkpoint_steps == 0:
                marks.append((written, state.copy()))
    payload = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    head = [np.concatenate([[np.uint64(written - w)], s]) for w, s in reversed(marks)]
    return payload.astype("<u4").tobytes(), (np.concatenate(head) if head else np.zeros(0, np.uint64)).astype("<u8").tobytes()


def decode_block(payload: bytes, marks: bytes, n: int, table: Table, lanes: int, checkpoint_steps: int) -> np.ndarray:
    """The ids of a block; its pieces between checkpoints are decoded side by side, one numpy row each."""
    words = np.frombuffer(payload, "<u4").astype(np.uint64)
    heads = np.frombuffer(marks, "<u8").reshape(-1, lanes + 1)
    pieces, steps = len(heads), -(-n // lanes)
    at, state = heads[:, 0].astype(np.int64), heads[:, 1:].astype(np.uint64)
    out = np.zeros((pieces, checkpoint_steps, lanes), np.uint32)
    words = np.concatenate([words, np.zeros(1, np.uint64)])
    mask, bits, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for step in range(min(checkpoint_steps, steps)):
        live = pieces if (pieces - 1) * checkpoint_steps + step < steps else pieces - 1
        x = state[:live]
        slot = x & mask
        symbol = table.slots[slot.astype(np.int64)]
        out[:live, step] = symbol
        x = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        empty = x < LOW
        taken = np.cumsum(empty, axis=1)
        where = (at[:live, None] + taken - 1)[empty]
        x[empty] = (x[empty] << shift) | words[where]
        at[:live] += taken[:, -1]
        state[:live] = x
    return out.reshape(-1)[:n] if pieces else np.zeros(0, np.uint32)


TOKENS = "part int, seq long, doc_id long, start long, n_tokens long, ids binary, counts binary"
TOKEN_NAMES = [c.split()[0] for c in TOKENS.split(", ")]


def _tokenize(o: CodecOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(o.vocabulary, o.end_id)
        width = "<u2" if len(encoder.opens) <= 1 << 16 else "<u4"
        part, seq, start, occurring = TaskContext.get().partitionId(), 0, 0, np.zeros(len(encoder.opens), np.int64)
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            occurring += np.bincount(ids, minlength=len(occurring))
            raw, size = ids.astype(width).tobytes(), np.dtype(width).itemsize
            ends = np.cumsum(counts)
            n = len(counts)
            offsets = np.concatenate([[0], ends * size]).astype(np.int64)
            values = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
            columns = [
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(seq, seq + n)),
                batch.column("doc_id"),
                pa.array(start + ends - counts),
                pa.array(counts),
                values,
                pa.nulls(n, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=TOKEN_NAMES)
            seq, start = seq + n, start + int(ends[-1])
        if seq:
            counted = [part, seq, None, start, 0, b"", occurring.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(counted, kinds)], names=TOKEN_NAMES)

    return run


def token_rows(docs: DataFrame, o: CodecOptions) -> DataFrame:
    """Ids of each document (text and end id) in ascending doc_id order: part and seq give the order. The last row of a part is
    no document: its `counts` (null elsewhere) are the occurrences of each id in the part."""
    ordered = plain_documents(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_tokenize(o), TOKENS)


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            new = np.frombuffer(raw, "<i8")
            counts = counts + new if len(counts) else new
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found].astype(np.int64))], names=["id", "n"])


def frequency_table(tokens: DataFrame) -> DataFrame:
    """Occurrences of each id: counted by the tasks that made the tokens, then summed. One row per id of the vocabulary at most."""
    counted = tokens.filter("counts IS NOT NULL").select("counts")
    return counted.mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = (
    "part int, seq long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, lanes int, "
    "checkpoint_steps int, payload binary, checkpoints binary, payload_crc32 long, ids_crc32 long"
)


def _encode(counts: np.ndarray, o: CodecOptions):
    def flush(rows: list, table: Table) -> pa.RecordBatch:
        ids = np.concatenate([r[4] for r in rows]).astype("<u4")
        payload, marks = encode_block(ids, table, o)
        values = [
            rows[0][0], rows[0][1], len(ids), [r[2] for r in rows], [r[3] for r in rows], [len(r[4]) for r in rows], o.lanes,
            o.checkpoint_steps, payload, marks, zlib.crc32(marks, zlib.crc32(payload)), zlib.crc32(ids),
        ]
        many = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.int64(), many, many, many, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, held = Table(counts), [], 0
        for batch in slices(batches, "ids"):
            for part, seq, doc_id, start, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "start", "n_tokens", "ids"))):
                if rows and (held >= o.block_tokens or part != rows[0][0]):
                    yield flush(rows, table)
                    rows, held = [], 0
                rows.append((part, seq, doc_id, start, _ids(raw, n)))
                held += n
        if rows:
            yield flush(rows, table)

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, options: CodecOptions = CodecOptions()) -> None:
    """Write the coded corpus below `path`: blocks, the shared frequency table, and where each part begins.

    Documents stand in ascending doc_id order (rows without doc_id first, equal ids by text, repeated rows as often as they
    occur). A missing or empty text has the end id alone. Extra columns are ignored; an empty table writes empty files.
    """
    tokens_path = scratch_path(spark, "tokens")
    token_rows(docs, options).write.option("compression", "zstd").parquet(tokens_path)
    tokens = spark.read.parquet(tokens_path)
    table = frequency_table(tokens)
    table.coalesce(1).write.parquet(f"{path}/frequencies")
    counts = read_frequencies(spark, path)
    documents = tokens.filter("counts IS NULL").drop("counts")
    documents.mapInArrow(_encode(counts, options), BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part, that is per task of the tokenizing job
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", before.alias("base")).coalesce(1).write.parquet(f"{path}/parts")
    drop_staged(spark, tokens)


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    """The shared table on the driver: as many rows as the vocabulary has ids, whatever the corpus."""
    rows = spark.read.parquet(f"{path}/frequencies").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _decode(counts: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(counts)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(row["checkpoints"], zlib.crc32(row["payload"])) != row["payload_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['seq']}: payload is damaged")
                ids = decode_block(row["payload"], row["checkpoints"], row["n_tokens"], table, row["lanes"], row["checkpoint_steps"]).astype("<u4")
                if zlib.crc32(ids) != row["ids_crc32"]:
                    raise ValueError(f"block {row['part']}/{row['seq']}: ids don't match their checksum")
                ends = np.cumsum(row["lengths"])
                spans = [ids[b - n : b] for b, n in zip(ends.tolist(), row["lengths"])]
                n = len(spans)
                columns = [
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["starts"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                ]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([s.astype(np.int64) for s in spans], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids. Blocks decode in parallel."""
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    rows = spark.read.parquet(f"{path}/blocks").mapInArrow(_decode(read_frequencies(spark, path), keep_ids), schema)
    found = rows.join(spark.read.parquet(f"{path}/parts"), "part")
    return found.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
