"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import drop_staged, prepare, scratch_path, shuffles_freed  # noqa: F401 (drop_staged: for the operators)

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the corpus."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back, so that lost executors never replay what led here."""
    path = scratch_path(spark, label)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.where(_BLANK, 0, np.arange(1, 257)).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_PIECE = 300_000  # bytes that are hashed at once, so that the arrays stay in a processor's cache


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """All words of some texts at once, lower-cased (A-Z only): 64-bit hash of each, and the line it stands on.

    `counts` are the words and `lines` the lines of each text; lines are numbered through all texts. A hash is a polynomial in
    the bytes of the word, summed up and mixed by numpy, so that no word becomes a Python object.
    """

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
        sizes = np.array([len(r) for r in raw], np.int64)
        piece = (np.cumsum(sizes) - sizes) // _PIECE
        edges = [0, *np.flatnonzero(np.diff(piece)).tolist(), len(raw) - 1]
        hashes, line, counts, done = [], [], [], 0
        for a, b in zip([0, *[e + 1 for e in edges[1:-1]]], [e + 1 for e in edges[1:]]):
            h, at, n = _hash_words(raw[a:b])
            hashes.append(h)
            line.append(at + done)
            counts.append(n)
            done += int(self.lines[a:b].sum())
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        self.line = np.concatenate(line) if line else none
        self.counts = np.concatenate(counts) if counts else none


def _hash_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its line, words of each text)."""
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    start = np.flatnonzero(opens)
    counts = np.diff(np.searchsorted(start, np.cumsum([0, *[len(r) + 1 for r in raw]])))
    if not len(start):
        return np.zeros(0, np.uint64), start, counts
    line = np.searchsorted(np.flatnonzero(data == 10), start)
    data, at = data[start[0] :], start - start[0]
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat(at.astype(np.int32), np.diff(at, append=len(data)))
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    return mix64(np.add.reduceat(_VALUE[data] * powers[place], at)), line, counts


def give_back() -> None:
    """Return memory that earlier tasks of this Python worker have freed to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about `most` bytes of `column` (one row at least)."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array([0 if v is None else v for v in _lengths(batch.column(batch.schema.get_field_index(column)))], dtype=np.int64)
        piece = np.cumsum(lengths) // most
        edges = np.flatnonzero(np.diff(piece, prepend=piece[0])).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def _lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def plain_documents(df: DataFrame) -> DataFrame:
    """doc_id and text only, a missing text read as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: SQL: common table expression `crc_table` (one row, a list `t`) for CRC32_SQL.
CRC_TABLE_SQL = """
  crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
      SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
"""
#: SQL: CRC-32 of the bytes whose hexadecimal digits are the column `bytes`, with crc_table in the FROM clause.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INT) + 1])), 4294967295)"""
