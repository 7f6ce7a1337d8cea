"""Line dedup as an exact set-similarity join.

A line is the set of its distinct words. Words are ordered by rarity, counted over the whole corpus in a table of bounded
size; two lines with a Jaccard similarity of `percent` share a word among the first few of both (prefix filter), differ
little in length (length filter) and have enough words left behind the shared one (positional filter). A parity bitmap bounds
the number of differing words from below and drops most other pairs; it is wider for longer lines, of 64, 128 or 256 bits, as
one that more words differ than it has bits tells nothing. What is left is verified on the full sets. Every line that resembles
an earlier one (by doc_id, then line number) is removed.

Lines with equal sets are one class. Each scan task emits a class once, so a line that makes up a third of all rows is no hot
group; its later occurrences are known to be removed at once. Postings travel in packed blobs, one per bucket of words, field
by field, so that the exchange's compression finds the bytes that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import Words, drop_staged, free_names, mix64, slices, staged

COUNTERS, CHUNK, FAN_IN = 1 << 19, 1 << 16, 64
FILTER_PARTS = 16
KEY_BITS = 46  # 12 bits of rarity above 34 bits of hash
LAST = (1 << 63) - 1  # stands for a missing doc_id
WIDE, WIDEST = 64, 160  # sets of more words have parity bitmaps of 128 and 256 bits


@dataclass(frozen=True)
class LineOptions:
    """percent: least similarity. least_words: lines with fewer distinct words are left alone. first: candidates per line and
    shared word before the rest is looked at in a second pass. postings: about as many per bucket. filter_bits: bits of the
    bitmap that tells every task which classes are asked for, whatever their number (it may let others through)."""

    percent: int = 80
    least_words: int = 4
    first: int = 4
    postings: int = 200_000
    filter_bits: int = 1 << 26


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: the id (missing ones last); tag: a hash that tells apart rows of the same id; text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


# ---- rarity -----------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, lines = np.zeros(COUNTERS, np.int64), 0
    for batch in slices(batches, "text"):
        words = Words(batch.column("text").to_pylist())
        lines += int(words.lines.sum())
        counts += np.bincount((words.hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
    part = TaskContext.get().partitionId()
    n = COUNTERS // CHUNK
    data = [counts[i * CHUNK : (i + 1) * CHUNK].astype("<i8").tobytes() for i in range(n)]
    columns = [pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([lines] * n, pa.int64()), pa.array(data, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "lines", "counts"])


COUNTS = "part long, chunk int, lines long, counts binary"


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for raw in table.column("counts").to_pylist():
        total += np.frombuffer(raw, "<i8")
    part, chunk = table.column("part")[0].as_py() // FAN_IN, table.column("chunk")[0].as_py()
    lines = sum(table.column("lines").to_pylist())
    return pa.table({"part": pa.array([part], pa.int64()), "chunk": pa.array([chunk], pa.int32()), "lines": pa.array([lines], pa.int64()), "counts": [total.astype("<i8").tobytes()]})


def word_counts(spark: SparkSession, keyed: DataFrame) -> tuple[np.ndarray, int]:
    """(occurrences of words by hash, in COUNTERS cells; number of lines). Tables of FAN_IN tasks at a time are added up."""
    level = staged(spark, keyed.select("text").mapInArrow(_count_words, COUNTS), "counts")
    top = level.agg(F.max("part")).first()[0]
    while top is not None:
        new = staged(spark, level.groupBy("chunk", F.floor(F.col("part") / FAN_IN)).applyInArrow(_add, COUNTS), "counts")
        drop_staged(spark, level)
        level = new
        if top < FAN_IN:
            break
        top //= FAN_IN
    rows = level.orderBy("chunk").collect()  # COUNTERS cells, whatever the corpus
    drop_staged(spark, level)
    if not rows:
        return np.zeros(COUNTERS, np.int64), 0
    return np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows]), rows[0]["lines"]


# ---- lines as sets ----------------------------------------------------------------------------------------------------


def rarity_steps(counts: np.ndarray) -> np.ndarray:
    """Rarity of each cell on a logarithmic scale of 4096 steps, the rarest first."""
    return np.minimum(np.log2(counts + 1.0) * 64, 4095).astype(np.uint64)


class LineSets:
    """The lines with at least `least` distinct words of some texts, vectorised: per line row (of the texts), number, size,
    id (hash of the set), bits (parity bitmap), odd, one and two (what widens it: of the lanes 0 to 3 of 64 bits, whose sum is `bits`,
    1 + 3, 1 and 2; zeros where the size asks for less); per word key, hash and line, the rarest first.

    A key has 12 bits of rarity above 34 bits of the word's hash; it orders words. Sets are those of the 64-bit hashes.
    """

    def __init__(self, hashes: np.ndarray, line: np.ndarray, row: np.ndarray, number: np.ndarray, steps: np.ndarray, least: int):
        n = len(row)
        key = steps[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)] << np.uint64(34) | hashes >> np.uint64(30)
        both = line.astype(np.uint64) << np.uint64(KEY_BITS) | key
        order = np.argsort(both)
        both, hashes = both[order], hashes[order]
        new = np.concatenate([[True], (both[1:] != both[:-1]) | (hashes[1:] != hashes[:-1])]) if len(both) else np.zeros(0, bool)
        both, hashes = both[new], hashes[new]
        line = (both >> np.uint64(KEY_BITS)).astype(np.int64)
        size = np.bincount(line, minlength=n)
        kept = size >= least
        both, hashes, line = both[kept[line]], hashes[kept[line]], line[kept[line]]
        self.size = size[kept]
        self.row, self.number = row[kept], number[kept]
        self.key, self.hash = both & np.uint64((1 << KEY_BITS) - 1), hashes
        self.line = (np.cumsum(kept) - 1)[line]
        self.start = np.cumsum(self.size) - self.size
        mixed = mix64(self.hash * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        if len(mixed):
            self.id = mix64(np.add.reduceat(mixed, self.start) + self.size.astype(np.uint64))
            self.bits = np.bitwise_xor.reduceat(np.uint64(1) << (mixed >> np.uint64(58)), self.start)
        else:
            self.id = self.bits = np.zeros(0, np.uint64)
        self.odd, self.one, self.two = np.zeros((3, len(self.size)), np.uint64)
        long = self.size > WIDE
        if long.any():
            mixed, sizes = mixed[long[self.line]], self.size[long]
            bit, lane, start = np.uint64(1) << (mixed >> np.uint64(58)), mixed >> np.uint64(56) & np.uint64(3), np.cumsum(sizes) - sizes
            one, two, three = (np.bitwise_xor.reduceat(np.where(lane == np.uint64(k), bit, np.uint64(0)), start) for k in (1, 2, 3))
            self.odd[long], self.one[long], self.two[long] = one ^ three, np.where(sizes > WIDEST, one, 0), np.where(sizes > WIDEST, two, 0)


def line_sets(texts: list[str], steps: np.ndarray, least: int, asked=None, most: int = 200_000) -> Iterator[LineSets]:
    """LineSets of at most `most` lines each; lines without words (without words that pass the filter `asked`) are passed over."""
    words = Words(texts)
    hashes, line = words.hashes, words.line
    if asked is not None:
        holds = np.zeros(int(words.lines.sum()), bool)
        holds[line[asked(hashes)]] = True
        hashes, line = hashes[holds[line]], line[holds[line]]
    if not len(line):
        return
    opens = np.concatenate([[True], line[1:] != line[:-1]])
    present, place = line[opens], np.cumsum(opens) - 1  # lines with words, and the line of each word among them
    first = np.cumsum(words.lines) - words.lines
    row = np.searchsorted(first, present, side="right") - 1
    number = present - first[row]
    at = np.flatnonzero(opens)
    for a in range(0, len(present), most):
        b = min(a + most, len(present))
        x, y = at[a], at[b] if b < len(present) else len(place)
        yield LineSets(hashes[x:y], place[x:y] - a, row[a:b], number[a:b], steps, least)


def prefix_length(size, percent: int):
    """Among how many of its rarest words a set shares one with each set that is similar to it."""
    return size - -(-percent * size // 100) + 1


def overlap_needed(size_x, size_y, percent: int):
    """Common words that a pair of this similarity has at least."""
    return -(-percent * (size_x + size_y) // (100 + percent))


# ---- postings and occurrences -----------------------------------------------------------------------------------------

POSTING = np.dtype([("word", "<u4"), ("size", "<u4"), ("pos", "<u2"), ("id", "<u8"), ("doc", "<i8"), ("bits", "<u8"), ("odd", "<u8"), ("one", "<u8"), ("two", "<u8")])
FIRST = np.dtype([("id", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("line", "<i8")])


def _blobs(kind: str, data: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The records packed by bucket, a few MB at once."""
    if not len(data):
        return
    order = np.argsort(bucket, kind="stable")
    data, bucket = data[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(at[1:], len(data))
    piece = at * data.itemsize // 4_000_000
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(piece)) + 1):
        raw = [data[a:b].tobytes() for a, b in zip(at[some].tolist(), ends[some].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(raw)), pa.array(bucket[at[some]].astype(np.int32)), pa.array(raw, pa.binary())], names=["kind", "bucket", "data"])


def _planes(column: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T.tobytes()


def pack_postings(p: np.ndarray) -> bytes:
    """Postings field by field, in the order of words, of the wide bitmaps what the size asks for."""
    p = p[np.argsort(p["word"], kind="stable")]
    word = np.diff(p["word"], prepend=np.uint32(0))
    long, longest = p["size"] > WIDE, p["size"] > WIDEST
    whole = [p["id"], p["bits"], p["odd"][long], p["one"][longest], p["two"][longest]]
    return b"".join([np.uint32(len(p)).tobytes(), *(_planes(c) for c in (word, p["size"], p["pos"], p["doc"])), *(np.ascontiguousarray(c).tobytes() for c in whole)])


def unpack_postings(packed: list[bytes]) -> np.ndarray:
    """What pack_postings has packed, blob after blob."""
    counts = [int(np.frombuffer(raw, "<u4", 1)[0]) for raw in packed]
    out, done = np.zeros(sum(counts), POSTING), 0
    for raw, n in zip(packed, counts):
        p, at = out[done : done + n], 4

        def take(kind: str, m: int) -> np.ndarray:
            nonlocal at
            at += (size := m * np.dtype(kind).itemsize)
            return np.frombuffer(raw, np.uint8, size, at - size)

        for name in ("word", "size", "pos", "doc"):
            kind = POSTING[name].str
            p[name] = np.ascontiguousarray(take(kind, n).reshape(-1, n).T).view(kind).ravel()
        p["word"] = np.cumsum(p["word"], dtype=np.uint32)
        long, longest = p["size"] > WIDE, p["size"] > WIDEST
        p["id"], p["bits"] = take("<u8", n).view("<u8"), take("<u8", n).view("<u8")
        for name, some in (("odd", long), ("one", longest), ("two", longest)):
            p[name][some] = take("<u8", int(some.sum())).view("<u8")
        done += n
    return out


def _packing(emit):
    """The rows of `emit`, postings packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emit(batches):
            if batch.column("kind")[0].as_py() == "posting":
                raw = [pack_postings(np.frombuffer(x.as_buffer(), POSTING)) for x in batch.column("data")]
                batch = pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("bucket"), pa.array(raw, pa.binary())], names=batch.schema.names)
            yield batch

    return run


def _emit(counts, o: LineOptions, buckets: int, words=None):
    """One task: postings of each class once, the first occurrence of each class, and the others as removed. With `words` (a
    filter) only the postings of words that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, asked = rarity_steps(counts.value), None if words is None else words.value
        first: dict[int, tuple[int, int, int]] = {}
        lost: list[tuple[int, int, int, int]] = []
        held, n_held = [], 0
        for batch in slices(batches, "text"):
            docs, tags = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
            for s in line_sets(batch.column("text").to_pylist(), steps, o.least_words, asked):
                pos = np.arange(len(s.key)) - s.start[s.line]
                meets = 100 * s.size >= o.percent * (s.size + 1)  # smaller sets resemble no other set, only their equals
                use = np.flatnonzero((pos < prefix_length(s.size, o.percent)[s.line]) & meets[s.line])
                seen = np.arange(len(s.id))
                if asked is not None:
                    use = use[asked(s.hash[use])]
                    seen = np.unique(s.line[use])
                new = np.zeros(len(s.id), bool)
                row = s.row[seen]
                for i, k, place in zip(seen.tolist(), s.id[seen].tolist(), zip(docs[row].tolist(), tags[row].tolist(), s.number[seen].tolist())):
                    old = first.get(k)
                    if old == place:  # a repeated row
                        continue
                    if old is None or place < old:
                        first[k] = place
                        new[i] = True  # a smaller doc makes the posting count again
                        place = old
                    if place is not None and asked is None:
                        lost.append((k, *place))
                use = use[new[s.line[use]]]
                line = s.line[use]
                out = np.empty(len(line), POSTING)
                out["word"] = mix64(s.key[use]) >> np.uint64(32)
                out["size"], out["pos"] = s.size[line], np.minimum(pos[use], 65535)
                out["id"], out["doc"], out["bits"] = s.id[line], docs[s.row[line]], s.bits[line]
                out["odd"], out["one"], out["two"] = s.odd[line], s.one[line], s.two[line]
                held.append(out)
                n_held += len(out)
            if n_held > 500_000 or len(lost) > 200_000:
                yield from _flush(held, lost)
                held, n_held, lost = [], 0, []
        yield from _flush(held, lost)
        if asked is None:
            firsts = np.array([(k, *p) for k, p in first.items()], FIRST)
            yield from _blobs("first", firsts, firsts["id"] % np.uint64(buckets))

    def _flush(held: list, lost: list) -> Iterator[pa.RecordBatch]:
        if held:
            postings = np.concatenate(held)
            held.clear()
            yield from _blobs("posting", postings, postings["word"] % np.uint32(buckets))
        if lost:
            gone = np.array(lost, FIRST)
            yield from _blobs("lost", gone, gone["doc"] % buckets)

    return run


class IdFilter:
    """A bitmap of class ids: asked for ids always pass, others sometimes."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix64(ids.astype(np.uint64, copy=False))
        return (x % np.uint64(bits)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        x, bits = mix64(ids.astype(np.uint64, copy=False)), np.uint64(len(self.bitmap) * 8)
        found = self._set(x % bits)
        left = np.flatnonzero(found)
        found[left] = self._set((x[left] >> np.uint64(32)) % bits)
        return found

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def id_filter(spark: SparkSession, ids: DataFrame, bits: int) -> IdFilter:
    """The bitmap of a column `id` of any length: each of FILTER_PARTS tasks fills its own, pieces of them are put together."""
    step = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in IdFilter.places(batch.column("id").to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k in range(0, len(bitmap), step):
            if bitmap[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bitmap[k : k + step].tobytes()], pa.binary())], names=["at", "piece"])

    def together(table: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(x, np.uint8) for x in table.column("piece").to_pylist()]
        return pa.table({"at": pa.array([table.column("at")[0].as_py()]), "piece": pa.array([np.bitwise_or.reduce(pieces).tobytes()], pa.binary())})

    parts = ids.select("id").repartition(FILTER_PARTS).mapInArrow(fill, "at long, piece binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("at").applyInArrow(together, "at long, piece binary").collect():  # `bits`, whatever the number of ids
        piece = np.frombuffer(row["piece"], np.uint8)
        bitmap[row["at"] : row["at"] + len(piece)] = piece
    return IdFilter(bitmap)


def bits_apart(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the postings p[x] and p[y], in the wider bitmaps that both of each pair have: a lower bound of the words
    that differ."""
    folded, smaller = p["bits"][x] ^ p["bits"][y], np.minimum(p["size"][x], p["size"][y])
    apart = np.bitwise_count(folded).astype(np.int64)
    at = np.flatnonzero(smaller > WIDE)
    odd = p["odd"][x[at]] ^ p["odd"][y[at]]
    even = folded[at] ^ odd
    apart[at] = np.bitwise_count(odd).astype(np.int64) + np.bitwise_count(even)
    most = smaller[at] > WIDEST
    at, odd, even = at[most], odd[most], even[most]
    one, two = (p[k][x[at]] ^ p[k][y[at]] for k in ("one", "two"))
    apart[at] = sum(np.bitwise_count(lane).astype(np.int64) for lane in (even ^ two, one, two, odd ^ one))
    return apart


def candidate_pairs(p: np.ndarray, o: LineOptions, only: IdFilter | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, differing bits, unfinished): candidate pairs of one bucket by id, and ids with further candidates.

    Postings are sorted by word and doc; each looks back step by step, all words at once, and keeps the `first` candidates
    whose bitmaps differ least. One with two likely candidates (half of the bits that may differ) looks no further. With
    `only`, the ids that pass it (as the later of a pair) keep all their candidates and others none.
    """
    by_doc = np.argsort(p["doc"], kind="stable")
    # a class that several tasks have sent stays once, with its first doc (one that is left twice does no harm)
    key = (p["word"].astype(np.uint64) << np.uint64(32) | p["id"] & np.uint64(0xFFFFFFFF))[by_doc]
    order = np.argsort(key, kind="stable")
    key, ids = key[order], p["id"][by_doc[order]]
    repeated = np.concatenate([[False], (key[1:] == key[:-1]) & (ids[1:] == ids[:-1])]) if len(p) else np.zeros(0, bool)
    by_doc = np.delete(by_doc, order[repeated])
    p = p[by_doc[np.argsort(p["word"][by_doc], kind="stable")]]
    del by_doc, key, order, ids, repeated
    n = len(p)
    word, size, pos, bits, ids = p["word"], p["size"].astype(np.int64), p["pos"].astype(np.int64), p["bits"].copy(), p["id"].copy()
    opened = np.concatenate([[True], word[1:] != word[:-1]]) if n else np.zeros(0, bool)
    place = np.arange(n) - np.maximum.accumulate(np.where(opened, np.arange(n), 0))  # place within the word
    live = np.flatnonzero(place >= 1)
    if only is not None:
        live = live[only(ids[live])]
    k = o.first
    kept = np.full((n if only is None else 0, k), 255, np.uint8)  # differing bits of the candidates kept
    partner = np.zeros((len(kept), k), np.int64)
    likely, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
    later, earlier, apart = [], [], []
    back = 1
    while len(live):
        y = live - back
        total = size[live] + size[y]
        room = total - 2 * overlap_needed(size[live], size[y], o.percent)
        differ = np.bitwise_count(bits[live] ^ bits[y]).astype(np.int64)
        fits = (differ <= room) & (100 * np.minimum(size[live], size[y]) >= o.percent * np.maximum(size[live], size[y]))
        fits &= 2 * np.minimum(size[live] - pos[live], size[y] - pos[y]) >= total - room
        close = np.flatnonzero(fits)
        differ[close] = bits_apart(p, live[close], y[close])
        fits[close] = differ[close] <= room[close]
        hit = live[fits]
        if only is not None:
            later.append(ids[hit])
            earlier.append(ids[hit - back])
            apart.append(differ[fits])
        elif len(hit):
            found[hit] += 1
            likely[hit] += 2 * differ[fits] <= room[fits]
            worst = kept[hit].argmax(axis=1)
            score = np.minimum(differ[fits], 254)
            better = score < kept[hit, worst]
            kept[hit[better], worst[better]] = score[better]
            partner[hit[better], worst[better]] = hit[better] - back
        back += 1
        live = live[(place[live] >= back) & (likely[live] < 2)]
    unfinished = np.zeros(0, np.uint64)
    if only is None:
        x, c = np.nonzero(kept < 255)
        later, earlier, apart = [ids[x]], [ids[partner[x, c]]], [kept[x, c]]
        unfinished = np.unique(ids[(found > k) | (likely >= 2)])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (later, earlier))
    bits = np.concatenate(apart).astype(np.int64) if apart else np.zeros(0, np.int64)
    pairs, at = np.unique(np.stack([x, y], axis=1), axis=0, return_index=True) if len(x) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    return pairs[:, 0], pairs[:, 1], bits[at], unfinished


FOUND = "kind string, id long, other long, doc long, tag long, line long"


def _meet(o: LineOptions, only):
    """Rows of FOUND from the blobs of one bucket after another."""

    def rows(kind: str, n: int, **cols) -> pa.RecordBatch:
        values = [pa.array([kind] * n, pa.string())]
        for c in ("id", "other", "doc", "tag", "line"):
            values.append(pa.array(cols[c].astype(np.uint64).view(np.int64) if cols[c].dtype == np.uint64 else cols[c], pa.int64()) if c in cols else pa.nulls(n, pa.int64()))
        return pa.RecordBatch.from_arrays(values, names=["kind", "id", "other", "doc", "tag", "line"])

    def bucket(kind: str, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == "posting":
            x, y, bits, more = candidate_pairs(unpack_postings(raw), o, None if only is None else only.value)
            if len(x):
                yield rows("pair", len(x), id=x, other=y, line=bits)
            if len(more):
                yield rows("more", len(more), id=more)
            return
        found = np.frombuffer(b"".join(raw), FIRST)
        if kind == "lost":
            yield rows("lost", len(found), doc=found["doc"], tag=found["tag"], line=found["line"])
            return
        found = found[np.lexsort((found["line"], found["tag"], found["doc"], found["id"]))]
        head = np.concatenate([[True], found["id"][1:] != found["id"][:-1]])
        lead = found[np.maximum.accumulate(np.where(head, np.arange(len(found)), 0))]
        later = (found["doc"] != lead["doc"]) | (found["tag"] != lead["tag"]) | (found["line"] != lead["line"])
        for name, part in (("first", found[head]), ("lost", found[later])):
            if len(part):
                yield rows(name, len(part), id=part["id"].copy(), doc=part["doc"], tag=part["tag"], line=part["line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, raw = None, []
        for batch in batches:
            for kind, number, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "data"))):
                if at is not None and at != (number, kind):
                    yield from bucket(at[1], raw)
                    raw = []
                at = (number, kind)
                raw.append(data)
        if raw:
            yield from bucket(at[1], raw)

    return run


# ---- verification -----------------------------------------------------------------------------------------------------


SETS = "id long, doc long, tag long, line long, words binary"


def place_ids(doc: np.ndarray, tag: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One hash of a line's place."""
    x = mix64(doc.astype(np.int64, copy=False).view(np.uint64) + np.uint64(1))
    x = mix64(x * np.uint64(3) + tag.astype(np.int64, copy=False).view(np.uint64))
    return mix64(x * np.uint64(3) + line.astype(np.int64, copy=False).view(np.uint64))


def _hashed_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = place_ids(*(batch.column(c).to_numpy() for c in ("doc", "tag", "line")))
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], names=["id"])


def _full_sets(counts, least: int, wanted):
    """Rows of SETS for the lines whose place passes the filter; words are packed 64-bit hashes, the rarest first. Other lines
    are not looked into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = rarity_steps(counts.value)
        for batch in slices(batches, "text"):
            docs, tags, texts = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), batch.column("text").to_pylist()
            n = np.array([t.count("\n") + 1 for t in texts], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            asked = np.flatnonzero(wanted.value(place_ids(docs[row], tags[row], number)))
            row, number = row[asked], number[asked]
            split = {r: texts[r].split("\n") for r in np.unique(row).tolist()}
            for s in line_sets([split[r][k] for r, k in zip(row.tolist(), number.tolist())], steps, least):
                sets = [s.hash[a : a + m].tobytes() for a, m in zip(s.start.tolist(), s.size.tolist())]
                at = row[s.row]
                columns = [s.id.view(np.int64), docs[at], tags[at], number[s.row]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sets, pa.binary())], names=["id", "doc", "tag", "line", "words"])

    return run


def full_sets(spark: SparkSession, keyed: DataFrame, counts, pairs: DataFrame, first: DataFrame, o: LineOptions) -> DataFrame:
    """Rows of SETS, the first place of each class, for all classes that the pairs name (and some others)."""
    ends = pairs.select("id").unionAll(pairs.select(F.col("other").alias("id"))).distinct()
    places = first.join(ends, "id").select("doc", "tag", "line").mapInArrow(_hashed_places, "id long")
    wanted = spark.sparkContext.broadcast(id_filter(spark, places, o.filter_bits))
    rows = keyed.mapInArrow(_full_sets(counts, o.least_words, wanted), SETS)
    # the first place of a class that is asked for has passed, so that it is the smallest here; repeated rows come twice
    sets = rows.groupBy("id").agg(F.min(F.struct("doc", "tag", "line", "words")).alias("least"))
    return staged(spark, sets.select("id", "least.*"), "sets")


def _prefix_words(percent: int):
    """The hashes of the words in the prefixes of full sets, as a column id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("words").to_pylist():
                words = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words[: prefix_length(len(words), percent)])], names=["id"])

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("words_x").to_pylist(), batch.column("words_y").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["id", "doc", "tag", "line"]).filter(pa.array(keep, pa.bool_()))

    return run


def later_ones(spark: SparkSession, pairs: DataFrame, sets: DataFrame, o: LineOptions) -> DataFrame:
    """The later class (id, doc, tag, line) of each pair (id, other) whose full sets are similar enough."""
    x = sets.select("id", F.struct("doc", "tag", "line", "id").alias("x"), F.col("words").alias("words_x"))
    y = sets.select(F.col("id").alias("other"), F.struct("doc", "tag", "line", "id").alias("y"), F.col("words").alias("words_y"))
    joined = pairs.join(x, "id").join(y, "other").select(F.greatest("x", "y").alias("later"), "words_x", "words_y")
    later = joined.select("later.*", "words_x", "words_y").mapInArrow(_similar(o.percent), "id long, doc long, tag long, line long")
    return staged(spark, later.distinct(), "later")


# ---- the operator -----------------------------------------------------------------------------------------------------


def removed_lines(spark: SparkSession, docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """(doc, tag, lines): numbers of the lines to remove, for each row of docs that loses some."""
    o, keyed = options, _keyed(docs)
    table, lines = word_counts(spark, keyed)
    counts = spark.sparkContext.broadcast(table)
    buckets = max(64, lines * 10 // o.postings)

    def meet(only=None, words=None) -> DataFrame:
        packed = keyed.mapInArrow(_packing(_emit(counts, o, buckets, words)), "kind string, bucket int, data binary")
        return packed.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_meet(o, only), FOUND)

    found = staged(spark, meet(), "lines")
    first = found.filter("kind = 'first'").select("id", "doc", "tag", "line")

    def settle(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Classes with an earlier similar line: by the nearest candidate of each, then by all others of those still without. And
        the full sets of the pairs' classes."""
        sets = full_sets(spark, keyed, counts, pairs, first, o)
        nearest = pairs.groupBy("id").agg(F.min(F.struct("bits", "other")).alias("best")).select("id", F.col("best.other").alias("other"))
        done = later_ones(spark, nearest, sets, o)
        left = pairs.join(done, "id", "left_anti").join(nearest, ["id", "other"], "left_anti").select("id", "other")
        similar = done.unionByName(later_ones(spark, left, sets, o)).distinct()
        drop_staged(spark, pairs)
        return similar, sets

    def pairs_of(found: DataFrame) -> DataFrame:
        pairs = found.filter("kind = 'pair'").groupBy("id", "other").agg(F.min("line").alias("bits"))
        return staged(spark, pairs, "pairs")

    similar, sets = settle(pairs_of(found))
    rest = staged(spark, found.filter("kind = 'more'").select("id").distinct().join(similar, "id", "left_anti"), "rest")
    if not rest.isEmpty():
        # what is left meets all lines again, in the words of its own postings only
        words = sets.join(rest, "id", "left_semi").select("words").mapInArrow(_prefix_words(o.percent), "id long")
        asked = spark.sparkContext.broadcast(id_filter(spark, words, o.filter_bits))
        only = spark.sparkContext.broadcast(id_filter(spark, rest, o.filter_bits))
        more, other_sets = settle(pairs_of(meet(only, asked)))
        drop_staged(spark, other_sets)
        similar = similar.unionByName(more).distinct()
    drop_staged(spark, sets)
    drop_staged(spark, rest)
    gone = similar.unionByName(found.filter("kind = 'lost'").select("id", "doc", "tag", "line")).select("doc", "tag", "line")
    return gone.groupBy("doc", "tag").agg(F.collect_set("line").alias("lines"))


def dedup_lines(spark: SparkSession, docs: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """All rows of docs, text without the removed lines, and the counts n_lines and n_removed.

    Lines end at line breaks; words are lower-cased (A-Z). A line is removed if an earlier line of the corpus has at least
    `percent` per cent similarity with it; lines with fewer than `least_words` distinct words stay. Rows without doc_id come
    last in the order; rows equal in doc_id and text are treated alike, as one document; a missing text stays missing (no
    lines); an empty table stays empty; columns named n_lines or n_removed are replaced, others stay.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = removed_lines(spark, docs, options)
    d, t, g, new = free_names(docs, "doc", "tag", "gone", "text")
    doc, tag = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({d: doc, t: tag}).join(gone.withColumnsRenamed({"doc": d, "tag": t, "lines": g}), [d, t], "left")
    rows = rows.withColumn(g, F.sort_array(g))
    pieces = F.split("text", "\n", -1)
    # what lies between two removed lines is one slice
    before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(g, k - 1)).cast("int")
    after = lambda k: F.when(k == F.size(g), F.size(pieces)).otherwise(F.get(g, k)).cast("int")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: F.slice(pieces, before(k) + 2, after(k) - before(k) - 1)))
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long")
    n_removed = F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long")
    return rows.withColumns({"n_lines": n_lines, "n_removed": n_removed, new: text}).select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in docs.columns], "n_lines", "n_removed")
