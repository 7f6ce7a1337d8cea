"""Near-duplicate documents by MinHash bands, odd sketches and exact verification.

A document's set holds its distinct five-word shingles. Documents with equal sets are one class. 128 MinHash samples of
each class give 32 band keys, and, folded into a parity bitmap of 512 bits, an odd sketch: the bits in which two sketches
differ estimate how many samples differ. Pairs that meet in a band and whose sketches allow it are confirmed on the texts.

A large group of near copies doesn't emit all its pairs: first every class meets one hub of its band bucket; what is then
still in different components meets in tiles of the buckets, inside the tasks, and only links leave them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import Words, drop_staged, free_names, mix64, slices, staged
from tidepanel.llm.graph import components

SAMPLES, ROWS_PER_BAND, SKETCH_BITS = 128, 4, 512
#: Bits in which two sketches may differ. A pair of similarity 0.75 differs in 32 samples on average, deviation 4.9; this bound
#: is met up to 72 differing samples, eight deviations above.
MOST_BITS = 110


@dataclass(frozen=True)
class NearOptions:
    """similarity in percent; words per shingle; tile: classes of a bucket compared at once. broadcast_rows: most ids (8
    bytes each) that may be broadcast."""

    percent: int = 75
    words: int = 5
    tile: int = 256
    broadcast_rows: int = 1_000_000


with np.errstate(over="ignore"):
    _MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
    _FACTORS = mix64(np.arange(1000, 1000 + SAMPLES, dtype=np.uint64)) | np.uint64(1)
    _SALTS = mix64(np.arange(5000, 5000 + SAMPLES, dtype=np.uint64))


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes; the whole sequence if it is shorter."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    k = min(n, words)
    total = h[: n - k + 1] * _MULTIPLIERS[0]
    for i in range(1, k):
        total = total + h[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix64(total + np.uint64(k)))


def shingles(text: str, words: int) -> np.ndarray:
    """The shingle set of one text."""
    return shingle_set(Words([text]).hashes, words)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The shingle set of each text; words of all texts are hashed together."""
    found = Words(texts)
    for end, n in zip(np.cumsum(found.counts).tolist(), found.counts.tolist()):
        yield shingle_set(found.hashes[end - n : end], words)


def samples(found: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of SAMPLES multipliers."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        low = np.minimum(low, (found[i : i + 512, None] * _FACTORS).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(-1, ROWS_PER_BAND)
    total = (parts * _MULTIPLIERS[8 : 8 + ROWS_PER_BAND]).sum(axis=1, dtype=np.uint64)
    return mix64(total + _SALTS[: len(parts)]).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Each sample flips one bit; eight 64-bit words."""
    bit = (mix64(low ^ _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, digests, bands, sketches = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist(), words):
                sizes.append(len(found))
                if not len(found):
                    digests.append(None)
                    bands.append(None)
                    sketches.append(None)
                    continue
                low = samples(found)
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(band_keys(low))
                sketches.append(odd_sketch(low))
            many = pa.list_(pa.int64())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, many), pa.array(sketches, many)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return run


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, band keys, odd sketch)."""
    return docs.mapInArrow(_sign(words), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def differing_bits(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    return reduce(lambda x, y: x + y, words)


def _confirm(o: NearOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}

        def of(doc_id: int, text: str) -> np.ndarray:
            key = xxhash.xxh3_64_intdigest(text.encode())
            if key not in recent:
                if len(recent) > 500:
                    recent.clear()
                recent[key] = shingles(text, o.words)
            return recent[key]

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            linked = []
            for i in range(len(a)):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * common >= o.percent * (len(x) + len(y) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def confirmed(spark: SparkSession, docs: DataFrame, pairs: DataFrame, o: NearOptions) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; only texts that pairs need are shuffled."""
    need = staged(spark, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "need")
    ids = F.broadcast(need) if need.count() <= o.broadcast_rows else need
    texts = staged(spark, docs.join(ids, "doc_id").distinct(), "texts")
    joined = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    joined = joined.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    links = staged(spark, joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(o), "a long, b long").distinct(), "links")
    drop_staged(spark, need)
    drop_staged(spark, texts)
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of its group), kept (doc_id = component_id).

    A missing or empty text has no shingles and is its own group. Rows with the same doc_id are one document with several
    texts: they share a group. Rows without doc_id link with nothing and are kept (component_id null). Repeated rows stay,
    extra columns are ignored, an empty table gives no rows. Texts of any length count whole.
    """
    o = options
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(spark, signatures(known, o.words), "signatures")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = named.join(reps, "digest")
    classes = staged(spark, members.filter("doc_id = rep").select("doc_id", "bands", "sketch"), "classes")
    several = members.select("doc_id", "rep").distinct()
    several = several.join(several.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1"), "doc_id")
    found = staged(spark, several.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")

    buckets = classes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("k")).filter("k > 1")
    shared = staged(spark, buckets.join(shared.select("key", "hub"), "key"), "buckets")
    sketches = classes.select(F.col("doc_id").alias("node"), "sketch")
    hubs = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    hubs = hubs.join(sketches.withColumnsRenamed({"node": "a", "sketch": "sketch_a"}), "a")
    hubs = hubs.join(sketches.withColumnsRenamed({"node": "b", "sketch": "sketch_b"}), "b")
    hubs = staged(spark, hubs.filter(differing_bits("sketch_a", "sketch_b") <= MOST_BITS).select("a", "b"), "pairs")
    found = found.unionAll(confirmed(spark, known, hubs, o))
    labels = staged(spark, components(spark, found), "components")

    found = found.unionAll(staged(spark, _links_apart(shared, classes, labels, known, o), "links"))
    labels = staged(spark, components(spark, found), "components")

    grouped = members.select("doc_id", "digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select("doc_id", "digest", F.coalesce("label", "rep").alias("component")).distinct()
    everyone = signed.select("doc_id", "n_shingles", "digest").alias("s").join(grouped.alias("g"), ["doc_id", "digest"], "left")
    result = everyone.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links_apart(shared: DataFrame, classes: DataFrame, labels: DataFrame, known: DataFrame, o: NearOptions) -> DataFrame:
    """Links (a, b) between classes of one bucket that are still in different components; enough of them to join all that
    belong together.

    A bucket of more than o.tile classes is cut into tiles that meet in pairs: those of its most frequent component with the
    others, and the others with each other. Pairs are compared inside the tasks and only links leave them.
    """
    placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    shares = placed.groupBy("key", "label").agg(F.count("*").alias("k"))
    top = F.max(F.struct("k", (-F.col("label")).alias("less"))).alias("top")
    mixed = shares.groupBy("key").agg(F.sum("k").alias("total"), F.count("*").alias("kinds"), top).filter("kinds > 1")
    tiles = lambda n: F.ceil(n / o.tile).cast("int")
    rows = placed.join(mixed, "key").withColumns({"major": tiles(F.col("top.k")), "minor": tiles(F.col("total") - F.col("top.k"))})
    is_major, turn = F.col("label") == -F.col("top.less"), F.xxhash64("node", F.lit(8))
    rows = rows.withColumn("t", F.when(is_major, F.pmod(turn, "major")).otherwise(F.pmod(turn, "minor")).cast("int"))
    meet = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    across = F.when(is_major, F.transform(upto("minor"), lambda s: meet("x", F.col("t"), s))).otherwise(F.transform(upto("major"), lambda s: meet("x", s, F.col("t"))))
    among = F.transform(upto("minor"), lambda s: meet("y", F.least(s, F.col("t")), F.greatest(s, F.col("t"))))
    meetings = F.when(F.col("total") <= o.tile, F.array(meet("z", F.lit(0), F.lit(0)))).when(is_major, across).otherwise(F.concat(across, among))
    rows = rows.select("key", "node", "label", is_major.alias("major"), "t", F.explode(meetings).alias("m"))
    rows = rows.join(classes.withColumnRenamed("doc_id", "node"), "node")
    need = staged(rows.sparkSession, rows.select(F.col("node").alias("doc_id")).distinct(), "need")
    ids = F.broadcast(need) if need.count() <= o.broadcast_rows else need
    texts = known.join(ids, "doc_id").distinct().withColumnRenamed("doc_id", "node")
    rows = rows.join(texts, "node").select("key", "m.kind", "m.i", "m.j", "node", "label", "major", "t", "bands", "sketch", "text")
    dealt = rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "node")
    return dealt.mapInArrow(_compare(o), "a long, b long").distinct()


def links_of_tile(rows: list[tuple], o: NearOptions) -> list[tuple[int, int]]:
    """Links among the rows (key, kind, i, j, node, label, major, t, bands, sketch, text) of one meeting.

    A pair is looked at in the first band it shares only. Sets are built for rows that have a partner; a row meets all its
    partners at once. Links that join what is joined already are left out.
    """
    key, kind, i, j = rows[0][:4]
    node, label = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    sketch = np.array([r[9] for r in rows], np.int64).view(np.uint64)  # numpy counts the bits of the absolute value of signed numbers
    bits = sum(np.bitwise_count(sketch[:, None, w] ^ sketch[None, :, w]).astype(np.int64) for w in range(sketch.shape[1]))
    near = np.triu((bits <= MOST_BITS) & (label[:, None] != label[None, :]), 1)
    if kind == "x":
        major = np.array([r[6] for r in rows])
        near &= major[:, None] != major[None, :]
    elif kind == "y" and i != j:
        tile = np.array([r[7] for r in rows])
        near &= tile[:, None] != tile[None, :]
    x, y = np.nonzero(near)
    if not len(x):
        return []
    bands = np.array([r[8] for r in rows], np.int64)
    first = bands[x, np.argmax(bands[x] == bands[y], axis=1)] == key
    x, y = x[first], y[first]
    if not len(x):
        return []
    used = np.unique(np.concatenate([x, y]))
    sets = dict(zip(used.tolist(), shingle_sets([rows[k][10] for k in used.tolist()], o.words)))
    _, codes = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True)
    sizes = np.zeros(len(rows), np.int64)
    sizes[used] = [len(sets[k]) for k in used.tolist()]
    ends = np.cumsum(sizes[used])
    coded = dict(zip(used.tolist(), np.split(codes, ends[:-1])))
    mark = np.zeros(int(codes.max()) + 1, np.int64)
    parent = list(range(len(rows)))
    seen: dict[int, int] = {}
    for k, v in enumerate(label.tolist()):
        parent[k] = seen.setdefault(v, k)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    for a, b in zip(at, [*at[1:], len(x)]):
        k, partners = int(x[a]), y[a:b]
        mark[coded[k]] = 1
        starts = np.cumsum(sizes[partners]) - sizes[partners]
        common = np.add.reduceat(mark[np.concatenate([coded[p] for p in partners.tolist()])], starts)
        mark[coded[k]] = 0
        linked = 100 * common >= o.percent * (sizes[k] + sizes[partners] - common)
        for p in partners[linked].tolist():
            u, v = root(k), root(p)
            if u != v:
                parent[v] = u
                out.append((int(node[k]), int(node[p])))
    return out


def _compare(o: NearOptions):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            links = links_of_tile(held, o) if len(held) > 1 else []
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in slices(batches, "text"):
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if row[:4] != at:
                    yield from flush()
                    held, at = [], row[:4]
                held.append(row)
        yield from flush()

    return run


def one_of_each_group(spark: SparkSession, docs: DataFrame, options: NearOptions = NearOptions()) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest doc_id, in one row (the smallest text, if rows
    share the id). Rows without doc_id all stay."""
    groups = near_duplicates(spark, docs, options).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    (place,) = free_names(docs, "turn")
    stay = docs.filter("doc_id IS NOT NULL").join(groups, "doc_id", "left_semi").withColumn(place, turn).filter(F.col(place) == 1)
    return stay.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
