"""Spelling variants: words that differ by one code point, found by pairs of trie nodes.

The vocabulary is sorted and its trie numbered on the way, once forwards and once with the words reversed. A word of length L
is the pair (node of its first i, node of its last L - i code points) for every i; without its code point i it is the pair
(node of the first i, node of the last L - i - 1). Equal pairs mean equal strings, so words that differ in one code point share
a pair that skips it, and a word shares a pair with every word that holds one code point more. A pair holds one word at most
and as many words without one code point as the alphabet has letters, so no group grows with the data.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import CRC32_SQL, CRC_TABLE_SQL, drop_staged, staged


@dataclass(frozen=True)
class VariantOptions:
    """Words have at least `letters` code points and `least` occurrences; a form occurs at least `times` as often as its word.
    `letter` is the character class of words. One occurrence in `damage` loses a code point (0: none does)."""

    letters: int = 7
    least: int = 2
    times: int = 10
    letter: str = r"[A-Za-zÀ-ÿ]"
    damage: int = 31


def word_counts(docs: DataFrame, o: VariantOptions) -> DataFrame:
    """(word, n) over whole texts; occurrences are added up before they are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"{o.letter}{{{o.letters},}}"), F.lit(0))  # shorter ones can't become words
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    words = words.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    if o.damage:
        words = words.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        words = words.withColumn("run", F.when(F.col("h") % o.damage == 0, cut).otherwise(F.col("run")))
    words = words.filter(F.length("run") >= o.letters)
    return words.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= o.least)


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of one partition, numbered as its sorted strings pass: nodes from 1 on, the root is 0."""
    part, at, nodes, last, path = TaskContext.get().partitionId(), 0, 0, "", [0]
    for batch in batches:
        paths = []
        for key in batch.column("key").to_pylist():
            k, most = 0, min(len(last), len(key))
            while k < most and last[k] == key[k]:
                k += 1
            path = [*path[: k + 1], *range(nodes + 1, nodes + 1 + len(key) - k)]
            nodes, last = nodes + len(key) - k, key
            paths.append(path)
        n = batch.num_rows
        rest = [batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n)), pa.array(paths, pa.list_(pa.int64()))], names=[*batch.schema.names, "part", "at", "path"])
        at += n


def borders(parts: list) -> list[tuple[int, int, int, int, list[int]]]:
    """For each partition, in order: (part, strings before it, nodes before it, depth of the path that its first string shares
    with the last one before it, global numbers of that path from the root on). `parts` has one row per partition."""
    out, strings, nodes, last, last_path = [], 0, 0, "", [0]
    for p in sorted(parts, key=lambda r: r["part"]):
        first, depth = p["first"]["key"], 0
        while depth < min(len(first), len(last)) and first[depth] == last[depth]:
            depth += 1
        shared = last_path[: depth + 1]
        out.append((p["part"], strings, nodes, depth, shared))
        last, last_path = p["last"]["key"], [shared[x] if x <= depth else nodes + x - depth for x in p["last"]["path"]]
        strings, nodes = strings + p["strings"], nodes + p["nodes"] - depth
    return out


def number_nodes(spark: SparkSession, words: DataFrame, key: Column) -> DataFrame:
    """words with `place` (of the key in sorted order) and `path`: numbers of the trie nodes from the root to the key.

    Keys are distinct. Partitions number their own nodes; what a partition's first key shares with the key before it gets that
    one's numbers. Two keys of each partition pass the driver.
    """
    columns = words.columns
    rows = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", part int, at long, path array<long>"
    local = staged(spark, rows.mapInArrow(_local_paths, ddl), "paths")
    ends = [f("key", "path").alias(n) for n, f in (("first", lambda *c: F.min_by(F.struct(*c), "at")), ("last", lambda *c: F.max_by(F.struct(*c), "at")))]
    found = local.groupBy("part").agg(*ends, F.count("*").alias("strings"), F.max(F.element_at("path", -1)).alias("nodes")).collect()
    table = spark.createDataFrame(borders(found), "part int, strings long, nodes long, depth int, shared array<long>")
    joined = local.join(F.broadcast(table), "part")  # one row per partition
    numbered = F.transform("path", lambda x: F.when(x <= F.col("depth"), F.get("shared", x.cast("int"))).otherwise(F.col("nodes") + x - F.col("depth")))
    return joined.select(*columns, (F.col("strings") + F.col("at")).alias("place"), numbered.alias("path"))


GAP, SKIP_FIRST, SKIP_AGAIN = range(3)  # nothing left out; a code point left out, the first of equal neighbours or a later one


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix node, suffix node, word, n, kind) of each word: L + 1 pairs that skip nothing, L that skip one code point."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4000):
            words = batch.slice(a, 4000)
            text = words.column("word").to_pylist()
            size = np.array([len(w) for w in text], np.int64)
            if not len(text):
                continue
            forward, backward = (words.column(c).flatten().to_numpy() for c in ("forward", "backward"))
            code = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
            opens = np.cumsum(size + 1) - (size + 1)
            owner = np.repeat(np.arange(len(text)), size + 1)
            i = np.arange(len(forward)) - opens[owner]
            suffix = opens[owner] + size[owner] - i  # place of the node of what follows the first i
            inner = i < size[owner]
            letter = (np.cumsum(size) - size)[owner] + i
            again = np.zeros(len(i), bool)
            again[inner & (i > 0)] = code[letter[inner & (i > 0)]] == code[letter[inner & (i > 0)] - 1]
            kind = np.where(again, SKIP_AGAIN, SKIP_FIRST)[inner]
            place, n = (words.column(c).to_numpy() for c in ("place", "n"))
            both = np.concatenate([owner, owner[inner]])
            columns = [
                np.concatenate([forward, forward[inner]]),
                np.concatenate([backward[suffix], backward[suffix[inner] - 1]]),
                place[both],
                n[both],
                np.concatenate([np.full(len(owner), GAP), kind]).astype(np.int8),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "suffix", "word", "n", "kind"])


def _meet(prefix: np.ndarray, suffix: np.ndarray, word: np.ndarray, n: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
    """(word, near words in its pair, n and number of the best of them) among rows sorted by (prefix, suffix)."""
    opens = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])])
    size = np.diff(np.flatnonzero(opens), append=len(prefix))
    shared = np.repeat(size > 1, size)
    group, word, n, kind = (np.cumsum(opens) - 1)[shared], word[shared], n[shared], kind[shared]
    order = np.lexsort((word, -n, group))  # in each pair the best word first
    group, word, n, kind = group[order], word[order], n[order], kind[order]
    out = []

    def first_of(group: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)

    skip = np.flatnonzero(kind != GAP)  # one replaced: all that skip share the pair
    first = first_of(group[skip])
    many = np.diff(first, append=len(skip))
    first, many = first[many > 1], many[many > 1]
    at = skip[np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    best = np.repeat(skip[first], many)
    best[at == best] = skip[first + 1]
    out.append((word[at], np.repeat(many - 1, many), n[best], word[best]))

    gap, once = np.flatnonzero(kind == GAP), np.flatnonzero(kind == SKIP_FIRST)  # one inserted or left out
    home = np.searchsorted(group[gap], group[once])
    fits = home < len(gap)
    fits[fits] = group[gap[home[fits]]] == group[once[fits]]
    at, home = once[fits], gap[home[fits]]
    out.append((word[at], np.ones(len(at), np.int64), n[home], word[home]))
    first = first_of(home)
    out.append((word[home[first]], np.diff(first, append=len(home)), n[at[first]], word[at[first]]))
    return [np.concatenate(c) for c in zip(*out)]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows with one pair; the last one of a batch waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("prefix", "suffix", "word", "n", "kind")]
        rows = rows if held is None else [np.concatenate(c) for c in zip(held, rows)]
        if not len(rows[0]):
            continue
        border = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
        held = [c[border:] for c in rows]
        if border:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _meet(*[c[:border] for c in rows])], names=["place", "near", "best_n", "best"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _meet(*held)], names=["place", "near", "best_n", "best"])


def roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(place, root) of words (place, next) that have a form; each round doubles the steps."""
    at = staged(spark, links.select("place", F.col("next").alias("root")), "roots")
    while True:
        further = at.select(F.col("place").alias("root"), F.col("root").alias("beyond"))
        at_next = staged(spark, at.join(further, "root", "left").select("place", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        drop_staged(spark, at)
        at = at_next.select("place", "root")
        if at_next.filter("moved").isEmpty():
            return at


def spelling_variants(spark: SparkSession, docs: DataFrame, options: VariantOptions = VariantOptions()) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of letters, lower-cased (A-Z only), with the occurrences and lengths of the options. The form is the near word
    (one code point inserted, deleted or replaced) of largest n, among equals the smallest in code-point order, if that n is large
    enough; the root is where following forms ends. A missing or empty text has no words; a row without doc_id has an empty id;
    repeated rows count as often as they occur; other columns are ignored; an empty table gives no rows.
    """
    o = options
    counts = staged(spark, word_counts(docs, o), "words")
    words = staged(spark, number_nodes(spark, counts, F.col("word")).withColumnRenamed("path", "forward"), "forward")
    backward = number_nodes(spark, words.select("word", F.col("place").alias("id")), F.reverse("word")).select(F.col("id").alias("place"), F.col("path").alias("backward"))
    pairs = words.join(backward, "place").select("word", "place", "n", "forward", "backward").mapInArrow(_pairs, "prefix long, suffix long, word long, n long, kind byte")
    met = pairs.repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix").mapInArrow(_near, "place long, near long, best_n long, best long")
    near = met.groupBy("place").agg(F.sum("near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("less"))).alias("top"))
    own = words.select("place", "word", "n").join(near, "place", "left")
    has_form = F.col("top.best_n") >= o.times * F.col("n")
    own = own.select("place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, -F.col("top.less")).alias("next"), F.when(has_form, F.col("top.best_n")).alias("form_n"))
    own = staged(spark, own, "near")
    formed = own.filter("next IS NOT NULL")
    ends = roots(spark, formed)
    name = lambda place, word: own.select(F.col("place").alias(place), F.col("word").alias(word))
    named = formed.select("place", "next", "form_n").join(ends, "place").join(name("next", "form"), "next").join(name("root", "root_word"), "root")
    full = own.select("place", "word", "n", "n_near").join(named.select("place", "form", "root_word", "form_n"), "place", "left")
    return full.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows, by equal strings instead of nodes.
SQL = f"""
WITH {CRC_TABLE_SQL}
  runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS raw FROM documents),
  lower_runs AS (SELECT doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
  keyed AS (SELECT run, k, hex(encode(doc || ':' || run)) AS bytes FROM lower_runs),
  hashed AS (
    SELECT run, k, {CRC32_SQL} AS h
    FROM keyed, crc_table),
  damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
  words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
  places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
  skips AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM places),
  near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(o := other, m := other_n), struct_pack(m := -other_n, o := other)) AS top FROM near GROUP BY word),
  formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 10 * w.n THEN top.o END AS form, CASE WHEN top.m >= 10 * w.n THEN top.m END AS form_n
    FROM words w LEFT JOIN best USING (word)),
  walk AS (
    WITH RECURSIVE step AS (
      SELECT word, word AS place, form AS following FROM formed
      UNION ALL SELECT s.word, f.word, f.form FROM step s JOIN formed f ON f.word = s.following)
    SELECT word, place AS root FROM step WHERE following IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)
"""
