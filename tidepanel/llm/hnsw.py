"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

A shard's graph is a set of flat arrays: vectors, and per layer the node numbers and a table of neighbours. One more
component makes all vectors of a shard equally long, so that the largest inner product is the nearest point. The upper,
small layers are exact neighbour graphs; the lowest is built by insertion in batches, each batch searched side by side in
numpy. Queries go to every shard in blocks, and the shards' best results are merged.

Equal vectors are one node: with k results asked for, the k + 1 smallest ids of a node are all that can ever be returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import staged

LOWEST = np.float32(-np.inf)


@dataclass(frozen=True)
class GraphOptions:
    """links: neighbours per node of an upper layer, twice as many in the lowest. build_beam, beam: candidates kept while
    inserting and searching. shard_rows: most nodes of a shard, about. least_shards: shards of a small table."""

    links: int = 16
    build_beam: int = 64
    beam: int = 96
    batch: int = 512
    shard_rows: int = 65_536
    least_shards: int = 8
    query_block: int = 16_384
    seed: int = 4


def diverse(points: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1 for none) up to `most` that are nearer to the row's point than to a chosen one;
    free places go to the nearest of the rest."""
    rows, width = near.shape
    chosen = np.zeros((rows, width), bool)
    vectors = points[np.maximum(near, 0)]
    gram = vectors @ vectors.transpose(0, 2, 1)
    closest = np.full((rows, width), LOWEST, np.float32)  # of each candidate to a chosen one
    count = np.zeros(rows, np.int64)
    for c in range(width):
        take = (near[:, c] >= 0) & (sims[:, c] > closest[:, c]) & (count < most)
        chosen[:, c] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, gram[:, c, :]), closest)
    rank = np.where(chosen, 0, np.where(near >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out


def _top(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` best of each row, best first, and their columns."""
    if sims.shape[1] > width:
        part = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    order = np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, axis=1), axis=1, kind="stable"), axis=1)
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1), order


def exact_neighbours(points: np.ndarray, width: int, most: int) -> np.ndarray:
    """Neighbour table of a small set of points."""
    n = len(points)
    out = np.full((n, most), -1, np.int32)
    for a in range(0, n, 512):
        sims = points[a : a + 512] @ points.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = LOWEST
        ids, s, _ = _top(np.broadcast_to(np.arange(n, dtype=np.int32), sims.shape), sims, min(width, n))
        out[a : a + 512] = diverse(points, np.where(s > LOWEST, ids, -1), s, most)
    return out


def beam_search(points: np.ndarray, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and similarities of the best `beam` nodes found for each query, best first; all queries step together."""
    q, n = len(queries), len(points)
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), LOWEST, np.float32)
    width = min(beam, entry.shape[1])
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.where(entry[:, :width] >= 0, np.einsum("qed,qd->qe", points[np.maximum(entry[:, :width], 0)], queries), LOWEST)
    ids, sims, _ = _top(ids, sims, beam)
    rows = np.arange(q)
    seen[rows[:, None], np.maximum(ids, 0)] |= ids >= 0
    done = np.zeros((q, beam), bool)
    live = rows
    step = 4
    while len(live):
        open_sims = np.where(done[live] | (ids[live] < 0), LOWEST, sims[live])
        pick = np.argsort(-open_sims, axis=1, kind="stable")[:, :step]
        valid = np.take_along_axis(open_sims, pick, axis=1) > LOWEST
        keep = valid.any(axis=1)
        live, pick, valid = live[keep], pick[keep], valid[keep]
        if not len(live):
            break
        block = done[live]
        np.put_along_axis(block, pick, True, axis=1)
        done[live] = block
        source = np.where(valid, np.take_along_axis(ids[live], pick, axis=1), -1)
        near = np.where(source[:, :, None] >= 0, table[np.maximum(source, 0)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        found = np.full(near.shape, LOWEST, np.float32)
        found[r, c] = np.einsum("id,id->i", points[near[r, c]], queries[live[r]])
        new_ids, new_sims, order = _top(np.concatenate([ids[live], near], axis=1), np.concatenate([sims[live], found], axis=1), beam)
        flags = np.concatenate([done[live], np.zeros(near.shape, bool)], axis=1)
        ids[live], sims[live], done[live] = np.where(new_sims > LOWEST, new_ids, -1), new_sims, np.take_along_axis(flags, order, axis=1)
    return ids, sims


class Graph:
    """Flat arrays of one shard. layers: from the top, (node numbers, neighbour table in places of these numbers)."""

    def __init__(self, points: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.layers = points, layers

    def search(self, queries: np.ndarray, beam: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes for each query, going down through the first `depth` layers."""
        depth = len(self.layers) if depth is None else depth
        nodes, _ = self.layers[0]
        sims = queries @ self.points[nodes].T
        places, sims, _ = _top(np.broadcast_to(np.arange(len(nodes), dtype=np.int32), sims.shape), sims, min(beam if depth == 1 else 8, len(nodes)))
        ids = nodes[places]
        for k in range(1, depth):
            nodes, table = self.layers[k]
            entry = np.searchsorted(nodes, ids).astype(np.int32)  # nodes ascend; upper nodes are in every lower layer
            entry = np.where(ids >= 0, entry, -1)
            places, sims = beam_search(self.points[nodes] if len(nodes) < len(self.points) else self.points, table, queries, entry, beam if k == depth - 1 else 8)
            ids = np.where(places >= 0, nodes[np.maximum(places, 0)], -1)
        return ids, sims


def build(points: np.ndarray, o: GraphOptions) -> Graph:
    """The graph of points of equal length; nodes are numbered by row."""
    n, rng = len(points), np.random.default_rng(o.seed)
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(o.links)).astype(int)
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    if not level.any():
        level[rng.integers(n)] = 1
    top = int(level.max())
    while top > 1 and (level >= top).sum() < 64:  # the top layer is scanned; level 1 always stays
        top -= 1
    if n <= 2 * o.links + 1:  # all are neighbours of all
        top = 0
    for at in range(top, 0, -1):
        nodes = np.flatnonzero(level >= at).astype(np.int32)
        layers.append((nodes, exact_neighbours(points[nodes], 3 * o.links, o.links)))
    lowest, every = 2 * o.links, np.arange(n, dtype=np.int32)
    if not layers:
        return Graph(points, [(every, exact_neighbours(points, 3 * lowest, lowest))])
    table = np.full((n, lowest), -1, np.int32)
    first = layers[-1][0]
    start = exact_neighbours(points[first], 2 * lowest, lowest)
    table[first] = np.where(start >= 0, first[np.maximum(start, 0)], -1)
    graph = Graph(points, [*layers, (every, table)])
    rest = rng.permutation(np.flatnonzero(level == 0)).astype(np.int32)
    a = 0
    while a < len(rest):
        b = a + min(o.batch, max(1, (len(first) + a) // 2))  # a batch sees itself only by near mates: no more than half of what is there
        _insert(graph, rest[a:b], o, lowest)
        a = b
    return graph


def _insert(graph: Graph, batch: np.ndarray, o: GraphOptions, lowest: int) -> None:
    points, table = graph.points, graph.layers[-1][1]
    ids, sims = graph.search(points[batch], o.build_beam)
    own = points[batch] @ points[batch].T
    np.fill_diagonal(own, LOWEST)
    mates, mate_sims, _ = _top(np.broadcast_to(batch, own.shape), own, min(o.links, len(batch)))
    near, s, _ = _top(np.concatenate([ids, mates], axis=1), np.concatenate([sims, mate_sims], axis=1), o.build_beam)
    table[batch] = diverse(points, np.where(s > LOWEST, near, -1), s, lowest)[:, :lowest]
    links = table[batch]
    back, new = links.ravel(), np.repeat(batch, links.shape[1])
    new, back = new[back >= 0], back[back >= 0]
    order = np.argsort(back, kind="stable")
    back, new = back[order], new[order]
    target, at, times = np.unique(back, return_index=True, return_counts=True)
    # every back link is looked at; nodes that many of the batch link to form groups of their own, of twice the width each
    widths = 2 * lowest * 2 ** np.ceil(np.log2(np.maximum(times / (2 * lowest), 1))).astype(int)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        _link_back(graph, target[own], [new[at[i] : at[i] + times[i]] for i in own.tolist()], lowest)


def _link_back(graph: Graph, target: np.ndarray, new: list[np.ndarray], lowest: int) -> None:
    """Give each target its new neighbours, and of more than `lowest` the diverse ones."""
    points, table = graph.points, graph.layers[-1][1]
    times = np.array([len(x) for x in new])
    grid = np.full((len(target), int(times.max())), -1, np.int32)
    grid[np.arange(grid.shape[1]) < times[:, None]] = np.concatenate(new)
    both = np.concatenate([table[target], grid], axis=1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    full = (both >= 0).sum(axis=1) > lowest
    simple = np.sort(both[~full], axis=1)[:, ::-1][:, :lowest]
    table[target[~full]] = simple
    some = max(1, 2048 * (3 * lowest) ** 2 // both.shape[1] ** 2)
    for b in range(0, int(full.sum()), some):
        t, near = target[full][b : b + some], both[full][b : b + some]
        s = np.where(near >= 0, np.einsum("tcd,td->tc", points[np.maximum(near, 0)], points[t]), LOWEST).astype(np.float32)
        near, s, _ = _top(near, s, near.shape[1])
        table[t] = diverse(points, np.where(s > LOWEST, near, -1), s, lowest)


# ---- shards -----------------------------------------------------------------------------------------------------------

SHARD = "dim int, shard int, ids binary, vectors binary, members array<array<long>>, layers array<struct<nodes: binary, links: binary>>"


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to at most length 1, with one more component that makes them all of length 1."""
    x = vectors.astype(np.float64)
    x = x / np.sqrt((x**2).sum(axis=1)).max()
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))[:, None]], axis=1).astype(np.float32)


def _build(o: GraphOptions):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        vectors = np.stack(rows["embedding"].to_numpy()).astype("<f4")
        graph = build(lengthened(vectors), o)
        layers = [{"nodes": nodes.astype("<i4").tobytes(), "links": table.astype("<i4").tobytes()} for nodes, table in graph.layers]
        one = [key[0], key[1], rows["vec_id"].to_numpy("<i8").tobytes(), vectors.tobytes(), [list(m) for m in rows["members"]], layers]
        return pd.DataFrame([one], columns=["dim", "shard", "ids", "vectors", "members", "layers"])

    return run


def usable(column: str) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def build_shards(spark: SparkSession, vectors: DataFrame, k: int, o: GraphOptions) -> tuple[DataFrame, int]:
    """(one row per shard with its graph, shards per dimension)."""
    rows = vectors.filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL").distinct()
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("turn") <= k + 1)
    nodes = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    nodes = staged(spark, nodes.select(F.col("members")[0].alias("vec_id"), "embedding", "members", F.size("embedding").alias("dim")), "nodes")
    shards = max(o.least_shards, -(-nodes.count() // o.shard_rows))
    placed = nodes.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(o.seed)), F.lit(shards)).cast("int"))
    return staged(spark, placed.groupBy("dim", "shard").applyInPandas(_build(o), SHARD), "graphs"), shards


def _search(k: int, o: GraphOptions):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        g = graphs.iloc[0]
        ids = np.frombuffer(g["ids"], "<i8")
        vectors = np.frombuffer(g["vectors"], "<f4").reshape(len(ids), -1)
        layers = []
        for layer in g["layers"]:
            nodes = np.frombuffer(layer["nodes"], "<i4")
            layers.append((nodes, np.frombuffer(layer["links"], "<i4").reshape(len(nodes), -1)))
        graph, members = Graph(lengthened(vectors), layers), g["members"]
        width = max(len(m) for m in members)
        table = np.full((len(ids), width), -1, np.int64)
        for i, m in enumerate(members):
            table[i, : len(m)] = m
        out = []
        for a in range(0, len(queries), o.batch):
            part = queries.iloc[a : a + o.batch]
            exact = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            own = part["vec_id"].to_numpy(np.int64)
            asked = np.concatenate([exact, np.zeros((len(exact), 1))], axis=1).astype(np.float32)
            found, _ = graph.search(asked, max(o.beam, 2 * k))
            score = np.where(found >= 0, np.einsum("qcd,qd->qc", vectors[np.maximum(found, 0)].astype(np.float64), exact), -np.inf)
            others = np.where(found[:, :, None] >= 0, table[np.maximum(found, 0)], -1).reshape(len(part), -1)
            score = np.where((others < 0) | (others == own[:, None]), -np.inf, np.repeat(score, width, axis=1))
            order = np.lexsort((others, -score), axis=1)[:, :k]
            best, ids_best = np.take_along_axis(score, order, axis=1), np.take_along_axis(others, order, axis=1)
            r, c = np.nonzero(best > -np.inf)
            out.append(pd.DataFrame({"query_id": own[r], "vec_id": ids_best[r, c], "score": best[r, c]}))
        return pd.concat(out)

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, options: GraphOptions = GraphOptions()) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found of each query, by inner product, ties to smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without vec_id. Only vectors
    of the query's length are candidates, and never those with its vec_id. Repeated rows count once; extra columns are
    ignored; an empty table gives no rows. Scores are sums in double precision over the original components.
    """
    o = options
    graphs, shards = build_shards(spark, vectors, k, o)
    asked = queries.filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    asked = staged(spark, asked.filter("vec_id IS NOT NULL").distinct().withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, -(-asked.count() // o.query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k, o), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
