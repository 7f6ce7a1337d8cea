"""Discrete Fourier transforms of series of any length.

A transform of height * 2 ** bits values is two rounds of short ones: the values are laid out as a matrix, transformed along its
columns, turned by twiddle factors, and transformed along its rows. Values travel as runs of TILE neighbours, and a task holds TILE columns
or rows of the matrix, about TILE times the square root of the length. The spectrum of a series at its own length, which need not be
one of these, is read off one transform of a longer grid: the values are divided by the transform of a narrow window, which fits
between the grid's points (to 1e-13 of the largest value of the spectrum). Of a real series half of the grid is sent.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame, functions as F

from tidepanel.operators.blocks import attach, number_rows, per_series
from tidepanel.session import cut_lineage, drop_staged

TILE_BITS = 6
SPAN = 64  # runs of a spectrum that are made at once
LEAST_GRID = 1.5  # points of the grid per value; fewer would ask for a window that costs digits
MOST_HALF = 16  # no window reaches more points to either side

#: A run of values: `chunk` counts runs of the transform, `n` is the length of the series, height * 2 ** bits that of the transform.
RUNS = "series_id string, n long, height int, bits int, chunk long, re array<double>, im array<double>"
_MANY = pa.list_(pa.float64())


def _arrays(z: np.ndarray) -> list[pa.Array]:
    """Rows of a complex matrix as two columns of arrays."""
    offsets = pa.array(np.arange(0, z.size + 1, z.shape[1] if z.size else 1, dtype=np.int32)) if z.size else pa.array([0], pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(part).ravel(), pa.float64())) for part in (z.real, z.imag)]


def _complex(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    re, im = (np.concatenate([c.flatten().to_numpy() for c in (col.chunks if isinstance(col, pa.ChunkedArray) else [col])]) for col in (table.column("re"), table.column("im")))
    return (re + 1j * im).reshape(-1, width)


def shape_for(length, tile_bits: int) -> list:
    """Columns height and bits of a transform of at least `length` values, hardly more, that can be cut into tiles."""
    bits = F.greatest(F.ceil(F.log2(length.cast("double")) / 2), F.lit(tile_bits)).cast("int")
    height = F.greatest(F.ceil(length / F.pow(F.lit(2.0), bits) / (1 << tile_bits)), F.lit(1)) * (1 << tile_bits)
    return [height.cast("int").alias("height"), bits.alias("bits")]


def _own(table: pa.Table, rows: int) -> list[pa.Array]:
    """The first columns of RUNS, for `rows` rows of one series."""
    return [pa.array([table.column(c)[0].as_py()] * rows, t) for c, t in (("series_id", pa.string()), ("n", pa.int64()), ("height", pa.int32()), ("bits", pa.int32()))]


def _size(runs: pa.RecordBatch) -> np.ndarray:
    return runs.column("height").to_numpy().astype(np.int64) << runs.column("bits").to_numpy().astype(np.int64)


def transform(runs: DataFrame, inverse: bool = False, tile_bits: int | None = None, real: bool = False) -> DataFrame:
    """The transforms of all series of RUNS, as RUNS. Missing runs are zeros, runs that come in parts are summed; the inverse is
    divided by the length. Of `real` values only the runs in the first half of each row of the matrix come; the others hold the
    conjugates of theirs."""
    tile = 1 << (TILE_BITS if tile_bits is None else tile_bits)
    sign = 2j * math.pi if inverse else -2j * math.pi
    short = np.fft.ifft if inverse else np.fft.fft

    def columns(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        n1, n2 = table.column("height")[0].as_py(), 1 << table.column("bits")[0].as_py()
        at = int(chunk[0] % (n2 // tile))
        x, parts, place = np.zeros((n1, tile), complex), _complex(table, tile), chunk // (n2 // tile)
        first = np.unique(place, return_index=True)[1]
        x[place[first]] = parts[first]
        more = np.delete(np.arange(len(place)), first)
        np.add.at(x, place[more], parts[more])
        rows = min(n1 // tile, n1 // (2 * tile) + 1) if real else n1 // tile
        turn = np.outer(np.arange(rows * tile), at * tile + np.arange(tile))  # below n1 * n2
        x = short(x, axis=0)[: rows * tile] * np.exp(sign * turn / (n1 * n2))
        re, im = _arrays(x.reshape(rows, tile * tile))
        return pa.table([*_own(table, rows), pa.array(np.arange(rows)), pa.array(np.full(rows, at)), re, im], names=["series_id", "n", "height", "bits", "row", "chunk", "re", "im"])

    def rows(table: pa.Table) -> pa.Table:
        n1, n2 = table.column("height")[0].as_py(), 1 << table.column("bits")[0].as_py()
        at = table.column("row")[0].as_py()
        x = np.zeros((n2 // tile, tile, tile), complex)
        x[table.column("chunk").to_numpy()] = _complex(table, tile * tile).reshape(-1, tile, tile)
        x = short(x.transpose(1, 0, 2).reshape(tile, n2), axis=1)
        re, im = _arrays(x.T)
        return pa.table([*_own(table, n2), pa.array(at + n1 // tile * np.arange(n2)), re, im], names=["series_id", "n", "height", "bits", "chunk", "re", "im"])

    across = (F.pow(F.lit(2.0), "bits") / tile).cast("long")  # runs in a row of the matrix
    by_column = runs.groupBy("series_id", (F.col("chunk") % across).alias("_t"))
    middle = by_column.applyInArrow(columns, "series_id string, n long, height int, bits int, row long, chunk long, re array<double>, im array<double>")
    return middle.groupBy("series_id", "row").applyInArrow(rows, RUNS)


def pointwise(runs: DataFrame, change: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], tile_bits: int | None = None) -> DataFrame:
    """RUNS with change(values, index, n, length of the transform) in place of the values, all as (runs x TILE)."""
    tile = 1 << (TILE_BITS if tile_bits is None else tile_bits)

    def run(batches):
        for b in batches:
            if b.num_rows:
                index = b.column("chunk").to_numpy()[:, None] * tile + np.arange(tile)
                z = change(_complex(b, tile), index, b.column("n").to_numpy()[:, None], _size(b)[:, None])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], *_arrays(z)], names=b.schema.names)

    return runs.mapInArrow(run, RUNS)


def runs_of(rows: DataFrame, value: str, length, tile_bits: int | None = None) -> DataFrame:
    """RUNS of the values at pos (0 to n - 1, without holes), for transforms of at least `length` (a column) values."""
    bits = TILE_BITS if tile_bits is None else tile_bits
    tile = 1 << bits
    packed = rows.groupBy("series_id", F.floor(F.col("pos") / tile).alias("chunk")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v")))).alias("_v")
    )
    at = F.sequence(F.lit(0), F.lit(tile - 1))
    return packed.select(
        "series_id", "n", *shape_for(length, bits), "chunk",
        F.transform(at, lambda i: F.coalesce(F.get("_v", i)["v"], F.lit(0.0))).alias("re"), F.transform(at, lambda i: F.lit(0.0)).alias("im"),
    )


@functools.lru_cache(64)
def _window(n: int, size: int, tile: int) -> tuple[int, float]:
    """(half width in points, shape) of the Kaiser-Bessel window that reads a spectrum off a grid of `size` points."""
    over = min(size / (n + 2 * tile), 2.5)
    half = math.ceil(34 / (2 * math.pi * math.sqrt(1 - 1 / over))) + 1
    return half, 2 * math.pi * half * (1 - 0.5 / over)


def _window_transform(t: np.ndarray, size: int, half: int, shape: float) -> np.ndarray:
    root = np.sqrt(shape**2 - (2 * math.pi * half * t / size) ** 2)
    return half * (np.exp(root - shape) - np.exp(-root - shape)) / root


@functools.lru_cache(64)
def _window_pieces(half: int, shape: float) -> np.ndarray:
    """The window between its points 1 - half to half, as Chebyshev series in the place between two points."""

    def piece(d: int) -> np.ndarray:
        return chebyshev.chebinterpolate(lambda x: np.i0(shape * np.sqrt(np.maximum(0, 1 - (((x + 1) / 2 - d) / half) ** 2))) * math.exp(-shape), 20)

    return np.stack([piece(d) for d in range(1 - half, half + 1)])


def _centre(n, tile: int):
    """The position that comes first on the grid; those before it are at its end."""
    return n // 2 // tile * tile


def _grid_shape(tile_bits: int) -> list:
    return shape_for(F.greatest(LEAST_GRID * (F.col("n") + (2 << tile_bits)), F.lit(2.0 * MOST_HALF)), tile_bits)


def grid_runs(rows: DataFrame, value: str, tile_bits: int) -> DataFrame:
    """RUNS of the values at pos (0 to n - 1), about their centre and divided by the window's transform. Rows are packed where
    they are: those of a run that aren't neighbours make several runs, which transform() sums."""
    tile = 1 << tile_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            series = b.column("series_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            pos, n = (b.column(c).to_numpy() for c in ("pos", "n"))
            v = pc.fill_null(b.column("v"), 0.0).to_numpy()
            of, size = pos // tile, _size(b)
            new = np.concatenate([[True], (series[1:] != series[:-1]) | (of[1:] != of[:-1])])
            head, z = np.flatnonzero(new), np.zeros((int(new.sum()), tile))
            t = pos - _centre(n, tile)
            for m, k in {(int(size[i]), int(n[i])) for i in head.tolist()}:
                own = (size == m) & (n == k)
                z[(np.cumsum(new) - 1)[own], (pos % tile)[own]] = v[own] / _window_transform(t[own], m, *_window(k, m, tile))
            chunk = (of[head] - _centre(n[head], tile) // tile) % (size[head] // tile)
            own = [b.column(c).take(pa.array(head)) for c in ("series_id", "n", "height", "bits")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(chunk), *_arrays(z + 0j)], names=["series_id", "n", "height", "bits", "chunk", "re", "im"])

    return rows.select("series_id", "pos", "n", *_grid_shape(tile_bits), F.col(value).cast("double").alias("v")).mapInArrow(run, RUNS)


def spectrum(rows: DataFrame, value: str, tile_bits: int | None = None, half: bool = False) -> DataFrame:
    """RUNS of the transform of each series at its own length n: index k < n of the runs (k <= n // 2, if `half` is enough), the
    rest is of no account.

    A transform is sent twice, half of a grid of 1.5 points per value each time (more for short series)."""
    tile_bits = TILE_BITS if tile_bits is None else tile_bits
    tile = 1 << tile_bits
    span = SPAN * tile
    size, n = F.col("height") * F.pow(F.lit(2.0), "bits"), F.col("n")
    last = F.floor(n / 2) if half else n - 1
    grid = transform(grid_runs(rows, value, tile_bits), tile_bits=tile_bits, real=True)

    def seen(sign: int, turns: int):
        """Spans that look at the points sign * (those of the run) + turns * size."""
        ends = [sign * (F.col("chunk") * tile + k) + turns * size for k in (0, tile - 1)]
        low, high = (ends if sign > 0 else ends[::-1])
        a = F.greatest(F.lit(0), F.floor((low - MOST_HALF - 2) * n / size / span)).cast("long")
        b = F.least(F.floor(last / span), F.floor((high + MOST_HALF + 2) * n / size / span)).cast("long")
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))

    spans = F.array_distinct(F.flatten(F.array(*[seen(1, k) for k in (-1, 0, 1)], *[seen(-1, k) for k in (0, 1, 2)])))
    near = grid.select("series_id", "chunk", "re", "im", F.explode(spans).alias("_chunks"))
    every = per_series(rows).select("series_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / span))).alias("_chunks"))

    def read_off(table: pa.Table) -> pa.Table:
        n, at = table.column("n")[0].as_py(), table.column("_chunks")[0].as_py()
        m = table.column("height")[0].as_py() << table.column("bits")[0].as_py()
        half_width, shape = _window(n, m, tile)
        k = np.arange(at * span, min((at + 1) * span, (n // 2 if half else n - 1) + 1))
        base, rest = np.divmod(k * m, n)
        low = int(base[0]) - half_width
        points = np.zeros(int(base[-1]) + half_width + 1 - low, complex)
        z, place = _complex(table, tile), table.column("chunk").to_numpy()[:, None] * tile + np.arange(tile)
        for sign, turns in ((1, -1), (1, 0), (1, 1), (-1, 0), (-1, 1), (-1, 2)):
            i = sign * place + (turns * m - low)
            own = (i >= 0) & (i < len(points))
            points[i[own]] = z[own] if sign > 0 else z[own].conj()
        weights = _window_pieces(half_width, shape) @ chebyshev.chebvander(2 * (rest / n) - 1, 20).T
        around = points[(base - low)[None, :] + np.arange(1 - half_width, half_width + 1)[:, None]]
        out = np.zeros((-(-len(k) // tile), tile), complex)
        out.ravel()[: len(k)] = (weights * around).sum(axis=0) * np.exp(-2j * math.pi * ((k * _centre(n, tile)) % n) / n)
        re, im = _arrays(out)
        return pa.table([*_own(table, len(out)), pa.array(at * SPAN + np.arange(len(out))), re, im], names=["series_id", "n", "height", "bits", "chunk", "re", "im"])

    # the spans come from a row per series, so Spark takes them for small; a join that sorts leaves the rows where the groups want them
    every = every.select("*", *_grid_shape(tile_bits)).hint("merge")
    return near.join(every, ["series_id", "_chunks"]).groupBy("series_id", "_chunks").applyInArrow(read_off, RUNS)


def strongest(runs: DataFrame, tile_bits: int | None = None) -> DataFrame:
    """(series_id, bin): the index from 1 to n // 2 with the largest magnitude, the smallest among equals."""
    tile = 1 << (TILE_BITS if tile_bits is None else tile_bits)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z = np.abs(_complex(b, tile))
            index = b.column("chunk").to_numpy()[:, None] * tile + np.arange(tile)
            z = np.where((index >= 1) & (index <= b.column("n").to_numpy()[:, None] // 2), z, -1.0)
            best = z.argmax(axis=1)
            at = np.arange(len(z))
            yield pa.RecordBatch.from_arrays([b.column("series_id"), pa.array(z[at, best]), pa.array(index[at, best])], names=["series_id", "power", "bin"])

    found = runs.mapInArrow(run, "series_id string, power double, bin long").where("power >= 0")
    return found.groupBy("series_id").agg((-F.max(F.struct("power", (-F.col("bin")).alias("less")))["less"]).alias("bin"))


def lag_sums(rows: DataFrame, value: str, tile_bits: int | None = None) -> DataFrame:
    """(series_id, n, lag, s): sums of products of the values `lag` apart, for all lags below half the length: the inverse
    transform of the power spectrum of the zero-padded series."""
    bits = TILE_BITS if tile_bits is None else tile_bits
    tile = 1 << bits
    power = pointwise(transform(runs_of(rows, value, 2 * F.col("n"), bits), tile_bits=bits), lambda z, k, n, m: (z * np.conj(z)).real + 0j, bits)
    sums = transform(power, inverse=True, tile_bits=bits).where(F.col("chunk") * tile < F.col("n") / 2)
    each = sums.select("series_id", "n", "chunk", F.posexplode("re").alias("_i", "s")).withColumn("lag", F.col("chunk") * tile + F.col("_i"))
    return each.where((F.col("lag") >= 1) & (F.col("lag") < F.least(F.col("n") - 1, F.floor(F.col("n") / 2)))).select("series_id", "n", "lag", "s")


def centred(rows: DataFrame) -> DataFrame:
    """(series_id, pos, n, d): valid values less their mean, numbered anew without holes.

    The numbered and the centred rows are written once, as all that follows reads them several times.
    """
    spark = rows.sparkSession
    valid = rows.where(F.col("y").isNotNull()).select("series_id", F.col("pos").alias("_p"), "y")
    numbered = cut_lineage(spark, number_rows(valid, ("_p",)).select("series_id", "pos", "n", "y"), "numbered")
    less = attach(numbered, per_series(numbered, F.avg("y").alias("_m"))).select("series_id", "pos", "n", (F.col("y") - F.col("_m")).alias("d"))
    less = cut_lineage(spark, less.sortWithinPartitions("series_id", "pos"), "centred")
    drop_staged(spark, numbered)
    return less
