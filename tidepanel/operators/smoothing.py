"""Natural cubic smoothing splines of series of any length, and the banded solves behind them.

The spline that minimises squared residuals plus lambda times the integrated squared second derivative is found by Reinsch's
system, which has five diagonals. A banded system is cut into pieces whose last unknowns separate them: pieces are reduced on
their own, a small system over the separators is solved, and the pieces are filled in. That is done twice: by numpy for the
unknowns of a block, and by Spark for the blocks of a series, so no block needs to know how far lambda reaches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import blocks as bl
from tidepanel.operators.blocks import attach, halo, nearest_valid, number_rows, per_series
from tidepanel.session import cut_lineage

DENSE = 96  # unknowns that are solved as one dense matrix
CANDIDATES = 16  # values of lambda tried at once
ROUNDS = 7
LOWEST, HIGHEST = -8.0, 20.0  # range of the exponent of lambda


def solve_bands(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """x of A x = rhs, with bands[w + d, i] = A[i, i + d] for |d| <= w; rhs has one column per right side."""
    w, n = bands.shape[0] // 2, bands.shape[1]
    if n <= DENSE:
        a = np.zeros((n, n))
        for d in range(-w, w + 1):
            i = np.arange(max(0, -d), min(n, n - d))
            a[i, i + d] = bands[w + d, i]
        return np.linalg.solve(a, rhs)
    size = max(32, 8 * w)
    count = -(-n // size)
    pad = count * size - n
    bands, rhs = np.pad(bands, ((0, 0), (0, pad))), np.pad(rhs, ((0, pad), (0, 0)))
    bands[w, n:] = 1.0
    b, r = bands.reshape(2 * w + 1, count, size), rhs.reshape(count, size, -1)
    inner = size - w
    whole = np.zeros((count, size, size + 2 * w))  # rows of a piece; columns: w before it, its own, w after it
    for d in range(-w, w + 1):
        i = np.arange(size)
        whole[:, i, i + w + d] = b[w + d]
    a, left, right = whole[:, :inner, w : w + inner], whole[:, :inner, :w], whole[:, :inner, w + inner : w + size]
    solved = np.linalg.solve(a, np.concatenate([left, right, r[:, :inner]], axis=2))
    x_left, x_right, x_rhs = solved[:, :, :w], solved[:, :, w : 2 * w], solved[:, :, 2 * w :]
    row, own, after = whole[:, inner:, w : w + inner], whole[:, inner:, w + inner : w + size], whole[:, inner:, w + size :]
    diagonal = own - row @ x_right
    before = -(row @ x_left)
    rest = r[:, inner:] - row @ x_rhs
    # the separators of a piece also touch the first w unknowns of the next one
    diagonal[:-1] -= after[:-1] @ x_left[1:, :w]
    further = np.zeros_like(diagonal)
    further[:-1] = -(after[:-1] @ x_right[1:, :w])
    rest[:-1] -= after[:-1] @ x_rhs[1:, :w]
    new_w = 2 * w - 1 if w > 1 else 1
    new = np.zeros((2 * new_w + 1, count * w))
    for i in range(w):
        for j in range(w):
            for shift, block in ((-w, before), (0, diagonal), (w, further)):
                if abs(j + shift - i) <= new_w:
                    new[new_w + j + shift - i, i::w] = block[:, i, j]
    ends = solve_bands(new, rest.reshape(count * w, -1)).reshape(count, w, -1)
    out = np.empty_like(r)
    out[:, inner:] = ends
    previous = np.concatenate([np.zeros_like(ends[:1]), ends[:-1]])
    out[:, :inner] = x_rhs - x_left @ previous - x_right @ ends
    return out.reshape(count * size, -1)[:n]


def reinsch(x: np.ndarray, y: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(bands, right side) of the system for the second derivatives at all points but the first and the last."""
    h = np.diff(x)
    a, b = 1 / h[:-1], 1 / h[1:]
    m = len(x) - 2
    bands = np.zeros((5, m))
    q = np.stack([a, -a - b, b])  # column j of Q has these at points j, j + 1, j + 2
    bands[2] = (h[:-1] + h[1:]) / 3 + lam * (q * q).sum(axis=0)
    if m > 1:
        near = h[1:-1] / 6 + lam * (q[1, :-1] * q[0, 1:] + q[2, :-1] * q[1, 1:])
        bands[3, :-1] = bands[1, 1:] = near
    if m > 2:
        far = lam * q[2, :-2] * q[0, 2:]
        bands[4, :-2] = bands[0, 2:] = far
    return bands, np.diff(np.diff(y) / h)


def second_derivatives(x: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """At all points, zero at both ends."""
    gamma = np.zeros(len(x))
    if len(x) > 2:
        bands, rhs = reinsch(x, y, lam)
        gamma[1:-1] = solve_bands(bands, rhs[:, None])[:, 0]
    return gamma


def _bend_at(x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Q gamma at all points: the jump of the slope of gamma, ends included."""
    slope = np.diff(gamma) / np.diff(x)
    return np.concatenate([slope, [0.0]]) - np.concatenate([[0.0], slope])


def grid(low: float, high: float) -> np.ndarray:
    """Exponents inside a bracket, evenly spaced."""
    return low + (high - low) * np.arange(1, CANDIDATES + 1) / (CANDIDATES + 1)


def narrowed(low: float, high: float, squares: np.ndarray, target: float) -> tuple[float, float]:
    """The bracket around the exponent at which the (growing) sum of squared residuals meets the target."""
    points = np.concatenate([[low], grid(low, high), [high]])
    k = int((np.asarray(squares) < target).sum())
    return float(points[k]), float(points[k + 1])


def smooth_points(x: np.ndarray, y: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, second derivatives, lambda) of the smoothest spline whose squared residuals sum up to `target`; the straight
    line (lambda infinite) if its own do not exceed it."""
    line = np.polyval(np.polyfit(x, y, 1), x) if len(x) > 1 else y.astype(float)
    if ((y - line) ** 2).sum() <= target or len(x) < 3:
        return line, np.zeros(len(x)), float("inf")
    low, high = LOWEST, HIGHEST
    for _ in range(ROUNDS):
        squares = []
        for e in grid(low, high):
            squares.append(10 ** (2 * e) * (_bend_at(x, second_derivatives(x, y, 10**e)) ** 2).sum())
        low, high = narrowed(low, high, np.array(squares), target)
    lam = 10 ** ((low + high) / 2)
    gamma = second_derivatives(x, y, lam)
    return y - lam * _bend_at(x, gamma), gamma, lam


# ---- blocks of a series -------------------------------------------------------------------------------------------------


class Block:
    """The points of one block and of its neighbours, and the system of its own unknowns.

    Unknowns are the second derivatives at the block's own points (but the first and last point of the series); its last two are
    separators unless it is the last block.
    """

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("vpos")
        self.x, self.y, self.vpos = (pdf[c].to_numpy(float if c != "vpos" else np.int64) for c in ("pos", "y", "vpos"))
        mine = np.flatnonzero(pdf["own"].to_numpy(bool))
        n = int(pdf["vn"].iloc[0])
        self.low, self.high = int(mine[0]), int(mine[-1])
        self.first, self.last = self.vpos[self.low] == 0, self.vpos[self.high] == n - 1
        self.own = mine[(self.vpos[mine] > 0) & (self.vpos[mine] < n - 1)]  # places of the unknowns among the points

    def parts(self, lam: float):
        """(columns solved for: left separators, right separators, right side; coupling rows) of the own unknowns."""
        bands, rhs = reinsch(self.x, self.y, lam)  # unknown j of this belongs to point j + 1
        at = self.own - 1
        seps = 0 if self.last else 2
        inner = at[: len(at) - seps]
        b = bands[:, inner].copy()
        sides = np.zeros((len(inner), 4))
        for d in (1, 2):  # what lies outside the inner unknowns moves to the right side
            for i in range(min(d, len(inner))):
                if not self.first:
                    sides[i, 2 + i - d] = bands[2 - d, inner[i]]
                b[2 - d, i] = 0.0
                k = len(inner) - 1 - i
                if seps:
                    sides[k, 2 + d - 1 - i] = bands[2 + d, inner[k]]
                b[2 + d, k] = 0.0
        solved = solve_bands(b, np.column_stack([sides, rhs[inner]])) if len(inner) else np.zeros((0, 5))
        own = np.zeros((2, 2))
        if seps:
            s = at[-2:]
            own = np.array([[bands[2, s[0]], bands[3, s[0]]], [bands[1, s[1]], bands[2, s[1]]]])
        return solved, sides, own, rhs[at[-2:]] if seps else np.zeros(2)

    def summary(self, lam: float) -> np.ndarray:
        """What the block adds to the system of separators: a 4 x 4 matrix and a right side over (left, right) separators."""
        solved, sides, own, rhs = self.parts(lam)
        matrix, right = -sides.T @ solved[:, :4], -sides.T @ solved[:, 4]
        matrix[2:, 2:] += own
        right[2:] += rhs
        return np.concatenate([matrix.ravel(), right])

    def filled(self, lam: float, ends: np.ndarray) -> np.ndarray:
        """Second derivatives at the block's points, given those at the left and right separators; unknown ones of neighbours
        stay zero."""
        solved, *_ = self.parts(lam)
        inner = solved[:, 4] - solved[:, :4] @ ends
        gamma = np.zeros(len(self.x))
        gamma[self.own[: len(inner)]] = inner
        if not self.last:
            gamma[self.own[-2:]] = ends[2:]
        if not self.first:
            gamma[[self.low - 2, self.low - 1]] = ends[:2]
        return gamma

    def answered(self) -> slice:
        """Points whose neighbours' second derivatives the block knows: from the left neighbour's last point on, to the last but
        one of its own."""
        return slice(0 if self.first else self.low - 1, len(self.x) if self.last else self.high)


def separators(rows: list[np.ndarray]) -> np.ndarray:
    """Values at the separators (blocks x 4: left, right) from the summaries of all blocks of a series, in order."""
    k = len(rows)
    ends = np.zeros((k, 4))
    if k > 1:
        m = 2 * (k - 1)
        bands, rhs = np.zeros((7, m)), np.zeros(m)
        for i, row in enumerate(rows):
            matrix, right = row[:16].reshape(4, 4), row[16:]
            for a in range(4):
                for b in range(4):
                    r, c = 2 * (i - 1) + a, 2 * (i - 1) + b
                    if 0 <= r < m and 0 <= c < m:
                        bands[3 + c - r, r] += matrix[a, b]
                r = 2 * (i - 1) + a
                if 0 <= r < m:
                    rhs[r] += right[a]
        found = solve_bands(bands, rhs[:, None])[:, 0].reshape(-1, 2)
        ends[1:, :2], ends[:-1, 2:] = found, found
    return ends


def _points(panel: DataFrame, size: int) -> DataFrame:
    """Valid points numbered without holes, by block, with three points of each neighbour."""
    valid = number_rows(panel.where(F.col("y").isNotNull()).select("series_id", F.col("pos").alias("_p"), "y"), ("_p",))
    cut = halo(valid, 3, 3, size=size).withColumn("own", F.col("_own"))
    return cut.select("series_id", F.col("_p").alias("pos"), F.col("pos").alias("vpos"), F.col("n").alias("vn"), "y", F.col("_blk").alias("b"), "own")


def _long(panel: DataFrame, factor: float, size: int) -> DataFrame:
    """(series_id, pos, y, f, gamma, lam) of series that take several blocks."""
    spark = panel.sparkSession
    points = cut_lineage(spark, _points(panel, size), "points")
    slope = F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0))
    own = points.where("own")
    lines = own.groupBy("series_id").agg(slope.alias("slope"), F.avg("pos").alias("mx"), F.avg("y").alias("my"), F.max("vn").alias("vn"))
    off = F.col("y") - F.col("my") - F.col("slope") * (F.col("pos") - F.col("mx"))
    squares = own.drop("vn").join(lines, "series_id").groupBy("series_id").agg(F.sum(off * off).alias("line"), F.max("vn").alias("vn"))
    target = factor * F.col("vn")
    state = squares.select("series_id", target.alias("target"), F.when(F.col("line") > target, F.lit(LOWEST)).alias("low"), F.when(F.col("line") > target, F.lit(HIGHEST)).alias("high"))
    state = cut_lineage(spark, state, "bracket")

    def reduced(state: DataFrame, exponents) -> tuple[DataFrame, DataFrame]:
        """Points with their exponents, and the separators of each block for each exponent."""
        tried = points.join(F.broadcast(state) if state.count() <= 100_000 else state, "series_id")

        def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
            block = Block(pdf)
            found = [block.summary(10**e) for e in exponents(pdf["low"].iloc[0], pdf["high"].iloc[0])]
            return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "b": [pdf["b"].iloc[0]], "sums": [np.concatenate(found).tolist()]})

        def series(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b")
            sums = np.stack(pdf["sums"].to_list()).reshape(len(pdf), -1, 20)
            ends = np.stack([separators(list(sums[:, e])) for e in range(sums.shape[1])], axis=1)
            return pd.DataFrame({"series_id": pdf["series_id"], "b": pdf["b"], "ends": [v.ravel().tolist() for v in ends]})

        summaries = tried.groupBy("series_id", "b").applyInPandas(blocks, "series_id string, b long, sums array<double>")
        return tried, cut_lineage(spark, summaries.groupBy("series_id").applyInPandas(series, "series_id string, b long, ends array<double>"), "separators")

    def squares_of(pdf: pd.DataFrame) -> pd.DataFrame:
        block, ends = Block(pdf), np.asarray(pdf["ends"].iloc[0]).reshape(-1, 4)
        out = []
        for e, own in zip(grid(pdf["low"].iloc[0], pdf["high"].iloc[0]), ends):
            bent = _bend_at(block.x, block.filled(10**e, own))[block.answered()]
            out.append(10 ** (2 * e) * float((bent**2).sum()))
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "e": range(len(out)), "s": out})

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        low, high = narrowed(first["low"], first["high"], pdf.sort_values("e")["s"].to_numpy(), first["target"])
        return pd.DataFrame({"series_id": [first["series_id"]], "target": [first["target"]], "low": [low], "high": [high]})

    open_ones = state.where("low IS NOT NULL")
    if not open_ones.isEmpty():
        for _ in range(ROUNDS):
            tried, ends = reduced(open_ones, grid)
            sums = tried.join(ends, ["series_id", "b"]).groupBy("series_id", "b").applyInPandas(squares_of, "series_id string, e long, s double")
            sums = sums.groupBy("series_id", "e").agg(F.sum("s").alias("s")).join(open_ones, "series_id")
            open_ones = cut_lineage(spark, sums.groupBy("series_id").applyInPandas(update, "series_id string, target double, low double, high double"), "bracket")
    middle = lambda low, high: [(low + high) / 2]

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        block, own = Block(pdf), np.asarray(pdf["ends"].iloc[0])
        lam = 10 ** ((pdf["low"].iloc[0] + pdf["high"].iloc[0]) / 2)
        gamma, part = block.filled(lam, own), block.answered()
        f = block.y - lam * _bend_at(block.x, gamma)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "pos": block.x[part].astype(np.int64), "f": f[part], "gamma": gamma[part], "lam": lam})

    tried, ends = reduced(open_ones, middle)
    bent = tried.join(ends, ["series_id", "b"]).groupBy("series_id", "b").applyInPandas(values, "series_id string, pos long, f double, gamma double, lam double")
    straight = own.join(state.where("low IS NULL").select("series_id"), "series_id").drop("vn").join(lines, "series_id")
    f = F.col("my") + F.col("slope") * (F.col("pos") - F.col("mx"))
    return bent.unionByName(straight.select("series_id", "pos", f.alias("f"), F.lit(0.0).alias("gamma"), F.lit(float("inf")).alias("lam")))


def smoothing_spline(panel: DataFrame, factor: float = 0.5, size: int | None = None) -> DataFrame:
    """Panel with `fitted`, the natural cubic smoothing spline through the valid points, `residual` and `lam`.

    The spline is the smoothest one whose squared residuals sum up to `factor` times the number of valid points. Holes take the
    cubic between their neighbours, positions beyond the valid points the straight continuation; a series with one valid point is
    constant, one without any stays NULL. Series of up to `size` rows (a block) are solved in one task, longer ones in blocks.
    """
    size = max(size or bl.BLOCK_ROWS, 8)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y"].notna()].sort_values("pos")
        x, y = pdf["pos"].to_numpy(float), pdf["y"].to_numpy(float)
        f, gamma, lam = smooth_points(x, y, factor * len(x)) if len(x) else (x, x, 0.0)
        return pd.DataFrame({"series_id": pdf["series_id"], "pos": pdf["pos"], "f": f, "gamma": gamma, "lam": lam})

    base = panel.select("series_id", "pos", "n", "y")
    found = base.where(F.col("n") <= size).groupBy("series_id").applyInPandas(run, "series_id string, pos long, f double, gamma double, lam double")
    long = base.where(F.col("n") > size)
    if not long.isEmpty():
        found = found.unionByName(_long(long, factor, size))
    marked = panel.join(found, ["series_id", "pos"], "left")
    near = nearest_valid(marked, value="f", carry=["gamma", "lam"])
    ends = found.groupBy("series_id").agg(*[f(F.struct("pos", "f", "gamma"), order).alias(c) for c, f, order in (("_a", F.min_by, "pos"), ("_z", F.max_by, "pos"))])
    inside = found.join(ends, "series_id")
    second = inside.groupBy("series_id").agg(
        F.min_by(F.struct("pos", "f", "gamma"), F.when(F.col("pos") > F.col("_a.pos"), F.col("pos"))).alias("_b"),
        F.max_by(F.struct("pos", "f", "gamma"), F.when(F.col("pos") < F.col("_z.pos"), F.col("pos"))).alias("_y"),
    )
    near = attach(near, ends.join(second, "series_id").join(per_series(panel), "series_id"), how="left")
    x = F.col("pos").cast("double")

    def slope(a: str, b: str, at_first: bool):
        """Slope of the piece from a to b at one of its ends; zero without a second point."""
        h = F.col(f"{b}.pos") - F.col(f"{a}.pos")
        own, other = (F.col(f"{a}.gamma"), F.col(f"{b}.gamma")) if at_first else (F.col(f"{b}.gamma"), F.col(f"{a}.gamma"))
        tilt = (F.col(f"{b}.f") - F.col(f"{a}.f")) / h
        turn = h * (2 * own + other) / 6
        return F.coalesce(tilt - turn if at_first else tilt + turn, F.lit(0.0))

    h = F.col("next_pos") - F.col("prev_pos")
    left, right = (F.col("next_pos") - x) / h, (x - F.col("prev_pos")) / h
    between = left * F.col("prev_y") + right * F.col("next_y") + ((left**3 - left) * F.col("prev_gamma") + (right**3 - right) * F.col("next_gamma")) * h * h / 6
    fitted = (
        F.when(F.col("f").isNotNull(), F.col("f"))
        .when(F.col("prev_pos").isNull(), F.col("_a.f") + slope("_a", "_b", True) * (x - F.col("_a.pos")))
        .when(F.col("next_pos").isNull(), F.col("_z.f") + slope("_y", "_z", False) * (x - F.col("_z.pos")))
        .otherwise(between)
    )
    out = near.withColumns({"fitted": fitted, "lam": F.coalesce("lam", "prev_lam", "next_lam")}).withColumn("residual", F.col("y") - F.col("fitted"))
    return out.drop("f", "gamma", "_a", "_b", "_y", "_z", "prev_pos", "prev_y", "prev_gamma", "prev_lam", "next_pos", "next_y", "next_gamma", "next_lam")
