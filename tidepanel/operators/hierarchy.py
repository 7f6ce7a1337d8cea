"""Hierarchies as edge tables (hierarchy_id, parent, child) and reconciliation of forecasts over them.

An edge table holds many hierarchies side by side; forecasts carry hierarchy_id, series_id, step, mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidepanel.session import cut_lineage

H = "hierarchy_id"


def nodes(edges: DataFrame) -> DataFrame:
    """(hierarchy_id, series_id, is_root, is_leaf)."""
    ends = edges.select(H, F.explode(F.array(F.struct(F.col("parent").alias("s"), F.lit(1).alias("p"), F.lit(0).alias("c")), F.struct(F.col("child").alias("s"), F.lit(0).alias("p"), F.lit(1).alias("c")))).alias("e"))
    per = ends.groupBy(H, F.col("e.s").alias("series_id")).agg(F.max("e.p").alias("p"), F.max("e.c").alias("c"))
    return per.select(H, "series_id", (F.col("c") == 0).alias("is_root"), (F.col("p") == 0).alias("is_leaf"))


def cycle_members(edges: DataFrame) -> DataFrame:
    """(hierarchy_id, series_id, reason): members on a cycle or above one. Hierarchies with such members are not reconciled.

    Edges to members without children are taken away, round by round, until none is left or none goes any more.
    """
    spark = edges.sparkSession
    live = cut_lineage(spark, edges.select(H, "parent", "child").distinct(), "edges")
    count = live.count()
    while count:
        inner = live.join(live.select(H, F.col("parent").alias("child")).distinct(), [H, "child"], "left_semi")
        inner = cut_lineage(spark, inner.select(H, "parent", "child"), "edges")
        left = inner.count()
        if left == count:
            break
        live, count = inner, left
    return live.select(H, F.col("parent").alias("series_id")).distinct().withColumn("reason", F.lit("member is on or above a cycle")).where(F.lit(count > 0))


def acyclic(edges: DataFrame) -> DataFrame:
    """Edges of the hierarchies without a cycle."""
    return edges.join(cycle_members(edges).select(H).distinct(), H, "left_anti")


def levels(edges: DataFrame, checked: bool = False) -> DataFrame:
    """(hierarchy_id, series_id, depth): breadth-first depth below the root, down to the deepest member.

    Hierarchies with cycles are left out (`checked` skips the search for them).
    """
    edges = edges if checked else acyclic(edges)
    found = nodes(edges).where("is_root").select(H, "series_id", F.lit(0).alias("depth"))
    front, depth = found, 0
    while True:
        depth += 1
        front = front.select(H, F.col("series_id").alias("parent")).join(edges, [H, "parent"]).select(
            H, F.col("child").alias("series_id"), F.lit(depth).alias("depth")
        )
        front = cut_lineage(edges.sparkSession, front.distinct(), f"level-{depth}")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.groupBy(H, "series_id").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame, weight: str | None = None, checked: bool = False) -> DataFrame:
    """(hierarchy_id, ancestor, leaf, k): the summing matrix as rows.

    k counts the paths; with `weight`, it adds up the products of that edge column along the paths.
    One join per level, each written once so the plan does not grow with depth. Hierarchies with cycles
    are left out (`checked` skips the search for them).
    """
    edges = edges if checked else acyclic(edges)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(H, F.col("parent"), F.col("child"), w.alias("w"))
    leaves = nodes(edges).where("is_leaf").select(H, F.col("series_id").alias("leaf"))
    paths = e.select(H, F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.col("w").alias("k"))
    found = leaves.select(H, F.col("leaf").alias("ancestor"), "leaf", F.lit(1.0).alias("k"))
    depth = 0
    while True:
        depth += 1
        found = found.unionByName(paths.join(leaves, (paths[H] == leaves[H]) & (paths["node"] == leaves["leaf"])).select(paths[H], "ancestor", "leaf", "k"))
        step = paths.join(e.withColumnRenamed("parent", "node"), [H, "node"])
        paths = step.groupBy(H, "ancestor", F.col("child").alias("node")).agg(F.sum(F.col("k") * F.col("w")).alias("k"))
        paths = cut_lineage(edges.sparkSession, paths, f"closure-{depth}")
        if paths.isEmpty():
            break
    return cut_lineage(edges.sparkSession, found.groupBy(H, "ancestor", "leaf").agg(F.sum("k").alias("k")), "closure")


def missing_leaves(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """Leaves without any forecast."""
    want = nodes(edges).where("is_leaf").select(H, "series_id")
    return want.join(forecast.select(H, "series_id").distinct(), [H, "series_id"], "left_anti")


def missing_members(edges: DataFrame, present: DataFrame) -> DataFrame:
    """Members of the hierarchy that are not among the present series."""
    return nodes(edges).select(H, "series_id").join(present.select(H, "series_id").distinct(), [H, "series_id"], "left_anti")


def outsiders(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast rows of series outside the hierarchy (passed through unchanged)."""
    return forecast.join(nodes(edges).select(H, "series_id"), [H, "series_id"], "left_anti")


def with_outsiders(edges: DataFrame, reconciled: DataFrame, forecast: DataFrame) -> DataFrame:
    return reconciled.unionByName(outsiders(edges, forecast).select(H, "series_id", "step", "mean"))


def _aggregate(paths: DataFrame, leaf_forecast: DataFrame) -> DataFrame:
    lf = leaf_forecast.select(H, F.col("series_id").alias("leaf"), "step", "mean")
    return paths.join(lf, [H, "leaf"]).groupBy(H, F.col("ancestor").alias("series_id"), "step").agg(F.sum(F.col("k") * F.col("mean")).alias("mean"))


def bottom_up(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """Leaf forecasts summed up to every node."""
    return _aggregate(closure(edges), forecast)


def shares(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """Edges with `share`: mean(child) / mean(parent) over the horizon, uniform where the parent is about 0."""
    m = forecast.groupBy(H, "series_id").agg(F.avg("mean").alias("m"))
    kids = edges.groupBy(H, "parent").agg(F.count(F.lit(1)).alias("kids"))
    out = edges.join(m.withColumnsRenamed({"series_id": "parent", "m": "pm"}), [H, "parent"], "left")
    out = out.join(m.withColumnsRenamed({"series_id": "child", "m": "cm"}), [H, "child"], "left").join(kids, [H, "parent"])
    share = F.when(F.abs(F.coalesce("pm", F.lit(0.0))) < 1e-12, 1 / F.col("kids")).otherwise(F.coalesce(F.col("cm") / F.col("pm"), F.lit(0.0)))
    return out.select(H, "parent", "child", share.alias("share"))


def top_down(edges: DataFrame, forecast: DataFrame, proportions: DataFrame | None = None, direct_parent: bool = False) -> DataFrame:
    """Root forecasts split to leaves and summed up again.

    By default leaf proportions are the shares multiplied along the path; `direct_parent` uses only the
    share of the leaf in its parent. `proportions` (hierarchy_id, series_id, share) overrides both.
    """
    edges = acyclic(edges)
    roots = nodes(edges).where("is_root").select(H, F.col("series_id").alias("ancestor"))
    paths = closure(edges, checked=True)
    sh = shares(edges, forecast)
    if proportions is not None or direct_parent:
        p = proportions if proportions is not None else sh.select(H, F.col("child").alias("series_id"), "share")
        reach = paths.join(roots, [H, "ancestor"]).join(p.withColumnRenamed("series_id", "leaf"), [H, "leaf"]).drop("k").withColumnRenamed("share", "k")
    else:
        reach = closure(sh, "share", checked=True).join(roots, [H, "ancestor"])
    top = forecast.select(H, F.col("series_id").alias("ancestor"), "step", "mean")
    leaf = reach.join(top, [H, "ancestor"]).groupBy(H, F.col("leaf").alias("series_id"), "step").agg(F.sum(F.col("k") * F.col("mean")).alias("mean"))
    return _aggregate(paths, leaf)


def shrunk_weight(inner: np.ndarray, variances_squared: float) -> float:
    """Weight of the diagonal in the shrunk covariance, from the inner products between steps of the centred residuals and the
    sum of the members' squared variances.

    The squared error of the sample covariance S around its one-step estimates c cT is expanded into sums that never
    build S: |c|^4 - 2 cT S c + |S|^2.
    """
    steps = len(inner)
    s_norm = float((inner**2).sum()) / (steps - 1) ** 2
    quadratic = float((inner**2).sum()) / (steps - 1)
    noise = float((np.diag(inner) ** 2).sum()) - 2 * quadratic + steps * s_norm
    spread = s_norm - variances_squared
    return min(max(noise / (spread * steps), 0.0), 1.0) if spread >= 1e-12 else 0.0


def shrinkage(centred: np.ndarray) -> tuple[float, np.ndarray]:
    """(weight of the diagonal, sample variances) of residuals with one row per member and one column per step."""
    variances = (centred**2).sum(axis=1) / (centred.shape[1] - 1)
    return shrunk_weight(centred.T @ centred, float((variances**2).sum())), variances


def _weighted(s: np.ndarray, residuals: np.ndarray, ridge: float = 1e-8) -> np.ndarray:
    """Sᵀ W⁻¹ for the shrunk covariance W, a diagonal plus a matrix of rank `steps` (Woodbury's identity)."""
    centred = residuals - residuals.mean(axis=1, keepdims=True)
    weight, variances = shrinkage(centred)
    diagonal = weight * variances + ridge
    low = centred * np.sqrt((1 - weight) / (centred.shape[1] - 1))
    scaled = s.T / diagonal
    core = np.eye(low.shape[1]) + low.T @ (low / diagonal[:, None])
    return scaled - (scaled @ low) @ np.linalg.solve(core, low.T / diagonal)


def _solve(method: str):
    def run(paths: pd.DataFrame, fc: pd.DataFrame) -> pd.DataFrame:
        cols = [H, "series_id", "step", "mean"]
        if paths.empty or fc.empty:
            return pd.DataFrame(columns=cols)
        s = paths.pivot_table(index="ancestor", columns="leaf", values="k", fill_value=0.0)
        y = fc.pivot_table(index="series_id", columns="step", values="mean").reindex(s.index).fillna(0.0)
        sm, ym = s.to_numpy(float), y.to_numpy(float)
        if method == "ols" or ym.shape[1] < 2:
            left = sm.T
        else:
            left = _weighted(sm, ym - sm @ y.loc[s.columns].to_numpy(float))
        out = pd.DataFrame(sm @ np.linalg.solve(left @ sm, left @ ym), index=s.index, columns=y.columns).stack().reset_index()
        out.columns = ["series_id", "step", "mean"]
        out[H] = paths[H].iloc[0]
        return out[cols]

    return run


def is_tree(edges: DataFrame) -> bool:
    """True where every member has at most one parent."""
    return edges.groupBy(H, "child").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()


def tree_least_squares(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """The least-squares projection of a tree, level by level, for hierarchies of any size. Rows may carry a `precision`.

    Upwards every node gets the precision `a` and best value `m` of its total given its subtree: its own and the
    forecast for a leaf; otherwise the children add up (means M, variances V = sum 1 / a) and the node's own
    forecast counts with its precision (1 without one). Downwards the gap between a node and its children's sum M is shared in
    proportion to 1 / a. One join per level in each direction.
    """
    spark, edges = edges.sparkSession, acyclic(edges)
    lev = cut_lineage(spark, levels(edges, checked=True).join(nodes(edges).select(H, "series_id", "is_leaf"), [H, "series_id"]), "tree-levels")
    steps = forecast.select(H, "step").distinct()
    own = F.col("precision") if "precision" in forecast.columns else F.lit(1.0)
    base = lev.join(steps, H).join(forecast.select(H, "series_id", "step", "mean", own.alias("p")), [H, "series_id", "step"], "left")
    base = cut_lineage(spark, base.withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "p": F.coalesce("p", F.lit(1.0))}), "tree-base")
    deepest = lev.agg(F.max("depth")).first()[0]
    parent = edges.select(H, "parent", F.col("child").alias("series_id"))
    up: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):
        here = base.where(F.col("depth") == d)
        if d == deepest:
            level = here.select(H, "series_id", "step", F.col("p").alias("a"), F.col("mean").alias("m"), F.lit(None).cast("double").alias("kid_mean"), F.lit(None).cast("double").alias("kid_var"))
        else:
            kids = up[d + 1].join(parent, [H, "series_id"]).groupBy(H, F.col("parent").alias("series_id"), "step").agg(F.sum("m").alias("kid_mean"), F.sum(1 / F.col("a")).alias("kid_var"))
            j = here.join(kids, [H, "series_id", "step"], "left")
            a = F.when(F.col("is_leaf"), F.col("p")).otherwise(F.col("p") + 1 / F.col("kid_var"))
            m = F.when(F.col("is_leaf"), F.col("mean")).otherwise((F.col("p") * F.col("mean") + F.col("kid_mean") / F.col("kid_var")) / a)
            level = j.select(H, "series_id", "step", a.alias("a"), m.alias("m"), "kid_mean", "kid_var")
        up[d] = cut_lineage(spark, level, f"tree-up-{d}")
    done = up[0].select(H, "series_id", "step", F.col("m").alias("mean"), "kid_mean", "kid_var")
    out = done.select(H, "series_id", "step", "mean")
    for d in range(1, deepest + 1):
        above = done.select(H, F.col("series_id").alias("parent"), "step", F.col("mean").alias("pt"), F.col("kid_mean").alias("pM"), F.col("kid_var").alias("pV"))
        level = up[d].join(parent, [H, "series_id"]).join(above, [H, "parent", "step"])
        value = F.col("m") + (1 / F.col("a")) / F.col("pV") * (F.col("pt") - F.col("pM"))
        done = cut_lineage(spark, level.select(H, "series_id", "step", value.alias("mean"), "kid_mean", "kid_var"), f"tree-down-{d}")
        out = out.unionByName(done.select(H, "series_id", "step", "mean"))
    return out


def level_sums(edges: DataFrame, forecast: DataFrame) -> DataFrame:
    """Leaf forecasts of a tree summed up to every node (hierarchy_id, series_id, step, mean), one join per level."""
    spark = edges.sparkSession
    leaf = nodes(edges).where("is_leaf").select(H, "series_id")
    placed = levels(edges, checked=True).join(leaf.withColumn("is_leaf", F.lit(True)), [H, "series_id"], "left")
    base = cut_lineage(spark, placed.where("is_leaf").join(forecast.select(H, "series_id", "step", "mean"), [H, "series_id"]), "leaves")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    parent = edges.select(H, "parent", F.col("child").alias("series_id"))
    cols = [H, "series_id", "step", "mean"]
    out = here = base.where(F.col("depth") == deepest).select(*cols)
    for d in range(deepest - 1, -1, -1):
        sums = here.join(parent, [H, "series_id"]).groupBy(H, F.col("parent").alias("series_id"), "step").agg(F.sum("mean").alias("mean"))
        here = cut_lineage(spark, sums.select(*cols).unionByName(base.where(F.col("depth") == d).select(*cols)), f"sums-{d}")
        out = out.unionByName(here)
    return out


def _added(parts: DataFrame, *columns: str) -> DataFrame:
    """Arrays of equal length per hierarchy, added up element by element."""
    out = None
    for c in columns:
        one = parts.select(H, F.posexplode(c).alias("i", "v")).groupBy(H, "i").agg(F.sum("v").alias("v"))
        one = one.groupBy(H).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e")).select(H, F.transform("e", lambda e: e["v"]).alias(c))
        out = one if out is None else out.join(one, H)
    return out


def _partial(work):
    """One row of partial sums per batch and hierarchy: work(rows) gives arrays by name."""

    def run(batches):
        for pdf in batches:
            rows = []
            for h, own in pdf.groupby(H, sort=False):
                rows.append({H: h, **{k: np.asarray(v, float).ravel().tolist() for k, v in work(own).items()}})
            if rows:
                yield pd.DataFrame(rows)

    return run


def _stack(own: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in own[column]])


def tree_minimum_trace(edges: DataFrame, forecast: DataFrame, ridge: float = 1e-8) -> DataFrame:
    """The shrinkage minimum-trace projection of trees of any size.

    The shrunk covariance is a diagonal D plus U U' of rank `steps`, so by Woodbury's identity the projection is the tree's least
    squares with precisions 1 / D, of the forecasts y and of the columns of U (Û), corrected by a small matrix Z:
    y_D + Û Z, Z = -C^-1 q + (C - G)^-1 (r - G C^-1 q), with C = I + U'D^-1 U, G = U'D^-1 Û, q = U'D^-1 y and r = Û'D^-1 y.
    Only sums over members of steps x steps numbers are gathered per hierarchy.
    """
    spark, edges = edges.sparkSession, acyclic(edges)
    member = nodes(edges).select(H, "series_id")
    steps = forecast.join(member, [H, "series_id"], "left_semi").select(H, "step").distinct()
    grid = member.join(steps, H).join(forecast.select(H, "series_id", "step", "mean"), [H, "series_id", "step"], "left")
    grid = cut_lineage(spark, grid.withColumn("mean", F.coalesce("mean", F.lit(0.0))), "members")
    totals = level_sums(edges, grid).withColumnRenamed("mean", "total")
    rest = grid.join(totals, [H, "series_id", "step"]).withColumn("r", F.col("mean") - F.col("total"))
    packed = rest.groupBy(H, "series_id").agg(F.array_sort(F.collect_list(F.struct("step", "mean", "r"))).alias("e"), F.avg("r").alias("m"))
    arrays = packed.select(
        H, "series_id", F.transform("e", lambda e: e["step"]).alias("steps"), F.transform("e", lambda e: e["mean"]).alias("y"),
        F.transform("e", lambda e: e["r"] - F.col("m")).alias("c"),
    )
    arrays = cut_lineage(spark, arrays, "residuals")

    def inner(own):
        c = _stack(own, "c")
        return {"gram": c.T @ c, "square": [((c**2).sum(axis=1) ** 2).sum()]}

    sums = _added(arrays.select(H, "c").mapInPandas(_partial(inner), f"{H} string, gram array<double>, square array<double>"), "gram", "square")

    def weights(batches):
        for pdf in batches:
            found = []
            for gram, square in zip(pdf["gram"], pdf["square"]):
                n = int(round(np.sqrt(len(gram))))
                found.append(shrunk_weight(np.asarray(gram, float).reshape(n, n), float(square[0]) / max(n - 1, 1) ** 2) if n > 1 else None)
            yield pd.DataFrame({H: pdf[H], "w": pd.array(found, dtype="Float64")})

    shrink = cut_lineage(spark, sums.mapInPandas(weights, f"{H} string, w double"), "shrinkage")
    n = F.size("c")
    variance = F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x) / (n - 1)
    scale = F.sqrt((1 - F.col("w")) / (n - 1))
    # without two steps there is no covariance: plain least squares
    plain = F.col("w").isNull()
    state = arrays.join(shrink, H).select(
        H, "series_id", "steps", "y", F.when(plain, F.lit(1.0)).otherwise(1 / (F.col("w") * variance + ridge)).alias("precision"),
        F.when(plain, F.transform("c", lambda x: F.lit(0.0))).otherwise(F.transform("c", lambda x: x * scale)).alias("u"),
    )
    state = cut_lineage(spark, state, "state")
    each = state.select(H, "series_id", "precision", F.explode(F.arrays_zip("steps", "y", "u")).alias("e"))
    ys = each.select(H, "series_id", F.struct(F.lit(0).alias("kind"), F.col("e.steps").alias("s")).alias("step"), F.col("e.y").alias("mean"), "precision")
    us = each.select(H, "series_id", F.struct(F.lit(1).alias("kind"), F.col("e.steps").alias("s")).alias("step"), F.col("e.u").alias("mean"), "precision")
    fitted = tree_least_squares(edges, ys.unionByName(us))
    both = fitted.groupBy(H, "series_id").agg(F.array_sort(F.collect_list(F.struct("step", "mean"))).alias("f"))
    first = lambda kind: F.transform(F.filter("f", lambda e: e["step"]["kind"] == kind), lambda e: e["mean"])
    full = cut_lineage(spark, state.join(both, [H, "series_id"]).select(H, "series_id", "steps", "y", "precision", "u", first(0).alias("yd"), first(1).alias("ud")), "fitted")

    def products(own):
        p = own["precision"].to_numpy(float)[:, None]
        u, ud, y = _stack(own, "u"), _stack(own, "ud"), _stack(own, "y")
        return {"c": u.T @ (p * u), "g": u.T @ (p * ud), "q": u.T @ (p * y), "r": ud.T @ (p * y)}

    names = ("c", "g", "q", "r")
    ddl = f"{H} string, " + ", ".join(f"{k} array<double>" for k in names)
    small = _added(full.mapInPandas(_partial(products), ddl), *names)

    def corrections(batches):
        for pdf in batches:
            out = []
            for c, g, q, r in zip(*(pdf[k] for k in names)):
                t = int(round(np.sqrt(len(c))))
                c, g, q, r = (np.asarray(x, float).reshape(t, t) for x in (c, g, q, r))
                c = np.eye(t) + c
                cq = np.linalg.solve(c, q)
                z = -cq + np.linalg.solve(c - (g + g.T) / 2, r - g @ cq)
                out.append(z.tolist())
            yield pd.DataFrame({H: pdf[H], "z": out})

    z = small.mapInPandas(corrections, f"{H} string, z array<array<double>>")
    row = full.join(z, H).select(H, "series_id", "ud", "z", F.explode(F.arrays_zip("steps", "yd", F.sequence(F.lit(0), F.size("steps") - 1).alias("k"))).alias("e"))
    moved = F.aggregate(F.zip_with("ud", "z", lambda a, b: a * F.get(b, F.col("e.k"))), F.lit(0.0), lambda a, x: a + x)
    return row.select(H, "series_id", F.col("e.steps").alias("step"), (F.col("e.yd") + moved).alias("mean"))


def dense_projection(edges: DataFrame, forecast: DataFrame, method: str) -> DataFrame:
    """Projection by one dense solve per hierarchy; hierarchies are solved in parallel."""
    member = nodes(edges).select(H, "series_id")
    fc = forecast.join(member, [H, "series_id"]).select(H, "series_id", "step", "mean")
    return (
        closure(edges).groupBy(H).cogroup(fc.groupBy(H)).applyInPandas(
            _solve(method), f"{H} string, series_id string, step int, mean double"
        )
    )


def optimal(edges: DataFrame, forecast: DataFrame, method: str = "ols") -> DataFrame:
    """Least-squares (`ols`) or shrinkage minimum-trace (`mint_shrink`) projection.

    Trees are solved level by level; members with several parents need a dense solve of the size of one hierarchy.
    """
    if is_tree(edges):
        member = nodes(edges).select(H, "series_id")
        known = forecast.join(member, [H, "series_id"], "left_semi")
        return tree_least_squares(edges, known) if method == "ols" else tree_minimum_trace(edges, known)
    return dense_projection(edges, forecast, method)


def reconcile(edges: DataFrame, forecast: DataFrame, method: str = "bottom_up", **kw) -> DataFrame:
    """Reconciled forecasts of all members, plus outsiders unchanged. Quantiles are not carried over."""
    run = {"bottom_up": bottom_up, "top_down": top_down}.get(method)
    out = run(edges, forecast, **kw) if run else optimal(edges, forecast, method)
    return with_outsiders(edges, out, forecast)


def coherency(edges: DataFrame, forecast: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(hierarchy_id, parent, problem, steps, max_diff): missing members, length mismatches, unequal sums."""
    size = forecast.groupBy(H, "series_id").agg(F.count(F.lit(1)).alias("len"))
    lens = edges.join(size.withColumnsRenamed({"series_id": "parent", "len": "pl"}), [H, "parent"], "left").join(
        size.withColumnsRenamed({"series_id": "child", "len": "cl"}), [H, "child"], "left"
    )
    flags = lens.groupBy(H, "parent").agg(
        F.max(F.col("pl").isNull().cast("int")).alias("no_parent"),
        F.max(F.col("cl").isNull().cast("int")).alias("no_child"),
        F.max((F.col("pl") != F.col("cl")).cast("int")).alias("lengths"),
    )
    f = forecast.select(H, "series_id", "step", "mean")
    kids = edges.join(f.withColumnRenamed("series_id", "child"), [H, "child"]).groupBy(H, "parent", "step").agg(F.sum("mean").alias("s"))
    gap = f.withColumnRenamed("series_id", "parent").join(kids, [H, "parent", "step"]).withColumn("d", F.abs(F.col("mean") - F.col("s")))
    off = gap.where(F.col("d") > tolerance).groupBy(H, "parent").agg(F.count(F.lit(1)).alias("steps"), F.max("d").alias("max_diff"))
    out = flags.join(off, [H, "parent"], "left")
    problem = (
        F.when(F.col("no_parent") == 1, "parent missing")
        .when(F.col("no_child") == 1, "children missing")
        .when(F.col("lengths") == 1, "horizon mismatch")
        .when(F.col("steps") > 0, "parent differs from the sum of its children")
    )
    return out.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        H, "parent", "problem", F.coalesce("steps", F.lit(0)).alias("steps"), "max_diff"
    )
