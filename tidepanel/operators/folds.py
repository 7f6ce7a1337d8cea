"""Hold-outs and walk-forward folds, laid out as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def holdout(panel: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(history without the last `horizon` points, those points as actuals with step and a)."""
    cut = F.col("n") - horizon
    history = panel.where(F.col("pos") < cut).withColumn("n", cut)
    actuals = panel.where(F.col("pos") >= cut).select(
        "series_id", (F.col("pos") - cut + 1).cast("int").alias("step"), "ts", F.col("y").alias("a")
    )
    return history, actuals


def min_train(horizon: int) -> int:
    return max(2 * horizon, 32)


def generate_folds(lengths: DataFrame, horizon: int, num_folds: int = 3, min_train_length: int | None = None) -> DataFrame:
    """Expanding-window folds per series, placed from the end; stops below the minimum training length."""
    floor = min_train_length if min_train_length is not None else min_train(horizon)
    back = F.explode(F.sequence(F.lit(0), F.lit(num_folds - 1)))
    out = lengths.select("series_id", "n", back.alias("i"))
    test_end = F.col("n") - F.col("i") * horizon
    return (
        out.withColumn("test_end", test_end)
        .withColumn("test_start", F.col("test_end") - horizon)
        .where((F.col("test_start") >= floor) & (F.col("test_start") >= 0))
        .select(
            "series_id",
            (F.lit(num_folds - 1) - F.col("i")).cast("int").alias("fold"),
            F.col("test_start").alias("train_end"),
            "test_start",
            "test_end",
        )
    )


def fold_rows(panel: DataFrame, horizon: int, num_folds: int = 3, min_train_length: int | None = None) -> DataFrame:
    """Panel rows repeated per fold with role `train` or `test`.

    The fold bounds follow from `n`, which every row carries, so no join is needed.
    """
    floor = min_train_length if min_train_length is not None else min_train(horizon)
    folds = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(num_folds - 1)),
            lambda i: F.struct(
                (F.lit(num_folds - 1) - i).alias("fold"),
                (F.col("n") - (i + 1) * horizon).alias("train_end"),
            ),
        ),
        lambda f: (f.train_end >= floor) & (f.train_end >= 0) & (F.col("pos") < f.train_end + horizon),
    )
    out = panel.select("*", F.explode(folds).alias("_f"))
    return out.select(
        F.col("_f.fold").alias("fold"),
        *panel.columns,
        F.col("_f.train_end").alias("train_end"),
        F.when(F.col("pos") < F.col("_f.train_end"), "train").otherwise("test").alias("role"),
    )


def fold_history(rows: DataFrame) -> DataFrame:
    """Training part; `n` becomes the fold's own length."""
    return rows.where(F.col("role") == "train").withColumn("n", F.col("train_end")).drop("role", "train_end")


def fold_actuals(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("role") == "test").select(
        "fold", "series_id", (F.col("pos") - F.col("train_end") + 1).cast("int").alias("step"), F.col("y").alias("a")
    )
