"""Analyse, recommend, forecast and assemble: a report as a dict of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.registry import MODELS
from tidepanel.operators import analysis as an, explain as ex, selection as sel


def forecast_report(
    panel: DataFrame,
    horizon: int,
    runners: dict[str, Callable[[DataFrame, int], DataFrame]],
    models: Sequence[tuple] = MODELS,
    covariates: DataFrame | None = None,
    strategy: str = "auto",
    max_points: int | None = None,
    candidates: int | None = None,
) -> dict[str, DataFrame]:
    """`analysis`, `recommendation`, `forecast`, `narrative` and `summary`.

    `runners` maps installed models to functions (history, horizon) -> (series_id, step, mean); only these
    are considered. Series whose best candidate fails use their next one, through all installed models or the best
    `candidates`; a series without any result has one forecast row with an error.
    """
    candidates = candidates or len(runners)
    analysis = an.analyze(panel, max_points)
    freq = analysis.select("series_id", "frequency")
    profiles = sel.series_profile(panel, covariates, freq)
    installed = [m for m in models if m[0] in runners]
    ranked = sel.auto_rank(profiles, installed, horizon, strategy).where(F.col("rank") <= candidates)
    forecast = sel.forecast_with_fallback(panel, ranked.select("series_id", "model", "rank"), runners, horizon, range(1, candidates + 1))
    chosen = forecast.where(F.col("model").isNotNull()).select("series_id", "model").distinct()
    return {
        "analysis": analysis,
        "recommendation": ranked.select("series_id", "model", "score", "rank"),
        "forecast": forecast,
        "narrative": ex.analysis_narrative(analysis),
        "summary": ex.overall_narrative(analysis, chosen),
    }
