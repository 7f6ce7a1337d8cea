"""Model capability table used by recommendation and selection."""

from __future__ import annotations

from typing import NamedTuple

COLUMNS = (
    "name string, family string, license string, needs_acceptance boolean, max_horizon int, forecast_ready boolean,"
    " past_num boolean, past_cat boolean, fut_num boolean, fut_cat boolean, static boolean"
)


class Model(NamedTuple):
    """One model: licence, horizon limit and the covariates it takes."""

    name: str
    family: str
    license: str
    needs_acceptance: bool = False
    max_horizon: int | None = None
    forecast_ready: bool = True
    past_num: bool = False
    past_cat: bool = False
    fut_num: bool = False
    fut_cat: bool = False
    static: bool = False


# Published forecasting models with their licence, horizon limit and covariate support (fixed values).
MODELS = [
    Model("mock", "mock", "mit"),
    Model("chronos2", "torch", "apache-2.0", past_num=True, past_cat=True, fut_num=True, fut_cat=True),
    Model("timesfm-2.5-200m", "timesfm", "apache-2.0", max_horizon=256, past_num=True, fut_num=True),
    Model("moirai-2.0-R-small", "uni2ts", "cc-by-nc-4.0", needs_acceptance=True, past_num=True, fut_num=True),
    Model("sundial-base-128m", "sundial", "apache-2.0", max_horizon=720),
    Model("toto-open-base-1.0", "toto", "apache-2.0", max_horizon=720, past_num=True),
    Model("granite-ttm-r2", "torch", "apache-2.0", max_horizon=96, past_num=True, fut_num=True),
    Model("lag-llama", "lag_llama", "apache-2.0"),
    Model("patchtst", "patchtst", "apache-2.0"),
    Model("tide", "tide", "apache-2.0"),
    Model("nhits", "nhits", "apache-2.0", past_num=True, fut_num=True, static=True),
    Model("nbeatsx", "nbeatsx", "apache-2.0", past_num=True, fut_num=True, static=True),
    Model("timer-base", "timer", "apache-2.0", max_horizon=720),
    Model("timemixer-base", "timemixer", "apache-2.0", max_horizon=720, forecast_ready=False),
    Model("forecastpfn", "forecastpfn", "apache-2.0", max_horizon=300, forecast_ready=False),
]
# Bonus points per model family for speed and for accuracy (fixed values).
SPEED = {
    "mock": 80.0, "timesfm": 45.0, "torch": 25.0, "uni2ts": 18.0, "sundial": 16.0, "toto": 14.0, "timer": 15.0,
    "timemixer": 17.0, "forecastpfn": 50.0,
}
ACCURACY = {
    "mock": -60.0, "timesfm": 14.0, "torch": 20.0, "uni2ts": 24.0, "sundial": 12.0, "toto": 22.0, "timer": 18.0,
    "timemixer": 20.0, "forecastpfn": 10.0,
}
LEARNED_SCALE = 30.0  # a learned weight of 1 is worth this many points

