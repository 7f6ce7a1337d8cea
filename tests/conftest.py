import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepanel.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", shuffle=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def panel(spark):
    """Build a panel from {series: values}, daily from 2024-01-01 (or at the given stamps)."""

    def build(series, step=timedelta(days=1), start=datetime(2024, 1, 1), stamps=None):
        rows = []
        for sid, values in series.items():
            at = stamps[sid] if stamps else [start + step * i for i in range(len(values))]
            for i, (t, v) in enumerate(zip(at, values)):
                rows.append((sid, t, i, len(values), None if v is None else float(v)))
        return spark.createDataFrame(rows, "series_id string, ts timestamp, pos long, n long, y double")

    return build


@pytest.fixture
def values_of():
    def read(df, column, key="pos", series="series_id"):
        out = {}
        for r in df.collect():
            out.setdefault(r[series], {})[r[key]] = r[column]
        return {s: [v[k] for k in sorted(v)] for s, v in out.items()}

    return read
