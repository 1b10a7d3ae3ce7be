from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from climspark.session import get_session  # noqa: E402

MEAN_MODEL = {"n_estimators": 1, "max_depth": 0, "bootstrap": False, "random_state": 42}


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_network(ids=(1, 2, 3), days=60, first=dt.date(2000, 1, 1), skip=0) -> pd.DataFrame:
    """Stations along a bent line that goes south-west, with rain in eleven steps.

    With ``skip``, each station misses every ``skip``-th day, at a phase of its own.
    """
    rows = []
    for s in ids:
        place = (30 - 1.5 * s, -90 - s * s / 4, 300.0 + 120 * (s % 5))
        for i in range(days):
            if not skip or (i + s) % skip:
                rows.append((s, first + dt.timedelta(days=i), *place, s + (7 * s + 3 * i) % 11 / 2))
    return pd.DataFrame(rows, columns=["station", "date", "latitude", "longitude", "altitude", "prec"])


@pytest.fixture(scope="session")
def network(spark):
    return spark.createDataFrame(make_network())


@pytest.fixture(scope="session")
def sparse(spark):
    """Six observations of three stations, one of them without a value; means are easily taken by hand."""
    day = lambda n: dt.date(1999, 12, 30) + dt.timedelta(days=n)
    rows = [
        (4, day(0), 10.0, 50.0, 0.0, 2.0), (4, day(1), 10.0, 50.0, 0.0, None), (4, day(2), 10.0, 50.0, 0.0, 6.0),
        (5, day(1), 11.0, 50.0, 7.0, 1.0), (5, day(40), 11.0, 50.0, 7.0, 3.0), (6, day(9), 19.0, 51.0, 9.0, 11.0),
    ]
    return spark.createDataFrame(
        rows, "station long, date date, latitude double, longitude double, altitude double, prec double"
    )


@pytest.fixture()
def pairs_pdf():
    """Gappy pairs of three stations: whole months and one whole year are empty."""
    rng = np.random.default_rng(3)
    rows = []
    for s in (1, 2, 3):
        for day in pd.date_range("1999-11-15", "2003-02-10"):
            gap = (day.year == 2001 and s == 2) or (day.month in (4, 5) and s == 1)
            if not gap and rng.random() < 0.5:
                y = round(float(rng.gamma(2, 3)), 1)
                rows.append((s, day.date(), y, y + float(rng.normal())))
    return pd.DataFrame(rows, columns=["station", "date", "y_true", "y_pred"])
