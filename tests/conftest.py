import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfwise.schema import RETAIL_CALENDAR as CAL  # noqa: E402
from shelfwise.session import build_session  # noqa: E402
from shelfwise.sources.tables import with_week_index  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def day(week: int, offset: int = 0) -> dt.date:
    return CAL.week_bounds(week)[0] + dt.timedelta(days=offset)


@pytest.fixture(scope="session")
def make_tx(spark):
    """Transactions from (customer, article, week, price, channel) rows on the first day of the week."""

    def make(rows):
        data = [(day(w), c, a, float(p), int(ch)) for c, a, w, p, ch in rows]
        df = spark.createDataFrame(data, "t_dat date, customer_idx int, article_idx int, price double, sales_channel_id int")
        return with_week_index(df, CAL)

    return make
