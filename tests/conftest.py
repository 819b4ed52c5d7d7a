from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockloom.session import build_session, clear_scratch  # noqa: E402
from stockloom.sources.sales import SALES_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)


def sales_rows(product_id, quantities, category="fever", start=date(2022, 1, 1), price=2.5, lead=3):
    """One row per day for a product."""
    rows = []
    for i, quantity in enumerate(quantities):
        day = start + timedelta(days=i)
        rows.append((
            day.isoformat(), "STORE_001", product_id, f"name {product_id}", category, "Winter", int(quantity),
            price, round(int(quantity) * price, 2), 50, lead, 0, 0,
        ))
    return rows


@pytest.fixture(scope="session")
def make_sales(spark):
    """Sales of {product: quantities}."""
    def make(series, **options):
        rows = [row for product, values in series.items() for row in sales_rows(product, values, **options)]
        return spark.createDataFrame(rows, SALES_SCHEMA)

    return make
