import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.schema import COST_ITEM_SCHEMA
from ledgerloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__sql__warehouse__dir=root / "warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MAY, APRIL = dt.date(2025, 5, 1), dt.date(2025, 4, 1)

SHORT = {
    "period": "bill_billing_period_start_date",
    "used": "line_item_usage_start_date",
    "service": "line_item_product_code",
    "type": "line_item_line_item_type",
    "usage_type": "line_item_usage_type",
    "instance": "product_instance_type",
    "resource": "line_item_resource_id",
    "region": "product_region_code",
    "operation": "line_item_operation",
    "cost": "line_item_unblended_cost",
    "amount": "line_item_usage_amount",
    "reservation": "reservation_reservation_a_r_n",
    "reservation_cost": "reservation_effective_cost",
    "unused_upfront": "reservation_unused_amortized_upfront_fee_for_billing_period",
    "unused_recurring": "reservation_unused_recurring_fee",
    "plan": "savings_plan_savings_plan_a_r_n",
    "plan_cost": "savings_plan_savings_plan_effective_cost",
    "tags": "resource_tags",
    "product": "product",
}

DEFAULTS = {
    "period": MAY,
    "used": dt.datetime(2025, 5, 2),
    "service": "compute",
    "type": "Usage",
    "usage_type": "box",
    "instance": "m1",
    "resource": "r1",
    "region": "north",
    "operation": "run",
    "cost": "1",
    "amount": "1",
    "reservation": "",
    "plan": "",
    "tags": {},
    "product": {"product_name": "Box", "instance_type": "m1", "region": "north"},
}


@pytest.fixture(scope="session")
def make_items(spark):
    """Cost items from dicts of short names; missing ones get defaults."""
    money = {f.name for f in COST_ITEM_SCHEMA if f.dataType.simpleString().startswith("decimal")}

    def make(*rows):
        records = []
        for row in rows:
            record = {SHORT[k]: v for k, v in {**DEFAULTS, **row}.items()}
            for name in money:
                value = record.get(name)
                record[name] = None if value is None else Decimal(str(value))
            records.append(tuple(record.get(name) for name in COST_ITEM_SCHEMA.names))
        return spark.createDataFrame(records, COST_ITEM_SCHEMA)

    return make


@pytest.fixture(scope="session")
def rows():
    """The rows of a frame as tuples, decimals as floats."""

    def collect(df):
        return [tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in df.collect()]

    return collect
