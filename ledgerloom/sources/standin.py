"""A cost table derived from a star schema of orders, for trying the reports out.

Lines become cost items: the part is service, resource and product, the
supplier's nation the region, the order's customer and priority the tags.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schema as s

# The tables' columns in use. A given schema saves the job that
# would read file footers to find it.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}

_AMOUNT = "decimal(18,2)"
_FEE = "decimal(28,4)"

_OF_PART = {s.SERVICE, s.USAGE_TYPE, s.INSTANCE_TYPE, s.PRODUCT}
_OF_NATION = {s.REGION, s.PRODUCT}
_OF_ORDER = {s.TAGS}


def _amount(column: str) -> str:
    return s.exact_cast(column, _AMOUNT)


def _fee(price: str, rate: str) -> str:
    return s.exact_cast(f"({_amount(price)} * {_amount(rate)})", _FEE)


def _numbered(prefix: str, every: int) -> str:
    return f"IF(l_suppkey % {every} = 0, '{prefix}' || l_suppkey, '')"


def _expressions(resource_key: str) -> dict[str, str]:
    """The cost columns as SQL expressions on the joined tables."""
    key, instance_type = resource_key, "IF(p_size % 5 = 0, '', CAST(p_size AS string))"
    ending = f"CASE WHEN {key} % 19 = 0 THEN '-management' WHEN {key} % 23 = 0 THEN '-overhead' ELSE '' END"
    return {
        s.PERIOD: "trunc(to_date(l_shipdate), 'month')",
        s.USAGE_START: "l_shipdate",
        s.LINE_TYPE: "CASE l_returnflag WHEN 'R' THEN 'Refund' WHEN 'A' THEN 'Credit' WHEN 'N' THEN 'Usage' END",
        s.SERVICE: "p_brand",
        s.USAGE_TYPE: "p_type",
        s.INSTANCE_TYPE: instance_type,
        s.RESOURCE: f"IF({key} % 17 = 0, '', 'res-' || {key} || {ending})",
        s.REGION: "n_name",
        s.OPERATION: "l_linestatus",
        s.USAGE_AMOUNT: _amount("l_quantity"),
        s.COST: _amount("l_extendedprice"),
        s.RESERVATION: _numbered("ri-", 5),
        s.RESERVATION_COST: _amount("l_extendedprice"),
        s.RESERVATION_UNUSED_UPFRONT: _fee("l_extendedprice", "l_discount"),
        s.RESERVATION_UNUSED_RECURRING: _fee("l_extendedprice", "l_tax"),
        s.PLAN: _numbered("sp-", 7),
        s.PLAN_COST: _amount("l_extendedprice"),
        s.PLAN_COMMITMENT: _fee("l_extendedprice", "l_quantity"),
        s.PLAN_USED: _fee("l_quantity", "l_discount"),
        s.PLAN_RATE: _amount("l_discount"),
        s.PLAN_UPFRONT: _fee("l_quantity", "l_tax"),
        s.TAGS: """CASE l_partkey % 3
            WHEN 0 THEN CAST(map() AS map<string,string>)
            WHEN 1 THEN map('user_creator', c_mktsegment, 'user_priority', o_orderpriority)
            ELSE map('user_priority', o_orderpriority) END""",
        s.PRODUCT: f"map('product_name', p_name, 'instance_type', {instance_type}, 'region', n_name)",
    }


def cost_items(
    spark: SparkSession,
    folder: str,
    columns: Iterable[str],
    start: dt.date | None = None,
    end: dt.date | None = None,
    resource_key: str = "l_partkey",
) -> DataFrame:
    """Cost items with the given columns, used from `start` up to but not on `end`.

    Only the tables that the columns need are joined. The date range is put on
    the raw column ahead of the joins, where it reaches the Parquet scan. The
    joins are left joins, so no cost line is lost, and carry no hints: Spark
    broadcasts a side whose size it has checked and otherwise shuffles, where
    AQE splits a key that holds too many rows.
    """
    wanted = list(dict.fromkeys(columns))

    def table(name):
        return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem")
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start))
    if end is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(end))
    if _OF_PART.intersection(wanted):
        lines = lines.join(table("part"), F.expr("l_partkey = p_partkey"), "left")
    if _OF_NATION.intersection(wanted):
        places = table("supplier").join(table("nation"), F.expr("s_nationkey = n_nationkey"), "left")
        lines = lines.join(places, F.expr("l_suppkey = s_suppkey"), "left")
    if _OF_ORDER.intersection(wanted):
        orders = table("orders").join(table("customer"), F.expr("o_custkey = c_custkey"), "left")
        lines = lines.join(orders, F.expr("l_orderkey = o_orderkey"), "left")
    expressions = _expressions(resource_key)
    return lines.selectExpr(*[f"{expressions[name]} AS {name}" for name in wanted])
