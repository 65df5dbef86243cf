"""Registered queries: a Spark callable, an output spec and, where SQL can say it, the SQL twin.

The spec lists the output columns with a type letter (i int, l bigint, d double rounded to six
places, p to nine, s text, t date, b boolean). Both sides are cast by it, so names and types agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import week_index
from shelfwise.plans import candidate_run as cr
from shelfwise.session import materialize_by
from shelfwise.sources import retail_view as rv
from shelfwise.sources.splits import before_week, build_holdout_fold

WEEK = rv.STORE_CALENDAR.holdout_week
CAL = rv.STORE_CALENDAR
SETTINGS = cr.RunSettings(min_pair_count=2, basket_weeks=400, seed_weeks=52, code_weeks=52)


class Store:
    """The given tables of one folder as frames of this domain."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return rv.read(self.spark, self.folder, name)

    @cached_property
    def tx(self) -> DataFrame:
        return rv.transactions(self.spark, self.folder)

    @cached_property
    def sales(self) -> DataFrame:
        """Order lines up to the target week, joined once and dealt by customer: candidates and features start from them."""
        lines = rv.transactions(self.spark, self.folder, before_week=WEEK + 1).drop("week_idx")
        return materialize_by(lines, "customer_idx", week_idx=week_index(F.col("t_dat"), CAL))

    @cached_property
    def history(self) -> DataFrame:
        return before_week(self.sales, WEEK)

    @cached_property
    def customers(self) -> DataFrame:
        return rv.customers(self.spark, self.folder)

    @cached_property
    def articles(self) -> DataFrame:
        return rv.articles(self.spark, self.folder)

    @cached_property
    def truth(self) -> DataFrame:
        return materialize_by(build_holdout_fold(self.sales, CAL).truth, "customer_idx")

    @cached_property
    def eval_customers(self) -> DataFrame:
        return self.truth.select("customer_idx").distinct()

    @cached_property
    def _state(self) -> cr.CandidateState:
        return cr.build_state(self.history, WEEK, CAL, self.articles, self.customers, SETTINGS)

    def state(self) -> cr.CandidateState:
        return self._state

    @cached_property
    def kept(self) -> dict[str, DataFrame]:
        """Checkpointed tables that several queries start from, by name."""
        return {}

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        return cr.all_sources(self.history, self.eval_customers, self.state())

    @cached_property
    def merged(self) -> DataFrame:
        return materialize_by(cr.generate(self.history, self.eval_customers, self.state()), "customer_idx")


_STORES: dict[tuple[str, str], Store] = {}


def store_for(spark: SparkSession, folder: str) -> Store:
    """One store per session and folder: the state, merged candidates, features and outcomes are
    written once and read by every query that needs them, as a scheduled run would do."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        _STORES[key] = Store(spark, folder)
    return _STORES[key]


_SPARK = {"i": "int", "l": "bigint", "s": "string", "t": "date", "b": "boolean"}
_DIGITS = {"d": 6, "p": 9}
_DUCK = {"i": "INTEGER", "l": "BIGINT", "s": "VARCHAR", "t": "DATE", "b": "BOOLEAN"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTE: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def to_spec(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in _columns(spec):
        c = F.col(name)
        # adding 0.0 turns -0.0 into 0.0
        c = F.round(c.cast("double"), _DIGITS[kind]) + F.lit(0.0) if kind in _DIGITS else c.cast(_SPARK[kind])
        cols.append(c.alias(name))
    return df.select(*cols)


def _sql_columns(spec: str) -> str:
    cols = []
    for name, kind in _columns(spec):
        c = f"round(CAST({name} AS DOUBLE), {_DIGITS[kind]}) + 0e0" if kind in _DIGITS else f"CAST({name} AS {_DUCK[kind]})"
        cols.append(f"{c} AS {name}")
    return ", ".join(cols)


def with_ctes(body: str, given: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named parts it uses, in dependency order."""
    parts = {**CTE, **(given or {})}
    ordered: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text))
        for name in parts:
            if name in words and name not in ordered and name not in above:
                visit(parts[name], (*above, name))
                ordered.append(name)

    visit(body, ())
    prefix = ",\n".join(f"{n} AS ({parts[n]})" for n in ordered)
    return f"WITH {prefix}\n{body}" if ordered else body


def register(
    name: str,
    spec: str,
    fn: Callable[[Store], DataFrame],
    sql: str | None = None,
    given: dict[str, str] | None = None,
) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, folder: to_spec(fn(store_for(spark, folder)), spec)
    if sql is not None:
        SQL[name] = with_ctes(f"SELECT {_sql_columns(spec)} FROM (\n{sql}\n) AS answer", given)


# --- shared SQL parts ------------------------------------------------------------

CTE["tx"] = """SELECT CAST(o_custkey AS BIGINT) AS customer_idx, CAST(l_partkey AS BIGINT) AS article_idx,
  CAST(o_orderdate AS DATE) AS t_dat, l_extendedprice / l_quantity AS price,
  CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS sales_channel_id,
  CAST(floor(datediff('day', DATE '1994-12-28', CAST(o_orderdate AS DATE)) / 7e0) AS INTEGER) AS week_idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTE["cust"] = """SELECT CAST(c_custkey AS BIGINT) AS customer_idx, c_name AS customer_id,
  CASE WHEN c_custkey % 50 <> 0 THEN CAST(18 + (c_custkey * 7) % 60 AS DOUBLE) END AS age,
  CASE WHEN c_acctbal > 5000 THEN 1e0 END AS FN, CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0e0 END AS Active,
  CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'PRE-CREATE' ELSE 'ACTIVE' END AS club_member_status,
  CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'HOUSEHOLD' THEN 'Monthly' WHEN 'FURNITURE' THEN 'NONE'
    ELSE 'Regularly' END AS fashion_news_frequency
  FROM customer"""
CTE["art"] = """SELECT CAST(p_partkey AS BIGINT) AS article_idx, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id,
  p_name AS prod_name, p_brand || '|' || p_type AS product_code, p_size AS product_type_no,
  split_part(p_name, ' ', 2) AS product_type_name, p_type AS product_group_name, p_type AS index_group_name,
  p_brand AS garment_group_name, split_part(p_name, ' ', 1) AS colour_group_name,
  split_part(p_name, ' ', 2) AS section_name, split_part(p_name, ' ', 2) AS department_name, p_size AS department_no
  FROM part"""
CTE["hist"] = f"SELECT * FROM tx WHERE week_idx < {WEEK}"
CTE["truth"] = f"SELECT DISTINCT customer_idx, article_idx FROM tx WHERE week_idx = {WEEK}"
CTE["evalc"] = "SELECT DISTINCT customer_idx FROM truth"
CTE["who"] = "SELECT customer_idx FROM evalc"
_BUCKET = """CASE WHEN age IS NULL THEN 'missing' WHEN age < 25 THEN '<25' WHEN age < 35 THEN '25-34'
  WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' ELSE '55+' END"""
CTE["bucket"] = f"SELECT customer_idx, {_BUCKET} AS age_bucket FROM cust"
CTE["bought"] = "SELECT customer_idx, article_idx, max(week_idx) AS last_week FROM hist SEMI JOIN who USING (customer_idx) GROUP BY ALL"
CTE["art_rank"] = """SELECT article_idx, count(*) AS units,
  row_number() OVER (ORDER BY count(*) DESC, article_idx) AS pop_rank FROM hist GROUP BY article_idx"""
