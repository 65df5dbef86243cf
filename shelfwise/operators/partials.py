"""Weekly partials of the features: counts, sums and days that merge, so that a week's state is the last one plus one week.

Three tables hold all that the features need of the sales before a week:

* (customer, week): rows, days as a bit for each weekday, online rows, price sums and bounds, last day;
* (article, week): rows, buyers, online rows, price sum, first and last day, sums over the buyers' ages;
* (customer, article): rows, first and last day.

Each is folded on the map side. Weeks are never split, so the first two are appended to; pairs are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import count_if
from shelfwise.session import materialize, materialize_by
from shelfwise.sources.splits import before_week

PAIR = ["customer_idx", "article_idx"]


def _price() -> Column:
    return F.col("price").cast("double")


def _online() -> Column:
    return count_if(F.col("sales_channel_id") == 2).alias("online")


def customer_weeks(history: DataFrame) -> DataFrame:
    # a week's seven days fall on different weekdays
    weekday = F.expr("shiftleft(1, cast(pmod(unix_date(t_dat), 7) as int))")
    return history.groupBy("customer_idx", "week_idx").agg(
        F.count("*").alias("n"),
        F.bit_or(weekday).alias("days"),
        _online(),
        F.sum(_price()).alias("price"),
        F.sum(_price() * _price()).alias("price_sq"),
        F.min(_price()).alias("lowest"),
        F.max(_price()).alias("highest"),
        F.max("t_dat").alias("last"),
    )


def article_weeks(history: DataFrame, customers: DataFrame) -> DataFrame:
    """Folded by buyer first: a best seller is spread over its buyers, and they are counted without a distinct."""
    bought = history.groupBy("article_idx", "week_idx", "customer_idx").agg(
        F.count("*").alias("n"), _online(), F.sum(_price()).alias("price"), F.min("t_dat").alias("first"), F.max("t_dat").alias("last")
    )
    aged = bought.join(customers.select("customer_idx", F.col("age").cast("double").alias("age")), "customer_idx", "left")
    known = F.when(F.col("age").isNotNull(), F.col("n"))
    return aged.groupBy("article_idx", "week_idx").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("buyers"),
        F.sum("online").alias("online"),
        F.sum("price").alias("price"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.coalesce(F.sum(known), F.lit(0)).alias("aged"),
        F.sum(known * F.col("age")).alias("age"),
        F.sum(known * F.col("age") * F.col("age")).alias("age_sq"),
    )


def pair_days(history: DataFrame) -> DataFrame:
    return history.groupBy(*PAIR).agg(F.count("*").alias("n"), F.min("t_dat").alias("first"), F.max("t_dat").alias("last"))


@dataclass(frozen=True)
class Partials:
    """The partials of all sales before ``week``."""

    week: int
    by_customer: DataFrame
    by_article: DataFrame
    pairs: DataFrame

    def of(self, customers: DataFrame) -> Partials:
        """The same with the rows of these customers alone, where there are any by customer."""
        who = customers.select("customer_idx").distinct()
        mine = [df.join(who, "customer_idx", "left_semi") for df in (self.by_customer, self.pairs)]
        return Partials(self.week, mine[0], self.by_article, mine[1])

    def before(self, week: int, history: DataFrame) -> Partials:
        """Those of an earlier week: weeks are cut off, as they are never split; pairs are folded anew, of ``history``."""
        if week > self.week:
            raise ValueError(f"partials of week {self.week} do not hold the weeks before {week}")
        by_week = [before_week(df, week) for df in (self.by_customer, self.by_article)]
        return Partials(week, *by_week, materialize_by(pair_days(before_week(history, week)), "customer_idx"))

    def saved(self) -> Partials:
        """Written; those by customer are dealt by customer, as sales are."""
        by_customer, pairs = [materialize_by(df, "customer_idx") for df in (self.by_customer, self.pairs)]
        return Partials(self.week, by_customer, materialize(self.by_article), pairs)


def of_history(history: DataFrame, week: int, customers: DataFrame) -> Partials:
    rows = history.filter(F.col("week_idx") < week)
    return Partials(week, customer_weeks(rows), article_weeks(rows, customers), pair_days(rows))


def rolled(last: Partials, tx: DataFrame, customers: DataFrame) -> Partials:
    """Partials one week on. Of ``tx`` the one week that is new is read."""
    new = tx.filter(F.col("week_idx") == last.week)
    pairs = last.pairs.unionByName(pair_days(new)).groupBy(*PAIR)
    return Partials(
        last.week + 1,
        last.by_customer.unionByName(customer_weeks(new)),
        last.by_article.unionByName(article_weeks(new, customers)),
        pairs.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")),
    )
