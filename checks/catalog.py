"""Catalogue, customer and profile queries."""

from pyspark.sql import functions as F

from checks.base import CAL, CTE, WEEK, Store, register
from checks.candidates import NAMES
from checks.metrics import lists
from shelfwise.operators import candidates as cand
from shelfwise.operators import catalog as ct
from shelfwise.operators import features as ft
from shelfwise.schema import SOURCES
from shelfwise.sources.tables import customer_age_buckets, judge_additions

M = "article_id:s prod_name:s product_type_name:s colour_group_name:s"
_M = "article_id, prod_name, product_type_name, colour_group_name"


def top_last_week(s: Store):
    return cand.last_week_top(s.history, WEEK)


def sales(s: Store):
    return s.history.filter(F.col("week_idx") >= WEEK - 4).groupBy("article_idx").agg(F.count("*").alias("sales"))


register(
    "article_metadata", "customer_idx:l article_idx:l pos:i " + M,
    lambda s: ct.with_metadata(lists(s)["base_b"], s.articles),
    f"SELECT customer_idx, base_b.article_idx, pos, {_M} FROM base_b JOIN art USING (article_idx)",
)
register(
    "article_search", "article_idx:l " + M, lambda s: ct.search(s.articles, "RED", 50),
    f"""SELECT article_idx, {_M} FROM art WHERE contains(lower(prod_name), 'red') OR contains(lower(product_type_name), 'red')
    OR contains(lower(colour_group_name), 'red') ORDER BY article_idx LIMIT 50""",
)
register(
    "trending_articles", "article_idx:l rank:i sales_last_week:l " + M, lambda s: ct.trending(top_last_week(s), s.articles),
    f"SELECT article_idx, source_rank AS rank, score AS sales_last_week, {_M} FROM lw_top JOIN art USING (article_idx) WHERE source_rank <= 20",
)
register(
    "popularity_fallback", "article_idx:l rank:i sales_last_week:l " + M, lambda s: ct.trending(top_last_week(s), s.articles, 12),
    f"SELECT article_idx, source_rank AS rank, score AS sales_last_week, {_M} FROM lw_top JOIN art USING (article_idx) WHERE source_rank <= 12",
)
register(
    "browse_catalogue", "article_idx:l sales:l total:l " + M,
    lambda s: ct.browse(s.articles, sales(s), {"product_group_name": "economy"}, "r", 24, 24),
    f"""SELECT article_idx, sales, count(*) OVER () AS total, {_M} FROM art LEFT JOIN (SELECT article_idx, count(*) AS sales FROM hist
    WHERE week_idx >= {WEEK - 4} GROUP BY 1) USING (article_idx) WHERE lower(product_group_name) = 'economy' AND contains(lower(prod_name), 'r')
    ORDER BY sales DESC NULLS LAST, article_idx LIMIT 24 OFFSET 24""",
)
_FV = ("product_group_name", "garment_group_name", "colour_group_name", "section_name")
register(
    "filter_values", "column_name:s value:s", lambda s: ct.filter_values(s.articles, _FV),
    " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM art" for c in _FV),
)
register(
    "customer_id_lookup", "customer_id:s customer_idx:l",
    lambda s: ct.id_lookup(s.table("customer").select(F.col("c_name").alias("customer_id")), s.customers),
    "SELECT customer_id, customer_idx FROM cust",
)
_SEG = "CASE WHEN n = 0 THEN 'cold-start' WHEN n <= 4 THEN 'light' WHEN n <= 19 THEN 'medium' ELSE 'heavy' END"
register(
    "sample_by_activity", "segment:s place:i customer_idx:l customer_id:s age_bucket:s", lambda s: ct.sample_by_activity(s.history, s.customers),
    f"""SELECT * FROM (SELECT {_SEG} AS segment, row_number() OVER (PARTITION BY {_SEG} ORDER BY
      CAST('0x' || substr(md5(customer_idx || '|42'), 1, 8) AS BIGINT), customer_idx) AS place, customer_idx, customer_id, age_bucket
      FROM cust JOIN bucket USING (customer_idx) LEFT JOIN (SELECT customer_idx, count(*) AS n0 FROM hist GROUP BY 1) USING (customer_idx),
      LATERAL (SELECT coalesce(n0, 0) AS n)) WHERE place <= 5""",
)
register(
    "customer_profiles", "customer_idx:l customer_id:s age_bucket:s n_purchases:l n_last_4_weeks:l n_articles:l last_purchase:t",
    lambda s: ct.customer_profiles(s.history, s.customers, WEEK),
    f"""SELECT customer_idx, any_value(customer_id) AS customer_id, any_value(age_bucket) AS age_bucket, count(*) AS n_purchases,
    count(*) FILTER (week_idx >= {WEEK - 4}) AS n_last_4_weeks, count(DISTINCT article_idx) AS n_articles, max(t_dat) AS last_purchase
    FROM hist JOIN cust USING (customer_idx) JOIN bucket USING (customer_idx) GROUP BY customer_idx""",
)
register(
    "recent_purchases", "customer_idx:l place:i article_idx:l bought_on:t " + M, lambda s: ct.recent_purchases(s.history, s.articles),
    f"""SELECT customer_idx, place, article_idx, bought_on, {_M} FROM (SELECT customer_idx, article_idx, max(t_dat) AS bought_on,
    row_number() OVER (PARTITION BY customer_idx ORDER BY max(t_dat) DESC, article_idx) AS place FROM hist GROUP BY 1, 2) JOIN art USING (article_idx) WHERE place <= 10""",
)
register(
    "actual_purchases", "customer_idx:l article_idx:l " + M, lambda s: ct.actual_purchases(s.truth, s.articles),
    f"SELECT customer_idx, article_idx, {_M} FROM truth JOIN art USING (article_idx)",
)
CTE["likes"] = """SELECT customer_idx, top_types, top_colour FROM (SELECT customer_idx, string_agg(product_type_name, ' and ' ORDER BY r) AS top_types FROM
  (SELECT customer_idx, product_type_name, row_number() OVER (PARTITION BY customer_idx ORDER BY count(DISTINCT article_idx) DESC, product_type_name) AS r
   FROM hist JOIN art USING (article_idx) GROUP BY 1, 2) WHERE r <= 2 GROUP BY 1) JOIN (SELECT customer_idx, colour_group_name AS top_colour,
   row_number() OVER (PARTITION BY customer_idx ORDER BY count(DISTINCT article_idx) DESC, colour_group_name) AS r
   FROM hist JOIN art USING (article_idx) GROUP BY 1, 2 QUALIFY r = 1) USING (customer_idx)"""
register(
    "preference_summary", "customer_idx:l top_types:s top_colour:s", lambda s: ct.preference_summary(s.history, s.articles), "SELECT * FROM likes"
)


def _compare(s: Store):
    own = ct.recent_purchases(s.history, s.articles, 12)
    pairs = s.customers.select(F.col("customer_idx").alias("left_idx"), (F.col("customer_idx") + 1).alias("right_idx"))
    return ct.compare_customers(own, ct.preference_summary(s.history, s.articles), pairs)


register(
    "compare_customers", "left_idx:l right_idx:l left_top_types:s right_top_types:s left_top_colour:s right_top_colour:s n_shared:i", _compare,
    """SELECT a.customer_idx AS left_idx, b.customer_idx AS right_idx, x.top_types AS left_top_types, y.top_types AS right_top_types, x.top_colour AS left_top_colour,
    y.top_colour AS right_top_colour, len(list_intersect(a.l, b.l)) AS n_shared FROM own12 a JOIN own12 b ON b.customer_idx = a.customer_idx + 1
    JOIN likes x ON x.customer_idx = a.customer_idx JOIN likes y ON y.customer_idx = b.customer_idx""",
    {
        "own12": """SELECT customer_idx, list(article_idx) AS l FROM (SELECT customer_idx, article_idx FROM hist GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY customer_idx ORDER BY max(t_dat) DESC, article_idx) <= 12) GROUP BY 1"""
    },
)
register(
    "sample_shoppers", "customer_idx:l customer_id:s age_bucket:s channel:s n_purchases:l summary:s",
    lambda s: ct.sample_shoppers(s.history, s.customers, s.articles),
    """SELECT customer_idx, customer_id, age_bucket, ch AS channel, n AS n_purchases, n || ' purchases, most of them ' || ch || ', age group ' || age_bucket
    || coalesce('; types: ' || top_types, '') || coalesce('; colour: ' || top_colour, '') AS summary FROM
    (SELECT * FROM (SELECT *, 0 AS late FROM chosen UNION ALL SELECT *, 1 FROM known ANTI JOIN chosen USING (customer_idx))
     ORDER BY late, CASE WHEN late = 1 THEN -n ELSE 0 END, customer_idx LIMIT 40) LEFT JOIN likes USING (customer_idx)""",
    {
        "known": """SELECT customer_idx, count(*) AS n, CASE WHEN count(*) FILTER (sales_channel_id = 1) * 2 >= count(*) THEN 'store' ELSE 'online' END AS ch,
          any_value(customer_id) AS customer_id, any_value(age_bucket) AS age_bucket FROM hist JOIN cust USING (customer_idx) JOIN bucket USING (customer_idx)
          GROUP BY 1 HAVING count(*) BETWEEN 5 AND 150""",
        "chosen": """SELECT * FROM known WHERE age_bucket <> 'missing' QUALIFY row_number() OVER (PARTITION BY age_bucket ORDER BY n, customer_idx) <= 8""",
    },
)
_SRC = " || ".join(f"CASE WHEN {s}_rank IS NOT NULL THEN ',{s}' ELSE '' END" for s in NAMES)
register(
    "candidate_funnel", "customer_idx:l article_idx:l final_source:s final_rank:i sources:s n_sources:i",
    lambda s: ct.candidate_funnel(s.merged, SOURCES), f"SELECT *, substr({_SRC}, 2) AS sources FROM cand_feat",
)
register(
    "trend_groups", "product_type_name:s sales:l n_articles:l share:d", lambda s: ct.trend_groups(top_last_week(s), s.articles),
    """SELECT product_type_name, sum(score) AS sales, count(*) AS n_articles, sum(score) * 1e0 / (SELECT sum(score) FROM lw_top) AS share
    FROM lw_top JOIN art USING (article_idx) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
register(
    "trend_by_age", "age_bucket:s rank:i article_idx:l sales:l prod_name:s",
    lambda s: ct.trend_by_age(cand.segment_top(s.history, WEEK, customer_age_buckets(s.customers)), s.articles),
    "SELECT age_bucket, source_rank AS rank, article_idx, score AS sales, prod_name FROM seg_top JOIN art USING (article_idx) WHERE source_rank <= 10 AND age_bucket <> 'missing'",
)
register(
    "sales_by_article_age", "age_label:s sales:l n_articles:l share:d",
    lambda s: ct.sales_by_article_age(ft.article_features(s.history, WEEK, s.articles, s.customers, CAL)),
    """SELECT CASE WHEN a_days_since_first_sale < 14 THEN 'under 2 weeks' WHEN a_days_since_first_sale < 60 THEN 'under 60 days'
    WHEN a_days_since_first_sale < 180 THEN 'under 180 days' ELSE 'older' END AS age_label, sum(a_sales_1w) AS sales, count(*) AS n_articles,
    sum(a_sales_1w) * 1e0 / (SELECT sum(a_sales_1w) FROM a_feat WHERE a_days_since_first_sale IS NOT NULL) AS share
    FROM a_feat WHERE a_days_since_first_sale IS NOT NULL GROUP BY 1""",
)


def _profile_rows(s: Store):
    """Customers as profiles: history before the target week is held, the rest arrives."""
    rows = s.tx.select(
        F.col("customer_idx").alias("profile_id"), "article_idx", F.col("t_dat").alias("created_at"), "week_idx", "price"
    )
    rows = rows.withColumn("id", F.concat_ws("|", "article_idx", F.round("price", 4).cast("decimal(18,4)").cast("string")))
    held = rows.filter(F.col("week_idx") < WEEK - 10)
    return held, rows.filter(F.col("week_idx") >= WEEK - 10)


def _append(s: Store):
    held, new = _profile_rows(s)
    counts = held.groupBy("profile_id").agg(F.count("*").alias("held"))
    judged = judge_additions(counts, new, 50).groupBy("profile_id").agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"))
    every = counts.join(judged, "profile_id", "full").na.fill(0)
    return every.withColumn("n_purchases", F.col("held") + F.col("n_accepted"))


register(
    "profile_purchase_append", "profile_id:l n_purchases:l n_accepted:l n_refused:l", _append,
    f"""SELECT customer_idx AS profile_id, CASE WHEN h + n <= 50 THEN h + n ELSE h END AS n_purchases, CASE WHEN h + n <= 50 THEN n ELSE 0 END AS n_accepted,
    CASE WHEN h + n <= 50 THEN 0 ELSE n END AS n_refused FROM
    (SELECT customer_idx, count(*) FILTER (week_idx < {WEEK - 10}) AS h, count(*) FILTER (week_idx >= {WEEK - 10}) AS n FROM tx GROUP BY 1)""",
)
register(
    "profile_list", "profile_id:l customer_id:s n_purchases:l last_purchase:t",
    lambda s: ct.profile_list(
        s.customers.select(F.col("customer_idx").alias("profile_id"), "customer_id"), _profile_rows(s)[0]
    ),
    f"""SELECT c.customer_idx AS profile_id, any_value(customer_id) AS customer_id, count(t.article_idx) AS n_purchases, max(t_dat) AS last_purchase
    FROM cust c LEFT JOIN (SELECT * FROM tx WHERE week_idx < {WEEK - 10}) t USING (customer_idx) GROUP BY 1""",
)
