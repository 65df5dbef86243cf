"""Feature groups, assembly and feature checks."""

from checks.base import CAL, CTE, SETTINGS, WEEK, Store, register
from checks.candidates import NAMES
from shelfwise.operators import features as ft
from shelfwise.operators.partials import of_history, rolled
from shelfwise.plans.fold_features import fold_frame
from shelfwise.schema import FEATURE_NAMES, FEATURES
from shelfwise.session import materialize_by
from shelfwise.sources.splits import before_week, build_holdout_fold
from shelfwise.sources.tables import portable_content_summary

D = f"(DATE '1994-12-28' + {WEEK * 7})"
CTE["c_feat"] = f"""SELECT customer_idx, count(*) AS c_n_purchases,
  {', '.join(f"count(*) FILTER (week_idx >= {WEEK - n}) AS c_n_purchases_{n}w" for n in (1, 4, 12))},
  count(DISTINCT article_idx) AS c_n_unique_articles, datediff('day', max(t_dat), {D}) AS c_days_since_last_purchase,
  count(DISTINCT week_idx) AS c_n_active_weeks, count(*) * 1e0 / count(DISTINCT t_dat) AS c_avg_basket_size,
  avg(price) AS c_mean_price, stddev_samp(price) AS c_std_price, avg(CASE WHEN sales_channel_id = 2 THEN 1e0 ELSE 0 END) AS c_online_share,
  any_value(age) AS c_age,
  any_value(CASE WHEN club_member_status IS NULL THEN -1 WHEN club_member_status = 'ACTIVE' THEN 1 ELSE 0 END) AS c_club_member_status,
  any_value(CASE fashion_news_frequency WHEN 'Regularly' THEN 2 WHEN 'Monthly' THEN 1 WHEN 'NONE' THEN 0 ELSE -1 END) AS c_fashion_news_frequency,
  any_value(coalesce(FN, -1)) AS c_FN, any_value(coalesce(Active, -1)) AS c_Active
  FROM hist LEFT JOIN cust USING (customer_idx) GROUP BY customer_idx"""


def _code(col: str) -> str:
    return f"(SELECT count(DISTINCT b.{col}) FROM art b WHERE b.{col} < art.{col}) AS a_{col}"


CTE["codes"] = "SELECT article_idx, " + ", ".join(
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS a_{c}" for c in ft.ORDINAL
) + " FROM art"
CTE["a_sold"] = f"""SELECT article_idx, {', '.join(f"count(*) FILTER (week_idx >= {WEEK - n}) AS s{n}" for n in (1, 2, 4))},
  count(DISTINCT customer_idx) FILTER (week_idx >= {WEEK - 1}) AS b1, min(t_dat) AS first, max(t_dat) AS last, avg(price) AS p_all,
  avg(price) FILTER (week_idx >= {WEEK - 4}) AS p4, avg(price) FILTER (week_idx >= {WEEK - 1}) AS p1,
  avg(age) FILTER (week_idx >= {WEEK - 12}) AS age12, stddev_samp(age) FILTER (week_idx >= {WEEK - 12}) AS sd12,
  avg(CASE WHEN sales_channel_id = 2 THEN 1e0 ELSE 0 END) FILTER (week_idx >= {WEEK - 4}) AS online_share_4w
  FROM hist LEFT JOIN cust USING (customer_idx) GROUP BY article_idx"""
CTE["a_rebuy"] = """SELECT article_idx, avg(CASE WHEN d > 1 THEN 1e0 ELSE 0 END) AS rebuy
  FROM (SELECT article_idx, customer_idx, count(DISTINCT t_dat) AS d FROM hist GROUP BY 1, 2) GROUP BY article_idx"""
CTE["a_feat"] = f"""SELECT article_idx, coalesce(s1, 0) AS a_sales_1w, coalesce(s2, 0) AS a_sales_2w, coalesce(s4, 0) AS a_sales_4w,
  coalesce(b1, 0) AS a_unique_buyers_1w, CASE WHEN s4 > 0 THEN s1 / (s4 / 4e0) END AS a_trend_ratio,
  datediff('day', first, {D}) AS a_days_since_first_sale, CASE WHEN first < DATE '1994-12-28' + 28 THEN 1 WHEN first IS NOT NULL THEN 0 END AS a_censored_flag,
  datediff('day', last, {D}) AS a_days_since_last_sale, p4 AS a_mean_price_4w, p1 / p_all AS a_price_vs_own_history,
  rebuy AS a_repurchase_rate, age12 AS a_mean_buyer_age_12w, sd12 AS a_std_buyer_age_12w, product_type_no AS a_product_type_no,
  {', '.join(f'a_{c}' for c in ft.ORDINAL)}, department_no AS a_department_no, online_share_4w
  FROM art LEFT JOIN a_sold USING (article_idx) LEFT JOIN a_rebuy USING (article_idx) JOIN codes USING (article_idx)"""
CTE["cand_feat"] = "SELECT merged.*, " + ", ".join(
    f"CASE WHEN {s}_rank IS NOT NULL THEN 1 ELSE 0 END AS in_{s}" for s in NAMES
) + ", " + " + ".join(f"CASE WHEN {s}_rank IS NOT NULL THEN 1 ELSE 0 END" for s in NAMES) + " AS n_sources FROM merged"
CTE["pop_totals"] = f"""SELECT greatest(count(*) FILTER (week_idx = {WEEK - 1}), 1) AS u1,
  greatest(coalesce(sum(1e0 / (1e0 + datediff('day', t_dat, {D}))), 0), 1e-6) AS ud FROM hist WHERE week_idx >= {WEEK - 4}"""
CTE["bucket_n"] = f"""SELECT age_bucket, count(*) AS bn FROM hist JOIN bucket USING (customer_idx)
  WHERE week_idx >= {WEEK - 2} GROUP BY age_bucket"""
CTE["own_pairs"] = "SELECT customer_idx, article_idx, count(*) AS n, max(t_dat) AS last FROM hist GROUP BY 1, 2"
CTE["own_codes"] = "SELECT customer_idx, product_code, sum(n) AS n, max(last) AS last FROM own_pairs JOIN art USING (article_idx) GROUP BY 1, 2"
CTE["own_pg"] = "SELECT customer_idx, product_group_name, sum(n) AS n FROM own_pairs JOIN art USING (article_idx) GROUP BY 1, 2"
CTE["own_gg"] = "SELECT customer_idx, garment_group_name, sum(n) AS n FROM own_pairs JOIN art USING (article_idx) GROUP BY 1, 2"
CTE["features"] = f"""SELECT m.customer_idx, m.article_idx, CASE WHEN t.article_idx IS NOT NULL THEN 1 ELSE 0 END AS label,
  m.* EXCLUDE (customer_idx, article_idx), c.* EXCLUDE (customer_idx), f.* EXCLUDE (article_idx),
  coalesce(p.n, 0) AS i_times_bought, datediff('day', p.last, {D}) AS i_days_since_bought_article,
  coalesce(k.n, 0) AS i_bought_same_product_code, datediff('day', k.last, {D}) AS i_days_since_bought_product_code,
  CAST(g.n AS DOUBLE) / c_n_purchases AS i_customer_share_product_group, CAST(h.n AS DOUBLE) / c_n_purchases AS i_customer_share_garment_group,
  abs(c_age - a_mean_buyer_age_12w) AS i_age_gap, CASE WHEN c_mean_price <> 0 THEN a_mean_price_4w / c_mean_price END AS i_price_ratio,
  abs(c_online_share - online_share_4w) AS i_channel_gap,
  CAST(popularity_last_week_score AS DOUBLE) / (SELECT u1 FROM pop_totals) AS popularity_last_week_share,
  CAST(popularity_decayed_score AS DOUBLE) / (SELECT ud FROM pop_totals) AS popularity_decayed_share,
  CAST(segment_popular_score AS DOUBLE) / bn AS segment_popular_share
  FROM cand_feat m LEFT JOIN c_feat c ON c.customer_idx = m.customer_idx JOIN a_feat f ON f.article_idx = m.article_idx
  JOIN art a ON a.article_idx = m.article_idx
  LEFT JOIN own_pairs p ON p.customer_idx = m.customer_idx AND p.article_idx = m.article_idx
  LEFT JOIN own_codes k ON k.customer_idx = m.customer_idx AND k.product_code = a.product_code
  LEFT JOIN own_pg g ON g.customer_idx = m.customer_idx AND g.product_group_name = a.product_group_name
  LEFT JOIN own_gg h ON h.customer_idx = m.customer_idx AND h.garment_group_name = a.garment_group_name
  LEFT JOIN bucket b ON b.customer_idx = m.customer_idx LEFT JOIN bucket_n USING (age_bucket)
  LEFT JOIN truth t ON t.customer_idx = m.customer_idx AND t.article_idx = m.article_idx"""

_KIND = {"tinyint": "i", "smallint": "i", "int": "i", "float": "d"}


def spec(group: str | None = None, extra: str = "") -> str:
    cols = [f"{f.name}:{_KIND[f.type.simpleString()]}" for f in FEATURES if group in (None, f.group)]
    return extra + " " + " ".join(cols)


def frame(s: Store):
    if "features" not in s.kept:
        # lists by customer stay together: means over a list need no exchange
        fold = build_holdout_fold(s.sales, CAL)
        s.kept["features"] = materialize_by(fold_frame(fold, CAL, s.articles, s.customers, SETTINGS, state=s.state(), merged=s.merged), "customer_idx")
    return s.kept["features"]


register(
    "customer_features", spec("customer", "customer_idx:l"),
    lambda s: ft.customer_features(s.history, WEEK, s.customers, CAL), "SELECT * FROM c_feat",
)


def _rolled(s: Store):
    """Partials of two weeks before, rolled on twice."""
    start = of_history(before_week(s.tx, WEEK - 2), WEEK - 2, s.customers).saved()
    return rolled(rolled(start, s.history, s.customers).saved(), s.history, s.customers)


def _rolled_customers(s: Store):
    p = _rolled(s)
    return ft.customer_features_of(p.by_customer, p.pairs, WEEK, s.customers, CAL)


def _rolled_articles(s: Store):
    p = _rolled(s)
    return ft.article_features_of(p.by_article, p.pairs, WEEK, s.articles, CAL)


register("customer_features_rolled", spec("customer", "customer_idx:l"), _rolled_customers, "SELECT * FROM c_feat")
register("article_features_rolled", spec("article", "article_idx:l") + " online_share_4w:d", _rolled_articles, "SELECT * FROM a_feat")
register(
    "article_features", spec("article", "article_idx:l") + " online_share_4w:d",
    lambda s: ft.article_features(s.history, WEEK, s.articles, s.customers, CAL), "SELECT * FROM a_feat",
)
register(
    "ordinal_codes", "article_idx:l " + " ".join(f"a_{c}:i" for c in ft.ORDINAL),
    lambda s: ft.ordinal_codes(s.articles), "SELECT * FROM codes",
)
register(
    "popularity_totals", "units_last_week:l units_decayed:d",
    lambda s: ft.popularity_totals(s.history, WEEK, CAL), "SELECT u1 AS units_last_week, ud AS units_decayed FROM pop_totals",
)
register("fold_features", spec(None, "customer_idx:l article_idx:l label:i"), frame, "SELECT * FROM features")
register(
    "fold_features_downsampled", "customer_idx:l article_idx:l label:i final_rank:i",
    lambda s: ft.downsample_negatives(frame(s), 0.2, 42, portable=True),
    """SELECT * FROM features WHERE label = 1
    OR CAST('0x' || substr(md5(customer_idx || '|' || article_idx || '|42'), 1, 8) AS BIGINT) / 4294967296e0 < 0.2e0""",
)
register(
    "feature_health", "feature:s null_rate:d is_constant:b",
    lambda s: ft.column_health(frame(s), FEATURE_NAMES),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (count(*) - count({c})) * 1e0 / count(*) AS null_rate,
        coalesce(min({c}) = max({c}), true) AS is_constant FROM features"""
        for c in FEATURE_NAMES
    ),
)
register(
    "label_consistency", "n_positive:l n_truth:l recall:d", lambda s: ft.label_consistency(frame(s), s.truth),
    """SELECT sum(label) AS n_positive, (SELECT count(*) FROM truth) AS n_truth,
    sum(label) * 1e0 / (SELECT count(*) FROM truth) AS recall FROM features""",
)
register(
    "table_content_hash", "table_name:s n_rows:l content_hash:l",
    lambda s: portable_content_summary(
        s.tx.select("customer_idx", "article_idx", "t_dat", "sales_channel_id", "week_idx"), "transactions"
    ),
    """SELECT 'transactions' AS table_name, count(*) AS n_rows, sum(CAST('0x' || substr(md5(
    customer_idx || '|' || article_idx || '|' || t_dat || '|' || sales_channel_id || '|' || week_idx), 1, 8) AS BIGINT)) AS content_hash FROM tx""",
)
