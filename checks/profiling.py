"""Tables, exploratory queries and load verification."""

from datetime import date

from pyspark.sql import functions as F

from checks.base import CAL, CTE, WEEK, Store, register
from shelfwise.operators import profiling as pf
from shelfwise.operators import quality as qa
from shelfwise.sources import tables as tb
from shelfwise.sources.splits import last_full_week

register(
    "scan_transactions", "customer_idx:l article_idx:l t_dat:t price:p sales_channel_id:i week_idx:i", lambda s: s.tx, "SELECT * FROM tx"
)
register(
    "scan_articles",
    "article_idx:l article_id:s prod_name:s product_code:s product_type_no:i product_type_name:s product_group_name:s index_group_name:s "
    "garment_group_name:s colour_group_name:s section_name:s department_name:s department_no:i",
    lambda s: s.articles, "SELECT * FROM art",
)
register(
    "scan_customers", "customer_idx:l customer_id:s age:d FN:d Active:d club_member_status:s fashion_news_frequency:s",
    lambda s: s.customers, "SELECT * FROM cust",
)
register(
    "customer_age_buckets", "customer_idx:l age_bucket:s", lambda s: tb.customer_age_buckets(s.customers), "SELECT * FROM bucket"
)
register(
    "article_product_codes", "article_idx:l product_code:s", lambda s: tb.article_product_codes(s.articles),
    "SELECT article_idx, product_code FROM art",
)
register(
    "last_full_week", "last_day:t last_week:i", lambda s: last_full_week(s.tx, CAL),
    "SELECT max(t_dat) AS last_day, floor(datediff('day', DATE '1994-12-28', max(t_dat) - 6) / 7e0) AS last_week FROM tx",
)


def raw_sales(s: Store):
    """Order lines with the outside ids, as an export would give them."""
    names = s.table("customer").select("c_custkey", F.col("c_name").alias("customer_id"))
    t = s.tx.join(names, F.col("customer_idx") == F.col("c_custkey"))
    return t.select(
        "t_dat", "customer_id", F.lpad(F.col("article_idx").cast("string"), 10, "0").alias("article_id"), "price", "sales_channel_id"
    )


def converted(s: Store):
    arts = tb.convert_articles(s.articles.drop("article_idx"))
    custs = tb.convert_customers(s.customers.drop("customer_idx"))
    return arts, custs, tb.convert_transactions(raw_sales(s), arts, custs, CAL)


CTE["dense_c"] = "SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS customer_idx FROM cust"
CTE["dense_a"] = "SELECT article_id, row_number() OVER (ORDER BY article_id) - 1 AS article_idx FROM art"
register(
    "dense_customer_keys", "customer_id:s customer_idx:l", lambda s: tb.dense_keys(s.customers.drop("customer_idx"), "customer_id", "customer_idx"),
    "SELECT * FROM dense_c",
)
register(
    "dense_article_keys", "article_id:s article_idx:l", lambda s: tb.convert_articles(s.articles.drop("article_idx")), "SELECT * FROM dense_a"
)
register(
    "convert_transactions", "t_dat:t customer_idx:l article_idx:l price:p sales_channel_id:i week_idx:i", lambda s: converted(s)[2],
    """SELECT t_dat, d.customer_idx, e.article_idx, price, sales_channel_id, week_idx FROM tx JOIN cust USING (customer_idx)
    JOIN dense_c d USING (customer_id) JOIN art ON art.article_idx = tx.article_idx JOIN dense_a e USING (article_id)""",
)
register(
    "verify_customers", "table_name:s check_name:s source_value:l stored_value:l passed:b",
    lambda s: qa.compare_tables("customers", s.customers.drop("customer_idx"), converted(s)[1], "customer_id"),
    "SELECT *, true AS passed FROM (" + " UNION ALL ".join(
        f"SELECT 'customers' AS table_name, '{n}' AS check_name, {e} AS source_value, {e} AS stored_value FROM cust"
        for n, e in [("rows", "count(*)"), ("distinct_ids", "count(DISTINCT customer_id)")]
        + [(f"nulls_{c}", f"count(*) - count({c})") for c in ("customer_id", "age", "FN", "Active", "club_member_status", "fashion_news_frequency")]
    ) + ")",
)
register(
    "verify_price_and_dates", "n_rows:l source_price_sum:d stored_price_sum:d price_ok:b dates_ok:b",
    lambda s: qa.compare_totals(raw_sales(s), converted(s)[2]).withColumn("source_price_sum", F.round("source_price_sum", 2)).withColumn(
        "stored_price_sum", F.round("stored_price_sum", 2)
    ),
    "SELECT count(*) AS n_rows, round(sum(price), 2) AS source_price_sum, round(sum(price), 2) AS stored_price_sum, true AS price_ok, true AS dates_ok FROM tx",
)


def _round_trip(s: Store):
    arts, custs, tx = converted(s)
    return qa.round_trip(raw_sales(s), tx, arts, custs)


register(
    "verify_round_trip", "n_only_in_source:l n_only_in_store:l", _round_trip,
    "SELECT count(*) - count(c_custkey) AS n_only_in_source, 0 AS n_only_in_store FROM tx LEFT JOIN customer ON c_custkey = customer_idx",
)
register(
    "verify_id_length", "n_ids:l n_wrong_length:l", lambda s: qa.id_lengths(s.articles),
    "SELECT count(*) AS n_ids, count(*) FILTER (length(article_id) <> 10) AS n_wrong_length FROM art",
)


def dictionary_sql(table: str, types: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS type, count(DISTINCT {c}) AS n_distinct, (count(*) - count({c})) * 100e0 / count(*) AS pct_null,
        (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS examples FROM {table}"""
        for c, t in types.items()
    )


_ART = {"article_idx": "bigint", "article_id": "string", "prod_name": "string", "product_code": "string", "product_type_no": "int",
        "product_type_name": "string", "product_group_name": "string", "index_group_name": "string", "garment_group_name": "string",
        "colour_group_name": "string", "section_name": "string", "department_name": "string", "department_no": "int"}
register(
    "column_dictionary_articles", "column_name:s type:s n_distinct:l pct_null:d examples:s",
    lambda s: pf.column_dictionary(s.articles.select(*_ART)), dictionary_sql("art", _ART),
)
_CUST = {"customer_idx": "bigint", "customer_id": "string", "age": "float", "FN": "float", "Active": "float", "club_member_status": "string", "fashion_news_frequency": "string"}
register(
    "column_dictionary_customers", "column_name:s type:s n_distinct:l pct_null:d examples:s",
    lambda s: pf.column_dictionary(s.customers.select(*_CUST)), dictionary_sql("cust", _CUST),
)
register(
    "duplicate_rows", "n_rows:l n_duplicates:l pct_duplicates:d n_repeated_lines:l pct_same_price:d", lambda s: pf.duplicate_rows(s.tx),
    """SELECT n_rows, n_duplicates, n_duplicates * 100e0 / n_rows AS pct_duplicates, n_repeated_lines, pct_same_price FROM
    (SELECT sum(n) AS n_rows, coalesce(sum(n) FILTER (n > 1), 0) AS n_duplicates FROM (SELECT count(*) AS n FROM tx GROUP BY ALL, customer_idx, article_idx, t_dat, price, sales_channel_id, week_idx)),
    (SELECT count(*) AS n_repeated_lines, avg(CASE WHEN sd < 1e-6 THEN 1e0 ELSE 0 END) * 100 AS pct_same_price FROM
      (SELECT count(*) AS n, stddev_samp(price) AS sd FROM tx GROUP BY customer_idx, article_idx, t_dat, sales_channel_id) WHERE n > 1)""".replace("GROUP BY ALL, ", "GROUP BY "),
)
register(
    "referential_integrity", "key:s n_used:l n_unknown:l n_never_used:l", lambda s: pf.referential_integrity(s.tx, s.customers, s.articles),
    " UNION ALL ".join(
        f"""SELECT '{k}' AS key, count(DISTINCT {k}) AS n_used, count(DISTINCT {k}) FILTER ({k} NOT IN (SELECT {k} FROM {t})) AS n_unknown,
        (SELECT count(*) FROM {t} ANTI JOIN tx USING ({k})) AS n_never_used FROM tx"""
        for k, t in (("customer_idx", "cust"), ("article_idx", "art"))
    ),
)
register(
    "category_counts", "column_name:s label:s n:l", lambda s: pf.category_counts(s.customers),
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS label, count(*) AS n FROM cust GROUP BY 2" for c in ("club_member_status", "fashion_news_frequency")),
)


def q_sql(value: str, points) -> str:
    return ", ".join(f"quantile_cont(CAST({value} AS DOUBLE), {p / 100}) AS p{p}" for p in points)


register(
    "age_summary", "n_values:l min_value:d max_value:d mean_value:d p5:d p25:d p50:d p75:d p95:d n_minor:l n_over_90:l",
    lambda s: pf.value_summary(s.customers, "age", {"n_minor": F.col("age") < 18, "n_over_90": F.col("age") > 90}),
    f"""SELECT count(age) AS n_values, min(age) AS min_value, max(age) AS max_value, avg(age) AS mean_value, {q_sql('age', (5, 25, 50, 75, 95))},
    count(*) FILTER (age < 18) AS n_minor, count(*) FILTER (age > 90) AS n_over_90 FROM cust""",
)
register(
    "price_summary", "n_values:l min_value:d max_value:d mean_value:d p5:d p25:d p50:d p75:d p95:d n_zero:l n_tiny:l n_over_1:l",
    lambda s: pf.value_summary(s.tx, "price", {"n_zero": F.col("price") == 0, "n_tiny": F.col("price") < 0.001, "n_over_1": F.col("price") > 1}),
    f"""SELECT count(price) AS n_values, min(price) AS min_value, max(price) AS max_value, avg(price) AS mean_value, {q_sql('price', (5, 25, 50, 75, 95))},
    count(*) FILTER (price = 0) AS n_zero, count(*) FILTER (price < 0.001) AS n_tiny, count(*) FILTER (price > 1) AS n_over_1 FROM tx""",
)
for _by, _k in (("t_dat", "t"), ("week_idx", "i")):
    register(
        f"volume_by_{'day' if _by == 't_dat' else 'week'}", f"{_by}:{_k} n_tx:l n_customers:l n_articles:l", lambda s, b=_by: pf.volume(s.tx, b),
        f"SELECT {_by}, count(*) AS n_tx, count(DISTINCT customer_idx) AS n_customers, count(DISTINCT article_idx) AS n_articles FROM tx GROUP BY 1",
    )
    register(
        f"debuts_by_{'day' if _by == 't_dat' else 'week'}", f"{_by}:{_k} n_debuts:l", lambda s, b=_by: pf.debuts(s.tx, b),
        f"SELECT f AS {_by}, count(*) AS n_debuts FROM (SELECT min({_by}) AS f FROM tx GROUP BY article_idx) GROUP BY 1",
    )
register(
    "weekday_pattern", "dow:i mean_tx:d n_days:l lift:d", lambda s: pf.weekday_pattern(s.tx),
    """SELECT dow, m AS mean_tx, n AS n_days, m / (avg(m) FILTER (dow < 5) OVER ()) AS lift FROM (SELECT isodow(t_dat) - 1 AS dow, avg(n) AS m, count(*) AS n
    FROM (SELECT t_dat, count(*) AS n FROM tx GROUP BY 1) GROUP BY 1)""",
)
register(
    "busiest_days", "t_dat:t n_tx:l n_customers:l", lambda s: pf.busiest_days(s.tx),
    "SELECT t_dat, count(*) AS n_tx, count(DISTINCT customer_idx) AS n_customers FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
register(
    "channel_share_by_week", "week_idx:i channel_1:l channel_2:l channel_2_pct:d", lambda s: pf.channel_share(s.tx),
    """SELECT week_idx, count(*) FILTER (sales_channel_id = 1) AS channel_1, count(*) FILTER (sales_channel_id = 2) AS channel_2,
    count(*) FILTER (sales_channel_id = 2) * 100e0 / count(*) AS channel_2_pct FROM tx GROUP BY 1""",
)
START = date(1995, 1, 25)
register(
    "debut_spikes", "t_dat:t n_debuts:l day_rank:i vs_median:d", lambda s: pf.debut_spikes(s.tx, START),
    f"""SELECT d AS t_dat, n AS n_debuts, rank() OVER (ORDER BY n DESC) AS day_rank, n / median(n) OVER () AS vs_median FROM (SELECT d, count(*) AS n FROM
    (SELECT min(t_dat) AS d FROM tx GROUP BY article_idx) WHERE d >= DATE '{START}' GROUP BY 1) ORDER BY n DESC, d LIMIT 5""",
)
DIST = "n_values:l mean_value:d min_value:d max_value:d pct_one:d "


def distribution(name: str, fn, value: str, points, source: str) -> None:
    register(
        name, DIST + " ".join(f"p{p}:d" for p in points), lambda s: pf.distribution(fn(s), value, points),
        f"""SELECT count(v) AS n_values, avg(v) AS mean_value, min(v) AS min_value, max(v) AS max_value,
        avg(CASE WHEN v = 1 THEN 1e0 ELSE 0 END) * 100 AS pct_one, {q_sql('v', points)} FROM ({source})""",
    )


distribution("purchases_per_customer", lambda s: pf.purchases_per_customer(s.tx), "n_purchases", (25, 50, 75, 90, 99), "SELECT count(*) AS v FROM tx GROUP BY customer_idx")
distribution("active_weeks_per_customer", lambda s: pf.active_weeks(s.tx), "n_active_weeks", (25, 50, 75, 90, 99), "SELECT count(DISTINCT week_idx) AS v FROM tx GROUP BY customer_idx")
distribution("basket_size_distribution", lambda s: pf.basket_sizes(s.tx), "basket_size", (50, 75, 90, 95, 99), "SELECT count(DISTINCT article_idx) AS v FROM tx GROUP BY customer_idx, t_dat")
distribution(
    "recency_distribution", lambda s: pf.recency(s.tx), "recency_days", (10, 25, 50, 75, 90),
    "SELECT datediff('day', max(t_dat), (SELECT max(t_dat) FROM tx)) AS v FROM tx GROUP BY customer_idx",
)
distribution(
    "purchase_gaps", lambda s: pf.purchase_gaps(s.tx), "gap_days", (25, 50, 75, 90),
    """SELECT v FROM (SELECT datediff('day', lag(t_dat) OVER (PARTITION BY customer_idx ORDER BY t_dat), t_dat) AS v
    FROM (SELECT DISTINCT customer_idx, t_dat FROM tx)) WHERE v IS NOT NULL""",
)
distribution(
    "article_lifespans", lambda s: pf.lifespans(s.tx), "lifespan_days", (25, 50, 75, 90),
    "SELECT datediff('day', min(t_dat), max(t_dat)) AS v FROM tx GROUP BY article_idx",
)
CTE["pvar"] = """SELECT article_idx, count(*) AS n_tx, CASE WHEN avg(price) <> 0 THEN stddev_samp(price) / avg(price) END AS cv,
  CASE WHEN max(price) <> 0 THEN (max(price) - min(price)) / max(price) END AS discount_range FROM tx GROUP BY 1 HAVING count(*) >= 10"""
register("price_variation", "article_idx:l n_tx:l cv:d discount_range:d", lambda s: pf.price_variation(s.tx), "SELECT * FROM pvar")
distribution("price_cv_distribution", lambda s: pf.price_variation(s.tx), "cv", (25, 50, 75, 90), "SELECT cv AS v FROM pvar")
register(
    "purchase_tiers", "tier:s n_customers:l pct:d", lambda s: pf.purchase_tiers(s.tx, s.customers),
    """SELECT tier, count(*) AS n_customers, count(*) * 100e0 / (SELECT count(*) FROM cust) AS pct FROM (SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1'
    WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS tier FROM (SELECT c.customer_idx, count(t.article_idx) AS n FROM cust c
      LEFT JOIN tx t USING (customer_idx) GROUP BY 1)) GROUP BY 1""",
)
for _c in ("club_member_status", "fashion_news_frequency"):
    register(
        f"activity_by_{_c}", f"{_c}:s n_customers:l mean_purchases:d median_purchases:d", lambda s, c=_c: pf.activity_by_category(s.tx, s.customers, c),
        f"""SELECT {_c}, count(*) AS n_customers, avg(n) AS mean_purchases, median(n) AS median_purchases FROM (SELECT c.customer_idx, any_value({_c}) AS {_c},
        count(t.article_idx) AS n FROM cust c LEFT JOIN tx t USING (customer_idx) GROUP BY 1) WHERE {_c} IS NOT NULL GROUP BY 1""",
    )
register(
    "sales_concentration", "n_articles:l gini:d top_1_pct_share:d top_10_pct_share:d", lambda s: pf.concentration(s.tx),
    """SELECT n AS n_articles, 1 - 2 * (sum(l) - (arg_min(l, r) + arg_max(l, r)) / 2) / (n - 1) AS gini,
    sum(v) FILTER (r > n - ceil(n * 0.01e0)) * 100e0 / sum(v) AS top_1_pct_share, sum(v) FILTER (r > n - ceil(n * 0.1e0)) * 100e0 / sum(v) AS top_10_pct_share
    FROM (SELECT v, row_number() OVER (ORDER BY v, article_idx) AS r, count(*) OVER () AS n,
      sum(v) OVER (ORDER BY v, article_idx ROWS UNBOUNDED PRECEDING) * 1e0 / sum(v) OVER () AS l FROM (SELECT article_idx, count(*) AS v FROM tx GROUP BY 1)) GROUP BY n""",
)
_CATS = ("product_group_name", "index_group_name", "garment_group_name", "colour_group_name")
register(
    "sales_by_category", "column_name:s label:s n_sales:l rank:i", lambda s: pf.sales_by_category(s.tx, s.articles, _CATS),
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS label, count(t.customer_idx) AS n_sales, row_number() OVER (ORDER BY count(t.customer_idx) DESC, {c}) AS rank
        FROM art LEFT JOIN tx t USING (article_idx) GROUP BY {c}) WHERE rank <= 15"""
        for c in _CATS
    ),
)
CTE["wsales"] = "SELECT article_idx, week_idx, count(*) AS n FROM tx GROUP BY 1, 2"
register(
    "decay_of_best_sellers", "weeks_since_debut:i n_articles:l mean_sales:d median_sales:d", lambda s: pf.decay_of_best_sellers(s.tx),
    """SELECT week_idx - debut AS weeks_since_debut, count(*) AS n_articles, avg(n) AS mean_sales, median(n) AS median_sales FROM wsales JOIN
    (SELECT article_idx, min(week_idx) AS debut FROM tx GROUP BY 1 ORDER BY count(*) DESC, article_idx LIMIT 500) USING (article_idx) WHERE week_idx - debut <= 20 GROUP BY 1""",
)
CTE["decay"] = f"""SELECT w AS weeks_since_debut, count(*) AS n_articles, median(coalesce(n, 0)) AS median_sales FROM (SELECT article_idx, debut, unnest(range(0, least(40, {WEEK} - debut) + 1)) AS w
  FROM (SELECT article_idx, min(week_idx) AS debut, min(t_dat) AS d FROM tx GROUP BY 1) WHERE d >= DATE '{START}') g LEFT JOIN wsales s
  ON s.article_idx = g.article_idx AND s.week_idx = g.debut + g.w GROUP BY 1"""
_DEC = "SELECT *, CASE WHEN (SELECT max(median_sales) FROM decay WHERE weeks_since_debut = 1) <> 0 THEN median_sales * 100 / (SELECT max(median_sales) FROM decay WHERE weeks_since_debut = 1) END AS pct_of_week_1 FROM decay"
register(
    "decay_of_all_articles", "weeks_since_debut:i n_articles:l median_sales:d pct_of_week_1:d", lambda s: pf.decay_of_all_articles(s.tx, START, WEEK), _DEC
)
register(
    "popularity_half_life", "half_life_week:i", lambda s: pf.half_life(pf.decay_of_all_articles(s.tx, START, WEEK)),
    f"SELECT min(weeks_since_debut) FILTER (pct_of_week_1 < 50) AS half_life_week FROM ({_DEC})",
)
register(
    "price_by_group", "product_group_name:s n_tx:l q1_price:p median_price:p q3_price:p", lambda s: pf.price_by_group(s.tx, s.articles),
    """SELECT product_group_name, count(*) AS n_tx, quantile_cont(price, 0.25) AS q1_price, quantile_cont(price, 0.5) AS median_price, quantile_cont(price, 0.75) AS q3_price
    FROM tx JOIN art USING (article_idx) GROUP BY 1""",
)
CTE["overlap"] = " UNION ALL ".join(
    f"""SELECT {k} AS k, p.week_idx, count(x.article_idx) AS shared, count(x.article_idx) * 1e0 / (any_value(np.n) + any_value(nn.n) - count(x.article_idx)) AS j FROM wpairs p
    JOIN (SELECT week_idx, count(*) AS n FROM wtop WHERE r <= {k} GROUP BY 1) nn ON nn.week_idx = p.week_idx
    JOIN (SELECT week_idx, count(*) AS n FROM wtop WHERE r <= {k} GROUP BY 1) np ON np.week_idx = p.prev_week
    LEFT JOIN wtop c ON c.week_idx = p.week_idx AND c.r <= {k} LEFT JOIN wtop x ON x.week_idx = p.prev_week AND x.article_idx = c.article_idx AND x.r <= {k} GROUP BY p.week_idx"""
    for k in (12, 100)
)
CTE["wtop"] = "SELECT week_idx, article_idx, row_number() OVER (PARTITION BY week_idx ORDER BY n DESC, article_idx) AS r FROM wsales WHERE week_idx >= 1"
CTE["wpairs"] = "SELECT * FROM (SELECT week_idx, lag(week_idx) OVER (ORDER BY week_idx) AS prev_week FROM (SELECT DISTINCT week_idx FROM wtop)) WHERE prev_week IS NOT NULL"
_OV = "SELECT a.week_idx, a.shared AS shared_12, a.j AS jaccard_12, b.shared AS shared_100, b.j AS jaccard_100 FROM overlap a JOIN overlap b ON a.week_idx = b.week_idx AND a.k = 12 AND b.k = 100"
register("weekly_overlap", "week_idx:i shared_12:l jaccard_12:d shared_100:l jaccard_100:d", lambda s: pf.weekly_overlap(s.tx), _OV)
register(
    "weekly_overlap_summary", "n_pairs:l median_jaccard_12:d median_jaccard_100:d median_shared_12:d n_zero_overlap_12:l",
    lambda s: pf.overlap_summary(pf.weekly_overlap(s.tx)),
    f"""SELECT count(*) AS n_pairs, median(jaccard_12) AS median_jaccard_12, median(jaccard_100) AS median_jaccard_100, median(shared_12) AS median_shared_12,
    count(*) FILTER (jaccard_12 = 0) AS n_zero_overlap_12 FROM ({_OV})""",
)
register(
    "repeat_rates", "level:s n_tx:l n_repeat:l repeat_rate:d", lambda s: pf.repeat_rates(s.tx, s.articles),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS level, count(*) AS n_tx, count(*) FILTER (t_dat > f) AS n_repeat, count(*) FILTER (t_dat > f) * 1e0 / count(*) AS repeat_rate FROM
        (SELECT t_dat, min(t_dat) OVER (PARTITION BY customer_idx, {'tx.article_idx' if c == 'article_idx' else c}) AS f FROM tx JOIN art USING (article_idx))"""
        for c in ("article_idx", "product_code", "product_type_name")
    ),
)
register(
    "repeat_rate_by_group", "product_group_name:s n_tx:l repeat_rate:d", lambda s: pf.repeat_rate_by_group(s.tx, s.articles),
    """SELECT product_group_name, count(*) AS n_tx, avg(CASE WHEN t_dat > f THEN 1e0 ELSE 0 END) AS repeat_rate FROM (SELECT article_idx, t_dat,
    min(t_dat) OVER (PARTITION BY customer_idx, article_idx) AS f FROM tx) JOIN art USING (article_idx) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""",
)
register(
    "cold_start_shares", "n_buyers:l pct_no_history:d pct_1_to_4:d pct_5_or_more:d n_articles:l n_new_articles:l pct_new_articles:d",
    lambda s: pf.cold_start(s.history, s.truth),
    """SELECT count(*) AS n_buyers, avg(CASE WHEN prior_count = 0 THEN 1e0 ELSE 0 END) * 100 AS pct_no_history, avg(CASE WHEN prior_count BETWEEN 1 AND 4 THEN 1e0 ELSE 0 END) * 100 AS pct_1_to_4,
    avg(CASE WHEN prior_count >= 5 THEN 1e0 ELSE 0 END) * 100 AS pct_5_or_more, any_value((SELECT count(DISTINCT article_idx) FROM truth)) AS n_articles,
    any_value((SELECT count(DISTINCT article_idx) FROM truth ANTI JOIN hist USING (article_idx))) AS n_new_articles,
    any_value((SELECT count(DISTINCT article_idx) FROM truth ANTI JOIN hist USING (article_idx)) * 100e0 / (SELECT count(DISTINCT article_idx) FROM truth)) AS pct_new_articles FROM prior""",
)
register(
    "top_copurchased_pairs", "article_a:l article_b:l pair_count:l name_a:s name_b:s", lambda s: pf.top_pairs(s.tx, WEEK + 2, 400, s.articles),
    """SELECT x.article_idx AS article_a, y.article_idx AS article_b, count(*) AS pair_count, any_value(p.prod_name) AS name_a, any_value(q.prod_name) AS name_b
    FROM (SELECT DISTINCT customer_idx, t_dat, article_idx FROM tx) x JOIN (SELECT DISTINCT customer_idx, t_dat, article_idx FROM tx) y
    ON x.customer_idx = y.customer_idx AND x.t_dat = y.t_dat AND x.article_idx < y.article_idx JOIN art p ON p.article_idx = x.article_idx JOIN art q ON q.article_idx = y.article_idx
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
register(
    "multi_variant_baskets", "n_multi_variant:l n_multi_article:l pct_multi_variant:d", lambda s: pf.multi_variant_baskets(s.tx, WEEK + 2, 400, s.articles),
    """SELECT a AS n_multi_variant, b AS n_multi_article, a * 100e0 / b AS pct_multi_variant FROM
    (SELECT count(*) AS a FROM (SELECT 1 FROM tx JOIN art USING (article_idx) GROUP BY customer_idx, t_dat, product_code HAVING count(DISTINCT article_idx) >= 2)),
    (SELECT count(*) AS b FROM (SELECT 1 FROM tx GROUP BY customer_idx, t_dat HAVING count(DISTINCT article_idx) >= 2))""",
)
