"""Segments, experiment statistics and association tests."""

from pyspark.sql import functions as F

from checks.base import CAL, CTE, WEEK, Store, register
from checks.features import frame
from checks.metrics import B, boot_cte, lists, outcomes
from shelfwise.functions.columns import hash_uniform
from shelfwise.operators import experiment as ex
from shelfwise.operators import metrics as mt
from shelfwise.operators import segments as sg
from shelfwise.operators import signal as si
from shelfwise.operators.candidate_eval import oracle_bound
from shelfwise.plans import evaluation as pe
from shelfwise.schema import FEATURE_NAMES


def cdf(z: str) -> str:
    """Normal distribution function: Abramowitz-Stegun 7.1.26."""
    t = f"(1e0 / (1e0 + 0.3275911e0 * (abs({z}) / sqrt(2e0))))"
    poly = f"((((1.061405429e0 * {t} + -1.453152027e0) * {t} + 1.421413741e0) * {t} + -0.284496736e0) * {t} + 0.254829592e0)"
    erf = f"(1e0 - {poly} * {t} * exp(-({z}) * ({z}) / 2e0))"
    return f"CASE WHEN {z} >= 0 THEN (1e0 + {erf}) / 2 ELSE (1e0 - {erf}) / 2 END"


def z_sql(table: str) -> str:
    """p_a, p_b, z, p_value, effect and interval from hits_a, n_a, hits_b, n_b."""
    return f"""SELECT *, 2e0 * (1e0 - ({cdf('abs(z)')})) AS p_value FROM (SELECT *, p_b - p_a AS effect,
      CASE WHEN s0 <> 0 THEN (p_b - p_a) / s0 ELSE 0 END AS z, p_b - p_a - 1.959963984540054e0 * s1 AS ci_lo,
      p_b - p_a + 1.959963984540054e0 * s1 AS ci_hi FROM (SELECT *, sqrt(pool * (1 - pool) * (1e0 / n_a + 1e0 / n_b)) AS s0,
        sqrt(p_a * (1 - p_a) / n_a + p_b * (1 - p_b) / n_b) AS s1 FROM (SELECT *, hits_a * 1e0 / n_a AS p_a, hits_b * 1e0 / n_b AS p_b,
          (hits_a + hits_b) * 1e0 / (n_a + n_b) AS pool FROM {table})))"""


CTE["seg_stats"] = """SELECT e.customer_idx, count(h.article_idx) AS n, avg(CASE WHEN h.article_idx IS NULL THEN NULL WHEN sales_channel_id = 2 THEN 1e0 ELSE 0 END) AS online,
  max(t_dat) AS last FROM evalc e LEFT JOIN hist h USING (customer_idx) GROUP BY 1"""
CTE["seg_cut"] = """SELECT CASE WHEN count(online) >= 3 THEN quantile_cont(online, 0.3333) ELSE 0.33 END AS lo,
  CASE WHEN count(online) >= 3 THEN quantile_cont(online, 0.6667) ELSE 0.67 END AS hi FROM seg_stats"""
CTE["new_art"] = "SELECT DISTINCT customer_idx FROM truth ANTI JOIN (SELECT DISTINCT article_idx FROM hist SEMI JOIN evalc USING (customer_idx)) USING (article_idx)"
CTE["segwide"] = f"""SELECT s.customer_idx, CASE WHEN n = 0 THEN '0' WHEN n <= 4 THEN '1-4' WHEN n <= 19 THEN '5-19' ELSE '20+' END AS prior_purchases,
  coalesce(age_bucket, 'missing') AS age_bucket, CASE WHEN online IS NULL THEN 'no_history' WHEN online <= lo THEN 'low_online'
  WHEN online <= hi THEN 'mid_online' ELSE 'high_online' END AS channel_tertile,
  CASE WHEN last IS NULL THEN 'never' WHEN d <= 7 THEN '<=7' WHEN d <= 30 THEN '8-30' WHEN d <= 90 THEN '31-90' ELSE '91+' END AS recency,
  CASE WHEN s.customer_idx IN (SELECT customer_idx FROM new_art) THEN 'buys_new_article' ELSE 'no_new_article' END AS new_article_buyer
  FROM (SELECT *, datediff('day', last, DATE '1994-12-28' + {WEEK * 7}) AS d FROM seg_stats) s LEFT JOIN bucket USING (customer_idx), seg_cut"""
CTE["xseg"] = " UNION ALL ".join(f"SELECT customer_idx, '{f}' AS family, {f} AS segment FROM segwide" for f in sg.FAMILIES)


def segments(s: Store):
    return sg.extended_segments(s.history, s.customers, s.truth, WEEK, CAL)


register("extended_segments", "customer_idx:l family:s segment:s", segments, "SELECT * FROM xseg")
register(
    "segment_map", "family:s segment:s n:l map:d",
    lambda s: sg.segment_map(mt.per_customer_metrics(lists(s)["heuristic"], s.truth), segments(s)),
    "SELECT family, segment, count(*) AS n, avg(ap) AS map FROM u_heuristic JOIN xseg USING (customer_idx) GROUP BY 1, 2",
)
HOLM = """SELECT *, least(1e0, max(({p} * (m - i + 1))) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)) AS {p}_adj FROM
  (SELECT *, row_number() OVER (ORDER BY {p}, family, segment) AS i, count(*) OVER () AS m FROM {t})"""
CTE["seg_out"] = "SELECT * FROM outcomes JOIN xseg USING (customer_idx)"
register(
    "segment_tests",
    "family:s segment:s n:l map_ranker:d map_heuristic:d mean_diff:d ci_lo:d ci_hi:d ci_excludes_zero:b p_bootstrap:d p_bootstrap_adj:d t:d flagged:b",
    lambda s: sg.segment_tests(outcomes(s), segments(s), B),
    "SELECT *, NOT ci_excludes_zero AS flagged FROM (" + HOLM.format(p="p_bootstrap", t="seg_t") + ")",
    {
        "seg_p": """SELECT family, segment, count(*) AS n, avg(ranker_ap) AS map_ranker, avg(heuristic_ap) AS map_heuristic,
          avg(ranker_ap - heuristic_ap) AS mean_diff, CASE WHEN stddev_samp(ranker_ap - heuristic_ap) <> 0
          THEN avg(ranker_ap - heuristic_ap) / (stddev_samp(ranker_ap - heuristic_ap) / sqrt(count(*))) END AS t FROM seg_out GROUP BY 1, 2""",
        "reps": boot_cte("seg_out", "customer_idx", {"d": ("ranker_ap - heuristic_ap", "1e0")}, B, groups="family, segment"),
        "seg_t": """SELECT any_value(p).*, quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi,
          quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS ci_excludes_zero,
          least(1, 2e0 * (count(*) FILTER (CASE WHEN mean_diff > 0 THEN d <= 0 ELSE d >= 0 END) + 1) / (count(d) + 1)) AS p_bootstrap
          FROM seg_p p JOIN reps USING (family, segment) GROUP BY p.family, p.segment""".replace(
            "any_value(p).*",
            "p.family, p.segment, any_value(n) AS n, any_value(map_ranker) AS map_ranker, any_value(map_heuristic) AS map_heuristic, "
            "any_value(mean_diff) AS mean_diff, any_value(t) AS t",
        ),
    },
)
register(
    "segment_ttests", "family:s segment:s n:l mean_diff:d t:d p_value:d p_adj:d",
    lambda s: sg.segment_ttests(outcomes(s), segments(s)),
)
register(
    "segment_paired_t", "family:s segment:s n:l mean_diff:d t:d",
    lambda s: ex.paired_t(outcomes(s).join(segments(s), "customer_idx"), ["family", "segment"], "ranker_ap", "heuristic_ap"),
    """SELECT family, segment, count(*) AS n, avg(ranker_ap - heuristic_ap) AS mean_diff, CASE WHEN stddev_samp(ranker_ap - heuristic_ap) <> 0
    THEN avg(ranker_ap - heuristic_ap) / (stddev_samp(ranker_ap - heuristic_ap) / sqrt(count(*))) END AS t FROM seg_out GROUP BY 1, 2""",
)

# --- experiment -------------------------------------------------------------------

_U = "CAST('0x' || substr(md5(customer_idx || '|42'), 1, 8) AS BIGINT) / 4294967296e0"
CTE["arms"] = f"""SELECT customer_idx, CASE WHEN row_number() OVER (ORDER BY {_U}, customer_idx) <= (SELECT count(*) // 2 FROM outcomes) THEN 'A' ELSE 'B' END AS arm
  FROM outcomes"""


def arms(s: Store, users=None):
    return ex.assign_arms(s.eval_customers if users is None else users)


register(
    "assign_arms_all_customers", "customer_idx:l arm:s",
    lambda s: ex.assign_arms(s.customers.select("customer_idx")),
    f"""SELECT customer_idx, CASE WHEN row_number() OVER (ORDER BY {_U}, customer_idx) <= (SELECT count(*) // 2 FROM cust) THEN 'A' ELSE 'B' END AS arm FROM cust""",
)
Z = "n_a:l n_b:l p_a:d p_b:d z:d"
CTE["replay"] = """SELECT count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b, sum(heuristic_hit) FILTER (arm = 'A') AS hits_a,
  sum(ranker_hit) FILTER (arm = 'B') AS hits_b, avg(heuristic_ap) FILTER (arm = 'A') AS mean_a, avg(ranker_ap) FILTER (arm = 'B') AS mean_b,
  var_samp(heuristic_ap) FILTER (arm = 'A') AS va, var_samp(ranker_ap) FILTER (arm = 'B') AS vb FROM outcomes JOIN arms USING (customer_idx)"""
register(
    "replay_comparison",
    Z + " z_p_value:d hit_effect:d hit_ci_lo:d hit_ci_hi:d mean_a:d mean_b:d t:d dof:d ap_effect:d ap_ci_lo:d ap_ci_hi:d",
    lambda s: ex.replay_comparison(outcomes(s), arms(s)),
    f"""SELECT n_a, n_b, p_a, p_b, z, p_value AS z_p_value, effect AS hit_effect, ci_lo AS hit_ci_lo, ci_hi AS hit_ci_hi, mean_a, mean_b,
    (mean_b - mean_a) / sqrt(va / n_a + vb / n_b) AS t, power(va / n_a + vb / n_b, 2) / (power(va / n_a, 2) / (n_a - 1) + power(vb / n_b, 2) / (n_b - 1)) AS dof,
    mean_b - mean_a AS ap_effect, mean_b - mean_a - 1.959963984540054e0 * sqrt(va / n_a + vb / n_b) AS ap_ci_lo,
    mean_b - mean_a + 1.959963984540054e0 * sqrt(va / n_a + vb / n_b) AS ap_ci_hi FROM ({z_sql('replay')})""",
)
register(
    "guardrails_by_arm", "arm:s coverage:d popularity_bias:d n_customers:l",
    lambda s: ex.guardrails(lists(s)["heuristic"], arms(s), mt.article_popularity_ranks(s.history)),
    """SELECT arm, any_value(cov) AS coverage, avg(r) AS popularity_bias, count(*) AS n_customers FROM
    (SELECT arm, customer_idx, avg(pop_rank) AS r FROM preds JOIN arms USING (customer_idx) LEFT JOIN art_rank USING (article_idx) GROUP BY 1, 2)
    JOIN (SELECT arm, count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) AS cov FROM preds JOIN arms USING (customer_idx) GROUP BY 1) USING (arm) GROUP BY arm""",
)
SPLITS = 200


def repeat_buyers(s: Store):
    """Every customer, marked when an article was bought on two days: a rate on the whole base."""
    r = pe.customer_repeat_rates(s.history)
    return r.select("customer_idx", F.when(F.col("rate") > 0, 1.0).otherwise(0.0).alias("hit"))


CTE["rebuyers"] = """SELECT customer_idx, max(CASE WHEN d > 1 THEN 1e0 ELSE 0 END) AS hit FROM
  (SELECT customer_idx, article_idx, count(DISTINCT t_dat) AS d FROM hist GROUP BY 1, 2) GROUP BY 1"""
CTE["splits"] = f"""SELECT split, count(*) FILTER (u < 0.5) AS n_a, count(*) FILTER (u >= 0.5) AS n_b, coalesce(sum(hit) FILTER (u < 0.5), 0) AS hits_a,
  coalesce(sum(hit) FILTER (u >= 0.5), 0) AS hits_b FROM (SELECT *, CAST('0x' || substr(md5(customer_idx || '|' || (split // 4) || '|42'),
  CAST((split % 4) * 8 + 1 AS INTEGER), 8) AS BIGINT) / 4294967296e0 AS u FROM rebuyers, (SELECT unnest(range(0, {SPLITS})) AS split)) GROUP BY split"""
register(
    "split_tests", "split:i n_a:l n_b:l z:d p_value:d", lambda s: ex.split_tests(repeat_buyers(s), "hit", SPLITS), z_sql("splits")
)
register(
    "aa_calibration", "n_splits:l n_rejected:l rejection_rate:d ci_lo:d ci_hi:d",
    lambda s: ex.aa_calibration(repeat_buyers(s), "hit", SPLITS),
    f"""SELECT n AS n_splits, k AS n_rejected, k * 1e0 / n AS rejection_rate, k * 1e0 / n - 1.959963984540054e0 * sqrt(k * 1e0 / n * (1 - k * 1e0 / n) / n) AS ci_lo,
    k * 1e0 / n + 1.959963984540054e0 * sqrt(k * 1e0 / n * (1 - k * 1e0 / n) / n) AS ci_hi
    FROM (SELECT count(*) AS n, count(*) FILTER (p_value < 0.05) AS k FROM ({z_sql('splits')}))""",
)


def arrivals(s: Store):
    from shelfwise.sources.retail_view import transactions

    week = transactions(s.spark, s.folder, first_week=WEEK, before_week=WEEK + 1)
    return week.groupBy("customer_idx").agg(F.min("t_dat").alias("day"))


CTE["looks"] = f"""SELECT day, sum(na) OVER w AS n_a, sum(nb) OVER w AS n_b, sum(ha) OVER w AS hits_a, sum(hb) OVER w AS hits_b FROM (
  SELECT day, count(*) FILTER (arm = 'A') AS na, count(*) FILTER (arm = 'B') AS nb, coalesce(sum(heuristic_hit) FILTER (arm = 'A'), 0) AS ha,
  coalesce(sum(ranker_hit) FILTER (arm = 'B'), 0) AS hb FROM outcomes JOIN arms USING (customer_idx)
  JOIN (SELECT customer_idx, min(t_dat) AS day FROM tx WHERE week_idx = {WEEK} GROUP BY 1) USING (customer_idx) GROUP BY day)
  WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)"""
register(
    "sequential_looks", "day:t n_a:l n_b:l hits_a:d hits_b:d z:d p_value:d first_crossing:b",
    lambda s: ex.sequential_looks(outcomes(s), arms(s), arrivals(s)),
    f"""SELECT *, coalesce(day = (SELECT min(day) FROM ({z_sql('(SELECT * FROM looks WHERE n_a > 0 AND n_b > 0)')}) WHERE p_value < 0.05), false) AS first_crossing
    FROM ({z_sql('(SELECT * FROM looks WHERE n_a > 0 AND n_b > 0)')})""",
)


def cuped_users(s: Store):
    """Target-week units against units of the 52 weeks before, both over every customer."""
    t = s.tx.filter(F.col("week_idx") < WEEK + 1)
    use = t.groupBy("customer_idx").agg(
        F.count(F.when(F.col("week_idx") >= WEEK - 26, 1)).cast("double").alias("metric"),
        F.count(F.when((F.col("week_idx") < WEEK - 26) & (F.col("week_idx") >= WEEK - 78), 1)).cast("double").alias("pre_units"),
        F.avg(F.when(F.col("week_idx") < WEEK - 26, F.col("price"))).alias("pre_price"),
    )
    u = F.when(hash_uniform(42, F.col("customer_idx")) < 0.5, "A").otherwise("B")
    return use.withColumn("arm", u).na.fill(0.0, ["pre_price"])


CTE["cuped_u"] = f"""SELECT customer_idx, CASE WHEN {_U} < 0.5 THEN 'A' ELSE 'B' END AS arm, count(*) FILTER (week_idx >= {WEEK - 26}) * 1e0 AS metric,
  count(*) FILTER (week_idx < {WEEK - 26} AND week_idx >= {WEEK - 78}) * 1e0 AS pre_units, coalesce(avg(price) FILTER (week_idx < {WEEK - 26}), 0) AS pre_price
  FROM tx WHERE week_idx <= {WEEK} GROUP BY customer_idx"""
CUPED = "theta:d x_mean:d corr:d r_squared:d n_factor:d var_unadjusted:d var_adjusted:d variance_reduction_pct:d t_unadjusted:d t_adjusted:d"


def cuped_sql(x: str) -> str:
    return f"""SELECT '{x}' AS covariate, any_value(theta) AS theta, any_value(xm) AS x_mean, any_value(r) AS corr, any_value(r * r) AS r_squared,
    any_value(1 - r * r) AS n_factor, var_samp(metric) AS var_unadjusted, var_samp(adj) AS var_adjusted,
    (1 - var_samp(adj) / var_samp(metric)) * 100 AS variance_reduction_pct,
    (avg(metric) FILTER (arm = 'B') - avg(metric) FILTER (arm = 'A')) / sqrt(var_samp(metric) FILTER (arm = 'B') / count(*) FILTER (arm = 'B')
      + var_samp(metric) FILTER (arm = 'A') / count(*) FILTER (arm = 'A')) AS t_unadjusted,
    (avg(adj) FILTER (arm = 'B') - avg(adj) FILTER (arm = 'A')) / sqrt(var_samp(adj) FILTER (arm = 'B') / count(*) FILTER (arm = 'B')
      + var_samp(adj) FILTER (arm = 'A') / count(*) FILTER (arm = 'A')) AS t_adjusted
    FROM (SELECT *, metric - theta * ({x} - xm) AS adj FROM cuped_u, (SELECT covar_samp(metric, {x}) / var_samp({x}) AS theta, avg({x}) AS xm,
      corr({x}, metric) AS r FROM cuped_u))"""


register(
    "cuped_two_covariates", "covariate:s " + CUPED,
    lambda s: ex.cuped(cuped_users(s), "metric", "pre_units").withColumn("covariate", F.lit("pre_units")).unionByName(
        ex.cuped(cuped_users(s), "metric", "pre_price").withColumn("covariate", F.lit("pre_price"))
    ),
    cuped_sql("pre_units") + " UNION ALL " + cuped_sql("pre_price"),
)


def base_rates(s: Store):
    """Repeat-buyer rate per age bucket, measured on all customers with history."""
    from shelfwise.functions.columns import age_bucket

    b = s.customers.select("customer_idx", age_bucket(F.col("age")).alias("segment"))
    return repeat_buyers(s).join(b, "customer_idx").groupBy("segment").agg(
        F.count("*").alias("n_customers"), F.avg("hit").alias("base_rate")
    ).filter((F.col("base_rate") > 0) & (F.col("base_rate") < 1))


_N = """ceil(power(1.959963984540054e0 * sqrt(2 * ((p0 + p1) / 2) * (1 - (p0 + p1) / 2)) + 0.8416212335729143e0 * sqrt(p0 * (1 - p0) + p1 * (1 - p1)), 2) / power(p1 - p0, 2))"""
_ZP = "(abs(p1 - p0) * sqrt(h) - 1.959963984540054e0 * sqrt(2 * ((p0 + p1) / 2) * (1 - (p0 + p1) / 2))) / sqrt(p0 * (1 - p0) + p1 * (1 - p1))"
register(
    "power_table", "segment:s n_customers:l base_rate:d lift:d p_treat:d n_per_arm:l n_total:l weeks:d power:d mde:d cohen_h:d",
    lambda s: ex.power_table(base_rates(s)),
    f"""SELECT segment, n AS n_customers, p0 AS base_rate, lift, p1 AS p_treat, k AS n_per_arm, k * 2 AS n_total, k / h AS weeks,
    CASE WHEN p1 < 1 THEN {cdf(_ZP)} END AS power, (1.959963984540054e0 + 0.8416212335729143e0) * sqrt(2 * p0 * (1 - p0) / h) AS mde,
    CASE WHEN p1 < 1 THEN abs(2 * (asin(sqrt(p1)) - asin(sqrt(p0)))) END AS cohen_h
    FROM (SELECT *, CASE WHEN p1 < 1 THEN {_N} END AS k FROM (SELECT segment, n, p0, n / 2e0 AS h, lift, p0 * (1 + lift) AS p1 FROM
      (SELECT age_bucket AS segment, count(*) AS n, avg(hit) AS p0 FROM rebuyers JOIN bucket USING (customer_idx) GROUP BY 1),
      (SELECT unnest([0.01e0, 0.02e0, 0.05e0, 0.1e0]) AS lift) WHERE p0 > 0 AND p0 < 1))""",
)
register(
    "holdout_report", "model:s n_eval_customers:l map:d ndcg:d recall:d precision:d hit_rate:d coverage:d pop_bias:d",
    lambda s: pe.compare_models(lists(s), s.truth, s.history, "base_a", 40)[0],
    " UNION ALL ".join(
        f"""SELECT '{m}' AS model, count(*) AS n_eval_customers, avg(ap) AS map, avg(ndcg) AS ndcg, avg(recall) AS recall, avg(precision) AS precision,
        avg(hit) FILTER (has_preds) AS hit_rate, (SELECT count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) FROM {p}) AS coverage,
        (SELECT avg(r) FROM (SELECT avg(pop_rank) AS r FROM {p} LEFT JOIN art_rank USING (article_idx) GROUP BY customer_idx)) AS pop_bias FROM u_{m}"""
        for m, p in (("heuristic", "preds"), ("base_a", "base_a"), ("base_b", "base_b"), ("base_raw", "base_raw"))
    ),
)
register(
    "holdout_differences", "model:s n:l mean_a:d mean_b:d mean_diff:d ci_lo:d ci_hi:d lift_pct:d",
    lambda s: pe.compare_models(lists(s), s.truth, s.history, "base_a", B)[1],
    """SELECT model, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_diff, any_value(lo) AS ci_lo, any_value(hi) AS ci_hi,
    CASE WHEN avg(b) <> 0 THEN avg(a - b) / avg(b) * 100 END AS lift_pct FROM prs JOIN (SELECT model, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi
      FROM reps GROUP BY 1) USING (model) GROUP BY model""",
    {
        "prs": " UNION ALL ".join(
            f"SELECT '{m}' AS model, customer_idx, x.ap AS a, y.ap AS b FROM u_{m} x JOIN u_base_a y USING (customer_idx)"
            for m in ("heuristic", "base_b", "base_raw")
        ),
        "reps": boot_cte("prs", "customer_idx", {"d": ("a - b", "1e0")}, B, groups="model"),
    },
)

# --- association --------------------------------------------------------------------

CTE["cust_n"] = "SELECT customer_idx, count(*) AS n, avg(CASE WHEN sales_channel_id = 2 THEN 1e0 ELSE 0 END) AS online FROM tx GROUP BY 1"


def per_customer(s: Store):
    counts = s.tx.groupBy("customer_idx").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("sales_channel_id") == 2, 1.0).otherwise(0.0)).alias("online")
    )
    return counts.join(s.customers, "customer_idx")


register(
    "spearman_age_purchases", "n:l rho:d", lambda s: ex.spearman(per_customer(s), "age", "n"),
    """SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY age) + (count(*) OVER (PARTITION BY age) - 1) / 2e0 AS rx,
    rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2e0 AS ry FROM cust_n JOIN cust USING (customer_idx) WHERE age IS NOT NULL)""",
)
register(
    "chi_square_age_channel", "n:l chi2:d dof:l cramers_v:d",
    lambda s: ex.chi_square(
        per_customer(s).select(
            F.when(F.col("age") <= 25, "a").when(F.col("age") <= 35, "b").when(F.col("age") <= 50, "c").when(F.col("age") <= 100, "d").alias("grp"),
            (F.col("online") > 0.5).alias("is_online"),
        ),
        "grp", "is_online",
    ),
    """SELECT any_value(tot) AS n, sum(o * o * tot * 1e0 / (r * c)) - any_value(tot) AS chi2, (count(DISTINCT grp) - 1) * (count(DISTINCT f) - 1) AS dof,
    sqrt((sum(o * o * tot * 1e0 / (r * c)) - any_value(tot)) / (any_value(tot) * (least(count(DISTINCT grp), count(DISTINCT f)) - 1))) AS cramers_v
    FROM (SELECT grp, f, o, sum(o) OVER (PARTITION BY grp) AS r, sum(o) OVER (PARTITION BY f) AS c, sum(o) OVER () AS tot FROM
      (SELECT CASE WHEN age <= 25 THEN 'a' WHEN age <= 35 THEN 'b' WHEN age <= 50 THEN 'c' WHEN age <= 100 THEN 'd' END AS grp, online > 0.5 AS f, count(*) AS o
       FROM cust_n JOIN cust USING (customer_idx) WHERE age IS NOT NULL GROUP BY 1, 2))""",
)
register(
    "mann_whitney_channel_price", "n1:l n2:l u:d rank_biserial:d",
    lambda s: ex.mann_whitney(s.tx, "price", F.col("sales_channel_id") == 2),
    """SELECT n1, n2, r1 - n1 * (n1 + 1) / 2e0 AS u, 1 - 2 * (r1 - n1 * (n1 + 1) / 2e0) / (n1 * 1e0 * n2) AS rank_biserial FROM
    (SELECT count(*) FILTER (c = 2) AS n1, count(*) FILTER (c <> 2) AS n2, sum(rk) FILTER (c = 2) AS r1 FROM (SELECT sales_channel_id AS c,
      rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2e0 AS rk FROM tx))""",
)

# --- single-feature signal -------------------------------------------------------------

SIGNAL = list(FEATURE_NAMES)


def signal_frame(s: Store):
    return frame(s).select("customer_idx", "article_idx", "label", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in SIGNAL])


CTE["long"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, customer_idx, article_idx, label, round(CAST({f} AS DOUBLE), 6) AS value FROM features" for f in SIGNAL
)
CTE["auc"] = """SELECT feature, count(value) AS n, coalesce(sum(label) FILTER (value IS NOT NULL), 0) AS n_positive,
  coalesce(CASE WHEN count(value) >= 10 THEN (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2e0) / nullif(sum(label) * 1e0 * (count(value) - sum(label)), 0) END, 0.5) AS auc
  FROM (SELECT feature, CASE WHEN value IS NOT NULL THEN label END AS label, value, CASE WHEN value IS NOT NULL THEN
    rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 END AS rk FROM long) GROUP BY feature"""
CTE["fmap"] = """SELECT feature, coalesce(s, 0) / (SELECT count(*) FROM evalc) AS map FROM (SELECT DISTINCT feature FROM long) LEFT JOIN
  (SELECT feature, sum(x / least(n_truth, 12)) AS s FROM (SELECT feature, customer_idx, sum(h * 1e0 / pos) AS x FROM (SELECT *,
     row_number() OVER (PARTITION BY feature, customer_idx ORDER BY pos) AS h FROM (SELECT feature, customer_idx, label,
       row_number() OVER (PARTITION BY feature, customer_idx ORDER BY CASE WHEN auc < 0.5 THEN value ELSE -value END NULLS LAST, article_idx) AS pos
       FROM long JOIN auc USING (feature) QUALIFY pos <= 12) WHERE label = 1) GROUP BY 1, 2) JOIN n_truth USING (customer_idx) GROUP BY 1) USING (feature)"""
register(
    "feature_auc", "feature:s n:l n_positive:l auc:d", lambda s: si.feature_auc(signal_frame(s), SIGNAL), "SELECT * FROM auc"
)


def _fmap(s: Store):
    x = signal_frame(s)
    return si.feature_map(x, s.truth, SIGNAL, si.directions(si.feature_auc(x, SIGNAL)))


register("feature_map", "feature:s map:d", _fmap, "SELECT * FROM fmap")


def _flags(s: Store):
    x = signal_frame(s)
    auc = si.feature_auc(x, SIGNAL)
    return si.leakage_flags(auc, si.feature_map(x, s.truth, SIGNAL, si.directions(auc)), oracle_bound(s.merged, s.truth).select("oracle_map"))


register(
    "leakage_flags", "feature:s oriented_auc:d map:d auc_flag:b map_flag:b", _flags,
    """SELECT feature, greatest(auc, 1 - auc) AS oriented_auc, map, greatest(auc, 1 - auc) > 0.9 AS auc_flag, map > (SELECT avg(least(h, 12) * 1e0 / least(n, 12))
      FROM (SELECT customer_idx, count(*) AS n, count(m.article_idx) AS h FROM truth LEFT JOIN merged m USING (customer_idx, article_idx) GROUP BY 1)) AS map_flag
    FROM auc JOIN fmap USING (feature)""",
)
CORR = list(FEATURE_NAMES)
register(
    "correlated_features", "feature_a:s feature_b:s r:d",
    lambda s: si.correlated_pairs(frame(s), CORR).filter(F.abs("r") > 0.95),
    """SELECT * FROM (SELECT x.feature AS feature_a, y.feature AS feature_b, CASE WHEN var_pop(x.value) > 1e-12 AND var_pop(y.value) > 1e-12
    THEN corr(x.value, y.value) END AS r FROM corr_long x JOIN corr_long y ON x.customer_idx = y.customer_idx AND x.article_idx = y.article_idx AND x.i < y.i
    GROUP BY 1, 2) WHERE abs(r) > 0.95""",
    {
        "corr_long": " UNION ALL ".join(
            f"SELECT {i} AS i, '{c}' AS feature, customer_idx, article_idx, CAST({c} AS DOUBLE) AS value FROM features WHERE {c} IS NOT NULL"
            for i, c in enumerate(CORR)
        )
    },
)
PSI = ["c_n_purchases", "c_mean_price", "c_n_unique_articles", "c_days_since_last_purchase"]


def _psi(s: Store):
    from shelfwise.operators.features import customer_features
    from shelfwise.sources.splits import before_week

    a = customer_features(before_week(s.tx, 339), 339, s.customers, CAL)
    b = customer_features(s.history, WEEK, s.customers, CAL)
    pick = [F.round(F.col(c).cast("double"), 6).alias(c) for c in PSI]
    return si.stability_index(a.select(pick), b.select(pick), PSI)


_CF = """SELECT count(*) AS c_n_purchases, avg(price) AS c_mean_price, count(DISTINCT article_idx) AS c_n_unique_articles,
  datediff('day', max(t_dat), DATE '1994-12-28' + {w} * 7) AS c_days_since_last_purchase FROM tx WHERE week_idx < {w} GROUP BY customer_idx"""
register(
    "stability_index", "feature:s psi:d", _psi,
    """SELECT feature, sum((po - pb) * ln(po / pb)) AS psi FROM (SELECT feature, greatest(nb * 1e0 / sum(nb) OVER w, 1e-6) AS pb, greatest(no * 1e0 / sum(no) OVER w, 1e-6) AS po
      FROM (SELECT feature, bin, count(*) FILTER (side = 'b') AS nb, count(*) FILTER (side = 'o') AS no FROM (SELECT side, feature,
        len(list_filter(e, lambda x: x < value)) AS bin FROM psi_long JOIN psi_edges USING (feature)) GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature)) GROUP BY feature""",
    {
        "psi_long": " UNION ALL ".join(
            f"SELECT '{side}' AS side, '{c}' AS feature, round(CAST({c} AS DOUBLE), 6) AS value FROM ({_CF.format(w=w)})"
            for side, w in (("b", 339), ("o", WEEK)) for c in PSI
        ),
        "psi_edges": "SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM psi_long WHERE side = 'b' GROUP BY feature",
    },
)
