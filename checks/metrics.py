"""List metrics, baselines and the metric suite."""

from pyspark.sql import functions as F

from checks.base import CAL, CTE, WEEK, Store, register
from shelfwise.operators import baselines as bl
from shelfwise.operators import metrics as mt
from shelfwise.operators import resampling as rs
from shelfwise.plans import evaluation as pe
from shelfwise.session import materialize
from shelfwise.sources.splits import build_fold, fold_overview

CTE["recent12"] = "SELECT customer_idx, article_idx, source_rank AS pos FROM c_recent WHERE source_rank <= 12"
CTE["base_a"] = "SELECT customer_idx, article_idx, source_rank AS pos FROM c_lw WHERE source_rank <= 12"
CTE["base_b"] = """SELECT customer_idx, article_idx, row_number() OVER (PARTITION BY customer_idx ORDER BY min(p)) AS pos
  FROM (SELECT customer_idx, article_idx, pos AS p FROM recent12 UNION ALL SELECT customer_idx, article_idx, pos + 12 FROM base_a)
  GROUP BY 1, 2 QUALIFY pos <= 12"""
CTE["raw12"] = """SELECT customer_idx, article_idx, row_number() OVER (PARTITION BY customer_idx ORDER BY t_dat DESC, article_idx) AS pos
  FROM hist SEMI JOIN who USING (customer_idx) QUALIFY pos <= 12"""
CTE["base_raw"] = """SELECT customer_idx, article_idx, row_number() OVER (PARTITION BY customer_idx ORDER BY p) AS pos
  FROM (SELECT customer_idx, article_idx, pos AS p FROM raw12 UNION ALL
        SELECT customer_idx, article_idx, pos + 12 FROM base_a ANTI JOIN raw12 USING (customer_idx, article_idx)) QUALIFY pos <= 12"""
CTE["n_truth"] = "SELECT customer_idx, count(*) AS n_truth FROM truth GROUP BY customer_idx"


def users_sql(preds: str) -> str:
    """Per-customer metrics; ap counts an article once, ndcg and precision every time."""
    return f"""SELECT n.customer_idx, n_truth, coalesce(nh, 0) AS n_hits, coalesce(s, 0) / least(n_truth, 12) AS ap,
      coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_truth, 12) + 1), lambda i: 1e0 / log2(i + 1))) AS ndcg,
      coalesce(nh, 0) * 1e0 / n_truth AS recall, coalesce(na, 0) / 12e0 AS precision, CASE WHEN nh > 0 THEN 1e0 ELSE 0 END AS hit,
      n.customer_idx IN (SELECT customer_idx FROM {preds}) AS has_preds
      FROM n_truth n LEFT JOIN (SELECT customer_idx, count(*) AS nh, sum(h * 1e0 / pos) AS s FROM (
          SELECT customer_idx, min(pos) AS pos, row_number() OVER (PARTITION BY customer_idx ORDER BY min(pos)) AS h
          FROM {preds} SEMI JOIN truth USING (customer_idx, article_idx) GROUP BY customer_idx, article_idx) GROUP BY 1) f USING (customer_idx)
      LEFT JOIN (SELECT customer_idx, count(*) AS na, sum(1e0 / log2(pos + 1)) AS dcg
          FROM {preds} SEMI JOIN truth USING (customer_idx, article_idx) GROUP BY 1) g USING (customer_idx)"""


for _n, _p in (("heuristic", "preds"), ("base_a", "base_a"), ("base_b", "base_b"), ("base_raw", "base_raw"), ("recent", "recent12")):
    CTE[f"u_{_n}"] = users_sql(_p)


def lists(s: Store) -> dict:
    return {
        "heuristic": bl.heuristic_lists(s.merged),
        "base_a": bl.last_week_lists(s.history, WEEK, s.eval_customers),
        "base_b": bl.recent_then_popular(s.history, WEEK, s.eval_customers),
        "base_raw": bl.recent_then_popular(s.history, WEEK, s.eval_customers, deduplicate=False),
    }


U = "customer_idx:l n_truth:l n_hits:l ap:d ndcg:d recall:d precision:d hit:d has_preds:b"
SUM = "n_customers:l map:d ndcg:d recall:d precision:d hit_rate:d micro_recall:d"


def summary_sql(users: str, hit: str = "avg(hit) FILTER (has_preds)") -> str:
    return f"""SELECT count(*) AS n_customers, avg(ap) AS map, avg(ndcg) AS ndcg, avg(recall) AS recall, avg(precision) AS precision,
    {hit} AS hit_rate, sum(n_hits) * 1e0 / sum(n_truth) AS micro_recall FROM {users}"""


register("per_customer_metrics", U, lambda s: mt.per_customer_metrics(lists(s)["heuristic"], s.truth), "SELECT * FROM u_heuristic")
register(
    "per_customer_metrics_repeated_articles", U,
    lambda s: mt.per_customer_metrics(lists(s)["base_raw"], s.truth), "SELECT * FROM u_base_raw",
)
register(
    "heuristic_metrics", SUM, lambda s: mt.summarize_metrics(mt.per_customer_metrics(lists(s)["heuristic"], s.truth)),
    summary_sql("u_heuristic"),
)


def recents(s: Store):
    """History-only lists: customers without history have none."""
    return bl.cand.repurchase(s.history, WEEK, s.eval_customers, 12, ordering="recency_only").withColumnRenamed("source_rank", "pos")


for _mode, _hit in (("drop", "avg(hit) FILTER (has_preds)"), ("zero", "avg(hit)")):
    register(
        f"history_only_metrics_missing_{_mode}", SUM,
        lambda s, m=_mode: mt.summarize_metrics(mt.per_customer_metrics(recents(s), s.truth), m),
        summary_sql("u_recent", _hit),
    )
register(
    "baseline_last_week_map", SUM, lambda s: mt.summarize_metrics(mt.per_customer_metrics(lists(s)["base_a"], s.truth)),
    summary_sql("u_base_a"),
)
register(
    "baseline_recent_then_popular", "deduplicated:b " + SUM,
    lambda s: mt.summarize_metrics(mt.per_customer_metrics(lists(s)["base_b"], s.truth)).withColumn("deduplicated", F.lit(True))
    .unionByName(mt.summarize_metrics(mt.per_customer_metrics(lists(s)["base_raw"], s.truth)).withColumn("deduplicated", F.lit(False))),
    f"SELECT true AS deduplicated, * FROM ({summary_sql('u_base_b')}) UNION ALL SELECT false, * FROM ({summary_sql('u_base_raw')})",
)
register(
    "baseline_lists", "customer_idx:l article_idx:l pos:i", lambda s: lists(s)["base_b"], "SELECT * FROM base_b",
)
register(
    "repeats_in_recent_history", "n_customers:l n_with_repeats:l n_asked:l n_asked_with_repeats:l",
    lambda s: bl.repeats_in_history(s.history, WEEK, s.eval_customers),
    """SELECT count(*) AS n_customers, count(*) FILTER (r) AS n_with_repeats, count(*) FILTER (a) AS n_asked,
    count(*) FILTER (r AND a) AS n_asked_with_repeats FROM (SELECT customer_idx, count(*) <> count(DISTINCT article_idx) AS r,
      customer_idx IN (SELECT customer_idx FROM evalc) AS a FROM (SELECT customer_idx, article_idx FROM hist
      QUALIFY row_number() OVER (PARTITION BY customer_idx ORDER BY t_dat DESC, article_idx) <= 12) GROUP BY 1)""",
)
register(
    "recall_at_cuts", " ".join(f"micro_recall_{c}:d mean_recall_{c}:d" for c in (20, 50, 100, 200)),
    lambda s: mt.recall_at_cuts(mt.predictions_from_ranks(s.merged, 200), s.truth, (20, 50, 100, 200)),
    "SELECT " + ", ".join(f"sum(h{c}) * 1e0 / sum(n) AS micro_recall_{c}, avg(h{c} * 1e0 / n) AS mean_recall_{c}" for c in (20, 50, 100, 200))
    + " FROM (SELECT t.customer_idx, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (final_rank <= {c}) AS h{c}" for c in (20, 50, 100, 200))
    + " FROM truth t LEFT JOIN merged m ON m.customer_idx = t.customer_idx AND m.article_idx = t.article_idx GROUP BY 1)",
)
register(
    "article_popularity_ranks", "article_idx:l units:l pop_rank:l",
    lambda s: mt.article_popularity_ranks(s.history), "SELECT * FROM art_rank",
)
register(
    "catalog_coverage", "n_recommended:l n_sold:l coverage:d",
    lambda s: mt.catalog_coverage(lists(s)["heuristic"], s.history),
    """SELECT count(DISTINCT article_idx) AS n_recommended, (SELECT count(*) FROM art_rank) AS n_sold,
    count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) AS coverage FROM preds""",
)
CTE["extras"] = """SELECT customer_idx, avg(pop_rank) AS pop_bias, avg(CASE WHEN o.n IS NOT NULL THEN 1e0 ELSE 0 END) AS repeat_share,
  avg(CASE WHEN pop_rank IS NULL THEN 1e0 ELSE 0 END) AS novelty_share FROM preds LEFT JOIN art_rank USING (article_idx)
  LEFT JOIN (SELECT DISTINCT customer_idx, article_idx, 1 AS n FROM hist) o USING (customer_idx, article_idx) GROUP BY customer_idx"""
register(
    "list_character", "customer_idx:l pop_bias:d repeat_share:d novelty_share:d",
    lambda s: mt.per_customer_extras(lists(s)["heuristic"], s.eval_customers, s.history), "SELECT * FROM extras",
)
register(
    "overlap_with_truth", "model:s customer_idx:l n_bought:l",
    lambda s: mt.overlap_with_truth({k: v for k, v in lists(s).items() if k in ("heuristic", "base_b")}, s.truth),
    """SELECT 'heuristic' AS model, customer_idx, count(*) AS n_bought FROM preds SEMI JOIN truth USING (customer_idx, article_idx) GROUP BY 2
    UNION ALL SELECT 'base_b', customer_idx, count(*) FROM base_b SEMI JOIN truth USING (customer_idx, article_idx) GROUP BY 2""",
)
CTE["outcomes"] = """SELECT a.customer_idx, a.ap AS ranker_ap, a.hit AS ranker_hit, b.ap AS heuristic_ap, b.hit AS heuristic_hit
  FROM u_heuristic a JOIN u_base_b b USING (customer_idx)"""


def outcomes(s: Store):
    """Per-customer outcomes of two models; the merged order stands for the new model."""
    if "outcomes" not in s.kept:
        x = lists(s)
        s.kept["outcomes"] = materialize(mt.outcome_table(x["heuristic"], x["base_b"], s.truth))
    return s.kept["outcomes"]


register(
    "outcome_table", "customer_idx:l ranker_ap:d ranker_hit:d heuristic_ap:d heuristic_hit:d", outcomes, "SELECT * FROM outcomes"
)


def boot_cte(table: str, unit: str, cols: dict[str, tuple[str, str]], b: int, seed: int = 42, groups: str = "") -> str:
    """SQL of the Poisson bootstrap: weights from eight hex digits of an md5."""
    g = f"{groups}, " if groups else ""
    cum = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745217, 0.9999999899522336)
    w = " + ".join(f"CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END" for c in cum)
    sums = ", ".join(
        f"round(sum(w * ({x})) / nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN w * ({d}) END), 0), 12) AS {n}" for n, (x, d) in cols.items()
    )
    return f"""SELECT {g}r AS replicate, {sums} FROM (SELECT *, {w} AS w FROM (SELECT *, CAST('0x' || substr(md5({unit} || '|' || (r // 4) || '|{seed}'),
      CAST((r % 4) * 8 + 1 AS INTEGER), 8) AS BIGINT) / 4294967296e0 AS u FROM {table}, (SELECT unnest(range(0, {b})) AS r))) GROUP BY {g}r"""


B = 200
register(
    "metric_suite",
    "model:s n_eval_customers:l map:d map_lo:d map_hi:d ndcg:d recall:d precision:d hit_rate:d hit_lo:d hit_hi:d "
    "coverage:d coverage_lo:d coverage_hi:d coverage_bias:d pop_bias:d pop_lo:d pop_hi:d repeat_share:d repeat_lo:d repeat_hi:d novelty_share:d",
    lambda s: pe.metric_suite("heuristic", lists(s)["heuristic"], s.truth, s.history, n_boot=B),
    """SELECT 'heuristic' AS model, m.n_customers AS n_eval_customers, map, map_lo, map_hi, ndcg, recall, precision, hit_rate, hit_lo, hit_hi,
    coverage, coverage_lo, coverage_hi, coverage_bias, pop_bias, pop_lo, pop_hi, repeat_share, repeat_lo, repeat_hi, novelty_share
    FROM sm m, (SELECT quantile_cont(a, 0.025) AS map_lo, quantile_cont(a, 0.975) AS map_hi, quantile_cont(h, 0.025) AS hit_lo,
      quantile_cont(h, 0.975) AS hit_hi, quantile_cont(p, 0.025) AS pop_lo, quantile_cont(p, 0.975) AS pop_hi,
      quantile_cont(s, 0.025) AS repeat_lo, quantile_cont(s, 0.975) AS repeat_hi FROM reps),
    (SELECT avg(pop_bias) AS pop_bias, avg(repeat_share) AS repeat_share, avg(novelty_share) AS novelty_share FROM extras),
    (SELECT any_value(pt) AS coverage, quantile_cont(c, 0.025) AS coverage_lo, quantile_cont(c, 0.975) AS coverage_hi, avg(c) - any_value(pt) AS coverage_bias
     FROM cov)""",
    {
        "sm": summary_sql("u_heuristic"),
        "joined": "SELECT * FROM u_heuristic LEFT JOIN extras USING (customer_idx)",
        "reps": boot_cte("joined", "customer_idx", {
            "a": ("ap", "1e0"), "h": ("CASE WHEN has_preds THEN hit END", "1e0"), "p": ("pop_bias", "1e0"), "s": ("repeat_share", "1e0")}, B),
        "cov": f"""SELECT r, count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) AS c,
          any_value((SELECT count(DISTINCT article_idx) * 1e0 FROM preds) / (SELECT count(*) FROM art_rank)) AS pt
          FROM preds, (SELECT unnest(range(0, {B})) AS r) WHERE CAST('0x' || substr(md5(customer_idx || '|' || (r // 4) || '|42'),
          CAST((r % 4) * 8 + 1 AS INTEGER), 8) AS BIGINT) / 4294967296e0 >= exp(-1e0) GROUP BY r""",
    },
)
register(
    "bootstrap_mean_ap", "mean:d ci_lo:d ci_hi:d n_customers:l",
    lambda s: rs.bootstrap_mean(outcomes(s), "ranker_ap", B),
    """SELECT (SELECT avg(ranker_ap) FROM outcomes) AS mean, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi,
    (SELECT count(*) FROM outcomes) AS n_customers FROM reps""",
    {"reps": boot_cte("outcomes", "customer_idx", {"m": ("ranker_ap", "1e0")}, B)},
)
PD = "n:l mean_a:d mean_b:d mean_diff:d ci_lo:d ci_hi:d ci_excludes_zero:b lift_pct:d p_bootstrap:d"
register(
    "paired_bootstrap_difference", PD, lambda s: rs.paired_difference(outcomes(s), "ranker_ap", "heuristic_ap", B),
    """SELECT n, ma AS mean_a, mb AS mean_b, md AS mean_diff, lo AS ci_lo, hi AS ci_hi, lo > 0 OR hi < 0 AS ci_excludes_zero,
    CASE WHEN mb <> 0 THEN md / mb * 100 END AS lift_pct, p AS p_bootstrap FROM
    (SELECT count(*) AS n, avg(ranker_ap) AS ma, avg(heuristic_ap) AS mb, avg(ranker_ap - heuristic_ap) AS md FROM outcomes),
    (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, least(1, 2e0 * (count(*) FILTER (CASE WHEN
      (SELECT avg(ranker_ap - heuristic_ap) FROM outcomes) > 0 THEN d <= 0 ELSE d >= 0 END) + 1) / (count(*) + 1)) AS p FROM reps)""",
    {"reps": boot_cte("outcomes", "customer_idx", {"d": ("ranker_ap - heuristic_ap", "1e0")}, B)},
)
register(
    "coverage_bootstrap_m_of_n", "n_customers:l coverage:d ci_lo:d ci_hi:d bias:d",
    lambda s: rs.bootstrap_coverage(lists(s)["base_b"], s.history, B, fraction=0.5),
    f"""SELECT (SELECT count(DISTINCT customer_idx) FROM base_b) AS n_customers, pt AS coverage, quantile_cont(c, 0.025) AS ci_lo,
    quantile_cont(c, 0.975) AS ci_hi, avg(c) - pt AS bias FROM (SELECT r, count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) AS c
      FROM base_b, (SELECT unnest(range(0, {B})) AS r) WHERE CAST('0x' || substr(md5(customer_idx || '|' || (r // 4) || '|42'),
      CAST((r % 4) * 8 + 1 AS INTEGER), 8) AS BIGINT) / 4294967296e0 >= exp(-0.5e0) GROUP BY r),
    (SELECT count(DISTINCT article_idx) * 1e0 / (SELECT count(*) FROM art_rank) AS pt FROM base_b) GROUP BY pt""",
)
register(
    "repurchase_rate_interval", "mean:d ci_lo:d ci_hi:d n_customers:l",
    lambda s: rs.bootstrap_mean(pe.customer_repeat_rates(s.history), "rate", B, weight="n"),
    """SELECT (SELECT sum(x) * 1e0 / sum(n) FROM rates) AS mean, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi,
    (SELECT count(*) FROM rates) AS n_customers FROM reps""",
    {
        "rates": """SELECT customer_idx, count(*) AS n, count(*) FILTER (t_dat > f) AS x FROM (SELECT customer_idx, t_dat,
          min(t_dat) OVER (PARTITION BY customer_idx, article_idx) AS f FROM hist) GROUP BY 1""",
        "reps": boot_cte("rates", "customer_idx", {"m": ("x", "n")}, B),
    },
)
FOLDS = (339, 340, 341, 342)
register(
    "fold_overview", "week_idx:i start_date:t end_date:t n_transactions:l n_customers:l n_articles:l n_history:l",
    lambda s: fold_overview(s.tx, [*FOLDS, WEEK], CAL),
    """SELECT week_idx, DATE '1994-12-28' + week_idx * 7 AS start_date, DATE '1994-12-28' + week_idx * 7 + 6 AS end_date,
    count(*) AS n_transactions, count(DISTINCT customer_idx) AS n_customers, count(DISTINCT article_idx) AS n_articles,
    any_value((SELECT count(*) FROM tx h WHERE h.week_idx < tx.week_idx)) AS n_history FROM tx WHERE week_idx BETWEEN 339 AND 343 GROUP BY week_idx""",
)
register(
    "fold_truth", "customer_idx:l article_idx:l", lambda s: build_fold(s.tx, 342, CAL).truth,
    "SELECT DISTINCT customer_idx, article_idx FROM tx WHERE week_idx = 342",
)
register(
    "rolling_origin_baseline", "week_idx:i n_customers:l map:d", lambda s: pe.rolling_baseline(s.tx, list(FOLDS), CAL),
    " UNION ALL ".join(
        f"""SELECT {w} AS week_idx, count(*) AS n_customers, avg(coalesce(s, 0) / least(n, 12)) AS map FROM
        (SELECT customer_idx, count(DISTINCT article_idx) AS n FROM tx WHERE week_idx = {w} GROUP BY 1) LEFT JOIN
        (SELECT customer_idx, sum(h * 1e0 / pos) AS s FROM (SELECT customer_idx, pos, row_number() OVER (PARTITION BY customer_idx ORDER BY pos) AS h
          FROM (SELECT DISTINCT customer_idx, article_idx FROM tx WHERE week_idx = {w}) JOIN (SELECT article_idx,
            row_number() OVER (ORDER BY count(*) DESC, article_idx) AS pos FROM tx WHERE week_idx = {w - 1} GROUP BY 1 QUALIFY pos <= 12) USING (article_idx))
          GROUP BY 1) USING (customer_idx)"""
        for w in FOLDS
    ),
)
