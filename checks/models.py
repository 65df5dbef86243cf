"""Rankers, explanations and recommendations."""

from pyspark.sql import functions as F

from checks.base import CAL, CTE, SETTINGS, WEEK, Store, register
from checks.features import frame
from checks.metrics import summary_sql  # noqa: F401  (shared SQL parts are registered there)
from checks.stats import segments
from shelfwise.operators import explain as xp
from shelfwise.operators import metrics as mt
from shelfwise.operators import ranker as rk
from shelfwise.plans import candidate_run as cr
from shelfwise.plans import evaluation as pe
from shelfwise.plans import recommend as rc
from shelfwise.plans.fold_features import fold_frame
from shelfwise.schema import FEATURE_NAMES
from shelfwise.session import materialize_by
from shelfwise.sources.splits import build_fold

WEIGHTS = tuple(((i * 37) % 11 - 5) / 10 for i in range(len(FEATURE_NAMES)))


def fixed_model(x) -> rk.LinearRanker:
    """Means and deviations from the data, weights by a rule, so that SQL can follow."""
    means, stds = rk.column_stats(x, FEATURE_NAMES)
    return rk.LinearRanker(tuple(FEATURE_NAMES), means, tuple(s if s > 1e-9 else 0.0 for s in stds), WEIGHTS)


def stored_frame(s: Store):
    return frame(s)


CTE["xlong"] = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {w}e0 AS w, customer_idx, article_idx, CAST({f} AS DOUBLE) AS value FROM features"""
    for f, w in zip(FEATURE_NAMES, WEIGHTS)
)
CTE["xstat"] = "SELECT feature, coalesce(avg(value), 0) AS m, coalesce(stddev_samp(value), 0) AS sd FROM xlong GROUP BY 1"
CTE["contrib"] = """SELECT *, contribution - avg(contribution) OVER (PARTITION BY customer_idx, feature) AS contrast FROM
  (SELECT feature, customer_idx, article_idx, value, CASE WHEN sd > 1e-9 THEN coalesce((value - m) / sd, 0) * w ELSE 0 END AS contribution FROM xlong JOIN xstat USING (feature))"""
CTE["scored"] = "SELECT customer_idx, article_idx, sum(contribution) AS score FROM contrib GROUP BY 1, 2"
CTE["xtop"] = """SELECT customer_idx, article_idx, row_number() OVER (PARTITION BY customer_idx ORDER BY score DESC, article_idx) AS pos FROM scored QUALIFY pos <= 12"""


def explained(s: Store, features=None):
    x = stored_frame(s)
    model = fixed_model(x)
    return x, model, xp.as_long(xp.wide_contrasts(x, model, features), model, features)


def _faithfulness(s: Store):
    x = stored_frame(s)
    model = fixed_model(x)
    return xp.faithfulness(xp.wide_contrasts(x, model), model)


register(
    "training_row_counts", "n_customers_kept:l n_customers_dropped:l n_rows_kept:l n_rows_dropped:l",
    lambda s: rk.training_counts(frame(s)),
    """SELECT count(*) FILTER (p = 1) AS n_customers_kept, count(*) FILTER (p = 0) AS n_customers_dropped, coalesce(sum(n) FILTER (p = 1), 0) AS n_rows_kept,
    coalesce(sum(n) FILTER (p = 0), 0) AS n_rows_dropped FROM (SELECT count(*) AS n, max(label) AS p FROM features GROUP BY customer_idx)""",
)
register(
    "training_frame", "customer_idx:l article_idx:l label:i final_rank:i", lambda s: rk.training_frame(stored_frame(s)),
    "SELECT * FROM features SEMI JOIN (SELECT customer_idx FROM features WHERE label = 1) USING (customer_idx)",
)


def _scores(s: Store):
    x = stored_frame(s)
    return fixed_model(x).score(x)


register("linear_scores", "customer_idx:l article_idx:l score:d", _scores, "SELECT * FROM scored")
register("linear_top_lists", "customer_idx:l article_idx:l pos:i", lambda s: xp.mark_top(_scores(s)), "SELECT * FROM xtop")


def _checks(s: Store):
    x = stored_frame(s)
    return rk.score_checks(fixed_model(x).score(x), x)


register(
    "score_checks", "n_scored:l n_bad_scores:l n_repeated:l n_expected:l", _checks,
    "SELECT count(*) AS n_scored, 0 AS n_bad_scores, 0 AS n_repeated, (SELECT count(*) FROM features) AS n_expected FROM scored",
)
register(
    "contributions", "customer_idx:l article_idx:l feature:s contribution:d contrast:d", lambda s: explained(s)[2], "SELECT * FROM contrib"
)


def _additivity(s: Store):
    x, model, long = explained(s)
    return xp.additivity(long, model.score(x))


register("contribution_additivity", "n_rows:l n_off:l", _additivity, "SELECT count(*) AS n_rows, 0 AS n_off FROM scored")
_IMP = "SELECT feature, count(*) AS n, avg(abs(contribution)) AS mean_abs_contribution, avg(abs(contrast)) AS mean_abs_contrast FROM {} GROUP BY feature"
register(
    "global_importance", "feature:s n:l mean_abs_contribution:d mean_abs_contrast:d", lambda s: xp.global_importance(explained(s)[2]), _IMP.format("contrib")
)


def _top_importance(s: Store):
    x, model, long = explained(s)
    return xp.global_importance(long.join(xp.mark_top(model.score(x)), xp.ROW, "left_semi"))


register(
    "importance_of_top_lists", "feature:s n:l mean_abs_contribution:d mean_abs_contrast:d", _top_importance,
    _IMP.format("(SELECT * FROM contrib SEMI JOIN xtop USING (customer_idx, article_idx))"),
)
register(
    "importance_by_segment", "segment:s feature:s n:l mean_abs_contribution:d mean_abs_contrast:d",
    lambda s: xp.global_importance(explained(s)[2].join(segments(s).filter("family = 'prior_purchases'"), "customer_idx"), ["segment"]),
    """SELECT segment, feature, count(*) AS n, avg(abs(contribution)) AS mean_abs_contribution, avg(abs(contrast)) AS mean_abs_contrast
    FROM contrib JOIN xseg USING (customer_idx) WHERE family = 'prior_purchases' GROUP BY 1, 2""",
)
_GROUP = "CASE WHEN feature LIKE 'c\\_%' ESCAPE '\\' THEN 'customer' WHEN feature LIKE 'a\\_%' ESCAPE '\\' THEN 'article' WHEN feature LIKE 'i\\_%' ESCAPE '\\' THEN 'interaction' ELSE 'candidate' END"
register(
    "importance_by_feature_group", "feature_group:s total:d n_features:l share:d", lambda s: xp.group_importance(xp.global_importance(explained(s)[2])),
    f"""SELECT {_GROUP} AS feature_group, sum(m) AS total, count(*) AS n_features, sum(m) / (SELECT sum(a) FROM (SELECT avg(abs(contribution)) AS a FROM contrib GROUP BY feature)) AS share
    FROM (SELECT feature, avg(abs(contribution)) AS m FROM contrib GROUP BY 1) GROUP BY 1""",
)


def _ranks(s: Store):
    x, model, long = explained(s)
    return xp.rank_comparison(xp.global_importance(long), rk.linear_importance(model, s.spark))


_W = "(SELECT DISTINCT feature, w FROM xlong)"
register(
    "importance_rank_comparison", "feature:s rank_contribution:i rank_contrast:i rank_importance:i", _ranks,
    f"""SELECT feature, row_number() OVER (ORDER BY round(a, 9) DESC, feature) AS rank_contribution, row_number() OVER (ORDER BY round(b, 9) DESC, feature) AS rank_contrast,
    row_number() OVER (ORDER BY round(abs(w), 9) DESC, feature) AS rank_importance FROM (SELECT feature, avg(abs(contribution)) AS a, avg(abs(contrast)) AS b FROM contrib GROUP BY 1) JOIN {_W} USING (feature)""",
)


def _reason_rows(s: Store):
    x, model, long = explained(s, xp.THEMES)
    return x, model, long, xp.reasons(long)


_P = "CAST(round_even(value * 100, 0) AS INTEGER)"
_D = "CAST(round_even(value, 0) AS INTEGER)"
_AGO = f"' ' || {_D} || CASE WHEN {_D} = 1 THEN ' day ago' ELSE ' days ago' END"
_SHARE = f"CASE WHEN value >= 0.25 THEN 'In a %s you buy often (' || {_P} || '% of your purchases)' WHEN value >= 0.10 THEN 'In a %s you''ve bought from before (' || {_P} || '% of your purchases)' END"
CTE["rtext"] = f"""SELECT *, CASE feature
  WHEN 'i_days_since_bought_article' THEN CASE WHEN {_D} > 0 THEN 'You bought this exact item' || {_AGO} END
  WHEN 'i_days_since_bought_product_code' THEN CASE WHEN {_D} > 0 THEN 'You bought another colour or size of this product' || {_AGO} END
  WHEN 'a_trend_ratio' THEN CASE WHEN CAST(round_even((value - 1) * 100, 0) AS INTEGER) >= 5 THEN 'Trending: ' || CAST(round_even((value - 1) * 100, 0) AS INTEGER) || '% more sales this week than its 4-week average' END
  WHEN 'i_age_gap' THEN CASE WHEN value <= 10 THEN 'Popular with customers your age' END
  WHEN 'i_customer_share_product_group' THEN {_SHARE.replace('%s', 'product category')}
  WHEN 'i_customer_share_garment_group' THEN {_SHARE.replace('%s', 'garment category')}
  WHEN 'a_repurchase_rate' THEN CASE WHEN value >= 0.0948 THEN 'Customers re-buy this more than most items (' || {_P} || '% vs 4.7% avg)' END
  WHEN 'i_bought_same_product_code' THEN CASE WHEN value >= 1 THEN 'Often bought together with something you bought recently' END END AS reason,
  CASE WHEN feature IN ('i_days_since_bought_article', 'i_days_since_bought_product_code') THEN 'repurchase' WHEN feature IN ('a_trend_ratio', 'a_repurchase_rate') THEN 'popularity_trend'
  WHEN feature = 'i_age_gap' THEN 'demographic_fit' WHEN feature = 'i_bought_same_product_code' THEN 'co_purchase' ELSE 'category' END AS theme
  FROM contrib WHERE feature IN ({', '.join(f"'{f}'" for f in xp.THEMES)})"""
CTE["rok"] = """SELECT * FROM (SELECT *, bool_or(feature = 'i_days_since_bought_article') OVER (PARTITION BY customer_idx, article_idx) AS e FROM rtext
  WHERE reason IS NOT NULL AND round(contrast, 9) > 0) WHERE NOT (e AND feature = 'i_days_since_bought_product_code')"""
CTE["rbest"] = """SELECT *, row_number() OVER (PARTITION BY customer_idx, article_idx ORDER BY round(contrast, 9) DESC, feature) AS place FROM
  (SELECT * FROM rok QUALIFY row_number() OVER (PARTITION BY customer_idx, article_idx, theme ORDER BY round(contrast, 9) DESC, feature) = 1) QUALIFY place <= 3"""
register(
    "reasons", "customer_idx:l article_idx:l place:i theme:s feature:s reason:s", lambda s: _reason_rows(s)[3], "SELECT * FROM rbest"
)


def _coverage(s: Store):
    x, _, _, rs = _reason_rows(s)
    return xp.reason_coverage(rs, x)


register(
    "reason_coverage", "n_rows:l n_with_reason:l share_with_reason:d mean_reasons:d n_conflicts:l", _coverage,
    """SELECT count(*) AS n_rows, count(n) AS n_with_reason, count(n) * 1e0 / count(*) AS share_with_reason, avg(coalesce(n, 0)) AS mean_reasons,
    count(*) FILTER (e AND c) AS n_conflicts FROM scored LEFT JOIN (SELECT customer_idx, article_idx, count(*) AS n, bool_or(feature = 'i_days_since_bought_article') AS e,
      bool_or(feature = 'i_days_since_bought_product_code') AS c FROM rbest GROUP BY 1, 2) USING (customer_idx, article_idx)""",
)
register("faithfulness", "n_rows:l top_mean_drop:d random_mean_drop:d n_larger:l n_smaller:l z:d p_value:d passed:b", _faithfulness)


def _examples(s: Store):
    x, model, _, rs = _reason_rows(s)
    return xp.worked_examples(xp.mark_top(model.score(x)), segments(s), xp.reason_lists(rs))


register(
    "worked_examples", "family:s segment:s customer_idx:l article_idx:l pos:i reasons:s", _examples,
    """SELECT family, segment, customer_idx, article_idx, pos, rs AS reasons FROM (SELECT family, segment, customer_idx FROM xseg SEMI JOIN xtop USING (customer_idx)
      QUALIFY row_number() OVER (PARTITION BY family, segment ORDER BY CAST('0x' || substr(md5(customer_idx || '|42'), 1, 8) AS BIGINT), customer_idx) = 1)
    JOIN xtop USING (customer_idx) LEFT JOIN (SELECT customer_idx, article_idx, string_agg(reason, ' | ' ORDER BY place) AS rs FROM rbest GROUP BY 1, 2) USING (customer_idx, article_idx)""",
)


def _partner(s: Store):
    x = stored_frame(s)
    return xp.partner_feature(x, fixed_model(x), "a_sales_1w")


register("partner_feature", "feature:s r:d", _partner)

# --- trained models -------------------------------------------------------------------


def fold_of(s: Store, week: int):
    fold = build_fold(s.sales, week, CAL, allow_holdout=True)
    if week == WEEK:
        return frame(s), fold.truth
    name = f"features_{week}"
    if name not in s.kept:
        state = cr.build_state(fold.history, week, CAL, s.articles, s.customers, SETTINGS, later=s.state().partials)
        s.kept[name] = materialize_by(fold_frame(fold, CAL, s.articles, s.customers, SETTINGS, state=state), "customer_idx")
    return s.kept[name], fold.truth


def _evaluation(s: Store):
    train, _ = fold_of(s, 342)
    test, truth = fold_of(s, WEEK)
    lists = {
        "merge_order": mt.predictions_from_ranks(test),
        "linear": rc.recommended_lists(test, rk.train_linear(train)),
        "trees": mt.predictions_from_scores(rk.score_trees(rk.train_trees(train, rounds=5, depth=3), test)),
    }
    out = None
    for m, p in lists.items():
        part = mt.summarize_metrics(mt.per_customer_metrics(p, truth)).withColumn("model", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


register("ranker_evaluation", "model:s n_customers:l map:d ndcg:d recall:d precision:d hit_rate:d", _evaluation)


def _ablation(s: Store):
    train, _ = fold_of(s, 342)
    test, truth = fold_of(s, WEEK)
    per = rk.group_ablation(train, test, truth)
    return per.groupBy("feature_group").agg(
        F.count("*").alias("n_customers"), F.avg("ablated_ap").alias("map"), F.avg(F.col("ablated_ap") - F.col("full_ap")).alias("map_change")
    )


register("group_ablation", "feature_group:s n_customers:l map:d map_change:d", _ablation)
register(
    "rolling_origin_ranker", "week_idx:i n_customers:l ranker_map:d heuristic_map:d lift_pct:d",
    lambda s: pe.rolling_ranker([(w, *fold_of(s, w)) for w in (341, 342, WEEK)]),
)


def _recommend(s: Store):
    x = stored_frame(s)
    out = rc.recommend(s.history, s.eval_customers, s.state(), s.customers, fixed_model(x), CAL)
    return out.withColumn("reasons", F.array_join("reasons", " | "))


register(
    "recommendations", "customer_idx:l article_idx:l pos:i final_source:s reasons:s", _recommend,
    """SELECT customer_idx, article_idx, pos, final_source, rs AS reasons FROM xtop JOIN merged USING (customer_idx, article_idx)
    LEFT JOIN (SELECT customer_idx, article_idx, string_agg(reason, ' | ' ORDER BY place) AS rs FROM rbest GROUP BY 1, 2) USING (customer_idx, article_idx)""",
)


def replayed(s: Store):
    """Sales of the target week's buyers under negative ids, from the lines that are joined and dealt already."""
    own = s.sales.join(s.eval_customers, "customer_idx", "left_semi")
    return own.withColumn("customer_idx", -F.col("customer_idx") - 1)


def _custom(s: Store):
    """Each target-week buyer's history replayed as a hand-made one under a negative id."""
    x = stored_frame(s)
    custom = replayed(s)
    people = s.customers.join(s.eval_customers, "customer_idx", "left_semi").withColumn("customer_idx", -F.col("customer_idx") - 1)
    return rc.recommend_custom(s.history, custom, people, s.state(), s.customers, fixed_model(x), CAL).select("customer_idx", "article_idx", "pos")


register(
    "custom_history_recommendations", "customer_idx:l article_idx:l pos:i", _custom,
    "SELECT -customer_idx - 1 AS customer_idx, article_idx, pos FROM xtop",
)
