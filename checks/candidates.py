"""Candidate sources, merge and their evaluation."""

from pyspark.sql import functions as F

from checks.base import CAL, CTE, SETTINGS, WEEK, Store, register
from shelfwise.functions.columns import age_bucket
from shelfwise.operators import candidate_eval as ev
from shelfwise.operators import candidates as cand
from shelfwise.operators import copurchase as cop
from shelfwise.operators import merge as mg
from shelfwise.operators import metrics as mt
from shelfwise.plans import candidate_run as cr
from shelfwise.sources import splits

C = "customer_idx:l article_idx:l score:d source_rank:i"
RN = "row_number() OVER (PARTITION BY customer_idx ORDER BY {})"


def top(table: str, order: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT customer_idx, article_idx, CAST(score AS FLOAT) AS score,
      row_number() OVER (PARTITION BY customer_idx ORDER BY {order}) AS source_rank FROM {table}) WHERE source_rank <= {k}"""


CTE["rep_pairs"] = """SELECT customer_idx, article_idx, max(t_dat) AS d, count(*) AS n,
  datediff('day', DATE '1970-01-01', max(t_dat)) AS score FROM hist SEMI JOIN who USING (customer_idx) GROUP BY customer_idx, article_idx"""
CTE["c_rep"] = top("rep_pairs", "d DESC, n DESC, article_idx", 50)
CTE["c_recent"] = top("rep_pairs", "d DESC, article_idx", 50)
CTE["last_sales"] = f"SELECT article_idx, count(*) AS n FROM hist WHERE week_idx = {WEEK - 1} GROUP BY article_idx"
CTE["code_pairs"] = f"""SELECT w.customer_idx, a.article_idx, coalesce(s.n, 0) AS score
  FROM (SELECT DISTINCT customer_idx, product_code FROM bought JOIN art USING (article_idx)
        WHERE last_week >= {WEEK - SETTINGS.code_weeks}) w
  JOIN art a USING (product_code) ANTI JOIN bought b ON b.customer_idx = w.customer_idx AND b.article_idx = a.article_idx
  LEFT JOIN last_sales s ON s.article_idx = a.article_idx"""
CTE["c_code"] = top("code_pairs", "score DESC, article_idx", 50)
CTE["items"] = f"""SELECT DISTINCT customer_idx, t_dat, article_idx FROM hist
  WHERE week_idx >= {WEEK - SETTINGS.basket_weeks}"""
CTE["pairs"] = f"""SELECT x.article_idx AS a, y.article_idx AS b, count(*) AS n FROM items x
  JOIN items y ON x.customer_idx = y.customer_idx AND x.t_dat = y.t_dat AND x.article_idx < y.article_idx
  GROUP BY 1, 2 HAVING count(*) >= {SETTINGS.min_pair_count}"""
CTE["item_n"] = "SELECT article_idx, CAST(count(*) AS DOUBLE) AS n FROM items GROUP BY article_idx"
CTE["half_edges"] = """SELECT p.a, p.b, p.n / sqrt(i.n * j.n) AS c FROM pairs p
  JOIN item_n i ON i.article_idx = p.a JOIN item_n j ON j.article_idx = p.b"""
CTE["edges"] = """SELECT a AS seed_article, b AS candidate_article, c AS cosine_score FROM half_edges
  UNION ALL SELECT b, a, c FROM half_edges"""
CTE["cop_pairs"] = f"""SELECT s.customer_idx, e.candidate_article AS article_idx, round(sum(cosine_score), 9) AS score
  FROM (SELECT customer_idx, article_idx FROM bought WHERE last_week >= {WEEK - SETTINGS.seed_weeks}) s
  JOIN edges e ON e.seed_article = s.article_idx
  ANTI JOIN bought b ON b.customer_idx = s.customer_idx AND b.article_idx = e.candidate_article GROUP BY 1, 2"""
CTE["c_cop"] = top("cop_pairs", "score DESC, article_idx", 50)
CTE["lw_top"] = """SELECT article_idx, n AS score, row_number() OVER (ORDER BY n DESC, article_idx) AS source_rank
  FROM last_sales QUALIFY source_rank <= 200"""
CTE["dec_sum"] = f"""SELECT article_idx,
  round(sum(1e0 / (1e0 + datediff('day', t_dat, DATE '1994-12-28' + {WEEK * 7}))), 9) AS score
  FROM hist WHERE week_idx >= {WEEK - 4} GROUP BY article_idx"""
CTE["dec_top"] = """SELECT article_idx, score, row_number() OVER (ORDER BY score DESC, article_idx) AS source_rank
  FROM dec_sum QUALIFY source_rank <= 100"""
CTE["seg_top"] = f"""SELECT age_bucket, article_idx, count(*) AS score,
  row_number() OVER (PARTITION BY age_bucket ORDER BY count(*) DESC, article_idx) AS source_rank
  FROM hist JOIN bucket USING (customer_idx) WHERE week_idx >= {WEEK - 2} GROUP BY age_bucket, article_idx QUALIFY source_rank <= 50"""
CTE["c_lw"] = "SELECT customer_idx, article_idx, CAST(score AS FLOAT) AS score, source_rank FROM who CROSS JOIN lw_top"
CTE["c_dec"] = "SELECT customer_idx, article_idx, CAST(score AS FLOAT) AS score, source_rank FROM who CROSS JOIN dec_top"
CTE["c_seg"] = """SELECT customer_idx, article_idx, CAST(score AS FLOAT) AS score, source_rank
  FROM who JOIN bucket USING (customer_idx) JOIN seg_top USING (age_bucket)"""
NAMES = {
    "repurchase": "c_rep",
    "product_code": "c_code",
    "copurchase": "c_cop",
    "popularity_last_week": "c_lw",
    "popularity_decayed": "c_dec",
    "segment_popular": "c_seg",
}
CTE["tagged"] = " UNION ALL ".join(
    f"SELECT {i} AS prio, '{s}' AS source, customer_idx, article_idx, score, source_rank FROM {t}"
    for i, (s, t) in enumerate(NAMES.items())
)
_PIVOT = ", ".join(
    f"max(score) FILTER (source = '{s}') AS {s}_score, max(source_rank) FILTER (source = '{s}') AS {s}_rank" for s in NAMES
)
CTE["merged"] = f"""SELECT * FROM (SELECT customer_idx, article_idx, arg_min(source, prio * 1000 + source_rank) AS final_source,
  row_number() OVER (PARTITION BY customer_idx ORDER BY min(prio * 1000 + source_rank)) AS final_rank, {_PIVOT}
  FROM tagged GROUP BY customer_idx, article_idx) WHERE final_rank <= 200"""
CTE["preds"] = "SELECT customer_idx, article_idx, final_rank AS pos FROM merged WHERE final_rank <= 12"
MERGED = "customer_idx:l article_idx:l final_source:s final_rank:i " + " ".join(
    f"{s}_score:d {s}_rank:i" for s in NAMES
)

register("candidates_repurchase", C, lambda s: cand.repurchase(s.history, WEEK, s.eval_customers), "SELECT * FROM c_rep")
register(
    "candidates_repurchase_recency_only", C,
    lambda s: cand.repurchase(s.history, WEEK, s.eval_customers, ordering="recency_only"), "SELECT * FROM c_recent",
)
register(
    "candidates_product_code", C,
    lambda s: cand.product_code_siblings(s.history, WEEK, s.eval_customers, s.articles, lookback_weeks=SETTINGS.code_weeks),
    "SELECT * FROM c_code",
)
register(
    "copurchase_edges", "seed_article:l candidate_article:l cosine_score:d",
    lambda s: cop.copurchase_edges(s.history, WEEK, SETTINGS.basket_weeks, SETTINGS.min_pair_count), "SELECT * FROM edges",
)
register(
    "candidates_copurchase", C,
    lambda s: cop.copurchase_candidates(
        s.history, WEEK, s.eval_customers,
        cop.copurchase_edges(s.history, WEEK, SETTINGS.basket_weeks, SETTINGS.min_pair_count),
        customer_lookback_weeks=SETTINGS.seed_weeks,
    ),
    "SELECT * FROM c_cop",
)
register(
    "candidates_popularity_last_week", C,
    lambda s: cand.popularity_last_week(s.history, WEEK, s.eval_customers), "SELECT * FROM c_lw",
)
register(
    "candidates_popularity_decayed", C,
    lambda s: cand.popularity_decayed(s.history, WEEK, s.eval_customers, CAL), "SELECT * FROM c_dec",
)
register(
    "candidates_popularity_exponential", "article_idx:l score:d source_rank:i",
    lambda s: cand.decayed_top(s.history, WEEK, CAL, decay="exp"),
    f"""SELECT article_idx, round(sum(power(0.5e0, datediff('day', t_dat, DATE '1994-12-28' + {WEEK * 7}) / 7e0)), 9) AS score,
    row_number() OVER (ORDER BY round(sum(power(0.5e0, datediff('day', t_dat, DATE '1994-12-28' + {WEEK * 7}) / 7e0)), 9) DESC, article_idx) AS source_rank
    FROM hist WHERE week_idx >= {WEEK - 4} GROUP BY article_idx QUALIFY source_rank <= 100""",
)
register(
    "candidates_segment_popular", C,
    lambda s: cand.segment_popular(s.history, WEEK, s.eval_customers, s.customers), "SELECT * FROM c_seg",
)
register(
    "candidate_contract_report", "source:s n_rows:l n_repeated_pairs:l max_rank:i n_bad_ranks:l",
    lambda s: _contract(s),
    " UNION ALL ".join(
        f"""SELECT '{n}' AS source, count(*) AS n_rows, count(*) - count(DISTINCT (customer_idx, article_idx)) AS n_repeated_pairs,
        max(source_rank) AS max_rank, count(*) FILTER (source_rank > {SETTINGS.k[n]} OR source_rank < 1) AS n_bad_ranks FROM {t}"""
        for n, t in NAMES.items()
    ),
)


def _contract(s: Store):
    out = None
    for name, df in s.sources.items():
        part = cand.contract_report(df, SETTINGS.k[name]).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


register("merge_candidates", MERGED, lambda s: mg.merge_candidates(s.sources), "SELECT * FROM merged")
register("all_sources_for_fold", MERGED, lambda s: s.merged, "SELECT * FROM merged")
EVERYONE = {"who": "SELECT DISTINCT customer_idx FROM hist"}
register(
    "all_customer_candidates", MERGED, lambda s: cr.generate_for_everyone(s.history, s.state()),
    "SELECT * FROM merged", EVERYONE,
)
STATS = "n_customers:l mean_candidates:d median_candidates:d p10:d p90:d pct_at_budget:d"
register(
    "candidate_count_stats", STATS,
    lambda s: mg.candidate_count_stats(cr.generate_for_everyone(s.history, s.state())),
    """SELECT count(*) AS n_customers, avg(n) AS mean_candidates, median(n) AS median_candidates,
    (SELECT n FROM sz ORDER BY n LIMIT 1 OFFSET (SELECT CAST(round((count(*) - 1) * 0.1e0) AS BIGINT) FROM sz)) AS p10,
    (SELECT n FROM sz ORDER BY n LIMIT 1 OFFSET (SELECT CAST(round((count(*) - 1) * 0.9e0) AS BIGINT) FROM sz)) AS p90,
    count(*) FILTER (n = 200) * 100e0 / count(*) AS pct_at_budget FROM sz""",
    {**EVERYONE, "sz": "SELECT customer_idx, count(*) AS n FROM merged GROUP BY customer_idx"},
)
register(
    "active_customers", "customer_idx:l", lambda s: splits.active_customers(s.tx, WEEK),
    "SELECT DISTINCT customer_idx FROM hist",
)


def _pair_sweep(s: Store):
    """Recall of the co-purchase source for several minimum pair counts."""
    out = None
    for m in (2, 3, 5):
        edges = cop.copurchase_edges(s.history, WEEK, SETTINGS.basket_weeks, m)
        got = cop.copurchase_candidates(s.history, WEEK, s.eval_customers, edges, customer_lookback_weeks=SETTINGS.seed_weeks)
        hits = got.join(s.truth, mt.PAIR, "left_semi").agg(F.count("*").alias("n_hits"))
        part = edges.agg(F.lit(m).alias("min_count"), (F.count("*") / 2).alias("n_pairs"))
        part = part.withColumn("n_candidates", got.agg(F.count("*").alias("n")).scalar())
        part = part.withColumn("n_hits", hits.scalar())
        out = part if out is None else out.unionByName(part)
    return out


register(
    "sweep_copurchase_min_count", "min_count:i n_pairs:l n_candidates:l n_hits:l", _pair_sweep,
    " UNION ALL ".join(
        f"""SELECT {m} AS min_count, (SELECT count(*) FROM pairs WHERE n >= {m}) AS n_pairs,
        (SELECT count(*) FROM sw_{m}) AS n_candidates, (SELECT count(*) FROM sw_{m} SEMI JOIN truth USING (customer_idx, article_idx)) AS n_hits"""
        for m in (2, 3, 5)
    ),
    {
        f"sw_{m}": f"""SELECT customer_idx, article_idx, row_number() OVER (PARTITION BY customer_idx ORDER BY round(sum(c), 9) DESC, article_idx) AS r
        FROM (SELECT s.customer_idx, e.candidate_article AS article_idx, e.cosine_score AS c
          FROM (SELECT * FROM bought WHERE last_week >= {WEEK - SETTINGS.seed_weeks}) s
          JOIN (SELECT e0.* FROM edges e0 JOIN pairs p ON p.n >= {m} AND p.a = least(seed_article, candidate_article)
                AND p.b = greatest(seed_article, candidate_article)) e ON e.seed_article = s.article_idx
          ANTI JOIN bought b ON b.customer_idx = s.customer_idx AND b.article_idx = e.candidate_article)
        GROUP BY 1, 2 QUALIFY r <= 50"""
        for m in (2, 3, 5)
    },
)


def _popularity_sweep(s: Store):
    out = None
    for k in (100, 200):
        best = cand.last_week_top(s.history, WEEK, k)
        hits = s.truth.join(best, "article_idx", "left_semi").agg(F.count("*").alias("n_hits"))
        part = hits.withColumn("k", F.lit(k)).withColumn("n_truth", s.truth.agg(F.count("*").alias("n")).scalar())
        out = part if out is None else out.unionByName(part)
    return out.withColumn("recall", F.col("n_hits") / F.col("n_truth"))


register(
    "sweep_popularity_budget", "k:i n_hits:l n_truth:l recall:d", _popularity_sweep,
    """SELECT k, (SELECT count(*) FROM truth SEMI JOIN (SELECT * FROM lw_top WHERE source_rank <= k) l USING (article_idx)) AS n_hits,
    (SELECT count(*) FROM truth) AS n_truth,
    (SELECT count(*) FROM truth SEMI JOIN (SELECT * FROM lw_top WHERE source_rank <= k) l USING (article_idx)) * 1e0 / (SELECT count(*) FROM truth) AS recall FROM (VALUES (100), (200)) v(k)""",
)


def _window_sweep(s: Store):
    out = None
    for name, weeks in (("all", None), ("12", 12), ("4", 4)):
        got = cand.repurchase(s.history, WEEK, s.eval_customers, lookback_weeks=weeks)
        part = got.join(s.truth.withColumn("hit", F.lit(1)), mt.PAIR, "left").agg(
            F.lit(name).alias("window"), F.count("*").alias("n_candidates"), F.count("hit").alias("n_hits")
        )
        out = part if out is None else out.unionByName(part)
    return out


_WIN = {"all": 0, "12": WEEK - 12, "4": WEEK - 4}
register(
    "sweep_repurchase_window", "window_weeks:s n_candidates:l n_hits:l",
    lambda s: _window_sweep(s).withColumnRenamed("window", "window_weeks"),
    " UNION ALL ".join(
        f"""SELECT '{n}' AS window_weeks, count(*) AS n_candidates, count(t.article_idx) AS n_hits
        FROM (SELECT customer_idx, article_idx FROM hist SEMI JOIN who USING (customer_idx) WHERE week_idx >= {lo} GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY customer_idx ORDER BY max(t_dat) DESC, count(*) DESC, article_idx) <= 50) c
        LEFT JOIN truth t USING (customer_idx, article_idx)"""
        for n, lo in _WIN.items()
    ),
)

# --- evaluation --------------------------------------------------------------------

CUTS = (20, 50, 100, 200)
RECALLS = " ".join(f"recall_{c}:d" for c in CUTS)


def recalls(rank: str, total: str = "count(*)") -> str:
    return ", ".join(f"count(*) FILTER ({rank} <= {c}) * 1e0 / {total} AS recall_{c}" for c in CUTS)


register(
    "candidate_recall", "n_eval_customers:l coverage:d mean_candidates:d " + RECALLS,
    lambda s: ev.candidate_recall(s.merged, s.truth),
    f"""SELECT (SELECT count(*) FROM evalc) AS n_eval_customers,
    (SELECT count(DISTINCT customer_idx) FROM merged) * 1e0 / (SELECT count(*) FROM evalc) AS coverage,
    (SELECT avg(n) FROM (SELECT count(*) AS n FROM merged GROUP BY customer_idx)) AS mean_candidates, {recalls('final_rank')}
    FROM truth LEFT JOIN merged USING (customer_idx, article_idx)""",
)
register(
    "recall_by_source", "source:s coverage:d " + RECALLS, lambda s: ev.recall_by_source(s.sources, s.truth),
    f"""SELECT source, count(DISTINCT customer_idx) * 1e0 / (SELECT count(*) FROM evalc) AS coverage,
    {', '.join(f"count(t.article_idx) FILTER (source_rank <= {c}) * 1e0 / (SELECT count(*) FROM truth) AS recall_{c}" for c in CUTS)}
    FROM tagged LEFT JOIN truth t USING (customer_idx, article_idx) GROUP BY source""",
)
register(
    "incremental_recall", "step:i source_added:s " + " ".join(f"recall_{c}:d gain_{c}:d" for c in CUTS),
    lambda s: ev.incremental_recall(s.sources, s.truth),
    "SELECT step, source_added, " + ", ".join(
        f"recall_{c}, recall_{c} - coalesce(lag(recall_{c}) OVER (ORDER BY step), 0) AS gain_{c}" for c in CUTS
    ) + " FROM steps",
    {
        "ranked_steps": """SELECT p.step, customer_idx, article_idx,
          row_number() OVER (PARTITION BY p.step, customer_idx ORDER BY min(prio * 1000 + source_rank)) AS r
          FROM tagged JOIN (SELECT unnest(range(1, 7)) AS step) p ON prio < p.step GROUP BY 1, 2, 3""",
        "steps": "SELECT step, (" + "CASE step " + " ".join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(NAMES))
        + " END) AS source_added, " + ", ".join(
            f"count(*) FILTER (r <= {c}) * 1e0 / (SELECT count(*) FROM truth) AS recall_{c}" for c in CUTS
        ) + " FROM ranked_steps SEMI JOIN truth USING (customer_idx, article_idx) GROUP BY step",
    },
)
register(
    "source_overlap", "source_a:s source_b:s n_both:l n_either:l jaccard:d", lambda s: ev.source_overlap(s.sources),
    """SELECT x.source AS source_a, y.source AS source_b, coalesce(b.n, 0) AS n_both, x.n + y.n - coalesce(b.n, 0) AS n_either,
    coalesce(b.n, 0) * 1e0 / (x.n + y.n - coalesce(b.n, 0)) AS jaccard
    FROM (SELECT prio, source, count(*) AS n FROM tagged GROUP BY 1, 2) x
    JOIN (SELECT prio, source, count(*) AS n FROM tagged GROUP BY 1, 2) y ON x.prio < y.prio
    LEFT JOIN (SELECT p.source AS sa, q.source AS sb, count(*) AS n FROM tagged p JOIN tagged q
      ON p.customer_idx = q.customer_idx AND p.article_idx = q.article_idx AND p.prio < q.prio GROUP BY 1, 2) b
      ON b.sa = x.source AND b.sb = y.source""",
)
CTE["prior"] = """SELECT e.customer_idx, count(h.article_idx) AS prior_count FROM evalc e
  LEFT JOIN hist h USING (customer_idx) GROUP BY e.customer_idx"""
CTE["segs"] = """SELECT customer_idx, prior_count, CASE WHEN prior_count = 0 THEN '0' WHEN prior_count <= 4 THEN '1-4'
  WHEN prior_count <= 19 THEN '5-19' ELSE '20+' END AS segment FROM prior"""
register(
    "purchase_segments", "customer_idx:l prior_count:l segment:s",
    lambda s: ev.purchase_segments(s.history, s.eval_customers), "SELECT * FROM segs",
)
register(
    "recall_by_segment", "segment:s n_customers:l " + RECALLS,
    lambda s: ev.recall_by_segment(s.merged, s.truth, ev.purchase_segments(s.history, s.eval_customers)),
    f"""SELECT segment, count(DISTINCT t.customer_idx) AS n_customers, {recalls('final_rank')} FROM truth t JOIN segs USING (customer_idx)
    LEFT JOIN merged m ON m.customer_idx = t.customer_idx AND m.article_idx = t.article_idx GROUP BY segment""",
)
register(
    "oracle_bound", "oracle_map:d candidate_precision:d total_hits:l total_candidates:l n_customers:l",
    lambda s: ev.oracle_bound(s.merged, s.truth),
    """SELECT avg(least(h, 12) * 1e0 / least(n, 12)) AS oracle_map, avg(CASE WHEN m > 0 THEN h * 1e0 / m ELSE 0 END) AS candidate_precision,
    sum(h) AS total_hits, sum(m) AS total_candidates, count(*) AS n_customers
    FROM (SELECT customer_idx, count(*) AS n FROM truth GROUP BY 1)
    LEFT JOIN (SELECT customer_idx, count(*) AS m, count(t.article_idx) AS h FROM merged LEFT JOIN truth t USING (customer_idx, article_idx) GROUP BY 1)
    USING (customer_idx)""",
)
register(
    "ordering_comparison", "n_customers:l n_order_differs:l n_set_differs:l n_difference_hits:l",
    lambda s: ev.compare_orders(
        cand.repurchase(s.history, WEEK, s.eval_customers, 12).withColumnRenamed("source_rank", "pos"),
        cand.repurchase(s.history, WEEK, s.eval_customers, 12, ordering="recency_only").withColumnRenamed("source_rank", "pos"),
        s.truth,
    ),
    """SELECT count(*) AS n_customers, count(*) FILTER (o) AS n_order_differs, count(*) FILTER (d) AS n_set_differs,
    count(*) FILTER (h) AS n_difference_hits FROM (SELECT customer_idx, bool_or(a IS DISTINCT FROM b) AS o,
      bool_or((a IS NULL) <> (b IS NULL)) AS d, bool_or((a IS NULL) <> (b IS NULL) AND t) AS h
      FROM (SELECT customer_idx, article_idx, p.source_rank AS a, q.source_rank AS b,
        (customer_idx, article_idx) IN (SELECT (customer_idx, article_idx) FROM truth) AS t
        FROM (SELECT * FROM c_rep WHERE source_rank <= 12) p FULL JOIN (SELECT * FROM c_recent WHERE source_rank <= 12) q
        USING (customer_idx, article_idx)) GROUP BY 1)""",
)
_ = age_bucket
