"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores. The fact table is converted to
the weekly layout once (timed as ``convert_fact``); all other queries read that.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from shelfwise.operators import baselines as bl
from shelfwise.operators import candidate_eval as ev
from shelfwise.operators import copurchase as cop
from shelfwise.operators import experiment as ex
from shelfwise.operators import explain as xp
from shelfwise.operators import features as ft
from shelfwise.operators import metrics as mt
from shelfwise.operators import profiling as pf
from shelfwise.operators import ranker as rk
from shelfwise.operators import resampling as rs
from shelfwise.plans import candidate_run as cr
from shelfwise.plans import evaluation as pe
from shelfwise.plans.fold_features import fold_frame
from shelfwise.session import build_session, materialize
from shelfwise.sources import retail_view as rv
from shelfwise.sources.splits import active_customers, build_holdout_fold
from shelfwise.sources.tables import load_transactions, write_transactions


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    cal, week = rv.STORE_CALENDAR, rv.STORE_CALENDAR.holdout_week
    work = tempfile.mkdtemp(prefix="bench-")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def run(name, build):
        start = time.time()
        out = build()
        if out is not None:
            rows[name] = out.count() if os.environ.get("BENCH_ROWS") else -1
            if rows[name] < 0:
                out.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        return out

    articles, customers = rv.articles(spark, folder), rv.customers(spark, folder)
    run("convert_fact", lambda: write_transactions(rv.transactions(spark, folder), f"{work}/fact"))
    tx = load_transactions(spark, f"{work}/fact", cal)
    fold = build_holdout_fold(tx, cal)
    hist = fold.history
    settings = cr.RunSettings(min_pair_count=2, basket_weeks=400, seed_weeks=52, code_weeks=52)
    state = {}

    def build_state():
        state["s"] = cr.build_state(hist, week, cal, articles, customers, settings)

    run("copurchase_edges", lambda: cop.copurchase_edges(hist, week, 400, 2))
    run("state_build", build_state)
    run("all_customer_candidates", lambda: cr.generate_for_everyone(hist, state["s"]))
    run("customer_features", lambda: ft.customer_features(hist, week, customers, cal))
    run("article_features", lambda: ft.article_features(hist, week, articles, customers, cal))

    def features(serve):
        return fold_frame(fold, cal, articles, customers, settings, serve, state["s"])

    run("fold_features", lambda: features(None))
    run("all_customer_features", lambda: features(active_customers(tx, week)))
    merged = materialize(cr.generate(hist, fold.eval_customers, state["s"]))
    run("candidate_recall", lambda: ev.candidate_recall(merged, fold.truth))
    heuristic = materialize(bl.heuristic_lists(merged))
    base = materialize(bl.recent_then_popular(hist, week, fold.eval_customers))
    run("metric_suite_1000_resamples", lambda: pe.metric_suite("heuristic", heuristic, fold.truth, hist, 1000))
    outcomes = materialize(mt.outcome_table(heuristic, base, fold.truth))
    run("paired_difference_1000_resamples", lambda: rs.paired_difference(outcomes, "ranker_ap", "heuristic_ap", 1000))
    everyone = materialize(
        pe.customer_repeat_rates(hist).select("customer_idx", F.when(F.col("rate") > 0, 1.0).otherwise(0.0).alias("hit"))
    )
    run("aa_calibration_1000_splits", lambda: ex.aa_calibration(everyone, "hit", 1000))
    x = materialize(features(None))
    model = rk.LinearRanker(tuple(ft.FEATURES[i].name for i in range(len(ft.FEATURES))), *_moments(x))
    run("score_and_top_lists", lambda: xp.mark_top(model.score(x)))
    run("contributions_and_reasons", lambda: xp.reasons(xp.with_contrast(xp.contributions(x, model))))
    run("reasons_of_top_lists", lambda: xp.reasons(xp.contrasts_of(x, model, xp.mark_top(model.score(x)), xp.THEMES)))
    run("repeat_rates", lambda: pf.repeat_rates(tx, articles))
    run("weekly_overlap", lambda: pf.weekly_overlap(tx))
    run("basket_sizes", lambda: pf.distribution(pf.basket_sizes(tx), "basket_size"))
    line = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
    if os.environ.get("BENCH_ROWS"):
        line["rows"] = rows
    spark.stop()
    print(json.dumps(line))


def _moments(x):
    names = [f.name for f in ft.FEATURES]
    means, stds = rk.column_stats(x, names)
    return means, stds, tuple(((i * 37) % 11 - 5) / 10 for i in range(len(names)))


if __name__ == "__main__":
    main()
