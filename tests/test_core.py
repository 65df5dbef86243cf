"""Hand tables with known answers, brute-force comparisons and leakage checks."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import bitmaps, skew
from shelfwise.functions import columns as col
from shelfwise.functions import ordering as od
from shelfwise.functions.skew import expansion_join
from shelfwise.functions.student import two_sided_t
from shelfwise.operators import candidates as cand
from shelfwise.operators import copurchase as cop
from shelfwise.operators import experiment as ex
from shelfwise.operators import explain as xp
from shelfwise.operators import features as ft
from shelfwise.operators import merge as mg
from shelfwise.operators import metrics as mt
from shelfwise.operators import profiling
from shelfwise.operators.partials import of_history, rolled
from shelfwise.plans import candidate_run as cr
from shelfwise.plans.fold_features import build_fold_features
from shelfwise.schema import FEATURE_NAMES, FEATURES, RETAIL_CALENDAR as CAL
from shelfwise.sources import splits, tables

HISTORY = [
    (1, 10, 8, 0.10, 1), (1, 10, 9, 0.20, 2), (1, 20, 7, 0.30, 1),
    (2, 10, 5, 0.15, 2), (2, 10, 6, 0.15, 2), (3, 10, 9, 0.10, 1),
]


@pytest.fixture(scope="module")
def customers(spark):
    rows = [(1, 30.0, "ACTIVE", "Regularly", 1.0, 1.0), (2, 40.0, "PRE-CREATE", "Monthly", None, None), (3, 50.0, None, None, 0.0, 1.0)]
    return spark.createDataFrame(
        rows, "customer_idx int, age double, club_member_status string, fashion_news_frequency string, FN double, Active double"
    )


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(a, f"{a:010d}", f"name{a}", code, 1, "t", "g", "ig", "gg", "col", "sec", 7) for a, code in ((10, "A"), (20, "A"), (30, "B"))]
    return spark.createDataFrame(
        rows,
        "article_idx int, article_id string, prod_name string, product_code string, product_type_no int, product_type_name string, "
        "product_group_name string, index_group_name string, garment_group_name string, colour_group_name string, section_name string, department_no int",
    )


def test_week_axis():
    assert CAL.anchor.weekday() == 2
    assert CAL.week_bounds(104) == (dt.date(2020, 9, 16), dt.date(2020, 9, 22))
    assert CAL.week_of(dt.date(2018, 9, 18)) == -1


def test_week_index_floors_and_accepts_epoch_days(spark):
    df = spark.createDataFrame([(CAL.anchor_day - 1,), (CAL.anchor_day,), (CAL.anchor_day + 7,)], "t_dat int")
    assert [r.week_idx for r in tables.with_week_index(df, CAL).orderBy("t_dat").collect()] == [-1, 0, 1]


def test_holdout_needs_permission(make_tx):
    tx = make_tx([(1, 10, 104, 0.1, 1)])
    with pytest.raises(ValueError):
        splits.build_fold(tx, 104, CAL)
    assert splits.build_holdout_fold(tx, CAL).truth.count() == 1
    with pytest.raises(ValueError):
        splits.check_no_future_rows(tx, 104)


def test_customer_and_article_features(make_tx, customers, articles):
    tx = make_tx(HISTORY)
    c = {r.customer_idx: r for r in ft.customer_features(tx, 10, customers, CAL).collect()}
    assert (c[1].c_n_purchases, c[1].c_n_purchases_1w, c[1].c_n_unique_articles, c[1].c_days_since_last_purchase) == (3, 1, 2, 7)
    assert c[1].c_online_share == pytest.approx(1 / 3) and c[2].c_online_share == 1.0
    assert (c[2].c_n_purchases_1w, c[2].c_days_since_last_purchase) == (0, 28)
    assert [(c[i].c_club_member_status, c[i].c_FN) for i in (1, 2, 3)] == [(1, 1), (0, -1), (-1, 0)]
    a = {r.article_idx: r for r in ft.article_features(tx, 10, articles, customers, CAL).collect()}
    assert (a[10].a_sales_1w, a[10].a_sales_4w, a[10].a_trend_ratio, a[10].a_days_since_last_sale) == (2, 4, 2.0, 7)
    assert a[10].a_repurchase_rate == pytest.approx(2 / 3)
    assert a[10].a_price_vs_own_history == pytest.approx(0.15 / 0.14)
    assert a[10].a_mean_buyer_age_12w == pytest.approx(38.0)
    assert a[30].a_sales_1w == 0 and a[30].a_days_since_first_sale is None


def test_repurchase_order(spark):
    d = lambda n: dt.date(2019, 1, 1) + dt.timedelta(days=n)
    rows = [(10, 100, d(100)), (10, 200, d(50)), (20, 300, d(80)), (20, 400, d(80)), (20, 400, d(80)), (20, 400, d(80))]
    tx = tables.with_week_index(spark.createDataFrame(rows, "customer_idx int, article_idx int, t_dat date"), CAL)

    def order(mode):
        got = cand.repurchase(tx, 104, None, 50, ordering=mode).orderBy("customer_idx", "source_rank").collect()
        return [r.article_idx for r in got]

    assert order("recency_only") == [100, 200, 300, 400]
    assert order("production") == [100, 200, 400, 300]


def test_merge_rules(spark):
    schema = "customer_idx int, article_idx int, score float, source_rank int"
    one = spark.createDataFrame([(1, 10, 100.0, 2), (1, 20, 50.0, 1)], schema)
    got = mg.merge_candidates({"A": one}, 10, ["A"]).orderBy("final_rank").collect()
    assert [r.article_idx for r in got] == [20, 10]
    b = spark.createDataFrame([(1, 30, 900.0, 1), (1, 10, 800.0, 2)], schema)
    got = mg.merge_candidates({"A": one, "B": b}, 3, ["A", "B"]).orderBy("final_rank").collect()
    assert [(r.article_idx, r.final_source) for r in got] == [(20, "A"), (10, "A"), (30, "B")]
    assert got[1].B_rank == 2


@pytest.mark.parametrize("min_count,direct", [(1, 2), (2, 2), (2, 3), (3, 4), (2, 100)])
def test_pair_counts_equal_brute_force(spark, min_count, direct):
    rng = random.Random(7)
    baskets = [rng.sample(range(14), rng.choice([1, 2, 3, 5, 9, 13])) for _ in range(25)] + [list(range(14))] * 2
    rows = [(i, dt.date(2020, 1, 1), a) for i, b in enumerate(baskets) for a in b]
    items = spark.createDataFrame(rows, "customer_idx int, t_dat date, article_idx int")
    want = Counter(p for b in baskets for p in combinations(sorted(b), 2))
    got = {(r.article_a, r.article_b): r.pair_count for r in cop.pair_counts(items, min_count, direct).collect()}
    assert got == {p: n for p, n in want.items() if n >= min_count}


def test_siblings_equal_brute_force(spark, make_tx):
    rng = random.Random(3)
    arts = [(a, "XYZ"[a % 3] if a < 12 else "X") for a in range(40)]
    rows = [(c, rng.randrange(40), rng.randrange(80, 100), 0.1, 1) for c in range(5) for _ in range(25)]
    tx, k = make_tx(rows), 3
    art = spark.createDataFrame(arts, "article_idx int, product_code string")
    got = cand.product_code_siblings(tx, 100, None, art, k, 12)
    have = {}
    for r in got.orderBy("customer_idx", "source_rank").collect():
        have.setdefault(r.customer_idx, []).append(r.article_idx)
    code, last = dict(arts), Counter(a for _, a, w, _, _ in rows if w == 99)
    for c in range(5):
        owned = {a for cc, a, *_ in rows if cc == c}
        codes = {code[a] for cc, a, w, *_ in rows if cc == c and w >= 88}
        want = sorted((a for a in code if code[a] in codes and a not in owned), key=lambda a: (-last[a], a))[:k]
        assert have.get(c, []) == want


def test_running_rank_and_quantiles(spark):
    rng = random.Random(1)
    vals = [(rng.randrange(3), rng.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(vals, "k int, v int, i int")
    ranked = od.running_rank(df, ["k"], [F.desc("v"), F.asc("i")]).collect()
    for key in range(3):
        order = sorted((r for r in ranked if r.k == key), key=lambda r: r["rank"])
        assert [r["rank"] for r in order] == list(range(1, len(order) + 1))
        assert [(r.v, r.i) for r in order] == sorted(((v, i) for k, v, i in vals if k == key), key=lambda t: (-t[0], t[1]))
    q = {r.k: r.p for r in od.exact_quantiles(df, ["k"], "v", {"p": 0.3}).collect()}
    for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.3)).alias("p")).collect():
        assert q[r.k] == pytest.approx(r.p)


def test_average_precision(spark):
    truth = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2), (3, 9)], "customer_idx int, article_idx int")
    preds = spark.createDataFrame(
        [(1, a, i + 1) for i, a in enumerate([1, 2, 3, 4])] + [(2, a, i + 1) for i, a in enumerate([1, 1, 2, 3])],
        "customer_idx int, article_idx int, pos int",
    )
    users = mt.per_customer_metrics(preds, truth)
    rows = {r.customer_idx: r for r in users.collect()}
    assert rows[1].ap == pytest.approx((1 + 2 / 3) / 2) and rows[2].ap == pytest.approx((1 + 2 / 3) / 2)
    assert rows[3].ap == 0 and not rows[3].has_preds
    assert rows[2].precision == pytest.approx(3 / 12)
    assert mt.summarize_metrics(users).first().hit_rate == 1.0
    assert mt.summarize_metrics(users, "zero").first().hit_rate == pytest.approx(2 / 3)


def test_sentinel_never_reaches_features(spark, make_tx, customers, articles):
    base = HISTORY + [(2, 30, 9, 0.2, 1), (1, 30, 10, 0.2, 1), (3, 10, 10, 0.1, 1)]
    spoiled = base + [(2, 20, 10, 999.0, 2)] * 3
    settings = cr.RunSettings(min_pair_count=1)

    def build(rows):
        x = build_fold_features(make_tx(rows), 10, CAL, articles, customers, settings)
        return x.filter("customer_idx in (1, 3)").drop("label")

    clean, other = build(base), build(spoiled)
    assert [f.name for f in clean.schema][2:] == FEATURE_NAMES
    assert all(clean.schema[f.name].dataType == f.type for f in FEATURES)
    assert clean.count() > 0
    assert clean.exceptAll(other).count() == 0 and other.exceptAll(clean).count() == 0


def test_statistics(spark):
    t = spark.createDataFrame([(100, 1000, 150, 1000)], "a int, na int, b int, nb int")
    r = ex.z_test(t, "a", "na", "b", "nb").first()
    assert r.z == pytest.approx(3.381, abs=1e-3) and r.ci_lo == pytest.approx(0.0211, abs=1e-4)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    got = {x.k: x.p_adj for x in ex.holm(p, "p", ["k"]).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})
    rates = spark.createDataFrame([("x", 144038, 0.0857)], "segment string, n_customers int, base_rate double")
    n = [x.n_per_arm for x in ex.power_table(rates).orderBy("lift").collect()]
    for have, want in zip(n, (1682326, 422475, 68503, 17502)):
        assert abs(have - want) / want < 1e-3
    assert two_sided_t(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    z = spark.range(1).select(col.normal_cdf(F.lit(1.96)).alias("p")).first().p
    assert z == pytest.approx(0.9750021, abs=1e-6)


def test_aa_calibration(spark):
    users = spark.range(5000).select(F.col("id").alias("customer_idx"), F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.0).alias("hit"))
    r = ex.aa_calibration(users, "hit", 400).first()
    assert 0.03 <= r.rejection_rate <= 0.07


def test_reason_rules(spark):
    rows = [
        ("i_customer_share_product_group", 0.30), ("i_customer_share_product_group", 0.12), ("i_customer_share_product_group", 0.05),
        ("i_days_since_bought_article", 1.0), ("i_days_since_bought_article", 0.0), ("a_trend_ratio", 1.04), ("a_trend_ratio", 1.5),
    ]
    df = spark.createDataFrame(rows, "feature string, value double")
    got = [r.t for r in df.select(xp.reason_text(F.col("feature"), F.col("value")).alias("t")).collect()]
    assert got[0] == "In a product category you buy often (30% of your purchases)"
    assert got[1] == "In a product category you've bought from before (12% of your purchases)"
    assert got[2] is None and got[3] == "You bought this exact item 1 day ago" and got[4] is None and got[5] is None
    assert got[6] == "Trending: 50% more sales this week than its 4-week average"
    long = spark.createDataFrame(
        [(1, 1, "i_days_since_bought_article", 3.0, 0.5), (1, 1, "i_days_since_bought_product_code", 3.0, 0.9), (1, 1, "a_trend_ratio", 2.0, 0.1)],
        "customer_idx int, article_idx int, feature string, value double, contrast double",
    )
    assert [r.feature for r in xp.reasons(long).orderBy("place").collect()] == ["i_days_since_bought_article", "a_trend_ratio"]


def test_export_is_verified(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    tables.export_tables({"one": a}, str(tmp_path / "x"), {"week": "10"})
    assert tables.load_exported(spark, str(tmp_path / "x"))["one"].count() == 2
    a.limit(1).write.mode("overwrite").parquet(str(tmp_path / "x" / "one"))
    with pytest.raises(ValueError):
        tables.load_exported(spark, str(tmp_path / "x"))


def test_fact_round_trip_and_fold_store(spark, make_tx, tmp_path):
    tx = make_tx(HISTORY)
    tables.write_transactions(tx, str(tmp_path / "f"), rows_per_file=2)
    back = tables.load_transactions(spark, str(tmp_path / "f"), CAL).select(*tx.columns)
    assert back.exceptAll(tx).count() == 0 and tx.exceptAll(back).count() == 0
    x = tx.select("customer_idx", "article_idx", F.lit(1).alias("label"))
    for w in (100, 101):
        tables.write_fold_features(x, str(tmp_path / "s"), w)
    assert tables.read_folds(spark, str(tmp_path / "s"), [101]).count() == 6
    tables.write_holdout_features(x, str(tmp_path / "p"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("label <> -1").count() == 0


def test_last_full_week_of_a_short_last_week(spark):
    from shelfwise.sources.splits import last_full_week

    start = CAL.week_bounds(12)[0]
    for days, want in ((0, 11), (5, 11), (6, 12), (7, 12)):
        tx = spark.createDataFrame([(start + dt.timedelta(days=days),)], "t_dat date")
        assert last_full_week(tx, CAL).first().last_week == want


def test_expansion_join_cuts_heavy_keys(spark):
    left = spark.createDataFrame([(k, c) for k, n in ((1, 700), (2, 40), (3, 1), (5, 3)) for c in range(n)], "k int, c int")
    right = spark.createDataFrame([(k, a) for k, n in ((1, 90), (2, 30), (3, 50), (4, 9)) for a in range(n)], "k int, a int")
    want = sorted((k, c, a) for k, n, m in ((1, 700, 90), (2, 40, 30), (3, 1, 50)) for c in range(n) for a in range(m))
    for rows in ((20_000, 1_000), (50, 20), (1, 1)):
        got = expansion_join(left, right, ["k"], "c", "a", *rows)
        assert sorted(tuple(r) for r in got.select("k", "c", "a").collect()) == want


def test_copurchase_candidates_with_one_article_in_most_baskets(spark, make_tx, monkeypatch):
    """Article 0 is in nearly all baskets and has an edge to every other: no group of the expansion is large."""
    r = np.random.default_rng(4)
    rows = [(c, 0, 59, 0.1, 1) for c in range(400)] + [(c, int(a), 59, 0.1, 1) for c in range(400) for a in r.integers(1, 300, 4)]
    tx = make_tx(rows)
    edges = cop.copurchase_edges(tx, 60, 52, 1)
    plain = sorted(map(tuple, cop.copurchase_candidates(tx, 60, None, edges, 20).collect()))
    sizes = []

    def cut(left, right, keys, a, b):
        out = skew.expansion_join(left, right, keys, a, b, 50, 40)
        spread = out.withColumn("g", F.struct("seed_article", F.pmod(F.xxhash64(a), F.lit(8)), F.pmod(F.xxhash64(b), F.lit(8))))
        sizes.extend(r["count"] for r in spread.filter("seed_article = 0").groupBy("g").count().collect())
        return out

    monkeypatch.setattr(cop, "expansion_join", cut)
    assert sorted(map(tuple, cop.copurchase_candidates(tx, 60, None, edges, 20).collect())) == plain
    assert len(sizes) == 64 and max(sizes) <= 3 * sorted(sizes)[32]
    bought, seen = {}, {}
    for c, a, *_ in rows:
        bought.setdefault(c, set()).add(a)
    weight = {(e.seed_article, e.candidate_article): e.cosine_score for e in edges.collect()}
    for (s, a), w in weight.items():
        seen.setdefault(s, []).append((a, w))
    for c in (0, 7, 399):
        score = {}
        for s in bought[c]:
            for a, w in seen[s]:
                if a not in bought[c]:
                    score[a] = score.get(a, 0) + w
        best = sorted(score, key=lambda a: (-round(score[a], 9), a))[:20]
        assert [x[1] for x in sorted((x for x in plain if x[0] == c), key=lambda x: x[4])] == best


def test_siblings_of_one_code_that_most_customers_buy(spark, make_tx, monkeypatch):
    """One code with 60 articles and 300 buyers, some of whom own most of its head or all of it."""
    rows = [(c, c % 60, 99, 0.1, 1) for c in range(300)] + [(c, a, 99, 0.1, 1) for c in range(4) for a in range(0, 60 if c == 3 else 14 + c)]
    tx, art = make_tx(rows), spark.createDataFrame([(a, "p" if a < 60 else "q") for a in range(65)], "article_idx int, product_code string")
    got = sorted(map(tuple, cand.product_code_siblings(tx, 100, None, art, 5).collect()))
    monkeypatch.setattr(cand, "expansion_join", lambda a, b, keys, x, y: skew.expansion_join(a, b, keys, x, y, 20, 3))
    assert sorted(map(tuple, cand.product_code_siblings(tx, 100, None, art, 5).collect())) == got
    sold, bought = {}, {}
    for c, a, *_ in rows:
        sold[a] = sold.get(a, 0) + 1
        bought.setdefault(c, set()).add(a)
    order = sorted(range(60), key=lambda a: (-sold[a], a))
    for c in range(300):
        want = [a for a in order if a not in bought[c]][:5]
        assert [x[1] for x in sorted((x for x in got if x[0] == c), key=lambda x: x[4])] == want


def test_distinct_counts_by_bitmaps(spark, make_tx):
    r = np.random.default_rng(2)
    rows = [(int(c), int(a), int(w), 0.1, 1) for c, a, w in zip(r.integers(0, 90_000, 3_000), r.integers(0, 50, 3_000), r.integers(90, 100, 3_000))]
    tx = make_tx(rows)
    weekly = {w: ({c for c, _, v, *_ in rows if v == w}, {a for _, a, v, *_ in rows if v == w}, sum(v == w for _, _, v, *_ in rows)) for w in range(90, 100)}
    got = profiling.volume(tx, "week_idx")
    assert {r.week_idx: (r.n_tx, r.n_customers, r.n_articles) for r in got.collect()} == {w: (n, len(c), len(a)) for w, (c, a, n) in weekly.items()}
    assert "Expand" not in got._jdf.queryExecution().toString()
    coarse = bitmaps.merged(bitmaps.id_bitmaps(tx, ["week_idx"], "customer_idx").withColumn("half", F.col("week_idx") >= 95), ["half"])
    want = {h: len(set().union(*[weekly[w][0] for w in weekly if (w >= 95) == h])) for h in (False, True)}
    assert {r.half: r.n for r in bitmaps.distinct_counts(coarse, ["half"], "n").collect()} == want


def test_top_pairs_reach_n(spark, make_tx):
    tx = make_tx([(c, a, 99, 0.1, 1) for c, arts in ((1, (1, 2, 3)), (2, (1, 2)), (3, (1, 2, 4)), (4, (1,)), (5, (1,))) for a in arts])
    art = spark.createDataFrame([(a, f"n{a}") for a in range(1, 5)], "article_idx int, prod_name string")
    got = [(r.article_a, r.article_b, r.pair_count) for r in profiling.top_pairs(tx, 100, 52, art, 4).collect()]
    assert sorted(got) == [(1, 2, 3), (1, 3, 1), (1, 4, 1), (2, 3, 1)]


def test_rolled_partials_equal_fresh_ones(spark, make_tx, customers, articles):
    """Three weeks in a row: the state rolled on by one week equals one built from all sales, and so do the features."""
    r = np.random.default_rng(8)
    rows = [
        (int(c), int(a), int(w), float(p) / 100, int(ch))
        for c, a, w, p, ch in zip(r.integers(1, 4, 300), r.choice([10, 20, 30], 300), r.integers(4, 13, 300), r.integers(5, 40, 300), r.integers(1, 3, 300))
    ]
    tx, settings = make_tx(rows), cr.RunSettings(min_pair_count=1)

    def rounded(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect()), key=str)

    state = of_history(tx, 8, customers).saved()
    for week in (9, 10, 11):
        fresh, state = of_history(tx, week, customers).saved(), rolled(state, tx, customers).saved()
        assert state.week == week
        for name in ("by_customer", "by_article", "pairs"):
            assert rounded(getattr(state, name)) == rounded(getattr(fresh, name).select(getattr(state, name).columns)), name
    history = splits.before_week(tx, 12)
    built = [cr.build_state(history, 12, CAL, articles, customers, settings, last=last) for last in (None, state)]
    features = [build_fold_features(tx, 12, CAL, articles, customers, settings, allow_holdout=True, state=s) for s in built]
    assert rounded(features[0]) == rounded(features[1]) and features[0].count() > 0
    with pytest.raises(ValueError):
        cr.build_state(tx, 14, CAL, articles, customers, settings, last=state)
