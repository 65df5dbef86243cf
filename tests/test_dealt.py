"""Tables dealt by customer: what starts from them exchanges no rows by customer, and gives the same results."""

import re
import statistics
import time
from itertools import combinations
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.columns import hash_uniform
from shelfwise.functions.skew import left_join_dealt
from shelfwise.operators import copurchase as cop
from shelfwise.operators import explain as xp
from shelfwise.operators import partials as pt
from shelfwise.operators import signal as si
from shelfwise.operators.ranker import LinearRanker, column_stats
from shelfwise.plans import candidate_run as cr
from shelfwise.plans import recommend as rc
from shelfwise.plans.fold_features import build_fold_features
from shelfwise.schema import RETAIL_CALENDAR as CAL
from shelfwise.schema import SEED
from shelfwise.session import CO_PARTITION, conf_set, lean, materialize, materialize_by
from shelfwise.sources.splits import before_week

NAMES = ("i_age_gap", "a_trend_ratio", "c_age", "final_rank", "a_repurchase_rate")


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def x(spark):
    rows = [
        (c, a, int(a == c % 7), float((a * 7 + c) % 5), float(a % 3) if a % 4 else None, float(c), a, (a * c % 11) / 10)
        for c in range(1, 30) for a in range(1, 3 + c)
    ]
    return spark.createDataFrame(rows, "customer_idx bigint, article_idx bigint, label int, " + ", ".join(f"{n} double" if n != "final_rank" else f"{n} bigint" for n in NAMES))


@pytest.fixture(scope="module")
def model(x):
    means, stds = column_stats(x, NAMES)
    return LinearRanker(NAMES, means, stds, (0.5, -0.3, 0.2, 0.1, 0.4))


def test_column_stats(spark, x):
    y = x.withColumn("none", F.lit(None).cast("double"))
    means, stds = column_stats(y, (*NAMES, "none"))
    rows = y.collect()
    for f, m, s in zip(NAMES, means, stds):
        known = [float(r[f]) for r in rows if r[f] is not None]
        assert m == pytest.approx(statistics.fmean(known)) and s == pytest.approx(statistics.stdev(known))
    assert (means[-1], stds[-1]) == (0.0, 0.0)
    assert column_stats(y.limit(0), ("c_age",)) == ((0.0,), (0.0,))


def test_sales_are_grouped_where_they_lie(spark, make_tx):
    tx = make_tx([(c, a, w, 1.0, 1) for c in range(20) for a in range(4) for w in (1, 2)])
    dealt = materialize_by(tx, "customer_idx")
    assert sorted(dealt.collect()) == sorted(tx.collect())
    assert sorted(materialize(tx).collect()) == sorted(tx.collect())
    for df in (pt.pair_days(dealt), pt.customer_weeks(dealt), cop.basket_items(dealt, 3, 3)):
        assert "Exchange" not in plan(df)


@pytest.mark.parametrize("direct", [2, 100])
def test_pairs_of_rare_articles_and_their_baskets(spark, make_tx, direct):
    baskets = [(1, 2, 3, 4), (1, 2, 9), (1, 2, 3, 7, 8), (5,), (3, 6), (2, 3, 4)]
    tx = materialize_by(make_tx([(c, a, 1, 1.0, 1) for c, b in enumerate(baskets) for a in b]), "customer_idx")
    want = {}
    for b in baskets:
        for p in combinations(b, 2):
            want[p] = want.get(p, 0) + 1
    n = {a: sum(a in b for b in baskets) for b in baskets for a in b}
    got = {(r.article_a, r.article_b): (r.pair_count, r.na, r.nb) for r in cop.pair_counts(cop.basket_items(tx, 2, 2), 2, direct).collect()}
    assert got == {(a, b): (k, n[a], n[b]) for (a, b), k in want.items() if k >= 2}


def test_wide_contrasts_equal_long_ones(spark, x, model):
    dealt = materialize_by(x, "customer_idx")
    wide = xp.wide_contrasts(dealt, model)
    assert "Exchange" not in plan(wide)
    key = lambda r: (r.customer_idx, r.article_idx, r.feature)
    want = {key(r): r for r in xp.with_contrast(xp.contributions(x, model)).collect()}
    got = {key(r): r for r in xp.as_long(wide, model).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].value, got[k].contribution) == (r.value, r.contribution) and got[k].contrast == pytest.approx(r.contrast, abs=1e-12)
    some = xp.as_long(xp.wide_contrasts(dealt, model, xp.THEMES), model, xp.THEMES)
    assert {key(r) for r in some.collect()} == {k for k in want if k[2] in xp.THEMES}


def test_faithfulness_equals_plain_count(spark, x, model):
    dealt = materialize_by(x, "customer_idx")
    out = xp.faithfulness(xp.wide_contrasts(dealt, model), model)
    assert plan(out).count("Exchange") <= 2 * 1  # the final count alone, in either plan
    long = xp.with_contrast(xp.contributions(x, model))
    rows = {}
    for r in long.withColumn("u", hash_uniform(SEED, F.col("customer_idx"), F.col("article_idx"), F.col("feature"))).collect():
        rows.setdefault((r.customer_idx, r.article_idx), []).append(r)
    tops, others = [], []
    for rs in rows.values():
        top = min(rs, key=lambda r: (0 if r.feature in xp.THEMES and r.contrast > 0 else 1, -r.contrast, r.feature))
        by_hash = sorted(rs, key=lambda r: r.u)
        other = by_hash[0] if by_hash[0].feature != top.feature else by_hash[1]
        tops.append(top.contribution)
        others.append(other.contribution)
    got = out.first()
    d = [round(t - o, 12) for t, o in zip(tops, others)]
    assert got.n_rows == len(rows)
    assert got.top_mean_drop == pytest.approx(statistics.fmean(tops)) and got.random_mean_drop == pytest.approx(statistics.fmean(others))
    assert (got.n_larger, got.n_smaller) == (sum(v > 0 for v in d), sum(v < 0 for v in d))


def test_feature_map_cuts_lists_where_they_lie(spark, x):
    truth = x.filter("label = 1").select("customer_idx", "article_idx")
    direction = si.directions(spark.createDataFrame([(n, 0.4 if i % 2 else 0.6) for i, n in enumerate(NAMES)], "feature string, auc double"))
    want = {r.feature: r.map for r in si.feature_map(x.repartition("customer_idx"), truth, list(NAMES), direction).collect()}
    dealt = si.feature_map(materialize_by(x, "customer_idx"), materialize(truth), list(NAMES), direction)
    assert {r.feature: r.map for r in dealt.collect()} == pytest.approx(want)
    assert "REPARTITION" not in plan(dealt)


def exchanged(df) -> list[str]:
    """The columns that each exchange of the plan moves."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return re.findall(r"\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_saved_tables_leave_no_shuffle_files(spark, x):
    """Whatever session is given: F1, shuffles of all steps lay on disk side by side."""
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        files = blocks.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    for saved in (materialize(x.groupBy("c_age").count()), materialize_by(x.repartition(3), "customer_idx")):
        for _ in range(100):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        assert not shuffles() - before and saved.columns


def test_pairs_meet_where_their_customers_lie(spark, x):
    """Also in a session that asks for all keys of a join."""
    dealt, own = materialize_by(x, "customer_idx"), materialize_by(x.select("customer_idx", "article_idx", F.lit(1).alias("n")), "customer_idx")
    with conf_set(spark, **{CO_PARTITION: "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        with lean(spark):
            assert not exchanged(dealt.join(own, ["customer_idx", "article_idx"], "left"))
        assert spark.conf.get(CO_PARTITION) == "true"


def test_left_join_keeps_rows_where_they_lie(spark, x):
    rows = x.select("customer_idx", F.when(F.col("article_idx") != 5, F.col("article_idx")).alias("article_idx"), F.col("c_age").alias("wide"))
    right = spark.createDataFrame([(a, a * 10, None if a == 3 else f"n{a}") for a in range(2, 20)], "article_idx bigint, v int, name string")
    hot = spark.createDataFrame([(2,), (2,), (3,), (99,)], "article_idx bigint")
    with conf_set(spark, **{CO_PARTITION: "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = left_join_dealt(materialize_by(rows, "customer_idx"), right, "article_idx", hot, "customer_idx")
        assert exchanged(out) and not any("wide" in columns for columns in exchanged(out))
        want = rows.join(right, "article_idx", "left").select(*rows.columns, "v", "name")
        key = lambda r: tuple((v is None, v) for v in r)
        assert sorted(map(key, out.collect())) == sorted(map(key, want.collect()))


def test_folds_share_the_partials_by_week(spark, make_tx):
    """an earlier fold exchanges no sales for its partials, and has the same ones and the same features."""
    people = spark.createDataFrame(
        [(c, f"n{c}", 20.0 + c if c % 3 else None, 1.0, 0.0, "ACTIVE", "Regularly") for c in range(8)],
        "customer_idx bigint, customer_id string, age float, FN float, Active float, club_member_status string, fashion_news_frequency string",
    )
    things = spark.createDataFrame(
        [(a, f"p{a % 4}", a % 3, a % 2, *[f"{n}{a % 3}" for n in "abcde"]) for a in range(12)],
        "article_idx bigint, product_code string, product_type_no int, department_no int, product_group_name string, index_group_name string, "
        "garment_group_name string, colour_group_name string, section_name string",
    )
    tx = materialize_by(make_tx([(c, (c * w + i) % 12, w, 0.1 * i + 0.05, 1 + i % 2) for c in range(8) for w in range(4, 10) if (c + w) % 3 for i in range(3)]), "customer_idx")
    settings = cr.RunSettings(min_pair_count=1)

    def rounded(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)

    last = pt.of_history(before_week(tx, 9), 9, people).saved()
    earlier, fresh = last.before(7, tx), pt.of_history(tx, 7, people)
    assert earlier.week == 7
    for name in ("by_customer", "by_article", "pairs"):
        ours = getattr(earlier, name)
        assert "Exchange" not in plan(ours) and rounded(ours) == rounded(getattr(fresh, name).select(ours.columns)), name
    history = before_week(tx, 7)
    built = [cr.build_state(history, 7, CAL, things, people, settings, later=later) for later in (None, last)]
    features = [rounded(build_fold_features(tx, 7, CAL, things, people, settings, allow_holdout=True, state=s)) for s in built]
    assert features[0] == features[1] and features[0]
    with pytest.raises(ValueError):
        last.before(10, tx)


def test_top_lists_meet_their_rows_where_they_lie(spark, x):
    """also in a session that asks for all keys of a join."""
    names = (*xp.THEMES, "c_age")
    full = x.select("customer_idx", "article_idx", F.lit("s").alias("final_source"), *[(F.col("i_age_gap") + F.col("article_idx") * i % 5).alias(n) for i, n in enumerate(xp.THEMES)], "c_age")
    means, stds = column_stats(full, names)
    model = LinearRanker(names, means, stds, tuple(0.5 - 0.1 * i for i in range(len(names))))
    with conf_set(spark, **{CO_PARTITION: "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = rc.explained_top(materialize_by(full, "customer_idx"), model)
        assert "Exchange" not in plan(out)
        rows = {(r.customer_idx, r.article_idx): (r.pos, r.final_source, r.reasons) for r in out.collect()}
    top = xp.mark_top(model.score(full))
    texts = xp.reason_lists(xp.reasons(xp.contrasts_of(full, model, top, xp.THEMES)))
    want = top.join(texts, xp.ROW, "left").collect()
    assert rows == {(r.customer_idx, r.article_idx): (r.pos, "s", r.reasons) for r in want} and any(r.reasons for r in want)


def test_replayed_histories_read_the_dealt_sales(spark, make_tx):
    """lines and orders are not joined again."""
    from checks.models import replayed

    sales = materialize_by(make_tx([(c, a, w, 1.0, 1) for c in range(6) for a in (1, 2) for w in (3, 4)]), "customer_idx")
    buyers = sales.filter("week_idx = 4 and customer_idx < 2").select("customer_idx").distinct()
    got = replayed(SimpleNamespace(sales=sales, eval_customers=buyers))
    assert "Exchange hashpartitioning" not in plan(got)
    assert sorted((r.customer_idx, r.article_idx, r.week_idx) for r in got.collect()) == sorted((-c - 1, a, w) for c in (0, 1) for a in (1, 2) for w in (3, 4))
