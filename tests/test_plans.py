"""Combinations, evaluation, studies, analytics and constraints on small hand-made tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from factorlake.functions import indicators
from factorlake.plans import catalog, combo, evaluate, history, performance, risk, winrate

DAY = dt.date(2020, 1, 1)


def panel(spark, growth, days=30):
    rows = [(i, DAY + dt.timedelta(days=k), 100.0 * (1 + g) ** k) for i, g in growth.items() for k in range(days)]
    return spark.createDataFrame(rows, "instrument_id string, date date, close double")


GROWTH = {f"i{k}": 0.001 * (k + 1) for k in range(5)}


def test_spec_validation():
    term = combo.Term("momentum")
    with pytest.raises(ValueError):
        combo.Spec((term,), top_k=1, top_pct=0.1)
    with pytest.raises(ValueError):
        combo.Spec((), top_k=1)
    with pytest.raises(ValueError):
        combo.Term("nonsense")
    with pytest.raises(ValueError):
        combo.Filter("momentum", "==", 1.0)
    assert combo.parse({"factors": [{"name": "momentum"}], "market": "US", "top_k": None, "extra": 1}, evaluation=True).top_k == 1


def test_monotone_panel_has_ic_one(spark):
    bars = panel(spark, GROWTH)
    s = combo.scores(bars, combo.Spec((combo.Term("momentum", params={"period": 5}),), top_k=1))
    ic = evaluate.rank_ic(s, bars, 3)
    assert ic.count() == 30 - 5 - 3 and ic.agg(F.min("ic")).first()[0] == pytest.approx(1.0)
    q = {r.bin: r.m for r in evaluate.quantile_returns(s, bars, 3, 5).groupBy("bin").agg(F.avg("mean_ret").alias("m")).collect()}
    assert [q[k] for k in range(5)] == sorted(q.values())


def test_flat_section_is_dropped(spark):
    assert combo.scores(panel(spark, dict.fromkeys(("a", "b", "c"), 0.0)), combo.Spec((combo.Term("momentum"),), top_k=1)).count() == 0


def test_ic_is_null_for_no_dates(spark):
    assert evaluate.ic_summary(spark.createDataFrame([], "date date, ic double")).first()["mean"] is None


def test_turnover_and_weights(spark):
    h = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1), ("c", 1)], "instrument_id string, ordinal int")
    assert {(r.ordinal, r.instrument_id, r.action) for r in combo.turnover(h).where("ordinal = 1").collect()} == {(1, "c", "BUY"), (1, "a", "SELL")}


def test_windows_put_the_rest_last(spark):
    w = evaluate.windows(panel(spark, {"a": 0.0}, days=11), 4)
    assert [r.n for r in w.groupBy("window_id").agg(F.count("*").alias("n")).orderBy("window_id").collect()] == [2, 2, 2, 5]


def test_period_returns_equal_a_loop_over_the_holdings(spark):
    rng = random.Random(9)
    close = {(i, k): 50 + rng.random() * 50 for i in "abcdef" for k in range(40) if (i, k) not in {("a", 10), ("b", 20)}}
    baskets = [sorted(rng.sample("abcdef", rng.choice([1, 2, 3]))) for _ in range(4)]
    weights = [{i: 1 / len(x) for i in x} for x in baskets]
    bars = spark.createDataFrame([(i, DAY + dt.timedelta(days=k), c) for (i, k), c in close.items()], "instrument_id string, date date, close double")
    held = spark.createDataFrame([(n, DAY + dt.timedelta(days=10 * n), i, w) for n, x in enumerate(weights) for i, w in x.items()], "ordinal int, date date, instrument_id string, weight double")
    at = lambda i, k: close[i, max(x for (j, x) in close if j == i and x <= k)]
    want = []
    for n in range(3):
        gross = sum(w * (at(i, 10 * n + 10) / at(i, 10 * n) - 1) for i, w in weights[n].items())
        before = weights[n - 1] if n else {}
        moved = sum(abs(weights[n].get(i, 0) - before.get(i, 0)) for i in "abcdef") / 2
        want.append((n, pytest.approx(gross), pytest.approx(moved), pytest.approx(gross - moved * 0.01)))
    got = evaluate.period_returns(held, bars, 0.01).orderBy("ordinal")
    assert [(r.ordinal, r.gross_ret, r.turnover, r.net_ret) for r in got.collect()] == want
    assert evaluate.period_returns(held.limit(0), bars).count() == 0


def test_grid(spark):
    assert evaluate.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6
    assert evaluate.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}, limit=2).count() == 2


def test_pairing_equals_the_open_close_rule(spark):
    random.seed(3)
    events = [random.choice([None, None, "golden", "death"]) for _ in range(300)]
    closes = [100 + random.random() for _ in events]
    rows = [("a", DAY + dt.timedelta(days=k), c, 1.0, 0.0, e) for k, (c, e) in enumerate(zip(closes, events, strict=True))]
    got = winrate.pair_trades(spark.createDataFrame(rows, "instrument_id string, date date, close double, ema_s double, ema_l double, signal string")).orderBy("entry_date").collect()
    want, opened = [], None
    for k, e in enumerate(events):
        if e == "golden" and opened is None:
            opened = k
        elif e == "death" and opened is not None:
            want.append((opened, k, max(closes[opened : opened + 21]) / closes[opened] - 1))
            opened = None
    assert [((r.entry_date - DAY).days, (r.exit_date - DAY).days) for r in got] == [w[:2] for w in want]
    assert [r.mfe for r in got] == pytest.approx([w[2] for w in want])


def test_history_merge(spark):
    cols = "instrument_id string, n bigint, last_signal date, mean_ret_5 double"
    a = spark.createDataFrame([("a", 2, DAY, 0.1), ("b", 1, DAY, 0.2)], cols)
    b = spark.createDataFrame([("a", 2, DAY + dt.timedelta(days=1), None), ("c", 1, DAY, 0.3)], cols)
    got = {r.instrument_id: (r.n, r.mean_ret_5) for r in history.merge(a, b).collect()}
    assert got == {"a": (4, pytest.approx(0.05)), "b": (1, 0.2), "c": (1, 0.3)}


def test_drawdowns_and_halts(spark):
    values = [100.0, 90.0, 85.0, 96.0, 101.0, 99.0]
    nav = spark.createDataFrame([(1, DAY + dt.timedelta(days=k), v) for k, v in enumerate(values)], "book int, date date, nav double")
    dd = performance.drawdowns(nav, ["book"], 100.0)
    assert [round(r.drawdown, 4) for r in dd.orderBy("date").collect()] == [0.0, 0.1, 0.15, 0.04, 0.0, round(2 / 101, 4)]
    assert [r.halted for r in risk.halts(dd, ["book"]).orderBy("date").collect()] == [False, False, True, False, False, False]
    u = performance.underwater(nav, ["book"], 100.0).orderBy("start").collect()
    assert [((r.start - DAY).days, (r.end - DAY).days) for r in u] == [(1, 4), (5, 5)]


def test_costs(spark):
    t = spark.createDataFrame([("BUY", 10.0, 100), ("SELL", 10.0, 10_000), ("BUY", 0.0, 5)], "side string, price double, shares bigint")
    assert [r.cost for r in performance.costs(t, "CN").collect()] == pytest.approx([5.01, 30 + 100 + 1, 0.0])


def test_fill_rules(spark):
    bars = spark.createDataFrame([("a", DAY, 10.0, 12.0, 9.0, 11.0), ("a", DAY + dt.timedelta(days=1), 11.0, 13.0, 10.5, 12.0)], "instrument_id string, date date, open double, high double, low double, close double")
    orders = spark.createDataFrame([("a", DAY, "BUY", 10.0), ("b", DAY, "BUY", 1.0)], "instrument_id string, date date, side string, limit_price double")
    status = lambda **k: {r.instrument_id: r.status for r in performance.fills(orders, bars, **k).collect()}
    assert status(rule="limit", lag_days=0) == {"a": "filled", "b": "rejected"}
    assert status(rule="limit", lag_days=1) == {"a": "unfilled", "b": "rejected"}


def test_first_rule_wins(spark):
    s = spark.createDataFrame([("BUY", 10.0, 10, 50.0, 1000.0, 10.0, 1)], "direction string, price double, shares int, held_value double, equity double, cash double, n_positions int")
    assert risk.gate(s, [("duplicate", {}), ("min_capital", {})]).first().reject_rule == "duplicate"
    assert risk.gate(s, [("max_positions", {}), ("min_capital", {})]).first().reject_rule == "min_capital"


def test_every_query_has_sql():
    assert not set(catalog.oracle_sql()) - set(catalog.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert len(list(itertools.chain(catalog.queries()))) > 150


def noisy(spark, n=12, days=40):
    rng = random.Random(3)
    rows = [(f"i{k}", DAY + dt.timedelta(days=d), 100.0 * (1 + rng.random())) for k in range(n) for d in range(days)]
    return spark.createDataFrame(rows, "instrument_id string, date date, close double")


def test_candidates_share_one_scoring(spark):
    bars = noisy(spark)
    got = {(r.candidate, r.date): r.ic for r in evaluate.candidate_ics(bars, "momentum", "period", [3, 5], [1, 4]).collect()}
    want = {}
    for p, h in itertools.product([3, 5], [1, 4]):
        scored = combo.scores(bars, combo.Spec((combo.Term("momentum", params={"period": p}),), top_k=1))
        want |= {(f"{p}|{h}", r.date): r.ic for r in evaluate.rank_ic(scored, bars, h).collect()}
    assert got == pytest.approx(want) and want


def test_latest_scores_are_those_of_the_last_date_with_any(spark):
    bars = noisy(spark).unionByName(panel(spark, {"alone": 0.01}, days=45))  # the last days have one instrument, which has no z-score
    spec = combo.Spec((combo.Term("momentum", params={"period": 3}),), top_k=4)
    every = combo.scores(bars, spec)
    last = every.agg(F.max("date")).first()[0]
    key = lambda df: {r.instrument_id: r.combo_score for r in df.collect()}
    assert last == DAY + dt.timedelta(days=39) and key(combo.latest_scores(bars, spec)) == pytest.approx(key(every.where(F.col("date") == last)))
    assert combo.screen(bars, spec).count() == 4 and combo.screen(bars, spec, at="2020-01-20").count() == 4
    assert combo.latest_scores(bars.limit(0), spec).count() == 0


def test_what_is_lost_stays_lost(spark):
    closes = {"a": [1.0] * 6, "b": [1.0, 2.0, 4.0, 0.0, 8.0, 9.0]}
    rows = [(i, DAY + dt.timedelta(days=k), c) for i, x in closes.items() for k, c in enumerate(x)]
    bars = spark.createDataFrame(rows, "instrument_id string, date date, close double")
    spec = combo.Spec((combo.Term("momentum", params={"period": 1}),), top_k=1, rebalance=1)
    (r,) = evaluate.evaluate_specs(bars, {"s": spec}, n_windows=1, cost_rate=0.0).collect()
    assert r.total_return == -1.0 and r.max_drawdown == 1.0


def test_fit_of_nearly_flat_prices_stays_in_range(spark):
    rng = random.Random(1)
    rows = [("a", DAY + dt.timedelta(days=k), (100.0 if k > 50 else 1.0) + rng.random() * 1e-9) for k in range(4000)]
    out = indicators.clenow_r2(spark.createDataFrame(rows, "instrument_id string, date date, close double"), 90).where("CLENOW_R2 IS NOT NULL")
    assert out.where("CLENOW_R2 < 0 OR CLENOW_R2 > 1 OR isnan(CLENOW_R2)").count() == 0


def test_draws_number_trades_over_instruments(spark):
    trades = spark.createDataFrame([(f"i{k % 7}", DAY + dt.timedelta(days=k), float(k)) for k in range(50)], "instrument_id string, entry_date date, ret double")
    drawn = winrate.bootstrap(trades, spark, 2000).select("ret").distinct().count()
    assert drawn == 50 and winrate.bootstrap(trades, spark, 2000).count() == 2000
