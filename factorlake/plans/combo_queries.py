"""Queries of combinations and their evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import factors
from factorlake.operators import universe as u
from factorlake.operators.asof import enrich
from factorlake.plans import bindings as b
from factorlake.plans import combo, evaluate
from factorlake.plans.factor_queries import lagged, rank, roll

REGIONS = {"north": ["EUROPE", "AMERICA"], "south": ["AFRICA", "ASIA", "MIDDLE EAST"]}
MOMENTUM = combo.Spec((combo.Term("momentum", params={"period": 20}), combo.Term("volatility", "low", 0.5)), top_k=3, rebalance=20, winsorize_pct=0.05)
GROUPED = combo.Spec((combo.Term("momentum", params={"period": 20}),), top_pct=0.2, rebalance=5, winsorize_pct=0.05, group_by=REGIONS, overrides={"S000001": "own"})
FILTERED = combo.Spec((combo.Term("momentum"),), top_k=5, filters=(combo.Filter("volume_ratio", ">", 0.5), combo.Filter("price_range", "<=", 0.9)))
PERIODS_, HORIZONS_ = [10, 20, 50], [5, 10, 20]
RANKING = combo.Spec((combo.Term("momentum", params={"period": 20}), combo.Term("fund_roe"), combo.Term("fund_pe_ttm", "low")), top_k=10, winsorize_pct=0.05)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(b.bars(spark, sf_dir), b.fundamentals(spark, sf_dir), b.valuation(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, spec: combo.Spec = MOMENTUM) -> DataFrame:
    return combo.scores(b.bars(spark, sf_dir), spec, b.sectors(spark, sf_dir))


def _clip(x: str, pct: float, source: str, out: str) -> dict[str, str]:
    """CTEs that add {out}_w: x clipped to nearest-rank quantiles per (date, _group)."""
    p = "PARTITION BY date, _group"
    return {
        f"{out}_a": f"SELECT *, row_number() OVER ({p} ORDER BY {x} ASC NULLS LAST)-1 AS at_, count({x}) OVER ({p}) AS n_ FROM {source}",
        f"{out}_b": f"SELECT *, max(CASE WHEN at_=floor({pct}*(n_-1)+0.5) THEN {x} END) OVER ({p}) AS lo_, "
            f"max(CASE WHEN at_=floor({1 - pct}*(n_-1)+0.5) THEN {x} END) OVER ({p}) AS hi_ FROM {out}_a",
        out: f"SELECT * EXCLUDE (at_, n_, lo_, hi_), CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, hi_), lo_) END AS {x}_w FROM {out}_b",
    }


def _z(x: str, sign: str = "") -> str:
    p = "PARTITION BY date, _group"
    return f"{sign}({x}_w - avg({x}_w) OVER ({p}))/nullif(stddev_samp({x}_w) OVER ({p}),0)"


_M20, _VOL = f"(close/nullif({lagged('close', 20)},0)-1)*100", f"({roll('stddev_samp', 'ret', 20)})*sqrt(252)"
SCORED = {
    "s0": f"SELECT instrument_id, date, close, '_all' AS _group, {_M20} AS f0, {_VOL} AS f1 FROM r",
    **_clip("f0", 0.05, "s0", "s1"), **_clip("f1", 0.05, "s1", "s2"),
    "s3": f"SELECT *, {_z('f0')} AS z0, {_z('f1', '-')} AS z1 FROM s2",
    "scored": "SELECT instrument_id, date, _group, z0 + z1*0.5 AS combo_score FROM s3 "
        "WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND z0 IS NOT NULL AND z1 IS NOT NULL",
}
FWD = {"fwd": "SELECT instrument_id, date, lead(close,{h}) OVER (PARTITION BY instrument_id ORDER BY date)/nullif(close,0)-1 AS fwd_ret FROM bars"}


def _fwd(h: int) -> dict[str, str]:
    return {"fwd": FWD["fwd"].format(h=h), "sr": "SELECT s.*, f.fwd_ret FROM scored s JOIN fwd f ON s.instrument_id=f.instrument_id AND s.date=f.date "
        "WHERE combo_score IS NOT NULL AND fwd_ret IS NOT NULL"}


GROUPS = {
    "g0": f"SELECT instrument_id, date, sector, {_M20} AS f0 FROM sectored",
    "g1": """SELECT *, CASE WHEN instrument_id='S000001' THEN 'own' WHEN sector IN ('EUROPE','AMERICA') THEN 'north' WHEN sector IN ('AFRICA','ASIA','MIDDLE EAST') THEN 'south' END AS _group FROM g0""",
    "g2": "SELECT * FROM g1 WHERE _group IS NOT NULL",
    **_clip("f0", 0.05, "g2", "g3"),
    "g4": f"SELECT *, {_z('f0')} AS z0 FROM g3",
    "scored": "SELECT instrument_id, date, _group, z0 AS combo_score FROM g4 WHERE f0 IS NOT NULL AND z0 IS NOT NULL",
}
RANKED = {
    "k0": f"SELECT p.instrument_id, p.date, '_all' AS _group, (p.close/nullif(lag(p.close,20) OVER (PARTITION BY p.instrument_id "
        f"ORDER BY p.date),0)-1)*100 AS f0, roe AS f1, CASE WHEN pe_ttm>0 THEN pe_ttm END AS f2 FROM panel p",
    **_clip("f0", 0.05, "k0", "k1"), **_clip("f1", 0.05, "k1", "k2"), **_clip("f2", 0.05, "k2", "k3"),
    "k4": f"SELECT *, {_z('f0')} AS z0, {_z('f1')} AS z1, {_z('f2', '-')} AS z2 FROM k3",
    "scored": "SELECT instrument_id, date, _group, z0+z1+z2 AS combo_score FROM k4 "
        "WHERE f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL AND z0 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL",
}
CHOSEN = {
    "live": "SELECT s.* FROM scored s JOIN tradable t ON s.instrument_id=t.instrument_id AND s.date=t.date",
    "chosen": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, _group ORDER BY combo_score DESC, instrument_id) AS rank FROM live) WHERE rank <= 3",
    "dates": "SELECT date, CAST(n/20 AS INTEGER) AS ordinal FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS n "
        "FROM (SELECT DISTINCT date FROM bars)) WHERE n % 20 = 0",
    "held": "SELECT c.instrument_id, c.date, d.ordinal, 1.0::DOUBLE/count(*) OVER (PARTITION BY c.date) AS weight FROM chosen c JOIN dates d ON c.date=d.date",
}
PERIODS = {
    "spans_": "SELECT h.*, n.date AS until FROM held h JOIN (SELECT DISTINCT ordinal-1 AS ordinal, date FROM held) n ON h.ordinal=n.ordinal",
    "e1": "SELECT s.*, b.close AS entry FROM spans_ s ASOF LEFT JOIN bars b ON s.instrument_id=b.instrument_id AND s.date>=b.date",
    "e2": "SELECT s.*, b.close AS leave FROM e1 s ASOF LEFT JOIN bars b ON s.instrument_id=b.instrument_id AND s.until>=b.date",
    "gross": "SELECT ordinal, date, sum(weight*(leave/nullif(entry,0)-1)) AS gross_ret FROM e2 GROUP BY ordinal, date",
    "moved": "SELECT coalesce(a.ordinal, p.ordinal) AS ordinal, sum(abs(coalesce(a.weight,0)-coalesce(p.weight,0)))/2 AS turnover "
        "FROM held a FULL JOIN (SELECT ordinal+1 AS ordinal, instrument_id, weight "
        "FROM held) p ON a.ordinal=p.ordinal AND a.instrument_id=p.instrument_id GROUP BY 1",
    "periods": "SELECT g.ordinal, g.date, gross_ret, turnover, gross_ret-turnover*0.001 AS net_ret FROM gross g JOIN moved m ON g.ordinal=m.ordinal",
}


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = b.bars(spark, sf_dir)
    chosen = combo.selected(combo.scores(bars, MOMENTUM), MOMENTUM, u.universe(bars, b.components(spark, sf_dir)))
    return combo.targets(chosen, combo.rebalance_dates(bars, MOMENTUM.rebalance))


def flagship(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """Momentum, return on equity and low price-earnings at the latest scored date: the top of the ranking."""
    latest = combo.latest_scores(panel(spark, sf_dir), RANKING)
    return combo.selected(latest, combo.Spec(RANKING.factors, top_k=top)).select("instrument_id", "date", F.round("combo_score", 6).alias("combo_score"), "rank")


def queries_and_sql() -> tuple[dict, dict]:
    q, o = {}, {}
    r6 = lambda c: F.round(c, 6).alias(c)
    score_cols = lambda df: df.select("instrument_id", "date", "_group", r6("combo_score"))
    score_sql = "SELECT instrument_id, date, _group, round(combo_score,6) AS combo_score FROM "

    q["g2_filters"] = lambda s, d: combo.filtered(b.bars(s, d), FILTERED.filters).select("instrument_id", "date", "close")
    o["g2_filters"] = b.sql(
        "SELECT instrument_id, date, close FROM f2 WHERE (high-low)/nullif(close,0) <= 0.9",
        f1=f"SELECT *, volume/nullif({roll('avg', 'volume', 20)},0) AS vr FROM bars", f2="SELECT * FROM f1 WHERE vr > 0.5",
    )

    def winsor(spark: SparkSession, sf_dir: str) -> DataFrame:
        from factorlake.functions.series import clipped

        df = factors.momentum(b.bars(spark, sf_dir), 20).withColumn("_group", F.lit("_all"))
        return clipped(df, "momentum", 0.05, ["date", "_group"], "clipped").select("instrument_id", "date", r6("clipped"))

    q["g3_winsorise"] = winsor
    o["g3_winsorise"] = b.sql("SELECT instrument_id, date, round(f0_w,6) AS clipped FROM s1", **SCORED)

    def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
        from factorlake.functions.series import clipped, standardised

        df = factors.momentum(b.bars(spark, sf_dir), 20).withColumn("_group", F.lit("_all"))
        df = clipped(df, "momentum", 0.05, ["date", "_group"], "w")
        return df.select("instrument_id", "date", F.round(standardised("w", ["date", "_group"]), 6).alias("z"))

    q["g4_zscore"] = zscore
    o["g4_zscore"] = b.sql("SELECT instrument_id, date, round(z0,6) AS z FROM s3", **SCORED)
    q["g5_combo_score"] = lambda s, d: score_cols(scored(s, d))
    o["g5_combo_score"] = b.sql(score_sql + "scored", **SCORED)
    q["g6_grouped_score"] = lambda s, d: score_cols(scored(s, d, GROUPED))
    o["g6_grouped_score"] = b.sql(score_sql + "scored", **GROUPS)
    q["g7_top_k"] = lambda s, d: combo.selected(scored(s, d), MOMENTUM, u.universe(b.bars(s, d), b.components(s, d))).select("instrument_id", "date", "rank", r6("combo_score"))
    o["g7_top_k"] = b.sql("SELECT instrument_id, date, CAST(rank AS INTEGER) AS rank, round(combo_score,6) AS combo_score FROM chosen", **SCORED, **CHOSEN)
    q["g7_top_pct_grouped"] = lambda s, d: combo.selected(scored(s, d, GROUPED), GROUPED).select("instrument_id", "date", "_group", "rank")
    o["g7_top_pct_grouped"] = b.sql(
        "SELECT instrument_id, date, _group, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= greatest(1, round_even(n*0.2, 0))", **GROUPS,
        t="SELECT *, row_number() OVER (PARTITION BY date, _group ORDER BY combo_score DESC, instrument_id) AS rank, "
            "count(*) OVER (PARTITION BY date, _group) AS n FROM scored",
    )
    q["g8_rebalance_dates"] = lambda s, d: combo.rebalance_dates(b.bars(s, d), 20)
    o["g8_rebalance_dates"] = b.sql("SELECT date, ordinal FROM dates", dates=CHOSEN["dates"])
    q["g9_targets"] = lambda s, d: held(s, d).select("instrument_id", "date", "ordinal", r6("weight"))
    o["g9_targets"] = b.sql("SELECT instrument_id, date, ordinal, round(weight,6) AS weight FROM held", **SCORED, **CHOSEN)
    q["g9_turnover"] = lambda s, d: combo.turnover(held(s, d)).select("ordinal", "instrument_id", "action")
    o["g9_turnover"] = b.sql(
        """SELECT ordinal, instrument_id, 'BUY' AS action FROM held h WHERE NOT EXISTS (SELECT 1 FROM held p WHERE p.instrument_id=h.instrument_id AND p.ordinal=h.ordinal-1)
        UNION ALL SELECT ordinal+1, instrument_id, 'SELL' FROM held h WHERE h.ordinal+1 IN (SELECT ordinal FROM held) AND NOT EXISTS (SELECT 1 FROM held p WHERE p.instrument_id=h.instrument_id AND p.ordinal=h.ordinal+1)""",
        **SCORED, **CHOSEN,
    )
    q["g10_ranking"] = flagship
    o["g10_ranking"] = b.sql("SELECT instrument_id, date, round(combo_score,6) AS combo_score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 20", **RANKED, t="SELECT *, row_number() OVER (ORDER BY combo_score DESC, instrument_id) AS rank FROM scored WHERE date = (SELECT max(date) FROM scored)")

    q["e1_forward_returns"] = lambda s, d: evaluate.forward_returns(b.bars(s, d), 20).select("instrument_id", "date", r6("fwd_ret"))
    o["e1_forward_returns"] = b.sql("SELECT instrument_id, date, round(fwd_ret,6) AS fwd_ret FROM fwd", fwd=_fwd(20)["fwd"])
    ic = {
        **SCORED, **_fwd(20),
        "rk": f"SELECT date, {rank('combo_score', 'date')} AS a, {rank('fwd_ret', 'date')} AS b FROM sr",
        "ic": "SELECT * FROM (SELECT date, round(covar_pop(a,b)/nullif(sqrt(var_pop(a)*var_pop(b)),0),12) AS ic FROM rk GROUP BY date) WHERE ic IS NOT NULL",
    }
    q["e2_rank_ic"] = lambda s, d: evaluate.rank_ic(scored(s, d), b.bars(s, d), 20).select("date", r6("ic"))
    o["e2_rank_ic"] = b.sql("SELECT date, round(ic,6) AS ic FROM ic", **ic)
    q["e3_ic_summary"] = lambda s, d: evaluate.ic_summary(evaluate.rank_ic(scored(s, d), b.bars(s, d), 20)).select(r6("mean"), r6("std"), r6("ir"), r6("win_rate"), "n_dates")
    o["e3_ic_summary"] = b.sql("SELECT round(avg(ic),6) AS mean, round(stddev_samp(ic),6) AS std, round(avg(ic)/nullif(stddev_samp(ic),0),6) AS ir, "
        "round(avg(CASE WHEN ic>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS win_rate, count(*) AS n_dates FROM ic", **ic)
    cuts = ", ".join(str(k / 5) for k in range(1, 5))
    quant = {
        **SCORED, **_fwd(20),
        "cut": f"SELECT date, quantile_cont(combo_score, [{cuts}]) AS cuts FROM sr GROUP BY date",
        "quant": "SELECT b.date, CAST(len(list_filter(cuts, lambda x: b.combo_score > x)) AS INTEGER) AS bin, avg(fwd_ret) AS mean_ret, "
            "count(*) AS n FROM sr b JOIN cut c ON b.date=c.date GROUP BY 1, 2",
    }
    q["e4_quantile_returns"] = lambda s, d: evaluate.quantile_returns(scored(s, d), b.bars(s, d), 20, 5).select("date", "bin", r6("mean_ret"), "n")
    o["e4_quantile_returns"] = b.sql("SELECT date, bin, round(mean_ret,6) AS mean_ret, n FROM quant", **quant)
    q["e5_top_minus_bottom"] = lambda s, d: evaluate.top_minus_bottom(evaluate.quantile_returns(scored(s, d), b.bars(s, d), 20, 5)).select("date", r6("spread"))
    o["e5_top_minus_bottom"] = b.sql("SELECT a.date, round(a.mean_ret-z.mean_ret,6) AS spread FROM quant a JOIN quant z ON a.date=z.date WHERE a.bin=4 AND z.bin=0", **quant)
    q["e6_coverage"] = lambda s, d: evaluate.coverage(b.bars(s, d), scored(s, d)).select("panel_rows", "scored_rows", r6("row_ratio"), "n_dates", "valid_dates", r6("date_ratio"))
    o["e6_coverage"] = b.sql(
        "SELECT p.n AS panel_rows, CAST(s.n AS BIGINT) AS scored_rows, round(s.n/CAST(p.n AS DOUBLE),6) AS row_ratio, p.d AS n_dates, "
            "s.v AS valid_dates, round(s.v/CAST(p.d AS DOUBLE),6) AS date_ratio FROM p, s", **SCORED,
        p="SELECT count(*) AS n, count(DISTINCT date) AS d FROM bars", s="SELECT sum(n) AS n, count(*) FILTER (n>=5 AND sd>0) AS v FROM (SELECT date, count(*) AS n, stddev_samp(combo_score) AS sd "
            "FROM scored GROUP BY date)",
    )
    q["e7_windows"] = lambda s, d: evaluate.windows(b.bars(s, d), 4)
    win = {"days": "SELECT date, row_number() OVER (ORDER BY date)-1 AS n, count(*) OVER () AS t FROM (SELECT DISTINCT date FROM bars)", "win": "SELECT date, CAST(least(n // greatest(1, t // least(4,t)), least(4,t)-1) AS INTEGER) AS window_id FROM days"}
    o["e7_windows"] = b.sql("SELECT date, window_id FROM win", **win)

    def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Mean RankIC of six drawn candidates of a grid of momentum periods and horizons."""
        drawn = evaluate.grid(spark, {"period": PERIODS_, "horizon": HORIZONS_}, limit=6).select("candidate_id")
        ics = evaluate.candidate_ics(b.bars(spark, sf_dir), "momentum", "period", PERIODS_, HORIZONS_, wanted=drawn.withColumnRenamed("candidate_id", "candidate"))
        means = ics.groupBy(F.col("candidate").alias("candidate_id")).agg(F.round(F.avg("ic"), 6).alias("mean"), F.count("*").alias("n_dates"))
        return drawn.join(means, "candidate_id")

    q["e8_grid"] = candidates

    def specs() -> dict[str, combo.Spec]:
        return {f"m{p}_k{k}_r{r}": combo.Spec((combo.Term("momentum", params={"period": p}),), top_k=k, rebalance=r) for p in (10, 20) for k in (5,) for r in (10, 20)}

    def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate.evaluate_specs(b.bars(spark, sf_dir), specs(), n_windows=2)

    rounded = lambda df, *keys: df.select(*keys, *(r6(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))
    q["e9_batch"] = lambda s, d: rounded(batch(s, d), "spec", "window_id")
    q["e10_walk_forward"] = lambda s, d: rounded(evaluate.walk_forward(batch(s, d)), "spec")
    q["e11_accepted"] = lambda s, d: rounded(evaluate.accepted(evaluate.walk_forward(batch(s, d)), min_sharpe=-10.0, max_drawdown=2.0, worst=-2.0), "spec")
    q["e12_period_returns"] = lambda s, d: evaluate.period_returns(held(s, d), b.bars(s, d), 0.001).select("ordinal", "date", r6("gross_ret"), r6("turnover"), r6("net_ret"))
    o["e12_period_returns"] = b.sql("SELECT ordinal, date, round(gross_ret,6) AS gross_ret, round(turnover,6) AS turnover, round(net_ret,6) AS net_ret FROM periods", **SCORED, **CHOSEN, **PERIODS)

    # the batch as SQL: the same CTEs per spec and window
    def batch_ctes() -> tuple[dict[str, str], str]:
        own: dict[str, str] = {k: v.replace("least(4,t)", "least(2,t)") for k, v in win.items()}
        rows = []
        for p in (10, 20):
            own[f"b{p}"] = (
                f"SELECT b.instrument_id, b.date, w.window_id, b.close, 'x' AS _g, (close/nullif(lag(close,{p}) OVER (PARTITION BY b.instrument_id, "
                f"window_id ORDER BY b.date),0)-1)*100 AS f0 FROM bars b JOIN win w ON b.date=w.date"
            )
            own[f"c{p}"] = f"SELECT *, row_number() OVER (PARTITION BY date ORDER BY f0 ASC NULLS LAST)-1 AS at_, count(f0) OVER (PARTITION BY date) AS n_ FROM b{p}"
            own[f"d{p}"] = (
                f"SELECT *, max(CASE WHEN at_=floor(0.01*(n_-1)+0.5) THEN f0 END) OVER (PARTITION BY date) AS lo_, "
                f"max(CASE WHEN at_=floor(0.99*(n_-1)+0.5) THEN f0 END) OVER (PARTITION BY date) AS hi_ FROM c{p}"
            )
            own[f"x{p}"] = f"SELECT *, CASE WHEN f0 IS NOT NULL THEN greatest(least(f0,hi_),lo_) END AS w_ FROM d{p}"
            own[f"z{p}"] = f"SELECT *, (w_-avg(w_) OVER (PARTITION BY date))/nullif(stddev_samp(w_) OVER (PARTITION BY date),0) AS z FROM x{p}"
            own[f"k{p}"] = (
                f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY z DESC, instrument_id) AS rank FROM z{p} "
                f"WHERE z IS NOT NULL) WHERE rank <= 5"
            )
            for r in (10, 20):
                rows.append(f"SELECT 'm{p}_k5_r{r}' AS spec, k.window_id, {r} AS r, d.ordinal, k.instrument_id, k.date, "
                    f"1.0::DOUBLE/count(*) OVER (PARTITION BY k.date) AS weight FROM k{p} k JOIN (SELECT date, CAST(n/{r} AS INTEGER) AS ordinal "
                    f"FROM (SELECT date, row_number() OVER (PARTITION BY window_id ORDER BY date)-1 AS n FROM win) WHERE n % {r} = 0) d ON k.date=d.date")
        own["hb"] = " UNION ALL ".join(rows)
        own["sb"] = "SELECT h.*, n.date AS until FROM hb h JOIN (SELECT DISTINCT spec, window_id, ordinal-1 AS ordinal, date FROM hb) n USING (spec, window_id, ordinal)"
        own["eb"] = "SELECT s.*, b.close AS entry FROM sb s ASOF LEFT JOIN bars b ON s.instrument_id=b.instrument_id AND s.date>=b.date"
        own["lb"] = "SELECT s.*, b.close AS leave FROM eb s ASOF LEFT JOIN bars b ON s.instrument_id=b.instrument_id AND s.until>=b.date"
        own["gb"] = "SELECT spec, window_id, r, ordinal, sum(weight*(leave/nullif(entry,0)-1)) AS g FROM lb GROUP BY ALL"
        own["mb"] = (
            "SELECT coalesce(a.spec,p.spec) AS spec, coalesce(a.window_id,p.window_id) AS window_id, coalesce(a.ordinal,p.ordinal) AS ordinal, "
            "sum(abs(coalesce(a.weight,0)-coalesce(p.weight,0)))/2 AS t "
            "FROM hb a FULL JOIN (SELECT spec, window_id, ordinal+1 AS ordinal, instrument_id, weight "
            "FROM hb) p ON a.spec=p.spec AND a.window_id=p.window_id AND a.ordinal=p.ordinal AND a.instrument_id=p.instrument_id GROUP BY 1,2,3"
        )
        own["pb"] = "SELECT g.*, g-t*0.001 AS net FROM gb g JOIN mb m USING (spec, window_id, ordinal)"
        own["nb"] = (
            "SELECT *, CASE WHEN min(net) OVER w<=-1 THEN 0 ELSE exp(sum(CASE WHEN net>-1 THEN ln(1+net) END) OVER w) END AS nav "
            "FROM pb WINDOW w AS (PARTITION BY spec, window_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)"
        )
        own["ddb"] = "SELECT *, 1-nav/greatest(max(nav) OVER (PARTITION BY spec, window_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING),1) AS dd FROM nb"
        own["res"] = (
            "SELECT spec, window_id, last(nav ORDER BY ordinal)-1 AS total_return, "
            "avg(net)/nullif(stddev_samp(net),0)*sqrt(252.0::DOUBLE/max(r)) AS sharpe, max(dd) AS max_drawdown, count(*) AS n_periods FROM ddb "
            "GROUP BY spec, window_id"
        )
        own["wf"] = (
            "SELECT spec, avg(sharpe) AS mean_sharpe, min(sharpe) AS min_sharpe, max(max_drawdown) AS max_drawdown, "
            "sum(total_return) AS total_return, min(total_return) AS worst_window FROM res GROUP BY spec"
        )
        return own, "round(mean_sharpe,6) AS mean_sharpe, round(min_sharpe,6) AS min_sharpe, round(max_drawdown,6) AS max_drawdown, round(total_return,6) AS total_return, round(worst_window,6) AS worst_window"

    own, columns = batch_ctes()
    o["e9_batch"] = b.sql("SELECT spec, window_id, round(total_return,6) AS total_return, round(sharpe,6) AS sharpe, round(max_drawdown,6) AS max_drawdown, n_periods FROM res", **own)
    o["e10_walk_forward"] = b.sql(f"SELECT spec, {columns} FROM wf", **own)
    o["e11_accepted"] = b.sql(f"SELECT spec, {columns} FROM wf WHERE mean_sharpe >= -10 AND max_drawdown <= 2 AND worst_window > -2 ORDER BY mean_sharpe DESC, spec LIMIT 10", **own)
    grid_parts = []
    grid_own: dict[str, str] = {}
    for p in PERIODS_:
        grid_own |= {f"a{p}": f"SELECT instrument_id, date, '_all' AS _group, (close/nullif({lagged('close', p)},0)-1)*100 AS f0 FROM bars"}
        grid_own |= _clip("f0", 0.01, f"a{p}", f"w{p}")
        grid_own[f"y{p}"] = f"SELECT instrument_id, date, {_z('f0')} AS combo_score FROM w{p}"
        for h in HORIZONS_:
            grid_own[f"v{p}_{h}"] = (
                f"SELECT s.date, s.combo_score, f.fwd_ret FROM y{p} s JOIN ({FWD['fwd'].format(h=h)}) f ON s.instrument_id=f.instrument_id AND s.date=f.date "
                f"WHERE combo_score IS NOT NULL AND fwd_ret IS NOT NULL"
            )
            grid_own[f"u{p}_{h}"] = f"SELECT date, {rank('combo_score', 'date')} AS a, {rank('fwd_ret', 'date')} AS b FROM v{p}_{h}"
            grid_parts.append(f"SELECT '{p}|{h}' AS candidate_id, round(avg(ic),6) AS mean, count(*) AS n_dates "
                f"FROM (SELECT date, round(covar_pop(a,b)/nullif(sqrt(var_pop(a)*var_pop(b)),0),12) AS ic FROM u{p}_{h} GROUP BY date) "
                f"WHERE ic IS NOT NULL")
    names = ", ".join(f"'{p}|{h}'" for p in PERIODS_ for h in HORIZONS_)
    grid_own["gr"] = " UNION ALL ".join(grid_parts)
    o["e8_grid"] = b.sql(f"SELECT * FROM gr WHERE candidate_id IN (SELECT id FROM (SELECT unnest([{names}]) AS id) ORDER BY md5('0:'||id) LIMIT 6)", **grid_own)
    m10 = combo.Spec(MOMENTUM.factors, top_k=3, winsorize_pct=MOMENTUM.winsorize_pct)
    q["m10_combo_screen"] = lambda s, d: combo.screen(b.bars(s, d), m10, u.universe(b.bars(s, d), b.components(s, d)), at="1999-06-30").select("instrument_id", "date", "rank", r6("combo_score"))
    o["m10_combo_screen"] = b.sql("SELECT instrument_id, date, CAST(rank AS INTEGER) AS rank, round(combo_score,6) AS combo_score FROM chosen WHERE date=DATE '1999-06-30'", **SCORED, **CHOSEN)
    return q, o
