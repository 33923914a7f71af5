"""Queries of the crossover study, signal history, screens, universe, calendar and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.operators import adjust, asof, calendar, sectors, universe
from factorlake.plans import bindings as b
from factorlake.plans import history, screens, winrate
from factorlake.plans.factor_queries import S, ema, lagged, roll
from factorlake.sources.shared import kept, new_path

_BACK = "(PARTITION BY instrument_id ORDER BY date ROWS {} PRECEDING)"


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """keys, and all other columns with doubles rounded."""
    return df.select(*keys, *(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys))


def _r(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c},{places}) AS {c}" for c in columns)


CROSS = {
    "k0": f"SELECT instrument_id, date, close, {ema('close', 2 / 61)} AS ema_s, {ema('close', 2 / 121)} AS ema_l, row_number() OVER {S} AS rn FROM intraday",
    "k1": "SELECT * FROM k0 WHERE rn > 121",
    "k2": f"SELECT *, {lagged('ema_s', 1)} AS ps, {lagged('ema_l', 1)} AS pl, row_number() OVER {S} AS i, "
        f"max(close) OVER (PARTITION BY instrument_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS top FROM k1",
    "cross_": "SELECT *, CASE WHEN ps<=pl AND ema_s>ema_l THEN 'golden' WHEN ps>=pl AND ema_s<ema_l THEN 'death' END AS signal FROM k2",
    "ev": f"SELECT *, {lagged('signal', 1)} AS bs FROM cross_ WHERE signal IS NOT NULL",
    "ch": "SELECT * FROM ev WHERE CASE WHEN bs IS NULL THEN signal='golden' ELSE signal<>bs END",
    "pr": f"SELECT instrument_id, signal, date AS entry_date, close AS entry_close, lead(date) OVER {S} AS exit_date, "
        f"lead(close) OVER {S} AS exit_close, lead(i) OVER {S}-i AS bars_held, top FROM ch",
    "tr": "SELECT instrument_id, entry_date, entry_close, exit_date, exit_close, exit_close/nullif(entry_close,0)-1 AS ret, bars_held, "
        "top/nullif(entry_close,0)-1 AS mfe, exit_close/nullif(entry_close,0)-1>0 AS win FROM pr "
        "WHERE signal='golden' AND exit_date IS NOT NULL",
    "st": "SELECT instrument_id, count(*) AS total_trades, avg(CASE WHEN win THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, "
        "avg(ret) FILTER (win) AS avg_win, avg(ret) FILTER (NOT win) AS avg_loss, min(ret) AS worst, median(ret) AS median_ret, "
        "median(bars_held) AS median_bars, median(mfe) AS median_mfe, sum(ret) AS total_return FROM tr GROUP BY instrument_id",
    "lst": "SELECT instrument_id, max(i) AS n, arg_max(ema_s>ema_l, i) AS above, arg_max(close, i) AS close, arg_max(signal, "
        "i) FILTER (signal IS NOT NULL) AS s, max(i) FILTER (signal IS NOT NULL) AS at_, arg_max(close, "
        "i) FILTER (signal IS NOT NULL) AS c FROM cross_ GROUP BY instrument_id",
    "cur": "SELECT instrument_id, n-at_ AS bars_since, close, close/nullif(c,0)-1 AS unrealized_ret FROM lst WHERE above AND s='golden'",
    "boot": "SELECT g.i AS sim, t.ret, t.ret*1000 AS pnl FROM (SELECT i, CAST('0x'||substr(md5('7:'||CAST(i AS VARCHAR)),1,8) AS BIGINT) % (SELECT count(*) "
        "FROM tr) AS k FROM range(5000) x(i)) g JOIN (SELECT row_number() OVER (ORDER BY instrument_id, entry_date)-1 AS k, ret "
        "FROM tr) t ON g.k=t.k",
}


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winrate.ema_cross(b.intraday(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winrate.pair_trades(cross(spark, sf_dir))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winrate.bootstrap(trades(spark, sf_dir), spark, 5000)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that turn to BUY."""
    return screens.rumi(b.bars(spark, sf_dir), changes_only=True).where("direction = 'BUY'").select("instrument_id", "date")


_UP = " + ".join(f"{50 - k}*{lagged('close', k)}" for k in range(50))
RUMI = {
    "ru0": f"SELECT *, {roll('avg', 'close', 3)} - ({_UP})/1275 AS d FROM bars",
    "ru1": f"SELECT *, {roll('avg', 'd', 30)} AS x FROM ru0",
    "ru2": "SELECT instrument_id, date, CASE WHEN x>0 THEN 'BUY' WHEN x<0 THEN 'SELL' END AS direction FROM ru1",
    "ru3": "SELECT * FROM ru2 WHERE direction IS NOT NULL",
    "ru4": f"SELECT *, {lagged('direction', 1)} AS bd FROM ru3",
    "sig": "SELECT instrument_id, date FROM ru4 WHERE (bd IS NULL OR bd<>direction) AND direction='BUY'",
}
HIST = RUMI | {
    "ah": "SELECT instrument_id, date, " + ", ".join(f"lead(close,{h}) OVER {S}/nullif(close,0)-1 AS ret_{h}" for h in history.HORIZONS) + " FROM bars",
    "hr": "SELECT s.instrument_id, s.date, " + ", ".join(f"ret_{h}" for h in history.HORIZONS) + " FROM sig s JOIN ah a ON s.instrument_id=a.instrument_id AND s.date=a.date",
}


def _history_sql(source: str) -> str:
    hits = ", ".join(f"avg(CASE WHEN ret_{h}>0 THEN 1.0::DOUBLE WHEN ret_{h} IS NOT NULL THEN 0 END) AS hit_rate_{h}" for h in (5, 20))
    return "SELECT instrument_id, count(*) AS n, max(date) AS last_signal, " + ", ".join(f"avg(ret_{h}) AS mean_ret_{h}" for h in history.HORIZONS) + f", {hits} FROM {source} GROUP BY instrument_id"


_MEANS = [*(f"mean_ret_{h}" for h in history.HORIZONS), "hit_rate_5", "hit_rate_20"]
PIVOT = {
    "p0": f"SELECT *, {ema('close', 2 / 11)} AS e10, {ema('close', 2 / 51)} AS e50, {ema('close', 2 / 201)} AS e200, {roll('avg', '(close*volume)', 20)} AS adv, "
        f"greatest(high-low, abs(high-c1), abs(low-c1)) AS trng FROM r",
    "p1": f"SELECT *, {ema('trng', 1 / 10)} AS a10, {ema('trng', 1 / 30)} AS a30 FROM p0",
    "p2": f"SELECT *, open/nullif(c1,0)-1 AS gap, {lagged('adv', 1)} AS advb, "
        f"(close-low)/nullif(high-low,0) AS place, {lagged('a10', 1)} AS a10b, {lagged('a30', 1)} AS a30b FROM p1",
    "p3": "SELECT *, coalesce(gap>=0.05,false) AS k1, coalesce(close*volume>=0.5*advb,false) AS k2, coalesce(place>=0.8,false) AS k3, "
        "coalesce(close>e50 AND e50>e200,false) AS k4, coalesce(advb>=10000,false) AS k5, coalesce(a10b<1.2*a30b,false) AS k6 FROM p2",
}
PIVOT_PARAMS = {"volume_multiple": 0.5, "min_adv": 10_000.0, "contraction": 1.2}
PULL = {
    "w0": f"SELECT instrument_id, date, {ema('close', 2 / 21)} AS we FROM weekly",
    "w1": f"SELECT *, {lagged('we', 1)} AS wb FROM w0",
    "c0": f"SELECT *, {ema('close', 2 / 21)} AS a, {ema('close', 2 / 61)} AS bb, {ema('close', 2 / 121)} AS c, {roll('avg', '(close*volume)', 20)} AS adv "
        f"FROM bars",
    "c1_": f"SELECT *, {lagged('c', 20)} AS cb FROM c0",
    "c2": "SELECT p.*, w1.we, w1.wb FROM c1_ p ASOF LEFT JOIN w1 ON p.instrument_id=w1.instrument_id AND p.date>=w1.date",
    "rg": "SELECT date, coalesce(close>CASE WHEN count(close) OVER w=200 THEN avg(close) OVER w END,true) AS calm "
        "FROM benchmark_px WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)",
    "c3": "SELECT c2.*, calm AND (greatest(a,bb,c)-least(a,bb,c))/nullif(least(a,bb,c),0)<0.3 AND abs((close-we)/nullif(we,0))<0.2 AND c>cb AND we>wb AND adv>=1000 AS ok "
        "FROM c2 JOIN rg ON c2.date=rg.date",
}
CLENOW = {
    "q0": f"SELECT *, {roll('avg', 'close', 100)} AS ma, {roll('min', 'ret', 90)} AS mdr, CASE WHEN close>0 THEN ln(close) END AS y, CAST(rn AS DOUBLE) AS k, "
        f"greatest(high-low, abs(high-c1), abs(low-c1)) AS trng, {roll('max', 'close', 63)} AS hh, {roll('avg', 'volume', 20)} AS vma FROM r",
    "q1": f"SELECT *, count(y) OVER {_BACK.format(89)} AS n, covar_pop(y,k) OVER {_BACK.format(89)} AS cov, "
        f"var_pop(y) OVER {_BACK.format(89)} AS vy, {ema('trng', 1 / 20)} AS atr FROM q0",
    "q2": "SELECT *, CASE WHEN n=90 AND vy>0 THEN (exp(cov/(8099/12.0::DOUBLE)*252)-1)*100*cov*cov/(8099/12.0::DOUBLE*vy) END AS score FROM q1",
    "q3": "SELECT q.*, g.sector FROM (SELECT * FROM q2 WHERE close>ma AND mdr>=-5 AND score>0) q ASOF "
        "LEFT JOIN sectors g ON q.instrument_id=g.instrument_id AND q.date>=g.date",
    "q4": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, instrument_id) AS s FROM q3) WHERE s <= 2",
    "q5": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument_id) AS rank FROM q4) WHERE rank <= 5",
    "q6": "SELECT *, CAST(floor(100000/nullif(atr,0)) AS BIGINT) AS shares, (close/nullif(ma,0)-1)*100 AS deviation_pct, "
        "(close/nullif(hh,0)-1)*100 AS drawdown_pct, volume/nullif(vma,0) AS volume_multiple, close-3*atr AS stop_price FROM q5",
    "q7": "SELECT *, concat_ws(',', CASE WHEN deviation_pct>50 THEN 'extended' END, CASE WHEN drawdown_pct< -15 THEN 'pulled back' END, CASE WHEN volume_multiple>3 THEN 'volume spike' END) AS alerts "
        "FROM q6 WHERE atr>0 AND shares>=1",
}


def clenow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.regression_momentum(b.bars(spark, sf_dir), sectors=b.sectors(spark, sf_dir), top=5, max_per_sector=2, trend=100, worst=-5.0, risk=0.1)


def pullbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.cluster_pullback(b.bars(spark, sf_dir), b.weekly(spark, sf_dir), b.benchmark_px(spark, sf_dir), cluster=0.3, near=0.2, min_adv=1000.0, regime=200)


RS = {
    "rs0": "SELECT *, CASE WHEN count(close) OVER w=200 THEN avg(close) OVER w END AS ma FROM benchmark_px WINDOW w AS (ORDER BY date ROWS 199 PRECEDING)",
    "rs1": "SELECT b.*, m.close AS bench, coalesce(m.close>m.ma,true) AS ok, b.close/nullif(m.close,0) AS rs FROM bars b JOIN rs0 m ON b.date=m.date",
    "rs2": f"SELECT *, {ema('rs', 2 / 61)} AS f, {ema('rs', 2 / 121)} AS s, {roll('avg', '(close*volume)', 20)} AS adv, row_number() OVER {S} AS n FROM rs1",
    "rs3": "SELECT *, f/nullif(s,0)-1 AS score FROM rs2 WHERE n>120 AND f>s AND adv>=1000 AND ok",
    "rs4": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument_id) AS rank FROM rs3) WHERE rank<=3",
}


def queries_and_sql() -> tuple[dict, dict]:
    q, o = {}, {}

    def add(name: str, query, sql: str | None, **own: str) -> None:  # noqa: ANN001
        q[name] = query
        if sql is not None:
            o[name] = b.sql(sql, **own)

    # crossover study
    add(
        "w1_adv",
        lambda s, d: winrate.adv_daily(b.bars(s, d), "2001-09-30").select("instrument_id", F.col("adv").cast("float")),
        "SELECT instrument_id, CAST(avg(volume) FILTER (rn<=20) * arg_max(close,date) AS FLOAT) AS adv FROM t GROUP BY instrument_id",
        t="SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY date DESC) AS rn FROM bars "
            "WHERE date<=DATE '2001-09-30' AND date>=DATE '2001-08-31'",
    )
    add(
        "w2_ema_cross",
        lambda s, d: rounded(cross(s, d), "instrument_id", "date"),
        f"SELECT instrument_id, date, {_r('close', 'ema_s', 'ema_l')}, signal FROM cross_",
        **CROSS,
    )
    tcols = f"instrument_id, entry_date, exit_date, {_r('entry_close', 'exit_close', 'ret', 'mfe')}, CAST(bars_held AS INTEGER) AS bars_held, win"
    add("w3_pair_trades", lambda s, d: rounded(trades(s, d), "instrument_id", "entry_date"), f"SELECT {tcols} FROM tr", **CROSS)
    add(
        "w4_overall",
        lambda s, d: rounded(winrate.overall(trades(s, d))),
        "SELECT count(*) AS total_trades, round(coalesce(avg(CASE WHEN win THEN 1.0::DOUBLE ELSE 0 END),0),6) AS win_rate, "
        "round(coalesce(avg(ret) FILTER (win),0),6) AS avg_win, round(coalesce(avg(ret) FILTER (NOT win),0),6) AS avg_loss, "
        "round(coalesce(sum(ret) FILTER (win),0)/nullif(abs(sum(ret) FILTER (NOT win)),0),6) AS profit_factor, "
        "round(coalesce(avg(bars_held),0),6) AS avg_bars_held FROM tr",
        **CROSS,
    )
    stats = _r("win_rate", "avg_win", "avg_loss", "worst", "median_ret", "median_bars", "median_mfe", "total_return")
    add(
        "w5_per_instrument",
        lambda s, d: rounded(winrate.per_instrument(trades(s, d)), "instrument_id"),
        f"SELECT instrument_id, total_trades, {stats} FROM st",
        **CROSS,
    )
    add(
        "w6_current_screen",
        lambda s, d: rounded(winrate.current_screen(cross(s, d)), "instrument_id"),
        f"SELECT instrument_id, CAST(bars_since AS INTEGER) AS bars_since, {_r('close', 'unrealized_ret')} FROM cur",
        **CROSS,
    )

    def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = cross(spark, sf_dir)
        return rounded(winrate.recent_golden(c, winrate.per_instrument(winrate.pair_trades(c)), None, max_bars_since=500), "instrument_id")

    add(
        "w7_recent_golden",
        recent,
        f"SELECT c.instrument_id, CAST(bars_since AS INTEGER) AS bars_since, {_r('close', 'unrealized_ret')}, "
        f"coalesce(total_trades,0) AS n, {stats}, round(bars_since/nullif(median_bars,0),6) AS progress_pct, "
        f"round(unrealized_ret/nullif(median_mfe,0),6) AS overheat_pct FROM cur c LEFT JOIN st s ON c.instrument_id=s.instrument_id "
        f"WHERE bars_since<=500 AND (total_trades IS NULL OR total_trades>=3)",
        **CROSS,
    )
    add(
        "w8_study",
        lambda s, d: rounded(winrate.study(b.intraday(s, d), b.bars(s, d), "2001-09-30")["per_instrument"], "instrument_id"),
        f"SELECT instrument_id, total_trades, {stats} FROM st",
        **CROSS,
    )
    add(
        "w9_bootstrap",
        lambda s, d: rounded(winrate.bootstrap_summary(draws(s, d)), places=4),
        f"SELECT {_r('mean_pnl', 'median_pnl', 'best', 'worst', 'win_rate', 'std_pnl', 'total_pnl', 'mean_ret', places=4)} "
        f"FROM (SELECT avg(pnl) AS mean_pnl, median(pnl) AS median_pnl, max(pnl) AS best, min(pnl) AS worst, "
        f"avg(CASE WHEN pnl>0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, stddev_pop(pnl) AS std_pnl, sum(pnl) AS total_pnl, "
        f"avg(ret) AS mean_ret FROM boot)",
        **CROSS,
    )
    add(
        "w10_percentiles",
        lambda s, d: rounded(winrate.percentiles(draws(s, d), "pnl"), places=4),
        "SELECT " + ", ".join(f"round(quantile_cont(pnl,{p / 100}),4) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM boot",
        **CROSS,
    )
    add(
        "w11_histogram",
        lambda s, d: winrate.histogram(draws(s, d), "pnl"),
        "SELECT CAST(CASE WHEN hi=lo THEN 0 ELSE least(floor((pnl-lo)/((hi-lo)/10)),9) END AS INTEGER) AS bin, count(*) AS n "
        "FROM boot, (SELECT min(pnl) AS lo, max(pnl) AS hi FROM boot) GROUP BY 1",
        **CROSS,
    )

    # signal history
    rets = [f"ret_{h}" for h in history.HORIZONS]
    add(
        "h1_with_returns",
        lambda s, d: rounded(history.with_returns(signals(s, d), b.bars(s, d)), "instrument_id", "date"),
        f"SELECT instrument_id, date, {_r(*rets)} FROM hr",
        **HIST,
    )
    add(
        "h2_aggregate",
        lambda s, d: rounded(history.aggregate(history.with_returns(signals(s, d), b.bars(s, d))), "instrument_id"),
        f"SELECT instrument_id, n, last_signal, {_r(*_MEANS)} FROM hh",
        **HIST,
        hh=_history_sql("hr"),
    )
    add("h3_replay", lambda s, d: signals(s, d), "SELECT instrument_id, date FROM sig", **RUMI)
    add(
        "h4_next_window",
        lambda s, d: history.next_window(history.aggregate(history.with_returns(signals(s, d), b.bars(s, d))), "2002-01-31"),
        "SELECT max(date)+1 AS start, DATE '2002-01-31'-45 AS \"end\" FROM hr",
        **HIST,
    )

    def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = history.with_returns(signals(spark, sf_dir), b.bars(spark, sf_dir))
        cut = F.lit("1998-06-30").cast("date")
        return history.merge(history.aggregate(r.where(F.col("date") <= cut)), history.aggregate(r.where(F.col("date") > cut)))

    mean = lambda c: f"round(CASE WHEN z.n IS NULL THEN a.{c} WHEN a.n IS NULL THEN z.{c} ELSE (a.n*coalesce(a.{c},0)+z.n*coalesce(z.{c},0))/(a.n+z.n) END,6) AS {c}"
    add(
        "h5_merge",
        lambda s, d: rounded(merged(s, d), "instrument_id"),
        "SELECT coalesce(a.instrument_id,z.instrument_id) AS instrument_id, coalesce(a.n,0)+coalesce(z.n,0) AS n, "
        "greatest(a.last_signal,z.last_signal) AS last_signal, " + ", ".join(map(mean, _MEANS)) + " FROM ha a FULL JOIN hz z ON a.instrument_id=z.instrument_id",
        **HIST,
        r0="SELECT * FROM hr WHERE date<=DATE '1998-06-30'",
        r1="SELECT * FROM hr WHERE date>DATE '1998-06-30'",
        ha=_history_sql("r0"),
        hz=_history_sql("r1"),
    )

    def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Two strategies' histories stored, one of them replaced by that of a part of its signals; the stored table's state."""
        path = new_path(spark, "history")
        returns = kept(history.with_returns(signals(spark, sf_dir), b.bars(spark, sf_dir)), "returns")  # read four times
        whole = history.aggregate(returns)
        for strategy, market in (("rumi", "US"), ("rumi", "CN"), ("other", "US")):
            history.save(whole, path, strategy, market)
        history.save(history.aggregate(returns.where("date <= DATE'1998-06-30'")), path, "rumi", "US")
        return history.status(spark.read.parquet(path))

    state = "SELECT '{}' AS strategy, '{}' AS market, count(*) AS n_rows, min(last_signal) AS first_signal, max(last_signal) AS last_signal FROM {}"
    add("h6_status", replaced, " UNION ALL ".join(state.format(*x) for x in (("rumi", "US", "ha"), ("rumi", "CN", "hh"), ("other", "US", "hh"))),
        **HIST, r0="SELECT * FROM hr WHERE date<=DATE '1998-06-30'", ha=_history_sql("r0"), hh=_history_sql("hr"))

    # screens
    m1 = ["CLENOW_SCORE", "deviation_pct", "drawdown_pct", "volume_multiple"]
    add(
        "m1_regression_momentum",
        lambda s, d: clenow(s, d).select("instrument_id", "date", "rank", F.round("CLENOW_SCORE", 4).alias("score")),
        "SELECT instrument_id, date, CAST(rank AS INTEGER) AS rank, round(score,4) AS score FROM q7",
        **CLENOW,
    )
    add(
        "m2_display",
        lambda s, d: clenow(s, d).select("instrument_id", "date", "shares", *(F.round(c, 4).alias(c) for c in (*m1[1:], "stop_price")), "alerts"),
        f"SELECT instrument_id, date, shares, {_r(*m1[1:], 'stop_price', places=4)}, alerts FROM q7",
        **CLENOW,
    )
    add(
        "m3_relative_strength",
        lambda s, d: screens.relative_strength(b.bars(s, d), b.benchmark_px(s, d), min_adv=1000.0, top=3).select("instrument_id", "date", "rank", F.round("score", 6).alias("score")),
        "SELECT instrument_id, date, CAST(rank AS INTEGER) AS rank, round(score,6) AS score FROM rs4",
        **RS,
    )
    add(
        "m4_cluster_pullback",
        lambda s, d: pullbacks(s, d).select("instrument_id", "date", "close"),
        "SELECT instrument_id, date, close FROM c3 WHERE ok",
        **PULL,
    )

    def exits4(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = pullbacks(spark, sf_dir).select("instrument_id", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
        return screens.pullback_exits(e, b.bars(spark, sf_dir)).select("instrument_id", "entry_date", "exit_date", "exit_rule")

    hit = "SELECT instrument_id, entry_date, min(date) AS exit_date, arg_min(rule, date) AS exit_rule FROM {} GROUP BY instrument_id, entry_date"
    add(
        "m5_pullback_exits",
        exits4,
        "SELECT e.instrument_id, e.date AS entry_date, h.exit_date, h.exit_rule FROM en e "
        "LEFT JOIN h ON e.instrument_id=h.instrument_id AND e.date=h.entry_date",
        **PULL,
        en="SELECT instrument_id, date, close FROM c3 WHERE ok",
        u0="SELECT *, sum(CASE WHEN close<bb THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY date ROWS 2 PRECEDING) AS u FROM c0",
        hits="SELECT e.instrument_id, e.date AS entry_date, p.date, CASE WHEN p.close<=e.close*0.92 THEN 'stop' WHEN u=3 THEN 'trend' END AS rule "
            "FROM en e JOIN u0 p ON e.instrument_id=p.instrument_id AND p.date>e.date WHERE p.close<=e.close*0.92 OR u=3",
        h=hit.format("hits"),
    )
    add(
        "m6_gap_pivot",
        lambda s, d: screens.gap_pivot(b.bars(s, d), **PIVOT_PARAMS).select("instrument_id", "date", F.round("gap", 6).alias("gap")),
        "SELECT instrument_id, date, round(gap,6) AS gap FROM p3 WHERE k1 AND k2 AND k3 AND k4 AND k5 AND k6",
        **PIVOT,
    )
    add(
        "m7_rejection_funnel",
        lambda s, d: screens.rejection_funnel(b.bars(s, d), **PIVOT_PARAMS),
        "SELECT CASE WHEN NOT k1 THEN 'gap' WHEN NOT k2 THEN 'volume' WHEN NOT k3 THEN 'close_place' WHEN NOT k4 THEN 'trend' WHEN NOT k5 THEN 'liquidity' WHEN NOT k6 THEN 'contraction' ELSE 'passed' END AS reason, "
        "count(*) AS n FROM p3 GROUP BY 1",
        **PIVOT,
    )

    add(
        "m8_pivot_exits",
        lambda s, d: screens.pivots_with_exits(b.bars(s, d), **PIVOT_PARAMS).select("instrument_id", "entry_date", "exit_date", "exit_rule"),
        "SELECT e.instrument_id, e.date AS entry_date, h.exit_date, h.exit_rule FROM en e "
        "LEFT JOIN h ON e.instrument_id=h.instrument_id AND e.date=h.entry_date",
        **PIVOT,
        en="SELECT instrument_id, date, low FROM p3 WHERE k1 AND k2 AND k3 AND k4 AND k5 AND k6",
        hits="SELECT e.instrument_id, e.date AS entry_date, p.date, CASE WHEN p.low<=e.low THEN 'pivot low' WHEN p.close<e10 THEN 'average' END AS rule "
            "FROM en e JOIN p0 p ON e.instrument_id=p.instrument_id AND p.date>e.date WHERE p.low<=e.low OR p.close<e10",
        h=hit.format("hits"),
    )
    add(
        "m9_rumi",
        lambda s, d: screens.rumi(b.bars(s, d)).select("instrument_id", "date", "direction"),
        "SELECT instrument_id, date, direction FROM ru3",
        **RUMI,
    )

    def report(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = b.bars(spark, sf_dir)
        sig = clenow(spark, sf_dir).select("instrument_id", "date", "sector", "CLENOW_R2")
        h = history.aggregate(history.with_returns(signals(spark, sf_dir), bars))
        return screens.report(sig, h, sectors.names(b.sectors(spark, sf_dir))).select("instrument_id", "date", "sector", "sector_name", "n_history", "mean_ret_20_pct", "hit_rate_20_pct", "stars", "fit")

    add(
        "m11_report",
        report,
        "SELECT q.instrument_id, q.date, q.sector, q.sector AS sector_name, coalesce(h.n,0) AS n_history, "
        "round(h.mean_ret_20*100,2) AS mean_ret_20_pct, round(h.hit_rate_20*100,2) AS hit_rate_20_pct, CASE WHEN h.n>=10 THEN 3 WHEN h.n>=5 THEN 2 WHEN h.n>0 THEN 1 ELSE 0 END AS stars, CASE WHEN r2>=0.85 THEN 'excellent' WHEN r2>=0.75 THEN 'good' WHEN r2>=0.65 THEN 'fair' ELSE 'weak' END AS fit "
        "FROM (SELECT *, cov*cov/(8099/12.0::DOUBLE*vy) AS r2 FROM q7) q LEFT JOIN hh h ON q.instrument_id=h.instrument_id",
        **CLENOW,
        **HIST,
        hh=_history_sql("hr"),
    )
    add(
        "m12_direction_counts",
        lambda s, d: screens.direction_counts(screens.rumi(b.bars(s, d))),
        "SELECT direction, count(*) AS n FROM ru3 GROUP BY direction",
        **RUMI,
    )

    # adjustment and joins
    for name, mode, base in (("a1_forward", "forward", "last"), ("a2_backward", "backward", "first")):
        add(
            f"{name}_adjust",
            lambda s, d, mode=mode: adjust.adjusted(b.bars(s, d), mode).select("instrument_id", "date", *(F.col(p).cast("float") for p in adjust.PRICES), "volume"),
            "SELECT instrument_id, date, " + ", ".join(f"CAST({p}*(adj_factor/f) AS FLOAT) AS {p}" for p in adjust.PRICES) + f", volume FROM (SELECT *, {base}(adj_factor) OVER (PARTITION BY instrument_id "
            f"ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM bars)",
        )
    add(
        "a3_raw",
        lambda s, d: adjust.adjusted(b.bars(s, d), "raw").select("instrument_id", "date", "open", "close"),
        "SELECT instrument_id, date, open, close FROM bars",
    )
    add(
        "j1_asof_fundamentals",
        lambda s, d: rounded(asof.asof(b.bars(s, d).select("instrument_id", "date"), b.fundamentals(s, d), ["end_date", "roe", "revenue_yoy"], tie="end_date"), "instrument_id", "date"),
        "SELECT b.instrument_id, b.date, f.end_date, round(f.roe,6) AS roe, round(f.revenue_yoy,6) AS revenue_yoy FROM bars b ASOF "
        "LEFT JOIN fundamentals f ON b.instrument_id=f.instrument_id AND b.date>=f.date",
    )
    add(
        "j2_enrich",
        lambda s, d: rounded(asof.enrich(b.bars(s, d).select("instrument_id", "date"), b.fundamentals(s, d), b.valuation(s, d)).select("instrument_id", "date", "net_margin", "pe_ttm", "pb"), "instrument_id", "date"),
        f"SELECT instrument_id, date, {_r('net_margin', 'pe_ttm', 'pb')} FROM panel",
    )
    add(
        "j3_sector_asof",
        lambda s, d: sectors.with_sector(b.bars(s, d).select("instrument_id", "date"), b.sectors(s, d)),
        "SELECT instrument_id, date, sector FROM sectored",
    )
    groups = {"north": ["EUROPE", "AMERICA"], "south": ["AFRICA", "ASIA", "MIDDLE EAST"]}
    add(
        "j4_groups",
        lambda s, d: sectors.grouped(sectors.with_sector(b.bars(s, d).select("instrument_id", "date"), b.sectors(s, d)), groups, {"S000001": "own"}).select("instrument_id", "date", "_group"),
        "SELECT * FROM (SELECT instrument_id, date, CASE WHEN instrument_id='S000001' THEN 'own' WHEN sector IN ('EUROPE','AMERICA') THEN 'north' WHEN sector IN ('AFRICA','ASIA','MIDDLE EAST') THEN 'south' END AS _group "
        "FROM sectored) WHERE _group IS NOT NULL",
    )
    add(
        "j6_weekly_asof",
        lambda s, d: rounded(screens.weekly_asof(b.bars(s, d).select("instrument_id", "date", "close"), b.weekly(s, d)).drop("close"), "instrument_id", "date", places=4),
        "SELECT instrument_id, date, round(we,4) AS week_ema, round(wb,4) AS week_ema_before FROM c2",
        **PULL,
    )
    add(
        "j8_benchmark_ratio",
        lambda s, d: b.bars(s, d).join(b.benchmark_px(s, d).withColumnRenamed("close", "bench"), "date").select("instrument_id", "date", F.round(F.col("close") / F.col("bench"), 6).alias("rs")),
        "SELECT a.instrument_id, a.date, round(a.close/m.close,6) AS rs FROM bars a JOIN benchmark_px m ON a.date=m.date",
    )

    # universe and calendar
    add("u1_universe", lambda s, d: universe.universe(b.bars(s, d), b.components(s, d)), "SELECT instrument_id, date FROM tradable")
    days = lambda s: s.sql("SELECT explode(array(DATE'1999-03-06', DATE'1999-04-10', DATE'2001-12-30')) AS date")
    listed = {
        "ld": "SELECT instrument_id, max(date) FILTER (event='IPO') AS ipo, max(date) FILTER (event='DELIST') AS delist FROM components GROUP BY instrument_id",
        "dd": "SELECT unnest([DATE '1999-03-06', DATE '1999-04-10', DATE '2001-12-30']) AS date",
        "li": "SELECT l.instrument_id, dd.date FROM ld l, dd WHERE (ipo IS NULL OR ipo<=dd.date) AND (delist IS NULL OR delist>dd.date) AND NOT EXISTS (SELECT 1 "
            "FROM halts h WHERE h.instrument_id=l.instrument_id AND dd.date>=h.halt AND (h.resume IS NULL OR dd.date<h.resume))",
    }
    add("u1_listed", lambda s, d: universe.listed(b.components(s, d), days(s)), "SELECT instrument_id, date FROM li", **listed)
    add(
        "u2_ever_added",
        lambda s, d: universe.ever_added(b.components(s, d), "SP500"),
        "SELECT DISTINCT instrument_id FROM components WHERE event LIKE 'SP500%ADD'",
    )
    add(
        "u3_active",
        lambda s, d: universe.active(b.bars(s, d).select("instrument_id", "date"), b.components(s, d)),
        "SELECT b.instrument_id, b.date, (ipo IS NULL OR ipo<=b.date) AND (delist IS NULL OR delist>b.date) AND NOT EXISTS (SELECT 1 "
        "FROM halts h WHERE h.instrument_id=b.instrument_id AND b.date>=h.halt AND (h.resume IS NULL OR b.date<h.resume)) AS is_active "
        "FROM bars b JOIN ld l ON b.instrument_id=l.instrument_id",
        ld=listed["ld"],
    )
    add("u4_halts", lambda s, d: universe.halts(b.components(s, d)), "SELECT instrument_id, halt, resume FROM halts")
    add("u5_listings", lambda s, d: universe.listings(b.components(s, d)), "SELECT instrument_id, ipo, delist FROM ld", ld=listed["ld"])
    add(
        "u6_sizes",
        lambda s, d: universe.sizes(universe.universe(b.bars(s, d), b.components(s, d))),
        "SELECT date, count(*) AS n_members FROM tradable GROUP BY date",
    )
    add(
        "u7_events",
        lambda s, d: universe.event_rows(b.components(s, d), "IPO", "DELIST"),
        "SELECT instrument_id, date, event FROM components WHERE event IN ('IPO','DELIST')",
    )
    add(
        "u8_active_by_last_event",
        lambda s, d: universe.active_by_last_event(b.components(s, d), "1999-04-01"),
        "SELECT instrument_id, event FROM (SELECT instrument_id, last(event ORDER BY date, event) AS event FROM components "
        "WHERE date<=DATE '1999-04-01' GROUP BY instrument_id) WHERE event NOT IN ('DELIST','HALT')",
    )
    add(
        "u9_sector_members",
        lambda s, d: sectors.members_at(b.sectors(s, d), "1999-01-01", "ASIA"),
        "SELECT instrument_id, sector, sector_name FROM (SELECT *, lead(date) OVER (PARTITION BY instrument_id ORDER BY date) AS til "
        "FROM sectors) WHERE date<=DATE '1999-01-01' AND (til IS NULL OR DATE '1999-01-01'<til) AND sector='ASIA'",
    )
    add("u10_sector_names", lambda s, d: sectors.names(b.sectors(s, d)), "SELECT sector, max(sector_name) AS sector_name FROM sectors GROUP BY sector")

    def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The calendar from the first to the last bar; days on which no instrument has a bar are its holidays."""
        bars = b.bars(spark, sf_dir)
        lo, hi = bars.agg(F.min("date"), F.max("date")).first()
        every = calendar.calendar(spark, str(lo), str(hi))
        closed = every.select("date").join(bars.select("date").distinct(), "date", "left_anti")
        return calendar.calendar(spark, str(lo), str(hi), closed)

    cals = {
        "span_": "SELECT min(date) AS lo, max(date) AS hi FROM bars",
        "cd": "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span_",
        "ct": "SELECT date, isodow(date)<=5 AND date IN (SELECT date FROM bars) AS is_trading FROM cd",
    }
    add("c1_calendar", lambda s, d: cal(s, d).select("date", "is_trading"), "SELECT date, is_trading FROM ct", **cals)
    add(
        "c2_trading_days",
        lambda s, d: calendar.trading_days(cal(s, d), "1999-01-01", "1999-12-31"),
        "SELECT date FROM ct WHERE is_trading AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'",
        **cals,
    )
    add(
        "c3_neighbours",
        lambda s, d: calendar.neighbours(cal(s, d)),
        "SELECT date, first(CASE WHEN is_trading THEN date END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS next_trading, "
        "last(CASE WHEN is_trading THEN date END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS previous_trading "
        "FROM ct",
        **cals,
    )
    add(
        "c4_week_ordinal",
        lambda s, d: cal(s, d).select("date", "week_ordinal"),
        "SELECT date, CAST(CASE WHEN is_trading THEN sum(CAST(is_trading AS INTEGER)) OVER (PARTITION BY date_trunc('week', date) "
        "ORDER BY date) ELSE 0 END AS INTEGER) AS week_ordinal FROM ct",
        **cals,
    )
    return q, o
