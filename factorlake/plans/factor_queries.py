"""Queries of the factors and indicators over the bound tables, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import factors, indicators
from factorlake.operators.asof import enrich
from factorlake.plans import bindings as b

S = "(PARTITION BY instrument_id ORDER BY date)"
Query = Callable[[SparkSession, str], DataFrame]


def roll(agg: str, x: str, p: int) -> str:
    w = f"(PARTITION BY instrument_id ORDER BY date ROWS {p - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} = {p} THEN {agg}({x}) OVER {w} END"


def lagged(x: str, n: int) -> str:
    return f"lag({x},{n}) OVER {S}"


def ema(x: str, alpha: float, adjusted: bool = False) -> str:
    """The recursion itself, folded over the list of all values so far."""
    values = f"list(CAST({x} AS DOUBLE)) OVER (PARTITION BY instrument_id ORDER BY date ROWS UNBOUNDED PRECEDING)"
    folded = f"list_reduce({values}, lambda acc, v: {alpha!r}*v + {1 - alpha!r}*acc)"
    if not adjusted:
        return folded
    # adjusted weights: the first value weighs alpha too, and the sum is divided by the weights
    first = f"first_value(CAST({x} AS DOUBLE)) OVER {S}"
    t = f"CAST(row_number() OVER {S} AS DOUBLE)"
    return f"((({folded}) - {1 - alpha!r}*power({1 - alpha!r}, {t}-1)*({first}))/(1-power({1 - alpha!r}, {t})))"


def rank(x: str, keys: str, descending: bool = False) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys} ORDER BY {x} {'DESC' if descending else 'ASC'} NULLS LAST) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1)/2.0::DOUBLE END"


#: name of query -> (registered name, parameters, places, SQL of each output column over r). Columns in output order.
SIMPLE: dict[str, tuple[str, dict, int, dict[str, str]]] = {
    "f1_momentum": ("momentum", {}, 6, {"momentum": f"(close/nullif({lagged('close', 10)},0)-1)*100"}),
    "f2_returns": ("returns", {}, 6, {"returns": "ret*100"}),
    "f3_volatility": ("volatility", {}, 6, {"volatility": f"({roll('stddev_samp', 'ret', 20)})*sqrt(252)"}),
    "f4_volume_ratio": ("volume_ratio", {}, 6, {"volume_ratio_20": f"volume/nullif({roll('avg', 'volume', 20)},0)"}),
    "f5_price_range": ("price_range", {}, 6, {"price_range": "(high-low)/nullif(close,0)"}),
    "f6_gap": ("gap", {}, 6, {"gap": "(open-c1)/nullif(c1,0)"}),
    "f7_intraday_return": ("intraday_return", {}, 6, {"intraday_return": "(close-open)/nullif(open,0)"}),
    "f8_overnight_return": ("overnight_return", {}, 6, {"overnight_return": "(open-c1)/nullif(c1,0)*100"}),
    "f9_turnover": ("turnover", {}, 6, {"turnover": "0.0::DOUBLE"}),
    "f10_relative_strength": ("relative_strength", {}, 6, {"relative_strength": f"(close/nullif({lagged('close', 20)},0)-1)*100"}),
    "f11_max_drawdown": ("max_drawdown", {}, 6, {"max_drawdown": f"(close-({roll('max', 'close', 20)}))/nullif(({roll('max', 'close', 20)}),0)"}),
    "f12_sharpe_proxy": ("sharpe_proxy", {}, 6, {"sharpe_proxy": f"(close/nullif({lagged('close', 10)},0)-1)/nullif({roll('stddev_samp', 'ret', 20)},0)"}),
    "f13_price_momentum": ("price_momentum", {"period": 20}, 6, {"momentum_20": f"(close/nullif({lagged('close', 20)},0)-1)*100"}),
    "f15_price_volatility": ("price_volatility", {}, 6, {"volatility_20": f"({roll('stddev_samp', 'ret', 20)})*sqrt(252)"}),
    "f18_turnover_rate": ("turnover_rate", {}, 6, {"turnover_rate": "CAST(NULL AS DOUBLE)"}),
    "f19_ma_bias_sma": ("ma_bias", {}, 6, {"ma_bias_20_SMA": f"close/nullif({roll('avg', 'close', 20)},0)-1"}),
    "f19_ma_bias_ema": ("ma_bias", {"ma_type": "EMA"}, 6, {"ma_bias_20_EMA": f"close/{ema('close', 1 - math.exp(-math.log(2) / 20), True)}-1"}),
    "i1_ma": ("MA", {}, 4, {"MA_20": roll("avg", "close", 20)}),
    "i2_ema": ("EMA", {}, 4, {"EMA_20": ema("close", 2 / 21)}),
    "i8_roc": ("ROC", {}, 6, {"ROC_10": f"(close-{lagged('close', 10)})/nullif({lagged('close', 10)},0)*100"}),
    "i9_mom": ("MOM", {}, 0, {"MOM_10": f"close-{lagged('close', 10)}"}),
    "i10_std": ("STD", {}, 4, {"STD_20": roll("stddev_samp", "close", 20)}),
    "i11_vol": ("VOL", {}, 6, {"VOL_20": f"({roll('stddev_samp', 'ret', 20)})*sqrt(252)"}),
    "i12_vma": ("VMA", {}, 4, {"VMA_20": roll("avg", "volume", 20)}),
    "i12_sma_volume": ("SMA_VOLUME", {}, 4, {"SMA_VOLUME_50": roll("avg", "volume", 50)}),
    "i13_obv": ("OBV", {}, 0, {"OBV": "CAST(sum(CASE WHEN close>c1 THEN volume WHEN close<c1 THEN -volume ELSE 0 END) OVER (PARTITION BY instrument_id "
        "ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT)"}),
    "i14_max": ("MAX", {}, 0, {"MAX_20": roll("max", "high", 20)}),
    "i14_min": ("MIN", {}, 0, {"MIN_20": roll("min", "low", 20)}),
    "i15_hh": ("HH", {}, 0, {"HH_63": roll("max", "close", 63)}),
    "i16_ll": ("LL", {}, 0, {"LL_20": roll("min", "low", 20)}),
    "i17_min_daily_return": ("MIN_DAILY_RETURN", {}, 6, {"MIN_DAILY_RETURN_90": roll("min", "ret", 90)}),
    "i18_adr_pct": ("ADR_PCT", {}, 6, {"ADR_PCT_20": roll("avg", "((high-low)/nullif(close,0))", 20)}),
}


def _places(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("instrument_id", "date", *(F.round(c, n).alias(c) if kinds[c] == "double" and n else F.col(c) for c, n in columns.items()))


def _on_bars(name: str, params: dict, columns: dict[str, int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = factors.FACTORS.get(name) or indicators.INDICATORS.find(name)
        return _places(f(b.bars(spark, sf_dir), **params), columns)

    return query


def _selected(columns: dict[str, tuple[str, int]], source: str, own: dict[str, str] | None = None) -> str:
    listed = ", ".join(f'round({x}, {n}) AS "{c}"' if n else f'{x} AS "{c}"' for c, (x, n) in columns.items())
    return b.sql(f"SELECT instrument_id, date, {listed} FROM {source}", **(own or {}))


def queries_and_sql() -> tuple[dict[str, Query], dict[str, str]]:
    q: dict[str, Query] = {}
    o: dict[str, str] = {}
    for name, (registered, params, places, columns) in SIMPLE.items():
        q[name] = _on_bars(registered, params, dict.fromkeys(columns, places))
        o[name] = _selected({c: (x, places) for c, x in columns.items()}, "r")

    def add(name: str, registered: str, columns: dict[str, tuple[str, int]], source: str, own: dict[str, str], params: dict | None = None) -> None:
        q[name] = _on_bars(registered, params or {}, {c: n for c, (_, n) in columns.items()})
        o[name] = _selected(columns, source, own)

    # values with many exact decimals: single precision has no ties to round differently
    q["i18_adv"] = lambda s, d: indicators.adv(b.bars(s, d)).select("instrument_id", "date", F.col("ADV_20").cast("float"))
    o["i18_adv"] = b.sql(f'SELECT instrument_id, date, CAST({roll("avg", "(close*volume)", 20)} AS FLOAT) AS "ADV_20" FROM r')
    mom = {"m": f"SELECT *, (close/nullif({lagged('close', 10)},0)-1)*100 AS x FROM bars"}
    add("f14_momentum_rank", "momentum_rank", {"momentum_rank_10": (f"({rank('x', 'date')})/count(*) OVER (PARTITION BY date)", 6)}, "m", mom)
    vol = {"m": f"SELECT *, ({roll('stddev_samp', 'ret', 20)})*sqrt(252) AS x FROM r"}
    add(
        "f16_volatility_rank",
        "volatility_rank",
        {"volatility_rank_20": (f"1-({rank('x', 'date')})/count(*) OVER (PARTITION BY date)", 6)},
        "m",
        vol,
        {"ascending": True},
    )
    align = {"m": f"SELECT *, {ema('close', 2 / 21, True)} AS ef, {ema('close', 2 / 61, True)} AS em, {ema('close', 2 / 121, True)} AS es FROM bars"}
    add("f20_ema_alignment", "ema_alignment", {"ema_alignment_20_60_120": ("least(close/ef-1, ef/em-1, em/es-1)", 6)}, "m", align)

    wma = " + ".join(f"{k + 1}*{lagged('close', k)}" for k in range(20))
    add("i3_wma", "WMA", {"WMA_20": (f"({wma})/210", 4)}, "r", {})
    gains = {"m": f"SELECT *, greatest(coalesce(close-c1,0),0) AS g, greatest(-coalesce(close-c1,0),0) AS l FROM r", "m2": f"SELECT *, {ema('g', 1 / 14)} AS ag, {ema('l', 1 / 14)} AS al FROM m"}
    add("i4_rsi", "RSI", {"RSI_14": ("CASE WHEN al=0 THEN 100.0::DOUBLE ELSE 100-100/(1+ag/al) END", 6)}, "m2", gains)
    mac = {"m": f"SELECT *, {ema('close', 2 / 13)} AS a, {ema('close', 2 / 27)} AS z FROM bars", "m2": "SELECT *, a-z AS line FROM m", "m3": f"SELECT *, {ema('line', 2 / 10)} AS sig FROM m2"}
    add(
        "i5_macd",
        "MACD",
        {"EMA_12": ("a", 4), "EMA_26": ("z", 4), "MACD_line": ("line", 4), "MACD_signal": ("sig", 4), "MACD_hist": ("line-sig", 4)},
        "m3",
        mac,
    )
    rng = {"m": "SELECT *, greatest(high-low, abs(high-c1), abs(low-c1)) AS tr FROM r"}
    add("i6_atr", "ATR", {"ATR_14": (ema("tr", 1 / 14), 4)}, "m", rng)
    bb = {"m": f"SELECT *, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM bars"}
    add(
        "i7_bb",
        "BB",
        {"BB_middle": ("mid", 4), "BB_upper": ("mid+2*sd", 4), "BB_lower": ("mid-2*sd", 4), "BB_width": ("4*sd/nullif(mid,0)", 6), "BB_pct": ("(close-(mid-2*sd))/nullif(4*sd,0)", 6)},
        "m",
        bb,
    )
    w = "(PARTITION BY instrument_id ORDER BY date ROWS 89 PRECEDING)"
    reg = {
        "m": "SELECT *, CASE WHEN close>0 THEN ln(close) END AS y, CAST(rn AS DOUBLE) AS k FROM r",
        "m2": f"SELECT *, count(y) OVER {w} AS n, covar_pop(y,k) OVER {w} AS cov, var_pop(y) OVER {w} AS vy FROM m",
        "m3": "SELECT *, CASE WHEN n=90 AND vy>0 THEN cov/(8099/12.0::DOUBLE) END AS slope, CASE WHEN n=90 AND vy>0 THEN cov*cov/(8099/12.0::DOUBLE*vy) END AS r2 "
            "FROM m2",
    }
    score = "(exp(slope*252)-1)*100*r2"
    add("f17_clenow_momentum", "clenow_momentum", {"clenow_momentum_90": (score, 4)}, "m3", reg)
    add("i19_clenow_score", "CLENOW_SCORE", {"CLENOW_SLOPE": ("slope", 8), "CLENOW_R2": ("r2", 6), "CLENOW_SCORE": (score, 4)}, "m3", reg)
    add("i20_clenow_r2", "CLENOW_R2", {"CLENOW_R2": ("r2", 6)}, "m3", reg)
    rs = {"m": "SELECT *, (2*close/" + "+close/".join(f"nullif({lagged('close', n)},0)" for n in (63, 126, 189, 252)) + ")/5 AS x FROM bars"}
    add("i21_rs_rating", "RS_RATING", {"RS_RATING": (f"({rank('x', 'date')})/nullif(count(x) OVER (PARTITION BY date),0)*100", 6)}, "m", rs)
    up = " + ".join(f"{50 - k}*{lagged('close', k)}" for k in range(50))
    rum = {"m": f"SELECT *, {roll('avg', 'close', 3)} - ({up})/1275 AS d FROM bars"}
    add("i22_rumi", "RUMI", {"RUMI_DIFF": ("d", 4), "RUMI": (roll("avg", "d", 30), 4)}, "m", rum)

    def sectored(name: str, registered: str, params: dict, column: str, expression: str, own: dict[str, str]) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _places(factors.FACTORS.find(registered)(b.bars(spark, sf_dir), sectors=b.sectors(spark, sf_dir), **params), {column: 6})

        q[name] = query
        o[name] = _selected({column: (expression, 6)}, "m", own)

    m = {"m": f"SELECT *, (close/nullif({lagged('close', 10)},0)-1)*100 AS x FROM sectored"}
    part = "OVER (PARTITION BY date, sector)"
    sectored("x1_sector_momentum", "sector_momentum", {}, "sector_momentum_10", f"CASE WHEN sector IS NOT NULL THEN avg(x) {part} END", m)
    sectored("x2_sector_relative_strength", "sector_relative_strength", {"aggregation": "median"}, "sector_relative_strength_10", f"x - CASE WHEN sector IS NOT NULL THEN median(x) {part} END", m)
    sectored("x3_rank_within_sector", "rank_within_sector", {}, "rank_within_sector_momentum", f"CASE WHEN sector IS NOT NULL THEN ({rank('x', 'date, sector', True)})/nullif(count(x) {part},0) END", m)
    sectored("x4_demean_by_sector", "demean_by_sector", {"factor_name": "volume_ratio"}, "demean_volume_ratio", f"x - CASE WHEN sector IS NOT NULL THEN avg(x) {part} END", {"m": f"SELECT *, volume/nullif({roll('avg', 'volume', 20)},0) AS x FROM sectored"})

    def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window

        df = factors.momentum(b.bars(spark, sf_dir)).where("date = DATE'2000-03-01' AND momentum IS NOT NULL")
        return df.select("instrument_id", F.round("momentum", 6).alias("value"), F.row_number().over(Window.partitionBy("date").orderBy(F.desc("momentum"), "instrument_id")).alias("rank"))

    q["x5_cross_section"] = cross_section
    o["x5_cross_section"] = b.sql("SELECT instrument_id, round(x,6) AS value, CAST(row_number() OVER (ORDER BY x DESC, instrument_id) AS INTEGER) AS rank FROM m "
        "WHERE date = DATE '2000-03-01' AND x IS NOT NULL", **mom)

    means = ["pe_ttm", "pb", "ps_ttm"]

    def panel(spark: SparkSession, sf_dir: str, *unused: str) -> DataFrame:
        return enrich(b.bars(spark, sf_dir), b.fundamentals(spark, sf_dir), b.valuation(spark, sf_dir).drop(*unused))

    def on_panel(name: str, columns: dict[str, tuple[str, dict, str, int]], source: str = "panel", own: dict[str, str] | None = None) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = panel(spark, sf_dir, *(c for c in means if f"fund_{c}" not in columns))
            for registered, (_, params, _, _) in columns.items():
                df = factors.FACTORS.find(registered)(df, **params)
            return df.select("instrument_id", "date", *(F.round(c, n).alias(c) for c, (_, _, _, n) in columns.items()))

        q[name] = query
        o[name] = _selected({c: (x, n) for c, (_, _, x, n) in columns.items()}, source, own)

    def passed(*names: str) -> dict[str, tuple[str, dict, str, int]]:
        return {n: (n, {}, factors.PASSED[n], 5 if n in ("fund_fcff", "fund_total_revenue") else 6) for n in names}

    on_panel("n1_quality", passed("fund_roe", "fund_roic", "fund_net_margin", "fund_op_margin"))
    on_panel("n2_growth", passed("fund_revenue_yoy", "fund_net_income_yoy"))
    on_panel("n3_revenue_yoy_band", {"fund_revenue_yoy_band": ("", {}, "-abs(revenue_yoy-17.5)", 6)})
    on_panel("n4_leverage", passed("fund_debt_to_assets", "fund_current_ratio", "fund_quick_ratio", "fund_debt_to_eqt"))
    on_panel("n5_cashflow", passed("fund_ocf_to_debt", "fund_ocf_to_shortdebt", "fund_q_ocf_to_sales", "fund_fcff"))
    on_panel("n6_size", passed("fund_total_mv", "fund_circ_mv", "fund_turnover_rate", "fund_total_revenue"))
    on_panel("n7_pe_ttm", {"fund_pe_ttm": ("", {}, "CASE WHEN pe_ttm>0 THEN pe_ttm END", 6)})
    on_panel("n8_pb_ps", {"fund_pb": ("", {}, "CASE WHEN pb>0 THEN pb END", 6), "fund_ps_ttm": ("", {}, "CASE WHEN ps_ttm>0 THEN ps_ttm END", 6)})

    def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
        return factors.quarterly_series(panel(spark, sf_dir, *means)).select("instrument_id", "date", "end_date", F.round("total_revenue", 5).alias("total_revenue"))

    new = {"z": f"SELECT *, coalesce(end_date <> lag(end_date) OVER {S}, true) AS nq FROM panel", "qs": "SELECT * FROM z WHERE nq"}
    q["n9_quarterly_series"] = quarterly
    o["n9_quarterly_series"] = b.sql("SELECT instrument_id, date, end_date, round(total_revenue,5) AS total_revenue FROM qs", **new)

    def shift(source: str, n: int, months: tuple[int, int], mode: str, anchor: int, years: float) -> dict[str, str]:
        at = lambda x, k: f"lag({x},{k}) OVER {S}"
        values = {
            "ratio": "(c-p)/nullif(abs(p),0)",
            "cagr": f"CASE WHEN p>0 AND c/p>0 THEN power(c/p, {1 / years!r})-1 END",
            "diff": "c-p",
        }
        return new | {
            "q1": f"SELECT instrument_id, date, {at(source, anchor)} AS c, {at(source, anchor + n)} AS p, {at('end_date', anchor)} AS ce, {at('end_date', anchor + n)} AS pe "
                f"FROM qs",
            "q2": f"SELECT instrument_id, date, CASE WHEN (year(ce)-year(pe))*12+month(ce)-month(pe) BETWEEN {months[0]} AND {months[1]} THEN {values[mode]} END AS x "
                f"FROM q1",
            "q3": "SELECT b.instrument_id, b.date, q2.x FROM bars b ASOF LEFT JOIN q2 ON b.instrument_id=q2.instrument_id AND b.date>=q2.date",
        }

    for name, registered in (("n11_revenue_qoq", "fund_revenue_qoq"), ("n11_revenue_qoq_prev", "fund_revenue_qoq_prev"), ("n12_net_income_qoq", "fund_net_income_qoq"), ("n12_net_income_qoq_prev", "fund_net_income_qoq_prev"), ("n13_revenue_cagr_3y", "fund_revenue_cagr_3y"), ("n14_roe_trend_4q", "fund_roe_trend_4q")):
        on_panel(name, {registered: ("", {}, "x", 6)}, "q3", shift(*factors.QUARTERLY[registered]))
    return q, o
