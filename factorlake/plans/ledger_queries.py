"""Queries of net-value, trade, constraint and ingest operators, with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.plans import bindings as b
from factorlake.plans import performance as p
from factorlake.plans import risk, winrate
from factorlake.plans.study_queries import CROSS, rounded
from factorlake.sources import ingest, sinks
from factorlake.sources.shared import discard, kept, new_path
from factorlake.streaming import bars as streams

INITIAL = 1_000_000.0
K = ["book"]
_W = "(PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)"
_O = "(PARTITION BY book ORDER BY date)"
_PREV = "(PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
CURVE = {
    "dr": f"SELECT *, nav/coalesce(lag(nav) OVER {_O}, 1000000)-1 AS daily_return, nav/1000000-1 AS cumulative_return FROM nav",
    "d0": f"SELECT *, greatest(max(nav) OVER {_W},1000000) AS peak, greatest(coalesce(max(nav) OVER {_PREV},1000000),1000000) AS earlier FROM nav",
    "d1": f"SELECT *, last(CASE WHEN nav>earlier THEN date END IGNORE NULLS) OVER {_W} AS peak_date, (peak-nav)/peak AS drawdown FROM d0",
    "dd": "SELECT book, date, nav, peak, peak_date, drawdown, coalesce(date-peak_date,0) AS days_since_peak FROM d1",
    "u0": f"SELECT *, drawdown>0 AS u, lead(date) OVER {_O} AS nx FROM dd",
    "u1": f"SELECT *, CASE WHEN u<>coalesce(lag(u) OVER {_O},false) THEN 1 ELSE 0 END AS e FROM u0",
    "u2": f"SELECT *, sum(e) OVER {_W} AS island FROM u1",
    "l0": f"SELECT *, max(drawdown) OVER {_W} AS worst, coalesce(max(drawdown) OVER {_PREV},0) AS wb, "
        f"sum(CASE WHEN nav>=peak THEN 1 ELSE 0 END) OVER {_W} AS peaks FROM dd",
    "l1": "SELECT *, last(CASE WHEN worst>wb THEN date END IGNORE NULLS) OVER (PARTITION BY book, peaks "
        "ORDER BY date ROWS UNBOUNDED PRECEDING) AS since FROM l0",
}


def _cost_sql(market: str) -> dict[str, str]:
    rate, least, stamp, transfer = p.RATES[market]
    return {
        "cv": "SELECT *, price*shares AS value FROM trades",
        "cc": f"SELECT *, CASE WHEN value>0 THEN greatest(value*{rate!r},{least!r}) ELSE 0 END AS commission, CASE WHEN value>0 AND side='SELL' THEN value*{stamp!r} ELSE 0 END AS stamp, CASE WHEN value>0 THEN value*{transfer!r} ELSE 0 END AS transfer "
            f"FROM cv",
        "ct": "SELECT *, commission+stamp+transfer AS cost FROM cc",
    }


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar as an order of its instrument, with its close as the limit."""
    return b.bars(spark, sf_dir).select("instrument_id", "date", F.when(F.col("volume") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("close").alias("limit_price"))


ORDERS = "SELECT instrument_id, date, CASE WHEN volume%2=0 THEN 'BUY' ELSE 'SELL' END AS side, close AS limit_price FROM bars"


def direction(volume: str) -> Column:
    return F.when(F.col(volume) % 3 == 0, "SELL").otherwise("BUY").alias("direction")


def gated_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as signals against a snapshot made from their own numbers."""
    s = risk.with_market(b.bars(spark, sf_dir).select("instrument_id", "date", F.col("close").alias("price"), F.col("volume").alias("v")), b.bars(spark, sf_dir))
    return s.select(
        "instrument_id", "date", "price", "prev_close", "adv_volume", "volume", direction("v"), F.col("v").alias("shares"),
        (F.col("v") % 5 != 0).alias("in_universe"), F.when(F.col("v") % 11 == 0, 5e4).otherwise(0.0).alias("held_value"), F.lit(1e6).alias("equity"), F.lit(2e5).alias("cash"),
        (F.col("v") % 30).alias("n_positions"), (F.col("v") % 40 / 100.0).alias("sector_weight"), F.lit(0.1).alias("bench_weight"), (F.col("v") % 13 == 0).alias("halted"),
    )


GATE = {
    "mk": "SELECT *, lag(close) OVER (PARTITION BY instrument_id "
        "ORDER BY date) AS prev_close, CASE WHEN count(volume) OVER w=20 THEN avg(volume) OVER w END AS adv_volume "
        "FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date ROWS 19 PRECEDING)",
    "sg": """SELECT instrument_id, date, close AS price, prev_close, adv_volume, volume, CASE WHEN volume%3=0 THEN 'SELL' ELSE 'BUY' END AS direction, volume AS shares, volume%5<>0 AS in_universe,
  CASE WHEN volume%11=0 THEN 5e4 ELSE 0 END AS held_value, 1e6 AS equity, 2e5 AS cash, volume%30 AS n_positions, volume%40/100.0::DOUBLE AS sector_weight, 0.1::DOUBLE AS bench_weight, volume%13=0 AS halted FROM mk""",
}
#: name -> (parameters, SQL of rejection), in the order of the gate.
RULES = {
    "universe": ({}, "NOT in_universe"),
    "duplicate": ({}, "direction='BUY' AND held_value>0"),
    "position_size": ({"pct": 0.12}, "direction='BUY' AND (held_value+price*shares)/equity>0.12"),
    "max_positions": ({"most": 28}, "direction='BUY' AND n_positions>=28"),
    "min_capital": ({"reserve": 90_000.0}, "direction='BUY' AND (cash<price*shares OR cash-price*shares<90000)"),
    "sector_concentration": ({"pct": 0.35}, "direction='BUY' AND sector_weight+price*shares/equity>0.35"),
    "liquidity": ({"min_volume": 5.0, "min_turnover": 10_000.0}, "coalesce(volume<5 OR volume*price<10000, true)"),
    "price_limit": ({"limit": 0.5}, "coalesce(CASE WHEN direction='BUY' THEN price/nullif(prev_close,0)-1>=0.499 ELSE price/nullif(prev_close,0)-1<= -0.499 END,false)"),
    "sector_neutral": ({"deviation": 0.2}, "direction='BUY' AND abs(sector_weight+price*shares/equity-bench_weight)>0.2"),
    "drawdown_halt": ({}, "direction='BUY' AND halted"),
}
_FIRST = "CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, (_, sql) in RULES.items()) + " END"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON, as an item list and as a flat object."""
    e = b.read(spark, sf_dir, "events")
    items = F.concat(F.lit('{"item_list":[{"field_id":1,"data":'), F.col("value").cast("string"), F.lit('},{"field_id":2},{"field_id":3,"data":'), F.col("user_id").cast("string"), F.lit("}]}"))
    return e.select("event_id", items.alias("raw"), F.col("props").alias("flat"))


def queries_and_sql() -> tuple[dict, dict]:
    q, o = {}, {}

    def add(name: str, query, sql: str | None, **own: str) -> None:  # noqa: ANN001
        q[name] = query
        if sql is not None:
            o[name] = b.sql(sql, **own)

    nav = lambda s, d: b.nav(s, d)
    ret = lambda s, d: p.daily_returns(b.nav(s, d), K, INITIAL)
    add(
        "p1_total_return",
        lambda s, d: rounded(p.total_return(nav(s, d), K, INITIAL), "book"),
        "SELECT book, round(t,6) AS total_return, round(CASE WHEN t>-1 THEN power(1+t,252.0::DOUBLE/n)-1 END,6) AS annual_return "
        "FROM (SELECT book, last(nav ORDER BY date)/1000000-1 AS t, count(*) AS n FROM nav GROUP BY book)",
    )
    add(
        "p2_daily_returns",
        lambda s, d: ret(s, d).select("book", "date", F.round("daily_return", 8).alias("daily_return"), F.round("cumulative_return", 8).alias("cumulative_return")),
        "SELECT book, date, round(daily_return,8) AS daily_return, round(cumulative_return,8) AS cumulative_return FROM dr",
        **CURVE,
    )
    add(
        "p3_drawdowns",
        lambda s, d: p.drawdowns(nav(s, d), K, INITIAL).select("book", "date", F.round("drawdown", 8).alias("drawdown"), "peak_date", "days_since_peak"),
        "SELECT book, date, round(drawdown,8) AS drawdown, peak_date, CAST(days_since_peak AS INTEGER) AS days_since_peak FROM dd",
        **CURVE,
    )
    add(
        "p4_max_drawdown",
        lambda s, d: rounded(p.max_drawdown(nav(s, d), K, INITIAL), "book", places=8),
        "SELECT book, round(max(drawdown),8) AS max_drawdown, first(date ORDER BY drawdown DESC, date) AS max_drawdown_date, "
        "round(last(drawdown ORDER BY date),8) AS current_drawdown FROM dd GROUP BY book",
        **CURVE,
    )
    add(
        "p5_underwater",
        lambda s, d: rounded(p.underwater(nav(s, d), K, INITIAL), "book", places=8),
        "SELECT book, min(date) AS start, max(coalesce(nx,date)) AS \"end\", round(max(drawdown),8) AS depth FROM u2 WHERE u GROUP BY book, island",
        **CURVE,
    )
    add(
        "p6_sharpe",
        lambda s, d: rounded(p.sharpe(ret(s, d), K), "book"),
        "SELECT book, round(CASE WHEN count(daily_return)>10 THEN avg(daily_return)*252/nullif(stddev_samp(daily_return)*sqrt(252),0) END,6) AS sharpe "
        "FROM dr GROUP BY book",
        **CURVE,
    )
    add(
        "p6_sharpe_excess",
        lambda s, d: rounded(p.sharpe_excess(ret(s, d), K), "book"),
        "SELECT book, round(CASE WHEN count(*)>10 THEN avg(daily_return-0.03/252)/nullif(stddev_samp(daily_return-0.03/252),0)*sqrt(252) END,6) AS sharpe_excess "
        "FROM dr WHERE daily_return<>0 GROUP BY book",
        **CURVE,
    )
    add(
        "p7_longest_deepening",
        lambda s, d: p.longest_deepening(nav(s, d), K, INITIAL),
        "SELECT book, CAST(coalesce(max(date-since),0) AS INTEGER) AS max_days FROM l1 GROUP BY book",
        **CURVE,
    )
    add(
        "p8_curve_summary",
        lambda s, d: rounded(p.curve_summary(ret(s, d), K), "book", places=5),
        "SELECT book, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(max(nav),5) AS max_nav, "
        "round(min(nav),5) AS min_nav, round(avg(daily_return),5) AS avg_return FROM dr GROUP BY book",
        **CURVE,
    )
    add(
        "p9_compare",
        lambda s, d: p.compare(p.total_return(nav(s, d), K, INITIAL)).select("book", "place"),
        "SELECT book, CAST(row_number() OVER (ORDER BY last(nav ORDER BY date) DESC NULLS LAST, book) AS INTEGER) AS place FROM nav GROUP BY book",
    )
    us = _cost_sql("US")
    f4 = lambda *c: [F.col(x).cast("float").alias(x) for x in c]
    s4 = lambda *c: ", ".join(f"CAST({x} AS FLOAT) AS {x.split('.')[-1]}" for x in c)
    add(
        "p10_trade_summary",
        lambda s, d: p.trade_summary(b.trades(s, d), K).select("book", "n", "n_buy", "n_sell", *f4("sum_value", "avg_value", "max_value", "min_value", "sum_cost")),
        f"SELECT book, n, n_buy, n_sell, {s4('sum_value', 'avg_value', 'max_value', 'min_value', 'sum_cost')} "
        f"FROM (SELECT book, count(*) AS n, count(*) FILTER (side='BUY') AS n_buy, count(*) FILTER (side='SELL') AS n_sell, "
        f"sum(value) AS sum_value, avg(value) AS avg_value, max(value) AS max_value, min(value) AS min_value, sum(cost) AS sum_cost FROM ct "
        f"GROUP BY book)",
        **us,
    )
    add(
        "p11_realised",
        lambda s, d: p.realised(b.trades(s, d), K).select("book", "instrument_id", "n_sells", "winners", "losers", F.round("pnl", 3).alias("pnl")),
        "SELECT s.book, s.instrument_id, count(*) AS n_sells, count(*) FILTER (pnl>0) AS winners, count(*) FILTER (pnl<0) AS losers, "
        "round(sum(pnl),3) AS pnl FROM (SELECT t.book, t.instrument_id, (t.price-coalesce(c.avg_cost,t.price))*t.shares AS pnl "
        "FROM trades t LEFT JOIN buys c ON t.book=c.book AND t.instrument_id=c.instrument_id WHERE t.side='SELL') s GROUP BY 1, 2",
        buys="SELECT book, instrument_id, sum(price*shares)/sum(shares) AS avg_cost FROM trades WHERE side='BUY' GROUP BY 1, 2",
    )
    slip = lambda s, d: b.trades(s, d).where("side = 'SELL'").withColumn("signal_price", F.col("price") * (1 + (F.col("trade_id") % 7 - 3) / 100.0))
    add(
        "p12_slippage",
        lambda s, d: rounded(p.slippage_stats(slip(s, d), K), "book"),
        "SELECT book, round(avg(CASE WHEN x>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS win_rate, round(avg(x) FILTER (x>0),6) AS avg_profit, "
        "round(avg(-x) FILTER (x<0),6) AS avg_loss, round((avg(x) FILTER (x>0))/nullif(avg(-x) FILTER (x<0),0),6) AS profit_ratio "
        "FROM (SELECT book, price/(price*(1+(trade_id%7-3)/100.0::DOUBLE))-1 AS x FROM trades WHERE side='SELL') GROUP BY book",
    )
    for m in ("CN", "US", "HK"):
        add(
            f"p13_costs_{m.lower()}",
            lambda s, d, m=m: p.costs(b.trades(s, d), m).select("trade_id", *f4("commission", "stamp", "transfer", "cost")),
            f"SELECT trade_id, {s4('commission', 'stamp', 'transfer', 'cost')} FROM ct",
            **_cost_sql(m),
        )
    add(
        "p14_fills_open",
        lambda s, d: p.fills(orders(s, d), b.bars(s, d), "open", 5.0).select("instrument_id", "date", "side", "fill_date", F.col("fill_price").cast("float").alias("fill_price"), "status"),
        "SELECT o.instrument_id, o.date, o.side, n.fd AS fill_date, CAST(n.px*CASE WHEN o.side='BUY' THEN 1.0005 ELSE 0.9995 END AS FLOAT) AS fill_price, CASE WHEN n.fd IS NULL THEN 'rejected' ELSE 'filled' END AS status "
        "FROM ord o JOIN nxt n ON o.instrument_id=n.instrument_id AND o.date=n.date",
        ord=ORDERS,
        nxt="SELECT instrument_id, date, lead(date) OVER w AS fd, lead(open) OVER w AS px FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date)",
    )
    add(
        "p14_fills_limit",
        lambda s, d: p.fills(orders(s, d), b.bars(s, d), "limit").groupBy("side", "status").agg(F.count("*").alias("n")),
        "SELECT o.side, CASE WHEN n.fd IS NULL THEN 'rejected' WHEN (o.side='BUY' AND n.lo<=o.limit_price) OR (o.side='SELL' AND n.hi>=o.limit_price) THEN 'filled' ELSE 'unfilled' END AS status, "
        "count(*) AS n FROM ord o JOIN nxt n ON o.instrument_id=n.instrument_id AND o.date=n.date GROUP BY 1, 2",
        ord=ORDERS,
        nxt="SELECT instrument_id, date, lead(date) OVER w AS fd, lead(low) OVER w AS lo, lead(high) OVER w AS hi "
        "FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date)",
    )
    add(
        "p15_positions",
        lambda s, d: p.positions(b.trades(s, d), K).select("trade_id", "shares_after"),
        "SELECT trade_id, CAST(sum(CASE WHEN side='BUY' THEN shares ELSE -shares END) OVER (PARTITION BY book, instrument_id "
        "ORDER BY date, trade_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shares_after FROM trades",
    )
    add(
        "p15_book_value",
        lambda s, d: p.book_value(b.trades(s, d), b.bars(s, d), K, INITIAL).select("book", "date", F.round("cash", 5).alias("cash"), F.col("position_value").cast("float").alias("position_value")),
        "SELECT c.book, c.date, round(c.cash,5) AS cash, CAST(v.pv AS FLOAT) AS position_value FROM cash c JOIN val v ON c.book=v.book AND c.date=v.date",
        fl="SELECT book, date, sum(CASE WHEN side='BUY' THEN -shares*price ELSE shares*price END) AS f FROM trades GROUP BY 1, 2",
        cash=f"SELECT book, date, 1000000+sum(f) OVER {_W} AS cash FROM fl",
        mv="SELECT book, instrument_id, date, sum(CASE WHEN side='BUY' THEN shares ELSE -shares END) AS d FROM trades GROUP BY 1, 2, 3",
        sh="SELECT h.book, h.instrument_id, c.date, sum(coalesce(m.d,0)) OVER (PARTITION BY h.book, h.instrument_id "
            "ORDER BY c.date ROWS UNBOUNDED PRECEDING) AS shares FROM (SELECT DISTINCT book, instrument_id "
            "FROM mv) h JOIN fl c ON h.book=c.book LEFT JOIN mv m ON m.book=h.book AND m.instrument_id=h.instrument_id AND m.date=c.date",
        val="SELECT s.book, s.date, sum(s.shares*coalesce(b.close,0)) AS pv FROM sh s ASOF "
            "LEFT JOIN bars b ON s.instrument_id=b.instrument_id AND s.date>=b.date GROUP BY 1, 2",
    )
    hold = lambda s, d: b.bars(s, d).select("instrument_id", "date", (F.col("close") * F.col("volume")).alias("value"))
    add(
        "p16_sector_weights",
        lambda s, d: rounded(p.sector_weights(hold(s, d), b.sectors(s, d)), "date", "sector"),
        "SELECT date, sector, round(v/nullif(sum(v) OVER (PARTITION BY date),0),6) AS weight "
        "FROM (SELECT date, coalesce(sector,'Unknown') AS sector, sum(close*volume) AS v FROM sectored GROUP BY 1, 2)",
    )
    add(
        "p16_largest_position",
        lambda s, d: rounded(p.largest_position(hold(s, d)), "date"),
        "SELECT date, round(max(close*volume)/nullif(sum(close*volume),0),6) AS largest_pct FROM bars GROUP BY date",
    )

    rules = [(n, params) for n, (params, _) in RULES.items()]
    add(
        "r1_gate",
        lambda s, d: risk.gate(gated_signals(s, d), rules).select("instrument_id", "date", "direction", "reject_rule"),
        f"SELECT instrument_id, date, direction, {_FIRST} AS reject_rule FROM sg",
        **GATE,
    )
    numbers = {"universe": "r2_universe", "duplicate": "r2_duplicate", "position_size": "r3_position_size", "max_positions": "r4_max_positions", "min_capital": "r5_min_capital", "sector_concentration": "r6_sector_concentration", "liquidity": "r7_liquidity", "price_limit": "r8_price_limit", "sector_neutral": "r9_sector_neutral"}
    for rule, name in numbers.items():
        add(
            name,
            lambda s, d, rule=rule: gated_signals(s, d).where(risk.RULES.find(rule)(**RULES[rule][0])).select("instrument_id", "date"),
            f"SELECT instrument_id, date FROM sg WHERE {RULES[rule][1]}",
            **GATE,
        )
    add(
        "r10_drawdown_halt",
        lambda s, d: risk.halts(p.drawdowns(nav(s, d), K, INITIAL), K, 0.01, 0.005).select("book", "date", "halted"),
        f"SELECT book, date, coalesce(last(CASE WHEN drawdown>0.01 THEN true WHEN drawdown<=0.005 THEN false END IGNORE NULLS) OVER {_W},false) AS halted "
        f"FROM dd",
        **CURVE,
    )
    add(
        "r11_gate_stats",
        lambda s, d: rounded(risk.gate_stats(risk.gate(gated_signals(s, d), rules))),
        "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (r IS NOT NULL),0) AS BIGINT) AS rejected, "
        "round(coalesce(sum(n) FILTER (r IS NOT NULL)/CAST(sum(n) AS DOUBLE),0),6) AS rejection_rate, first(r ORDER BY n DESC, "
        "r) FILTER (r IS NOT NULL) AS most_common FROM (SELECT r, count(*) AS n FROM g GROUP BY r)",
        **GATE,
        g=f"SELECT {_FIRST} AS r FROM sg",
    )

    # ingest and sources
    add(
        "s3_load_bars",
        lambda s, d: ingest.load_bars(b.bars(s, d), "1997-06-01", "1998-06-30", ["S000001", "S000002"]).select("instrument_id", "date", F.col("close").cast("float").alias("close"), "adj_factor"),
        "SELECT instrument_id, date, CAST(close*(adj_factor/last(adj_factor) OVER (PARTITION BY instrument_id "
        "ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS FLOAT) AS close, adj_factor FROM bars "
        "WHERE date BETWEEN DATE '1997-06-01' AND DATE '1998-06-30' AND instrument_id IN ('S000001','S000002')",
    )
    add(
        "s5_select_events",
        lambda s, d: ingest.select_rows(b.components(s, d), "1997-01-01", "1999-12-31"),
        "SELECT instrument_id, date, event FROM components WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
    )
    add(
        "s6_select_intraday",
        lambda s, d: ingest.select_rows(b.intraday(s, d), "2024-01-05 00:00:00", "2024-01-06 12:00:00", ["click", "view"]).select("instrument_id", "date", "close", "volume"),
        "SELECT instrument_id, date, close, volume FROM intraday "
        "WHERE date BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00' AND instrument_id IN ('click','view')",
    )
    add("s7_instrument_ids", lambda s, d: ingest.instrument_ids(b.bars(s, d)), "SELECT DISTINCT instrument_id FROM bars")
    add(
        "s8_date_range",
        lambda s, d: ingest.date_range(b.bars(s, d), "S000001"),
        "SELECT min(date) AS first_date, max(date) AS last_date FROM bars WHERE instrument_id='S000001'",
    )

    def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars up to a day, then all from half a year before it with doubled volume, through the stored table."""
        path = new_path(spark, "bars")
        bars = b.bars(spark, sf_dir)
        ingest.upsert(spark, bars.where("date <= DATE'1998-12-31'"), path)
        ingest.upsert(spark, bars.where("date >= DATE'1998-07-01'").withColumn("volume", F.col("volume") * 2), path)
        return spark.read.parquet(path).select("instrument_id", "date", "close", "volume")

    add("s9_upsert", upserted, "SELECT instrument_id, date, close, CASE WHEN date>=DATE '1998-07-01' THEN volume*2 ELSE volume END AS volume FROM bars")

    def landed_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars that land twice, the later part of them again in a second lot, every row followed by another of its key in the same file; all upserted in one batch."""
        landing, path = new_path(spark, "landing"), new_path(spark, "bars")
        bars = b.bars(spark, sf_dir)
        for lot, less in ((bars, 0), (bars.where("date >= DATE'1998-07-01'"), 10)):
            twice = lot.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("volume", F.col("volume") - F.col("k") - less)
            twice.repartition("instrument_id").sortWithinPartitions("instrument_id", "date", "k").drop("k").write.mode("append").parquet(landing)
        ingest.upsert(spark, ingest.landed(spark, landing, ingest.BARS), path)
        return spark.read.parquet(path).select("instrument_id", "date", "close", "volume")

    # what came last has the smallest values: it stays by its arrival alone
    add("s9_keep_last", landed_twice, "SELECT instrument_id, date, close, volume - CASE WHEN date>=DATE '1998-07-01' THEN 11 ELSE 1 END AS volume FROM bars")

    def three_loads(spark: SparkSession, sf_dir: str) -> str:
        """A table after three upserts that overlap; its path."""
        path = new_path(spark, "bars")
        bars = b.bars(spark, sf_dir)
        for some in ("date < DATE'1996-01-01'", "date >= DATE'1995-07-01' AND date < DATE'2000-01-01'", "date >= DATE'1999-11-01'"):
            ingest.upsert(spark, bars.where(some), path)
        return path

    add(
        "s12_stored_state",
        lambda s, d: ingest.stored_state(s, three_loads(s, d)),
        "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT instrument_id) AS n_instruments FROM bars",
    )
    add("s12_stored_marks", lambda s, d: ingest.stored_marks(s, three_loads(s, d)), "SELECT instrument_id, max(date) AS hwm FROM bars GROUP BY instrument_id")

    def stored_bars(spark: SparkSession, sf_dir: str) -> str:
        """The bars as a stored table; its path."""
        path = new_path(spark, "bars")
        ingest.upsert(spark, b.bars(spark, sf_dir), path, replace=True)
        return path

    add(
        "s2_scan_instrument",
        lambda s, d: ingest.read_partition(s, stored_bars(s, d), ingest.BARS, "S000003").select("instrument_id", "date", "close", "volume", "year"),
        "SELECT instrument_id, date, close, volume, CAST(year(date) AS INTEGER) AS year FROM bars WHERE instrument_id='S000003'",
    )
    add(
        "s10_read_partition",
        lambda s, d: ingest.read_partition(s, stored_bars(s, d), ingest.BARS, "S000004", 1998).select("instrument_id", "date", "close"),
        "SELECT instrument_id, date, close FROM bars WHERE instrument_id='S000004' AND year(date)=1998",
    )
    half = lambda df: df.where("date <= DATE'1999-06-30' AND instrument_id <> 'S000003'")
    add(
        "s11_newer",
        lambda s, d: ingest.newer(b.bars(s, d), ingest.high_water(half(b.bars(s, d)))).select("instrument_id", "date"),
        "SELECT b.instrument_id, b.date FROM bars b LEFT JOIN (SELECT instrument_id, max(date) AS h FROM bars "
        "WHERE date<=DATE '1999-06-30' AND instrument_id<>'S000003' GROUP BY 1) m ON b.instrument_id=m.instrument_id "
        "WHERE h IS NULL OR b.date>h",
    )
    add(
        "s12_dataset_state",
        lambda s, d: ingest.dataset_state(b.bars(s, d)),
        "SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT instrument_id) AS n_instruments FROM bars",
    )
    add("s12_last_dates", lambda s, d: ingest.high_water(b.bars(s, d)), "SELECT instrument_id, max(date) AS hwm FROM bars GROUP BY instrument_id")
    raw = lambda s, d: b.components(s, d).select("instrument_id", F.date_format("date", "yyyy-MM-dd").alias("event_date"), F.col("event").alias("event_type"), F.lit("x").alias("event_details"))
    add("s13_renamed", lambda s, d: ingest.renamed(raw(s, d), "US", "components"), "SELECT instrument_id, date, event, 'x' AS details FROM components")
    codes = lambda s, d: b.read(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "sse").when(F.col("s_suppkey") % 3 == 1, "SZ").otherwise("HKEX").alias("exchange"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ticker"), F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit(".SH")).alias("code"))
    add(
        "s15_instrument_ids",
        lambda s, d: codes(s, d).select("s_suppkey", ingest.id_cn("exchange", "ticker").alias("cn"), ingest.id_us("exchange").alias("us"), ingest.id_from_code("code").alias("from_code"), ingest.id_from_code("code", False).alias("bare")),
        "SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' END || lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS cn, CASE s_suppkey%3 WHEN 0 THEN 'SSE' WHEN 1 THEN 'SZ' ELSE 'HKEX' END AS us, 'SH'||lpad(CAST(s_suppkey AS VARCHAR),6,'0')||'.SH' AS from_code, 'SH'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS bare "
        "FROM supplier",
    )
    members = lambda s, d: b.read(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("ticker"), F.when(F.col("s_suppkey") % 2 == 0, "SP500").otherwise("OTHER").alias("index_id"))
    prices = lambda s, d: b.bars(s, d).withColumn("ticker", F.lower("ticker"))
    add(
        "s16_us_bars",
        lambda s, d: ingest.us_bars(prices(s, d), members(s, d)).select("instrument_id", "date", "close", "adj_factor"),
        "SELECT instrument_id, date, close, 1.0::DOUBLE AS adj_factor FROM bars WHERE CAST(substr(instrument_id,2) AS INTEGER)%6=0",
    )
    stocks = lambda s, d: codes(s, d).withColumn("ticker", b.instrument("s_suppkey"))
    add(
        "s17_cn_bars",
        lambda s, d: ingest.cn_bars(b.bars(s, d), stocks(s, d)).select("instrument_id", "date", "close"),
        "SELECT CASE CAST(substr(instrument_id,2) AS INTEGER)%3 WHEN 0 THEN 'SH' ELSE 'SZ' END||instrument_id AS instrument_id, date, "
        "close FROM bars WHERE CAST(substr(instrument_id,2) AS INTEGER)%3<>2",
    )

    def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Hourly bars, those of clicks in a second batch with higher closes as well, and the same as 5-minute bars."""
        one = b.intraday(spark, sf_dir).select(
            F.col("instrument_id").alias("ticker"), F.lit("1h").alias("interval"), F.col("date").alias("datetime"), "open", "high", "low", "close", "volume", F.lit(1).alias("batch")
        )
        again = one.where("ticker = 'click'").withColumns({"close": F.col("close") + 1, "batch": F.lit(2)})
        return one.unionByName(again).unionByName(one.withColumns({"interval": F.lit("5m"), "batch": F.lit(3)}))

    add(
        "s18_intraday",
        lambda s, d: ingest.intraday_bars(hours(s, d)).select("instrument_id", "datetime", "date", "close"),
        """SELECT upper(instrument_id) AS instrument_id, date AS datetime, CAST(date AS DATE) AS date,
        CASE WHEN instrument_id='click' THEN close+1 ELSE close END AS close FROM intraday""",
    )
    add(
        "s19_index_closes",
        lambda s, d: ingest.index_closes(b.benchmark_px(s, d).withColumn("index_id", F.lit("ALL"))).select("instrument_id", "date", F.col("close").cast("float").alias("close")),
        "SELECT 'ALL' AS instrument_id, date, CAST(close AS FLOAT) AS close FROM benchmark_px",
    )
    changes = lambda s, d: b.components(s, d).where("event IN ('SP500_ADD', 'DELIST')").select(F.col("instrument_id").alias("ticker"), F.col("date").alias("change_date"), F.when(F.col("event") == "DELIST", "REMOVED").otherwise("ADDED").alias("change_type"))
    add(
        "s20_listing_events",
        lambda s, d: ingest.listing_events(changes(s, d), b.bars(s, d)).select("instrument_id", "date", "event"),
        "SELECT instrument_id, date, CASE event WHEN 'DELIST' THEN 'DELIST' ELSE 'IPO' END AS event FROM components "
        "WHERE event IN ('SP500_ADD','DELIST') UNION ALL SELECT instrument_id, min(date), 'IPO' FROM bars "
        "WHERE instrument_id NOT IN (SELECT instrument_id FROM components WHERE event='SP500_ADD') GROUP BY instrument_id",
    )
    dated = lambda s, d: b.components(s, d).groupBy("instrument_id").agg(F.max(F.when(F.col("event") == "IPO", F.col("date"))).alias("list_date"), F.max(F.when(F.col("event") == "DELIST", F.col("date"))).alias("delist_date"))
    add(
        "s21_full_universe",
        lambda s, d: ingest.full_universe_events(dated(s, d), b.components(s, d)),
        "SELECT instrument_id, date, CASE event WHEN 'IPO' THEN 'CSI800_ADDED' WHEN 'DELIST' THEN 'CSI800_REMOVED' ELSE event END AS event "
        "FROM components UNION ALL SELECT instrument_id, date, event FROM components WHERE event IN ('IPO','DELIST')",
    )
    add(
        "s22_static_sectors",
        lambda s, d: ingest.static_sectors(b.sectors(s, d).where("date = DATE'1995-01-01'").withColumn("gics_sector", F.when(F.col("sector") != "NATION_3", F.col("sector")))),
        "SELECT instrument_id, DATE '2000-01-01' AS date, sector, sector AS sector_name FROM sectors WHERE date=DATE '1995-01-01' AND sector<>'NATION_3'",
    )
    income = lambda s, d: b.fundamentals(s, d).select(F.col("instrument_id").alias("ticker"), F.col("end_date").alias("period_end"), F.col("date").alias("ann_date"), (F.month("end_date") / 3).cast("int").alias("financial_type"), "total_revenue", "net_income", (F.col("net_income") / 1e6).alias("diluted_eps"))
    extra = lambda s, d: b.fundamentals(s, d).select(F.col("instrument_id").alias("ticker"), F.col("end_date").alias("period_end"), "roe").where("month(end_date) <> 6")
    add(
        "s24_us_fundamentals",
        lambda s, d: rounded(ingest.us_fundamentals(income(s, d), extra(s, d)).select("instrument_id", "date", "eps_ttm", "revenue_yoy", "net_income_yoy", "roe"), "instrument_id", "date"),
        "SELECT instrument_id, date, round(CASE WHEN count(net_income) OVER w=4 THEN sum(net_income/1e6) OVER w END,6) AS eps_ttm, "
        "round(revenue_yoy,6) AS revenue_yoy, round(net_income_yoy,6) AS net_income_yoy, "
        "round(CASE WHEN month(end_date)<>6 THEN roe END,6) AS roe "
        "FROM fundamentals WINDOW w AS (PARTITION BY instrument_id ORDER BY end_date ROWS 3 PRECEDING)",
    )
    cn = lambda s, d: b.fundamentals(s, d).select(F.concat(F.substring("instrument_id", 2, 6), F.when(F.col("instrument_id") == "S000001", ".XX").otherwise(".SZ")).alias("ts_code"), "end_date", F.col("date").alias("ann_date"), "total_revenue", "roe")
    add(
        "s25_cn_fundamentals",
        lambda s, d: rounded(ingest.cn_fundamentals(cn(s, d).drop("roe"), cn(s, d).drop("total_revenue")).select("instrument_id", "date", "end_date", "roe"), "instrument_id", "date"),
        "SELECT 'SZ'||substr(instrument_id,2)||'.SZ' AS instrument_id, date, end_date, round(roe,6) AS roe FROM fundamentals WHERE instrument_id<>'S000001'",
    )
    add(
        "s27_item_list",
        lambda s, d: ingest.item_list(payloads(s, d).drop("flat"), "raw", {"value": 1, "absent": 2, "user": 3}),
        "SELECT event_id, value, CAST(NULL AS DOUBLE) AS absent, CAST(user_id AS DOUBLE) AS user FROM events".replace(" AS user", ' AS "user"'),
    )
    add(
        "s28_flat_payload",
        lambda s, d: ingest.flat_payload(payloads(s, d).drop("raw"), "flat", {"k": "k", "z": "z"}),
        "SELECT event_id, TRY_CAST(json_extract_string(props,'$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS z FROM events",
    )
    stored = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    add(
        "s1_scan",
        lambda s, d: ingest.scan(s, f"{d}/orders.parquet", stored).unionByName(ingest.scan(s, f"{d}/no_such_table", stored)),
        "SELECT o_orderkey, o_totalprice FROM orders",
    )
    add(
        "s4_bars_for_instrument",
        lambda s, d: ingest.load_bars(b.bars(s, d), ids=["S000002"], columns=["close", "volume"]).select("instrument_id", "date", "close", "volume"),
        "SELECT instrument_id, date, close, volume FROM bars WHERE instrument_id='S000002'",
    )
    add(
        "s14_dates_from_text",
        lambda s, d: ingest.dates_from_text(b.bars(s, d).select("instrument_id", F.when(F.col("volume") % 9 == 0, "n/a").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), "close")),
        "SELECT instrument_id, CASE WHEN volume%9<>0 THEN date END AS date, close FROM bars",
    )
    source = lambda s, d: b.bars(s, d).select("instrument_id", F.date_format("date", "yyyy-MM-dd").alias("trade_date"), "ticker", F.col("open").alias("open_price"), F.col("high").alias("high_price"), F.col("low").alias("low_price"), F.col("close").alias("close_price"), "volume", "adj_factor")

    def ingested(dataset: str, source, columns: list[str]):  # noqa: ANN001, ANN202
        """A first run up to a day, then one after the stored table's last day, of the instruments that bars or listing events name."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            path, rows = new_path(spark, dataset), source(spark, sf_dir)
            day = F.col({"daily": "trade_date", "components": "event_date", "sectors": "assign_date"}[dataset])
            known = ingest.all_instruments(b.bars(spark, sf_dir).where("instrument_id <> 'S000007'"), b.components(spark, sf_dir).where("event = 'SP500_ADD'"))
            ingest.mapped_ingest(spark, rows.where(day <= "1997-06-30"), "CN", dataset, path, known)
            ingest.mapped_ingest(spark, rows, "CN", dataset, path, known)
            return spark.read.parquet(path).select(*columns)

        return run

    known = "instrument_id IN (SELECT instrument_id FROM bars WHERE instrument_id<>'S000007' UNION SELECT instrument_id FROM components WHERE event='SP500_ADD')"
    assigned = lambda s, d: b.sectors(s, d).select("instrument_id", F.date_format("date", "yyyy-MM-dd").alias("assign_date"), F.col("sector").alias("sector_code"), "sector_name")
    add(
        "s23_mapped_ingest",
        ingested("daily", source, ["instrument_id", "date", "close", "volume"]),
        f"SELECT instrument_id, date, close, volume FROM bars WHERE {known}",
    )
    add("s23_components", ingested("components", raw, ["instrument_id", "date", "event"]), f"SELECT instrument_id, date, event FROM components WHERE {known}")
    add("s23_sectors", ingested("sectors", assigned, ["instrument_id", "date", "sector"]), f"SELECT instrument_id, date, sector FROM sectors WHERE {known}")
    add(
        "s23_since",
        lambda s, d: ingest.renamed(source(s, d), "CN", "daily").where(F.col("date") > F.lit(ingest.start_after("1999-07-01", False, None)).cast("date")).select("instrument_id", "date", "close"),
        "SELECT instrument_id, date, close FROM bars WHERE date > DATE '1999-06-30'",
    )

    def unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars without a factor, with text for volumes and longs for dates."""
        text = F.when(F.col("volume") % 5 == 0, "n/a").otherwise(F.col("volume").cast("string"))
        return b.bars(spark, sf_dir).drop("adj_factor").withColumns({"volume": text, "open": F.col("open").cast("float"), "date": F.date_format("date", "yyyy-MM-dd")})

    add(
        "s29_schema_problems",
        lambda s, d: ingest.bad_values(unlike(s, d)),
        """SELECT 'missing column adj_factor' AS problem, count(*) AS n_bad FROM bars UNION ALL SELECT 'column date is string, not date', 0
        UNION ALL SELECT 'column volume is string, not bigint', count(*) FILTER (volume%5=0) FROM bars""",
    )
    daily_value = lambda s, d: b.valuation(s, d).select(F.concat(F.substring("instrument_id", 2, 6), F.lit(".SZ")).alias("ts_code"), F.col("date").alias("trade_date"), "pe_ttm", "pb")
    add(
        "s26_cn_valuation",
        lambda s, d: rounded(ingest.cn_valuation(daily_value(s, d), "1996-01-01", "1997-12-31"), "instrument_id", "date"),
        "SELECT 'SZ'||substr(instrument_id,2)||'.SZ' AS instrument_id, date, round(pe_ttm,6) AS pe_ttm, round(pb,6) AS pb FROM valuation "
        "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'",
    )

    def results(spark: SparkSession, sf_dir: str) -> Iterator[tuple[str, DataFrame]]:
        """Signals (the largest step first, while little else is kept), trades, a curve and a comparison, each with a key and a value; worked out once and kept until the next is asked for."""
        key = lambda *c: F.concat_ws("|", *(F.col(x).cast("string") for x in c)).alias("key")
        nav = kept(b.nav(spark, sf_dir), "nav")
        signals = b.bars(spark, sf_dir).select("instrument_id", "date", F.col("close").alias("price"), direction("volume"))  # the gate's market columns aren't saved: bars are read once
        found = {
            "signals": signals.select(key("instrument_id", "date", "direction"), F.col("price").alias("value")),
            "trades": b.trades(spark, sf_dir).select(key("trade_id", "date", "side"), F.round("price", 4).alias("value")),
            "curve": nav.select(key("book", "date"), F.round("nav", 6).alias("value")),
            "comparison": p.compare(p.total_return(nav, K, INITIAL)).select(key("book"), F.col("place").cast("double").alias("value")),
        }
        for name, df in found.items():
            table = kept(df, name)
            yield name, table
            discard(table)
        discard(nav)

    def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All results through compressed CSV, JSON and Markdown files and back."""
        out = []
        for name, df in results(spark, sf_dir):
            for kind in ("csv", "json", "markdown"):
                path = new_path(spark, name)
                sinks.write(df, path, kind, "gzip")
                if kind == "markdown":
                    cells = F.split(F.col("value"), r" \| ")
                    lines = spark.read.text(path).where("value LIKE '| %' AND value <> '| key | value |' AND value NOT LIKE '| ---%'")
                    one = lines.select(F.substr(cells[0], F.lit(3)).alias("key"), F.rtrim(F.replace(cells[1], F.lit("|"))).cast("double").alias("value"))
                else:
                    reader = spark.read.option("header", True) if kind == "csv" else spark.read
                    one = reader.format(kind).schema(df.schema).load(path)
                out.append(one.withColumns({"result": F.lit(name), "sink": F.lit(kind)}))
        return functools.reduce(DataFrame.unionByName, out)

    add(
        "s30_sinks",
        round_trip,
        "SELECT key, value, result, sink FROM res, (SELECT unnest(['csv','json','markdown']) AS sink)",
        **GATE,
        res="""SELECT trade_id||'|'||date||'|'||side AS key, round(price,4) AS value, 'trades' AS result FROM trades
        UNION ALL SELECT instrument_id||'|'||date||'|'||direction, price, 'signals' FROM sg UNION ALL SELECT book||'|'||date, round(nav,6), 'curve' FROM nav
        UNION ALL SELECT CAST(book AS VARCHAR), CAST(row_number() OVER (ORDER BY last(nav ORDER BY date) DESC NULLS LAST, book) AS DOUBLE), 'comparison' FROM nav GROUP BY book""",
    )
    add(
        "s31_names",
        lambda s, d: ingest.with_names(b.read(s, d, "supplier").select(b.instrument("s_suppkey").alias("ticker")), b.read(s, d, "supplier").where("s_suppkey % 2 = 0").select(b.instrument("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"))),
        "SELECT 'S'||lpad(CAST(s_suppkey AS VARCHAR),6,'0') AS ticker, CASE WHEN s_suppkey%2=0 THEN s_name END AS company_name FROM supplier",
    )

    def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Bars that land in two lots, the second with late rows of the first's years, through the upserting stream."""
        landing, path, marks = (new_path(spark, x) for x in ("landing", "bars", "marks"))
        bars = b.bars(spark, sf_dir)
        for lot in (bars.where("date <= DATE'1998-12-31'"), bars.where("date >= DATE'1998-10-01'").withColumn("volume", F.col("volume") + 1)):
            lot.write.mode("append").parquet(landing)
            streams.upsert_stream(spark, landing, path, marks).awaitTermination()
        return spark.read.parquet(path).select("instrument_id", "date", "close", "volume")

    add("v1_upsert_stream", streamed, "SELECT instrument_id, date, close, CASE WHEN date>=DATE '1998-10-01' THEN volume+1 ELSE volume END AS volume FROM bars")
    ticks = lambda s, d: b.read(s, d, "events").select(F.col("event_type").alias("instrument_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))
    add("v2_hourly_bars", lambda s, d: streams.hourly_bars(ticks(s, d)), "SELECT instrument_id, date AS datetime, open, high, low, close, volume FROM intraday")

    def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Hourly bars of ticks that land in lots of six days, each taken by a run of its own that goes on from the checkpoint.

        A third of a lot's last six hours comes with the next lot, within the tolerance; an eleventh
        of the first two lots comes three lots late, beyond it.
        """
        landing, path, marks = (new_path(spark, x) for x in ("ticks", "hours", "marks"))
        day = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
        lot = F.floor(day / 518_400)
        held = F.when((F.col("seq") % 11 == 3) & (lot < 2), 3).when((F.col("seq") % 3 == 0) & (day % 518_400 >= 496_800), 1).otherwise(0)
        dealt = kept(ticks(spark, sf_dir).select("instrument_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "price", (lot + held).alias("lot")), "lots")
        for k in range(5):
            dealt.where(F.col("lot") == k).drop("lot").write.mode("append").parquet(landing)
            streams.bars_stream(spark, landing, path, marks, late="12 hours").awaitTermination()
        return spark.read.parquet(path).select("instrument_id", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "open", "high", "low", "close", "volume")

    STREAM = {
        "tk": """SELECT event_type AS instrument_id, ts, event_id AS seq, value AS price, date_trunc('hour', ts) AS date, (epoch_ms(ts)//1000 - epoch_ms(TIMESTAMP '2024-01-01')//1000) AS s FROM events""",
        "tl": """SELECT *, s//518400 + CASE WHEN seq%11=3 AND s//518400<2 THEN 3 WHEN seq%3=0 AND s%518400>=496800 THEN 1 ELSE 0 END AS lot FROM tk""",
        "tw": "SELECT lot, max(max(ts)) OVER (ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(max(ts)) OVER (ORDER BY lot ROWS UNBOUNDED PRECEDING) AS now FROM tl WHERE lot<5 GROUP BY lot",
        "tc": "SELECT tl.* FROM tl JOIN tw ON tl.lot=tw.lot WHERE (seen IS NULL OR date + INTERVAL 1 HOUR > seen - INTERVAL 12 HOUR)",
        "sb": """SELECT instrument_id, date, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*) AS volume
          FROM tc WHERE date + INTERVAL 1 HOUR <= (SELECT max(now) FROM tw) - INTERVAL 12 HOUR GROUP BY instrument_id, date""",
    }
    add("v2_stream_bars", streamed_bars, "SELECT instrument_id, date AS datetime, open, high, low, close, volume FROM sb", **STREAM)
    add(
        "v2_stream_cross",
        lambda s, d: rounded(winrate.ema_cross(streamed_bars(s, d).withColumnRenamed("datetime", "date")), "instrument_id", "date"),
        "SELECT instrument_id, date, round(close,6) AS close, round(ema_s,6) AS ema_s, round(ema_l,6) AS ema_l, signal FROM cross_",
        **STREAM,
        **{k: CROSS[k].replace("FROM intraday", "FROM sb") for k in ("k0", "k1", "k2", "cross_")},
    )
    return q, o
