"""The library's logical tables made from the driver's star schema, in Spark and as SQL text.

bars, weekly, components, sectors, fundamentals, valuation, benchmark_px, intraday, trades, nav.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instrument(key: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 6, "0"))


def quotient(a: F.Column, b: F.Column) -> F.Column:
    """a / b as the SQL has it: over 0 infinite with the sign of a, and no number for 0 / 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


#: Rows of one task where a table is laid out by instrument; an instrument stays whole.
TASK_ROWS = 250_000


def by_instrument(df: DataFrame, n_rows: int) -> DataFrame:
    """Rows laid out by instrument in as many parts as their number asks for: what windows and groups of instruments hold in a task doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / TASK_ROWS)), "instrument_id")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship lines of a supplier and day as trades of a bar; laid out by instrument, so that windows over instruments shuffle no more."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = read(spark, sf_dir, "lineitem")
    lines = lines.select(instrument("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("date"), "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    rows = by_instrument(lines, lines.count()).groupBy("instrument_id", "date", "l_suppkey").agg(  # counted by the files' footers
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume")
    )
    adj = F.when(F.col("date") < F.lit("1998-01-01").cast("date"), 0.5).otherwise(1.0).alias("adj_factor")
    return rows.select("instrument_id", "date", F.col("instrument_id").alias("ticker"), "open", "high", "low", "close", "volume", adj)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).groupBy("instrument_id", F.date_trunc("week", "date").alias("w"))
    return rows.agg(
        F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    ).drop("w")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    i = instrument("l_suppkey").alias("instrument_id")
    day = lambda text: F.lit(text).cast("date")
    ipo = s.select(i, F.col("lo").alias("date"), F.lit("IPO").alias("event"))
    delist = s.where("l_suppkey % 17 = 0").select(i, F.date_sub("hi", 200).alias("date"), F.lit("DELIST").alias("event"))
    halt = s.where("l_suppkey % 10 = 3").select(i, day("1999-03-01").alias("date"), F.lit("HALT").alias("event"))
    resume = s.where("l_suppkey % 10 = 3").select(i, day("1999-06-01").alias("date"), F.lit("RESUME").alias("event"))
    added = s.where("l_suppkey % 4 = 1").select(i, day("1997-01-02").alias("date"), F.lit("SP500_ADD").alias("event"))
    return ipo.union(delist).union(halt).union(resume).union(added)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = instrument("s_suppkey").alias("instrument_id")
    first = s.select(i, F.lit("1995-01-01").cast("date").alias("date"), F.col("n_name").alias("sector"), F.col("n_name").alias("sector_name"))
    return first.union(s.select(i, F.lit("1998-01-01").cast("date"), F.col("r_name"), F.col("r_name")))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("q")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_revenue"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("cost"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("debt"), F.sum("l_quantity").alias("units"), F.count("*").alias("n"),
    )
    revenue, net, debt, units, n = (F.col(c) for c in ("total_revenue", "net_income", "debt", "units", "n"))
    q = q.select(instrument("l_suppkey").alias("instrument_id"), F.last_day(F.add_months("q", 2)).alias("end_date"), "total_revenue", (revenue - F.col("cost")).alias("net_income"), "debt", "units", "n")
    w = Window.partitionBy("instrument_id").orderBy("end_date")
    year = lambda x: F.try_divide(F.col(x), F.lag(x, 4).over(w)) - 1
    return q.select(
        "instrument_id", F.date_add("end_date", 30).alias("date"), "end_date", "total_revenue", "net_income",
        (quotient(net, revenue) * 100).alias("roe"), quotient(net, revenue + debt).alias("roic"),
        quotient(net, revenue).alias("net_margin"), (1 - quotient(debt, revenue)).alias("op_margin"),
        year("total_revenue").alias("revenue_yoy"), year("net_income").alias("net_income_yoy"),
        quotient(debt, revenue + debt).alias("debt_to_assets"), (units / n).alias("current_ratio"), (units / n / 2).alias("quick_ratio"),
        quotient(debt, net).alias("debt_to_eqt"), quotient(net, debt).alias("ocf_to_debt"), (quotient(net, debt) / 2).alias("ocf_to_shortdebt"),
        (quotient(net, revenue) / 2).alias("q_ocf_to_sales"), (net - debt).alias("fcff"),
        (F.sum("net_income").over(w.rowsBetween(-3, 0)) / 1e6).alias("eps_ttm"),
    )


def valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly values of suppliers. Means are summed row by row in the order of the files: where one is a limit itself, the order decides on which side the sum of doubles falls."""
    key, place = ["l_suppkey", "m"], ["_metadata.file_name", "_metadata.row_index"]
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("m"), "l_extendedprice", "l_quantity", "l_tax", "l_discount", F.struct(*place).alias("place"))
    w = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = lines.withColumns({"t": F.avg("l_tax").over(w), "d": F.avg("l_discount").over(w)}).groupBy(*key).agg(
        F.sum("l_extendedprice").alias("v"), F.sum("l_quantity").alias("u"), F.max_by("t", "place").alias("t"), F.max_by("d", "place").alias("d")
    )
    return m.select(
        instrument("l_suppkey").alias("instrument_id"), F.last_day("m").alias("date"), ((F.col("d") - 0.03) * 1000).alias("pe_ttm"), ((F.col("t") - 0.02) * 100).alias("pb"),
        ((F.col("d") - F.col("t")) * 10).alias("ps_ttm"), (F.col("v") / 1000).alias("total_mv"), (F.col("v") / 2000).alias("circ_mv"), (F.col("u") / 100).alias("turnover_rate"),
    )


def benchmark_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: the mean close of all bars."""
    return bars(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("close"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("instrument_id"), F.date_trunc("hour", "ts").alias("date"))
    return e.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades of fifty books."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("trade_id"), (F.col("o_custkey") % 50).cast("int").alias("book"), F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), instrument_of("o_custkey").alias("instrument_id"),
        (F.col("o_totalprice") / 100).alias("price"), (F.col("o_orderkey") % 90 + 10).cast("bigint").alias("shares"),
    )


def instrument_of(key: str) -> F.Column:
    return F.concat(F.lit("S"), F.lpad((F.col(key) % 10).cast("string"), 6, "0"))


def nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, date, nav: a million, and the running sum of signed order values over twenty."""
    day = trades(spark, sf_dir).groupBy("book", "date").agg(F.sum(F.when(F.col("side") == "BUY", F.col("price")).otherwise(-F.col("price"))).alias("f"))
    w = Window.partitionBy("book").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return day.select("book", "date", (1_000_000 + F.sum("f").over(w) / 20).alias("nav"))


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity"
_ID = "'S'||lpad(CAST({} AS VARCHAR),6,'0')"

#: The same tables as SQL.
CTES = {
    "bars": f"""SELECT {_ID.format('l_suppkey')} AS instrument_id, CAST(l_shipdate AS DATE) AS date, {_ID.format('l_suppkey')} AS ticker,
  first(l_extendedprice/l_quantity ORDER BY {_ORDER}) AS open, max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  last(l_extendedprice/l_quantity ORDER BY {_ORDER}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume,
  CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-01-01' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS adj_factor
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "weekly": """SELECT instrument_id, max(date) AS date, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close,
  CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY instrument_id, date_trunc('week', date)""",
    "spans": "SELECT l_suppkey AS k, " + _ID.format("l_suppkey") + " AS instrument_id, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem GROUP BY l_suppkey",
    "components": """SELECT instrument_id, lo AS date, 'IPO' AS event FROM spans UNION ALL SELECT instrument_id, hi - 200, 'DELIST' FROM spans WHERE k % 17 = 0
  UNION ALL SELECT instrument_id, DATE '1999-03-01', 'HALT' FROM spans WHERE k % 10 = 3 UNION ALL SELECT instrument_id, DATE '1999-06-01', 'RESUME' FROM spans WHERE k % 10 = 3
  UNION ALL SELECT instrument_id, DATE '1997-01-02', 'SP500_ADD' FROM spans WHERE k % 4 = 1""",
    "sectors": f"""SELECT {_ID.format('s_suppkey')} AS instrument_id, DATE '1995-01-01' AS date, n_name AS sector, n_name AS sector_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
  UNION ALL SELECT {_ID.format('s_suppkey')}, DATE '1998-01-01', r_name, r_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "quarters": f"""SELECT {_ID.format('l_suppkey')} AS instrument_id, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH AS DATE) - 1 AS end_date,
  sum(l_extendedprice*(1-l_discount)) AS total_revenue, sum(l_extendedprice*(1-l_discount)) - sum(l_extendedprice*l_tax) AS net_income,
  sum(l_extendedprice*l_discount) AS debt, sum(l_quantity) AS units, count(*) AS n FROM lineitem GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)""",
    "fundamentals": """SELECT instrument_id, end_date + 30 AS date, end_date, total_revenue, net_income, net_income/total_revenue*100 AS roe, net_income/(total_revenue+debt) AS roic,
  net_income/total_revenue AS net_margin, 1-debt/total_revenue AS op_margin, total_revenue/nullif(lag(total_revenue,4) OVER q,0)-1 AS revenue_yoy,
  net_income/nullif(lag(net_income,4) OVER q,0)-1 AS net_income_yoy, debt/(total_revenue+debt) AS debt_to_assets, units/n AS current_ratio, units/n/2 AS quick_ratio,
  debt/net_income AS debt_to_eqt, net_income/debt AS ocf_to_debt, net_income/debt/2 AS ocf_to_shortdebt, net_income/total_revenue/2 AS q_ocf_to_sales, net_income-debt AS fcff,
  sum(net_income) OVER (PARTITION BY instrument_id ORDER BY end_date ROWS 3 PRECEDING)/1e6 AS eps_ttm
  FROM quarters WINDOW q AS (PARTITION BY instrument_id ORDER BY end_date)""",
    "valuation": f"""SELECT {_ID.format('l_suppkey')} AS instrument_id, CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) - 1 AS date, (avg(l_discount)-0.03)*1000 AS pe_ttm,
  (avg(l_tax)-0.02)*100 AS pb, (avg(l_discount)-avg(l_tax))*10 AS ps_ttm, sum(l_extendedprice)/1000 AS total_mv, sum(l_extendedprice)/2000 AS circ_mv, sum(l_quantity)/100 AS turnover_rate
  FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)""",
    "benchmark_px": "SELECT date, avg(close) AS close FROM bars GROUP BY date",
    "intraday": """SELECT event_type AS instrument_id, date_trunc('hour', ts) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "trades": """SELECT o_orderkey AS trade_id, CAST(o_custkey % 50 AS INTEGER) AS book, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
  'S'||lpad(CAST(o_custkey % 10 AS VARCHAR),6,'0') AS instrument_id, o_totalprice/100 AS price, CAST(o_orderkey % 90 + 10 AS BIGINT) AS shares FROM orders""",
    "nav": """SELECT book, date, 1000000 + sum(f) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING)/20 AS nav
  FROM (SELECT book, date, sum(CASE WHEN side='BUY' THEN price ELSE -price END) AS f FROM trades GROUP BY book, date)""",
    "r": """SELECT *, lag(close) OVER s AS c1, close/nullif(lag(close) OVER s,0)-1 AS ret, row_number() OVER s AS rn FROM bars WINDOW s AS (PARTITION BY instrument_id ORDER BY date)""",
    "panel": """SELECT b.*, f.* EXCLUDE (instrument_id, date), v.* EXCLUDE (instrument_id, date) FROM bars b
  ASOF LEFT JOIN fundamentals f ON b.instrument_id=f.instrument_id AND b.date>=f.date ASOF LEFT JOIN valuation v ON b.instrument_id=v.instrument_id AND b.date>=v.date""",
    "sectored": "SELECT b.*, g.sector FROM r b ASOF LEFT JOIN sectors g ON b.instrument_id=g.instrument_id AND b.date>=g.date",
    "halts": """SELECT h.instrument_id, h.date AS halt, (SELECT min(x.date) FROM components x WHERE x.instrument_id=h.instrument_id AND x.event='RESUME' AND x.date>=h.date) AS resume
  FROM components h WHERE h.event='HALT'""",
    "tradable": """SELECT b.instrument_id, b.date FROM bars b WHERE b.instrument_id IN (SELECT instrument_id FROM components)
  AND NOT EXISTS (SELECT 1 FROM halts h WHERE h.instrument_id=b.instrument_id AND b.date>=h.halt AND (h.resume IS NULL OR b.date<h.resume))""",
}


def sql(body: str, **own: str) -> str:
    """`body` after the WITH clause of the tables it names; own: further tables, by name, that come after those."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(CTES[name])
                wanted.append(name)

    for text in (*own.values(), body):
        need(text)
    parts = [f"{n} AS ({CTES[n]})" for n in wanted] + [f"{n} AS ({t})" for n, t in own.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
