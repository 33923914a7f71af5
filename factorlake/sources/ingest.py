"""Reading, shaping and upserting the point-in-time tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.operators.adjust import adjusted

BARS = T.StructType([T.StructField("instrument_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")), T.StructField("volume", T.LongType()), T.StructField("adj_factor", T.DoubleType())])
#: Rows of one file of a stored table, at most.
FILE_ROWS = 5_000_000
#: Buckets of instruments in each year of a stored table, unless its first upsert says otherwise.
BUCKETS = 16
#: Types that may stand for each other.
ALIKE = ({"int", "bigint"}, {"float", "double"}, {"string"}, {"date"})


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; an absent path is an empty table of the schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def select_rows(df: DataFrame, start: str | None = None, end: str | None = None, ids: list[str] | DataFrame | None = None, time: str = "date") -> DataFrame:
    """Rows within inclusive times and of some instruments: a list, or a table to semi join with."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(df.schema[time].dataType))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast(df.schema[time].dataType))
    if isinstance(ids, DataFrame):
        return df.join(ids.select("instrument_id").distinct(), "instrument_id", "left_semi")
    return df.where(F.col("instrument_id").isin(ids)) if ids is not None else df


def load_bars(df: DataFrame, start: str | None = None, end: str | None = None, ids: list[str] | None = None, columns: list[str] | None = None, mode: str = "forward") -> DataFrame:
    """Bars of a range, adjusted by the factors in that range; keys and adj_factor are always kept."""
    out = select_rows(df, start, end, ids)
    if columns is not None:
        out = out.select(*dict.fromkeys(["instrument_id", "date", "adj_factor", *columns]))
    return adjusted(out, mode)


def instrument_ids(df: DataFrame) -> DataFrame:
    return df.select("instrument_id").distinct()


def date_range(df: DataFrame, instrument_id: str | None = None) -> DataFrame:
    """One row: first_date, last_date."""
    df = df.where(F.col("instrument_id") == instrument_id) if instrument_id else df
    return df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def merged(old: DataFrame, new: DataFrame, keys: list[str] | None = None, arrival: list[str] | None = None) -> DataFrame:
    """Old and new rows, the new one where they share a key, and of several new ones the last by the columns of `arrival`.

    Columns of `arrival` order rows as they came and are not kept. Rows that these don't order
    are told apart by their largest values.
    """
    keys, arrival = keys or ["instrument_id", "date"], arrival or []
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    ties = [c for c in new.columns if c not in (*keys, *arrival)]
    w = Window.partitionBy(*keys).orderBy(F.desc("__seq"), *(F.col(c).desc_nulls_last() for c in (*arrival, *ties)))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__seq", *arrival)


def landed(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """Rows of landing files with `arrival`: when their file was written, its name, and their place in it."""
    rows = (spark.readStream if stream else spark.read).schema(schema).parquet(path)
    return rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index").alias("arrival"))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def in_partitions(touched: list[Row]) -> Column:
    """Whether a row is of one of these years and buckets, in a form that prunes folders."""
    years: dict[int, list[int]] = {}
    for r in touched:
        years.setdefault(r["year"], []).append(r["bucket"])
    some = F.lit(False)
    for y, own in years.items():
        some = some | (F.col("year").eqNullSafe(F.lit(y)) & F.col("bucket").isin(own))
    return some


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str] | None = None, replace: bool = False, time: str = "date", arrival: list[str] | None = None, buckets: int = BUCKETS) -> None:
    """Merge rows into a stored table by key, the last to arrive staying; rewrite the touched partitions alone.

    A table lies in folders of a year and a bucket of instruments (a hash of the id; how many
    buckets, the first upsert settles). Only folders that the new rows fall in are read, merged
    and written again; all other files stay as they are. With `replace`, what is stored of the
    same instruments and years goes first, whatever its keys.

    `arrival` are the columns that tell which of two new rows came later; without it the column
    `arrival`, as landed() gives it, where there is one. They are not stored.

    Partitions larger than others are split among tasks, into files of at most FILE_ROWS rows,
    sorted by instrument, so that readers of one skip the rest by statistics. The old files go
    when all new ones are written. Then the summaries of the touched partitions follow.
    """
    arrival = arrival or (["arrival"] if "arrival" in new.columns else [])
    buckets = stored_buckets(spark, path) or buckets
    new = new.withColumns({"year": F.year(time), "bucket": bucket_of(F.col("instrument_id"), buckets)})
    touched = new.select("year", "bucket").distinct().collect()  # as many as there are folders, at most
    if not touched:
        return
    schema = new.drop(*arrival).schema
    old = scan(spark, path, schema).where(in_partitions(touched))
    if replace:
        pairs = ["instrument_id", "year"]
        old = old.join(new.select(*pairs).distinct(), pairs, "left_anti")
    whole = merged(old, new, keys, arrival)
    # Spark stages the new files and swaps the folders at the end of the job: the old ones can be read meanwhile
    out = whole.hint("rebalance", "year", "bucket").sortWithinPartitions("year", "bucket", "instrument_id", time)
    _write_partitions(out.select(*schema.names), path, "year", "bucket")
    summarise(spark, path, schema, touched, time, buckets)


def _write_partitions(df: DataFrame, path: str, *folders: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS).partitionBy(*folders).parquet(path)


#: What is kept of each instrument and of each partition, by year, beside the table's folders.
MARKS = "instrument_id string, n_rows bigint, first_time {0}, last_time {0}, bucket int, year int"
STATE = "n_rows bigint, first_time {0}, last_time {0}, n_instruments bigint, buckets int, bucket int, year int"


def summarise(spark: SparkSession, path: str, schema: T.StructType, touched: list[Row], time: str, buckets: int) -> None:
    """Write the summaries of some partitions anew: rows and times by instrument, and of the partition with the number of its bucket's instruments.

    Only these partitions' rows are read; summaries of the same years' other buckets are carried over.
    An instrument lies in one bucket in all years, so the marks of the touched buckets tell how many they hold.
    """
    kind = schema[time].dataType.simpleString()
    same_years = F.col("year").isin([r["year"] for r in touched]) | F.col("year").isNull()

    def replaced(new: DataFrame, name: str, form: str) -> DataFrame:
        known = T.StructType.fromDDL(form.format(kind))
        others = scan(spark, f"{path}/{name}", known).where(same_years & ~in_partitions(touched))
        _write_partitions(others.unionByName(new).hint("rebalance", "year"), f"{path}/{name}", "year")
        return scan(spark, f"{path}/{name}", known).where(in_partitions(touched))

    rows = scan(spark, path, schema).where(in_partitions(touched))
    marks = rows.groupBy("year", "bucket", "instrument_id").agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    state = replaced(marks, "_marks", MARKS).groupBy("year", "bucket").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )
    every = scan(spark, f"{path}/_marks", T.StructType.fromDDL(MARKS.format(kind))).where(F.col("bucket").isin(sorted({r["bucket"] for r in touched})))
    state = state.join(every.groupBy("bucket").agg(F.countDistinct("instrument_id").alias("n_instruments")), "bucket")
    replaced(state.withColumn("buckets", F.lit(buckets)), "_state", STATE)


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets a stored table has; None where there is no table."""
    first = scan(spark, f"{path}/_state", T.StructType.fromDDL("buckets int")).select("buckets").first()
    return first["buckets"] if first else None


def stored_state(spark: SparkSession, path: str, time_type: str = "date") -> DataFrame:
    """One row: n_rows, first_date, last_date, n_instruments of a stored table, from its summaries alone.

    A bucket never loses an instrument, so the largest number that its years tell is the present one.
    """
    state = scan(spark, f"{path}/_state", T.StructType.fromDDL(STATE.format(time_type)))
    buckets = state.groupBy("bucket").agg(F.sum("n_rows").alias("n_rows"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"), F.max("n_instruments").alias("n"))
    return buckets.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.min("first_time").alias("first_date"), F.max("last_time").alias("last_date"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_instruments")
    )


def stored_marks(spark: SparkSession, path: str, time_type: str = "date") -> DataFrame:
    """instrument_id, hwm: the last time stored of each instrument, from the table's summaries alone."""
    marks = scan(spark, f"{path}/_marks", T.StructType.fromDDL(MARKS.format(time_type)))
    return marks.groupBy("instrument_id").agg(F.max("last_time").alias("hwm"))


def read_partition(spark: SparkSession, path: str, schema: T.StructType, instrument_id: str, year: int | None = None, time: str = "date") -> DataFrame:
    """One instrument's rows of a table that upsert() wrote, of one year or all: years and buckets are pruned as folders, instruments by statistics."""
    layout = [T.StructField("year", T.IntegerType()), T.StructField("bucket", T.IntegerType())]
    rows = scan(spark, path, T.StructType([*(f for f in schema if f.name not in ("year", "bucket")), *layout])).where(F.col("instrument_id") == instrument_id)
    if buckets := stored_buckets(spark, path):
        rows = rows.where(F.col("bucket") == bucket_of(F.lit(instrument_id), buckets))
    return (rows.where(F.col("year") == year) if year is not None else rows).drop("bucket").orderBy(time)


def high_water(stored: DataFrame, time: str = "date") -> DataFrame:
    """instrument_id, hwm: the last time stored of each instrument."""
    return stored.groupBy("instrument_id").agg(F.max(time).alias("hwm"))


def newer(source: DataFrame, marks: DataFrame, time: str = "date") -> DataFrame:
    """Source rows after their instrument's mark; all rows of instruments without one."""
    m = marks.select(F.col("instrument_id").alias("__i"), "hwm")
    return source.join(m, F.col("instrument_id") == F.col("__i"), "left").where(F.col("hwm").isNull() | (F.col(time) > F.col("hwm"))).drop("__i", "hwm")


def start_after(since: str | None, full: bool, stored_end: str | None) -> str:
    """The day after which a whole dataset is read: the day before `since`, else all, else what is stored."""
    from datetime import date, timedelta

    if since:
        return str(date.fromisoformat(since) - timedelta(days=1))
    return "1970-01-01" if full or not stored_end else stored_end


def dataset_state(df: DataFrame) -> DataFrame:
    """One row: n_rows, first_date, last_date, n_instruments."""
    return df.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("instrument_id").alias("n_instruments"))


#: Source columns of the mapped tables.
COLUMN_MAPS = {
    ("CN", "daily"): {"instrument_id": "instrument_id", "trade_date": "date", "ticker": "ticker", "open_price": "open", "high_price": "high", "low_price": "low", "close_price": "close", "volume": "volume", "adj_factor": "adj_factor"},
    ("CN", "components"): {"instrument_id": "instrument_id", "event_date": "date", "event_type": "event", "event_details": "details"},
    ("CN", "sectors"): {"instrument_id": "instrument_id", "assign_date": "date", "sector_code": "sector", "sector_name": "sector_name"},
}
COLUMN_MAPS |= {("US", k[1]): v for k, v in COLUMN_MAPS.items()}


def renamed(df: DataFrame, market: str, dataset: str) -> DataFrame:
    """Source columns under the library's names; dates given as text become dates."""
    if (market, dataset) not in COLUMN_MAPS:
        raise ValueError(f"no column map for {market} {dataset}")
    return dates_from_text(df.select(*(F.col(s).alias(d) for s, d in COLUMN_MAPS[market, dataset].items())))


#: What tells the rows of a mapped table apart.
MAPPED_KEYS = {"daily": ["instrument_id", "date"], "components": ["instrument_id", "date", "event"], "sectors": ["instrument_id", "date"]}


def all_instruments(*tables: DataFrame) -> DataFrame:
    """The instruments of any of the tables, each once."""
    every = tables[0].select("instrument_id")
    for t in tables[1:]:
        every = every.union(t.select("instrument_id"))
    return every.distinct()


def mapped_ingest(spark: SparkSession, source: DataFrame, market: str, dataset: str, path: str, instruments: DataFrame | None = None, since: str | None = None, full: bool = False) -> None:
    """Merge a source table into the stored one: names mapped, some instruments, days after the table's last."""
    rows = renamed(source, market, dataset)
    if instruments is not None:
        rows = rows.join(instruments, "instrument_id", "left_semi")
    end = None if since or full else stored_state(spark, path).first()["last_date"]
    rows = rows.where(F.col("date") > F.lit(start_after(since, full, str(end) if end else None)).cast("date"))
    upsert(spark, rows, path, MAPPED_KEYS[dataset])


def dates_from_text(df: DataFrame, columns: tuple[str, ...] = ("date", "end_date", "period_end", "ann_date")) -> DataFrame:
    """Known date columns of type string as dates; text that is no date is null."""
    for c in columns:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")).cast("date"))
    return df


def id_cn(exchange: str, ticker: str) -> Column:
    """SH or SZ by the exchange, then the ticker; null for other exchanges."""
    e = F.upper(exchange)
    return F.concat(F.when(e.isin("SSE", "SH"), "SH").when(e.isin("SZSE", "SZ"), "SZ"), F.col(ticker))


def id_us(ticker: str) -> Column:
    return F.upper(ticker)


def id_from_code(code: str, keep_suffix: bool = True) -> Column:
    """600519.SH -> SH600519.SH, or SH600519 without the suffix."""
    suffix = F.element_at(F.split(code, r"\."), -1)
    body = F.col(code) if keep_suffix else F.substring_index(code, ".", 1)
    return F.when(suffix.isin("SH", "SZ"), F.concat(suffix, body))


def us_bars(prices: DataFrame, constituents: DataFrame, marks: DataFrame | None = None, indices: tuple[str, ...] = ("SP500", "RUSSELL1000")) -> DataFrame:
    """Price rows of the indices' tickers after their mark, unadjusted."""
    known = constituents.where(F.col("index_id").isin(*indices)).select("ticker").distinct()
    rows = prices.join(known, "ticker", "left_semi").select(id_us("ticker").alias("instrument_id"), "date", "ticker", "open", "high", "low", "close", "volume", F.lit(1.0).alias("adj_factor"))
    return newer(rows, marks) if marks is not None else rows


def cn_bars(prices: DataFrame, stocks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Price rows of stocks on the two exchanges after their mark."""
    own = stocks.select("ticker", id_cn("exchange", "ticker").alias("instrument_id")).where("instrument_id IS NOT NULL")
    rows = prices.drop("instrument_id").join(own, "ticker").select("instrument_id", "date", "ticker", "open", "high", "low", "close", "volume", F.lit(1.0).alias("adj_factor"))
    return newer(rows, marks) if marks is not None else rows


def intraday_bars(prices: DataFrame, marks: DataFrame | None = None, interval: str = "1h", batch: str = "batch") -> DataFrame:
    """Bars of an interval after their mark; of several for one instrument and time the last by `batch` stays."""
    values = ["open", "high", "low", "close", "volume"]
    rows = prices.where(F.col("interval") == interval).select(id_us("ticker").alias("instrument_id"), "datetime", F.to_date("datetime").alias("date"), "ticker", *values, F.col(batch).alias("__batch"))
    rows = newer(rows, marks, "datetime") if marks is not None else rows
    last = Window.partitionBy("instrument_id", "datetime").orderBy(F.desc("__batch"), *(F.desc_nulls_last(c) for c in values))
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__batch")


def index_closes(prices: DataFrame, index: str | None = None) -> DataFrame:
    rows = prices.where(F.col("index_id") == index) if index else prices
    return rows.select(F.col("index_id").alias("instrument_id"), "date", "close")


def listing_events(changes: DataFrame, prices: DataFrame) -> DataFrame:
    """Index changes as events (ADDED: IPO, else DELIST), and an IPO at the first price of tickers never added."""
    known = changes.select(id_us("ticker").alias("instrument_id"), F.col("change_date").alias("date"), F.when(F.col("change_type") == "ADDED", "IPO").otherwise("DELIST").alias("event"))
    added = known.where("event = 'IPO'").select("instrument_id").distinct()
    first = prices.groupBy(id_us("ticker").alias("instrument_id")).agg(F.min("date").alias("date")).join(added, "instrument_id", "left_anti")
    return known.unionByName(first.withColumn("event", F.lit("IPO")))


def full_universe_events(stocks: DataFrame, existing: DataFrame) -> DataFrame:
    """IPO and DELIST by listing dates; what index rows called so before becomes CSI800_ADDED and CSI800_REMOVED."""
    named = F.when(F.col("event") == "IPO", "CSI800_ADDED").when(F.col("event") == "DELIST", "CSI800_REMOVED").otherwise(F.col("event"))
    dates = stocks.select("instrument_id", F.explode(F.array(F.struct(F.col("list_date").alias("date"), F.lit("IPO").alias("event")), F.struct(F.col("delist_date").alias("date"), F.lit("DELIST").alias("event")))).alias("e"))
    return existing.select("instrument_id", "date", named.alias("event")).unionByName(dates.select("instrument_id", "e.*").where("date IS NOT NULL"))


def static_sectors(stocks: DataFrame, sector: str = "gics_sector", since: str = "2000-01-01") -> DataFrame:
    """One assignment per stock, since a fixed day; stocks without a sector go."""
    return stocks.where(F.col(sector).isNotNull()).select("instrument_id", F.lit(since).cast("date").alias("date"), F.col(sector).alias("sector"), F.col(sector).alias("sector_name"))


def us_fundamentals(income: DataFrame, indicators: DataFrame) -> DataFrame:
    """Quarterly rows by announcement day: trailing sum of four diluted earnings, growth against four quarters before."""
    rows = income.where("financial_type BETWEEN 1 AND 4 AND ann_date IS NOT NULL").join(indicators, ["ticker", "period_end"], "left")
    w = Window.partitionBy("ticker").orderBy("period_end")
    four = w.rowsBetween(-3, 0)
    year = lambda x: F.try_divide(F.col(x), F.lag(x, 4).over(w)) - 1
    out = rows.withColumns({
        "instrument_id": id_us("ticker"), "date": F.col("ann_date"),
        "eps_ttm": F.when(F.count("diluted_eps").over(four) == 4, F.sum("diluted_eps").over(four)), "revenue_yoy": year("total_revenue"), "net_income_yoy": year("net_income"),
    })
    return out.drop("ann_date", "financial_type")


def cn_fundamentals(income: DataFrame, indicators: DataFrame) -> DataFrame:
    """Quarterly rows by announcement day; growth comes from the source; codes that give no id go."""
    rows = income.join(indicators.drop("ann_date"), ["ts_code", "end_date"], "left")
    return rows.withColumns({"instrument_id": id_from_code("ts_code"), "date": F.col("ann_date")}).where("instrument_id IS NOT NULL").drop("ts_code", "ann_date")


def cn_valuation(snapshots: DataFrame, start: str, end: str) -> DataFrame:
    """Daily ratios of a range under the library's ids; codes that give no id go."""
    rows = snapshots.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.select(id_from_code("ts_code").alias("instrument_id"), F.col("trade_date").alias("date"), *(c for c in rows.columns if c not in ("ts_code", "trade_date"))).where("instrument_id IS NOT NULL")


def item_list(df: DataFrame, payload: str, fields: dict[str, int]) -> DataFrame:
    """Columns from a JSON {"item_list": [{"field_id": .., "data": ..}]}; items without data don't count."""
    items = F.from_json(payload, "item_list array<struct<field_id int, data double>>")["item_list"]
    pick = lambda k: F.try_element_at(F.filter(items, lambda x: (x["field_id"] == k) & x["data"].isNotNull()), F.lit(1))["data"]
    return df.withColumns({name: pick(k) for name, k in fields.items()}).drop(payload)


def flat_payload(df: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """Double columns from a flat JSON object, renamed; what is absent or no number is null."""
    return df.withColumns({name: F.expr(f"try_cast(get_json_object(`{payload}`, '$.{key}') AS double)") for key, name in fields.items()}).drop(payload)


def with_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Display names of tickers, where known; of several the first in order of letters."""
    return df.join(names.groupBy("ticker").agg(F.min("company_name").alias("company_name")), "ticker", "left")


def problems(schema: T.StructType, wanted: T.StructType = BARS) -> list[str]:
    """Missing columns and types that can't stand for the wanted ones; further columns are fine."""
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    out = []
    for f in wanted:
        want = f.dataType.simpleString()
        if f.name not in kinds:
            out.append(f"missing column {f.name}")
        elif kinds[f.name] != want and not any({kinds[f.name], want} <= group for group in ALIKE):
            out.append(f"column {f.name} is {kinds[f.name]}, not {want}")
    return out


def bad_values(df: DataFrame, wanted: T.StructType = BARS) -> DataFrame:
    """problem, n_bad of every missing or unlike column: all rows for the one, values that no cast turns for the other."""
    kinds = {f.name: f.dataType for f in wanted}
    found = [(p, p.split()[2] if p.startswith("missing") else p.split()[1]) for p in problems(df.schema, wanted)]
    bad = [F.count("*") if p.startswith("missing") else F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull()) for p, c in found]
    rows = F.array(*(F.struct(F.lit(p).alias("problem"), n.alias("n_bad")) for (p, _), n in zip(found, bad, strict=True))) if found else F.array().cast("array<struct<problem: string, n_bad: bigint>>")
    return df.agg(rows.alias("x")).select(F.explode("x").alias("x")).select("x.*")
