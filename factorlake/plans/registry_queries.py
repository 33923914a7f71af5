"""Queries through the registries, with a factor, an indicator, a screen and a rule added as a user adds one, and a spec from JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions import factors
from factorlake.functions.registry import FACTORS, RULES, SCREENS, Registry
from factorlake.functions.series import ratio
from factorlake.operators import universe as u
from factorlake.plans import bindings as b
from factorlake.plans import combo, risk
from factorlake.plans.combo_queries import CHOSEN, SCORED
from factorlake.plans.ledger_queries import GATE, gated_signals

#: A user's own set of indicators, beside the library's.
INDICATORS = Registry("indicator")
#: As a file of specs holds it; the ranking of the combination queries.
SPEC = json.dumps({
    "factors": [{"name": "momentum", "params": {"period": 20}}, {"name": "volatility", "direction": "low", "weight": 0.5}],
    "top_k": 3, "rebalance": 20, "winsorize_pct": 0.05,
})


@FACTORS("day_width")
def day_width(df: DataFrame) -> DataFrame:
    """High less low over the low."""
    return df.withColumn("day_width", ratio(F.col("high") - F.col("low"), "low"))


@INDICATORS("TYPICAL")
def typical(df: DataFrame) -> DataFrame:
    """Mean of high, low and close."""
    return df.withColumn("TYPICAL", (F.col("high") + F.col("low") + F.col("close")) / 3)


@SCREENS("wide_days")
def wide_days(panel: DataFrame, least: float = 0.5) -> DataFrame:
    """BUY on days whose close is over the typical price and whose width is at least so much."""
    df, width = factors.compute(INDICATORS.find("TYPICAL")(panel), "day_width")
    return df.where((F.col(width) >= least) & (F.col("close") > F.col("TYPICAL"))).select("instrument_id", "date", F.lit("BUY").alias("direction"), "close")


@RULES("small_order")
def small_order(least: float = 1000.0) -> Column:
    """An order under a value, either side."""
    return F.col("price") * F.col("shares") < least


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = combo.parse(json.loads(SPEC))
    bars = b.bars(spark, sf_dir)
    return combo.selected(combo.scores(bars, spec), spec, u.universe(bars, b.components(spark, sf_dir)))


def queries_and_sql() -> tuple[dict, dict]:
    width, mean = "(high-low)/nullif(low,0)", "(high+low+close)/3"
    q = {
        "y1_own_factor": lambda s, d: factors.compute(b.bars(s, d), "day_width")[0].select("instrument_id", "date", F.round("day_width", 6).alias("day_width")),
        "y2_own_indicator": lambda s, d: INDICATORS.find("TYPICAL")(b.bars(s, d)).select("instrument_id", "date", F.col("TYPICAL").cast("float").alias("typical")),
        "y3_own_screen": lambda s, d: SCREENS.find("wide_days")(b.bars(s, d)).select("instrument_id", "date", "direction"),
        "y4_own_rule": lambda s, d: risk.gate(gated_signals(s, d), [("universe", {}), ("small_order", {"least": 5000.0})]).select("instrument_id", "date", "reject_rule"),
        "y5_parsed_spec": lambda s, d: parsed(s, d).select("instrument_id", "date", "rank", F.round("combo_score", 6).alias("combo_score")),
    }
    o = {
        "y1_own_factor": b.sql(f"SELECT instrument_id, date, round({width},6) AS day_width FROM bars"),
        "y2_own_indicator": b.sql(f"SELECT instrument_id, date, CAST({mean} AS FLOAT) AS typical FROM bars"),
        "y3_own_screen": b.sql(f"SELECT instrument_id, date, 'BUY' AS direction FROM bars WHERE {width}>=0.5 AND close>{mean}"),
        "y4_own_rule": b.sql(
            "SELECT instrument_id, date, CASE WHEN NOT in_universe THEN 'universe' WHEN price*shares<5000 THEN 'small_order' END AS reject_rule FROM sg", **GATE
        ),
        "y5_parsed_spec": b.sql("SELECT instrument_id, date, CAST(rank AS INTEGER) AS rank, round(combo_score,6) AS combo_score FROM chosen", **SCORED, **CHOSEN),
    }
    return q, o
