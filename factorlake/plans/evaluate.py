"""How good a score is: rank correlation, quantile returns, coverage, walk-forward, portfolio returns."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.functions.series import average_rank, clipped, lead, ratio, standardised
from factorlake.operators.asof import asof
from factorlake.operators.sectors import group_of, with_sector
from factorlake.plans import combo
from factorlake.sources.shared import kept


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """instrument_id, date, fwd_ret: close `horizon` rows later over the close, less 1."""
    return bars.select("instrument_id", "date", (ratio(lead("close", horizon), "close") - 1).alias("fwd_ret"))


def scored_returns(scored: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    both = scored.join(forward_returns(bars, horizon), ["instrument_id", "date"])
    return both.where("combo_score IS NOT NULL AND fwd_ret IS NOT NULL")


def rank_ic(scored: DataFrame, bars: DataFrame, horizon: int = 20) -> DataFrame:
    """date, ic: Pearson correlation of the average ranks of score and forward return; undefined dates go.

    Rounded to 12 places, so that no correlation is 0 and not a trace beside it.
    """
    both = scored_returns(scored, bars, horizon)
    ranks = both.select("date", average_rank("combo_score", "date").alias("a"), average_rank("fwd_ret", "date").alias("b"))
    parts = ranks.groupBy("date").agg(F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return parts.select("date", F.round(F.try_divide("c", F.sqrt(F.col("va") * F.col("vb"))), 12).alias("ic")).where("ic IS NOT NULL")


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: mean, sample deviation, ratio of the two, share of positive dates and their number."""
    s = ic.agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n_dates"))
    return s.select("mean", "std", F.try_divide("mean", "std").alias("ir"), "win_rate", "n_dates")


def quantile_returns(scored: DataFrame, bars: DataFrame, horizon: int = 20, n: int = 5) -> DataFrame:
    """date, bin (0..n-1 by score), mean_ret, n: bins are right-closed at the date's linear quantiles k/n."""
    both = scored_returns(scored, bars, horizon)
    cuts = F.percentile("combo_score", F.array(*(F.lit(k / n) for k in range(1, n)))).over(Window.partitionBy("date"))
    binned = both.withColumn("__cuts", cuts).withColumn("bin", F.size(F.filter("__cuts", lambda c: F.col("combo_score") > c)))
    return binned.groupBy("date", "bin").agg(F.avg("fwd_ret").alias("mean_ret"), F.count("*").alias("n"))


def top_minus_bottom(quantiles: DataFrame, n: int = 5) -> DataFrame:
    """date, spread: the highest bin's mean return less the lowest's, where a date has both."""
    side = lambda k: F.max(F.when(F.col("bin") == k, F.col("mean_ret")))
    return quantiles.groupBy("date").agg((side(n - 1) - side(0)).alias("spread")).where("spread IS NOT NULL")


def coverage(panel: DataFrame, scored: DataFrame, min_stocks: int = 5) -> DataFrame:
    """One row: panel rows, scored rows, their ratio, dates, dates with enough scores that differ, their ratio."""
    p = panel.agg(F.count("*").alias("panel_rows"), F.countDistinct("date").alias("n_dates"))
    by = scored.groupBy("date").agg(F.count("*").alias("n"), F.stddev_samp("combo_score").alias("sd"))
    s = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored_rows"), F.count_if((F.col("n") >= min_stocks) & (F.col("sd") > 0)).alias("valid_dates"))
    both = p.join(s)  # one row each
    return both.select("panel_rows", "scored_rows", ratio("scored_rows", "panel_rows").alias("row_ratio"), "n_dates", "valid_dates", ratio("valid_dates", "n_dates").alias("date_ratio"))


def windows(panel: DataFrame, n: int) -> DataFrame:
    """date, window_id: n contiguous blocks of floor(N / n) dates, the rest in the last; at most N blocks."""
    days = kept(panel.select("date").distinct(), "days")  # a table of dates: the panel is read once for all uses
    total = days.count()
    n = max(1, min(n, total))
    size = max(1, total // n)
    place = F.row_number().over(Window.orderBy("date")) - 1  # one row a date
    return days.select("date", F.least(F.floor(place / size), F.lit(n - 1)).cast("int").alias("window_id"))


def grid(spark: SparkSession, params: dict[str, list], limit: int | None = None, seed: int = 0) -> DataFrame:
    """candidate_id and one column per parameter: all combinations, or `limit` of them in the order of a hash.

    Parameter lists are part of the query's text and the grid is their small product.
    """
    names = list(params)
    rows = list(itertools.product(*params.values()))
    df = spark.createDataFrame(rows, names) if rows else None
    df = df.withColumn("candidate_id", F.concat_ws("|", *names))
    if limit is None or len(rows) <= limit:
        return df
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "candidate_id"))).limit(limit)


def candidate_ics(bars: DataFrame, factor: str, param: str, values: list, horizons: list[int], pct: float = 0.01, wanted: DataFrame | None = None) -> DataFrame:
    """date, candidate (value|horizon), ic of a factor at every value of its parameter, over every horizon.

    The panel is read once and shuffled once by instrument for all factors and forward returns;
    each value is a group of the one scoring, so that all candidates share its shuffle by date.
    `wanted` (candidate) names those to be ranked, all without it.
    """
    df = bars
    for v in values:
        before = df.columns
        df, name = combo.factors.compute(df, factor, **{param: v})
        df = df.select(*before, F.col(name).cast("double").alias(f"__v{v}"))
    df = df.withColumns({f"__h{h}": ratio(lead("close", h), "close") - 1 for h in horizons})
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"__h{h}").alias("fwd_ret")) for h in horizons))
    each = F.explode(F.array(*(F.struct(F.lit(str(v)).alias("v"), F.col(f"__v{v}").alias("f")) for v in values)))
    long = df.select("instrument_id", "date", ahead.alias("__ahead"), each.alias("x")).select("instrument_id", "date", "__ahead", F.col("x.v").alias("_group"), F.col("x.f").alias("__f0"))
    scored = combo.score_rows(long, combo.Spec((combo.Term(factor, params={param: values[0]}),), top_k=1, winsorize_pct=pct), "__ahead")
    both = scored.select("date", "_group", "combo_score", F.explode("__ahead").alias("a")).select("date", F.concat_ws("|", "_group", "a.h").alias("candidate"), "combo_score", "a.fwd_ret").where("fwd_ret IS NOT NULL")
    both = both.join(F.broadcast(wanted), "candidate", "left_semi") if wanted is not None else both
    keys = ("candidate", "date")
    ranks = both.select(*keys, average_rank("combo_score", *keys).alias("a"), average_rank("fwd_ret", *keys).alias("b"))
    parts = ranks.groupBy(*keys).agg(F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return parts.select(*keys, F.round(F.try_divide("c", F.sqrt(F.col("va") * F.col("vb"))), 12).alias("ic")).where("ic IS NOT NULL")


def period_returns(held: DataFrame, bars: DataFrame, cost_rate: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """ordinal, date, gross_ret, turnover, net_ret of equal-weight holdings between rebalances, per keys.

    A holding's return runs from its rebalance date to the next one's close (its last close
    before, if it doesn't trade then). The last rebalance has no next and gives no row. turnover
    is the share of weight that changes hands; net_ret is gross_ret less turnover * cost_rate.
    The holdings are written as a table in the shared folder, so that they are worked out once.
    """
    at = [*keys, "ordinal"]
    held = kept(held.select(*at, "date", "instrument_id", "weight"), "held")  # read three times
    ahead = held.select(*keys, (F.col("ordinal") - 1).alias("ordinal"), F.col("date").alias("until")).distinct()
    # a holding asks for two closes, at its start and at its end: one as-of join answers both
    ends = F.explode(F.array(F.struct(F.col("date"), F.lit(0).alias("end")), F.struct(F.col("until").alias("date"), F.lit(1).alias("end"))))
    asked = held.join(ahead, at).select("instrument_id", *at, "weight", F.col("date").alias("since"), ends.alias("x")).select("instrument_id", *at, "weight", "since", "x.*")
    closes = asof(asked, bars.select("instrument_id", "date", "close"), ["close"])
    pick = lambda k: F.max(F.when(F.col("end") == k, F.col("close")))
    both = closes.groupBy("instrument_id", *at, "since", "weight").agg(pick(0).alias("entry"), pick(1).alias("leave"))
    gross = both.groupBy(*at, F.col("since").alias("date")).agg(F.sum(F.col("weight") * (ratio("leave", "entry") - 1)).alias("gross_ret"))
    # a holding adds its weight at its rebalance and takes it off at the next: what is left of both is what moved
    steps = F.explode(F.array(F.struct(F.col("ordinal"), F.col("weight").alias("w")), F.struct((F.col("ordinal") + 1).alias("ordinal"), (-F.col("weight")).alias("w"))))
    each = held.select(*keys, "instrument_id", steps.alias("x")).select(*keys, "instrument_id", "x.*")
    moved = each.groupBy(*at, "instrument_id").agg(F.sum("w").alias("w")).groupBy(*at).agg((F.sum(F.abs("w")) / 2).alias("turnover"))
    out = gross.join(moved, at)
    return out.select(*at, "date", "gross_ret", "turnover", (F.col("gross_ret") - F.col("turnover") * cost_rate).alias("net_ret"))


def _key(s: combo.Spec) -> str:
    """What makes specs score and rank alike."""
    return repr((s.factors, s.filters, s.group_by, s.overrides, s.winsorize_pct, s.sector_filter))


def _with_filters(df: DataFrame, families: list[tuple[combo.Filter, ...]]) -> DataFrame:
    """df once for each list of filters, as __family and instruments of their own, with the rows that pass it; a null factor fails."""
    df = df.withColumn("__family", F.explode(F.array(*(F.lit(k) for k in range(len(families))))))
    df = df.withColumn("instrument_id", F.concat_ws("|", "__family", "instrument_id"))
    for k, filters in enumerate(families):
        for t in filters:
            before = df.columns
            computed, name = combo.factors.compute(df, t.name, **t.params)
            keep = (F.col("__family") != k) | F.coalesce(combo.OPERATORS[t.op](F.col(name), t.value), F.lit(False))
            df = computed.where(keep).select(*before)
    return df


def ranked_scorings(panel: DataFrame, scorings: dict[str, combo.Spec], sectors: DataFrame | None = None, named: Column | None = None) -> DataFrame:
    """scoring, instrument_id, date, _group, combo_score, rank of every different scoring, ranked among all its candidates.

    `named` gives rows of one instrument different names where factors are to start anew.

    One plan for all: the panel carries each different factor once, as a column, worked out in one
    shuffle by instrument; then each row is exploded into the scorings' terms, by a table of the
    specs that is part of the query's text, and all of them are winsorised, standardised, summed
    and ranked by the same windows. How often the panel is read doesn't depend on how many there
    are; filters, which change the rows a factor sees, multiply rows, once for each list of them.
    """
    families = [s.filters for k, s in enumerate(scorings.values()) if s.filters not in [x.filters for x in list(scorings.values())[:k]]]
    df = panel.withColumn("__id", F.col("instrument_id"))
    with_sectors = sectors is not None and any(s.group_by is not None or s.sector_filter is not None for s in scorings.values())
    df = with_sector(df, sectors) if with_sectors else df.withColumn("sector", F.lit(None).cast("string"))
    df = _with_filters(df.withColumn("instrument_id", named) if named is not None else df, families)
    terms: dict[str, str] = {}
    for s in scorings.values():
        for t in s.factors:
            if (key := repr((t.name, sorted(t.params.items())))) not in terms:
                terms[key] = f"__f{len(terms)}"
                before = df.columns
                computed, name = combo.factors.compute(df, t.name, **t.params)
                df = computed.select(*before, F.col(name).cast("double").alias(terms[key]))
    each = []
    for scoring, s in scorings.items():
        group = group_of(s.group_by, s.overrides, "__id")
        inside = F.coalesce(F.col("sector").isin(*s.sector_filter), F.lit(False)) if s.sector_filter is not None else F.lit(True)
        for k, t in enumerate(s.factors):
            f = F.col(terms[repr((t.name, sorted(t.params.items())))])
            own = F.col("__family") == families.index(s.filters)
            fields = {"scoring": F.lit(scoring), "_group": F.when(own, group), "term": F.lit(k), "of": F.lit(len(s.factors)), "f": f, "weight": F.lit(t.weight if t.direction == "high" else -t.weight).cast("double"), "pct": F.lit(s.winsorize_pct).cast("double"), "inside": inside}
            each.append(F.struct(*(c.alias(n) for n, c in fields.items())))
    long = df.select(F.col("__id").alias("instrument_id"), "date", F.explode(F.filter(F.array(*each), lambda x: x["_group"].isNotNull())).alias("x")).select("instrument_id", "date", "x.*")
    keys = ["scoring", "date", "_group", "term"]
    long = clipped(long, "f", F.col("pct"), keys, "w").withColumn("z", standardised("w", keys) * F.col("weight"))
    row = ["scoring", "date", "_group", "instrument_id"]
    # terms in their order, so that equal scores are equal to the last digit
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("term", "z"))), F.lit(0.0), lambda acc, x: acc + x["z"])
    scored = long.where("f IS NOT NULL AND z IS NOT NULL").groupBy(*row, "of", "inside").agg(total.alias("combo_score"), F.count("*").alias("n")).where("n = of AND inside")
    order = Window.partitionBy("scoring", "date", "_group").orderBy(F.desc("combo_score"), "instrument_id")
    return scored.select(*row, "combo_score", F.row_number().over(order).alias("rank"))


def evaluate_specs(panel: DataFrame, specs: dict[str, combo.Spec], n_windows: int = 4, cost_rate: float = 0.001, sectors: DataFrame | None = None) -> DataFrame:
    """spec, window_id, total_return, sharpe, max_drawdown, n_periods of every spec in every window.

    Factors start anew in each window: instruments are named after their window, so that all
    windows are scored in one pass, and all different scorings in one plan (ranked_scorings()).
    The specs' cuts and rebalance dates are joined on, as a table of the specs (the query's text),
    and all are reduced together.
    """
    spark = panel.sparkSession
    parts = windows(panel, n_windows)
    named = F.concat_ws("|", "window_id", "instrument_id")
    # sectors and overrides go by the instrument itself, so they come before the windows' names
    scorings = {key: s for s in specs.values() for key in [_key(s)]}
    number = {key: str(k) for k, key in enumerate(scorings)}
    ranked = ranked_scorings(panel.join(parts, "date"), {number[k]: s for k, s in scorings.items()}, sectors, named)
    size = F.count("*").over(Window.partitionBy("scoring", "date", "_group"))
    rows = [(n, number[_key(s)], s.top_k, s.top_pct, s.rebalance) for n, s in specs.items()]
    table = spark.createDataFrame(rows, "spec string, scoring string, top_k int, top_pct double, rebalance int")
    cut = F.coalesce("top_k", F.greatest(F.lit(1), F.bround(F.col("__n") * F.col("top_pct"), 0).cast("int")))
    chosen = ranked.withColumn("__n", size).join(F.broadcast(table), "scoring").where(F.col("rank") <= cut)
    place = F.row_number().over(Window.partitionBy("window_id").orderBy("date")) - 1  # one row a date
    paces = F.array(*(F.lit(r) for r in sorted({x.rebalance for x in specs.values()})))
    days = parts.withColumn("__p", place).withColumn("rebalance", F.explode(paces)).where(F.col("__p") % F.col("rebalance") == 0)
    days = days.select("date", "window_id", "rebalance", (F.col("__p") / F.col("rebalance")).cast("int").alias("ordinal"))
    weight = 1.0 / F.count("*").over(Window.partitionBy("spec", "date"))
    held = chosen.join(days, ["date", "rebalance"]).select("spec", "window_id", "rebalance", "ordinal", "date", "instrument_id", weight.alias("weight"))
    keys = ("spec", "window_id", "rebalance")
    out = period_returns(held, panel, cost_rate, keys)
    by = Window.partitionBy("spec", "window_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a portfolio that has lost everything stays at 0
    nav = out.withColumn("nav", F.when(F.min("net_ret").over(by) <= -1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("net_ret") > -1, F.log1p("net_ret"))).over(by))))
    nav = nav.withColumn("dd", 1 - F.col("nav") / F.greatest(F.max("nav").over(by), F.lit(1.0)))
    last = nav.groupBy("spec", "window_id").agg(
        (F.max_by("nav", "ordinal") - 1).alias("total_return"), F.avg("net_ret").alias("m"), F.stddev_samp("net_ret").alias("s"), F.max("dd").alias("max_drawdown"), F.count("*").alias("n_periods"), F.max("rebalance").alias("r")
    )
    return last.select("spec", "window_id", "total_return", (F.try_divide("m", "s") * F.sqrt(252.0 / F.col("r"))).alias("sharpe"), "max_drawdown", "n_periods")


def walk_forward(results: DataFrame) -> DataFrame:
    """spec, mean_sharpe, min_sharpe, max_drawdown, total_return over a spec's windows."""
    return results.groupBy("spec").agg(F.avg("sharpe").alias("mean_sharpe"), F.min("sharpe").alias("min_sharpe"), F.max("max_drawdown").alias("max_drawdown"), F.sum("total_return").alias("total_return"), F.min("total_return").alias("worst_window"))


def accepted(summary: DataFrame, min_sharpe: float = 1.0, max_drawdown: float = 0.20, worst: float = 0.0, top: int = 10) -> DataFrame:
    """The best by mean Sharpe of the specs within the thresholds; by default none with a losing window."""
    ok = (F.col("mean_sharpe") >= min_sharpe) & (F.col("max_drawdown") <= max_drawdown) & (F.col("worst_window") > worst)
    return summary.where(ok).orderBy(F.desc("mean_sharpe"), "spec").limit(top)
