"""Declarative factor combinations: filter, winsorise, standardise, weigh, select."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions import factors
from factorlake.functions.registry import FACTORS
from factorlake.functions.series import clipped, standardised
from factorlake.operators.sectors import grouped, with_sector
from factorlake.sources.shared import kept

OPERATORS = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


@dataclass(frozen=True)
class Term:
    name: str
    direction: str = "high"
    weight: float = 1.0
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        FACTORS.find(self.name)
        if self.direction not in ("high", "low"):
            raise ValueError("direction is high or low")


@dataclass(frozen=True)
class Filter:
    name: str
    op: str
    value: float
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        FACTORS.find(self.name)
        if self.op not in OPERATORS:
            raise ValueError(f"op is one of {', '.join(OPERATORS)}")


@dataclass(frozen=True)
class Spec:
    """What to rank by, and how many to hold: one of top_k and top_pct."""

    factors: tuple[Term, ...]
    top_k: int | None = None
    top_pct: float | None = None
    rebalance: int = 1
    filters: tuple[Filter, ...] = ()
    group_by: dict | None = None
    overrides: dict | None = None
    sector_filter: tuple[str, ...] | None = None
    winsorize_pct: float = 0.01

    def __post_init__(self) -> None:
        if not self.factors:
            raise ValueError("a spec needs a factor")
        if (self.top_k is None) == (self.top_pct is None):
            raise ValueError("give one of top_k and top_pct")
        if self.rebalance < 1 or (self.top_k is not None and self.top_k < 1) or (self.top_pct is not None and not 0 < self.top_pct <= 1):
            raise ValueError("top_k and rebalance are at least 1, top_pct is in (0, 1]")


def parse(raw: dict, evaluation: bool = False) -> Spec:
    """A spec from its JSON object; `evaluation` reads only what scoring needs and ignores the rest."""
    own = {k: raw[k] for k in ("group_by", "winsorize_pct") if raw.get(k) is not None}
    own |= {"factors": tuple(Term(**t) for t in raw.get("factors", ())), "filters": tuple(Filter(**t) for t in raw.get("filters", ()))}
    if evaluation:
        return Spec(top_k=1, **own)
    own |= {k: raw[k] for k in ("top_k", "top_pct", "rebalance", "overrides") if raw.get(k) is not None}
    return Spec(**own, sector_filter=tuple(raw["sector_filter"]) if raw.get("sector_filter") else None)


def filtered(panel: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    """Rows that pass every threshold; a null factor fails. Each filter sees the rows that those before it left."""
    for t in filters:
        df, name = factors.compute(panel, t.name, **t.params)
        panel = df.where(OPERATORS[t.op](F.col(name), t.value)).select(*panel.columns)
    return panel


def scores(panel: DataFrame, spec: Spec, sectors: DataFrame | None = None) -> DataFrame:
    """instrument_id, date, _group, combo_score: the weighted sum of winsorised z-scores per (date, group).

    Factors are computed on the filtered rows, as columns of one panel, so instruments are
    shuffled once and dates once. Rows with any factor or z-score undefined go.
    """
    return score_rows(factor_rows(panel, spec, sectors), spec)


def factor_rows(panel: DataFrame, spec: Spec, sectors: DataFrame | None = None) -> DataFrame:
    """instrument_id, date, _group and the spec's factors, __f0 and so on: all that goes by instrument."""
    df = filtered(panel, spec.filters)
    for i, t in enumerate(spec.factors):
        before = df.columns
        df, name = factors.compute(df, t.name, **t.params)
        df = df.select(*before, F.col(name).cast("double").alias(f"__f{i}"))
    if spec.group_by is not None:
        df = grouped(with_sector(df, sectors), spec.group_by, spec.overrides)
    else:
        df = grouped(df, None)
    return df.select("instrument_id", "date", "_group", *(f"__f{i}" for i in range(len(spec.factors))))


def score_rows(df: DataFrame, spec: Spec, *others: str) -> DataFrame:
    """The score of rows with their factors, by date and group; columns named in `others` stay."""
    keys = ["date", "_group"]
    for i in range(len(spec.factors)):
        df = clipped(df, f"__f{i}", spec.winsorize_pct, keys, f"__w{i}")
    signs = [1.0 if t.direction == "high" else -1.0 for t in spec.factors]
    df = df.withColumns({f"__z{i}": standardised(f"__w{i}", keys) * s for i, s in enumerate(signs)})
    known = F.lit(True)
    total = F.lit(0.0)
    for i, t in enumerate(spec.factors):
        known = known & F.col(f"__f{i}").isNotNull() & F.col(f"__z{i}").isNotNull()
        total = total + F.col(f"__z{i}") * t.weight
    return df.where(known).select("instrument_id", "date", "_group", total.alias("combo_score"), *others)


def latest_scores(panel: DataFrame, spec: Spec, sectors: DataFrame | None = None) -> DataFrame:
    """The scores of the last date that has any.

    Only few dates go through the cross-section. The factors are written as a table; a date can
    have scores where some group of it has a complete row and different values of each factor,
    which one aggregate of the table tells. Of these dates the last is tried, then the two
    before it, then four and so on: winsorising may still leave a date without a deviation.
    """
    rows = kept(factor_rows(panel, spec, sectors), "factors")
    own = [f"__f{i}" for i in range(len(spec.factors))]
    complete = F.count_if(~F.exists(F.array(*own), lambda x: x.isNull()))
    groups = rows.groupBy("date", "_group").agg(complete.alias("n"), *((F.min(f) < F.max(f)).alias(f"{f}_differs") for f in own))
    able = groups.where(F.col("n") > 0)
    for f in own:
        able = able.where(f"{f}_differs")
    able = able.select("date").distinct()
    tried, many = None, 1
    while True:
        left = able.where(F.col("date") < F.lit(tried)) if tried is not None else able
        days = [r["date"] for r in left.orderBy(F.desc("date")).limit(many).collect()]
        at = score_rows(rows.where(F.col("date").isin(days) if days else F.lit(False)), spec)
        last = at.agg(F.max("date").alias("d")).first()["d"] if days else None
        if not days or last is not None:
            return at.where(F.col("date") == F.lit(last))
        tried, many = days[-1], min(2 * many, 1024)


def rebalance_dates(panel: DataFrame, every: int) -> DataFrame:
    """date, ordinal of every r-th distinct date, from the first. Ordered in one task: one row a date."""
    days = panel.select("date").distinct().withColumn("__n", F.row_number().over(Window.orderBy("date")) - 1)
    return days.where(F.col("__n") % every == 0).select("date", (F.col("__n") / every).cast("int").alias("ordinal"))


def selected(scored: DataFrame, spec: Spec, universe: DataFrame | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """The best of each (date, group) with their rank: top_k, or top_pct of the candidates, at least 1.

    Candidates are cut to the universe, and to some sectors, before the best are taken; equal
    scores go by instrument_id. The share rounds half to even.
    """
    if universe is not None:
        scored = scored.join(universe.select("instrument_id", "date"), ["instrument_id", "date"], "left_semi")
    if spec.sector_filter is not None:
        scored = with_sector(scored, sectors).where(F.col("sector").isin(*spec.sector_filter)).drop("sector")
    w = Window.partitionBy("date", "_group")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("combo_score"), "instrument_id")))
    if spec.top_k is not None:
        return ranked.where(F.col("rank") <= spec.top_k)
    size = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.lit(spec.top_pct), 0).cast("int"))
    return ranked.withColumn("__size", size).where(F.col("rank") <= F.col("__size")).drop("__size")


def screen(panel: DataFrame, spec: Spec, universe: DataFrame | None = None, at: str | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """BUY rows of a combination at one day: the best of the universe with rank and score; only that day is scored."""
    if at is None:
        scored = latest_scores(panel, spec, sectors)
    else:
        rows = factor_rows(panel, spec, sectors)
        scored = score_rows(rows.where(F.col("date") == F.lit(at).cast("date")), spec)
    return selected(scored, spec, universe, sectors).withColumn("direction", F.lit("BUY"))


def targets(chosen: DataFrame, dates: DataFrame) -> DataFrame:
    """instrument_id, date, ordinal, weight: equal weights of what is chosen on rebalance dates."""
    held = chosen.join(dates, "date")
    return held.select("instrument_id", "date", "ordinal", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def turnover(held: DataFrame) -> DataFrame:
    """ordinal, instrument_id, action: who enters and who leaves at each rebalance.

    A holding enters where the instrument's ordinal before isn't the one before, and leaves at the
    next ordinal where its next isn't that one, if anything is held then: windows over one plan of
    the holdings.
    """
    own = Window.partitionBy("instrument_id").orderBy("ordinal")
    now = F.col("ordinal")
    enters = ~F.coalesce(F.lag("ordinal").over(own) == now - 1, F.lit(False))
    leaves = ~F.coalesce(F.lead("ordinal").over(own) == now + 1, F.lit(False))
    marked = held.select("instrument_id", "ordinal", enters.alias("enters"), leaves.alias("leaves"))
    each = F.array(F.struct(now.alias("ordinal"), F.when(F.col("enters"), "BUY").alias("action"), F.lit(1).alias("held")), F.struct((now + 1).alias("ordinal"), F.when(F.col("leaves"), "SELL").alias("action"), F.lit(0).alias("held")))
    moves = marked.select("instrument_id", F.explode(each).alias("m")).select("m.ordinal", "instrument_id", "m.action", "m.held")
    any_held = F.max("held").over(Window.partitionBy("ordinal"))
    return moves.withColumn("__any", any_held).where("__any = 1 AND action IS NOT NULL").select("ordinal", "instrument_id", "action")
