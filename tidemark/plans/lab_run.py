"""A research run (V9, B9, B10, B13): one set of parameters to all of its tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import draws
from tidemark.operators import lab
from tidemark.operators.composite import composite, expected_sources
from tidemark.plans.ledger import Ledger

#: Features that the sources enter through the composite; only these change when a source is left out.
COMPOSED = ("alt_signal_score", "attention_score", "sentiment_score", "attention_acceleration", "sentiment_change", "agreement", "divergence")
RANDOM_SEED = 42
Sections = Callable[..., DataFrame]


class NotEnough(ValueError):
    """Too few usable cross-sections for a run."""


def trading_dates(signals: DataFrame, p: C.LabParams) -> DataFrame:
    """Weekdays with signals from the start (the warm-up after the first day by default) to the end."""
    days = signals.select("date").distinct()
    first = F.date_add(F.lit(days.agg(F.min("date").alias("d")).first().d), C.WARM_UP_DAYS) if p.start is None else F.lit(p.start).cast("date")
    days = days.where((F.weekday("date") < 5) & (F.col("date") >= first))
    return days if p.end is None else days.where(F.col("date") <= F.lit(p.end).cast("date"))


def sections_of(labels: DataFrame, universe: DataFrame, dates: DataFrame, p: C.LabParams) -> Sections:
    """A function (signals, features, least confidence) to the run's sections."""

    def of(signals: DataFrame, features: dict[str, float], floor: float = p.min_confidence) -> DataFrame:
        return lab.sections(signals.join(dates, "date", "left_semi"), labels, universe, features, p.horizon, p.top_rank, p.sectors, floor)

    return of


def baselines(of: Sections, signals: DataFrame, horizon: int, seed: int = RANDOM_SEED) -> DataFrame:
    """(name, dates, mean_rank_ic, t_stat) of a seeded random signal, attention alone and the default composite."""
    drawn = signals.withColumn("random", draws.normal(seed, F.col("date"), F.col("entity")))
    return lab.scenarios({"random": of(drawn, {"random": 1.0}), "attention": of(signals, {"attention_score": 1.0}), "composite": of(signals, {"alt_signal_score": 1.0})}, horizon, 1)


def floors(of: Sections, signals: DataFrame, features: dict[str, float], horizon: int, least: float = 0.0) -> DataFrame:
    """The same for floors of confidence, none below ``least``."""
    return lab.scenarios({str(f): of(signals, features, max(float(f), least)) for f in C.CONFIDENCE_FLOORS}, horizon)


def without_sources(of: Sections, compose: Callable[[tuple[str, ...]], DataFrame], features: dict[str, float], horizon: int, excluded: tuple[str, ...] = ()) -> DataFrame | None:
    """The same with one source more left out each time (B10); None if no feature is of the composite."""
    if not set(features) & set(COMPOSED):
        return None
    return lab.scenarios({s: of(compose((*excluded, s)), features) for s in C.SOURCES if s not in excluded}, horizon)


def run(features: DataFrame, signals: DataFrame, labels: DataFrame, universe: DataFrame, p: C.LabParams, mood: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name: summary, quintiles, curve, splits, walk_forward, baselines, sectors, months, floors, coverage, integrity,
    and, where they apply, removals and regimes.

    ``signals`` are the default composite's; weights or exclusions of the parameters compose them anew from
    ``features``. Raises ``NotEnough`` below ten usable dates.
    """
    known = expected_sources(features)
    compose = lambda exclude: composite(features, known, p.component_weights or None, exclude)
    panel = compose(p.exclude_sources) if p.component_weights or p.exclude_sources else signals
    dates = trading_dates(signals, p)
    of = sections_of(labels, universe, dates, p)
    weights = {f: p.weights.get(f, 1.0) for f in p.features}
    main = of(panel, weights)
    stats = lab.date_stats(main)
    if (usable := stats.count()) < C.MIN_DATES:
        raise NotEnough(f"{usable} usable dates; {C.MIN_DATES} are needed")
    chosen = universe if p.top_rank is None else universe.where(F.col("rank") <= p.top_rank)
    chosen = chosen.where(F.col("sector").isin(*p.sectors)) if p.sectors else chosen
    split = lab.splits(stats)
    candidates = {"combined": stats} if len(p.features) > 1 else {}
    candidates |= {f: lab.date_stats(of(panel, {f: 1.0})) for f in p.features}
    named = [x.select(F.lit(k).alias("candidate"), "date", "rank_ic") for k, x in candidates.items()]
    rows = named[0]
    for more in named[1:]:
        rows = rows.unionByName(more)
    out = {
        "summary": lab.summary(stats, p.horizon),
        "quintiles": lab.pooled_quintiles(main),
        "curve": lab.spread_curve(stats, p.horizon),
        "splits": lab.summary(split, p.horizon, ["split"]),
        "walk_forward": lab.walk_forward(rows, p.horizon, min_train=max(20, usable * 2 // 5)),
        "baselines": baselines(of, signals, p.horizon),
        "sectors": lab.group_ic(main, p.horizon),
        "months": lab.by_month(stats, p.horizon),
        "floors": floors(of, panel, weights, p.horizon, p.min_confidence),
        "coverage": lab.coverage(main, dates, chosen.count()),
        "integrity": lab.integrity(features, labels.where(F.col("horizon") == p.horizon)),
    }
    removals = without_sources(of, compose, weights, p.horizon, p.exclude_sources)
    if removals is not None:
        out["removals"] = removals
    if mood is not None:
        out["regimes"] = lab.summary(lab.regimes(stats, mood), p.horizon, ["regime"], bootstrap=False)
    return out


def verdict(tables: dict[str, DataFrame]) -> str:
    """Of a run's tables."""
    full = tables["summary"].first()
    test = tables["splits"].where("split = 'test'").first()
    return lab.verdict(full.mean_rank_ic, test.t_stat if test else None, test.mean_rank_ic if test else None)


def store(tables: dict[str, DataFrame], folder: str, run_id: str) -> None:
    """Each table of a run below ``folder/table/run=...``, so that all runs of a table are one partitioned table."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}/run={run_id}")


def keep(ledger: Ledger, tables: dict[str, DataFrame], p: C.LabParams, folder: str, run_id: str | None = None) -> str:
    """Store a run's tables as ``store`` does and enter it, with its parameters and the rows of each table (K7); the run's id."""
    with ledger.run("lab", asdict(p), {"composite": C.COMPOSITE_VERSION}, run_id) as kept:
        for name, table in tables.items():
            kept.write(table, f"{folder}/{name}/run={kept.id}", {f"{name}.rows": F.count("*")})
    return kept.id


def look_up(ledger: Ledger, folder: str, run_id: str) -> tuple[Row, C.LabParams, dict[str, DataFrame]] | None:
    """A stored run by its id: its entry, its parameters and its tables (B14); None where there is none that succeeded."""
    found = ledger.find(run_id)
    if found is None or found.job != "lab" or found.status != "succeeded":
        return None
    p = C.LabParams(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(found.params).items()})
    names = [n.removesuffix(".rows") for n in found.totals if n.endswith(".rows")]
    return found, p, {n: ledger.spark.read.parquet(f"{folder}/{n}/run={run_id}") for n in names}
