"""What a collection lacks, as events (K5): sources that are not available, days not collected, data gone stale."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import intervals

#: Days missing beyond which a gap is a warning, and days that its message names.
MANY, NAMED = 3, 3


def quality_events(covered: DataFrame, states: DataFrame, keys: list[str], first: datetime.date, last: datetime.date) -> DataFrame:
    """(keys, severity, kind, message, date): what is wrong with the days ``first`` to ``last`` of each key of ``states``.

    ``covered`` has a row (keys, date) for a collected day, repeats and other days included; ``states`` one
    (keys, state, reason) a key. An unavailable key gives provider_unavailable and nothing more. Others give
    coverage_gap, from their first missing day, and stale, on their latest day, where that is more than
    ``C.STALE_AFTER`` days before the last; a key without any day is a gap, not stale. Days are not exploded.
    """
    up = states.where(~F.col("state").eqNullSafe("unavailable"))
    down = states.where("state = 'unavailable'").select(*keys, F.lit("warning").alias("severity"), F.lit("provider_unavailable").alias("kind"), F.coalesce("reason", F.lit("unavailable")).alias("message"), F.lit(None).cast("date").alias("date"))
    within = covered.where(F.col("date").between(F.lit(first), F.lit(last)))
    spans = intervals.subtracted(up.select(*keys, F.lit(first).alias("start"), F.lit(last).alias("end")), intervals.of_days(within, keys), keys)
    gaps = spans.groupBy(*keys).agg(F.sum(intervals.n_days()).alias("n"), F.min("start").alias("date"), F.collect_list(F.struct("start", "end")).alias("spans"))
    # of each of the first spans the first days alone may be among the first of all
    named = F.slice(F.flatten(F.transform(F.slice(F.array_sort("spans"), 1, NAMED), lambda s: F.sequence(s.start, F.least(s.end, F.date_add(s.start, NAMED - 1))))), 1, NAMED)
    gaps = gaps.select(
        *keys,
        F.when(F.col("n") > MANY, "warning").otherwise("info").alias("severity"),
        F.lit("coverage_gap").alias("kind"),
        F.concat(F.col("n").cast("string"), F.lit(f" of the days {first} to {last} not collected, first "), F.array_join(named.cast("array<string>"), ", ")).alias("message"),
        "date",
    )
    latest = within.groupBy(*keys).agg(F.max("date").alias("date")).where(F.col("date") < F.date_sub(F.lit(last), C.STALE_AFTER))
    stale = latest.join(up.select(*keys), keys, "left_semi").select(*keys, F.lit("warning").alias("severity"), F.lit("stale").alias("kind"), F.concat(F.lit("latest data "), F.col("date").cast("string"), F.lit(f" is over {C.STALE_AFTER} days before {last}")).alias("message"), "date")
    return down.unionByName(gaps).unionByName(stale)
