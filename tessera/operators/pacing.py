"""Timing and progress of runs as windows over their logs (IN5, IN7, HP22)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fetch_slots(requests: DataFrame, gap: float = 1.0, domain: str = "domain", ts: str = "ts", order: str = "id") -> DataFrame:
    """IN7: ``requests`` with ``slot``, the time at which each may go: one a domain every ``gap`` seconds, in order.

    slot n is max(ts n, slot n-1 + gap), which is n * gap + the running maximum of
    ts k - k * gap, so it takes one window and no loop.  A domain is one group: its
    requests wait for each other anyhow.
    """
    line = Window.partitionBy(domain).orderBy(ts, order)
    place = requests.withColumn("_n", F.row_number().over(line) * F.lit(float(gap)))
    ahead = F.max(F.col(ts) - F.col("_n")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return place.withColumn("slot", ahead + F.col("_n")).drop("_n")


def progress_states(log: DataFrame, run: str = "run_id", phase: str = "phase", order: str = "ordinal") -> DataFrame:
    """HP22: each line of a run's log (processed, total) with totals and progress that never fall, and a percentage.

    Progress stays within the total; a phase without a total is done once anything is.
    """
    line = Window.partitionBy(run, phase).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, done = F.max("total").over(line), F.max("processed").over(line)
    out = log.withColumns({"total": total, "processed": done})
    out = out.withColumn("processed", F.when(F.col("total") > 0, F.least("processed", "total")).otherwise(F.col("processed")))
    share = (
        F.when(F.col("total") <= 0, F.when(F.col("processed") > 0, 100).otherwise(0))
        .otherwise(F.bround(100 * F.col("processed") / F.col("total")))
    )
    return out.withColumn("percent", F.least(F.lit(100), share).cast("int"))


def changes(log: DataFrame, values: list[str], run: str = "run_id", order: str = "ordinal") -> DataFrame:
    """IN5: the lines of a progress log whose values differ from those of the line before."""
    line = Window.partitionBy(run).orderBy(order)
    now = F.struct(*values)
    return log.withColumn("_before", F.lag(now).over(line)).where(~F.col("_before").eqNullSafe(now)).drop("_before")
