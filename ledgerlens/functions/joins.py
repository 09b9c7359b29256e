"""Join policy.

* Dimension tables (app labels, hourly prices of one symbol, protocol payloads, contract addresses) are joined
  without hints. Spark checks their size itself: statically against ``spark.sql.autoBroadcastJoinThreshold`` and,
  under AQE, again at runtime from the real shuffle size; beyond the threshold the join is a sort-merge join whose
  skewed partitions AQE splits (``spark.sql.adaptive.skewJoin.enabled``). A hint would bypass that check.
* Sides whose row count is bounded by the parameters - one row per period, per day of a bounded range, or a single
  aggregate row - are broadcast explicitly with :func:`bounded`; the caller states the bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of ``df`` is below its broadcast threshold, so that a join with it needs no shuffle."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction (per-period or per-day aggregates, one-row
    scalars)."""
    return F.broadcast(df)
