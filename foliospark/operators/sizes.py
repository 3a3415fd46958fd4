"""Size checks before a broadcast, and before a small table is dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side is broadcast.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counting stops at the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond, the plan shuffles.

    Meant for narrow rows (ids, terms, numbers).
    """
    return F.broadcast(df) if is_small(df, rows) else df


#: Bytes by the optimizer's estimate up to which a table may lie in one task's row group.
SPREAD_BYTES = 256 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores if they are so few that one task may read them all.

    Larger tables come in many tasks anyway and are left where they are. Runs no job.
    """
    estimate = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > SPREAD_BYTES:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
