"""How many tasks a step is dealt to: as many as the tables that it reads are large, so that a task's memory doesn't grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the tables read, as they are stored, for which there is one task; and the most tasks.
TASK_BYTES, MOST = 4 << 20, 20_000


def tasks(*frames: DataFrame) -> int:
    """The session's shuffle partitions, or more where the tables beneath ``frames`` are large; tables of unknown size don't count."""
    size = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
        size += sum(s for s in sizes if s < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, -(-size // TASK_BYTES)))
