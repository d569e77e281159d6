"""Numbers within groups of any size: by ranges of the order, so that no group has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.session import staged


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 .. in each group by ``order`` (nulls first), like ``row_number`` over the group.

    Rows are dealt by ranges of group and order and numbered there; a group that goes over several ranges adds
    up the rows of the ranges before, one row a range and group. Rows of equal order are told apart by their
    place, so a third of all rows may be equal.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, "__tie")
    ranged = ranged.sortWithinPartitions(*keys, "__tie").withColumn("__at", F.monotonically_increasing_id())
    rows = staged(ranged.withColumn("__part", F.shiftrightunsigned("__at", 33)).drop("__tie"), "numbered")
    ranges = rows.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = ranges.withColumn("__before", before).where("__before > 0")
    renamed = spread.select(F.col("__part").alias("__p"), "__before", *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)))
    on = (F.col("__part") == F.col("__p")) & F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    # one group at most goes on from a range into the next: no more rows than ranges
    joined = rows.join(F.broadcast(renamed), on, "left")
    local = F.row_number().over(Window.partitionBy("__part", *group).orderBy("__at"))
    number = (local + F.coalesce("__before", F.lit(0))).cast("long")
    return joined.withColumn(name, number).drop("__at", "__part", "__p", "__before", *(f"__g{i}" for i in range(len(group))))
