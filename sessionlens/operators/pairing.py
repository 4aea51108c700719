"""Pairing tool results with the tool uses before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Every result with the latest unconsumed use of its tool_use_id before it, null if there's none.

    Both have file, tool_use_id, pos (a sortable position) and columns of their own. A use is consumed by the first result after it, and
    replaced by a later use of the same id; so a result pairs exactly if the row before it in its id's order is a use. One sort by
    (file, tool_use_id), no join; ids are unique to a call, so no group is large. Rows without an id never pair and don't meet.
    """
    named = F.coalesce("tool_use_id", F.lit("")) != ""
    uses, nameless, results = uses.where(named), results.where(~named), results.where(named)
    own = [c for c in uses.columns if c not in ("file", "tool_use_id", "pos")]
    both = uses.withColumn("_use", F.lit(True)).unionByName(results.withColumn("_use", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy("file", "tool_use_id").orderBy("pos")
    before = F.lag(F.struct("_use", *own)).over(order)
    out = both.withColumn("_before", before).where("not _use")
    for c in own:
        out = out.withColumn(c, F.when(F.col("_before._use"), F.col(f"_before.{c}")))
    return out.drop("_before", "_use").unionByName(nameless, allowMissingColumns=True)
