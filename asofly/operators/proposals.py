"""Research proposals as a table: static audit and first-round selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_round(proposals: DataFrame, *, cap: int) -> DataFrame:
    """Of proposals that passed, the first of each family and mechanism, at most `cap` a family; reason for every row."""
    first = F.row_number().over(Window.partitionBy("research_family", "mechanism", "passed").orderBy("factor_id"))
    out = proposals.withColumn("_first", (first == 1) & F.col("passed"))
    turn = F.row_number().over(Window.partitionBy("research_family", "_first").orderBy("factor_id"))
    reason = F.when(~F.col("passed"), "NOT_PASSED").when(~F.col("_first"), "MECHANISM_TAKEN").when(turn <= cap, "SELECTED").otherwise("FAMILY_CAP")
    return out.withColumn("reason", reason).drop("_first")
