"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """`group`, `place` (from 1), `item`, `score`: the n best items of each group by score descending, then item
    ascending.

    Null and NaN scores and null groups or items are left out; infinite scores are numbers as any other; of
    several scores of one item in a group the highest counts; -0.0 equals 0.0. A group of fewer items gives all
    of them; an empty table nothing. Other columns are ignored.

    Method: row_number by score and identifier with a rank filter. The optimiser turns it into a group limit
    (for n up to spark.sql.optimizer.windowGroupLimitThreshold, 1000) that keeps at most n rows of a group in
    each task before the exchange, so a group of millions of items sends n rows a task. Repeated items are
    reduced to their highest score before, by group and item together, which splits large groups as well.
    """
    number = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.when(number == 0, F.lit(0.0)).otherwise(number).alias("s"))
    best = rows.where("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)").groupBy("g", "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    ranked = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return ranked.select(F.col("g").alias(group), "place", F.col("i").alias(item), F.col("s").alias(score))
