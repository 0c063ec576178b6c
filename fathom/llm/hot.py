"""Pairs of rows that share a key, where some keys are shared by very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathom.session import write_table

#: A key of more holders is split: a task compares so many of them with all.
HOLDERS = 1000


def pairs_sharing(keys: DataFrame, ratio: float) -> DataFrame:
    """(a, b), a < b: the pairs of ``keys(key, x, n)`` that share a key and whose sizes ``n`` allow a similarity of ``ratio``.

    Sets of n and m members, n <= m, have a Jaccard index of at most n / m. A frequent key's holders are spread over tasks.
    """
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("h")).filter("h > 1").select("key", F.ceil(F.col("h") / HOLDERS).cast("int").alias("parts"))
    shared = write_table(keys.join(counted, "key"), "shared-keys")
    left = shared.select("key", F.col("x").alias("a"), F.col("n").alias("n_a"), F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))
    right = shared.select("key", F.col("x").alias("b"), F.col("n").alias("n_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= ratio * F.greatest("n_a", "n_b"))
    return left.join(right, ["key", "part"]).filter(near).select("a", "b").distinct()
