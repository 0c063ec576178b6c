"""Table upkeep: upserts, set inserts, deletes, fingerprints and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the last of ``incoming`` (by ``order``) where it has the key, else ``current``'s."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    fresh = incoming.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def insert_missing(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set insert: rows that ``current`` has already change nothing."""
    return current.unionByName(incoming.select(current.columns)).distinct()


def delete_repository(artifacts: DataFrame, edges: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """The tables without a repository's artifacts and without the edges that touch them."""
    gone = artifacts.filter(F.col("repository") == repository).select("id")
    kept = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(
        gone.select(F.col("id").alias("target_id")), "target_id", "left_anti"
    )
    return artifacts.filter(F.col("repository") != repository), kept.select(edges.columns)


def overwrite_repositories(artifacts: DataFrame, path: str) -> None:
    """Write ``artifacts`` partitioned by repository, replacing only the partitions that it has."""
    (
        artifacts.repartition("repository").sortWithinPartitions("tier").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("repository").parquet(path)
    )


def index_stats(artifacts: DataFrame) -> DataFrame:
    """(repository, artifacts, newest): distinct ids and the last update of each repository, and of all (``total``)."""
    each = artifacts.groupBy("repository", "id").agg(F.max("updated_at").alias("updated_at"))
    return each.rollup("repository").agg(
        F.count(F.lit(1)).alias("artifacts"), F.round(F.coalesce(F.max("updated_at"), F.lit(0.0)), 3).alias("newest")
    ).withColumn("repository", F.coalesce("repository", F.lit("total")))


def fingerprints(artifacts: DataFrame) -> DataFrame:
    """(repository, artifacts, fingerprint): a digest of each repository's ids and texts that no order changes.

    Per-row digests are added up as numbers, so that any split of the rows gives the same sum.
    """
    content = F.sha2(F.concat_ws("\x1f", "id", F.coalesce("text", F.lit(""))), 256)
    number = F.conv(F.substring(content, 1, 10), 16, 10).cast("decimal(38,0)")
    rows = artifacts.select("repository", "id", number.alias("number")).distinct()
    return rows.groupBy("repository").agg(
        F.count(F.lit(1)).alias("artifacts"), F.sum("number").cast("string").alias("sum")
    ).select("repository", "artifacts", F.sha2(F.concat_ws(":", "repository", F.col("artifacts").cast("string"), "sum"), 256).alias("fingerprint"))
