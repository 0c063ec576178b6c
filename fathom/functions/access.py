"""Access: tiers, scopes and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Tier names and ranks. Fixed values.
TIER_RANKS = {"T-1": 1, "T-2": 2, "T-3": 3}


def tier_rank(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in TIER_RANKS.items():
        out = F.when(tier == name, F.lit(rank)).otherwise(out)
    return out


def in_scope(repository: Column, scope: Column) -> Column:
    """Null scope: everything; an empty scope: nothing; else membership."""
    return F.when(scope.isNull(), F.lit(True)).otherwise(F.array_contains(scope, repository))


def visible(rows: DataFrame, tier: int, scope: list[str] | None) -> DataFrame:
    """The rows of ``tier`` or below within ``scope``; None is no restriction and an empty list is nothing."""
    seen = rows.filter(F.col("tier") <= tier)
    return seen if scope is None else seen.filter(F.col("repository").isin(scope) if scope else F.lit(False))


def user_tiers(users: DataFrame, access_matrix: DataFrame) -> DataFrame:
    """``users`` with ``user_tier``; users that the matrix lacks have the lowest tier."""
    known = access_matrix.select("user_id", tier_rank(F.col("tier")).alias("known_tier"))
    return users.join(known, "user_id", "left").withColumn("user_tier", F.coalesce("known_tier", F.lit(1))).drop("known_tier")


def allowed_scopes(groups: DataFrame, group_scopes: DataFrame) -> DataFrame:
    """(subject, scopes): sorted distinct repositories of each subject's ``group_name`` rows."""
    return (
        groups.join(group_scopes, "group_name").groupBy("subject")
        .agg(F.array_sort(F.collect_set("repository")).alias("scopes"))
    )
