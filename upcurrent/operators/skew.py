"""A few keys holding most records: eager aggregation through a join.

Both inputs are aggregated by the join key before they meet. The join then sees one compact state per (join key, group)
from the left and one per join key from the right; counts are multiplied by the number of right rows, sums are combined,
and the states are rolled up to the groups. A group that holds a third of all rows reaches a reducer as one partial state
per task, never as rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from ..functions.text import folded

#: The column that splittable adds.
SPLIT = "__split"


def splittable(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with SPLIT, a hash of the keys, to be joined by the keys and SPLIT.

    Adaptive execution splits a hot key's partition only where both sides of a join come straight from an exchange that the planner put
    there: not from an explicit repartition, nor from an aggregation or join by the same keys whose partitioning is taken over. No side
    is partitioned by SPLIT already, so the planner exchanges both.
    """
    return df.withColumn(SPLIT, F.xxhash64(*keys))


def eager_counts(left: DataFrame, right: DataFrame, key: str, groups: list[str], identity: list[str]) -> DataFrame:
    """Per groups: n_rows (rows of left), n_joined (rows of left join right) and n_identities (distinct identity of the right rows reached).

    key is a column of both inputs. Left rows without a partner count in n_rows only. Null groups form a group of their
    own. identity columns are counted as one value; a value with a null part is not counted.
    """
    states = left.groupBy(key, *groups).agg(F.count(F.lit(1)).alias("n"))
    known = F.lit(True)
    for c in identity:
        known &= F.col(c).isNotNull()
    # A key may stand for several identities; all states of one key stay a short list of (identity, count).
    partners = right.where(F.col(key).isNotNull()).groupBy(key, *identity).agg(F.count(F.lit(1)).alias("m")).withColumn("known", known)
    # The left rows are counted before the join, as a key with several partners would multiply them.
    reached = states.where(F.col(key).isNotNull()).join(partners, key)
    pairs = reached.groupBy(*groups, *identity).agg(F.sum(F.col("n") * F.col("m")).alias("joined"), F.max(F.col("known").cast("int")).alias("known"))
    joined = pairs.groupBy(*groups).agg(F.sum("joined").alias("n_joined"), F.sum("known").cast("bigint").alias("n_identities"))
    rows = states.groupBy(*groups).agg(F.sum("n").alias("n_rows"))
    same = F.lit(True)
    j = joined.select(*(F.col(g).alias(f"__{i}") for i, g in enumerate(groups)), "n_joined", "n_identities")
    for i, g in enumerate(groups):
        same &= rows[g].eqNullSafe(j[f"__{i}"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.join(j, same, "left").select(*groups, F.col("n_rows").cast("bigint").alias("n_rows"), zero("n_joined"), zero("n_identities"))


def package_counts(pr_change: DataFrame, pr: DataFrame) -> DataFrame:
    """ecosystem, package, n_changes, n_joined, n_pull_requests; keys folded. A pull request is (owner, name, number), folded too."""
    left = pr_change.select("pr_id", folded("ecosystem").alias("ecosystem"), folded("package").alias("package"))
    right = pr.select(F.col("id").alias("pr_id"), folded("repo_owner").alias("owner"), folded("repo_name").alias("name"), F.col("pr_number").alias("number"))
    return eager_counts(left, right, "pr_id", ["ecosystem", "package"], ["owner", "name", "number"]).withColumnsRenamed({"n_rows": "n_changes", "n_identities": "n_pull_requests"})


def heavy_keys(counts: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """The rows of counts that hold at least share of all rows. rows: the table whose rows n_changes counts; of it no column is read."""
    total = rows.agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("t")).scalar()
    return counts.where(F.col("n_changes").cast("decimal(20,0)") >= F.lit(Decimal(str(share))) * total)
