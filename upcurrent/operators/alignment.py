"""How far projects agree on the same version change.

Two aggregations give everything: by (version triple, project), which takes each project's latest decision, then by triple. Counts of
rows are carried through the first as partial sums, modes as counts per tier, so that no triple's rows are ever collected.
The median of group sizes alone needs its values: they are counted by (triple, size) first, and size is bounded by what a
pull request holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.paths import ECOSYSTEMS

TRIPLE = ["ecosystem", "package", "from_version", "to_version"]
PROJECT = ["repo_owner", "repo_name"]
DECISIONS = ("merged", "closed-unmerged")
EXCLUDED = ("open", "superseded")
SOURCES = ("dependabot", "renovate", "human", "other-bot")


def contributing_rows(change: DataFrame, pr: DataFrame, labels: DataFrame) -> DataFrame:
    """Changes with all labels and their pull request. labels: the wide view."""
    p = pr.select(F.col("id").alias("pr_id"), *PROJECT, "event_created_at", "is_fork", "is_archived")
    c = change.select("change_id", "pr_id", *TRIPLE, "group_size")
    return c.join(labels.select("change_id", "source", "semver_tier", "security", "outcome"), "change_id").join(p, "pr_id")


def hosted(rows: DataFrame, kept: bool = True) -> DataFrame:
    """Rows of repositories that are neither forks nor archived; unknown counts as neither. kept=False gives the others."""
    out = F.coalesce(F.col("is_fork"), F.lit(False)) | F.coalesce(F.col("is_archived"), F.lit(False))
    return rows.where(~out if kept else out)


def group_size(c: str = "group_size") -> Column:
    """Sizes that are null or 0 count as 1."""
    return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1))


def alignment_score(merged: Column, closed: Column, k: Column) -> Column:
    """1 - entropy / ln 2 of the decisions; 1.0 for one project or a unanimous triple."""
    term = lambda n: F.when(n == 0, 0.0).otherwise(-(n / k) * F.log(n / k))
    return F.when((k <= 1) | (F.greatest(merged, closed) == k), 1.0).otherwise(1.0 - (term(merged) + term(closed)) / F.log(F.lit(2.0)))


def source_mix(counts: dict[str, Column]) -> Column:
    d, r, h, o = (counts[s] for s in SOURCES)
    total = d + r + h + o
    return (
        F.when(total == 0, "mixed_other")
        .when(d == total, "all_dependabot")
        .when(r == total, "all_renovate")
        .when(h == total, "all_human")
        .when(o == total, "all_other_bot")
        .when((h == 0) & (d + r + o > 0), "mixed_bots")
        .when((h > 0) & (d + r + o > 0), "mixed_bot_human")
        .otherwise("mixed_other")
    )


def by_project(rows: DataFrame) -> DataFrame:
    """One state per (triple, project): the latest decision, the latest excluded outcome and partial counts."""
    decided, excluded = F.col("outcome").isin(*DECISIONS), F.col("outcome").isin(*EXCLUDED)
    when = F.struct(F.coalesce("event_created_at", F.lit("")).alias("at"), F.col("change_id"))
    latest = lambda mask: F.max_by(F.when(mask, F.col("outcome")), F.when(mask, when))
    count = lambda mask: F.count_if(mask)
    return rows.groupBy(*TRIPLE, *PROJECT).agg(
        latest(decided).alias("decision"),
        latest(excluded).alias("excluded"),
        F.count(F.lit(1)).alias("rows"),
        count(decided).alias("decided"),
        count(excluded).alias("excluded_rows"),
        count(F.col("outcome") == "superseded").alias("superseded_rows"),
        count(F.col("outcome") == "open").alias("open_rows"),
        count(decided & (F.col("security") == "security")).alias("security"),
        *(count(decided & (F.col("source") == s)).alias(f"s_{i}") for i, s in enumerate(SOURCES)),
        F.sum(F.when(decided, group_size())).alias("size_sum"),
        F.max(F.when(decided, group_size())).alias("size_max"),
        count(decided & (group_size() != 1)).alias("not_single"),
    )


def triples(rows: DataFrame) -> DataFrame:
    """Per triple the counts, of all triples, also those without a decision."""
    k = by_project(rows).groupBy(*TRIPLE).agg(
        F.count(F.lit(1)).alias("k_projects_all"),
        F.count("decision").alias("k_projects_decided"),
        F.sum("decided").alias("k_changes"),
        F.sum("rows").alias("k_changes_total"),
        F.count_if(F.col("decision") == "merged").alias("n_merged"),
        F.count_if(F.col("decision") == "closed-unmerged").alias("n_closed_unmerged"),
        F.count_if(F.col("decision").isNull() & (F.col("excluded") == "open")).alias("n_open"),
        F.count_if(F.col("decision").isNull() & (F.col("excluded") == "superseded")).alias("n_superseded"),
        F.sum("security").alias("n_security"),
        *(F.sum(f"s_{i}").alias(name) for i, name in enumerate(("n_dependabot", "n_renovate", "n_human", "n_other_bot"))),
        F.sum("size_sum").alias("size_sum"),
        F.max("size_max").alias("max_group_size"),
        F.sum("not_single").alias("not_single"),
        F.sum("excluded_rows").alias("excluded_rows"),
        F.sum("superseded_rows").alias("superseded_rows"),
        F.sum("open_rows").alias("open_rows"),
    )
    return k


def _decided_detail(rows: DataFrame) -> DataFrame:
    """Per triple the modal tier, ties going to the smaller name, and the exact median group size of decided rows."""
    n = rows.where(F.col("outcome").isin(*DECISIONS)).groupBy(*TRIPLE, "semver_tier", group_size().alias("size")).agg(F.count(F.lit(1)).alias("n"))
    tiers = n.groupBy(*TRIPLE, "semver_tier").agg(F.sum("n").alias("n")).groupBy(*TRIPLE).agg(F.min_by("semver_tier", F.struct(-F.col("n"), F.col("semver_tier"))).alias("semver_tier"))
    median = n.groupBy(*TRIPLE).agg(F.percentile("size", 0.5, F.col("n")).cast("double").alias("median_group_size"))
    return same_triple(tiers, median)


def same_triple(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by triple, where a null from_version equals a null one."""
    r = right.withColumnsRenamed({c: f"__{c}" for c in TRIPLE})
    on = F.lit(True)
    for c in TRIPLE:
        on &= left[c].eqNullSafe(r[f"__{c}"])
    return left.join(r, on, how).drop(*(f"__{c}" for c in TRIPLE))


def alignment(rows: DataFrame, least: int = 2) -> DataFrame:
    """The alignment table of the triples that at least `least` projects decided. rows: contributing rows of hosted repositories."""
    k = triples(rows).where(F.col("k_projects_decided") >= max(least, 1))
    k = same_triple(k, _decided_detail(rows))
    counts = dict(zip(SOURCES, (F.col(c) for c in ("n_dependabot", "n_renovate", "n_human", "n_other_bot"))))
    return k.select(
        *TRIPLE,
        "semver_tier",
        "k_projects_all",
        "k_projects_decided",
        "k_changes",
        "k_changes_total",
        "n_merged",
        "n_closed_unmerged",
        "n_open",
        "n_superseded",
        (F.col("n_security") > 0).cast("int").alias("is_security_any"),
        (F.col("n_security") == F.col("k_changes")).cast("int").alias("is_security_all"),
        "n_dependabot",
        "n_renovate",
        "n_human",
        "n_other_bot",
        source_mix(counts).alias("source_mix"),
        F.round(alignment_score(F.col("n_merged"), F.col("n_closed_unmerged"), F.col("k_projects_decided")), 9).alias("alignment"),
        F.round(F.col("size_sum") / F.col("k_changes"), 9).alias("mean_group_size"),
        "median_group_size",
        "max_group_size",
        (F.col("not_single") == 0).cast("int").alias("all_singleton"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row of totals. rows: all contributing rows; forks and archived repositories are counted and left out."""
    kept, lost = hosted(rows), hosted(rows, kept=False)
    t, k = triples(kept), F.col("k_projects_decided")
    some = k > 0
    totals = t.agg(
        F.count_if(some).alias("triples_total"),
        *(F.count_if(k >= n).alias(f"triples_k_ge_{n}") for n in (2, 3, 5)),
        *(F.count_if((k >= 5) & (F.col("ecosystem") == e)).alias(f"triples_k_ge_5_{e}") for e in ECOSYSTEMS),
        F.count_if((k >= 5) & (F.col("not_single") == 0)).alias("triples_k_ge_5_all_singleton"),
        F.count_if((F.col("k_changes") < F.col("k_changes_total")) & (F.col("open_rows") > 0)).alias("triples_with_open_projects"),
        F.count_if(F.col("k_changes") < F.col("k_changes_total")).alias("triples_with_non_decision_projects"),
        F.count_if(~some).alias("triples_dropped_zero_decided"),
        F.count_if(~some & (F.col("superseded_rows") == F.col("k_changes_total"))).alias("triples_dropped_only_superseded"),
        F.count_if(k < 2).alias("triples_below_k2_after_non_decision_exclusion"),
        F.coalesce(F.sum(F.col("excluded_rows") - F.col("superseded_rows")), F.lit(0)).alias("open_change_rows_excluded"),
        F.coalesce(F.sum("superseded_rows"), F.lit(0)).alias("superseded_change_rows_excluded"),
        F.coalesce(F.sum("excluded_rows"), F.lit(0)).alias("non_decision_change_rows_excluded"),
    )
    forks = lost.agg(F.count(F.lit(1)).alias("fork_or_archived_change_rows_excluded"), *(F.count_if(F.col("ecosystem") == e).alias(f"fork_or_archived_change_rows_excluded_{e}") for e in ECOSYSTEMS))
    return totals.withColumn("__1", F.lit(1)).join(forks.withColumn("__1", F.lit(1)), "__1").drop("__1")


def targets_met(alignment_rows: DataFrame, targets: dict[str, int], least: int = 5) -> DataFrame:
    """ecosystem, target, n, met for each target; all met when every met is true."""
    spark = alignment_rows.sparkSession
    wanted = spark.createDataFrame(sorted(targets.items()), "ecosystem string, target bigint")
    n = alignment_rows.where(F.col("k_projects_decided") >= least).groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "ecosystem", "left").select("ecosystem", "target", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("target")).alias("met"))
