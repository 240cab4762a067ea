"""Diagnostics of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.text import col
from .alignment import PROJECT, TRIPLE
from .labels import stored_labels

#: The bins and reasons of the reports.
FILE_BINS = ("1", "2", "3", "4", "5", "6-10", "11-25", "26-50", "51-100", ">100")
GROUP_SIZE_BINS = ("1", "2", "3", "4", "5", "6-10", "11-25", "26-50", ">50")
FILTER_REASONS = (
    "mixed_manifest_and_non_manifest_files",
    "too_many_files",
    "too_many_files_cap",
    "no_manifest_files",
    "graphql_not_found",
    "graphql_error",
)
PR_DIMENSIONS = ("source", "outcome", "security")
FILES = "array<struct<path:string,additions:bigint,deletions:bigint>>"


def files_array(files_json: Column | str) -> Column:
    """The files of a JSON array; anything else, also unreadable text, is an empty one."""
    arr = F.from_json(F.when(col(files_json).rlike(r"^\s*\["), col(files_json)), FILES)
    return F.coalesce(F.filter(arr, lambda f: f.isNotNull()), F.array().cast(FILES))


def _bin(n: Column, above: str) -> Column:
    return F.when(n <= 5, n.cast("string")).when(n <= 10, "6-10").when(n <= 25, "11-25").when(n <= 50, "26-50").otherwise(above)


def file_bin(count: Column | str, listed: Column, next_page: Column | str) -> Column:
    """More than a page is '>100'; null for no files. 101 to 500 listed files still count as '51-100'."""
    n = F.coalesce(col(count), listed)
    return F.when(F.coalesce(col(next_page), F.lit(False)), ">100").when(n >= 1, _bin(n, "51-100"))


def group_size_bin(size: Column | str) -> Column:
    s = col(size)
    return F.when(s.isNull() | (s < 1), "unknown").otherwise(_bin(s, ">50"))


def filter_reason(reason: Column | str) -> Column:
    return F.when(col(reason).isin(*FILTER_REASONS), col(reason)).otherwise("other/unknown")


def zero_filled(counts: DataFrame, key: str, values: tuple[str, ...], n: str = "n") -> DataFrame:
    """counts with a row of 0 for each missing value."""
    all_values = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return all_values.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).alias(n))


def _count(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_files(pr: DataFrame) -> DataFrame:
    """Pull requests with a file list, their files and ecosystems; 'unmatched' where no ecosystem fits."""
    rows = pr.where("files_json IS NOT NULL").withColumn("files", files_array("files_json"))
    eco = paths.ecosystems("files")
    return rows.withColumn("ecosystems", F.when(F.size(eco) > 0, eco).otherwise(F.array(F.lit("unmatched"))))


def ecosystem_counts(pr: DataFrame, change: DataFrame) -> DataFrame:
    """measure, ecosystem, reason, n: candidates, filter_pass, filter_fail by reason, parse_success, zero_changes."""
    rows = with_files(pr).select("id", "passes_manifest_only_filter", "manifest_filter_reason", F.explode("ecosystems").alias("ecosystem"))
    changed = change.where("pr_id IS NOT NULL").select(F.col("pr_id").alias("id")).distinct()
    rows = rows.join(changed.withColumn("changed", F.lit(True)), "id", "left")
    passes, fails = F.col("passes_manifest_only_filter"), F.col("passes_manifest_only_filter") == F.lit(False)
    none = F.lit(None).cast("string")
    each = F.array(
        F.struct(F.lit("candidates").alias("measure"), none.alias("reason")),
        F.when(passes, F.struct(F.lit("filter_pass").alias("measure"), none.alias("reason"))),
        F.when(passes & F.col("changed").isNull(), F.struct(F.lit("zero_changes").alias("measure"), none.alias("reason"))),
        F.when(fails, F.struct(F.lit("filter_fail").alias("measure"), filter_reason("manifest_filter_reason").alias("reason"))),
    )
    told = rows.select("ecosystem", F.explode(F.array_compact(each)).alias("x")).select("x.measure", "ecosystem", "x.reason")
    bare = pr.where("enriched_at IS NOT NULL AND files_json IS NULL AND passes_manifest_only_filter = false").select(F.lit("filter_fail").alias("measure"), F.lit("unmatched").alias("ecosystem"), filter_reason("manifest_filter_reason").alias("reason"))
    parsed = change.select("pr_id", "ecosystem").distinct().select(F.lit("parse_success").alias("measure"), "ecosystem", none.alias("reason"))
    return _count(told.unionByName(bare).unionByName(parsed), "measure", "ecosystem", "reason")


def zero_change_cases(pr: DataFrame, change: DataFrame) -> DataFrame:
    """pr_id, ecosystems, manifest_paths, all_paths_known_stubs of pull requests that pass the filter but gave no change."""
    rows = with_files(pr).where("passes_manifest_only_filter")
    rows = rows.join(change.select(F.col("pr_id").alias("id")), "id", "left_anti")
    p = F.filter(F.transform("files", lambda f: f["path"]), lambda x: paths.is_manifest(x))
    stubs = (F.size(p) > 0) & F.forall(p, lambda x: paths.is_stub(x))
    return rows.select(F.col("id").alias("pr_id"), F.sort_array("ecosystems").alias("ecosystems"), p.alias("manifest_paths"), stubs.alias("all_paths_known_stubs"))


def file_bins(pr: DataFrame) -> DataFrame:
    """bin, n over all bins, and 'zero' for pull requests without files."""
    rows = pr.where("files_json IS NOT NULL").select(F.coalesce(file_bin("file_count", F.size(files_array("files_json")), "files_has_next_page"), F.lit("zero")).alias("bin"))
    return zero_filled(_count(rows, "bin"), "bin", (*FILE_BINS, "zero"))


def next_page_fraction(pr: DataFrame) -> DataFrame:
    n, d = F.count_if(F.col("files_has_next_page")), F.count("files_has_next_page")
    return pr.where("enriched_at IS NOT NULL").agg(n.alias("n"), d.alias("denominator"), F.coalesce(F.try_divide(n, d), F.lit(0.0)).alias("fraction"))


def action_counts(pr: DataFrame) -> DataFrame:
    return _count(pr.where("enriched_at IS NOT NULL"), F.coalesce(F.nullif("pr_action", F.lit("")), F.lit("unknown")).alias("pr_action"))


def error_counts(errors: DataFrame) -> DataFrame:
    """stage, error_type, n; a missing type is 'unknown'."""
    return _count(errors, "stage", F.coalesce("error_type", F.lit("unknown")).alias("error_type"))


def stage_counts(pr: DataFrame, change: DataFrame, classification: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """name, n: how far the tables have come, and why pull requests were filtered out (reason:...)."""
    named = lambda df, **c: df.agg(*(e.alias(k) for k, e in c.items())).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*c))).alias("name", "n"))
    passes, tried = F.col("passes_manifest_only_filter"), F.col("parse_attempted_at").isNotNull()
    out = named(pr, pr_total=F.count(F.lit(1)), pr_enriched=F.count("enriched_at"), pr_passing=F.count_if(passes), pr_failing=F.count_if(passes == F.lit(False)), pr_parse_attempted=F.count_if(tried))
    out = out.unionByName(named(change, changes=F.count(F.lit(1)), pr_with_changes=F.countDistinct("pr_id")))
    out = out.unionByName(named(classification, classifications=F.count(F.lit(1)), changes_classified=F.countDistinct("change_id")))
    if errors is not None:
        out = out.unionByName(named(errors, errors=F.count(F.lit(1))))
    reasons = _count(pr.where("passes_manifest_only_filter = false"), F.concat(F.lit("reason:"), F.coalesce("manifest_filter_reason", F.lit("unknown"))).alias("name"))
    return out.unionByName(reasons)


def repeated_triples(change: DataFrame, pr: DataFrame, least: int = 5) -> DataFrame:
    """ecosystem (null: all), repeated_triples, singleton_restricted: triples that at least `least` projects share.

    A size that is null or 0 is no singleton here, other than in the alignment table.
    """
    project = F.concat(*(x for c in PROJECT for x in (F.lit("/"), F.col(c))))
    rows = change.select("pr_id", *TRIPLE, "group_size").join(pr.select(F.col("id").alias("pr_id"), project.alias("project")), "pr_id")
    single = F.coalesce("group_size", F.lit(0)) == 1
    t = rows.groupBy(*TRIPLE, "project").agg(F.count_if(~single).alias("other")).groupBy(*TRIPLE).agg(F.count("project").alias("k"), F.sum("other").alias("other"))
    return t.where(F.col("k") >= least).groupingSets([[], ["ecosystem"]], "ecosystem").agg(F.count(F.lit(1)).alias("repeated_triples"), F.count_if(F.col("other") == 0).alias("singleton_restricted"))


def pr_and_change_weighted(change: DataFrame, pr: DataFrame, classification: DataFrame, version: int = 1) -> DataFrame:
    """dimension, label, n_prs, n_changes: each label weighted by pull requests (their modal label) and by changes."""
    rows = _classified(change, pr, classification, version).where(F.col("dimension").isin(*PR_DIMENSIONS))
    c = rows.groupBy("dimension", "pr_id", "label").agg(F.count(F.lit(1)).alias("n"))
    by_change = c.groupBy("dimension", "label").agg(F.sum("n").alias("n_changes"))
    modal = c.groupBy("dimension", "pr_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    by_pr = _count(modal, "dimension", "label").withColumnRenamed("n", "n_prs")
    out = by_pr.join(by_change, ["dimension", "label"], "full")
    return out.select("dimension", "label", F.coalesce("n_prs", F.lit(0)).alias("n_prs"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))


def pr_weighted_by_ecosystem(change: DataFrame, pr: DataFrame, classification: DataFrame, version: int = 1) -> DataFrame:
    """dimension, ecosystem, label, n_prs, share: the modal label of each pull request, counted for each of its ecosystems."""
    rows = _classified(change, pr, classification, version)
    eco = rows.select("pr_id", "ecosystem").distinct()
    c = rows.where(F.col("dimension").isin(*PR_DIMENSIONS)).groupBy("dimension", "pr_id", "label").agg(F.count(F.lit(1)).alias("n"))
    modal = c.groupBy("dimension", "pr_id").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    n = _count(modal.join(eco, "pr_id"), "dimension", "ecosystem", "label").withColumnRenamed("n", "n_prs")
    from pyspark.sql import Window

    return n.withColumn("share", F.col("n_prs") / F.sum("n_prs").over(Window.partitionBy("dimension", "ecosystem")))


def consistency(change: DataFrame, pr: DataFrame, classification: DataFrame, version: int = 1) -> DataFrame:
    """name, n: per dimension the pull requests whose changes disagree (violations:...), and those in several ecosystems."""
    rows = _classified(change, pr, classification, version)
    c = rows.where(F.col("dimension").isin(*PR_DIMENSIONS)).select("dimension", "pr_id", "label").distinct().groupBy("dimension", "pr_id").agg(F.count(F.lit(1)).alias("k"))
    bad = c.where("k > 1").groupBy(F.concat(F.lit("violations:"), "dimension").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = rows.select("pr_id", "ecosystem").distinct().groupBy("pr_id").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    return bad.unionByName(e.select(F.lit("cross_ecosystem").alias("name"), "n"))


def group_size_bins(change: DataFrame, pr: DataFrame, classification: DataFrame, version: int = 1) -> DataFrame:
    """bin, n of classified changes over all bins; 'unknown' only where it occurs."""
    ids = _classified(change, pr, classification, version).select("change_id", "group_size").distinct()
    n = _count(ids, group_size_bin("group_size").alias("bin"))
    return zero_filled(n.where("bin <> 'unknown'"), "bin", GROUP_SIZE_BINS).unionByName(n.where("bin = 'unknown'"))


def _classified(change: DataFrame, pr: DataFrame, classification: DataFrame, version: int) -> DataFrame:
    c = change.join(pr.select(F.col("id").alias("pr_id")), "pr_id", "left_semi").select("change_id", "pr_id", "ecosystem", "group_size")
    return c.join(stored_labels(classification, version).select("change_id", "dimension", "label"), "change_id")
