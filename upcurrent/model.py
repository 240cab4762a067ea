"""Schemas of the stored tables, and how a table of an older layout is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

DISCOVERY = "repo_owner string, repo_name string, pr_number bigint, event_created_at string, actor_login string, pr_action string"
ENRICHED = {
    "pr_created_at": "string", "title": "string", "body": "string", "author_login": "string", "author_type": "string", "state": "string", "merged": "boolean",
    "merged_at": "string", "closed_at": "string", "additions": "int", "deletions": "int", "base_sha": "string", "head_sha": "string", "is_cross_repository": "boolean",
    "is_fork": "boolean", "is_archived": "boolean", "root_commit_sha": "string", "commit_messages_concat": "string", "commits_truncated": "boolean",
    "files": "array<struct<path:string,additions:int,deletions:int>>", "passes_manifest_only_filter": "boolean", "files_has_next_page": "boolean", "file_count": "int",
    "manifest_file_count": "int", "non_manifest_file_count": "int", "manifest_filter_reason": "string", "parse_priority": "string", "enriched_at": "string",
}
STATE = {"parse_attempted_at": "string", "closing_comments_fetched_at": "string", "outcome_titlebody": "string", "superseded_reasons": "string"}
_METRICS = {"alignment": "double", "k_projects_decided": "bigint", "k_changes": "bigint", "k_changes_total": "bigint", "n_merged": "bigint", "n_closed_unmerged": "bigint", "n_open": "bigint", "n_superseded": "bigint"}
BACKUPS = ("v1", "pcb")
SCHEMAS = {
    "pr": f"id bigint, {DISCOVERY}, " + ", ".join(f"{k} {v}" for k, v in (ENRICHED | STATE).items()),
    "change": "change_id bigint, pr_id bigint, ecosystem string, package string, from_version string, to_version string, manifest_path string, is_lockfile boolean, group_size int",
    "classification": "change_id bigint, dimension string, label string, classifier_version int, classified_at string",
    "triple_alignment": "ecosystem string, package string, from_version string, to_version string, semver_tier string, k_projects_all bigint, k_projects_decided bigint, k_changes bigint, k_changes_total bigint, n_merged bigint, n_closed_unmerged bigint, n_open bigint, n_superseded bigint, is_security_any int, is_security_all int, n_dependabot bigint, n_renovate bigint, n_human bigint, n_other_bot bigint, source_mix string, alignment double, mean_group_size double, median_group_size double, max_group_size int, all_singleton int, "
    + ", ".join(f"{c}_{b} {t}" for b in BACKUPS for c, t in _METRICS.items())
    + ", computed_at string",
    "pipeline_error": "stage string, repo_owner string, repo_name string, pr_number bigint, error_type string, message string, created_at string",
    "pr_closing_comment": "id bigint, pr_id bigint, author_login string, author_type string, body string, created_at string, fetched_at string",
}
METRICS = tuple(_METRICS)
RENAMED = {"triple_alignment": {"k_projects": "k_projects_all"}}


def schema(spark: SparkSession, table: str) -> StructType:
    return _parse_datatype_string(SCHEMAS[table])


def reconcile(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types in order: old names are renamed, missing columns null, others dropped. Doing it twice changes nothing."""
    for old, new in RENAMED.get(table, {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    want = schema(df.sparkSession, table)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(spark, table))
