"""Inserts, updates and deletes as functions from tables to tables.

Files are immutable, so every write gives the table's next version; increments.VersionedTable keeps versions. Keys that may be null are compared null-safely.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from ..model import BACKUPS, ENRICHED, METRICS
from .alignment import TRIPLE, same_triple
from .discovery import KEY, insert_ignore

LABEL_KEY = ["change_id", "dimension", "classifier_version"]


def insert_pull_requests(pr: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The rows of new to append: the first of each natural key the table does not have."""
    return insert_ignore(pr, new, KEY, order)


def insert_labels(classification: DataFrame, new: DataFrame) -> DataFrame:
    """The labels of new to append; known keys are left as they are, of repeats within new the smallest label counts."""
    return insert_ignore(classification, new, LABEL_KEY, ["label"])


def update_by_key(table: DataFrame, updates: DataFrame, keys: list[str], allowed: Iterable[str] | None = None) -> DataFrame:
    """table with the columns of updates set where its key occurs. Columns that are not allowed or unknown are passed over.

    updates has one row per key; a null in it sets null.
    """
    names = [c for c in updates.columns if c in table.columns and c not in keys and (allowed is None or c in set(allowed))]
    u = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__hit"))
    out = table.join(u, keys, "left")
    return out.select(*((F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)) for c in table.columns))


def update_enrichment(pr: DataFrame, fields: DataFrame) -> DataFrame:
    """fields: id and enrichment columns; everything else in it is dropped."""
    return update_by_key(pr, fields, ["id"], ENRICHED)


def with_group_size(parsed: DataFrame) -> DataFrame:
    """Changes of one insert, group_size being their number per pull request. The sizes come from an aggregation joined back, not a window."""
    sizes = parsed.groupBy("pr_id").agg(F.count(F.lit(1)).cast("int").alias("group_size"))
    return parsed.drop("group_size").join(sizes, "pr_id")


def number_changes(parsed: DataFrame, after: int = 0) -> DataFrame:
    """change_id in order of (pr_id, change_no), from after + 1 on: counts per pull request, summed up over ranges of pull requests.

    zipWithIndex over a range-partitioned sort numbers rows without a global window; partitions are counted once.
    """
    ordered = parsed.repartitionByRange("pr_id").sortWithinPartitions("pr_id", "change_no")
    schema = ordered.schema.add("change_id", LongType())
    return ordered.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + after + 1)).toDF(schema)


def mark(pr: DataFrame, ids: DataFrame, column: str, value: str) -> DataFrame:
    """column set to value for the ids."""
    return update_by_key(pr, ids.select("id").distinct().withColumn(column, F.lit(value)), ["id"])


def delete_labels(classification: DataFrame, dimensions: list[str], version: int) -> DataFrame:
    """What stays when the labels of these dimensions and this version are deleted."""
    gone = (F.col("classifier_version") == version) & F.col("dimension").isin(dimensions)
    return classification.where(~F.coalesce(gone, F.lit(False)))


def replace_comments(comments: DataFrame, new: DataFrame, pr_ids: DataFrame) -> DataFrame:
    """All comments of pr_ids replaced by those in new; a pull request without any in new keeps none."""
    return comments.join(pr_ids.select("pr_id").distinct(), "pr_id", "left_anti").select(*comments.columns).unionByName(new.select(*comments.columns))


def append_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    return errors.unionByName(new, allowMissingColumns=True)


def delete_parse_errors(errors: DataFrame, done: DataFrame) -> DataFrame:
    """What stays when the parse errors of these pull requests (KEY) are deleted."""
    parse = errors.where("stage = 'parse'").join(done.select(*KEY).distinct(), KEY, "left_anti").select(*errors.columns)
    return errors.where("stage IS NULL OR stage <> 'parse'").unionByName(parse)


def replace_alignment(old: DataFrame, new: DataFrame) -> DataFrame:
    """new in place of old, the snapshots of old carried over by triple."""
    kept = [f"{c}_{b}" for b in BACKUPS for c in METRICS]
    snap = old.where(" OR ".join(f"alignment_{b} IS NOT NULL" for b in BACKUPS)).select(*TRIPLE, *kept)
    return same_triple(new.drop(*kept), snap, "left")


def backup_alignment(table: DataFrame, name: str) -> DataFrame:
    """The present metrics copied into the snapshot columns of that name where they are still empty; a second call changes nothing."""
    if name not in BACKUPS:
        raise ValueError(name)
    fresh = F.col(f"alignment_{name}").isNull()
    return table.select(*(F.when(fresh, F.col(c[: -len(name) - 1])).otherwise(F.col(c)).alias(c) if c in [f"{m}_{name}" for m in METRICS] else F.col(c) for c in table.columns))


def needs_enrichment(pr: DataFrame, limit: int | None = None) -> DataFrame:
    out = pr.where("enriched_at IS NULL").orderBy(F.asc_nulls_first("event_created_at"), "id")
    return out if limit is None else out.limit(limit)


def _parseable(pr: DataFrame, include_deferred: bool) -> DataFrame:
    rows = pr.where("passes_manifest_only_filter")
    return rows if include_deferred else rows.where("parse_priority IS NULL OR parse_priority = 'priority'")


def needs_parsing(pr: DataFrame, change: DataFrame, include_deferred: bool = False) -> DataFrame:
    rows = _parseable(pr, include_deferred).where("parse_attempted_at IS NULL")
    return rows.join(change.select(F.col("pr_id").alias("id")), "id", "left_anti").select(*pr.columns)


def needs_parse_retry(pr: DataFrame, change: DataFrame, errors: DataFrame, include_deferred: bool = False) -> DataFrame:
    """Pull requests with a parse error and no change; a semi-join, so that several errors give one row."""
    rows = _parseable(pr, include_deferred).join(errors.where("stage = 'parse'").select(*KEY), KEY, "left_semi")
    return rows.join(change.select(F.col("pr_id").alias("id")), "id", "left_anti").select(*pr.columns)


def needs_comments(pr: DataFrame) -> DataFrame:
    return pr.where("outcome_titlebody = 'closed-unmerged' AND closing_comments_fetched_at IS NULL")
