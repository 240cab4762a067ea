"""References to records that do not exist.

References may be composite and partly null. They are grouped by their null mask, and each mask is anti-joined with the
parents on the columns that are not null, under the declared match semantics of SQL:

- simple: a reference with any null refers to nothing and is no orphan;
- partial: the columns that are not null must match some parent;
- full: a reference that is null in part is an orphan, a wholly null one is not.

A parent counts when it has a row that is not deleted and, where times are given, did not arrive after the child. Equal
times are fine; an unknown time on either side counts as in time.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from ..functions.text import instant, utc_month
from .skew import SPLIT, splittable


def live(parent: DataFrame, key: str, tombstones: DataFrame) -> DataFrame:
    """Parents without an open deletion. tombstones: key, restored_at; one open row is enough, whenever it was made."""
    return parent.join(tombstones.where(F.col("restored_at").isNull()).select(F.col("entity_id").alias(key)), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str], match: str = "simple", child_time: str | None = None, parent_time: str | None = None) -> DataFrame:
    """The rows of child whose reference has no parent. on: child column -> parent column.

    Null masks are decided row by row before the shuffle, so null references, however many, meet in no task. Both sides get
    exchanges that adaptive execution can split where one parent is referred to by a large share of the rows
    (skew.splittable), also where parent is the outcome of a join by the same key.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    keys = list(on)
    out = None
    for mask in product((False, True), repeat=len(keys)):
        here = F.lit(True)
        for k, null in zip(keys, mask):
            here &= F.col(k).isNull() if null else F.col(k).isNotNull()
        rows = child.where(here)
        if all(mask) or any(mask) and match == "simple":
            continue
        if any(mask) and match == "full":
            found = rows
        else:
            used = [k for k, null in zip(keys, mask) if not null]
            kind = rows.select(*used).union(parent.select(*(on[k] for k in used))).schema  # the types both sides are compared in
            p = parent.select(*(F.col(on[k]).cast(f.dataType).alias(f"__p{i}") for i, (k, f) in enumerate(zip(used, kind))), *([F.col(parent_time).alias("__pt")] if parent_time else []))
            p = splittable(p, [f"__p{i}" for i in range(len(used))])
            cond = p[SPLIT] == F.xxhash64(*(rows[k].cast(f.dataType) for k, f in zip(used, kind)))
            for i, (k, f) in enumerate(zip(used, kind)):
                cond &= rows[k].cast(f.dataType) == p[f"__p{i}"]
            if child_time and parent_time:
                cond &= F.coalesce(p["__pt"] <= rows[child_time], F.lit(True))
            found = rows.join(p, cond, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def change_references(pr_change: DataFrame) -> DataFrame:
    return pr_change.select(F.lit("pr_change").alias("table_name"), F.col("change_id").alias("row_id"), F.col("pr_id").alias("ref"), F.col("ingested_at").alias("at"))


def classification_references(classification: DataFrame) -> DataFrame:
    return classification.select(F.lit("classification").alias("table_name"), F.col("classification_id").alias("row_id"), F.col("change_id").alias("ref"), instant("classified_at").alias("at"))


def pipeline_orphans(pr: DataFrame, pr_change: DataFrame, classification: DataFrame, tombstone: DataFrame) -> DataFrame:
    """table_name, row_id, at: references of changes to pull requests and of classifications to changes."""
    out = []
    for refs, parent, key, entity in ((change_references(pr_change), pr, "id", "pr"), (classification_references(classification), pr_change, "change_id", "pr_change")):
        parents = live(parent.select(key, "ingested_at"), key, tombstone.where(F.col("entity") == entity))
        out.append(orphans(refs, parents, {"ref": key}, "simple", "at", "ingested_at"))
    return out[0].unionByName(out[1]).select("table_name", "row_id", "at")


def orphan_report(found: DataFrame, references: DataFrame) -> DataFrame:
    """table_name, period, n_orphans, n_references: per table and month; both inputs shrink to one row a month first."""
    month = utc_month("at").alias("period")
    a = found.groupBy("table_name", month).agg(F.count(F.lit(1)).alias("n_orphans"))
    b = references.where("ref is not null").groupBy("table_name", month).agg(F.count(F.lit(1)).alias("n_references"))
    period = lambda x: F.coalesce(F.col("period"), F.lit("unknown"))
    a, b = a.withColumn("period", period(a)), b.withColumn("period", period(b))
    return b.join(a, ["table_name", "period"], "left").select("table_name", "period", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), "n_references")
