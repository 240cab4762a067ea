"""Labels of changes: computing, storing and comparing them, and the wide view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import classifiers, comments, versions
from ..functions.classifiers import DIMENSIONS

LABEL_KEY = ["change_id", "dimension", "classifier_version"]


def selected_dimensions(names: Iterable[str] | None) -> list[str]:
    """The given names once each, in order; all of them for None."""
    chosen = list(dict.fromkeys(names)) if names is not None else list(DIMENSIONS)
    if unknown := [n for n in chosen if n not in DIMENSIONS]:
        raise ValueError(f"unknown dimensions: {', '.join(unknown)}")
    return chosen


def stored_labels(classification: DataFrame, version: int | None = None) -> DataFrame:
    """One row per (change, dimension, version): the first that arrived, as an insert that ignores repeats leaves it."""
    rows = classification if version is None else classification.where(F.col("classifier_version") == version)
    return rows.groupBy(*LABEL_KEY).agg(F.min_by("label", "classification_id").alias("label"), F.min_by("classified_at", "classification_id").alias("classified_at"))


def wide_labels(classification: DataFrame, version: int = 1, complete: bool = True) -> DataFrame:
    """change_id and a column per dimension, in one shuffle; complete keeps changes that have all of them."""
    rows = classification.where(F.col("classifier_version") == version)
    aggs = [F.expr(f"min_by(label, classification_id) FILTER (WHERE dimension = '{d}')").alias(d) for d in DIMENSIONS]
    out = rows.groupBy("change_id").agg(*aggs)
    return out.dropna(subset=list(DIMENSIONS)) if complete else out


def missing_labels(change: DataFrame, classification: DataFrame, dimensions: list[str], version: int = 1) -> DataFrame:
    """Changes that lack at least one of the dimensions."""
    have = classification.where((F.col("classifier_version") == version) & F.col("dimension").isin(dimensions)).groupBy("change_id").agg(F.countDistinct("dimension").alias("n"))
    return change.join(have.where(F.col("n") == len(dimensions)).select("change_id"), "change_id", "left_anti")


def ordered_comments(comment: DataFrame) -> DataFrame:
    """pr_id, comments: each pull request's comments in order of time, null times first, then of id.

    The source gives at most enrich.COMMENTS comments of a pull request, which bounds the lists; supersessions needs none.
    """
    entry = F.struct("created_at", "id", "author_login", "author_type", "body")
    arr = F.sort_array(F.collect_list(entry))
    cast = F.transform(arr, lambda c: F.struct(c["id"].alias("id"), c["author_login"].alias("author_login"), c["author_type"].alias("author_type"), c["body"].alias("body"), c["created_at"].alias("created_at")))
    return comment.where(F.col("pr_id").isNotNull()).groupBy("pr_id").agg(cast.alias("comments"))


def supersessions(comment: DataFrame) -> DataFrame:
    """pr_id, reason, bot_family, pattern_name, comment_text, created_at of each pull request's latest comment that fits a pattern.

    Comments are matched row by row and only the latest match is kept while aggregating, so no list of comments is built.
    """
    c = F.struct("author_login", "author_type", "body")
    rows = comment.where(F.col("pr_id").isNotNull()).select("pr_id", "id", "created_at", "body", comments.comment_pattern(c).alias("m")).where("m IS NOT NULL")
    x = F.struct("m.reason", "m.bot_family", "m.pattern_name", F.col("body").alias("comment_text"), "created_at")
    return rows.groupBy("pr_id").agg(F.max_by(x, F.struct("created_at", "id")).alias("x")).select("pr_id", "x.*")


def classify(change: DataFrame, pr: DataFrame, comment: DataFrame | None = None, dimensions: list[str] | None = None) -> DataFrame:
    """change_id, pr_id, labels and the superseded reason, a column per dimension. pr: with an array of structs `files`.

    What depends on the pull request alone is computed once for each, before the join, so that its changes get labels and no texts. Only
    lockfile rows whose package no manifest row of the same pull request changes are joined with title, body and files: manifest
    rows are direct as they are, and the others by a semi-join. Null keys have no such manifest row. Changes whose pull request is
    missing get no row, like in an inner join.
    """
    want = selected_dimensions(dimensions)
    p = pr.select(F.col("id").alias("pr_id"), "actor_login", "author_login", "author_type", "title", "body", "commit_messages_concat", "state", "merged", "files")
    if comment is not None:
        p = p.join(supersessions(comment).select("pr_id", F.col("reason").alias("__reason")), "pr_id", "left")
    else:
        p = p.withColumn("__reason", F.lit(None).cast("string"))
    done = classifiers.outcome("state", "merged", "title", "body", "__reason")
    of_pr = {"source": classifiers.source("actor_login", "author_login", "author_type"), "security": classifiers.security("title", "body", "commit_messages_concat"), "outcome": done["label"]}
    texts = ["title", "body", "files"]
    p = p.select("pr_id", *(c.alias(d) for d, c in of_pr.items() if d in want), *([done["reason"].alias("superseded_reason")] if "outcome" in want else []), *texts)
    c = change.select("change_id", "pr_id", "ecosystem", "package", "from_version", "to_version", "manifest_path", F.coalesce("is_lockfile", F.lit(False)).alias("is_lockfile"))

    def labelled(rows: DataFrame, direct) -> DataFrame:
        own = {"semver_tier": versions.semver_tier("from_version", "to_version"), "direct_transitive": direct}
        return rows.select("change_id", "pr_id", *((own[d].alias(d) if d in own else F.col(d)) for d in want), *(["superseded_reason"] if "outcome" in want else []))

    if "direct_transitive" not in want:
        return labelled(c.join(p.drop(*texts), "pr_id"), None)
    keys = ["pr_id", "ecosystem", "package"]
    manifest, lock = c.where(~F.col("is_lockfile")), c.where("is_lockfile")
    siblings = manifest.select(*keys).distinct()
    plain = manifest.unionByName(lock.join(siblings, keys, "left_semi").select(*c.columns)).join(p.drop(*texts), "pr_id")
    told = lock.join(siblings, keys, "left_anti").select(*c.columns).join(p, "pr_id")
    direct = classifiers.direct_transitive("is_lockfile", F.lit(False), "package", "title", "body", "manifest_path", "files", "ecosystem")
    return labelled(plain, F.lit("direct")).unionByName(labelled(told, direct))


def long_labels(wide: DataFrame, dimensions: list[str], version: int = 1) -> DataFrame:
    """change_id, dimension, label, classifier_version: one row for each label."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions))).alias("x")
    return wide.select("change_id", each).select("change_id", "x.dimension", "x.label", F.lit(version).alias("classifier_version"))


def label_flips(old: DataFrame, new: DataFrame) -> DataFrame:
    """dimension, old_label, new_label, n of the labels that differ between two long tables, matched by (change, dimension)."""
    o = old.select("change_id", "dimension", F.col("label").alias("old_label"))
    n = new.select("change_id", "dimension", F.col("label").alias("new_label"))
    return o.join(n, ["change_id", "dimension"]).where("old_label <> new_label").groupBy("dimension", "old_label", "new_label").agg(F.count(F.lit(1)).alias("n"))


def relabel(change: DataFrame, pr: DataFrame, classification: DataFrame, dimensions: list[str], version: int = 1, comment: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A forced run: the labels that stand after it, and the flips. Labels of these dimensions and version are deleted and computed anew for all changes."""
    from .store import LABEL_KEY, delete_labels, insert_labels

    want = selected_dimensions(dimensions)
    columns = [*LABEL_KEY, "label"]
    stored = stored_labels(classification).select(*columns)
    old = stored.where((F.col("classifier_version") == version) & F.col("dimension").isin(want))
    new = long_labels(classify(change, pr, comment, want), want, version).select(*columns)
    kept = delete_labels(stored, want, version)
    return kept.unionByName(insert_labels(kept, new)), label_flips(old, new)


def label_distribution(long: DataFrame) -> DataFrame:
    return long.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))


def unmatched_bot_comments(change: DataFrame, classification: DataFrame, comments_by_pr: DataFrame, sample_size: int = 10, seed: int = 42) -> DataFrame:
    """bot_family, n, samples: closed pull requests whose bot comments fit no pattern, by the family of the last one.

    Samples are the sample_size rows of the lowest seeded hash; a bounded aggregate, not a sort of each family.
    """
    closed = classification.where("dimension = 'outcome' AND classifier_version = 1 AND label = 'closed-unmerged'").select("change_id")
    prs = change.join(closed, "change_id", "left_semi").select("pr_id").distinct()
    rows = comments_by_pr.join(prs, "pr_id", "left_semi")
    bots = F.filter("comments", lambda c: comments.bot_family(c["author_login"], c["author_type"]) != "human")
    rows = rows.select("pr_id", bots.alias("bots")).where((F.size("bots") > 0) & comments.supersession("bots").isNull())
    last = F.element_at("bots", -1)
    rows = rows.select("pr_id", comments.bot_family(last["author_login"], last["author_type"]).alias("bot_family"), comments.shown(last["body"]).alias("last_comment_text"), last["created_at"].alias("created_at"))
    rows = rows.withColumn("rank", F.md5(F.concat_ws(":", F.lit(seed), "pr_id")))
    counts = rows.groupBy("bot_family").agg(F.count(F.lit(1)).alias("n"))
    # Before the exchange each task keeps its own lowest ranks only (a limit within the group), which is exact.
    from pyspark.sql import Window

    top = rows.withColumn("k", F.row_number().over(Window.partitionBy("bot_family").orderBy("rank", "pr_id"))).where(F.col("k") <= sample_size)
    samples = top.groupBy("bot_family").agg(F.sort_array(F.collect_list(F.struct("rank", "pr_id", "last_comment_text", "created_at"))).alias("samples"))
    return counts.join(samples, "bot_family")
