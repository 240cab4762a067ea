"""Pull-request events of an archive: what was opened, synchronised or reopened first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The events that count.
EVENT, ACTIONS = "PullRequestEvent", ("opened", "synchronize", "reopened")
KEY = ["repo_owner", "repo_name", "pr_number"]


def check_request(date: str, limit: int | None) -> None:
    if not re.fullmatch(r"\d{8}", date):
        raise ValueError("date must be YYYYMMDD")
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")


def events(raw: DataFrame, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """owner, name, number, time, actor and action of raw archive events (type, repo, payload, actor, created_at, id)."""
    action = F.get_json_object("payload", "$.action")
    part = lambda i: F.get(F.split("repo", "/"), F.lit(i))
    number = F.coalesce(F.get_json_object("payload", "$.number"), F.get_json_object("payload", "$.pull_request.number"))
    rows = raw.where((F.col("type") == EVENT) & action.isin(*actions))
    return rows.select(F.col("id").alias("event_id"), part(0).alias("repo_owner"), part(1).alias("repo_name"), number.try_cast("bigint").alias("pr_number"), F.col("created_at").alias("event_created_at"), F.col("actor").alias("actor_login"), action.alias("pr_action"))


def first_events(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, all columns. order should end with a unique column; min_by aggregates before the shuffle, a window would not."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("x")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def read_archive_day(spark: SparkSession, root: str, date: str, limit: int | None = None) -> DataFrame:
    """The first event of each pull request of one day's JSON files under root/date, in order of time."""
    check_request(date, limit)
    schema = "id string, type string, repo string, payload string, actor string, created_at string"
    out = first_events(events(spark.read.schema(schema).json(f"{root}/{date}")), KEY, ["event_created_at", "event_id"]).orderBy("event_created_at", "event_id")
    return out if limit is None else out.limit(limit)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The rows of new that an insert which ignores known keys would add: the first of each key, unless existing has it."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest)).select(*new.columns)
    return first.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


__all__ = ["ACTIONS", "KEY", "check_request", "events", "first_events", "insert_ignore", "read_archive_day"]
