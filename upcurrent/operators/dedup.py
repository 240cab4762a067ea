"""Messages delivered more than once: exactly one copy of each is kept.

Hash aggregation by identifier, taking min_by over a struct of delivery order and tie-break. The struct is packed into
one decimal where its two parts are whole numbers, because Spark's hash aggregation needs buffers of a fixed width;
anything else would fall back to sorting. The partial aggregation on the map side leaves one row per identifier and task,
so an identifier that holds a third of all rows costs no more than any other.

Null identifiers: a row with a null in any key column identifies no message; it is kept and has no copies.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import folded, instant
from .skew import SPLIT, splittable


def delivery_order(delivered: Column, tie: Column) -> Column:
    """(delivered, tie), both BIGINT-like and not negative, as one number of the same order. Null deliveries go last."""
    late = F.coalesce(delivered.cast("bigint"), F.lit(9223372036854775807)).cast("decimal(38,0)")
    return (late * F.lit(Decimal(10**19)) + tie.cast("decimal(20,0)")).cast("decimal(38,0)")


def winners(rows: DataFrame, keys: list[str], row_id: str, order: Column) -> DataFrame:
    """keys, kept_id, n_copies: of each identifier the row_id that comes first in order."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return rows.where(known).groupBy(*keys).agg(F.min_by(F.col(row_id), order).alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))


def copies(rows: DataFrame, keys: list[str], row_id: str, order: Column) -> DataFrame:
    """kept_id, dup_id: one row for every further copy.

    The winners of repeated messages only are shuffled once more, so that adaptive execution can split the copies of a hot
    identifier over several tasks (skew.splittable). Rows go in narrow: the keys and row_id.
    """
    repeated = winners(rows, keys, row_id, order).where("n_copies > 1").drop("n_copies")
    narrow = rows.select(*keys, F.col(row_id).alias("dup_id"))
    return splittable(narrow, keys).join(splittable(repeated, keys), [*keys, SPLIT]).where("dup_id <> kept_id").select("kept_id", "dup_id")


def exactly_once(rows: DataFrame, keys: list[str], row_id: str, order: Column) -> DataFrame:
    """All columns of the kept copies, and the rows that identify no message. row_id must be unique and not null."""
    dups = copies(rows, keys, row_id, order).select(F.col("dup_id").alias(row_id))
    return rows.join(dups, row_id, "left_anti")


#: What identifies a pull-request message.
MESSAGE = ["m_owner", "m_name", "m_number", "m_at"]


def message_keys(pr: DataFrame, *more: Column) -> DataFrame:
    return pr.select("id", *more, folded("repo_owner").alias("m_owner"), folded("repo_name").alias("m_name"), F.col("pr_number").alias("m_number"), instant("event_created_at").alias("m_at"))


def message_copies(pr: DataFrame) -> DataFrame:
    """kept_id, dup_id of pr. The smallest id is kept: ids follow arrival, so the order is (id, id)."""
    return copies(message_keys(pr), MESSAGE, "id", delivery_order(F.col("id"), F.col("id")))


def first_deliveries(pr: DataFrame) -> DataFrame:
    """kept_id, n_copies of every message: the copy delivered first by ingested_at, ties going to the smaller id."""
    delivered = F.unix_micros("ingested_at")
    rows = message_keys(pr, F.greatest(delivered, F.lit(0)).alias("m_delivered"))
    return winners(rows, MESSAGE, "id", delivery_order(F.col("m_delivered"), F.col("id"))).select("kept_id", "n_copies")


def messages(pr: DataFrame) -> DataFrame:
    """pr with one row per message, all columns."""
    return pr.join(message_copies(pr).select(F.col("dup_id").alias("id")), "id", "left_anti")
