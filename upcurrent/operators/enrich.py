"""From fetched pull-request payloads to columns.

The payload is parsed once with a schema and flattened inside the JVM. Fetching itself is a pluggable function that maps batches of keys to
payload texts; it runs on the executors with retry and a budget per task.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths
from ..functions.text import col
from .discovery import KEY
from .store import append_errors, delete_parse_errors, mark, update_enrichment

MAX_FILES, PAGE_FILES, BATCH, COMMENTS = 500, 100, 25, 15
_PAGE = "pageInfo:struct<hasNextPage:boolean,endCursor:string,capExceeded:boolean>"
PAYLOAD = f"""createdAt string, title string, body string, author struct<login:string,__typename:string>, merged boolean, state string, closedAt string, mergedAt string,
additions int, deletions int, baseRefOid string, headRefOid string, isCrossRepository boolean,
repository struct<isFork:boolean,isArchived:boolean,object:struct<oid:string>>,
commits struct<nodes:array<struct<commit:struct<message:string>>>,{_PAGE}>,
files struct<nodes:array<struct<path:string,additions:int,deletions:int>>,{_PAGE}>"""


def manifest_filter(files: Column | str, next_page: Column | str, cap: Column | str) -> Column:
    """struct(passes, reason, files, manifests, others): whether only manifests changed, and if not, the first reason of several."""
    f = col(files)
    n, m = F.size(f), F.size(F.filter(f, lambda x: paths.is_manifest(x["path"])))
    more, capped = F.coalesce(col(next_page), F.lit(False)), F.coalesce(col(cap), F.lit(False))
    passes = (m > 0) & (m == n) & ~more & ~capped
    reason = F.when(passes, "passed").when(capped, "too_many_files_cap").when(more, "too_many_files").when(m == 0, "no_manifest_files").when(m < n, "mixed_manifest_and_non_manifest_files").otherwise("other")
    return F.struct(passes.alias("passes"), reason.alias("reason"), n.alias("files"), m.alias("manifests"), (n - m).alias("others"))


def parse_priority(files: Column | str, passes: Column, targets: list[str]) -> Column:
    """priority where an ecosystem of the files is a target, else deferred_non_priority; null where the filter is not passed."""
    hit = F.arrays_overlap(paths.ecosystems(files), F.array(*map(F.lit, targets)).cast("array<string>"))
    return F.when(passes, F.when(F.coalesce(hit, F.lit(False)), "priority").otherwise("deferred_non_priority"))


def flatten_payload(rows: DataFrame, payload: str = "payload", targets: list[str] | None = None) -> DataFrame:
    """rows with the enrichment columns in place of the payload text. Files without a path and empty commit messages fall out."""
    p = F.col("__p")
    nodes = lambda x: F.coalesce(x["nodes"], F.array())
    out = rows.withColumn("__p", F.from_json(payload, PAYLOAD))
    out = out.withColumn("files", F.filter(nodes(p["files"]), lambda f: F.coalesce(f["path"] != "", F.lit(False))))
    info = p["files"]["pageInfo"]
    out = out.withColumn("__m", manifest_filter("files", info["hasNextPage"], info["capExceeded"]))
    messages = F.filter(F.transform(nodes(p["commits"]), lambda c: c["commit"]["message"]), lambda m: F.coalesce(m != "", F.lit(False)))
    plain = {"pr_created_at": "createdAt", "title": "title", "body": "body", "state": "state", "merged": "merged", "merged_at": "mergedAt", "closed_at": "closedAt", "additions": "additions", "deletions": "deletions", "base_sha": "baseRefOid", "head_sha": "headRefOid", "is_cross_repository": "isCrossRepository"}
    no = F.lit(False)
    columns = {k: p[v] for k, v in plain.items()} | {
        "author_login": p["author"]["login"],
        "author_type": p["author"]["__typename"],
        "is_fork": p["repository"]["isFork"],
        "is_archived": p["repository"]["isArchived"],
        "root_commit_sha": p["repository"]["object"]["oid"],
        "commit_messages_concat": F.array_join(messages, "\n---\n"),
        "commits_truncated": F.coalesce(p["commits"]["pageInfo"]["hasNextPage"], no),
        "passes_manifest_only_filter": F.col("__m.passes"),
        "files_has_next_page": F.coalesce(info["hasNextPage"], no),
        "file_count": F.col("__m.files"),
        "manifest_file_count": F.col("__m.manifests"),
        "non_manifest_file_count": F.col("__m.others"),
        "manifest_filter_reason": F.col("__m.reason"),
    }
    if targets is not None:
        columns["parse_priority"] = parse_priority("files", F.col("__m.passes"), targets)
    return out.withColumns(columns).drop("__p", "__m", payload)


def merge_pages(pages: list[list[dict]], has_next: bool) -> tuple[list[dict], bool, bool]:
    """Files of all pages up to MAX_FILES, whether there are more, and whether the cap cut them."""
    nodes = [n for page in pages for n in page]
    capped = has_next and len(nodes) >= MAX_FILES
    return nodes[:MAX_FILES], has_next or len(nodes) > MAX_FILES, capped


class Budget:
    """Stops a task's fetching when the remaining calls or the time run low; every task holds its own share."""

    def __init__(self, calls: int | None = None, seconds: float | None = None, keep: int = 100):
        self.calls, self.seconds, self.keep, self.began = calls, seconds, keep, time.monotonic()

    def spent(self, remaining: int | None = None) -> bool:
        if remaining is not None:
            self.calls = remaining
        return (self.calls is not None and self.calls < self.keep) or (self.seconds is not None and time.monotonic() - self.began >= self.seconds)


#: What an answer's error of this kind leaves as the filter's reason.
REASONS = {"NOT_FOUND": "graphql_not_found"}
OTHER_REASON = "graphql_error"


def filter_reason_of(error: str) -> str:
    return REASONS.get(error, OTHER_REASON)


#: What a call gives for a batch of key rows: for each its payload and the answer's error type, and the calls that remain, where it knows.
Answer = tuple[list[tuple[str | None, str | None]], int | None]


def fetch(rows: DataFrame, call: Callable[[list[dict]], Answer], keys: list[str], seconds: float | None = None, pause: float = 5.0, keep: int = 100, more: Callable[[dict, str], Answer] | None = None) -> DataFrame:
    """keys, payload, error, status. call maps at most BATCH key rows to their answers.

    A call that raises is tried once more after a pause, then its rows stay pending with the kind of failure; rows an answer calls
    wrong are failed and count as attempted; rows after the budget ran out, by time or by fewer than keep remaining calls, are pending without an
    error. more(row, cursor) gives a further page of files of one row: pages are added until there are no more or MAX_FILES are reached, and a row
    whose page fails stays pending.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", payload string, error string, status string"

    def twice(f: Callable[[], Answer]) -> Answer:
        try:
            return f()
        except Exception:  # noqa: BLE001 - the network may fail in any way
            time.sleep(pause)
            return f()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = Budget(seconds=seconds, keep=keep)
        for pdf in batches:
            for k in range(0, len(pdf), BATCH):
                part = pdf.iloc[k : k + BATCH].reset_index(drop=True)
                records = part.to_dict("records")
                out: list[tuple[str | None, str | None, str]] = [(None, None, "pending")] * len(part)
                if not budget.spent():
                    try:
                        answers, left = twice(lambda: call(records))
                        budget.spent(left)
                        out = [(p, e, "failed" if e else "done") for p, e in answers]
                        if more:
                            out = [_all_files(r, *x, more, twice, budget) if x[2] == "done" else x for r, x in zip(records, out)]
                    except Exception as e:  # noqa: BLE001
                        out = [(None, type(e).__name__, "pending")] * len(part)
                payload, error, status = zip(*out)
                yield part.assign(payload=list(payload), error=list(error), status=list(status))

    return rows.select(*keys).mapInPandas(run, schema)


def _all_files(row: dict, payload: str | None, error: str | None, status: str, more: Callable[[dict, str], Answer], twice: Callable, budget: Budget) -> tuple[str | None, str | None, str]:
    """The answer with all pages of its files; pending where a page fails or the budget ends before the last one."""
    doc = json.loads(payload) if payload else {}
    files = doc.get("files") or {}
    info, pages = files.get("pageInfo") or {}, [files.get("nodes") or []]
    while info.get("hasNextPage") and sum(map(len, pages)) < MAX_FILES:
        if budget.spent():
            return None, None, "pending"
        try:
            (answer,), left = twice(lambda: more(row, info.get("endCursor")))  # noqa: B023
        except Exception as e:  # noqa: BLE001
            return None, type(e).__name__, "pending"
        budget.spent(left)
        if answer[1]:
            return None, answer[1], "pending"
        page = (json.loads(answer[0]) or {}).get("files") or {}
        pages.append(page.get("nodes") or [])
        info = page.get("pageInfo") or {}
    if len(pages) == 1 and not info.get("hasNextPage"):
        return payload, error, status
    nodes, next_page, capped = merge_pages(pages, bool(info.get("hasNextPage")))
    doc["files"] = {"nodes": nodes, "pageInfo": {"hasNextPage": next_page, "capExceeded": capped}}
    return json.dumps(doc), error, status


def recorded(folder: str, name: Callable[[dict], str]) -> Callable[[list[dict]], Answer]:
    """A call that answers from recorded payloads, one JSON file a row; a row without one is not found."""

    def call(rows: list[dict]) -> Answer:
        out: list[tuple[str | None, str | None]] = []
        for r in rows:
            path = os.path.join(folder, name(r) + ".json")
            out.append((open(path, encoding="utf-8").read(), None) if os.path.exists(path) else (None, "NOT_FOUND"))
        return out, None

    return call


def enrich_run(pr: DataFrame, errors: DataFrame, answers: DataFrame, at: str, targets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pull-request and error tables after a run. answers: what fetch gave for id and the natural key, written down first.

    Done rows get their columns and enriched_at, failed ones the reason and enriched_at, as they were attempted; pending ones stay, those
    with a failure leave an error each.
    """
    done = flatten_payload(answers.where("status = 'done'").select("id", "payload"), targets=targets).withColumn("enriched_at", F.lit(at))
    failed = answers.where("status = 'failed'").select("id", F.when(F.col("error").isin(*REASONS), F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))[F.col("error")]).otherwise(OTHER_REASON).alias("manifest_filter_reason"), F.lit(False).alias("passes_manifest_only_filter"), F.lit(at).alias("enriched_at"))
    after = update_enrichment(update_enrichment(pr, done), failed)
    wrong = answers.where("error IS NOT NULL").select(F.lit("enrich").alias("stage"), *KEY, F.when(F.col("status") == "failed", F.col("error")).otherwise("network_or_http").alias("error_type"), F.col("error").alias("message"), F.lit(at).alias("created_at"))
    return after, append_errors(errors, wrong)


def parse_run(pr: DataFrame, change: DataFrame, errors: DataFrame, parsed: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of pull requests, changes and errors after parsed, what diffs.diff_changes gave for a run's diffs, with pr_id being id.

    Each pull request counts as attempted. One whose diff failed leaves an error and no change; one that succeeded loses its earlier errors.
    """
    bad, good = parsed.where("error IS NOT NULL"), parsed.where("error IS NULL")
    named = pr.select(F.col("id").alias("pr_id"), *KEY)
    after = mark(pr, parsed.select(F.col("pr_id").alias("id")), "parse_attempted_at", at)
    columns = [c for c in change.columns if c in parsed.columns]
    rest = delete_parse_errors(errors, named.join(good.select("pr_id").distinct(), "pr_id", "left_semi"))
    new = bad.join(named, "pr_id").select(F.lit("parse").alias("stage"), *KEY, F.substring_index("error", ":", 1).alias("error_type"), F.col("error").alias("message"), F.lit(at).alias("created_at"))
    return after, change.unionByName(good.select(*columns), allowMissingColumns=True), append_errors(rest, new)


def until_met(batches: Iterator[DataFrame], step: Callable[[DataFrame], int], met: Callable[[], bool], every: int = 2000, said: Callable[[int], None] | None = None) -> int:
    """Runs step on batches of pending rows until met, which is asked after the first batch and then for every so many rows; the rows processed.

    step returns how many rows it processed, said hears of the progress.
    """
    n, next_check = 0, 0
    for batch in batches:
        n += step(batch)
        if said:
            said(n)
        if n >= next_check:
            if met():
                break
            next_check = n + every
    return n


COMMENTS_PAYLOAD = "comments struct<nodes:array<struct<author:struct<login:string,__typename:string>,body:string,createdAt:string>>>"


def closing_comments(rows: DataFrame, payload: str = "payload", fetched_at: str | None = None) -> DataFrame:
    """pr_id and a row for each of the payload's last COMMENTS comments, in the order of their table. rows: pr_id, payload.

    Ids follow (pr_id, place), so that sorting by (created_at, id) keeps the payload's order among equal times. Unreadable payloads give none.
    """
    nodes = F.coalesce(F.from_json(payload, COMMENTS_PAYLOAD)["comments"]["nodes"], F.array())
    last = F.slice(nodes, F.greatest(F.size(nodes) - COMMENTS + 1, F.lit(1)), COMMENTS)
    each = rows.select("pr_id", F.posexplode(last).alias("place", "c"))
    at = F.lit(fetched_at) if fetched_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return each.select((F.col("pr_id") * COMMENTS + F.col("place")).alias("id"), "pr_id", F.col("c.author.login").alias("author_login"), F.col("c.author.__typename").alias("author_type"), F.col("c.body").alias("body"), F.col("c.createdAt").alias("created_at"), at.alias("fetched_at"))
