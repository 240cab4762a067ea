"""Command line: python -m upcurrent.cli COMMAND --data FOLDER [--out PATH] [options].

Every command reads the Parquet tables of a folder; results are written as Parquet, summaries as JSON or Markdown.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.paths import ECOSYSTEMS
from . import model
from .functions import classifiers
from .operators import alignment as al, diagnose as dg, discovery, enrich as en, gold, labels as lb, stats, store
from .plans import reports
from .sources import diffs, jsonl
from .sources.tables import scratch, table


def ecosystem_list(text: str) -> list[str]:
    """'npm,go' as a list without repeats; unknown names are an error."""
    names = list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    if not names or (bad := [n for n in names if n not in ECOSYSTEMS]):
        raise argparse.ArgumentTypeError(f"expected some of {', '.join(ECOSYSTEMS)}: {text}" if not names else f"unknown ecosystems: {', '.join(bad)}")
    return names


def targets(text: str) -> dict[str, int]:
    """'npm:50,go:10' as a mapping; a target is at least 1."""
    out = {}
    for part in text.split(","):
        name, _, n = part.partition(":")
        (eco,) = ecosystem_list(name)
        if not n.strip().isdigit() or int(n) < 1:
            raise argparse.ArgumentTypeError(f"expected ecosystem:number: {part}")
        out[eco] = int(n)
    return out


class Context:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.args.data, name)

    def optional(self, name: str) -> DataFrame:
        """A table that an earlier run may not have left yet."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.args.data}/{name}.parquet")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return model.reconcile(self.table(name), name) if there else model.empty(self.spark, name)

    def settled(self, df: DataFrame) -> DataFrame:
        """df written down once, so that what came from outside is not fetched again when it is used twice."""
        at = scratch(self.spark, "run")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def save_tables(self, **tables: DataFrame) -> None:
        """Each table under its name in the output folder, or shown."""
        for name, df in tables.items():
            if self.args.out:
                df.write.mode("errorifexists").parquet(f"{self.args.out}/{name}.parquet")
            else:
                df.show(20, truncate=40)

    def files(self) -> DataFrame:
        return self.table("pr").withColumn("files", dg.files_array("files_json"))

    def wide(self, complete: bool = True) -> DataFrame:
        return lb.wide_labels(self.table("classification"), self.args.version, complete)

    def rows(self) -> DataFrame:
        return al.contributing_rows(self.table("pr_change"), self.table("pr"), self.wide())

    def save(self, df: DataFrame) -> None:
        if self.args.out:
            df.write.mode("errorifexists").parquet(self.args.out)
        else:
            df.show(50, truncate=False)

    def report(self, parts: dict) -> dict:
        if self.args.out:
            return jsonl.write_report(parts, self.args.out)
        return {k: [r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}


def discover(c: Context) -> None:
    c.save(discovery.read_archive_day(c.spark, c.args.data, c.args.date, c.args.limit))


def enrich(c: Context) -> None:
    """The next pending pull requests from payloads recorded as <id>.json under --payloads."""
    pr = model.reconcile(c.table("pr"), "pr")
    todo = store.needs_enrichment(pr, c.args.limit).select("id", *discovery.KEY)
    call = en.recorded(c.args.payloads, lambda r: str(r["id"]))
    answers = c.settled(en.fetch(todo, call, ["id", *discovery.KEY], c.args.seconds, keep=c.args.stop_remaining))
    after, errors = en.enrich_run(pr, c.optional("pipeline_error"), answers, c.args.now, c.args.priority)
    c.save_tables(pr=after, pipeline_error=errors)


def fetch_closing_comments(c: Context) -> None:
    """Closing comments of closed pull requests from payloads recorded as <id>.json, and the bot comments that fit no pattern."""
    pr = c.table("pr")
    o = classifiers.outcome("state", "merged", "title", "body")
    old = c.optional("pr_closing_comment")
    open_ = pr.select("id", o["label"].alias("outcome_titlebody")).join(old.select(F.col("pr_id").alias("id"), F.lit("earlier").alias("closing_comments_fetched_at")).distinct(), "id", "left")
    todo = store.needs_comments(open_).select("id").orderBy("id")
    answers = c.settled(en.fetch(todo if c.args.limit is None else todo.limit(c.args.limit), en.recorded(c.args.payloads, lambda r: str(r["id"])), ["id"], c.args.seconds, keep=c.args.stop_remaining))
    done = answers.where("status = 'done'").select(F.col("id").alias("pr_id"), "payload")
    c.save_tables(pr_closing_comment=store.replace_comments(old, en.closing_comments(done, fetched_at=c.args.now), done))


def unmatched(c: Context) -> None:
    found = lb.unmatched_bot_comments(c.table("pr_change"), c.table("classification"), lb.ordered_comments(c.optional("pr_closing_comment")))
    print(json.dumps(c.report({"unmatched": found}), indent=2, sort_keys=True, default=str))


def parse(c: Context) -> None:
    """The changes in a folder of diffs; with --tables the tables after the run: changes numbered on, pull requests attempted, errors left or cleared."""
    found = diffs.diff_changes(diffs.read_diffs(c.spark, c.args.data))
    if not c.args.tables:
        return c.save(found)
    c.args.data = c.args.tables
    change = c.table("pr_change")
    last = change.agg(F.coalesce(F.max("change_id"), F.lit(0))).scalar()
    numbered = store.number_changes(found.where("error IS NULL"), c.spark.range(1).select(last.alias("n")).first()["n"]).unionByName(found.where("error IS NOT NULL"), allowMissingColumns=True)
    pr, change, errors = en.parse_run(model.reconcile(c.table("pr"), "pr"), change, c.optional("pipeline_error"), c.settled(numbered), c.args.now)
    return c.save_tables(pr=pr, pr_change=change, pipeline_error=errors)


def pending(c: Context) -> None:
    c.save(store.needs_parsing(c.table("pr"), c.table("pr_change"), c.args.include_deferred))


def classify(c: Context) -> None:
    """Labels of the changes that lack some; with --force all of these dimensions anew, the table that then stands and the flips."""
    dims = lb.selected_dimensions(c.args.dimensions.split(",") if c.args.dimensions else None)
    comments = c.optional("pr_closing_comment")
    if c.args.force:
        labels, flips = lb.relabel(c.table("pr_change"), c.files(), c.table("classification"), dims, c.args.version, comments)
        print(json.dumps({"flips": [r.asDict() for r in flips.orderBy("dimension", "old_label", "new_label").collect()]}, indent=2))
        return c.save(labels)
    todo = lb.missing_labels(c.table("pr_change"), c.table("classification"), dims, c.args.version)
    return c.save(lb.long_labels(lb.classify(todo, c.files(), comments, dims), dims, c.args.version))


def compute_alignment(c: Context) -> None:
    c.save(al.alignment(al.hosted(c.rows())))


def summarize_alignment(c: Context) -> None:
    print(json.dumps(c.report({"summary": al.summary(c.rows())}), indent=2, sort_keys=True, default=str))


def check_targets(c: Context) -> None:
    print(json.dumps(c.report({"targets": al.targets_met(al.alignment(al.hosted(c.rows())), c.args.targets)}), indent=2, default=str))


def diagnose(c: Context) -> None:
    pr, change, cl = (c.table(t) for t in ("pr", "pr_change", "classification"))
    parts = {
        "ecosystem_counts": dg.ecosystem_counts(pr, change), "files_per_pr": dg.file_bins(pr), "next_page": dg.next_page_fraction(pr), "actions": dg.action_counts(pr), "group_sizes": dg.group_size_bins(change, pr, cl, c.args.version),
        "weighted": dg.pr_and_change_weighted(change, pr, cl, c.args.version), "consistency": dg.consistency(change, pr, cl, c.args.version), "repeated_triples": dg.repeated_triples(change, pr), "stages": dg.stage_counts(pr, change, cl, c.optional("pipeline_error")),
    }
    out = c.report(parts)
    out["weighted"] = reports.percentages(reports.percentages(out["weighted"], "n_prs", ["dimension"]), "n_changes", ["dimension"])
    print(json.dumps(out, indent=2, sort_keys=True, default=str))


def effects(c: Context) -> None:
    w, keys = c.wide(complete=False), ["dimension", "stratifier", "unit"]
    cells = stats.cells(stats.pr_records(c.table("pr_change"), c.table("pr"), w), stats.change_records(c.table("pr_change"), w))
    got = c.report({"overall": stats.cramers_v(cells, keys), "intervals": stats.bootstrap_v(cells, keys, c.args.resamples), "pairwise": stats.pairwise_v(cells), "excluded": stats.excluded_levels(cells)})
    print(reports.effects_markdown(got["overall"], got["intervals"], got["pairwise"]))


def strata(c: Context) -> None:
    a = al.alignment(al.hosted(c.rows()))
    got = c.report({"strata": stats.strata(a, c.args.least), "intervals": stats.strata_intervals(a, c.args.least, c.args.resamples), "correlations": stats.correlations(a, c.args.least), "correlation_intervals": stats.correlation_intervals(a, c.args.least, c.args.resamples)})
    print(reports.strata_markdown(got["strata"], got["intervals"]))


def gold_summary(c: Context) -> None:
    rows = jsonl.read_jsonl(c.spark, c.args.data)
    wrong = gold.validate(rows).where(F.size("errors") > 0).select("pr_id", "errors").limit(20)
    print(json.dumps(c.report({"summary": gold.summary(rows), "invalid": wrong}), indent=2, default=str))


COMMANDS = {f.__name__.replace("_", "-"): f for f in (discover, enrich, fetch_closing_comments, unmatched, parse, pending, classify, compute_alignment, summarize_alignment, check_targets, diagnose, effects, strata, gold_summary)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="upcurrent", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--data", required=True)
    p.add_argument("--out")
    p.add_argument("--date", default="")
    p.add_argument("--limit", type=int)
    p.add_argument("--version", type=int, default=1)
    p.add_argument("--dimensions")
    p.add_argument("--force", action="store_true")
    p.add_argument("--include-deferred", action="store_true")
    p.add_argument("--targets", type=targets, default=dict.fromkeys(ECOSYSTEMS, 1))
    p.add_argument("--resamples", type=int, default=stats.RESAMPLES)
    p.add_argument("--least", type=int, default=5)
    p.add_argument("--payloads", help="folder of recorded payloads")
    p.add_argument("--tables", help="folder of the tables a parse run updates")
    p.add_argument("--priority", type=ecosystem_list)
    p.add_argument("--seconds", type=float, help="stop fetching after so long")
    p.add_argument("--stop-remaining", type=int, default=100)
    p.add_argument("--now", default=datetime.now(timezone.utc).isoformat(), help="the time the run notes")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command](Context(spark or SparkSession.builder.appName("upcurrent").getOrCreate(), args))


if __name__ == "__main__":
    main()
