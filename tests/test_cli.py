"""The command line over the smallest tables."""

import argparse
import json
import os

import pytest

from upcurrent import cli

DATA = "/root/testdata/sf0.001"


def test_option_parsers():
    assert cli.ecosystem_list("npm, go,npm") == ["npm", "go"] and cli.targets("npm:5,go:1") == {"npm": 5, "go": 1}
    for bad in ("", "perl", "npm:0", "npm:x"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.targets(bad)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
@pytest.mark.parametrize("command", ["pending", "summarize-alignment", "diagnose", "effects", "strata", "check-targets"])
def test_commands(spark, capsys, command):
    cli.main([command, "--data", DATA, "--resamples", "50", "--least", "2"], spark)
    assert capsys.readouterr().out.strip()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_classify_writes_what_is_missing(spark, tmp_path):
    out = str(tmp_path / "labels")
    cli.main(["classify", "--data", DATA, "--version", "2", "--dimensions", "source,outcome", "--out", out], spark)
    got = spark.read.parquet(out)
    assert {r.dimension for r in got.select("dimension").distinct().collect()} == {"source", "outcome"} and got.columns == ["change_id", "dimension", "label", "classifier_version"]


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_runs_read_what_earlier_runs_left(spark, tmp_path, capsys):
    data, payloads = tmp_path / "data", tmp_path / "payloads"
    data.mkdir(), payloads.mkdir()
    for name in ("pr", "pr_change", "classification"):
        os.symlink(f"{DATA}/{name}.parquet", data / f"{name}.parquet")
    todo = [r.id for r in spark.read.parquet(f"{DATA}/pr.parquet").where("enriched_at IS NULL").orderBy("event_created_at", "id").select("id").limit(3).collect()]
    (payloads / f"{todo[0]}.json").write_text(json.dumps({"title": "from a payload", "files": {"nodes": [{"path": "go.mod"}]}}))
    cli.main(["enrich", "--data", str(data), "--payloads", str(payloads), "--limit", "3", "--now", "later", "--out", str(tmp_path / "e")], spark)
    after = {r.id: r for r in spark.read.parquet(str(tmp_path / "e/pr.parquet")).where("enriched_at = 'later'").collect()}
    assert set(after) == set(todo) and after[todo[0]].title == "from a payload" and after[todo[1]].manifest_filter_reason == "graphql_not_found"
    assert spark.read.parquet(str(tmp_path / "e/pipeline_error.parquet")).count() == 2

    closed = [r.id for r in spark.read.parquet(f"{DATA}/pr.parquet").where("lower(state) = 'closed' AND NOT coalesce(merged, false)").select("id").collect()]
    for i in closed:
        (payloads / f"{i}.json").write_text(json.dumps({"comments": {"nodes": [{"author": {"login": "dependabot[bot]"}, "body": "Superseded by #7." if i == closed[0] else "No words", "createdAt": "2025-01-01"}]}}))
    cli.main(["fetch-closing-comments", "--data", str(data), "--payloads", str(payloads), "--out", str(tmp_path / "c")], spark)
    os.symlink(tmp_path / "c/pr_closing_comment.parquet", data / "pr_closing_comment.parquet")
    assert spark.read.parquet(str(data / "pr_closing_comment.parquet")).count() == len(closed)
    cli.main(["fetch-closing-comments", "--data", str(data), "--payloads", str(payloads), "--limit", "5"], spark)  # nothing is fetched twice
    capsys.readouterr()
    cli.main(["unmatched", "--data", str(data)], spark)
    assert "unmatched" in json.loads(capsys.readouterr().out)
    cli.main(["classify", "--data", str(data), "--force", "--dimensions", "outcome", "--out", str(tmp_path / "l")], spark)
    assert "flips" in json.loads(capsys.readouterr().out)
    labels = spark.read.parquet(str(tmp_path / "l"))
    first = spark.read.parquet(f"{DATA}/pr_change.parquet").where(f"pr_id = {closed[0]}").select("change_id")
    got = {r.label for r in labels.where("dimension = 'outcome' AND classifier_version = 1").join(first, "change_id").collect()}
    assert got <= {"superseded"} and labels.where("classifier_version = 2").count() > 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_parse_run_updates_the_tables(spark, tmp_path):
    pr = spark.read.parquet(f"{DATA}/pr.parquet").limit(2).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / f"{pr[0].id}.diff").write_text("--- a/go.mod\n+++ b/go.mod\n@@ -1 +1 @@\n-require a v1\n+require a v2\n")
    (tmp_path / "d" / f"{pr[1].id}.diff").write_text("@@ -1 +1 @@\n-a\n+b\n")
    cli.main(["parse", "--data", str(tmp_path / "d"), "--tables", DATA, "--now", "later", "--out", str(tmp_path / "o")], spark)
    read = lambda name: spark.read.parquet(str(tmp_path / f"o/{name}.parquet"))
    old = spark.read.parquet(f"{DATA}/pr_change.parquet")
    new = read("pr_change").join(old, "change_id", "left_anti").collect()
    assert [(r.pr_id, r.package, r.change_id) for r in new] == [(pr[0].id, "a", old.agg({"change_id": "max"}).first()[0] + 1)]
    assert {r.id for r in read("pr").where("parse_attempted_at = 'later'").collect()} == {pr[0].id, pr[1].id}
    assert [r.error_type for r in read("pipeline_error").collect()] == ["ValueError"]
