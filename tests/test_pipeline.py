"""Labels, alignment, diagnostics, statistics, the store, enrichment, the hand-labelled set and streaming."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upcurrent import model
from upcurrent.functions import classifiers, comments, paths, versions
from upcurrent.operators import alignment as al, diagnose as dg, discovery, enrich, gold, labels as lb, stats, store
from upcurrent.plans import pipeline_queries, reports
from upcurrent.sources import diffs, jsonl
from upcurrent.streaming.first_event import append_new, first_events_stream


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, a {kind}" + (f", b {kind}" if isinstance(values[0], tuple) and len(values[0]) > 1 else "") + (f", c {kind}" if isinstance(values[0], tuple) and len(values[0]) > 2 else ""))
    return [r[0] for r in df.orderBy("i").select(make.alias("x")).collect()]


TIERS = [("1.2.3", "2.0.0", "major"), ("1.2.3", "1.3.0", "minor"), ("v1.2.3", "1.2.4", "patch"), ("^1.2", "~1.2", "unknown"), (None, "1.0", "unknown"), ("abc", "1.0", "unknown"), ("2024.1", "2024.2", "calver"), ("1.0.0-rc.1", "1.0.0", "prerelease"), ("a" * 40, "1.0", "sha-pin"), ("1.0.dev3", "1.1", "minor"), ("1" * 30 + ".0", "2.0", "major"), ("release-5", "release-6", "prerelease"), ("build5", "build6", "major"), ("", "", "unknown"), ("01.2", "1.2.0", "unknown")]


def test_semver(spark):
    assert column(spark, [t[:2] for t in TIERS], versions.semver_tier("a", "b")) == [t[2] for t in TIERS]
    assert column(spark, [(" '>= 1.0' ",), ("==~1",), (None,)], versions.normalise_version("a")) == ["1.0", "1", None]
    keys = column(spark, [("1.10",), ("1.9",), ("1.9.0a",)], versions.version_key("a"))
    assert keys[0] > keys[1]


SOURCES = [("dependabot[bot]", None, None, "dependabot"), (None, "renovate-bot", None, "renovate"), ("x", "me", "Bot", "other-bot"), ("ci[bot]", "", None, "other-bot"), ("dependabot", "me", None, "human"), (None, None, None, "human"), ("snyk-bot", None, None, "other-bot"), ("notdependabot", None, None, "human")]


def test_sources_security_and_paths(spark):
    assert column(spark, [s[:3] for s in SOURCES], classifiers.source("a", "b", "c")) == [s[3] for s in SOURCES]
    assert column(spark, [("Fix CVE-2024-1234", None, None), (None, "ghsa-aaaa-bbbb-1234", ""), (None, None, None)], classifiers.security("a", "b", "c")) == ["security", "security", "non-security"]
    files = ["pom.xml", "a/build.gradle.kts", "x/package.json", "Cargo.lock", "requirements/dev.txt", "app/requirements/dev.txt", "w\\requirements-x.txt", "go.sum", "README.md", "", None]
    assert column(spark, [(f,) for f in files], paths.ecosystem("a")) == ["maven", "maven", "npm", "cargo", "pip", None, "pip", "go", None, None, None]
    assert column(spark, [("a/b",), ("/dev/null",), ("c/d",)], paths.strip_diff_path("a")) == ["b", "/dev/null", "c/d"]


def test_mentions(spark):
    cases = [("my-lib", "bump my_lib to 2", None, True), ("g:art", None, "Art was updated", True), ("lib", "my-lib only", "lib-x lib/y", False), ("a.b+c", "an a.b+c here", None, True), ("x", None, None, False), ("", "anything", None, False)]
    assert column(spark, [c[:3] for c in cases], classifiers.mentions("a", "b", "c")) == [c[3] for c in cases]


def test_outcomes(spark):
    df = spark.createDataFrame([("MERGED", True, "", None), ("open", False, None, None), ("CLOSED", False, "superseded by #4", "x"), ("closed", None, "", "comment_grouped"), ("closed", None, None, None), (None, None, None, None)], "s string, m boolean, t string, r string")
    o = classifiers.outcome("s", "m", "t", F.lit(None).cast("string"), "r")
    assert [tuple(r[0]) for r in df.select(o).collect()] == [("merged", None), ("open", None), ("superseded", "title_body"), ("superseded", "comment_grouped"), ("closed-unmerged", None), ("unknown", None)]


def test_comments_and_unmatched(spark, rows):
    c = [
        (1, 1, "dependabot[bot]", None, "Superseded by #9", "2025-01-01"), (2, 1, "dependabot[bot]", None, "Looks like this is up-to-date now", "2025-01-02"), (3, 1, "human", "User", "superseded by #3", "2025-01-03"),
        (4, 2, "renovate[bot]", None, "Renovate will\nnot close. Won't notify you again about this release", "2025-01-01"), (5, 2, "renovate[bot]", None, "Autoclosing this PR", None), (6, 3, "ci", "Bot", "hello", "2025-01-01"), (7, None, "x", None, None, None),
    ]
    t = spark.createDataFrame(c, "id bigint, pr_id bigint, author_login string, author_type string, body string, created_at string")
    o = lb.ordered_comments(t)
    got = {r.pr_id: r.m for r in o.select("pr_id", comments.supersession("comments").alias("m")).collect()}
    assert got[1].pattern_name == "dependabot_up_to_date_now" and got[2].reason == "comment_grouped" and got[3] is None and set(got) == {1, 2, 3}
    flat = {r.pr_id: (r.reason, r.pattern_name, r.comment_text, r.created_at) for r in lb.supersessions(t).collect()}
    assert flat == {i: (got[i].reason, got[i].pattern_name, got[i].comment_text, got[i].created_at) for i in (1, 2)}
    text = json.dumps([{"author_login": "dependabot[bot]", "body": "no longer needed"}, None])
    parsed = column(spark, [(text,), ("nonsense",), (None,), ("{}",), ("[1,")], F.size(comments.parse_comments("a")))
    assert parsed[0] >= 1 and parsed[1:] == [0, 0, 0, 0]
    change = spark.createDataFrame([(10, 3), (11, 1)], "change_id bigint, pr_id bigint")
    cl = spark.createDataFrame([(10, "outcome", "closed-unmerged", 1), (11, "outcome", "closed-unmerged", 1)], "change_id bigint, dimension string, label string, classifier_version int")
    out = lb.unmatched_bot_comments(change, cl, o).collect()
    assert [(r.bot_family, r.n, r.samples[0].pr_id) for r in out] == [("other-bot", 1, 3)]
    assert column(spark, [("x" * 600,), ("ab",)], comments.shown("a")) == ["x" * 500 + "...[truncated]", "ab"]


PRS = "id bigint, repo_owner string, repo_name string, event_created_at string, is_fork boolean, is_archived boolean"


def aligned(spark, data):
    """data: (project, outcome, time, group size, fork, source, tier, security) for one triple."""
    pr = spark.createDataFrame([(i, "o", d[0], d[2], d[4], None) for i, d in enumerate(data)], PRS)
    change = spark.createDataFrame([(i, i, "npm", "p", None, "2", d[3]) for i, d in enumerate(data)], "change_id bigint, pr_id bigint, ecosystem string, package string, from_version string, to_version string, group_size int")
    cl = [(i * 5 + k, i, n, v, 1) for i, d in enumerate(data) for k, (n, v) in enumerate((("source", d[5]), ("semver_tier", d[6]), ("security", d[7]), ("direct_transitive", "direct"), ("outcome", d[1])))]
    cl = spark.createDataFrame(cl, "classification_id bigint, change_id bigint, dimension string, label string, classifier_version int")
    return al.contributing_rows(change, pr, lb.wide_labels(cl))


def test_alignment_of_one_triple(spark):
    rows = aligned(
        spark,
        [
            ("a", "merged", "2025-01-01", 1, None, "human", "minor", "security"),
            ("a", "closed-unmerged", "2025-01-02", 2, False, "renovate", "major", "non-security"),  # the later decision counts
            ("b", "merged", "2025-01-01", None, None, "human", "major", "security"),
            ("c", "merged", None, 0, None, "human", "minor", "security"),
            ("d", "open", "2025-01-01", 9, None, "human", "minor", "security"),
            ("d", "superseded", "2025-01-03", 9, None, "human", "minor", "security"),
            ("a", "open", "2025-01-09", 9, None, "human", "minor", "security"),
            ("e", "unknown", "2025-01-01", 9, None, "human", "minor", "security"),
            ("f", "merged", "2025-01-01", 9, True, "human", "minor", "security"),
        ],
    )
    (r,) = al.alignment(al.hosted(rows)).collect()
    assert (r.k_projects_all, r.k_projects_decided, r.k_changes, r.k_changes_total) == (5, 3, 4, 8)
    assert (r.n_merged, r.n_closed_unmerged, r.n_open, r.n_superseded) == (2, 1, 0, 1)
    assert (r.semver_tier, r.source_mix, r.is_security_any, r.is_security_all) == ("major", "mixed_bot_human", 1, 0)
    assert (r.mean_group_size, r.median_group_size, r.max_group_size, r.all_singleton) == (1.25, 1.0, 2, 0)
    h = -(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(2)
    assert r.alignment == pytest.approx(1 - h, abs=1e-9)
    s = al.summary(rows).collect()[0]
    assert (s.triples_total, s.triples_k_ge_3, s.triples_k_ge_5, s.open_change_rows_excluded, s.superseded_change_rows_excluded, s.fork_or_archived_change_rows_excluded_npm) == (1, 1, 0, 2, 1, 1)
    assert {(r.ecosystem, r.met) for r in al.targets_met(al.alignment(al.hosted(rows)), {"npm": 1, "go": 0}, 3).collect()} == {("npm", True), ("go", True)}


def test_alignment_of_nothing(spark):
    rows = aligned(spark, [("a", "open", None, 1, None, "human", "minor", "security")])
    assert al.alignment(rows).count() == 0
    s = al.summary(rows).collect()[0]
    assert (s.triples_total, s.triples_dropped_zero_decided, s.triples_dropped_only_superseded) == (0, 1, 0)
    assert al.summary(rows.limit(0)).collect()[0].non_decision_change_rows_excluded == 0


def test_bins(spark):
    assert column(spark, [(n,) for n in (None, 0, 1, 5, 6, 25, 26, 51)], dg.group_size_bin("a"), "int") == ["unknown", "unknown", "1", "5", "6-10", "11-25", "26-50", ">50"]
    assert column(spark, [(0,), (3,), (300,)], dg.file_bin("a", F.lit(9), F.lit(False)), "int") == [None, "3", "51-100"]
    assert column(spark, [(3,)], dg.file_bin("a", F.lit(9), F.lit(True)), "int") == [">100"]


def cells(spark, table, row=("maven", "npm"), col=("direct", "transitive")):
    data = [("direct_transitive", "ecosystem", "change", row[i], col[j], n) for i, r in enumerate(table) for j, n in enumerate(r)]
    return spark.createDataFrame(data, "dimension string, stratifier string, unit string, row string, col string, n bigint")


@pytest.mark.parametrize(("table", "v"), [([[50, 0], [0, 50]], 1.0), ([[25, 25], [25, 25]], 0.0), ([[10, 20], [0, 0]], 0.0), ([[30, 10], [20, 40]], None)])
def test_cramers_v(spark, table, v):
    keys = ["dimension", "stratifier", "unit"]
    want = stats.table_v(np.array(table)) if v is None else v
    assert stats.cramers_v(cells(spark, table), keys).collect()[0].v == pytest.approx(want, abs=1e-8)
    if v is None:
        b = stats.bootstrap_v(cells(spark, table), keys, 500).collect()[0]
        assert b.ci_lo < want < b.ci_hi
        p = stats.pairwise_v(cells(spark, table)).collect()
        assert [(x.a, x.b, x.n_a, x.n_b, x.substantive) for x in p] == [("maven", "npm", 40, 60, True)]
        assert stats.pairwise_v(cells(spark, table), 50).count() == 0 and stats.excluded_levels(cells(spark, table), 50).collect()[0].level == "maven"


def test_ranks_strata_and_correlations(spark, rows):
    ranks = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), ("s", 3, 2)], "k string, v int, n bigint")
    assert rows(stats.average_rank(ranks, "v", ["k"]).select("v", "rank")) == [(1, 1.0), (2, 2.5), (3, 4.5)]
    rng = np.random.default_rng(1)
    x = rng.integers(1, 5, 60)
    y = np.round(x / 10 + rng.integers(0, 3, 60) / 10, 1)
    data = [("npm" if i % 2 else "go", "minor", i % 3 == 0, "all_human", float(b), float(a), 6) for i, (a, b) in enumerate(zip(x, y))]
    t = spark.createDataFrame(data, "ecosystem string, semver_tier string, is_security_any boolean, source_mix string, alignment double, mean_group_size double, k_projects_decided bigint").withColumn("is_security_any", F.col("is_security_any").cast("int"))
    c = {r.scope: r for r in stats.correlations(t).collect()}
    assert c["all"].pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-5) and c["npm"].n == 30
    ci = {r.scope: r for r in stats.correlation_intervals(t, resamples=300).collect()}
    assert ci["all"].pearson_ci_lo < c["all"].pearson < ci["all"].pearson_ci_hi and ci["all"].ci_note is None
    s = stats.strata(t).collect()
    overall = next(r for r in s if r.scope == "overall")
    assert overall.n == 60 and overall.median == pytest.approx(float(np.median(y))) and len(s) == 1 + 2 + 1 + 2 + 1 + 2 + 2 + 2 + 1
    i = stats.strata_intervals(t, resamples=300).collect()
    o = next(r for r in i if r.scope == "overall")
    assert o.ci_mean_lo < overall.mean < o.ci_mean_hi and any(r.ci_note == "n too small" for r in i)
    assert "overall" in reports.strata_markdown([r.asDict() for r in s], [r.asDict() for r in i]) and "NA" in reports.strata_markdown([], [])
    assert stats.correlations(t.limit(2)).where("scope = 'all'").collect()[0].pearson is None


def test_correlation_intervals_use_all_resamples(spark, monkeypatch):
    """Against one resample at a time."""
    data = np.random.default_rng(3)
    x = np.sort(data.integers(1, 30, 80) / 2.0)
    y = np.round(x / 40 + data.random(80), 3)
    c = data.integers(1, 4, 80)
    t = spark.createDataFrame([("npm", float(a), float(b), 6) for a, b, n in zip(x, y, c) for _ in range(n)], "ecosystem string, mean_group_size double, alignment double, k_projects_decided bigint")
    monkeypatch.setattr(pipeline_queries, "alignment", lambda spark, d: t)
    got = {r.scope: r for r in pipeline_queries.QUERIES["correlation_intervals"](spark, "").collect()}
    cells = t.toPandas().groupby(["mean_group_size", "alignment"]).size().reset_index(name="n")
    x, y, c = (cells[k].to_numpy(float) for k in ("mean_group_size", "alignment", "n"))
    rng, p, s = np.random.default_rng(42), [], []
    for _ in range(10_000):
        w = rng.multinomial(int(c.sum()), c / c.sum())
        a, b = np.repeat(x, w), np.repeat(y, w)
        if len(set(a)) > 1 and len(set(b)) > 1:
            p.append(np.corrcoef(a, b)[0, 1])
            s.append(np.corrcoef(*(np.searchsorted(z := np.sort(v), v) + np.searchsorted(z, v, "right") for v in (a, b)))[0, 1])
    r = got["all"]
    assert [r.pearson_ci_lo, r.pearson_ci_hi, r.spearman_ci_lo, r.spearman_ci_hi] == pytest.approx([*np.percentile(p, [2.5, 97.5]), *np.percentile(s, [2.5, 97.5])], abs=1e-9)


def test_store(spark, rows):
    pr = model.empty(spark, "pr").unionByName(spark.createDataFrame([(1, "o", "r", 1)], "id bigint, repo_owner string, repo_name string, pr_number bigint"), allowMissingColumns=True)
    assert model.reconcile(model.reconcile(pr.drop("state"), "pr"), "pr").columns == pr.columns
    new = spark.createDataFrame([(2, "o", "r", 1, "b"), (4, "o", "r", 2, "b"), (3, "o", "r", 2, "a")], "id bigint, repo_owner string, repo_name string, pr_number bigint, event_created_at string")
    assert [r.id for r in store.insert_pull_requests(pr, new, ["event_created_at", "id"]).collect()] == [3]
    up = store.update_enrichment(pr, spark.createDataFrame([(1, "OPEN", "evil"), (9, "x", "y")], "id bigint, state string, repo_owner string"))
    assert rows(up.select("id", "state", "repo_owner")) == [(1, "OPEN", "o")]
    assert rows(store.mark(up, spark.createDataFrame([(1,), (1,)], "id bigint"), "parse_attempted_at", "now").select("parse_attempted_at", "state")) == [("now", "OPEN")]
    parsed = spark.createDataFrame([(5, 2, "b"), (5, 1, "a"), (4, 1, "c")], "pr_id bigint, change_no int, package string")
    assert rows(store.number_changes(store.with_group_size(parsed), 10).select("change_id", "package", "group_size")) == [(11, "c", 1), (12, "a", 2), (13, "b", 2)]
    c = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "id bigint, pr_id bigint, body string")
    n = spark.createDataFrame([(3, 1, "z")], "id bigint, pr_id bigint, body string")
    assert rows(store.replace_comments(c, n, spark.createDataFrame([(1,), (2,)], "pr_id bigint"))) == [(3, 1, "z")]
    e = spark.createDataFrame([("parse", "o", "r", 1), ("enrich", "o", "r", 1), ("parse", "o", None, 1), (None, "o", "r", 1)], "stage string, repo_owner string, repo_name string, pr_number bigint")
    assert store.delete_parse_errors(e, pr).count() == 3
    assert store.append_errors(e, e.limit(1).drop("pr_number")).count() == 5
    t = model.reconcile(spark.createDataFrame([("npm", "p", None, "2", 0.5, 3)], "ecosystem string, package string, from_version string, to_version string, alignment double, k_projects_decided bigint"), "triple_alignment")
    b = store.backup_alignment(t, "v1")
    assert b.collect() == store.backup_alignment(b, "v1").collect() and b.collect()[0].alignment_v1 == 0.5
    fresh = t.withColumn("alignment", F.lit(0.9))
    r = store.replace_alignment(b, fresh).collect()
    assert [(x.alignment, x.alignment_v1, x.alignment_pcb) for x in r] == [(0.9, 0.5, None)]
    with pytest.raises(ValueError):
        store.backup_alignment(t, "v9")


PAYLOAD = {"createdAt": "t", "title": "x", "author": {"login": "me", "__typename": "Bot"}, "merged": True, "repository": {"isFork": True}, "commits": {"nodes": [{"commit": {"message": "a"}}, {"commit": {"message": ""}}, None, {"commit": {"message": "b"}}], "pageInfo": {"hasNextPage": True}}, "files": {"nodes": [{"path": "go.mod", "additions": 1}, {"path": None}], "pageInfo": {"hasNextPage": False}}}


def test_enrichment(spark, rows):
    mixed = PAYLOAD | {"files": {"nodes": [{"path": "go.mod"}, {"path": "README"}], "pageInfo": {"hasNextPage": True}}}
    df = spark.createDataFrame([(1, json.dumps(PAYLOAD)), (2, json.dumps(mixed)), (3, "{}"), (4, None)], "id bigint, payload string")
    out = {r.id: r for r in enrich.flatten_payload(df, targets=["go"]).collect()}
    assert (out[1].commit_messages_concat, out[1].commits_truncated, out[1].file_count, out[1].manifest_filter_reason, out[1].parse_priority, out[1].author_type) == ("a\n---\nb", True, 1, "passed", "priority", "Bot")
    assert (out[2].manifest_filter_reason, out[2].parse_priority) == ("too_many_files", None)
    assert (out[3].manifest_filter_reason, out[3].file_count, out[4].passes_manifest_only_filter) == ("no_manifest_files", 0, False)
    calls = []

    def call(batch):
        if any(r["id"] == 60 for r in batch):
            raise OSError("down")
        return [(None, "NOT_FOUND") if r["id"] == 3 else (json.dumps(PAYLOAD), None) for r in batch], None

    got = {r.id: r for r in enrich.fetch(spark.range(70).coalesce(1), call, ["id"], pause=0).collect()}
    assert got[1].status == "done" and (got[3].status, got[3].error) == ("failed", "NOT_FOUND") and got[60].status == "pending" and len(got) == 70 and not calls
    assert {r.status for r in enrich.fetch(spark.range(3), call, ["id"], seconds=0).collect()} == {"pending"}
    assert enrich.merge_pages([[{}] * 300, [{}] * 300], True) == ([{}] * 500, True, True) and enrich.merge_pages([[{}]], False) == ([{}], False, False)
    assert enrich.filter_reason_of("NOT_FOUND") == "graphql_not_found"


def page(paths, cursor=None):
    return {"nodes": [{"path": p} for p in paths], "pageInfo": {"hasNextPage": cursor is not None, "endCursor": cursor}}


def test_fetch_adds_pages_and_stops_at_the_rate(spark):
    def call(batch):
        return [(json.dumps(PAYLOAD | {"files": page(["go.mod"], "c1")}), None) for _ in batch], None

    def more(row, cursor):
        if row["id"] == 1:
            raise OSError("down")
        if row["id"] == 2:
            return [(None, "BAD_CURSOR")], None
        if row["id"] == 3:
            return [(json.dumps({"files": page(["x"] * 300, "again")}), None)], None
        return [(json.dumps({"files": page(["go.sum"], "c2") if cursor == "c1" else page(["a/go.mod"])}), None)], None

    got = {r.id: r for r in enrich.fetch(spark.range(4).coalesce(1), call, ["id"], pause=0, more=more).collect()}
    assert [n["path"] for n in json.loads(got[0].payload)["files"]["nodes"]] == ["go.mod", "go.sum", "a/go.mod"]
    assert (got[1].status, got[1].error) == ("pending", "OSError") and (got[2].status, got[2].error) == ("pending", "BAD_CURSOR")
    capped = json.loads(got[3].payload)["files"]
    assert len(capped["nodes"]) == enrich.MAX_FILES and capped["pageInfo"] == {"hasNextPage": True, "capExceeded": True}

    def limited(batch):
        return [("{}", None)] * len(batch), 120 - 30 * (batch[0]["id"] // 25)

    got = [r.status for r in enrich.fetch(spark.range(100).coalesce(1), limited, ["id"], pause=0).orderBy("id").collect()]
    assert got == ["done"] * 50 + ["pending"] * 50  # the second answer leaves 90 calls


def test_runs_leave_state_and_errors(spark, rows):
    pr = model.reconcile(spark.createDataFrame([(i, "o", "r", i, None) for i in range(1, 5)], "id bigint, repo_owner string, repo_name string, pr_number bigint, enriched_at string"), "pr")
    answers = spark.createDataFrame([(1, "o", "r", 1, json.dumps(PAYLOAD), None, "done"), (2, "o", "r", 2, None, "NOT_FOUND", "failed"), (3, "o", "r", 3, None, "OSError", "pending"), (4, "o", "r", 4, None, None, "pending")], "id bigint, repo_owner string, repo_name string, pr_number bigint, payload string, error string, status string")
    after, errors = enrich.enrich_run(pr, model.empty(spark, "pipeline_error"), answers, "now", ["go"])
    assert rows(after.select("id", "title", "manifest_filter_reason", "enriched_at")) == [(1, "x", "passed", "now"), (2, None, "graphql_not_found", "now"), (3, None, None, None), (4, None, None, None)]
    assert rows(errors.select("stage", "pr_number", "error_type")) == [("enrich", 2, "NOT_FOUND"), ("enrich", 3, "network_or_http")]
    change = spark.createDataFrame([], "change_id bigint, pr_id bigint, ecosystem string, package string, from_version string, to_version string, manifest_path string, is_lockfile boolean, group_size int")
    parsed = diffs.diff_changes(spark.createDataFrame([(1, "--- a/go.mod\n+++ b/go.mod\n@@ -1 +1 @@\n-require a v1\n+require a v2\n"), (2, "@@ -1 +1 @@\n-a\n+b\n"), (3, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n")], "pr_id bigint, diff string"))
    earlier = spark.createDataFrame([("parse", "o", "r", 1, "x"), ("enrich", "o", "r", 1, "x")], "stage string, repo_owner string, repo_name string, pr_number bigint, error_type string")
    p, c, e = enrich.parse_run(pr, change, earlier, parsed, "now")
    assert rows(p.where("parse_attempted_at = 'now'").select("id")) == [(1,), (2,)]
    assert rows(c.select("pr_id", "package", "to_version", "group_size")) == [(1, "a", "v2", 1)]
    assert rows(e.select("stage", "pr_number", "error_type")) == [("enrich", 1, "x"), ("parse", 2, "ValueError")]


def test_loop_stops_when_targets_are_met():
    asked, said = [], []

    def met():
        asked.append(1)
        return len(asked) == 3

    assert enrich.until_met(iter([1000] * 20), lambda b: b, met, said=said.append) == 5000 and len(asked) == 3 and said == [1000, 2000, 3000, 4000, 5000]
    assert enrich.until_met(iter([5] * 3), lambda b: b, lambda: False) == 15


def test_percentages():
    data = [{"d": "x", "n": 1}, {"d": "x", "n": 2}, {"d": "y", "n": 0}]
    assert [r["n_percentage"] for r in reports.percentages(data, "n", ["d"])] == [33.3, 66.7, 0.0]


def test_version_keys_follow_the_specification(spark):
    packaging = pytest.importorskip("packaging.version")
    good = ["1.0.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.0", "1.0+abc", "1.0+abc.2", "1.0+5", "1.0.post1", "1.0-2", "1.0.post3.dev1", "1.0a1.dev2", "1.0a1.post1", "1.1.dev0", "v1.10", "1.9", "1!0.1", "2.0-preview_3", "1.0.0.1", "0"]
    rng = random.Random(3)
    rng.shuffle(good)
    df = spark.createDataFrame([(v,) for v in good], "v string").orderBy(versions.version_key("v"), "v")
    want = sorted(good, key=lambda v: (packaging.Version(v), v))
    assert [r.v for r in df.collect()] == want
    other = ["release-2", "release-10", "release-1b", "abc", "2024_01x", "==1.0", None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in other], "v string").orderBy(versions.version_key("v")).collect()]
    assert got == [None, "==1.0", "2024_01x", "abc", "release-1b", "release-2", "release-10"]


def gold_row(**change):
    row = {
        "pr_id": 1, "pr_url": "u", "repo": "o/r", "pr_number": 1, "change_ids": [1, 2], "ecosystem_summary": ["npm"], "group_size": 2, "pr_labels": {"source": "human", "outcome": "open", "security": "security"},
        "change_labels": [{"change_id": 1, "package": "p", "from_version": None, "to_version": "2", "manifest_path": "m", "semver_tier": "major", "direct_or_transitive": "direct"}], "unlabelled_change_ids": [2], "change_label_scope": "sampled_changes",
        "heuristic_pr_labels": {"source": "human", "outcome": "open", "security": "security"}, "heuristic_change_labels": [{"change_id": i, "semver_tier": "major", "direct_or_transitive": "direct"} for i in (1, 2)],
        "label_status": "human_verified", "label_source": "manual", "reviewed_by_human": True, "confidence": None, "reasoning": "", "uncertainty_notes": "", "notes": "", "labelled_at": "now",
    }
    return json.dumps(row | change)


def test_gold_set(spark, tmp_path):
    path = str(tmp_path / "gold.jsonl")
    assert jsonl.read_jsonl(spark, path).count() == 0
    bad = [{"repo": "none"}, {"change_ids": [1, 1, 2]}, {"unlabelled_change_ids": []}, {"unlabelled_change_ids": [1, 2]}, {"change_label_scope": "all_changes"}, {"change_label_scope": "none"}, {"confidence": "sure"}, {"label_status": "x"}, {"heuristic_change_labels": []}, {"pr_labels": {"source": "alien", "outcome": "open", "security": "security"}}, {"notes": None}, {"pr_id": "x"}]
    (tmp_path / "gold.jsonl").write_text("\n".join([gold_row(), "", *(gold_row(**b) for b in bad)]) + "\n")
    out = [r.errors for r in gold.validate(jsonl.read_jsonl(spark, path)).collect()]
    assert out[0] == [] and all(out[1:]) and len(out) == 1 + len(bad)
    ok = spark.createDataFrame([(gold_row(),)], "v string").select(F.from_json("v", gold.SCHEMA).alias("x")).select("x.*")
    jsonl.append_jsonl(ok, str(tmp_path / "out"))
    jsonl.append_jsonl(ok, str(tmp_path / "out"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="repo:no_owner"):
        jsonl.append_jsonl(ok.withColumn("repo", F.lit("x")), str(tmp_path / "out"))
    made = gold.make_rows(ok.drop("unlabelled_change_ids", "change_label_scope", "labelled_at")).collect()[0]
    assert made.unlabelled_change_ids == [2] and made.change_label_scope == "all_changes"
    assert gold.pr_ids(ok, verified=True).count() == 1
    assert {(r.field, r.value, r.n) for r in gold.summary(ok.withColumn("label_source", F.lit(None).cast("string"))).collect()} == {("label_status", "human_verified", 1), ("label_source", "unknown", 1)}
    (tmp_path / "broken.jsonl").write_text("{}\nnot json\n")
    with pytest.raises(Exception, match="not a JSON line"):
        jsonl.read_jsonl(spark, str(tmp_path / "broken.jsonl")).collect()
    report = jsonl.write_report({"a": gold.pr_ids(ok), "b": 1}, str(tmp_path / "r/x.json"))
    assert report == {"a": [{"pr_id": 1}], "b": 1} == json.loads((tmp_path / "r/x.json").read_text())


def test_archive_day_and_stream(spark, tmp_path, rows):
    day = tmp_path / "20250101"
    day.mkdir()
    event = lambda i, t, action, kind="PullRequestEvent", repo="o/r": json.dumps({"id": str(i), "type": kind, "repo": repo, "payload": json.dumps({"action": action, "number": 7}), "actor": "me", "created_at": t})
    (day / "a.json").write_text("\n".join([event(3, "2025-01-01T02", "opened"), event(1, "2025-01-01T01", "reopened"), event(2, "2025-01-01T00", "closed"), event(4, "2025-01-01T00", "opened", "PushEvent"), event(5, "2025-01-01T05", "opened", repo="solo")]) + "\n")
    got = discovery.read_archive_day(spark, str(tmp_path), "20250101").collect()
    assert [(r.repo_owner, r.repo_name, r.pr_number, r.event_id) for r in got] == [("o", "r", 7, "1"), ("solo", None, 7, "5")]
    for bad in (("2025-01-01", None), ("20250101", 0)):
        with pytest.raises(ValueError):
            discovery.check_request(*bad)
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "id bigint, repo_owner string, repo_name string, pr_number bigint"
    for k in (0, 1):
        spark.createDataFrame([(10 * k + i, "o", "r", i % 3 + k) for i in range(6)], schema).coalesce(1).write.mode("append").parquet(src)
        append_new(spark.readStream.schema(schema).parquet(src), out, discovery.KEY, ["id"], ck).awaitTermination()
    assert rows(spark.read.parquet(out).select("id", "pr_number")) == [(0, 0), (1, 1), (12, 3), (2, 2)]


def test_registered_queries(spark):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 50
    assert "SELECT" in s["alignment"]


def test_closing_comments(spark, rows):
    nodes = [{"author": {"login": f"u{i}", "__typename": "User"}, "body": str(i), "createdAt": "t"} for i in range(20)] + [{"author": None, "body": None, "createdAt": None}]
    df = spark.createDataFrame([(1, json.dumps({"comments": {"nodes": nodes}})), (2, "bad"), (3, None), (4, json.dumps({"comments": {"nodes": []}}))], "pr_id bigint, payload string")
    out = enrich.closing_comments(df, fetched_at="now").orderBy("id").collect()
    assert [r.body for r in out] == [str(i) for i in range(6, 20)] + [None] and {r.pr_id for r in out} == {1} and out[-1].author_login is None


def test_classify_with_comments(spark, rows):
    pr = spark.createDataFrame([(1, "dependabot[bot]", None, None, "t", "", None, "CLOSED", False, [("web/package.json",)]), (2, None, "me", "User", "bump left-pad", None, None, "closed", None, None)], "id bigint, actor_login string, author_login string, author_type string, title string, body string, commit_messages_concat string, state string, merged boolean, files array<struct<path:string>>")
    change = spark.createDataFrame([(10, 1, "npm", "a", "1.0", "2.0", "web/package-lock.json", True), (11, 1, "npm", "a", "1.0", "1.1", "web/package.json", False), (12, 2, "npm", "left-pad", None, "1", "package-lock.json", True), (13, 9, "npm", "x", "1", "2", "p", False)], "change_id bigint, pr_id bigint, ecosystem string, package string, from_version string, to_version string, manifest_path string, is_lockfile boolean")
    said = spark.createDataFrame([(1, 1, "dependabot[bot]", None, "No longer needed", "t")], "id bigint, pr_id bigint, author_login string, author_type string, body string, created_at string")
    out = rows(lb.classify(change, pr, said))
    assert out == [(10, 1, "dependabot", "major", "non-security", "direct", "superseded", "comment_grouped"), (11, 1, "dependabot", "minor", "non-security", "direct", "superseded", "comment_grouped"), (12, 2, "human", "unknown", "non-security", "transitive", "closed-unmerged", None)]
    assert lb.classify(change, pr, dimensions=["source", "source"]).columns == ["change_id", "pr_id", "source"]
    with pytest.raises(ValueError):
        lb.selected_dimensions(["nothing"])


def test_stream_drops_repeats_within_the_watermark(spark, tmp_path, rows):
    src, out, ck = (str(tmp_path / n) for n in ("s", "o", "c"))
    data = [(1, "a", "2025-01-01T00:00:00"), (2, "a", "2025-01-01T00:10:00"), (3, "b", "2025-01-01T00:00:00"), (4, None, "2025-01-01T00:00:00"), (5, None, "2025-01-01T00:00:01")]
    spark.createDataFrame(data, "id bigint, k string, t string").withColumn("at", F.col("t").cast("timestamp")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id bigint, k string, t string, at timestamp").parquet(src)
    first_events_stream(stream, ["k"], "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out).select("k").distinct()) == [("a",), ("b",), (None,)] and spark.read.parquet(out).count() == 3
