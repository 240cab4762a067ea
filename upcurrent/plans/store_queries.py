"""Queries of the stored tables' writes, payloads, whole documents and the hand-labelled set, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import model
from ..functions import classifiers, versions
from ..operators import alignment as al, diagnose as dg, discovery, enrich, gold, labels as lb, stats, store
from ..sources import diffs
from . import pipeline_queries as pq
from .pipeline_queries import change, comment_table, errors, pr

# --- Payloads and their columns ---

SHOWN = ["title", "body", "merged", "state", "additions", "base_sha", "author_login", "author_type", "is_fork", "commit_messages_concat", "commits_truncated", "passes_manifest_only_filter", "file_count", "manifest_file_count", "manifest_filter_reason", "parse_priority"]


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """id and the payload text a fetch of each enriched pull request would have given, made of its columns."""
    p = pr(spark, d).where("enriched_at IS NOT NULL").withColumn("files", dg.files_array("files_json"))
    page = lambda more: F.struct(F.coalesce(more, F.lit(False)).alias("hasNextPage"))
    commits = F.transform(F.split("commit_messages_concat", "\n---\n"), lambda m: F.struct(F.struct(m.alias("message")).alias("commit")))
    payload = F.struct(
        "title", "body", "merged", "state", "additions", F.col("base_sha").alias("baseRefOid"), F.struct(F.col("author_login").alias("login"), F.col("author_type").alias("__typename")).alias("author"),
        F.struct(F.col("is_fork").alias("isFork")).alias("repository"), F.struct(commits.alias("nodes"), page(F.col("commits_truncated")).alias("pageInfo")).alias("commits"), F.struct(F.col("files").alias("nodes"), page(F.col("files_has_next_page")).alias("pageInfo")).alias("files"),
    )
    return p.select("id", F.to_json(payload).alias("payload"))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The pull requests as discovered, updated by what their payloads say."""
    bare = model.reconcile(pr(spark, d).select("id", *discovery.KEY), "pr")
    fields = enrich.flatten_payload(payloads(spark, d), targets=["npm", "go"])
    return store.update_enrichment(bare, fields).select("id", *SHOWN)


def flattened_comments(spark: SparkSession, d: str) -> DataFrame:
    """Closing comments out of payloads that hold all comments of eight pull requests each; the last ones count."""
    c = comment_table(spark, d).withColumn("pr_id", F.expr("pr_id div 8"))
    node = F.struct(F.struct(F.col("author_login").alias("login")).alias("author"), "body", F.col("created_at").alias("createdAt"))
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("id", node.alias("node")))), lambda x: x["node"])
    p = c.groupBy("pr_id").agg(F.to_json(F.struct(F.struct(nodes.alias("nodes")).alias("comments"))).alias("payload"))
    return enrich.closing_comments(p, fetched_at="2025-01-01T00:00:00+00:00").drop("author_type")


# --- Writes ---


def marked_parsed(spark: SparkSession, d: str) -> DataFrame:
    done = change(spark, d).select(F.col("pr_id").alias("id"))
    return store.mark(pr(spark, d), done, "parse_attempted_at", "2030-01-01T00:00:00+00:00").select("id", "parse_attempted_at")


def replaced_comments(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests of every third number get their bot comments anew, marked; those without a bot comment keep none."""
    c = comment_table(spark, d)
    ids = c.where("pr_id % 3 = 0").select("pr_id")
    new = c.where("pr_id % 3 = 0 AND author_login <> 'reviewer'").withColumn("body", F.concat(F.lit("again: "), "body"))
    return store.replace_comments(c, new, ids).select("id", "pr_id", "author_login", F.md5("body").alias("body_md5"))


def superseded_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reasons a relabelling leaves on pull requests."""
    p = pr(spark, d).withColumn("files", dg.files_array("files_json"))
    got = lb.classify(change(spark, d), p, comment_table(spark, d), ["outcome"]).groupBy("pr_id").agg(F.max("superseded_reason").alias("superseded_reasons"))
    return store.update_by_key(model.reconcile(pr(spark, d), "pr"), got.withColumnRenamed("pr_id", "id"), ["id"]).select("id", "superseded_reasons")


def classified_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with closing comments taken into account."""
    p = pr(spark, d).withColumn("files", dg.files_array("files_json"))
    return lb.classify(change(spark, d), p, comment_table(spark, d), ["outcome"]).select("change_id", "outcome", "superseded_reason")


def remaining_errors(spark: SparkSession, d: str) -> DataFrame:
    """Parse errors appended for every pull request that has none of its own kind, then deleted for those with changes."""
    p = pr(spark, d).where("pr_number % 3 = 0").select(F.lit("parse").alias("stage"), *discovery.KEY, F.lit("late").alias("error_type"))
    done = pr(spark, d).join(change(spark, d).select(F.col("pr_id").alias("id")), "id", "left_semi")
    return store.delete_parse_errors(store.append_errors(errors(spark, d), p), done).groupBy("stage", "error_type").agg(F.count(F.lit(1)).alias("n"))


def needs_comments(spark: SparkSession, d: str) -> DataFrame:
    o = classifiers.outcome("state", "merged", "title", "body")
    p = pr(spark, d).select("id", o["label"].alias("outcome_titlebody"), F.when(F.col("id") % 2 == 0, "2025-01-01").alias("closing_comments_fetched_at"))
    return store.needs_comments(p).select("id")


def replaced_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The alignment table of all triples, its metrics doubled and kept as a snapshot, replaced by that of triples with two deciding projects."""
    old = model.reconcile(pq.alignment_all(spark, d).withColumn("alignment", F.col("alignment") * 2), "triple_alignment")
    kept = store.backup_alignment(old, "v1")
    again = store.backup_alignment(kept.withColumn("alignment", F.lit(-1.0)), "v1")  # a second snapshot changes nothing
    new = model.reconcile(pq.alignment(spark, d), "triple_alignment")
    return store.replace_alignment(again, new).select(*al.TRIPLE, "alignment", "alignment_v1", "k_changes_v1", "alignment_pcb")


def relabelled(spark: SparkSession, d: str) -> DataFrame:
    """Flips of a forced relabelling of outcomes: stored labels taken out, computed anew and compared."""
    p = pr(spark, d).withColumn("files", dg.files_array("files_json"))
    return lb.relabel(change(spark, d), p, pq.classification(spark, d), ["outcome", "source"], pq.VERSION, comment_table(spark, d))[1]


# --- The hand-labelled set ---


def gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows made of labelled pull requests, each with one of FAULTS by its id."""
    c = change(spark, d).join(pq.wide(spark, d), "change_id").select("pr_id", "change_id", "package", "from_version", "to_version", "manifest_path", "semver_tier", F.col("direct_transitive").alias("direct_or_transitive"), "ecosystem", "source", "outcome", "security")
    labels = F.sort_array(F.collect_list(F.struct("change_id", "package", "from_version", "to_version", "manifest_path", "semver_tier", "direct_or_transitive")))
    g = c.groupBy("pr_id").agg(labels.alias("change_labels"), F.sort_array(F.collect_set("ecosystem")).alias("ecosystem_summary"), F.struct(F.min("source").alias("source"), F.min("outcome").alias("outcome"), F.min("security").alias("security")).alias("pr_labels"))
    g = g.join(pr(spark, d).select(F.col("id").alias("pr_id"), F.concat_ws("/", "repo_owner", "repo_name").alias("repo"), "pr_number"), "pr_id")
    heuristic = F.transform("change_labels", lambda x: F.struct(x["change_id"].alias("change_id"), x["semver_tier"].alias("semver_tier"), x["direct_or_transitive"].alias("direct_or_transitive")))
    rows = g.select(
        "*", F.transform("change_labels", lambda x: x["change_id"]).alias("change_ids"), F.size("change_labels").cast("bigint").alias("group_size"), F.lit("https://code.example/pr").alias("pr_url"), F.col("pr_labels").alias("heuristic_pr_labels"), heuristic.alias("heuristic_change_labels"),
        F.lit("human_verified").alias("label_status"), F.lit("manual").alias("label_source"), F.lit(True).alias("reviewed_by_human"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("change_label_scope"), F.lit(None).cast("array<bigint>").alias("unlabelled_change_ids"),
    )
    fault = F.pmod(F.col("pr_id"), F.lit(len(FAULTS)))
    for k, (column, broken, _) in enumerate(FAULTS):
        if column:
            rows = rows.withColumn(column, F.when(fault == k, broken()).otherwise(F.col(column)))
    return gold.make_rows(rows)


def _changed(field: str, **parts: Column) -> Column:
    """The labels of field with some parts set."""
    return F.transform(field, lambda x: x.withField(*next(iter(parts.items()))))


_FIRST_ID = lambda: F.slice("change_ids", 1, 1)
#: Column, what stands in it instead, and the rules that then are broken. Rows are made from them one by one.
FAULTS: list[tuple[str | None, Callable[[], Column] | None, str]] = [
    (None, None, ""),
    ("pr_url", lambda: F.lit(""), "pr_url:empty"),
    ("repo", lambda: F.lit("none"), "repo:no_owner"),
    ("change_ids", lambda: F.concat("change_ids", _FIRST_ID()), "change_ids:repeated"),
    ("unlabelled_change_ids", _FIRST_ID, "change_ids:twice; change_label_scope:some_open"),
    ("change_label_scope", lambda: F.lit("none"), "change_label_scope:some_labelled"),
    ("change_label_scope", lambda: F.lit("some"), "change_label_scope:level"),
    ("label_status", lambda: F.lit("someday"), "label_status:level"),
    ("label_source", lambda: F.lit("guessed"), "label_source:level"),
    ("confidence", lambda: F.lit("sure"), "confidence:level"),
    ("reviewed_by_human", lambda: F.lit(None).cast("boolean"), "reviewed_by_human:missing"),
    ("heuristic_change_labels", lambda: F.slice("heuristic_change_labels", 1, 0), "heuristic_change_labels:other_ids"),
    ("heuristic_change_labels", lambda: F.concat("heuristic_change_labels", "heuristic_change_labels"), "heuristic_change_labels:repeated"),
    ("pr_labels", lambda: F.col("pr_labels").withField("source", F.lit("alien")), "pr_labels.source:level"),
    ("heuristic_pr_labels", lambda: F.col("heuristic_pr_labels").withField("outcome", F.lit("lost")), "heuristic_pr_labels.outcome:level"),
    ("ecosystem_summary", lambda: F.slice("ecosystem_summary", 1, 0), "ecosystem_summary:empty"),
    ("change_labels", lambda: F.slice("change_labels", 1, 0), "change_label_scope:some_open"),
    ("change_labels", lambda: _changed("change_labels", semver_tier=F.lit("huge")), "change_labels.semver_tier:level"),
    ("change_labels", lambda: _changed("change_labels", manifest_path=F.lit(None).cast("string")), "change_labels.manifest_path:missing"),
    ("unlabelled_change_ids", lambda: F.array(F.lit(-1).cast("bigint")), "change_ids:not_covered; change_label_scope:some_open"),
    ("unlabelled_change_ids", lambda: F.array(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint")), "unlabelled_change_ids:list; change_ids:not_covered; change_label_scope:some_open"),
    ("change_ids", lambda: F.slice("change_ids", 1, 0), "change_ids:empty; heuristic_change_labels:other_ids; change_ids:not_covered"),
    ("group_size", lambda: F.lit(None).cast("bigint"), "group_size:missing"),
]


def gold_validation(spark: SparkSession, d: str) -> DataFrame:
    return gold.validate(gold_rows(spark, d)).select("pr_id", F.array_join("errors", "; ").alias("errors"))


def gold_summary(spark: SparkSession, d: str) -> DataFrame:
    return gold.summary(gold_rows(spark, d).withColumn("label_status", F.when(F.col("pr_id") % 3 != 0, F.col("label_status"))))


def gold_ids(spark: SparkSession, d: str) -> DataFrame:
    return gold.pr_ids(gold_rows(spark, d), verified=True)


# --- Whole documents in diffs of several files ---

#: Path, lines before, the changed line and lines after; @ stands for the package and V for its version. By ecosystem, one of them for each change by its id.
DOCUMENTS: dict[str, list[tuple[str, list[str], str, list[str], bool]]] = {
    "npm": [
        ("web/package.json", ["{", '  "name": "x",', '  "devDependencies": {'], '    "@": "^V"', ["  }", "}"], False),
        ("web/package-lock.json", ["{", '  "packages": {', '    "node_modules/@": {'], '      "version": "V"', ["    }", "  }", "}"], True),
        ("package-lock.json", ["{", '  "dependencies": {', '    "@": {'], '      "version": "V"', ["    }", "  }", "}"], True),
    ],
    "pip": [
        ("Pipfile", ["[packages]"], '"@" = "==V"', [], False),
        ("Pipfile.lock", ["{", '  "default": {', '    "@": {'], '      "version": "==V"', ["    }", "  }", "}"], True),
        ("pyproject.toml", ["[tool.poetry.dependencies]"], '"@" = {version = "^V"}', [], False),
        ("poetry.lock", ["[[package]]", 'name = "@"'], 'version = "V"', [], True),
    ],
    "cargo": [
        ("Cargo.toml", ["[package]", 'name = "x"', "", "[build-dependencies]"], '"@" = "~V"', [], False),
        ("Cargo.lock", ["[[package]]", 'name = "@"'], 'version = "V"', [], True),
    ],
    "maven": [
        ("pom.xml", ["<project>", "  <dependencies>", "    <dependency>", "      <groupId>org.x</groupId>", "      <artifactId>@</artifactId>"], "      <version>V</version>", ["    </dependency>", "  </dependencies>", "</project>"], False),
        ("core/pom.xml", ["    <dependency>", "      <groupId>org.x</groupId>", "      <artifactId>@</artifactId>"], "      <version>V</version>", ["    </dependency>"], False),
        ("part/pom.xml", ["<dependency>", "  <groupId>org.x</groupId>", "  <artifactId>@</artifactId>"], "  <version>V</version>", [], False),
    ],
}
SECOND = "--- a/go.mod\n+++ b/go.mod\n@@ -1,3 +1,3 @@\n require (\n-\tx.example/second v1.0.0 // indirect\n+\tx.example/second v1.1.0 // indirect\n )\n--- a/yarn.lock\n+++ b/yarn.lock\n@@ -1 +1 @@\n-a\n+b\n"


def _kind() -> Column:
    sizes = F.create_map(*(x for e, docs in DOCUMENTS.items() for x in (F.lit(e), F.lit(len(docs)))))
    return F.concat_ws(":", "e", F.pmod(F.col("change_id"), sizes[F.col("e")]).cast("string"))


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    c = change(spark, d).select("change_id", F.lower(F.trim("ecosystem")).alias("e"), F.translate(F.lower(F.trim("package")), ":", ".").alias("p"), F.coalesce("from_version", F.lit("0")).alias("a"), F.col("to_version").alias("b"))
    text = F.lit(None).cast("string")
    for e, docs in DOCUMENTS.items():
        for k, (path, before, line, after, _) in enumerate(docs):
            n = len(before) + 1 + len(after)
            hunk = "\n".join([f"--- a/{path}", f"+++ b/{path}", f"\x03 -1,{n} +1,{n} \x03", *(" " + x for x in before), "-" + line.replace("V", "\x01"), "+" + line.replace("V", "\x02"), *(" " + x for x in after), SECOND.replace("@@", "\x03")])
            filled = F.lit(hunk)
            for sign, value in (("@", F.col("p")), ("\x01", F.col("a")), ("\x02", F.col("b")), ("\x03", F.lit("@@"))):
                filled = F.replace(filled, F.lit(sign), value)
            text = F.when(_kind() == f"{e}:{k}", filled).otherwise(text)
    return c.select("change_id", text.alias("diff"))


def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_changes(document_texts(spark, d), "change_id").select(F.col("pr_id").alias("change_id"), "change_no", "ecosystem", "package", "from_version", "to_version", "manifest_path", "is_lockfile", "group_size", "error")


# --- Orders and comments ---


def version_order(spark: SparkSession, d: str) -> DataFrame:
    """Each package's distinct versions in order."""
    v = change(spark, d).select("ecosystem", "package", F.col("to_version").alias("version")).distinct()
    w = Window.partitionBy("ecosystem", "package").orderBy("key")
    return v.withColumn("key", versions.version_key("version")).select("ecosystem", "package", "version", F.dense_rank().over(w).alias("place"))


def strongest_pairs(spark: SparkSession, d: str) -> DataFrame:
    return stats.strongest_pairs(stats.pairwise_v(pq.cells(spark, d)), 10)


def unmatched_comments(spark: SparkSession, d: str) -> DataFrame:
    """How many there are, and the samples."""
    found = lb.unmatched_bot_comments(change(spark, d), pq.classification(spark, d), lb.ordered_comments(comment_table(spark, d)))
    return found.select("bot_family", "n", F.array_join(F.transform("samples", lambda x: x["pr_id"].cast("string")), ",").alias("pr_ids"), F.array_join(F.transform("samples", lambda x: F.md5(x["last_comment_text"])), ",").alias("texts"))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return dg.stage_counts(pr(spark, d), change(spark, d), pq.classification(spark, d), errors(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (enriched, flattened_comments, marked_parsed, replaced_comments, superseded_reasons, classified_outcomes, remaining_errors, needs_comments, replaced_alignment, relabelled, gold_validation, gold_summary, gold_ids, parsed_documents, version_order, strongest_pairs, unmatched_comments, stage_counts)
}

# --- SQL ---

_CASE = lambda of, values: f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"
_FILES = pq._FILES
_FAULT = f"c.pr_id % {len(FAULTS)}"
_GOLD = f"""WITH {pq._WIDE}, g AS (SELECT DISTINCT c.pr_id FROM pr_change c JOIN wide w USING (change_id) JOIN pr p ON p.id = c.pr_id
  WHERE source IS NOT NULL AND semver_tier IS NOT NULL AND security IS NOT NULL AND direct_transitive IS NOT NULL AND outcome IS NOT NULL)"""
_OUTCOME = pq.SQL["classify_outcome"]
#: The latest comment that fits a pattern, of each pull request.
_REASONS = f"""said AS ({pq.SQL['supersession_match']}), plain AS ({_OUTCOME}),
outcomes AS (SELECT p.id, CASE WHEN o.label = 'closed-unmerged' AND s.reason IS NOT NULL THEN 'superseded' ELSE o.label END AS label,
  CASE WHEN o.reason IS NOT NULL THEN o.reason WHEN o.label IN ('superseded', 'closed-unmerged') THEN s.reason END AS reason
  FROM pr p JOIN plain o USING (id) LEFT JOIN said s ON s.pr_id = p.id)"""
_PEP_SQL = versions.PEP_PARTS.replace("'", "''")
_TRIPLES = pq._ROWS


def _document_rows() -> str:
    rows = []
    for e, docs in DOCUMENTS.items():
        for k, (path, _, _, _, lock) in enumerate(docs):
            name = "'org.x:' || p" if e == "maven" else "p"
            rows.append(f"SELECT change_id, 1 AS change_no, '{e}' AS ecosystem, {name} AS package, a AS from_version, b AS to_version, '{path}' AS manifest_path, {str(lock).lower()} AS is_lockfile, 2 AS group_size FROM c WHERE e = '{e}' AND k = {k} AND a <> b")
    known = ", ".join(f"'{e}'" for e in DOCUMENTS)
    second = f"SELECT change_id, CASE WHEN a <> b THEN 2 ELSE 1 END, 'go', 'x.example/second', 'v1.0.0', 'v1.1.0', 'go.mod', false, CASE WHEN a <> b THEN 2 ELSE 1 END FROM c WHERE e IN ({known})"
    return " UNION ALL ".join([*rows, second])


_SIZES = _CASE("lower(trim(ecosystem))", {f"'{e}'": len(x) for e, x in DOCUMENTS.items()})

SQL: dict[str, str] = {
    "enriched": f"""WITH f AS (SELECT *, coalesce(files_has_next_page, false) AS more, list_filter({_FILES}, lambda x: coalesce(x.path, '') <> '') AS files FROM pr WHERE enriched_at IS NOT NULL),
g AS (SELECT *, len(files) AS n, list_filter(list_transform(files, lambda x: {pq._eco('x.path')}), lambda e: e IS NOT NULL) AS ecos FROM f),
h AS (SELECT *, len(ecos) AS m, len(ecos) > 0 AND len(ecos) = n AND NOT more AS ok FROM g)
SELECT p.id, h.title, h.body, h.merged, h.state, h.additions, h.base_sha, h.author_login, h.author_type, h.is_fork,
  CASE WHEN h.id IS NOT NULL THEN coalesce(array_to_string(list_filter(string_split(h.commit_messages_concat, chr(10) || '---' || chr(10)), lambda x: x <> ''), chr(10) || '---' || chr(10)), '') END AS commit_messages_concat,
  CASE WHEN h.id IS NOT NULL THEN coalesce(h.commits_truncated, false) END AS commits_truncated, ok AS passes_manifest_only_filter, CAST(n AS INT) AS file_count, CAST(m AS INT) AS manifest_file_count,
  CASE WHEN ok THEN 'passed' WHEN more THEN 'too_many_files' WHEN m = 0 THEN 'no_manifest_files' WHEN m < n THEN 'mixed_manifest_and_non_manifest_files' END AS manifest_filter_reason,
  CASE WHEN ok THEN CASE WHEN list_has_any(ecos, ['npm', 'go']) THEN 'priority' ELSE 'deferred_non_priority' END END AS parse_priority
FROM pr p LEFT JOIN h ON h.id = p.id""",
    "flattened_comments": f"""WITH {pq._COMMENTS}, x AS (SELECT *, pr_id // 8 AS own, CASE family WHEN 'human' THEN 'reviewer' ELSE family || '[bot]' END AS author_login FROM cm),
n AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY id DESC) AS back, row_number() OVER (PARTITION BY own ORDER BY id) AS place, count(*) OVER (PARTITION BY own) AS size FROM x)
SELECT own * {enrich.COMMENTS} + place - greatest(size - {enrich.COMMENTS}, 0) - 1 AS id, own AS pr_id, author_login, body, created_at, '2025-01-01T00:00:00+00:00' AS fetched_at FROM n WHERE back <= {enrich.COMMENTS}""",
    "marked_parsed": "SELECT id, CASE WHEN EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = pr.id) THEN '2030-01-01T00:00:00+00:00' ELSE parse_attempted_at END AS parse_attempted_at FROM pr",
    "replaced_comments": f"""WITH {pq._COMMENTS} SELECT id, pr_id, CASE family WHEN 'human' THEN 'reviewer' ELSE family || '[bot]' END AS author_login, md5(CASE WHEN pr_id % 3 = 0 THEN 'again: ' || body ELSE body END) AS body_md5
FROM cm WHERE pr_id % 3 <> 0 OR family <> 'human'""",
    "superseded_reasons": f"WITH {_REASONS} SELECT p.id, CASE WHEN EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = p.id) THEN o.reason END AS superseded_reasons FROM pr p JOIN outcomes o USING (id)",
    "classified_outcomes": f"WITH {_REASONS} SELECT c.change_id, o.label AS outcome, o.reason AS superseded_reason FROM pr_change c JOIN outcomes o ON o.id = c.pr_id",
    "relabelled": f"""WITH {_REASONS}, who AS ({pq.SQL['classify_source']}), old AS ({pq._FIRST}),
new AS (SELECT c.change_id, 'outcome' AS dimension, o.label FROM pr_change c JOIN outcomes o ON o.id = c.pr_id UNION ALL SELECT c.change_id, 'source', w.label FROM pr_change c JOIN who w ON w.id = c.pr_id)
SELECT dimension, old.label AS old_label, new.label AS new_label, count(*) AS n FROM old JOIN new USING (change_id, dimension) WHERE classifier_version = {pq.VERSION} AND old.label <> new.label GROUP BY ALL""",
    "remaining_errors": f"""WITH {pq._ERRORS}, e AS (SELECT * FROM err UNION ALL SELECT 'parse', repo_owner, repo_name, pr_number, 'late' FROM pr WHERE pr_number % 3 = 0)
SELECT stage, error_type, count(*) AS n FROM e WHERE stage <> 'parse' OR NOT EXISTS (SELECT 1 FROM pr p WHERE p.repo_owner = e.repo_owner AND p.repo_name = e.repo_name AND p.pr_number = e.pr_number AND EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = p.id)) GROUP BY ALL""",
    "needs_comments": f"WITH o AS ({_OUTCOME}) SELECT id FROM o WHERE label = 'closed-unmerged' AND id % 2 <> 0",
    "replaced_alignment": f"WITH {_TRIPLES} SELECT ecosystem, package, from_version, to_version, alignment, alignment * 2 AS alignment_v1, k_changes AS k_changes_v1, CAST(NULL AS DOUBLE) AS alignment_pcb FROM alignment WHERE k_projects_decided >= 2",
    "gold_validation": _GOLD + f" SELECT pr_id, {_CASE(_FAULT, {k: repr(x[2]) for k, x in enumerate(FAULTS)})} AS errors FROM g c",
    "gold_summary": _GOLD + f""", v AS (SELECT CASE WHEN pr_id % 3 <> 0 THEN CASE WHEN {_FAULT} = 7 THEN 'someday' ELSE 'human_verified' END END AS s, CASE WHEN {_FAULT} = 8 THEN 'guessed' ELSE 'manual' END AS m FROM g c)
SELECT 'label_status' AS field, coalesce(s, 'unknown') AS value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'label_source', m, count(*) FROM v GROUP BY ALL""",
    "gold_ids": _GOLD + f" SELECT pr_id FROM g c WHERE {_FAULT} <> 7",
    "parsed_documents": f"""WITH c AS (SELECT change_id, lower(trim(ecosystem)) AS e, replace(lower(trim(package)), ':', '.') AS p, coalesce(from_version, '0') AS a, to_version AS b, change_id % {_SIZES} AS k FROM pr_change)
SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({_document_rows()})""",
    "version_order": f"""WITH v AS (SELECT DISTINCT ecosystem, package, to_version AS version FROM pr_change),
m AS (SELECT *, {pq._NORM('version')} AS n FROM v),
x AS (SELECT *, regexp_extract(lower(n), '{_PEP_SQL}', ['epoch', 'release', 'pre', 'pre_no', 'post_a', 'post', 'post_no', 'dev', 'dev_no', 'local']) AS g, regexp_matches(lower(n), '{_PEP_SQL}') AS pep FROM m),
y AS (SELECT *, CASE WHEN g.post_a <> '' THEN TRY_CAST(g.post_a AS HUGEINT) WHEN g.post <> '' THEN TRY_CAST('0' || g.post_no AS HUGEINT) ELSE -1 END AS post, g.dev <> '' AS is_dev FROM x),
k AS (SELECT *, CASE WHEN pep THEN 0 ELSE 1 END AS k0, CASE WHEN pep THEN TRY_CAST('0' || g.epoch AS HUGEINT) ELSE 0 END AS k1,
  CASE WHEN pep THEN list_transform(string_split(regexp_replace(g.release, '(\\.0+)+$', ''), '.'), lambda z: TRY_CAST(z AS HUGEINT)) ELSE [] END AS k2,
  CASE WHEN NOT pep THEN 0 WHEN g.pre IN ('a', 'alpha') THEN 1 WHEN g.pre IN ('b', 'beta') THEN 2 WHEN g.pre <> '' THEN 3 WHEN post < 0 AND is_dev THEN 0 ELSE 4 END AS k3, CASE WHEN pep AND g.pre <> '' THEN TRY_CAST('0' || g.pre_no AS HUGEINT) ELSE 0 END AS k4,
  CASE WHEN pep THEN post ELSE 0 END AS k5, CASE WHEN NOT pep THEN 0 WHEN is_dev THEN TRY_CAST('0' || g.dev_no AS HUGEINT) ELSE TRY_CAST(1e30 AS HUGEINT) END AS k6,
  CASE WHEN pep THEN '' ELSE lower(n) END AS k9,
  CASE WHEN pep THEN list_transform(list_filter(regexp_split_to_array(g.local, '[-_.]'), lambda z: z <> ''), lambda z: CASE WHEN regexp_full_match(z, '[0-9]+') THEN '1' || lpad(z, 40, '0') ELSE '0' || z END) ELSE [] END AS k7,
  CASE WHEN pep THEN [] ELSE list_transform(regexp_extract_all(lower(n), '[0-9]+|[^0-9]+'), lambda z: CASE WHEN regexp_full_match(z, '[0-9]+') THEN '0' || lpad(z, 40, '0') ELSE '1' || z END) END AS k8 FROM y)
SELECT ecosystem, package, version, CAST(dense_rank() OVER (PARTITION BY ecosystem, package ORDER BY k0, k1, k2, k3, k4, k5, k6, k7, k8, k9) AS INT) AS place FROM k""",
    "strongest_pairs": f"WITH q AS ({pq.SQL['pairwise_cramers_v']}) SELECT dimension, stratifier, unit, a, b, v FROM q ORDER BY v DESC, a, b, dimension, stratifier, unit LIMIT 10",
    "unmatched_comments": f"""WITH {pq._COMMENTS}, closed AS (SELECT DISTINCT pr_id FROM pr_change JOIN classification USING (change_id) WHERE dimension = 'outcome' AND classifier_version = 1 AND label = 'closed-unmerged'),
b AS (SELECT o.*, body <> '' AND NOT regexp_matches(body, '{pq.comments.EXCLUDED}') AND ({" OR ".join(f"(family = '{f}' AND regexp_matches(body, '{p}'))" for f, p, _, _ in pq.comments.PATTERNS)}) AS fits FROM cm o JOIN closed USING (pr_id) WHERE family <> 'human'),
l AS (SELECT pr_id, arg_max(family, (coalesce(created_at, ''), id)) AS bot_family, arg_max(body, (coalesce(created_at, ''), id)) AS body FROM b GROUP BY pr_id HAVING NOT bool_or(fits)),
r AS (SELECT *, CASE WHEN length(body) > 500 THEN left(body, 500) || '...[truncated]' ELSE body END AS shown, row_number() OVER (PARTITION BY bot_family ORDER BY md5('42:' || pr_id), pr_id) AS k FROM l)
SELECT bot_family, count(*) AS n, string_agg(CAST(pr_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 10) AS pr_ids, string_agg(md5(shown), ',' ORDER BY k) FILTER (WHERE k <= 10) AS texts FROM r GROUP BY bot_family""",
    "stage_counts": f"WITH {pq._ERRORS} " + pq.SQL["stage_counts"] + " UNION ALL SELECT 'errors', count(*) FROM err",
}
