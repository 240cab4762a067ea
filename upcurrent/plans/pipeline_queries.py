"""The dependency-update pipeline's own queries over the whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import classifiers, comments, paths, versions
from ..functions.text import utc_text
from ..operators import alignment as al, diagnose as dg, discovery, labels as lb, stats
from ..operators import enrich, store
from ..sources import diffs
from ..sources.tables import table

VERSION = 1


def t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name)


pr, change, classification, documents, events = t("pr"), t("pr_change"), t("classification"), t("documents"), t("events")


def wide(spark: SparkSession, d: str, complete: bool = True) -> DataFrame:
    return lb.wide_labels(classification(spark, d), VERSION, complete)


def rows(spark: SparkSession, d: str) -> DataFrame:
    return al.contributing_rows(change(spark, d), pr(spark, d), wide(spark, d))


def alignment(spark: SparkSession, d: str) -> DataFrame:
    return al.alignment(al.hosted(rows(spark, d)))


def alignment_all(spark: SparkSession, d: str) -> DataFrame:
    return al.alignment(al.hosted(rows(spark, d)), least=1)


def latest_decision(spark: SparkSession, d: str) -> DataFrame:
    return al.by_project(al.hosted(rows(spark, d))).select(*al.TRIPLE, *al.PROJECT, "decision", "excluded")


def first_event(spark: SparkSession, d: str) -> DataFrame:
    out = discovery.first_events(pr(spark, d).select("id", *discovery.KEY, "event_created_at", "pr_action", "actor_login"), discovery.KEY, ["event_created_at", "id"])
    return out.where(F.col("pr_action").isin(*discovery.ACTIONS) | F.col("pr_action").isNull())


def archive_events(spark: SparkSession, d: str) -> DataFrame:
    """The event table read as an archive: a repository per user, the number from the JSON properties."""
    e = events(spark, d)
    action = F.when(F.col("event_type") == "purchase", "opened").when(F.col("event_type") == "click", "synchronize").when(F.col("event_type") == "view", "closed").otherwise("reopened")
    payload = F.to_json(F.struct(action.alias("action"), F.get_json_object("props", "$.k").cast("bigint").alias("number")))
    raw = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "PushEvent").otherwise("PullRequestEvent").alias("type"), F.concat(F.lit("owner/user"), F.col("user_id").cast("string")).alias("repo"), payload.alias("payload"), F.concat(F.lit("actor"), (F.col("event_id") % 7).cast("string")).alias("actor"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return discovery.first_events(discovery.events(raw), discovery.KEY, ["event_created_at", "event_id"])


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Messages with even ids as the table, the others as the insert."""
    p = pr(spark, d).select("id", *discovery.KEY, "event_created_at")
    old = F.col("id") % 2 == 0
    return discovery.insert_ignore(p.where(old), p.where(~old), discovery.KEY, ["id"]).select("id", *discovery.KEY)


def needs_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return store.needs_enrichment(pr(spark, d)).select("id")


def needs_parsing(spark: SparkSession, d: str) -> DataFrame:
    return store.needs_parsing(pr(spark, d), change(spark, d)).select("id")


def wide_labels(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d, complete=False)


def missing_labels(spark: SparkSession, d: str) -> DataFrame:
    return lb.missing_labels(change(spark, d), classification(spark, d), ["source", "outcome"], 2).select("change_id")


def classify_source(spark: SparkSession, d: str) -> DataFrame:
    return pr(spark, d).select("id", classifiers.source("actor_login", "author_login", "author_type").alias("label"))


def classify_semver(spark: SparkSession, d: str) -> DataFrame:
    return change(spark, d).select("change_id", versions.semver_tier("from_version", "to_version").alias("label"))


def normalised_versions(spark: SparkSession, d: str) -> DataFrame:
    return change(spark, d).select("change_id", versions.normalise_version("from_version").alias("old"), versions.normalise_version("to_version").alias("new"))


def classify_security(spark: SparkSession, d: str) -> DataFrame:
    return pr(spark, d).select("id", classifiers.security("title", "body", "commit_messages_concat").alias("label"))


def classify_outcome(spark: SparkSession, d: str) -> DataFrame:
    o = classifiers.outcome("state", "merged", "title", "body")
    return pr(spark, d).select("id", o["label"].alias("label"), o["reason"].alias("reason"))


def classify_direct(spark: SparkSession, d: str) -> DataFrame:
    p = pr(spark, d).withColumn("files", dg.files_array("files_json"))
    return lb.classify(change(spark, d), p, dimensions=["direct_transitive"]).select("change_id", F.col("direct_transitive").alias("label"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    p = pr(spark, d).withColumn("files", dg.files_array("files_json"))
    return lb.long_labels(lb.classify(change(spark, d), p), lb.selected_dimensions(None), VERSION)


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return lb.label_distribution(lb.stored_labels(classification(spark, d), VERSION))


def label_flips(spark: SparkSession, d: str) -> DataFrame:
    s = lb.stored_labels(classification(spark, d))
    return lb.label_flips(s.where("classifier_version = 1"), s.where("classifier_version = 2"))


def path_ecosystems(spark: SparkSession, d: str) -> DataFrame:
    c = change(spark, d).select("manifest_path").distinct()
    return c.select("manifest_path", paths.ecosystem("manifest_path").alias("ecosystem"), paths.is_lockfile("manifest_path").alias("is_lockfile"), paths.dirname("manifest_path").alias("folder"))


def comment_table(spark: SparkSession, d: str) -> DataFrame:
    """Bot comments and review threads as closing comments: each names its repository's pull request by number."""
    c = documents(spark, d).where("source IN ('bot_comment', 'review_thread')")
    login = F.when(F.col("source") == "bot_comment", F.when(F.col("doc_id") % 3 == 0, "renovate[bot]").otherwise("dependabot[bot]")).otherwise("reviewer")
    # No text speaks of superseded pull requests, so every fifth comment gets a closing phrase.
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Superseded by #"), F.col("doc_id").cast("string"))).otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.col("doc_id").alias("id"), F.expr("1000 + doc_id div 3").alias("pr_id"), login.alias("author_login"), F.lit(None).cast("string").alias("author_type"), said.alias("body"), utc_text("collected_at").alias("created_at"))


def ordered_comments(spark: SparkSession, d: str) -> DataFrame:
    o = lb.ordered_comments(comment_table(spark, d))
    ids = F.array_join(F.transform("comments", lambda c: c["id"].cast("string")), ",")
    stored = comments.parse_comments(F.to_json("comments"))  # as the text a table would hold
    said = F.md5(F.array_join(F.transform(stored, lambda c: F.concat_ws(":", c["author_login"], c["body"])), "|"))
    return o.select("pr_id", F.size("comments").alias("n"), ids.alias("ids"), said.alias("said"))


def supersession_match(spark: SparkSession, d: str) -> DataFrame:
    return lb.supersessions(comment_table(spark, d)).drop("comment_text")


def diff_texts(spark: SparkSession, d: str) -> DataFrame:
    """A diff for each change, in the format of its ecosystem; a lockfile one where the change says so. Line formats, so that whole and partial hunks read alike."""
    c = change(spark, d).select("change_id", F.lower(F.trim("ecosystem")).alias("e"), F.trim("package").alias("p"), F.coalesce("from_version", F.lit("0")).alias("a"), F.col("to_version").alias("b"), F.coalesce("is_lockfile", F.lit(False)).alias("l"))
    f = lambda *xs: F.concat(*(F.col(x) if x in "pabl" else F.lit(x) for x in xs))
    two = lambda path, before, name, after: f(f"diff --git a/{path} b/{path}\nindex 1..2 100644\n--- a/{path}\n+++ b/{path}\n@@ -7,3 +7,3 @@ x\n {before}\n-{name[0]}", *name[1], "\n", f"+{name[0]}", *name[2], f"\n {after}\n")
    text = (
        F.when((F.col("e") == "npm") & F.col("l"), f('--- a/package-lock.json\n+++ b/package-lock.json\n@@ -1,2 +1,2 @@\n     "node_modules/', "p", '": {\n-      "version": "', "a", '",\n+      "version": "', "b", '",\n'))
        .when(F.col("e") == "npm", two("web/package.json", '  "dependencies": {', ('    "', ("p", '": "', "a", '",'), ("p", '": "', "b", '",')), "  }"))
        .when((F.col("e") == "cargo"), f('--- a/Cargo.lock\n+++ b/Cargo.lock\n@@ -1,2 +1,2 @@\n name = "', "p", '"\n-version = "', "a", '"\n+version = "', "b", '"\n'))
        .when((F.col("e") == "pip"), two("requirements.txt", "# pins", ("", ("p", "==", "a"), ("p", "==", "b")), ""))
        .when((F.col("e") == "go"), two("go.mod", "require (", ("\t", ("p", " ", "a"), ("p", " ", "b")), ")"))
        .when((F.col("e") == "maven"), two("build.gradle", "dependencies {", ("    implementation '", ("p", ":", "a", "'"), ("p", ":", "b", "'")), "}"))
    )
    return c.select("change_id", text.alias("diff"))


def parsed_changes(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_changes(diff_texts(spark, d), "change_id").select(F.col("pr_id").alias("change_id"), "ecosystem", "package", "from_version", "to_version", "is_lockfile", "group_size", "error")


def with_ids(spark: SparkSession, d: str) -> DataFrame:
    return pr(spark, d).select("id", *discovery.KEY, "passes_manifest_only_filter", "parse_priority", "parse_attempted_at")


def errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors as earlier runs would have left them: of messages by their ids, several for some pull requests."""
    i = F.col("id")
    kind = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "timeout").otherwise("bad_diff")
    return pr(spark, d).where(i % 5 != 0).select(F.when(i % 3 == 0, "enrich").otherwise("parse").alias("stage"), "repo_owner", "repo_name", "pr_number", kind.alias("error_type"))


def parse_retry(spark: SparkSession, d: str) -> DataFrame:
    return store.needs_parse_retry(with_ids(spark, d), change(spark, d), errors(spark, d)).select("id")


def updated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Stored labels without version 1's outcomes, and version 2's put in their place."""
    s = lb.stored_labels(classification(spark, d)).select(*store.LABEL_KEY, "label")
    kept = store.delete_labels(s, ["outcome"], 1)
    new = s.where("classifier_version = 2").withColumn("classifier_version", F.lit(1))
    return kept.unionByName(store.insert_labels(kept, new))


def manifest_filter(spark: SparkSession, d: str) -> DataFrame:
    m = enrich.manifest_filter("files", "files_has_next_page", F.lit(False))
    p = pr(spark, d).where("files_json IS NOT NULL").withColumn("files", F.filter(dg.files_array("files_json"), lambda f: F.coalesce(f["path"] != "", F.lit(False))))
    return p.select("id", m["passes"].alias("passes"), m["reason"].alias("reason"), m["files"].cast("bigint").alias("n_files"), m["manifests"].cast("bigint").alias("n_manifests"), enrich.parse_priority("files", m["passes"], ["npm", "go"]).alias("priority"))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return store.with_group_size(change(spark, d).select("change_id", "pr_id")).select("change_id", F.col("group_size").cast("bigint").alias("n"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d, complete=False)
    return stats.cells(stats.pr_records(change(spark, d), pr(spark, d), w), stats.change_records(change(spark, d), w))


TABLE_KEYS = ["dimension", "stratifier", "unit"]
LEAST_PROJECTS = 3
#: A threshold under which some levels of the test tables lie.
RARE = 400

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {
    "alignment": alignment,
    "alignment_all": alignment_all,
    "alignment_summary": lambda s, d: al.summary(rows(s, d)),
    "alignment_targets": lambda s, d: al.targets_met(alignment(s, d), {e: 1 for e in paths.ECOSYSTEMS}, 3),
    "latest_decision": latest_decision,
    "discover_first_event": first_event,
    "archive_events": archive_events,
    "insert_ignore": insert_ignore,
    "needs_enrichment": needs_enrichment,
    "needs_parsing": needs_parsing,
    "wide_labels": wide_labels,
    "missing_labels": missing_labels,
    "classify_source": classify_source,
    "classify_semver": classify_semver,
    "classify_security": classify_security,
    "classify_outcome": classify_outcome,
    "classify_direct": classify_direct,
    "classified_labels": classified,
    "normalised_versions": normalised_versions,
    "label_distribution": label_distribution,
    "label_flips": label_flips,
    "path_ecosystems": path_ecosystems,
    "ordered_comments": ordered_comments,
    "supersession_match": supersession_match,
    "ecosystem_counts": lambda s, d: dg.ecosystem_counts(pr(s, d), change(s, d)),
    "zero_change_cases": lambda s, d: dg.zero_change_cases(pr(s, d), change(s, d)),
    "file_bins": lambda s, d: dg.file_bins(pr(s, d)),
    "next_page_fraction": lambda s, d: dg.next_page_fraction(pr(s, d)),
    "action_counts": lambda s, d: dg.action_counts(pr(s, d)),
    "repeated_triples": lambda s, d: dg.repeated_triples(change(s, d), pr(s, d), LEAST_PROJECTS),
    "pr_and_change_weighted": lambda s, d: dg.pr_and_change_weighted(change(s, d), pr(s, d), classification(s, d), VERSION),
    "pr_weighted_by_ecosystem": lambda s, d: dg.pr_weighted_by_ecosystem(change(s, d), pr(s, d), classification(s, d), VERSION),
    "consistency": lambda s, d: dg.consistency(change(s, d), pr(s, d), classification(s, d), VERSION),
    "group_size_bins": lambda s, d: dg.group_size_bins(change(s, d), pr(s, d), classification(s, d), VERSION),
    "parsed_changes": parsed_changes,
    "parse_retry": parse_retry,
    "error_counts": lambda s, d: dg.error_counts(errors(s, d)),
    "updated_labels": updated_labels,
    "manifest_filter": manifest_filter,
    "group_sizes": group_sizes,
    "contingency": cells,
    "cramers_v": lambda s, d: stats.cramers_v(cells(s, d), TABLE_KEYS),
    "pairwise_cramers_v": lambda s, d: stats.pairwise_v(cells(s, d)),
    "excluded_levels": lambda s, d: stats.excluded_levels(cells(s, d)),
    "rare_levels": lambda s, d: stats.excluded_levels(cells(s, d), RARE),
    "cramers_v_intervals": lambda s, d: stats.bootstrap_v(cells(s, d), TABLE_KEYS),
    "strata": lambda s, d: stats.strata(alignment(s, d), LEAST_PROJECTS),
    "strata_intervals": lambda s, d: stats.strata_intervals(alignment(s, d), LEAST_PROJECTS),
    "correlations": lambda s, d: stats.correlations(alignment(s, d), 2),
    "correlation_intervals": lambda s, d: stats.correlation_intervals(alignment(s, d), 2),
}

# --- SQL ---

_FIRST = "SELECT change_id, dimension, classifier_version, arg_min(label, classification_id) AS label FROM classification GROUP BY ALL"
_WIDE = "stored AS (" + _FIRST + "), wide AS (SELECT change_id, " + ", ".join(f"max(CASE WHEN dimension = '{x}' THEN label END) AS {x}" for x in classifiers.DIMENSIONS) + f" FROM stored WHERE classifier_version = {VERSION} GROUP BY change_id)"
_ROWS = (
    _WIDE
    + """,
complete AS (SELECT * FROM wide WHERE source IS NOT NULL AND semver_tier IS NOT NULL AND security IS NOT NULL AND direct_transitive IS NOT NULL AND outcome IS NOT NULL),
every AS (
  SELECT c.change_id, c.pr_id, c.ecosystem, c.package, c.from_version, c.to_version, coalesce(nullif(c.group_size, 0), 1) AS size,
    w.source, w.semver_tier, w.security, w.outcome, p.repo_owner, p.repo_name, coalesce(p.event_created_at, '') AS ts,
    coalesce(p.is_fork, false) OR coalesce(p.is_archived, false) AS away,
    w.outcome IN ('merged', 'closed-unmerged') AS decided, w.outcome IN ('open', 'superseded') AS excluded
  FROM pr_change c JOIN complete w USING (change_id) JOIN pr p ON p.id = c.pr_id),
r AS (SELECT * FROM every WHERE NOT away),
k AS (
  SELECT ecosystem, package, from_version, to_version, repo_owner, repo_name,
    arg_max(outcome, (ts, change_id)) FILTER (WHERE decided) AS decision,
    arg_max(outcome, (ts, change_id)) FILTER (WHERE excluded) AS excluded
  FROM r GROUP BY ALL),
tri AS (
  SELECT ecosystem, package, from_version, to_version, count(*) AS k_projects_all, count(decision) AS k_projects_decided,
    count(*) FILTER (WHERE decision = 'merged') AS n_merged, count(*) FILTER (WHERE decision = 'closed-unmerged') AS n_closed_unmerged,
    count(*) FILTER (WHERE decision IS NULL AND excluded = 'open') AS n_open,
    count(*) FILTER (WHERE decision IS NULL AND excluded = 'superseded') AS n_superseded
  FROM k GROUP BY ALL),
tier AS (
  SELECT ecosystem, package, from_version, to_version, semver_tier, count(*) AS n FROM r WHERE decided GROUP BY ecosystem, package, from_version, to_version, semver_tier
  QUALIFY row_number() OVER (PARTITION BY ecosystem, package, from_version, to_version ORDER BY count(*) DESC, semver_tier) = 1),
agg AS (
  SELECT ecosystem, package, from_version, to_version, count(*) FILTER (WHERE decided) AS k_changes, count(*) AS k_changes_total,
    count(*) FILTER (WHERE decided AND security = 'security') AS n_security,
    count(*) FILTER (WHERE decided AND source = 'dependabot') AS n_dependabot, count(*) FILTER (WHERE decided AND source = 'renovate') AS n_renovate,
    count(*) FILTER (WHERE decided AND source = 'human') AS n_human, count(*) FILTER (WHERE decided AND source = 'other-bot') AS n_other_bot,
    avg(size) FILTER (WHERE decided) AS mean_size, median(size) FILTER (WHERE decided) AS median_size, max(size) FILTER (WHERE decided) AS max_size,
    count(*) FILTER (WHERE decided AND size <> 1) AS other_sizes,
    count(*) FILTER (WHERE excluded) AS excluded_rows, count(*) FILTER (WHERE outcome = 'superseded') AS superseded_rows, count(*) FILTER (WHERE outcome = 'open') AS open_rows
  FROM r GROUP BY ALL),
j AS (
  SELECT tri.*, agg.* EXCLUDE (ecosystem, package, from_version, to_version) FROM tri JOIN agg ON tri.ecosystem IS NOT DISTINCT FROM agg.ecosystem
    AND tri.package IS NOT DISTINCT FROM agg.package AND tri.from_version IS NOT DISTINCT FROM agg.from_version AND tri.to_version IS NOT DISTINCT FROM agg.to_version),
alignment AS (
  SELECT j.ecosystem, j.package, j.from_version, j.to_version, tier.semver_tier, k_projects_all, k_projects_decided, k_changes, k_changes_total,
    n_merged, n_closed_unmerged, n_open, n_superseded, CAST(n_security > 0 AS INT) AS is_security_any, CAST(n_security = k_changes AS INT) AS is_security_all,
    n_dependabot, n_renovate, n_human, n_other_bot,
    CASE WHEN k_changes = 0 THEN 'mixed_other' WHEN n_dependabot = k_changes THEN 'all_dependabot' WHEN n_renovate = k_changes THEN 'all_renovate'
      WHEN n_human = k_changes THEN 'all_human' WHEN n_other_bot = k_changes THEN 'all_other_bot'
      WHEN n_human = 0 THEN 'mixed_bots' ELSE 'mixed_bot_human' END AS source_mix,
    round(CASE WHEN k_projects_decided <= 1 OR greatest(n_merged, n_closed_unmerged) = k_projects_decided THEN 1.0
      ELSE 1.0 + (n_merged / k_projects_decided * ln(n_merged / k_projects_decided) + n_closed_unmerged / k_projects_decided * ln(n_closed_unmerged / k_projects_decided)) / ln(2) END, 9) AS alignment,
    round(mean_size, 9) AS mean_group_size, CAST(median_size AS DOUBLE) AS median_group_size, max_size AS max_group_size, CAST(other_sizes = 0 AS INT) AS all_singleton
  FROM j JOIN tier ON j.ecosystem IS NOT DISTINCT FROM tier.ecosystem AND j.package IS NOT DISTINCT FROM tier.package
    AND j.from_version IS NOT DISTINCT FROM tier.from_version AND j.to_version IS NOT DISTINCT FROM tier.to_version
  WHERE k_projects_decided >= 1)"""
)
_ECOS = paths.ECOSYSTEMS
_BINS = lambda n, above: f"CASE WHEN {n} <= 5 THEN CAST({n} AS VARCHAR) WHEN {n} <= 10 THEN '6-10' WHEN {n} <= 25 THEN '11-25' WHEN {n} <= 50 THEN '26-50' ELSE '{above}' END"
_NAME = lambda p: f"regexp_extract({p}, '([^/]*)$', 1)"


def _eco(p: str) -> str:
    name, q = _NAME(p), lambda names: ", ".join(f"'{n}'" for n in names)
    parts = [f"WHEN {name} IN ({q(names)})" + (f" OR {name} LIKE 'requirements%.txt' OR {p} LIKE 'requirements%.txt'" if e == "pip" else "") + f" THEN '{e}'" for e, names in paths.MANIFESTS.items()]
    return "CASE " + " ".join(parts) + " END"


_LOCK = lambda p: f"{_NAME(p)} IN ({', '.join(repr(x) for x in paths.LOCKFILES)})"
_DIR = lambda p: f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '.' END"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_UNQUOTE = lambda x: f"regexp_replace({x}, '^[\"'']+|[\"'']+$', '', 'g')"
_NORM = lambda x: _UNQUOTE(_STRIP("regexp_replace(" + _UNQUOTE(_STRIP(x)) + ", '^((>=|<=|==|!=|~=|[\\^~><=])\\s*)+', '')"))
_PEP = versions.PEP440.replace("(?:[0-9]+)?", "[0-9]*")
_RELEASE = lambda x: f"(SELECT list_transform(list_slice(list_concat(l, ['0', '0']), 1, 3), lambda y: regexp_replace(y, '^0+([0-9])', '\\1')) FROM (SELECT CASE WHEN regexp_matches(lower({x}), '{versions.PEP440}') THEN string_split(regexp_extract(lower({x}), '{versions.PEP440}', 2), '.') ELSE regexp_extract_all({x}, '[0-9]+') END AS l) WHERE len(l) > 0)"
_BOTS = ", ".join(repr(b) for b in classifiers.BOTS)


def _who(login: str, kind: str | None) -> str:
    typed = f"WHEN lower(coalesce({kind}, '')) = 'bot' THEN 'other-bot' " if kind else ""
    return (
        f"CASE WHEN regexp_full_match(lower({login}), 'dependabot(\\[bot\\])?') THEN 'dependabot' WHEN regexp_full_match(lower({login}), '(renovate|renovate-bot)(\\[bot\\])?') THEN 'renovate' "
        f"{typed}WHEN lower({login}) LIKE '%[bot]' OR regexp_replace(lower({login}), '\\[bot\\]$', '') IN ({_BOTS}) THEN 'other-bot' ELSE 'human' END"
    )


_FILES = "CASE WHEN json_valid(files_json) AND json_type(files_json) = 'ARRAY' THEN list_filter(list_transform(CAST(json_extract(files_json, '$[*]') AS JSON[]), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN {'path': json_extract_string(x, '$.path')} END), lambda x: x IS NOT NULL) ELSE [] END"
_TEXT = "concat_ws(chr(10), nullif(title, ''), nullif(body, '')"
_REASON = "CASE WHEN manifest_filter_reason IN (" + ", ".join(repr(x) for x in dg.FILTER_REASONS) + ") THEN manifest_filter_reason ELSE 'other/unknown' END"
_FILED = f"""filed AS (
  SELECT id, passes_manifest_only_filter AS passes, {_REASON} AS reason, {_FILES} AS files FROM pr WHERE files_json IS NOT NULL),
ecos AS (
  SELECT f.*, list_sort(list_distinct(list_filter(list_transform(files, lambda x: {_eco("coalesce(x.path, '')")}), lambda e: e IS NOT NULL))) AS found FROM filed f),
matched AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['unmatched'] END AS ecosystems FROM ecos)"""
_CLASSIFIED = f"stored AS ({_FIRST}), cl AS (SELECT c.change_id, c.pr_id, c.ecosystem, c.group_size, s.dimension, s.label FROM pr_change c JOIN stored s USING (change_id) WHERE s.classifier_version = {VERSION} AND EXISTS (SELECT 1 FROM pr p WHERE p.id = c.pr_id))"
_MODAL = "modal AS (SELECT dimension, pr_id, label FROM cl WHERE dimension IN ('source', 'outcome', 'security') GROUP BY dimension, pr_id, label QUALIFY row_number() OVER (PARTITION BY dimension, pr_id ORDER BY count(*) DESC, label) = 1)"
_COMMENTS = """cm AS (
  SELECT doc_id AS id, 1000 + doc_id // 3 AS pr_id, CASE WHEN source = 'bot_comment' THEN CASE WHEN doc_id % 3 = 0 THEN 'renovate' ELSE 'dependabot' END ELSE 'human' END AS family,
    CASE WHEN doc_id % 5 = 0 THEN 'Superseded by #' || doc_id ELSE coalesce(text, '') END AS body, strftime(make_timestamp(epoch_us(collected_at)), '%Y-%m-%dT%H:%M:%S') AS created_at
  FROM documents WHERE source IN ('bot_comment', 'review_thread'))"""
_ERRORS = """err AS (SELECT CASE WHEN id % 3 = 0 THEN 'enrich' ELSE 'parse' END AS stage, repo_owner, repo_name, pr_number,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'timeout' ELSE 'bad_diff' END AS error_type FROM pr WHERE id % 5 <> 0)"""
_RECORDS = (
    _WIDE
    + """,
per AS (SELECT c.pr_id, c.ecosystem, w.* EXCLUDE (change_id, semver_tier, direct_transitive) FROM pr_change c JOIN wide w USING (change_id)
  WHERE source IS NOT NULL AND outcome IS NOT NULL AND security IS NOT NULL AND EXISTS (SELECT 1 FROM pr p WHERE p.id = c.pr_id)),
prs AS (SELECT e.pr_id, e.ecosystem, s.label AS source, o.label AS outcome, q.label AS security FROM (SELECT pr_id, min(ecosystem) AS ecosystem FROM per GROUP BY pr_id) e"""
    + "".join(f" JOIN (SELECT pr_id, {d} AS label FROM per GROUP BY pr_id, {d} QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY count(*) DESC, {d}) = 1) {a} ON {a}.pr_id = e.pr_id" for d, a in (("source", "s"), ("outcome", "o"), ("security", "q")))
    + "), chs AS (SELECT c.ecosystem, w.source, w.semver_tier, w.direct_transitive FROM pr_change c JOIN wide w USING (change_id) WHERE w.source IS NOT NULL AND semver_tier IS NOT NULL AND direct_transitive IS NOT NULL),"
    + "long AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{s}' AS stratifier, '{u}' AS unit, {s} AS \"row\", {d} AS col FROM {src}" for u, src, ds in (("pr", "prs", stats.PR_DIMENSIONS), ("change", "chs", stats.CHANGE_DIMENSIONS)) for d in ds for s in stats.STRATIFIER_LEVELS)
    + "), cell AS (SELECT *, count(*) AS n FROM long WHERE "
    + " AND ".join(f"(dimension <> '{d}' OR col IN ({', '.join(map(repr, levels))}))" for d, levels in stats.DIMENSION_LEVELS.items())
    + " AND "
    + " AND ".join(f"(stratifier <> '{s}' OR \"row\" IN ({', '.join(map(repr, levels))}))" for s, levels in stats.STRATIFIER_LEVELS.items())
    + " GROUP BY ALL)"
)


def _v(cell: str, keys: str) -> str:
    return f"""marg AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, "row") AS r, sum(n) OVER (PARTITION BY {keys}, col) AS c FROM {cell}),
tot AS (SELECT {keys}, sum(n) AS n, sum(n * n / r / c) AS s, least(count(DISTINCT "row"), count(DISTINCT col)) AS m FROM marg GROUP BY ALL)
SELECT {keys}, CAST(n AS BIGINT) AS n, round(CASE WHEN m >= 2 THEN least(sqrt(greatest(s - 1, 0) / nullif(m - 1, 0)), 1.0) ELSE 0.0 END, 9) AS v FROM tot"""


_LEVEL_ORDER = "CASE lv " + " ".join(f"WHEN '{x}' THEN {i}" for levels in stats.STRATIFIER_LEVELS.values() for i, x in enumerate(levels)) + " END"
_STRATA = " UNION ALL ".join(
    "SELECT '"
    + ("_x_".join(s) or "overall")
    + "' AS scope, "
    + ", ".join((f"CAST({c} AS VARCHAR)" if c in s else "CAST(NULL AS VARCHAR)") + f" AS {c}" for c in stats.STRATUM_COLUMNS)
    + f", count(*) AS n, round(avg(alignment), 9) AS mean, round(median(alignment), 9) AS median, count(*) >= {stats.LEAST_N} AS reportable FROM alignment WHERE k_projects_decided >= {LEAST_PROJECTS} GROUP BY ALL HAVING count(*) > 0"
    for s in ((), *stats.STRATA)
)

SQL: dict[str, str] = {
    "alignment": f"WITH {_ROWS} SELECT * FROM alignment WHERE k_projects_decided >= 2",
    "alignment_all": f"WITH {_ROWS} SELECT * FROM alignment",
    "alignment_summary": f"""WITH {_ROWS} SELECT a.*, b.* FROM (SELECT count(*) FILTER (WHERE k_projects_decided > 0) AS triples_total,
  {", ".join(f"count(*) FILTER (WHERE k_projects_decided >= {n}) AS triples_k_ge_{n}" for n in (2, 3, 5))},
  {", ".join(f"count(*) FILTER (WHERE k_projects_decided >= 5 AND ecosystem = '{e}') AS triples_k_ge_5_{e}" for e in _ECOS)},
  count(*) FILTER (WHERE k_projects_decided >= 5 AND other_sizes = 0) AS triples_k_ge_5_all_singleton,
  count(*) FILTER (WHERE k_changes < k_changes_total AND open_rows > 0) AS triples_with_open_projects,
  count(*) FILTER (WHERE k_changes < k_changes_total) AS triples_with_non_decision_projects,
  count(*) FILTER (WHERE k_projects_decided = 0) AS triples_dropped_zero_decided,
  count(*) FILTER (WHERE k_projects_decided = 0 AND superseded_rows = k_changes_total) AS triples_dropped_only_superseded,
  count(*) FILTER (WHERE k_projects_decided < 2) AS triples_below_k2_after_non_decision_exclusion,
  CAST(coalesce(sum(excluded_rows - superseded_rows), 0) AS BIGINT) AS open_change_rows_excluded,
  CAST(coalesce(sum(superseded_rows), 0) AS BIGINT) AS superseded_change_rows_excluded,
  CAST(coalesce(sum(excluded_rows), 0) AS BIGINT) AS non_decision_change_rows_excluded FROM j) a,
  (SELECT count(*) AS fork_or_archived_change_rows_excluded, {", ".join(f"count(*) FILTER (WHERE ecosystem = '{e}') AS fork_or_archived_change_rows_excluded_{e}" for e in _ECOS)} FROM every WHERE away) b""",
    "alignment_targets": f"WITH {_ROWS} SELECT e AS ecosystem, CAST(1 AS BIGINT) AS target, count(a.ecosystem) AS n, count(a.ecosystem) >= 1 AS met FROM (SELECT unnest([{', '.join(map(repr, _ECOS))}]) AS e) LEFT JOIN alignment a ON a.ecosystem = e AND k_projects_decided >= 3 GROUP BY e",
    "latest_decision": f"WITH {_ROWS} SELECT * FROM k",
    "discover_first_event": "SELECT id, repo_owner, repo_name, pr_number, event_created_at, pr_action, actor_login FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY repo_owner, repo_name, pr_number ORDER BY event_created_at, id) = 1) WHERE pr_action IN ('opened', 'synchronize', 'reopened') OR pr_action IS NULL",
    "archive_events": """WITH e AS (SELECT event_id, 'owner' AS repo_owner, 'user' || user_id AS repo_name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pr_number, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS event_created_at,
  'actor' || (event_id % 7) AS actor_login, CASE event_type WHEN 'purchase' THEN 'opened' WHEN 'click' THEN 'synchronize' WHEN 'view' THEN 'closed' ELSE 'reopened' END AS pr_action FROM events WHERE event_type <> 'error')
SELECT * FROM e WHERE pr_action <> 'closed' QUALIFY row_number() OVER (PARTITION BY repo_owner, repo_name, pr_number ORDER BY event_created_at, event_id) = 1""",
    "insert_ignore": "SELECT id, repo_owner, repo_name, pr_number FROM (SELECT * FROM pr WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY repo_owner, repo_name, pr_number ORDER BY id) = 1) n WHERE NOT EXISTS (SELECT 1 FROM pr o WHERE o.id % 2 = 0 AND o.repo_owner = n.repo_owner AND o.repo_name = n.repo_name AND o.pr_number = n.pr_number)",
    "needs_enrichment": "SELECT id FROM pr WHERE enriched_at IS NULL",
    "needs_parsing": "SELECT id FROM pr WHERE passes_manifest_only_filter AND parse_attempted_at IS NULL AND (parse_priority IS NULL OR parse_priority = 'priority') AND NOT EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = pr.id)",
    "wide_labels": f"WITH {_WIDE} SELECT * FROM wide",
    "missing_labels": "SELECT change_id FROM pr_change c WHERE (SELECT count(DISTINCT dimension) FROM classification l WHERE l.change_id = c.change_id AND classifier_version = 2 AND dimension IN ('source', 'outcome')) < 2",
    "classify_source": f"SELECT id, CASE WHEN coalesce(author_login, '') <> '' THEN {_who('author_login', 'author_type')} WHEN coalesce(actor_login, '') <> '' THEN {_who('actor_login', None)} ELSE 'human' END AS label FROM pr",
    "normalised_versions": f"SELECT change_id, {_NORM('from_version')} AS old, {_NORM('to_version')} AS new FROM pr_change",
    "classify_semver": f"""WITH n AS (SELECT change_id, from_version, {_NORM('from_version')} AS a, {_NORM('to_version')} AS b FROM pr_change),
p AS (SELECT *, {_RELEASE('a')} AS p, {_RELEASE('b')} AS q FROM n)
SELECT change_id, CASE WHEN from_version IS NULL THEN 'unknown'
  WHEN regexp_matches(a, '{versions.SHA}') OR regexp_matches(b, '{versions.SHA}') THEN 'sha-pin'
  WHEN regexp_matches(a, '{versions.CALVER}') OR regexp_matches(b, '{versions.CALVER}') THEN 'calver'
  WHEN regexp_matches(a, '{versions.PRERELEASE}') OR regexp_matches(b, '{versions.PRERELEASE}') THEN 'prerelease'
  WHEN p IS NULL OR q IS NULL THEN 'unknown' WHEN p[1] <> q[1] THEN 'major' WHEN p[2] <> q[2] THEN 'minor' WHEN p[3] <> q[3] THEN 'patch' ELSE 'unknown' END AS label FROM p""",
    "classify_security": f"SELECT id, CASE WHEN regexp_matches({_TEXT}, nullif(commit_messages_concat, '')), '{classifiers.ADVISORY}') THEN 'security' ELSE 'non-security' END AS label FROM pr",
    "classify_outcome": f"""WITH x AS (SELECT id, coalesce(merged, false) AS m, lower(coalesce(state, '')) AS s, regexp_matches({_TEXT}), '{classifiers.SUPERSEDED}') AS said FROM pr)
SELECT id, CASE WHEN m THEN 'merged' WHEN s = 'open' THEN 'open' WHEN s = 'closed' AND said THEN 'superseded' WHEN s = 'closed' THEN 'closed-unmerged' ELSE 'unknown' END AS label,
  CASE WHEN NOT m AND s = 'closed' AND said THEN 'title_body' END AS reason FROM x""",
    "classify_direct": f"""WITH f AS (SELECT id, {_TEXT}) AS text, {_FILES} AS files FROM pr),
c AS (SELECT c.*, f.text, f.files, EXISTS (SELECT 1 FROM pr_change s WHERE s.pr_id = c.pr_id AND s.ecosystem = c.ecosystem AND s.package = c.package AND NOT coalesce(s.is_lockfile, false)) AS sibling FROM pr_change c JOIN f ON f.id = c.pr_id),
n AS (SELECT *, [lower(package), lower(split_part(package, ':', -1)), replace(lower(package), '_', '-'), replace(lower(package), '-', '_')] AS forms FROM c)
SELECT change_id, CASE WHEN NOT coalesce(is_lockfile, false) OR sibling THEN 'direct'
  WHEN len(list_filter(files, lambda x: coalesce({_eco('x.path')} = ecosystem AND NOT {_LOCK('x.path')} AND {_DIR('x.path')} = {_DIR('manifest_path')}, false))) > 0
    AND len(list_filter(forms, lambda x: regexp_matches(lower(text), '(^|[^a-z0-9_./-])' || regexp_escape(x) || '($|[^a-z0-9_./-])'))) > 0 THEN 'direct' ELSE 'transitive' END AS label FROM n""",
    "label_distribution": f"SELECT dimension, label, count(*) AS n FROM ({_FIRST}) WHERE classifier_version = {VERSION} GROUP BY ALL",
    "label_flips": f"WITH s AS ({_FIRST}) SELECT o.dimension, o.label AS old_label, n.label AS new_label, count(*) AS n FROM s o JOIN s n USING (change_id, dimension) WHERE o.classifier_version = 1 AND n.classifier_version = 2 AND o.label <> n.label GROUP BY ALL",
    "path_ecosystems": f"SELECT DISTINCT manifest_path, {_eco('manifest_path')} AS ecosystem, {_LOCK('manifest_path')} AS is_lockfile, {_DIR('manifest_path')} AS folder FROM pr_change",
    "ordered_comments": f"""WITH {_COMMENTS} SELECT pr_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at NULLS FIRST, id) AS ids,
  md5(string_agg(CASE family WHEN 'human' THEN 'reviewer' ELSE family || '[bot]' END || ':' || body, '|' ORDER BY created_at NULLS FIRST, id)) AS said FROM cm GROUP BY pr_id""",
    "supersession_match": f"""WITH {_COMMENTS}, m AS (SELECT *, CASE
    WHEN body = '' OR regexp_matches(body, '{comments.EXCLUDED}') THEN NULL
    {" ".join(f"WHEN family = '{f}' AND regexp_matches(body, '{p}') THEN '{i:02d}'" for i, (f, p, _, _) in enumerate(comments.PATTERNS))} END AS hit FROM cm)
SELECT pr_id, CASE hit {" ".join(f"WHEN '{i:02d}' THEN '{r}'" for i, (_, _, r, _) in enumerate(comments.PATTERNS))} END AS reason, family AS bot_family,
  CASE hit {" ".join(f"WHEN '{i:02d}' THEN '{n}'" for i, (_, _, _, n) in enumerate(comments.PATTERNS))} END AS pattern_name, created_at
FROM m WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1""",
    "ecosystem_counts": f"""WITH {_FILED}, x AS (SELECT id, passes, reason, unnest(ecosystems) AS ecosystem FROM matched),
told AS (
  SELECT 'candidates' AS measure, ecosystem, NULL AS reason FROM x
  UNION ALL SELECT 'filter_pass', ecosystem, NULL FROM x WHERE passes
  UNION ALL SELECT 'zero_changes', ecosystem, NULL FROM x WHERE passes AND NOT EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = x.id)
  UNION ALL SELECT 'filter_fail', ecosystem, reason FROM x WHERE NOT passes
  UNION ALL SELECT 'filter_fail', 'unmatched', {_REASON} FROM pr WHERE enriched_at IS NOT NULL AND files_json IS NULL AND NOT passes_manifest_only_filter
  UNION ALL SELECT 'parse_success', ecosystem, NULL FROM (SELECT DISTINCT pr_id, ecosystem FROM pr_change))
SELECT *, count(*) AS n FROM told GROUP BY ALL""",
    "zero_change_cases": f"""WITH {_FILED}, z AS (SELECT id AS pr_id, ecosystems, list_filter(list_transform(files, lambda x: x.path), lambda y: {_eco('y')} IS NOT NULL) AS manifest_paths FROM matched
  WHERE passes AND NOT EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = matched.id))
SELECT *, len(manifest_paths) > 0 AND len(list_filter(manifest_paths, lambda y: NOT ({_LOCK('y')} OR {_NAME('y')} IN ('build.gradle', 'build.gradle.kts')))) = 0 AS all_paths_known_stubs FROM z""",
    "file_bins": f"""WITH b AS (SELECT CASE WHEN coalesce(files_has_next_page, false) THEN '>100' WHEN n >= 1 THEN {_BINS('n', '51-100')} ELSE 'zero' END AS bin
  FROM (SELECT files_has_next_page, coalesce(file_count, len({_FILES})) AS n FROM pr WHERE files_json IS NOT NULL))
SELECT v AS bin, count(b.bin) AS n FROM (SELECT unnest([{', '.join(map(repr, (*dg.FILE_BINS, 'zero')))}]) AS v) LEFT JOIN b ON b.bin = v GROUP BY v""",
    "next_page_fraction": "SELECT count(*) FILTER (WHERE files_has_next_page) AS n, count(files_has_next_page) AS denominator, coalesce(count(*) FILTER (WHERE files_has_next_page) / nullif(count(files_has_next_page), 0), 0.0) AS fraction FROM pr WHERE enriched_at IS NOT NULL",
    "action_counts": "SELECT coalesce(nullif(pr_action, ''), 'unknown') AS pr_action, count(*) AS n FROM pr WHERE enriched_at IS NOT NULL GROUP BY ALL",
    "stage_counts": """SELECT 'pr_total' AS name, count(*) AS n FROM pr UNION ALL SELECT 'pr_enriched', count(enriched_at) FROM pr
UNION ALL SELECT 'pr_passing', count(*) FROM pr WHERE passes_manifest_only_filter UNION ALL SELECT 'pr_failing', count(*) FROM pr WHERE NOT passes_manifest_only_filter
UNION ALL SELECT 'pr_parse_attempted', count(parse_attempted_at) FROM pr UNION ALL SELECT 'changes', count(*) FROM pr_change
UNION ALL SELECT 'pr_with_changes', count(DISTINCT pr_id) FROM pr_change UNION ALL SELECT 'classifications', count(*) FROM classification
UNION ALL SELECT 'changes_classified', count(DISTINCT change_id) FROM classification
UNION ALL SELECT 'reason:' || coalesce(manifest_filter_reason, 'unknown'), count(*) FROM pr WHERE NOT passes_manifest_only_filter GROUP BY ALL""",
    "repeated_triples": f"""WITH x AS (SELECT ecosystem, count(DISTINCT repo_owner || '/' || repo_name) AS k, sum(CASE WHEN coalesce(group_size, 0) = 1 THEN 0 ELSE 1 END) AS other
  FROM pr_change c JOIN pr p ON p.id = c.pr_id GROUP BY ecosystem, package, from_version, to_version)
SELECT ecosystem, count(*) AS repeated_triples, count(*) FILTER (WHERE other = 0) AS singleton_restricted FROM x WHERE k >= {LEAST_PROJECTS} GROUP BY GROUPING SETS ((), (ecosystem))""",
    "pr_and_change_weighted": f"""WITH {_CLASSIFIED}, {_MODAL}, a AS (SELECT dimension, label, count(*) AS n FROM modal GROUP BY ALL), b AS (SELECT dimension, label, count(*) AS n FROM cl WHERE dimension IN ('source', 'outcome', 'security') GROUP BY ALL)
SELECT dimension, label, coalesce(a.n, 0) AS n_prs, coalesce(b.n, 0) AS n_changes FROM a FULL JOIN b USING (dimension, label)""",
    "pr_weighted_by_ecosystem": f"WITH {_CLASSIFIED}, {_MODAL}, n AS (SELECT dimension, ecosystem, label, count(*) AS n_prs FROM modal JOIN (SELECT DISTINCT pr_id, ecosystem FROM cl) USING (pr_id) GROUP BY ALL) SELECT *, n_prs / sum(n_prs) OVER (PARTITION BY dimension, ecosystem) AS share FROM n",
    "consistency": f"""WITH {_CLASSIFIED} SELECT 'violations:' || dimension AS name, count(*) AS n FROM (SELECT dimension, pr_id FROM cl WHERE dimension IN ('source', 'outcome', 'security') GROUP BY ALL HAVING count(DISTINCT label) > 1) GROUP BY ALL
UNION ALL SELECT 'cross_ecosystem', count(*) FROM (SELECT pr_id FROM cl GROUP BY pr_id HAVING count(DISTINCT ecosystem) > 1)""",
    "group_size_bins": f"""WITH {_CLASSIFIED}, b AS (SELECT DISTINCT change_id, CASE WHEN group_size IS NULL OR group_size < 1 THEN 'unknown' ELSE {_BINS('group_size', '>50')} END AS bin FROM cl)
SELECT v AS bin, count(b.bin) AS n FROM (SELECT unnest([{', '.join(map(repr, dg.GROUP_SIZE_BINS))}]) AS v) LEFT JOIN b ON b.bin = v GROUP BY v UNION ALL SELECT bin, count(*) FROM b WHERE bin = 'unknown' GROUP BY bin""",
    "parsed_changes": """WITH c AS (SELECT change_id, lower(trim(ecosystem)) AS e, trim(package) AS p, coalesce(from_version, '0') AS a, to_version AS b, coalesce(is_lockfile, false) AS l FROM pr_change)
SELECT change_id, e AS ecosystem, p AS package, a AS from_version, b AS to_version, e = 'cargo' OR (e = 'npm' AND l) AS is_lockfile, 1 AS group_size, CAST(NULL AS VARCHAR) AS error FROM c
WHERE a <> b AND e IN ('npm', 'cargo', 'pip', 'go', 'maven') AND (e <> 'maven' OR regexp_full_match(p, '[^:]+:[^:]+'))""",
    "parse_retry": f"""WITH {_ERRORS} SELECT id FROM pr WHERE passes_manifest_only_filter AND (parse_priority IS NULL OR parse_priority = 'priority') AND NOT EXISTS (SELECT 1 FROM pr_change c WHERE c.pr_id = pr.id)
  AND EXISTS (SELECT 1 FROM err e WHERE e.stage = 'parse' AND e.repo_owner = pr.repo_owner AND e.repo_name = pr.repo_name AND e.pr_number = pr.pr_number)""",
    "error_counts": f"WITH {_ERRORS} SELECT stage, coalesce(error_type, 'unknown') AS error_type, count(*) AS n FROM err GROUP BY ALL",
    "updated_labels": f"""WITH s AS ({_FIRST}), kept AS (SELECT * FROM s WHERE NOT (classifier_version = 1 AND dimension = 'outcome'))
SELECT * FROM kept UNION ALL SELECT change_id, dimension, 1, label FROM s WHERE classifier_version = 2 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.change_id = s.change_id AND k.dimension = s.dimension AND k.classifier_version = 1)""",
    "manifest_filter": f"""WITH f AS (SELECT id, coalesce(files_has_next_page, false) AS more, list_filter({_FILES}, lambda x: coalesce(x.path, '') <> '') AS files FROM pr WHERE files_json IS NOT NULL),
g AS (SELECT *, len(files) AS n, list_filter(list_transform(files, lambda x: {_eco('x.path')}), lambda e: e IS NOT NULL) AS ecos FROM f),
h AS (SELECT *, len(ecos) AS m, len(ecos) > 0 AND len(ecos) = n AND NOT more AS passes FROM g)
SELECT id, passes, CASE WHEN passes THEN 'passed' WHEN more THEN 'too_many_files' WHEN m = 0 THEN 'no_manifest_files' WHEN m < n THEN 'mixed_manifest_and_non_manifest_files' ELSE 'other' END AS reason, n AS n_files, m AS n_manifests,
  CASE WHEN passes THEN CASE WHEN list_has_any(ecos, ['npm', 'go']) THEN 'priority' ELSE 'deferred_non_priority' END END AS priority FROM h""",
    "group_sizes": "SELECT change_id, count(*) OVER (PARTITION BY pr_id) AS n FROM pr_change WHERE pr_id IS NOT NULL",
    "contingency": f"WITH {_RECORDS} SELECT * FROM cell",
    "cramers_v": f"WITH {_RECORDS}, {_v('cell', 'dimension, stratifier, unit')}",
    "pairwise_cramers_v": f"""WITH {_RECORDS}, lv AS (SELECT dimension, stratifier, unit, "row" AS lv, sum(n) AS n, {_LEVEL_ORDER.replace('lv ', '"row" ', 1)} AS o FROM cell GROUP BY ALL HAVING sum(n) >= 30),
pair AS (SELECT x.dimension, x.stratifier, x.unit, x.lv AS a, y.lv AS b, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b FROM lv x JOIN lv y USING (dimension, stratifier, unit) WHERE x.o < y.o),
pc AS (SELECT c.*, a, b, n_a, n_b FROM cell c JOIN pair p USING (dimension, stratifier, unit) WHERE c."row" IN (a, b)),
res AS (WITH {_v('pc', 'dimension, stratifier, unit, a, b, n_a, n_b')}) SELECT * EXCLUDE (n), v >= 0.1 AS substantive FROM res""",
    "excluded_levels": f'WITH {_RECORDS} SELECT dimension, stratifier, unit, "row" AS level, CAST(sum(n) AS BIGINT) AS n FROM cell GROUP BY ALL HAVING sum(n) < 30',
    "rare_levels": f'WITH {_RECORDS} SELECT dimension, stratifier, unit, "row" AS level, CAST(sum(n) AS BIGINT) AS n FROM cell GROUP BY ALL HAVING sum(n) < {RARE}',
    "strata": f"WITH {_ROWS.replace('WHERE k_projects_decided >= 1)', 'WHERE k_projects_decided >= 2)')}, res AS ({_STRATA}) SELECT * FROM res",
    "correlations": f"""WITH {_ROWS}, x AS (SELECT unnest(['all', ecosystem]) AS scope, mean_group_size AS x, alignment AS y FROM alignment WHERE k_projects_decided >= 2),
rk AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY x) + (count(*) OVER (PARTITION BY scope, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY scope ORDER BY y) + (count(*) OVER (PARTITION BY scope, y) - 1) / 2 AS ry FROM x)
SELECT scope, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN count(*) >= 3 AND count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN round(corr(rx, ry), 6) END AS spearman FROM rk GROUP BY scope""",
}

_OF_PR = " UNION ALL ".join(f"SELECT c.change_id, '{d}' AS dimension, x.label FROM pr_change c JOIN ({SQL[q]}) x ON x.id = c.pr_id" for d, q in (("source", "classify_source"), ("security", "classify_security"), ("outcome", "classify_outcome")))
_OF_CHANGE = " UNION ALL ".join(f"SELECT c.change_id, '{d}' AS dimension, x.label FROM pr_change c JOIN ({SQL[q]}) x USING (change_id) WHERE EXISTS (SELECT 1 FROM pr p WHERE p.id = c.pr_id)" for d, q in (("semver_tier", "classify_semver"), ("direct_transitive", "classify_direct")))
SQL["classified_labels"] = f"SELECT *, {VERSION} AS classifier_version FROM ({_OF_PR} UNION ALL {_OF_CHANGE})"
