"""The general data-processing problems: their queries over the whole tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dedup, increments, nested, orphans, skew
from ..sources.tables import scratch, table

HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.message_copies(table(spark, d, "pr"))


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    return dedup.messages(table(spark, d, "pr")).select("id", "repo_owner", "repo_name", "pr_number", "event_created_at", "pr_action")


def p1_first_delivered(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_deliveries(table(spark, d, "pr"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.pipeline_orphans(*(table(spark, d, t) for t in ("pr", "pr_change", "classification", "tombstone")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.change_references(table(spark, d, "pr_change")).unionByName(orphans.classification_references(table(spark, d, "classification")))
    return orphans.orphan_report(_orphans(spark, d), refs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.next_parse(table(spark, d, "pr"), table(spark, d, "pipeline_run"), scratch(spark, "increment"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten(table(spark, d, "pr"), "id", "files_json", ("file", "hunk", "bump"), values=False).select("id", "file_no", "hunk_no", "bump_no")


def _level(level: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: nested.level_table(nested.flatten(table(spark, d, "pr"), "id", "files_json", (level,)), level)


def p5_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each variant's table and how many of their parents stand in the parents' tables, all tables written in one pass."""
    tables = nested.route(nested.flatten(table(spark, d, "pr"), "id", "files_json"), scratch(spark, "nested"))
    out, parents = None, None
    for level, variants in nested.VARIANTS.items():
        keys = nested.KEYS[: 2 + nested.LEVELS.index(level)]
        rows = None
        for v in variants:
            one = tables[v].select(*keys, F.lit(v).alias("variant"))
            rows = one if rows is None else rows.unionByName(one)
        linked = rows.withColumn("linked", F.lit(1)) if parents is None else rows.join(parents.select(*keys[:-1]).distinct().withColumn("linked", F.lit(1)), keys[:-1], "left")
        n = linked.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("linked").alias("n_linked")).select(F.lit(level).alias("level"), "variant", "n", "n_linked")
        out, parents = n if out is None else out.unionByName(n), rows
    return out


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return skew.package_counts(table(spark, d, "pr_change"), table(spark, d, "pr")).select("ecosystem", "package", "n_changes", "n_pull_requests")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(p6_counts(spark, d), table(spark, d, "pr_change"), HEAVY_SHARE).select("ecosystem", "package")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_messages": p1_messages,
    "p1_first_delivered": p1_first_delivered,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p5_files": _level("file"),
    "p5_hunks": _level("hunk"),
    "p5_bumps": _level("bump"),
    "p5_labels": _level("label"),
    "p5_variants": p5_variants,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}


def at(c: str) -> str:
    """DuckDB: ISO text as an instant, UTC where it has no offset."""
    t = f"trim({c}, E' \\t\\r\\n')"
    return f"CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({t}, '([zZ]|[+-][0-9][0-9](:?[0-9][0-9])?)$') THEN CAST({t} AS TIMESTAMPTZ) ELSE CAST({t} || '+00:00' AS TIMESTAMPTZ) END"


_MESSAGE = f"lower(trim(repo_owner)), lower(trim(repo_name)), pr_number, {at('event_created_at')}"
_ORPHANS = f"""
refs AS (
  SELECT 'pr_change' AS table_name, change_id AS row_id, pr_id AS ref, ingested_at AS moment FROM pr_change
  UNION ALL
  SELECT 'classification', classification_id, change_id, {at('classified_at')} FROM classification),
parents AS (
  SELECT 'pr_change' AS table_name, 'pr' AS entity, id AS ref, ingested_at AS since FROM pr
  UNION ALL
  SELECT 'classification', 'pr_change', change_id, ingested_at FROM pr_change),
live AS (
  SELECT * FROM parents p WHERE NOT EXISTS (
    SELECT 1 FROM tombstone t WHERE t.entity = p.entity AND t.entity_id = p.ref AND t.restored_at IS NULL)),
orphans AS (
  SELECT * FROM refs r WHERE ref IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM live l WHERE l.table_name = r.table_name AND l.ref = r.ref AND coalesce(l.since <= r.moment, true)))"""
_KEYED = """
keyed AS (SELECT pr_id, lower(trim(ecosystem)) AS ecosystem, lower(trim(package)) AS package FROM pr_change),
counts AS (
  SELECT ecosystem, package, count(*) AS n_changes,
    count(DISTINCT CASE WHEN p.id IS NOT NULL THEN (lower(trim(repo_owner)), lower(trim(repo_name)), pr_number) END) AS n_pull_requests
  FROM keyed k LEFT JOIN pr p ON p.id = k.pr_id GROUP BY ecosystem, package)"""

_JSON = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END"
_LIST = lambda x: f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST(json_extract({x}, '$[*]') AS JSON[]) WHEN 'OBJECT' THEN [{x}] ELSE [] END"
_SAYS = lambda x, k: f"CASE WHEN json_type({x}, '$.{k}') = 'VARCHAR' THEN {x} ->> '$.{k}' END"
_TEXT = lambda x, k: f"CASE WHEN coalesce(json_type({x}, '$.{k}'), 'NULL') <> 'NULL' THEN {x} ->> '$.{k}' END"
_INT = lambda x, k: f"CASE WHEN json_type({x}, '$.{k}') IN ('UBIGINT', 'BIGINT') THEN CAST({x} ->> '$.{k}' AS BIGINT) END"
_FULL = lambda x: f"nullif(trim({x}, E' \\t\\r\\n'), '') IS NOT NULL"


def _children(name: str, parent: str, keys: str, member: str, no: str) -> str:
    """CTEs name_l, name_x and name: the objects in parent's member, numbered; text of JSON is read twice at each place."""
    return f"""
{name}_m AS (SELECT {keys}, {_JSON('m')} AS m FROM (SELECT {keys}, v -> '$.{member}' AS m FROM {parent})),
{name}_l AS (SELECT {keys}, {_LIST('m')} AS l FROM {name}_m),
{name}_x AS (SELECT {keys}, unnest(l) AS x, CAST(generate_subscripts(l, 1) AS INT) AS {no} FROM {name}_l),
{name} AS (SELECT {keys}, {no}, v FROM (SELECT {keys}, {no}, {_JSON('x')} AS v FROM {name}_x) WHERE json_type(v) = 'OBJECT')"""


#: Nodes of each level as JSON, and their states from the level below upwards.
_NODES = f"""
d0 AS (SELECT row_number() OVER () AS r, id, CAST(files_json AS JSON) AS v FROM pr WHERE json_valid(files_json)),
d1 AS (SELECT r, id, {_JSON('v')} AS v FROM d0),
d2 AS (SELECT r, id, {_JSON('v')} AS v FROM d1),
d3 AS (SELECT r, id, CASE json_type(v) WHEN 'ARRAY' THEN CAST(json_extract(v, '$[*]') AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l FROM d2),
d4 AS (SELECT r, id, unnest(l) AS x, generate_subscripts(l, 1) AS page FROM d3),
d5 AS (SELECT r, id, page, {_JSON('x')} AS x FROM d4),
d6 AS (SELECT r, id, page, CASE WHEN json_type(x) = 'ARRAY' THEN x WHEN json_type(x) = 'OBJECT' AND json_exists(x, '$.nodes') THEN {_JSON("(x -> '$.nodes')")} END AS inner_, x,
  json_type(x) = 'ARRAY' OR (json_type(x) = 'OBJECT' AND json_exists(x, '$.nodes')) AS many FROM d5),
d7 AS (SELECT r, id, page, CASE WHEN many THEN {_LIST('inner_')} ELSE [x] END AS l FROM d6),
d8 AS (SELECT r, id, page, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM d7),
d9 AS (SELECT r, id, CAST(row_number() OVER (PARTITION BY r ORDER BY page, k) AS INT) AS file_no, {_JSON('x')} AS v FROM d8),
f AS (SELECT * FROM d9 WHERE json_type(v) = 'OBJECT' AND ({_FULL(_SAYS('v', 'path'))} OR {_FULL(_SAYS('v', 'filename'))})),
{_children('h', 'f', 'r, id, file_no', 'hunks', 'hunk_no')},
{_children('b', 'h', 'r, id, file_no, hunk_no', 'bumps', 'bump_no')},
{_children('x', 'b', 'r, id, file_no, hunk_no, bump_no', 'labels', 'label_no')},
labels AS (SELECT *, CASE WHEN coalesce(json_type(v, '$.dimension'), 'NULL') <> 'NULL' THEN 'label' ELSE 'bare_label' END AS variant FROM x),
bumps AS (SELECT b.*, CASE WHEN n > 0 THEN 'labelled_' ELSE '' END || CASE WHEN coalesce(json_type(v, '$.from'), 'NULL') <> 'NULL' THEN 'bump' ELSE 'new_bump' END AS variant
  FROM b LEFT JOIN (SELECT r, file_no, hunk_no, bump_no, count(*) AS n FROM labels WHERE variant = 'label' GROUP BY ALL) USING (r, file_no, hunk_no, bump_no)),
hunks AS (SELECT h.*, CASE WHEN n > 0 THEN 'hunk' ELSE 'empty_hunk' END AS variant FROM h LEFT JOIN (SELECT r, file_no, hunk_no, count(*) AS n FROM bumps GROUP BY ALL) USING (r, file_no, hunk_no)),
files AS (SELECT f.*, CASE WHEN n > 0 THEN '' ELSE 'bare_' END || CASE WHEN {_FULL(_SAYS('v', 'previous_path'))} THEN 'renamed_file' WHEN {_FULL(_SAYS('v', 'path'))} THEN 'file' ELSE 'named_file' END AS variant
  FROM f LEFT JOIN (SELECT r, file_no, count(*) AS n FROM hunks WHERE variant = 'hunk' GROUP BY ALL) USING (r, file_no))"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH k AS (SELECT id, min(id) OVER (PARTITION BY {_MESSAGE}) AS kept_id FROM pr)
SELECT kept_id, id AS dup_id FROM k WHERE id <> kept_id""",
    "p1_messages": f"""
SELECT id, repo_owner, repo_name, pr_number, event_created_at, pr_action FROM pr
QUALIFY row_number() OVER (PARTITION BY {_MESSAGE} ORDER BY id) = 1""",
    "p1_first_delivered": f"""
SELECT arg_min(id, (coalesce(epoch_us(ingested_at), 9223372036854775807), id)) AS kept_id, count(*) AS n_copies FROM pr
WHERE repo_owner IS NOT NULL AND repo_name IS NOT NULL AND pr_number IS NOT NULL AND {at('event_created_at')} IS NOT NULL GROUP BY {_MESSAGE}""",
    "p2_found": f"WITH {_ORPHANS} SELECT table_name, row_id FROM orphans",
    "p2_report": f"""
WITH {_ORPHANS},
a AS (SELECT table_name, coalesce(strftime(make_timestamp(epoch_us(moment)), '%Y-%m'), 'unknown') AS period, count(*) AS n FROM orphans GROUP BY ALL),
b AS (SELECT table_name, coalesce(strftime(make_timestamp(epoch_us(moment)), '%Y-%m'), 'unknown') AS period, count(*) AS n FROM refs WHERE ref IS NOT NULL GROUP BY ALL)
SELECT table_name, period, coalesce(a.n, 0) AS n_orphans, b.n AS n_references FROM b LEFT JOIN a USING (table_name, period)""",
    "p3_found": f"""
WITH work AS (
  SELECT id, {at('enriched_at')} AS enriched, {at('parse_attempted_at')} AS attempted FROM pr
  WHERE trim(coalesce(enriched_at, ''), E' \\t\\r\\n') <> ''),
runs AS (SELECT started_at, max_by(status, run_id) AS status FROM pipeline_run WHERE stage = 'parse' GROUP BY started_at)
SELECT id FROM work ASOF LEFT JOIN runs ON attempted >= started_at
WHERE attempted IS NULL OR attempted < enriched OR (started_at IS NOT NULL AND coalesce(status, '') <> 'succeeded')""",
    "p5_found": f"""WITH {_NODES} SELECT id, file_no, 0 AS hunk_no, 0 AS bump_no FROM files
UNION ALL SELECT id, file_no, hunk_no, 0 FROM hunks UNION ALL SELECT id, file_no, hunk_no, bump_no FROM bumps""",
    "p5_files": f"""WITH {_NODES} SELECT id, file_no, variant, CASE WHEN {_FULL(_SAYS('v', 'path'))} THEN v ->> '$.path' ELSE v ->> '$.filename' END AS path,
  {_TEXT('v', 'previous_path')} AS previous_path, {_INT('v', 'additions')} AS additions, {_INT('v', 'deletions')} AS deletions FROM files""",
    "p5_hunks": f"WITH {_NODES} SELECT id, file_no, hunk_no, variant, {_TEXT('v', 'header')} AS header FROM hunks",
    "p5_bumps": f"WITH {_NODES} SELECT id, file_no, hunk_no, bump_no, variant, {_TEXT('v', 'package')} AS package, {_TEXT('v', 'from')} AS from_version, {_TEXT('v', 'to')} AS to_version FROM bumps",
    "p5_labels": f"WITH {_NODES} SELECT id, file_no, hunk_no, bump_no, label_no, variant, {_TEXT('v', 'dimension')} AS dimension, {_TEXT('v', 'label')} AS label FROM labels",
    "p5_variants": f"WITH {_NODES} SELECT *, n AS n_linked FROM (" + " UNION ALL ".join(f"SELECT '{level}' AS level, variant, count(*) AS n FROM {level}s GROUP BY variant" for level in nested.LEVELS) + ")",
    "p6_counts": f"WITH {_KEYED} SELECT * FROM counts",
    "p6_found": f"WITH {_KEYED} SELECT ecosystem, package FROM counts WHERE n_changes * 50 >= (SELECT count(*) FROM pr_change)",
}
