"""Copies, orphans, increments, nested records and heavy keys."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from upcurrent.functions.text import blank, instant
from upcurrent.operators import dedup, increments, nested, orphans, skew

PR = "id bigint, repo_owner string, repo_name string, pr_number bigint, event_created_at string"


def test_instant_reads_all_styles_as_utc(spark):
    same = ["2025-01-01T10:00:00Z", "2025-01-01 10:00:00", "2025-01-01T10:00:00.000000+00:00", "2025-01-01T12:00:00+0200", "2025-01-01T05:00:00-05", "20250101T100000Z", " 2025-01-01t10:00:00z ", "2025-01-01T15:30:00+05:30"]
    df = spark.createDataFrame([(x,) for x in same], "t string").select(instant("t").cast("long").alias("s"))
    assert {r.s for r in df.collect()} == {int(datetime(2025, 1, 1, 10, tzinfo=timezone.utc).timestamp())}
    bad = spark.createDataFrame([("",), ("  ",), (None,), ("soon",), ("2025-13-40T00:00:00Z",)], "t string")
    assert [r[0] for r in bad.select(instant("t")).collect()] == [None] * 5
    assert [r[0] for r in spark.createDataFrame([("\t\n",), ("x",), (None,)], "t string").select(blank("t")).collect()] == [True, False, True]


def test_copies_keep_the_smallest_id(spark, rows):
    data = [
        (1, "Own", "repo", 1, "2025-01-01T10:00:00Z"),
        (2, " own ", "REPO", 1, "2025-01-01T12:00:00+02:00"),
        (3, "own", "repo", 1, "2025-01-01 10:00:00"),
        (4, "own", "repo", 1, "2025-01-01T10:00:01Z"),
        (5, "own", "repo", 2, "2025-01-01T10:00:00Z"),
        (6, "own", None, 1, "2025-01-01T10:00:00Z"),
        (7, "own", None, 1, "2025-01-01T10:00:00Z"),
        (8, "own", "repo", 1, "unreadable"),
        (9, "own", "repo", 1, "unreadable"),
    ]
    pr = spark.createDataFrame(data, PR).withColumn("kept_id", F.lit("clash")).withColumn("n_copies", F.lit(0))
    assert rows(dedup.message_copies(pr)) == [(1, 2), (1, 3)]
    assert [r[0] for r in rows(dedup.messages(pr).select("id"))] == [1, 4, 5, 6, 7, 8, 9]
    assert rows(dedup.message_copies(pr.limit(0))) == []


def test_hot_message_and_hash_aggregation(spark):
    pr = spark.range(3000).select((F.col("id") + 1).alias("id"), F.lit("o").alias("repo_owner"), F.lit("r").alias("repo_name"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("bigint").alias("pr_number"), F.lit("2025-01-01T00:00:00Z").alias("event_created_at"))
    out = dedup.message_copies(pr)
    assert out.count() == 999 and out.select("kept_id").distinct().count() == 1
    plan = dedup.winners(dedup.message_keys(pr), dedup.MESSAGE, "id", dedup.delivery_order(F.col("id"), F.col("id")))._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def in_tasks(df):
    """Rows of the result in each partition of the final join, largest first. The sum keeps all columns from being pruned."""
    return sorted((r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns))).collect()), reverse=True)


@pytest.fixture
def small_as_large(spark):
    """Settings under which small data behave as large: nothing is broadcast, a few thousand rows are a large partition."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_identifier_is_split(spark, small_as_large):
    n = 1_000_000
    df = spark.range(0, n, 1, 32).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.expr("id div 2")).alias("k"))
    out = dedup.copies(df, ["k"], "id", dedup.delivery_order(F.col("id"), F.col("id")))
    tasks = in_tasks(out)
    assert sum(tasks) >= n // 3 - 1 and tasks[0] <= 2 * n / 16, tasks[:5]  # twice the mean


def test_hot_parent_is_split(spark, small_as_large):
    n = 1_000_000
    child = spark.range(0, n, 1, 32).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("ref"))
    parent = spark.range(0, n, 1, 8).select(F.col("id").alias("k"))
    live = orphans.live(parent, "k", spark.range(0, 0).selectExpr("id AS entity_id", "CAST(NULL AS timestamp) AS restored_at"))
    tasks = in_tasks(orphans.orphans(child, live, {"ref": "k"}))
    assert sum(tasks) == (n + 2) // 3 and tasks[0] <= 2 * n / 16, tasks[:5]  # twice the mean


def test_references_of_another_type(spark):
    child = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, ref int")
    parent = spark.createDataFrame([(5,)], "k bigint")
    assert [r.id for r in orphans.orphans(child, parent, {"ref": "k"}).collect()] == [2]


def test_first_delivery(spark):
    rows = [(1, "o", "r", 1, "2025-01-01T00:00:00Z", T0 + H), (2, "O", "r", 1, "2025-01-01T00:00:00Z", T0), (3, "o", "r", 1, "2025-01-01T00:00:00Z", T0), (4, "o", "r", 2, "2025-01-01T00:00:00Z", None)]
    pr = spark.createDataFrame(rows, PR + ", ingested_at timestamp")
    assert sorted(map(tuple, dedup.first_deliveries(pr).collect())) == [(2, 3), (4, 1)]


def test_exactly_once_orders_by_delivery_then_tie(spark, rows):
    df = spark.createDataFrame([("a", 5, 1, "x"), ("a", 3, 9, "y"), ("a", 3, 2, "z"), (None, 1, 3, "n"), (None, 1, 4, "n"), ("b", None, 7, "w")], "k string, at bigint, id bigint, v string")
    out = dedup.exactly_once(df, ["k"], "id", dedup.delivery_order(F.col("at"), F.col("id")))
    assert sorted(r.id for r in out.collect()) == [2, 3, 4, 7]


T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
H = timedelta(hours=1)


def test_pipeline_orphans(spark, rows):
    pr = spark.createDataFrame([(1, T0), (2, T0 + H), (3, T0), (4, T0)], "id bigint, ingested_at timestamp")
    change = spark.createDataFrame([(10, 1, T0), (11, 2, T0), (12, 9, T0), (13, 3, T0), (14, None, T0), (15, 4, T0), (16, 2, T0 + H)], "change_id bigint, pr_id bigint, ingested_at timestamp")
    cl = spark.createDataFrame([(100, 10, "2025-01-01T00:00:00Z"), (101, 12, "2025-01-01T00:00:01Z"), (102, 99, "2025-02-01T00:00:00Z"), (103, 10, "2024-12-31T23:00:00Z"), (104, 13, "2025-01-02"), (105, 15, "bad time"), (106, None, "2025-01-02")], "classification_id bigint, change_id bigint, classified_at string")
    tomb = spark.createDataFrame([("pr", 3, T0, None), ("pr", 3, T0, T0), ("pr", 4, T0, T0), ("pr_change", 13, T0, None), ("pr_change", 1, T0, None)], "entity string, entity_id bigint, deleted_at timestamp, restored_at timestamp")
    out = orphans.pipeline_orphans(pr, change, cl, tomb)
    assert rows(out.select("table_name", "row_id")) == [("classification", 102), ("classification", 103), ("classification", 104), ("pr_change", 11), ("pr_change", 12), ("pr_change", 13)]
    refs = orphans.change_references(change).unionByName(orphans.classification_references(cl))
    assert rows(orphans.orphan_report(out, refs)) == [("classification", "2024-12", 1, 1), ("classification", "2025-01", 1, 3), ("classification", "2025-02", 1, 1), ("classification", "unknown", 0, 1), ("pr_change", "2025-01", 3, 6)]
    assert rows(orphans.pipeline_orphans(pr.limit(0), change.limit(0), cl.limit(0), tomb.limit(0))) == []
    assert orphans.pipeline_orphans(pr.limit(0), change, cl, tomb).where("table_name = 'pr_change'").count() == 6


@pytest.mark.parametrize(("match", "ids"), [("simple", [3]), ("partial", [3, 5]), ("full", [3, 4, 5])])
def test_composite_references_with_nulls(spark, match, ids):
    child = spark.createDataFrame([(1, "a", 1), (3, "a", 2), (4, "a", None), (5, "z", None), (6, None, None)], "id bigint, x string, y bigint").withColumn("__p0", F.lit(1))
    parent = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, None)], "px string, py bigint")
    out = orphans.orphans(child, parent, {"x": "px", "y": "py"}, match)
    assert sorted(r.id for r in out.collect()) == ids and out.columns == child.columns


def test_next_parse(spark, tmp_path, rows):
    runs = [(1, "parse", T0, "succeeded"), (2, "parse", T0 + 2 * H, "failed"), (3, "parse", T0 + 60 * H, "succeeded"), (4, "enrich", T0 + H, "failed")]
    log = spark.createDataFrame(runs, "run_id bigint, stage string, started_at timestamp, status string")
    at = lambda h: (T0 + h * H).isoformat()
    data = [
        (1, at(0.5), at(1), False),  # parsed by run 1
        (2, at(0.5), at(2), True),  # the run that starts then failed
        (3, at(0.5), at(50), True),  # still the failed run, days later
        (4, at(0.5), at(61), False),
        (5, at(1.5), at(1), True),  # enriched again since
        (6, at(1), at(1), False),  # equal times
        (7, at(1), None, True),
        (8, at(1), " ", True),
        (9, None, at(1), False),
        (10, "", None, False),
        (11, at(0), at(500), False),  # long after the last start
        (12, at(1), at(1), False),
        (2, at(0.5), at(2), True),  # a copy, on its own
    ]
    path = str(tmp_path / "pr")
    df = spark.createDataFrame([d[:3] for d in data], "id bigint, enriched_at string, parse_attempted_at string")
    df.withColumn(increments.POS, F.lit(7)).withColumn("day", F.lit("x")).withColumn("_change", F.lit("-")).repartition(3).write.parquet(path)
    got = [r[0] for r in rows(increments.next_parse(spark.read.parquet(path), log, str(tmp_path / "a b%20c")))]
    assert sorted(got) == sorted(d[0] for d in data if d[3])
    df.limit(0).write.parquet(path + "0")
    assert rows(increments.next_parse(spark.read.parquet(path + "0"), log, str(tmp_path / "empty"))) == []


@pytest.fixture
def store(spark, tmp_path):
    return lambda name: increments.VersionedTable(spark, str(tmp_path / name))


def frame(spark, lo, hi, parts=1):
    return spark.range(lo, hi, 1, parts).select("id", (F.col("id") * 2).alias("word"), F.lit(0).alias("__file_no"))


def pairs(df):
    return sorted((r["id"], r["_change"]) for r in df.collect())


def test_versions_give_exact_deltas(spark, store, rows):
    src = store("src")
    assert src.append(frame(spark, 0, 100)) == 1 and src.append(frame(spark, 100, 103)) == 2
    assert src.delete(F.col("id").isin(5, 64, 101)) == 3
    assert pairs(src.changes(1, 3)) == sorted([(100, "+"), (102, "+"), (5, "-"), (64, "-")])
    assert pairs(src.changes(3, 1)) == sorted([(100, "-"), (102, "-"), (5, "+"), (64, "+")])
    assert pairs(src.changes(3, 3)) == [] and src.changes(3, 3).columns == ["id", "word", "__file_no", "_change"]
    assert len(pairs(src.changes(None, 3))) == 100 == src.read().count() and src.read(2).count() == 103
    assert src.delete(F.col("id") == 6) == 4 and pairs(src.changes(3, 4, ["id"])) == [(6, "-")]
    assert pairs(src.changes(1, 4, ["id"])) == sorted([(100, "+"), (102, "+"), (5, "-"), (6, "-"), (64, "-")])
    entries = src.manifest(4)["files"]
    src.commit([e for e in entries if e["rows"] == 100])
    assert pairs(src.changes(4, 5, ["id"])) == [(100, "-"), (102, "-")]
    assert src.delete(F.lit(True)) == 6 and src.read().count() == 0 and len(pairs(src.changes(5, 6))) == 97


def test_a_run_reads_new_files_only(spark, store):
    src = store("src")
    src.append(frame(spark, 0, 1000, 5))
    src.append(frame(spark, 1000, 1010))
    new = src.changes(1, 2)
    assert len(new.inputFiles()) == 1 and new.count() == 10
    assert "Join" not in new._jdf.queryExecution().toString()


def test_increments_survive_failures(spark, store, rows):
    src, out = store("src"), store("out")
    process = lambda changes: changes.select("id", "_change")
    src.append(frame(spark, 0, 100))
    assert increments.run_increment(src, "src", out, process) == 1
    assert increments.run_increment(src, "src", out, process) is None
    src.append(frame(spark, 100, 103))
    src.delete(F.col("id") == 5)

    def fails(changes):
        out.write(changes.select("id", "_change"))  # data written, commit never made
        raise RuntimeError

    with pytest.raises(RuntimeError):
        increments.run_increment(src, "src", out, fails)
    assert out.latest() == 1 and out.manifest(1)["processed"] == {"src": 1}
    assert increments.run_increment(src, "src", out, process) == 2
    assert out.manifest(2)["processed"] == {"src": 3}
    assert sorted(r["id"] for r in out.read().collect()) == sorted([*range(103), 5])
    assert out.vacuum() == 1 and out.read().count() == 104


def test_of_two_writers_one_conflicts(spark, store):
    """Both read the same note; only one output becomes visible."""
    src, out = store("src"), store("out")
    src.append(frame(spark, 0, 10))

    def process(changes):
        if out.latest() == 0:  # the other run commits while this one is still working
            increments.run_increment(src, "src", store("out"), lambda c: c)
        return changes

    with pytest.raises(increments.Conflict):
        increments.run_increment(src, "src", out, process)
    assert out.versions() == [1] and out.read().count() == 10
    assert increments.run_increment(src, "src", out, process) is None


def test_racing_commits_lose_nothing(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    tables = [store("t") for _ in range(8)]
    tables[0].commit([], schema=spark.range(1).schema)

    def publish(k):
        try:
            tables[k]._publish(2, f'{{"by": {k}}}'.encode())
        except increments.Conflict:
            return None
        return k

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(publish, range(8)) if k is not None]
    assert len(won) == 1 and tables[0].manifest(2) == {"by": won[0]} and tables[0].versions() == [1, 2]


def test_rename_refuses_an_existing_version(spark, store):
    """The way taken where files cannot be linked."""
    t = store("t")
    t.commit([], schema=spark.range(1).schema)
    draft = t._path("_versions/.draft")
    t._fs.create(draft, True).close()
    with pytest.raises(FileExistsError):
        t._rename(draft, t._path("_versions/1.json"))
    t._rename(draft, t._path("_versions/2.json"))
    assert t.versions() == [1, 2]


def test_many_files_cost_the_driver_one_entry_each(spark, store):
    """No word reaches the driver: the first run's plan joins nothing, and a wide deletion's manifest stays as short as its list of files."""
    src = store("src")
    src.append(frame(spark, 0, 200_000, 50))
    src.delete(F.col("id") % 2 == 0)
    entries = src.manifest(2)["files"]
    assert len(entries) == 50 and sum(e["hidden"] for e in entries) == 100_000 and max(len(json.dumps(e)) for e in entries) < 400
    assert "Join" not in src.changes(None, 1)._jdf.queryExecution().toString()
    assert src.changes(1, 2).where("_change = '-'").count() == 100_000 == src.read().count()


def nested_truth(doc):
    """Plain restatement for documents whose lists are lists."""
    out = []
    for n, f in enumerate(doc, 1):
        if not f or not (f.get("path") or f.get("filename")):
            continue
        out.append((n, 0, 0))
        for m, h in enumerate(f.get("hunks") or [], 1):
            if h is None:
                continue
            out.append((n, m, 0))
            out += [(n, m, k) for k, b in enumerate(h.get("bumps") or [], 1) if b is not None]
    return out


def wrapped(times):
    doc = '[{"path": "a"}]'
    for _ in range(times):
        doc = json.dumps(doc)
    return doc


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON, st.sampled_from([None, 1]), st.integers(0, 40), st.sampled_from(["", ",", "]", "}", '"', " 1", "\n"]))
def test_loads_deep_reads_what_json_reads(value, indent, at, extra):
    doc = json.dumps(value, indent=indent)
    assert repr(nested.loads_deep(doc)) == repr(json.loads(doc))
    broken = doc[:at] + extra + doc[at:]
    try:
        want = repr(json.loads(broken))
    except ValueError:
        with pytest.raises(ValueError):
            nested.loads_deep(broken)
    else:
        assert repr(nested.loads_deep(broken)) == want


@pytest.mark.parametrize(
    ("doc", "expect"),
    [
        (None, []),
        ("", []),
        ("   ", []),
        ("{broken", []),
        ('[{"path": "a"', []),
        ("[]", []),
        ("null", []),
        ("7", []),
        ('[{"path": "a"}, {"path": ""}, {"filename": "b"}, null, {"path": null, "filename": "c"}]', [(1, 0, 0), (3, 0, 0), (5, 0, 0)]),
        ('{"nodes": [{"path": "a", "hunks": {"bumps": {"package": "x", "labels": {"dimension": "d"}}}}]}', [(1, 0, 0), (1, 1, 0), (1, 1, 1)]),
        ('[{"nodes": [{"path": "a"}]}, {"nodes": null}, {"nodes": [{"path": "b"}]}]', [(1, 0, 0), (2, 0, 0)]),
        ('{"path": "only", "hunks": [null, {"bumps": [null, {"package": "x"}]}]}', [(1, 0, 0), (1, 2, 0), (1, 2, 2)]),
        (json.dumps(json.dumps([{"path": "a", "hunks": json.dumps([{"bumps": None}])}])), [(1, 0, 0), (1, 1, 0)]),
        ('[{"path": "", "hunks": [{"bumps": [{"package": "x"}]}]}]', []),
        ("[" * 100000, []),
        ('[{"path": "a", "x": ' + "[" * 100000 + "]" * 100000 + ', "hunks": [{}]}]', [(1, 0, 0), (1, 1, 0)]),
        ('[{"path": "a", "x": ' + '{"y":' * 50000 + "null" + "}" * 50000 + "}, 7]", [(1, 0, 0)]),
        ('[{"path": "a", "x": ' + "[" * 100000 + "]" * 99999 + "}]", []),
        (wrapped(12), [(1, 0, 0)]),
    ],
)
def test_nested_nodes(doc, expect):
    assert [(n, m, k) for level, _, _, (n, m, k, j) in nested.nodes(doc) if level != "label"] == expect


BUMP = st.fixed_dictionaries({"package": st.text(max_size=3)}, optional={"from": st.none() | st.text(max_size=2), "labels": st.none()})
FILE = st.fixed_dictionaries({}, optional={"path": st.none() | st.sampled_from(["", "a", "b/c"]), "filename": st.sampled_from(["", "f"]), "hunks": st.none() | st.lists(st.none() | st.fixed_dictionaries({"bumps": st.none() | st.lists(st.none() | BUMP, max_size=3)}), max_size=3)})


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.none() | FILE, max_size=4))
def test_nested_against_plain_walk(doc):
    assert [(n, m, k) for level, _, _, (n, m, k, j) in nested.nodes(json.dumps(doc)) if level != "label"] == nested_truth(doc)


def test_states_come_from_the_childrens_states():
    bump, new = {"package": "p", "from": "1", "labels": [{"dimension": "d"}]}, {"package": "q", "labels": [{}]}
    doc = [{"path": "a", "hunks": [{"bumps": [bump, new]}, {"bumps": []}]}, {"filename": "b", "hunks": [{"header": "@@"}]}, {"path": "c", "previous_path": "d"}]
    states = [(at, variant) for _, variant, _, at in nested.nodes(json.dumps(doc))]
    assert states == [
        ((1, 0, 0, 0), "file"), ((1, 1, 0, 0), "hunk"), ((1, 1, 1, 0), "labelled_bump"), ((1, 1, 1, 1), "label"), ((1, 1, 2, 0), "new_bump"), ((1, 1, 2, 1), "bare_label"), ((1, 2, 0, 0), "empty_hunk"),
        ((2, 0, 0, 0), "bare_named_file"), ((2, 1, 0, 0), "empty_hunk"), ((3, 0, 0, 0), "bare_renamed_file"),
    ]
    assert all(v in nested.VARIANTS[level] for level, v, _, _ in nested.nodes(json.dumps(doc)))


def test_level_and_variant_tables_link_to_parents(spark, rows, tmp_path):
    doc = json.dumps([{"path": "a", "previous_path": "z", "additions": 2**70, "hunks": [{"header": "@@", "bumps": [{"package": "p", "from": None, "to": 3, "labels": [{"dimension": "d", "label": "l"}]}]}]}])
    df = spark.createDataFrame([(1, doc, 0), (2, None, 0), (1, doc, 0)], "id bigint, files_json string, level int")
    flat = nested.flatten(df, "id", "files_json")
    assert rows(nested.level_table(flat, "file")) == [(1, 1, "renamed_file", "a", "z", None, None)] * 2
    assert rows(nested.level_table(flat, "bump")) == [(1, 1, 1, 1, "labelled_new_bump", "p", None, "3")] * 2
    assert rows(nested.level_table(flat, "label")) == [(1, 1, 1, 1, 1, "label", "d", "l")] * 2
    tables = nested.route(flat, str(tmp_path / "t"))
    assert rows(tables["renamed_file"]) == [(1, 1, "a", "z", None, None)] * 2 and tables["file"].columns == ["id", "file_no", "path", "additions", "deletions"]
    assert rows(tables["labelled_new_bump"]) == [(1, 1, 1, 1, "p", "3")] * 2 and tables["bump"].count() == 0
    assert "PartitionFilters: [isnotnull(variant" in tables["label"]._jdf.queryExecution().toString()
    assert nested.flatten(df.limit(0), "id", "files_json").count() == 0


def test_eager_counts_and_heavy_keys(spark, rows):
    pr = spark.createDataFrame([(1, "O", "r", 1), (2, "o ", "R", 1), (3, "o", "r", 2), (None, "o", "r", 9)], "id bigint, repo_owner string, repo_name string, pr_number bigint")
    change = [(i, 1 + i % 3, "NPM ", "Pkg") for i in range(60)] + [(100, None, "npm", "pkg"), (101, 77, "npm", "pkg"), (102, 1, None, "x"), (103, 3, "go", "m")]
    change = spark.createDataFrame(change, "change_id bigint, pr_id bigint, ecosystem string, package string").withColumn("n", F.lit("clash"))
    out = skew.package_counts(change, pr)
    assert rows(out) == [("go", "m", 1, 1, 1), ("npm", "pkg", 62, 60, 2), (None, "x", 1, 1, 1)]
    assert [r.package for r in skew.heavy_keys(out, change, 0.5).collect()] == ["pkg"]
    assert skew.package_counts(change.limit(0), pr).count() == 0
    assert rows(skew.package_counts(change, pr.limit(0)).where("package = 'pkg'")) == [("npm", "pkg", 62, 0, 0)]


def test_eager_counts_multiply_when_keys_repeat(spark, rows):
    left = spark.createDataFrame([(1, "g"), (1, "g"), (2, "g")], "k bigint, g string")
    right = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k bigint, who string")
    assert rows(skew.eager_counts(left, right, "k", ["g"], ["who"])) == [("g", 3, 7, 2)]
