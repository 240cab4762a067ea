"""Processing only new or changed records: differences of immutable table versions.

A version of a table is a manifest: its data files, and for each file the deletion vector of the row positions that the
version does not show. Files never change; a version adds files, removes files and replaces deletion vectors. Two
manifests therefore give the record delta without reading what they share:

    added    rows of added files, and positions that left a deletion vector
    removed  rows of removed files, and positions that entered one

Added and removed files are read straight away. Deletion vectors lie in Parquet files beside the manifests as words of 64
positions, (FILE, WORD, bits): executors build them with a map-side bit_or and compare them by integer arithmetic; the
driver sees one entry a file and never a word. The version that a run has processed is stored in the commit of its
output, in one atomic step, so a run that fails before it leaves nothing visible and the next one gets the same delta.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.types import StructType

from ..functions.text import blank, instant
from ..sources.tables import broadcast_within

FILE, POS, WORD = "__row_file", "__row_pos", "__row_word"
WORDS = f"{FILE} bigint, {WORD} bigint, bits bigint"


def positions(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """columns, FILE, POS of rows read straight from files."""
    return rows.select(*columns, F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS))


def files(rows: DataFrame) -> DataFrame:
    """path, rows, FILE of a table read from files; no column is read."""
    f = F.col("_metadata.file_path")
    return rows.groupBy(f.alias("path")).agg(F.count(F.lit(1)).alias("rows")).withColumn(FILE, F.xxhash64("path"))


def word_no() -> Column:
    return F.shiftright(F.col(POS), 6)


def bit_no() -> Column:
    return F.pmod(F.col(POS), F.lit(64)).cast("int")


def has_bit(word: str) -> Column:
    """Whether the row's bit is set in the word; a null word has none."""
    return F.coalesce(F.call_function("shiftrightunsigned", F.col(word), bit_no()).bitwiseAND(F.lit(1).cast("bigint")) == 1, F.lit(False))


def vectors(rows: DataFrame, **hidden: Column) -> DataFrame:
    """FILE, WORD and for each name the bits of the rows it hides. rows: FILE, POS and what the conditions need; null hides nothing."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_no())
    bits = [F.coalesce(F.bit_or(F.when(c, one)), F.lit(0).cast("bigint")).alias(name) for name, c in hidden.items()]
    return rows.groupBy(FILE, word_no().alias(WORD)).agg(*bits)


class Conflict(RuntimeError):
    """Another writer published the version first."""


class VersionedTable:
    """A folder of immutable data files with numbered manifests.

    Layout: data/<name> and vectors/<name> hold Parquet files, _versions/<n>.json one manifest each: {"schema", "files": [{"path", "id",
    "rows", "vector", "hidden"}], "processed": {source: version}}. id is what rows have as FILE, vector names the folder that holds the file's
    words, hidden counts its bits. A manifest is written aside and then put under its number in one step that fails if the number is taken; readers see it
    whole or not at all, and of two writers one gets a Conflict. Manifests list files, so their size follows the number of files, not of
    rows. Data and vectors of a run that failed or lost lie in folders of their own, which vacuum removes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(root)
        self._fs = path.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(path).toString().rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self._path("_versions")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The last version's number, 0 for a table without any."""
        return (self.versions() or [0])[-1]

    def manifest(self, version: int | None) -> dict:
        """The manifest of a version; None or 0 is the empty table."""
        if not version:
            return {"schema": None, "files": [], "processed": {}}
        stream = self._fs.open(self._path(f"_versions/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, data: bytes) -> None:
        """Puts the whole manifest under its number, or raises Conflict.

        On a local or mounted file system by a hard link, elsewhere by FileContext's rename that refuses an existing target. Both are
        atomic where the file system's own operation is, as on HDFS; an object store without such a rename allows one writer only.
        """
        draft, final = self._path(f"_versions/.{version}-{uuid.uuid4().hex}.tmp"), self._path(f"_versions/{version}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, True)
        out.write(bytearray(data))
        out.close()
        try:
            if self.root.startswith("file:"):
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                self._rename(draft, final)
        except FileExistsError as e:
            raise Conflict(f"version {version} exists already") from e
        finally:
            self._fs.delete(draft, False)

    def _rename(self, draft, final) -> None:
        from py4j.protocol import Py4JJavaError

        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise FileExistsError(final.toString()) from e
            raise

    def commit(self, entries: list[dict], processed: dict[str, int] | None = None, base: int | None = None, schema: StructType | None = None) -> int:
        """Publishes these files as the version after base, by default the latest. Conflict if that number is taken."""
        base = self.latest() if base is None else base
        before = self.manifest(base)
        made = {"schema": json.loads(schema.json()) if schema else before["schema"], "files": entries, "processed": before["processed"] | (processed or {})}
        self._publish(base + 1, json.dumps(made).encode())
        return base + 1

    def write(self, df: DataFrame) -> list[dict]:
        """Writes data files without publishing them."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(at)
        return self.entries(self.spark.read.schema(df.schema).parquet(at))

    def entries(self, rows: DataFrame) -> list[dict]:
        """Manifest entries of the files rows are read from, wherever they lie; one row a file reaches the driver."""
        found = [r.asDict() for r in files(rows).collect()]
        if len({r[FILE] for r in found}) < len(found):
            raise RuntimeError("two files share an id; rename one of them")
        return [{"path": r["path"], "id": r[FILE], "rows": r["rows"], "vector": None, "hidden": 0} for r in found]

    def append(self, df: DataFrame, processed: dict[str, int] | None = None, base: int | None = None) -> int:
        base = self.latest() if base is None else base
        return self.commit(self.manifest(base)["files"] + self.write(df), processed, base, df.schema)

    def write_vectors(self, words: DataFrame, names: list[str]) -> dict[str, tuple[str, dict[int, int]]]:
        """Stores the words of several vectors, columns of words, in one pass: name -> folder, {FILE: number of hidden rows}."""
        at = f"vectors/{uuid.uuid4().hex}"
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("v"), F.col(n).alias("bits")) for n in names)))
        words.select(FILE, WORD, each.alias("x")).select(FILE, WORD, "x.v", "x.bits").where("bits <> 0").write.partitionBy("v").parquet(f"{self.root}/{at}")
        out: dict[str, tuple[str, dict[int, int]]] = {n: (f"{at}/v={n}", {}) for n in names}
        counts = self.spark.read.schema(f"{WORDS}, v string").parquet(f"{self.root}/{at}").groupBy("v", FILE).agg(F.sum(F.bit_count("bits")).alias("n"))
        for r in counts.collect():  # at most one row a file and name
            out[r["v"]][1][r[FILE]] = r["n"]
        return out

    def _words(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], WORDS)
        return self.spark.read.schema(WORDS).parquet(*(f"{self.root}/{f}" for f in folders))

    def hide(self, entries: list[dict], stored: tuple[str, dict[int, int]]) -> list[dict]:
        """entries with the vectors of write_vectors; files without a hidden row have none."""
        folder, hidden = stored
        return [e | ({"vector": folder, "hidden": n} if (n := hidden.get(e["id"], 0)) else {"vector": None, "hidden": 0}) for e in entries]

    def delete(self, condition: Column) -> int:
        """A version whose deletion vectors hide the rows that meet the condition too."""
        base = self.latest()
        now = self.manifest(base)["files"]
        new = vectors(positions(self._read(now, base).where(condition)), bits=F.lit(True))
        touched = {r[FILE] for r in new.select(FILE).distinct().collect()}  # at most one row a file
        hit = [e for e in now if e["id"] in touched]
        old = self._vectors_of(hit).join(new.select(FILE).distinct(), FILE, "left_semi")
        stored = self.write_vectors(new.unionByName(old).groupBy(FILE, WORD).agg(F.bit_or("bits").alias("bits")), ["bits"])["bits"]
        changed = {e["path"]: e for e in self.hide(hit, stored)}
        return self.commit([changed.get(e["path"], e) for e in now], base=base)

    def _vectors_of(self, entries: list[dict]) -> DataFrame:
        """FILE, WORD, bits of the folders the entries name; they may hold words of other files too."""
        return self._words(sorted({e["vector"] for e in entries if e["vector"]}))

    def _read(self, entries: list[dict], version: int) -> DataFrame:
        schema = StructType.fromJson(self.manifest(version)["schema"])
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(unquote(e["path"]) for e in entries))  # the metadata column has paths encoded

    def _shown(self, entries: list[dict], version: int, columns: list[str]) -> DataFrame:
        """The rows of the entries that their vectors do not hide; files without one are read as they are."""
        plain, with_vector = [e for e in entries if not e["vector"]], [e for e in entries if e["vector"]]
        out = self._read(plain, version).select(*columns)
        if with_vector:
            rows = positions(self._read(with_vector, version), *columns).withColumn(WORD, word_no()).join(self._vectors_of(with_vector), [FILE, WORD], "left")
            out = out.unionByName(rows.where(~has_bit("bits")).select(*columns))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        m = self.manifest(version)
        return self._shown(m["files"], version, [f["name"] for f in m["schema"]["fields"]])

    def changes(self, old: int | None, new: int, columns: list[str] | None = None) -> DataFrame:
        """The records that differ between two versions, with _change. Files both have with the same vector are not read."""
        schema = (self.manifest(new)["schema"] or self.manifest(old)["schema"])["fields"]
        columns = [f["name"] for f in schema] if columns is None else columns
        a, b = ({f["path"]: f for f in self.manifest(v)["files"]} for v in (old, new))
        out = [self._shown([side[p] for p in sorted(side.keys() - other.keys())], version, columns).withColumn("_change", F.lit(sign)) for side, other, version, sign in ((b, a, new, "+"), (a, b, old, "-")) if version]
        both = sorted(p for p in a.keys() & b.keys() if (a[p]["vector"], a[p]["hidden"]) != (b[p]["vector"], b[p]["hidden"]))
        if both:
            before, after = (self._vectors_of([side[p] for p in both]).withColumnRenamed("bits", name) for side, name in ((a, "__was"), (b, "__is")))
            was, now = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("__was", "__is"))
            words = before.join(after, [FILE, WORD], "full").select(FILE, WORD, was.bitwiseAND(F.bitwise_not(now)).alias("__plus"), now.bitwiseAND(F.bitwise_not(was)).alias("__minus")).where("__plus <> 0 OR __minus <> 0")
            rows = positions(self._read([b[p] for p in both], new), *columns).withColumn(WORD, word_no()).join(words, [FILE, WORD])
            rows = rows.withColumn("_change", F.when(has_bit("__plus"), "+").when(has_bit("__minus"), "-")).where("_change IS NOT NULL")
            out.append(rows.select(*columns, "_change"))
        return reduce(DataFrame.unionByName, out)

    def vacuum(self) -> int:
        """Deletes the data and vector folders no version names; returns their number. Only while no run is writing."""
        used = set()
        for v in self.versions():
            for e in self.manifest(v)["files"]:
                used |= {e["path"].rpartition("/")[0].rpartition("/")[2], (e["vector"] or "").partition("/")[2].partition("/")[0]}
        gone = 0
        for kind in ("data", "vectors"):
            if self._fs.exists(self._path(kind)):
                for s in self._fs.listStatus(self._path(kind)):
                    if s.getPath().getName() not in used:
                        gone += self._fs.delete(s.getPath(), True)
        return gone


def run_increment(source: VersionedTable, name: str, sink: VersionedTable, process: Callable[[DataFrame], DataFrame], columns: list[str] | None = None) -> int | None:
    """Processes what changed in source since the version noted in sink's last commit; None if nothing did.

    process takes the changes and returns the rows to append. The output's files and the processed version become visible
    together. The output is published as the version after the one whose note was read: of two runs at once the slower one
    gets a Conflict instead of writing the same records again.
    """
    base = sink.latest()
    since, now = sink.manifest(base)["processed"].get(name), source.latest()
    if since == now:
        return None
    return sink.append(process(source.changes(since, now, columns)), {name: now}, base)


# --- The next parse run ---

#: Rows of the run log up to which it is sent to all tasks, as one row a run and day; a longer one is joined as the planner sees fit.
MOST_RUNS = 200_000


def parse_runs(pipeline_run: DataFrame) -> DataFrame:
    """day, starts, ends, ok: parse runs, one row for each day from a run's start to the next one's; a log of fixed size.

    The last run has no end; days after the last start are looked up under the last start's day (see parse_state).
    """
    runs = pipeline_run.where("stage = 'parse'").groupBy("started_at").agg(F.max_by("status", "run_id").alias("status"))
    w = Window.orderBy("started_at")
    runs = runs.select(F.col("started_at").alias("starts"), F.lead("started_at").over(w).alias("ends"), F.coalesce(F.col("status") == "succeeded", F.lit(False)).alias("ok"))
    return runs.withColumn("day", F.explode(F.sequence(F.to_date("starts"), F.coalesce(F.to_date("ends"), F.to_date("starts")))))


def parse_state(pr: DataFrame, pipeline_run: DataFrame) -> DataFrame:
    """FILE, POS, ready, done of pr: enriched, and parsed by a successful run since.

    An attempt belongs to the run that started last at or before it; an attempt before any run counts as successful.
    An enrichment time that cannot be read counts as newer than any attempt.
    """
    runs = parse_runs(pipeline_run)
    last = runs.agg(F.max(F.to_date("starts"))).scalar()
    rows = positions(pr, (~blank("enriched_at")).alias("ready"), instant("enriched_at").alias("enriched"), instant("parse_attempted_at").alias("attempted"))
    rows = rows.withColumn("day", F.least(F.to_date("attempted"), last))
    hit = (rows["day"] == runs["day"]) & (rows["attempted"] >= runs["starts"]) & F.coalesce(rows["attempted"] < runs["ends"], F.lit(True))
    rows = rows.join(broadcast_within(runs, MOST_RUNS, pipeline_run), hit, "left")
    done = F.coalesce((F.col("attempted") >= F.col("enriched")) & F.coalesce(F.col("ok"), F.lit(True)), F.lit(False))
    return rows.select(FILE, POS, "ready", done.alias("done"))


def next_parse(pr: DataFrame, pipeline_run: DataFrame, root: str) -> DataFrame:
    """id of the rows the next parse run must process: the sink's output of one increment. root: a folder all executors reach.

    pr's files are registered where they lie, as two versions: version 1 shows what successful runs have parsed since its
    enrichment, version 2 what is enriched by now. Their deletion vectors come from one scan of three columns. The
    sink's first commit says that version 1 is processed; the increment diffs the manifests, reads the changed positions' ids and
    commits them together with version 2. Jobs run while the query is built; a run that is lost starts anew under another root.
    """
    source, sink = (VersionedTable(pr.sparkSession, f"{root}/{name}") for name in ("pr", "work"))
    files_ = source.entries(pr)
    words = vectors(parse_state(pr, pipeline_run), parsed=~F.col("ready") | ~F.col("done"), enriched=~F.col("ready"))
    stored = source.write_vectors(words, ["parsed", "enriched"])
    for name in ("parsed", "enriched"):
        source.commit(source.hide(files_, stored[name]), schema=pr.schema)
    sink.commit([], {"pr": 1}, schema=pr.select("id").schema)
    run_increment(source, "pr", sink, lambda changes: changes.where("_change = '+'").select("id"), ["id"])
    return sink.read()
