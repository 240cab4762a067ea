"""Text cut off by field limits: a backward character n-gram model.

The model reads a text backward from a position and tells how the end of a text compares with its continuation there. For
every context of one to ORDERS[-1] characters it holds the number of distinct values that end with it and the number of places
inside values where text goes on after it; a longer context's odds start from those of the next shorter one. Every value is
scored: it was cut if, after its final context, an end is hardly likelier than at a place picked at random. The threshold of the
log-odds is the rate of ends per place in values of its language and column, times the odds that a value of its length was cut,
plus MARGIN. A value's own end is left out of the counts.

What a length says is thus evidence beside the context, no rule of its own. The odds are those of a peak in the lengths of the
source's values, in characters or UTF-8 bytes, against the lengths on both sides of it; values with the same end count once there, since a
template piles up at one length too. A source may have several limits; a value at none has the odds CUT_SHARE.

Marks put behind a cut are taken off before counting, measuring and scoring. A marked value is whole only where its final context is
a usual end of whole values and mostly carries a mark ("more to come...").

Null and blank values are no cases, like values of commits_truncated. Language is told from the script and, in Latin script, from function words in
the last 400 characters.

One Python pass over the texts writes what is needed of each value (its end, marks and lengths) and each task's counts to the shared folder;
lengths, ends and scores then come from that narrow table. Counts live in hash tables of fixed size that are summed block by block, so what reaches the
driver has a fixed size. On a large corpus cells hold more than one context: what a cell of the table holds at the median is taken off every cell,
so that only contexts well above such noise speak and the others leave the odds to shorter ones. `extra` makes the tables larger.
The jobs of fitting run while the query is built; a Fitted can be pickled and used again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from ..sources.tables import scratch, spread

ORDERS = (1, 2, 3, 4, 6, 8)
#: log2 of the cells of each table, and its order. Long contexts have two tables with different hashes: the lower count is the better one.
TABLES = ((14, 1), (17, 2), (19, 3), (19, 4), (19, 4), (19, 6), (19, 6), (19, 8), (19, 8))
#: Pseudo-observations with which a context's odds start from the shorter context's.
PRIOR = 20.0
#: Log-odds above the rate of random cuts from which an end counts as whole.
MARGIN = 2.5
#: Odds of a cut where the length does not tell; they move the threshold by their logarithm only.
CUT_SHARE = 0.1
#: Characters of an end that are kept, and that tell whether two values end alike.
TAIL, SAME = 48, 160
FIELDS = ("body", "commit_messages_concat")

#: Scripts by code points, and function words of languages in Latin script.
SCRIPTS = {"cyrillic": (0x400, 0x52F), "greek": (0x370, 0x3FF), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "hangul": (0xAC00, 0xD7AF), "kana": (0x3040, 0x30FF), "han": (0x3400, 0x9FFF)}
WORDS = {
    "en": "the and is of to for with this that was are from not".split(),
    "de": "der die das und ist nicht mit für ein eine wird den von auf".split(),
    "fr": "le la les et est pas des une dans pour avec sur qui du".split(),
    "es": "el los las es una por con para que no se del".split(),
    "pt": "o os as é uma não por com para que do da em".split(),
    "it": "il gli è una non per con che di del della sono".split(),
    "nl": "de het een en is niet met voor van dat op".split(),
    "pl": "i nie jest się na do z że w dla".split(),
}
_LATIN = re.compile(r"[a-zß-ÿœąćęłńóśźż]+")
_LANGUAGES: dict[str, list[str]] = {}
for _name, _words in WORDS.items():
    for _w in _words:
        _LANGUAGES.setdefault(_w, []).append(_name)

#: Marks that pipelines put behind a cut.
MARK = re.compile(
    r"\s*(?:…|\ufffd|\.{3,}|[\[(<{]\s*(?:…|\.{2,}|(?:(?:message|text|content|output|body|log)\s+)?(?:truncated|clipped|cut(?: off)?|trimmed|snip(?:ped)?|shortened|abridged|continued|more)\b[^\])>}\n]{0,24})\s*[\])>}]|(?:read|show|view|see)\s+more)\s*$",
    re.I,
)
_VERSION = re.compile(r"\d+(?:\.\d+){2,}")
_YEAR = re.compile(r"\d{4,}")
_DIGITS = re.compile(r"\d+")


def normal(text: str) -> str:
    """Lower case; three-part versions, long and short numbers are one character each."""
    return _DIGITS.sub("0", _YEAR.sub("\x02", _VERSION.sub("\x01", text.replace("\r", "").replace("\x00", "\x05").lower())))


def stripped(text: str) -> tuple[str, bool]:
    """text without a mark at its end, and whether it had one."""
    m = MARK.search(text, max(0, len(text) - 80))
    return (text[: m.start()], True) if m else (text, False)


def language(text: str) -> str:
    """The script of the text's end, and in Latin script the language most of whose function words stand in it."""
    end = text[-400:]
    if not end.isascii():
        wide = [ord(c) for c in end if c > "\u036f"]
        if len(wide) * 4 >= len(end):
            n, name = max((sum(lo <= c <= hi for c in wide), name) for name, (lo, hi) in SCRIPTS.items())
            if n * 2 >= len(wide):
                return name
    seen: dict[str, int] = {}
    for w in _LATIN.findall(end.lower()):
        for name in _LANGUAGES.get(w, ()):
            seen[name] = seen.get(name, 0) + 1
    n, name = max(((n, name) for name, n in seen.items()), default=(0, ""))
    return name if n >= 2 else "latin"


_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def layout(extra: int = 0) -> tuple[tuple[int, int], ...]:
    """TABLES with 2**extra times the cells."""
    return tuple((bits + extra, order) for bits, order in TABLES)


def contexts(chars: np.ndarray, extra: int = 0) -> Iterator[np.ndarray]:
    """For each table, the cell of the context that ends at each place, together with the kind of its line.

    chars: code points; contexts run on over what lies before. A line's kind is its first character, all letters and digits being one kind:
    what a list item, a table row or a tag ends with is no usual end of a sentence.
    """
    fresh = np.ones(len(chars), bool)
    fresh[1:] = (chars[:-1] == 10) | (chars[:-1] == 0)
    kind = chars[np.maximum.accumulate(np.where(fresh, np.arange(len(chars)), 0))]
    plain = (kind >= 97) & (kind <= 122) | (kind == 48) | (kind > 127) | (kind < 9)
    h = np.where(plain, 97, kind).astype(np.uint64) << np.uint64(32)
    c = chars.astype(np.uint64)
    done = 0
    for bits, order in layout(extra):
        if order == done:  # the second table of the order
            yield ((h * _MIX2) >> np.uint64(64 - bits)).astype(np.int64)
            continue
        for k in range(done, order):
            h[k:] = h[k:] * _MIX + c[: len(c) - k] + np.uint64(1)
            h[k:] ^= h[k:] >> np.uint64(29)
        done = order
        yield ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_GAP = "\x00" * ORDERS[-1]


def tables(extra: int = 0) -> list[np.ndarray]:
    return [np.zeros(1 << b, np.int64) for b, _ in layout(extra)]


def add_inside(counts: list[np.ndarray], texts: list[str], extra: int = 0) -> None:
    """Adds the places of texts after which they go on. Texts are taken together, with gaps as long as the longest context between them."""
    chunk, size = [], 0
    for k, t in enumerate(texts):
        chunk.append(t)
        size += len(t) + 1
        if size > 1_000_000 or k + 1 == len(texts):
            chars = codes(_GAP + _GAP.join(chunk) + _GAP)
            inside = np.flatnonzero((chars[:-1] != 0) & (chars[1:] != 0))
            for table, cell in zip(counts, contexts(chars, extra)):
                table += np.bincount(cell[inside], minlength=len(table))
            chunk, size = [], 0


def end_cells(tails: list[str], extra: int = 0) -> list[np.ndarray]:
    """For each table, the cells of the tails' final contexts."""
    chars = codes(_GAP + _GAP.join(tails) + _GAP)
    last = np.flatnonzero((chars[:-1] != 0) & (chars[1:] == 0))
    return [cell[last] for cell in contexts(chars, extra)]


def noise(table: np.ndarray) -> float:
    """What a cell holds without any context of weight: the median, and three standard deviations of as many chance arrivals."""
    m = float(np.median(table))
    return m + 3 * m**0.5


class Model:
    """inside, ends, marked: by table, places that go on, distinct values that end, and those of them that carried a mark. rates: values per place by language."""

    def __init__(self, inside: list[np.ndarray], ends: list[np.ndarray], marked: list[np.ndarray], rates: dict[str, float] | None = None, extra: int = 0):
        self.inside, self.ends, self.marked, self.rates, self.extra = inside, ends, marked, rates or {}, extra
        self.places, self.total = int(inside[0].sum()), int(ends[0].sum())
        self.noise = [(noise(e), noise(i), noise(m)) for e, i, m in zip(ends, inside, marked)]

    def __reduce__(self):
        """Mostly empty tables travel compressed."""
        return _unpacked, ([[zlib.compress(t.astype(np.int64).tobytes(), 1) for t in ts] for ts in (self.inside, self.ends, self.marked)], self.rates, self.extra)

    def score(self, tails: list[str], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of an end after each tail, its own end left out, and the share of marked values among those that end so."""
        q = np.full(len(tails), max(self.total - 1, 1) / max(self.places + self.total, 1))
        usual = np.full(len(tails), 0.0)
        cells, k, levels = end_cells(tails, self.extra), 0, []
        for order in ORDERS:
            e = i = m = None
            while k < len(TABLES) and TABLES[k][1] == order:
                at = [np.maximum(t[k][cells[k]] - z, 0) for t, z in zip((self.ends, self.inside, self.marked), self.noise[k])]
                e, i, m = at if e is None else (np.minimum(x, y) for x, y in zip((e, i, m), at))
                k += 1
            e, m = np.maximum(e - 1, 0), np.maximum(m - marks, 0)
            levels.append((e, i))
            usual = np.where(e > 0, m / np.maximum(e, 1), usual * 0.5)
        # What a longer context saw is taken out of the shorter one, so that no end or place counts twice.
        for (e, i), (e2, i2) in zip(levels, [*levels[1:], (0, 0)]):
            e, i = np.maximum(e - e2, 0), np.maximum(i - i2, 0)
            q = (e + PRIOR * q) / (e + i + PRIOR)
        return np.log(q) - np.log1p(-q), usual

    def cut(self, tails: list[str], marks: np.ndarray, languages: list[str], odds: np.ndarray) -> np.ndarray:
        """odds: of a cut by each value's length."""
        ends, usual = self.score(tails, marks)
        rate = self.total / max(self.places, 1)
        limit = np.log(odds * np.array([self.rates.get(g, rate) for g in languages])) + MARGIN
        return (ends < limit) | (marks & (usual < 0.5))


def _unpacked(packed: list[list[bytes]], rates: dict[str, float], extra: int) -> Model:
    return Model(*([_narrow(np.frombuffer(zlib.decompress(t), np.int64)) for t in ts] for ts in packed), rates, extra)


def _narrow(t: np.ndarray) -> np.ndarray:
    return t.astype(np.int32) if t.max(initial=0) < 2**31 else t


def end_of(clean: str) -> str:
    """The end of a normalised value, behind its last line's first character where that lies further back."""
    line = clean.rfind("\n", 0, max(0, len(clean) - 1)) + 1
    end = clean[-TAIL:]
    if line < len(clean) - TAIL:
        end = clean[line] + "\x03" + end
    return end or "\x04"


# --- Over a table ---

BLOCK = 1 << 15
MAX_LIMITS = 100_000
#: A length's neighbours on either side, closer and wider, and the values a length is taken to have at least.
NEAR, LEAST = ((4, 12), (4, 50)), 0.2
#: How many times its neighbours a length without any cut may have: lengths of short messages of one form lie close together.
SLOPE = 3.0

VALUE = "id bigint, source string, field string, language string, key bigint, tail string, mark boolean, chars int, bytes int"
_BLOCKS = "field string, kind string, tab int, block int, data binary"
_MEASURED = f"{VALUE}, kind string, tab int, block int, data binary"
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _blocks(field: str, kind: str, counts: list[np.ndarray]) -> Iterator[tuple[str, str, int, int, bytes]]:
    for k, table in enumerate(counts):
        for b in range(0, len(table), BLOCK):
            part = table[b : b + BLOCK]
            if part.any():
                yield field, kind, k, b // BLOCK, zlib.compress(part.astype(np.int64).tobytes(), 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition, read one by one: what is kept is one table block for each key, however many tasks sent theirs."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        *key, data = (batch.column(k) for k in range(5))
        for at, x in zip(zip(*(c.to_pylist() for c in key)), data):
            part = np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
            total[at] = total[at] + part if at in total else part
    if total:
        yield _batch([*zip(*total), [zlib.compress(x.tobytes(), 1) for x in total.values()]], _schema(_BLOCKS))


def measure(rows: DataFrame, row_id: str, source: str, fields: tuple[str, ...], root: str, extra: int = 0) -> DataFrame:
    """Writes to root and reads back, in one pass over the texts: a row for each value (VALUE), and each task's counts of inside places as blocks."""
    schema = _schema(_MEASURED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {f: tables(extra) for f in fields}
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for k, f in enumerate(fields):
                    out, texts = [], []
                    for i, src, v in zip(ids, sources, batch.column(k + 2).to_pylist()):
                        if not v or v.isspace():
                            continue
                        short, mark = stripped(v)
                        clean = normal(short)
                        key = int.from_bytes(blake2b(clean[-SAME:].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                        out.append((i, src, f, language(short), key, end_of(clean), mark, len(short), len(short) if short.isascii() else len(short.encode("utf-8", "surrogatepass"))))
                        texts.append(clean)
                    add_inside(counts[f], texts, extra)
                    if out:
                        n = len(out)
                        yield _batch([*zip(*out), ["value"] * n, *[[None] * n] * 3], schema)
        blocks = [b for f in fields for b in _blocks(f, "inside", counts[f])]
        if blocks:
            f, *rest = zip(*blocks)
            yield _batch([*[[None] * len(blocks)] * 2, f, *[[None] * len(blocks)] * 6, *rest], schema)

    spread(rows.select(F.col(row_id).cast("bigint"), F.col(source).cast("string"), *fields)).mapInArrow(run, _MEASURED).write.parquet(root)
    return rows.sparkSession.read.schema(_MEASURED).parquet(root)


Limits = dict[tuple[str | None, str], list[tuple[str, int, float]]]


def length_odds(measured: DataFrame) -> Limits:
    """(source, field) -> limits as (unit, length, odds of a cut at it), of the lengths at which more values were cut than not.

    Lengths are counted over all values, those with the same end once. A length's values are compared with as many as its neighbours on
    either side have, whichever are more; SLOPE times those and two standard deviations are taken off, so that few values or a natural hump say little. Only limits reach the driver.
    """
    v = measured.where("kind = 'value'").select("source", "field", "chars", "bytes", F.right("tail", F.lit(12)).alias("end")).distinct()
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("n")) for u in ("chars", "bytes"))))
    n = v.select("source", "field", units.alias("u")).groupBy("source", "field", "u.unit", "u.n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source", "field", "unit").orderBy(F.col("n"))
    side = lambda lo, hi: F.coalesce(F.sum("c").over(w.rangeBetween(lo, hi)), F.lit(0)) / float(hi - lo + 1)
    n = n.withColumn("near", F.greatest(*(side(*r) for a, b in NEAR for r in ((-b, -a), (a, b)))))
    n = n.withColumn("odds", (F.col("c") - SLOPE * F.col("near") - 2 * F.sqrt("c")) / F.greatest("near", F.lit(LEAST)))
    # For plain text characters and bytes peak alike: the unit with more values at that length is the one that limits.
    n = n.where("odds > 1 AND source IS NOT NULL").groupBy("source", "field", "n").agg(F.max_by(F.struct("unit", "odds"), F.struct("c", "unit")).alias("x"))
    found = n.select("source", "field", "x.unit", "n", "x.odds").limit(MAX_LIMITS + 1).collect()
    if len(found) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits; the source column does not name sources")
    out: Limits = {}
    for r in found:
        out.setdefault((r["source"], r["field"]), []).append((r["unit"], r["n"], r["odds"]))
    return out


def odds_at(chars: int, size: int, limits: list[tuple[str, int, float]]) -> float:
    """Odds of a cut by length. A cut in bytes may have dropped up to three bytes of a character, or put a replacement character for them."""
    return max((odds for unit, n, odds in limits if (chars == n if unit == "chars" else n - 3 <= size <= n + 2)), default=CUT_SHARE)


@dataclass
class Fitted:
    """What scoring needs, of a fixed size: the length odds of each source and a model for each field."""

    limits: Limits
    models: dict[str, Model]


def fit(measured: DataFrame, fields: tuple[str, ...] = FIELDS, extra: int = 0, lengths: bool = True) -> Fitted:
    """From all values. Ends of values at a length where most were cut are left out. lengths=False leaves the lengths out of everything."""
    limits = length_odds(measured) if lengths else {}
    spark = measured.sparkSession
    known = spark.sparkContext.broadcast(limits)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(f, kind): tables(extra) for f in fields for kind in ("ends", "marked")}
        for batch in batches:
            x = batch.to_pandas()
            for f in fields:
                own = x[x["field"] == f]
                if len(own):
                    mark = own["mark"].to_numpy(bool)
                    for k, cell in enumerate(end_cells(own["tail"].tolist(), extra)):
                        for kind, found in (("ends", cell), ("marked", cell[mark])):
                            at, n = np.unique(found, return_counts=True)
                            counts[f, kind][k][at] += n
        out = [b for (f, kind), c in counts.items() for b in _blocks(f, kind, c)]
        if out:
            yield _batch(zip(*out), _schema(_BLOCKS))

    def at_no_limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, f, chars, size = (batch.column(k).to_pylist() for k in range(4))
            keep = [odds_at(c, b, known.value[s, g]) <= 1 if (s, g) in known.value else True for s, g, c, b in zip(src, f, chars, size)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([1, 4, 5, 6])

    # Copies of a value, also those cut at the same place, count as one end: they share their last SAME characters.
    values = measured.where("kind = 'value'").select("source", "field", "chars", "bytes", "key", "tail", "mark")
    distinct = values.mapInArrow(at_no_limit, "field string, key bigint, tail string, mark boolean").groupBy("field", "key", "tail").agg(F.min("mark").alias("mark"))
    parts = measured.where("kind = 'inside'").select("field", "kind", "tab", "block", "data").unionByName(distinct.select("field", "tail", "mark").mapInArrow(ends, _BLOCKS))
    got: dict = {f: {k: tables(extra) for k in ("inside", "ends", "marked")} for f in fields}
    for r in parts.repartition("field", "kind", "tab", "block").mapInArrow(_summed, _BLOCKS).toLocalIterator(prefetchPartitions=True):  # a fixed number of blocks
        data = np.frombuffer(zlib.decompress(bytes(r["data"])), np.int64)
        got[r["field"]][r["kind"]][r["tab"]][r["block"] * BLOCK : r["block"] * BLOCK + len(data)] = data
    of = measured.where("kind = 'value'").groupBy("field", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()  # one row a language
    rates: dict = {f: {r["language"]: r["n"] / max(r["chars"], 1) for r in of if r["field"] == f} for f in fields}
    return Fitted(limits, {f: Model(*([_narrow(t) for t in got[f][k]] for k in ("inside", "ends", "marked")), rates[f], extra) for f in fields})


def score(measured: DataFrame, fitted: Fitted) -> DataFrame:
    """id, source, field, cut of every value that is neither null nor blank."""
    shared = measured.sparkSession.sparkContext.broadcast(fitted)
    schema = _schema("id bigint, source string, field string, cut boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, models = shared.value.limits, shared.value.models
        for batch in batches:
            x = batch.to_pydict()
            odds = np.array([odds_at(c, b, limits[s, f]) if (s, f) in limits else CUT_SHARE for s, f, c, b in zip(x["source"], x["field"], x["chars"], x["bytes"])])
            field, marks, cut = np.array(x["field"]), np.array(x["mark"], bool), np.zeros(len(odds), bool)
            for f, model in models.items():
                at = np.flatnonzero(field == f)
                if len(at):
                    cut[at] = model.cut([x["tail"][k] for k in at], marks[at], [x["language"][k] for k in at], odds[at])
            yield _batch([x["id"], x["source"], x["field"], cut], schema)

    values = measured.where("kind = 'value'").select("id", "source", "field", "language", "tail", "mark", "chars", "bytes")
    return values.mapInArrow(run, "id bigint, source string, field string, cut boolean")


def scored(rows: DataFrame, row_id: str = "id", source: str = "fetched_via", fields: tuple[str, ...] = FIELDS, extra: int = 0, lengths: bool = True) -> DataFrame:
    measured = measure(rows, row_id, source, fields, scratch(rows.sparkSession, "ends"), extra)
    return score(measured, fit(measured, fields, extra, lengths))


def truncated(rows: DataFrame, **how) -> DataFrame:
    """id, field of the values that were cut, of each copy on its own. how: as of scored."""
    return scored(rows, **how).where("cut").select("id", "field")


def truncation_report(values: DataFrame) -> DataFrame:
    """source, field, n_values, n_cut, rate of scored values; those without a source form one of their own, 'unknown'."""
    n = values.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "field").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut"))
    return n.withColumn("rate", F.col("n_cut") / F.col("n_values"))
