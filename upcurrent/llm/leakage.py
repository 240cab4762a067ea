"""Evaluation texts that leaked into training text: size-partitioned MinHash containment search, then exact shingles.

The short side are the evaluation items, a stated query set that is taken in blocks of ITEMS_PER_BLOCK; all blocks of up to
ITEM_BYTES of item text go through a task together, so that the corpus is read and cut into words once for them. Each item is cut
into overlapping pieces of PIECE words; each piece is a set of shingles. Documents are cut into overlapping windows that
are long enough to hold any passage of the required length whole, and a window's set is cut down to the shingles any item
has: the rest cannot be contained. Windows are put into partitions by the size of that set, as in LSH Ensemble: a partition's
largest size turns the required containment into the least Jaccard similarity, and that into the number of MinHash rows
that are compared, so that a window is missed with a chance below MISS. Partitions too small to hold the required number
of shingles are empty by arithmetic.

A candidate (document, item) is verified exactly: the window must hold the required number of the item's shingles, then
common words are chained in order around it, and a chain counts if it holds at least `least` words of the item and at most one in `slack` of the words it spans is replaced or left
out. Only verified pairs leave a task; documents are never shuffled.

No passage needs more than longest() words. Of one that is longer, cut in two where both parts have at least `least` words besides the errors
allowed them, one part has no more errors for its length than the whole and is a passage by itself. So a passage of any length holds one whose errors fit into
longest(), and a block of PIECE words of that keeps least_overlap() shingles.

Words are what is left between blanks when tags, link targets, commands and punctuation are gone and character references are read, folded.
Null, empty and too short texts yield nothing, like items shorter than `least`; an item given twice is reported for each of its ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

SHINGLE = 3
LEAST, SLACK = 15, 6
#: An item's piece: with as many errors as a passage of longest() words may have it keeps least_overlap() shingles.
PIECE = 24
WINDOW, STRIDE = 2 * PIECE, PIECE - SHINGLE
#: Chance to miss a window that holds the least overlap.
MISS = 1e-6
#: Upper sizes of the partitions of windows, in shingles known to items.
SIZES = (9, 12, 16, 22, 32, WINDOW)
ITEMS_PER_BLOCK = 500
#: Text of the items that is searched for in one pass over the corpus; the index takes some thirty times as much memory in a task.
ITEM_BYTES = 16 << 20

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)|\{\{|\}\}")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?")
_DROP = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text or "{{" in text:
        text = _LINK.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    return text


def word(token: str) -> str:
    """What a token between blanks says; empty for mere punctuation."""
    return _DROP.sub("", token.casefold())


def words(text: str) -> list[str]:
    return [w for x in plain(text).split() if (w := word(x))]


class Codes(dict):
    """Token -> code of its word: 0 for words no item has, -1 for tokens without one. Emptied when it holds LIMIT tokens."""

    LIMIT = 200_000

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        w = word(token)
        code = self.vocabulary.get(w, 0) if w else -1
        if len(token) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = code
        return code

    def __reduce__(self):
        return type(self), (self.vocabulary,)


def least_overlap() -> int:
    """Shingles that LEAST words keep at least when one in SLACK is replaced; words left out cost fewer."""
    return LEAST - SHINGLE + 1 - SHINGLE * (LEAST // SLACK)


def rows_needed(size: int) -> int:
    """MinHash rows, each of them a band, for windows of at most this size."""
    t, q = least_overlap(), PIECE - SHINGLE + 1
    similar = t / max(q + size - t, q)
    return int(np.ceil(np.log(MISS) / np.log1p(-similar)))


#: rows_needed by the number of shingles in a window.
ROWS = [rows_needed(next(z for z in SIZES if k <= z)) for k in range(WINDOW + 1)]


def longest(least: int = LEAST, slack: int = SLACK) -> int:
    """Words, with errors, that a passage without a shorter one in it has at most."""
    return 2 * (least + least // (slack - 1)) - 1


def dense(doc: list[int], item: dict[int, list[int]], least: int, slack: int) -> list[tuple[int, int]]:
    """The parts of doc that hold all passages: from known word to known word, so many that the unknown ones between are few enough.

    A chain's words are known, and each unknown word between them is an error, so its own stretch is among those that are joined here.
    """
    known = np.array([w in item for w in doc], bool)
    # A known word weighs 1, an unknown one as much as it takes away: a part's weight is not negative. This tells most documents that have none.
    weight = np.concatenate([[0], np.cumsum(np.where(known, 1, 1 - slack))])
    if len(doc) < least or (weight[least:] < np.minimum.accumulate(weight[:-least])).all():
        return []
    at = np.flatnonzero(known)
    parts: list[tuple[int, int]] = []
    for n in range(least, longest(least, slack) + 1):
        if n > len(at):
            break
        first, last = at[: len(at) - n + 1], at[n - 1 :]
        good = (last - first + 1 - n) * (slack - 1) <= n
        parts += zip(first[good].tolist(), (last[good] + 1).tolist())
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chained(doc: list[int], item: dict[int, list[int]], least: int, slack: int) -> bool:
    """Whether doc holds the passage. item: word -> its places in the item; words unknown to it are absent."""
    return any(_chain(doc[a:b], item, least, slack) for a, b in dense(doc, item, least, slack))


def _chain(doc: list[int], item: dict[int, list[int]], least: int, slack: int) -> bool:
    most = longest(least, slack) // slack
    # For each pair of equal words, the most words of a chain that ends there with 0, 1, ... errors. More of them than most are never needed.
    needed = [max(least, e * (slack - 1)) for e in range(most + 1)]
    before: list[dict[int, list[int]]] = [{} for _ in range(most + 1)]  # the latest words' pairs, the last word's first
    for w in doc:
        now = {}
        for j in item.get(w, ()):
            mine = [1] + [0] * most
            for back, pairs in enumerate(before):
                for j0, chain in pairs.items():
                    if 0 < j - j0 <= most + 1:
                        lost = max(back, j - j0 - 1)
                        for e in range(lost, most + 1):
                            if (m := chain[e - lost]) and m >= mine[e]:
                                mine[e] = m + 1
            if max(mine) >= least and any(m >= n for m, n in zip(mine, needed)):
                return True
            now[j] = mine
        before = [now, *before[:-1]]
    return False


class ItemIndex:
    """What the tasks need of a block of items. Its size is bounded by the block, not by the corpus."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST, slack: int = SLACK):
        self.least, self.slack = least, slack
        texts = [(i, w) for i, t in items if t and len(w := words(t)) >= least]
        self.ids = [i for i, _ in texts]
        self.vocabulary: dict[str, int] = {}
        coded = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in texts]
        self.base = len(self.vocabulary) + 1
        self.codes = Codes(self.vocabulary)
        self.places = []
        for c in coded:
            at: dict[int, list[int]] = {}
            for j, w in enumerate(c.tolist()):
                at.setdefault(w, []).append(j)
            self.places.append(at)
        pieces, owner = [], []
        for k, c in enumerate(coded):
            for s in range(max(1, len(c) - PIECE + 1)):
                pieces.append(self.shingles(c[s : s + PIECE]))
                owner.append(k)
        #: Items that repeat shingles within a piece: the sets hold fewer than the words do, so their windows are counted without proposal.
        self.repeating = sorted({k for p, k in zip(pieces, owner) if len(np.unique(p)) < len(p)})
        self.universe = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.int64)
        #: The items that hold each shingle of the universe.
        held: list[set[int]] = [set() for _ in self.universe]
        rng = np.random.default_rng(20)
        n = max(rows_needed(s) for s in SIZES)
        self.mixed = rng.integers(0, 2**63, len(self.universe), np.uint64)
        self.factors = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.row = np.arange(n, dtype=np.uint64) << np.uint64(32)
        # One table for all rows: sorted distinct (row, value), and behind each the items that have it. Neighbouring pieces of an item mostly share theirs.
        mine: dict[int, list[np.ndarray]] = {}
        for p, k in zip(pieces, owner):
            known = np.searchsorted(self.universe, p)
            for u in known.tolist():
                held[u].add(k)
            if len(p):
                mine.setdefault(k, []).append(self.row + self.signature(known, n))
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, some in mine.items():
            keys.append(np.unique(np.concatenate(some)))
            owners.append(np.full(len(keys[-1]), k))
        every, own = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        self.keys, starts = np.unique(every[order], return_index=True)
        self.starts, self.owners = np.append(starts, len(every)), own[order]
        self.held = [np.array(sorted(x), np.int64) for x in held]

    def signature(self, known: np.ndarray, rows: int) -> np.ndarray:
        """The least hash of the shingles in each row."""
        return ((self.mixed[known][:, None] * self.factors[:rows]) >> np.uint64(32)).min(0)

    def shingles(self, coded: np.ndarray) -> np.ndarray:
        """Codes of the shingles; those with a word no item has are left out."""
        n = len(coded) - SHINGLE + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SHINGLE):
            part = coded[k : k + n]
            code = code * self.base + part
            known &= part > 0
        return code[known]

    def find(self, text: str | None) -> list[int]:
        """Ids of the items that leaked into text."""
        return self.find_in(plain(text).split()) if text else []

    def find_in(self, tokens: list[str]) -> list[int]:
        """Ids of the items that leaked into the text of these tokens between blanks."""
        if not self.ids:
            return []
        codes = self.codes
        coded = [c for x in tokens if (c := codes[x]) >= 0]
        n = len(coded) - SHINGLE + 1
        if n < least_overlap():
            return []
        a = np.array(coded, np.int64)
        code = (a[:n] * self.base + a[1 : n + 1]) * self.base + a[2 : n + 2]
        at = np.searchsorted(self.universe, code)
        at[at == len(self.universe)] = 0
        hit = (self.universe[at] == code) & (a[:n] > 0) & (a[1 : n + 1] > 0) & (a[2 : n + 2] > 0)
        if hit.sum() < least_overlap():
            return []
        total = np.concatenate([[0], np.cumsum(hit)])
        regions: dict[int, list[tuple[int, int]]] = {}
        around = longest(self.least, self.slack)
        starts = np.arange(0, max(1, n - (WINDOW - SHINGLE + 1) + STRIDE), STRIDE)
        stops = np.minimum(n, starts + WINDOW - SHINGLE + 1)
        kept = least_overlap()
        full = total[stops] - total[starts] >= kept
        for s, e in zip(starts[full].tolist(), stops[full].tolist()):
            known = np.unique(at[s:e][hit[s:e]])
            found = set(self.repeating)
            if len(known) >= kept:
                rows = ROWS[len(known)]
                key = self.row[:rows] + self.signature(known, rows)
                p = np.searchsorted(self.keys, key)
                p = p[self.keys[np.minimum(p, len(self.keys) - 1)] == key]
                for q in p.tolist():
                    found.update(self.owners[self.starts[q] : self.starts[q + 1]].tolist())
            if not found:
                continue
            # Exact shingle containment of what the rows proposed.
            overlap = np.bincount(np.concatenate([self.held[u] for u in at[s:e][hit[s:e]].tolist()]), minlength=len(self.ids))
            for k in [k for k in found if overlap[k] >= kept]:
                spans = regions.setdefault(k, [])
                low, high = max(0, s - around), s + WINDOW + around
                if spans and low <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], high)
                else:
                    spans.append((low, high))
        return [self.ids[k] for k, spans in regions.items() if any(chained(coded[s:e], self.places[k], self.least, self.slack) for s, e in spans)]


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, slack: int = SLACK) -> DataFrame:
    """doc_id, item_id: one row for each document and item that leaked into it."""
    rows = items.select(F.col(item_id).cast("bigint"), F.col(item_text)).where(F.col(item_text).isNotNull())
    docs = spread(documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), F.col(text)))
    passes: list[list[ItemIndex]] = [[]]
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append(tuple(r))
        size += len(r[1])
        if len(block) == ITEMS_PER_BLOCK:
            passes[-1].append(ItemIndex(block, least, slack))
            block = []
            if size >= ITEM_BYTES:
                passes.append([])
                size = 0
    if block:
        passes[-1].append(ItemIndex(block, least, slack))
    return reduce(DataFrame.union, (_search(docs, blocks) for blocks in passes if blocks or len(passes) == 1))


def _search(docs: DataFrame, blocks: list[ItemIndex]) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for batch in batches:
            found = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = plain(t).split()
                found += [(i, k) for index in indexes for k in index.find_in(tokens)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, item_id bigint")


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """suite, item_id, n_documents of every item, also those that leaked nowhere."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("suite", "item_id").join(n, "item_id", "left").select("suite", "item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
