"""Encoding of a corpus with a public byte-level BPE tokenizer: speculate and verify.

Texts are cut into words by the tokenizer's pattern; a word's ids do not depend on its neighbours. For the new words of a
batch a greedy longest-match proposes tokens; all adjacent pairs of the batch are then checked at once: a proposal is the
exact encoding if, for each adjacent pair of tokens, merging their joined bytes gives back that pair. Verdicts on pairs are
kept in sorted arrays, so the check is a binary search over the batch's distinct pairs. Only words with a failing pair
are merged exactly, by rank, with a heap: a word of any length takes O(n log n).

Empty and null texts give an empty list. The vocabulary file's path is a parameter; its ranks, of fixed size, go to the
tasks with the function.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

#: Fixed value: the pattern the byte_bpe_50k vocabulary was built with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in one task; the memory is emptied beyond that.
CACHED_WORDS = 300_000
#: Verdicts on pairs kept likewise.
CACHED_PAIRS = 1_000_000
#: Longer words are encoded, but not kept.
CACHED_LENGTH = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SpeculativeBpe:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.size = len(self.token)
        # Longest token that starts with these two bytes: where the greedy search begins.
        self.longest: dict[bytes, int] = {}
        for t in ranks:
            if len(t) > self.longest.get(t[:2], 0):
                self.longest[t[:2]] = len(t)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.split = regex.compile(PATTERN).findall

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the adjacent pair of the lowest rank is merged first, the leftmost of equals."""
        ranks, n = self.ranks, len(word)
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left; every single byte is a token."""
        ranks, longest, out, i, n = self.ranks, self.longest, [], 0, len(word)
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For codes first * size + second: whether the two tokens stay apart when merged together."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == distinct[known]
        if not known.all():
            new = distinct[~known]
            a, b = (new // self.size).tolist(), (new % self.size).tolist()
            verdict = np.fromiter((self.merge(self.token[x] + self.token[y]) == [x, y] for x, y in zip(a, b)), bool, len(new))
            place = at[~known]  # both arrays are in order, so the new ones are put in between
            self.pairs, self.fits = np.insert(self.pairs, place, new), np.insert(self.fits, place, verdict)
            at = np.searchsorted(self.pairs, distinct)
        return self.fits[at][back]

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words, as a batch."""
        data = [w.encode() for w in words]
        proposals = [self.propose(w) for w in data]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = owner[:-1] == owner[1:]
        failed: set[int] = set()
        if inner.any():
            ok = self.compatible((flat[:-1] * self.size + flat[1:])[inner])
            failed = set(np.unique(owner[:-1][inner][~ok]).tolist())
        return {w: tuple(self.merge(data[k]) if k in failed else proposals[k]) for k, w in enumerate(words)}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = self.learn([w for w in set(chain.from_iterable(split)) if w not in self.words])
        kept = {w: ids for w, ids in new.items() if len(w) <= CACHED_LENGTH}
        self.words |= kept
        if len(kept) == len(new):
            return [list(chain.from_iterable(map(self.words.__getitem__, words))) for words in split]
        return [list(chain.from_iterable(self.words[w] if w in self.words else new[w] for w in words)) for words in split]


def encode(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of every document. A map over partitions: nothing is shuffled."""
    ranks = load_ranks(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SpeculativeBpe(ranks)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = bpe.encode_batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, schema.field("ids").type)], schema=schema)

    return spread(documents.select(F.col(doc_id).cast("bigint"), F.col(text))).mapInArrow(run, "doc_id bigint, ids array<int>")
