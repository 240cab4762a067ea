"""Repetition inside a single document.

Every document is scored by the length-normalised log-likelihood ratio of its hashed word n-grams between two
multinomials: one over the raw corpus, one over a trusted target, the documents whose n-grams hardly recur. A feature is
the n-gram's hash bucket together with whether it stood earlier in the same document, so a document that says the same
again moves mass to features the trusted part rarely has.

The ratio ranks documents but does not measure a share, and nothing bounds it from below for a given share: where all documents repeat,
or repeat what trusted ones repeat too, it is low for heavy ones. So the share of repeated characters is measured exactly for every
document, from the same hashes, and the case threshold is put on that alone.

Words are compared folded, with every number or version as one value; scripts without blanks are taken by character.
Blank, null and short texts have share 0. The multinomials have a fixed number of cells, summed over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

NGRAM = 4
BUCKETS = 4096
#: Documents with at most this share of recurring n-grams make up the trusted target.
TRUSTED = 0.1
CASE_SHARE = 0.4

#: Scripts without blanks between words.
WIDE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af"
_TOKEN = re.compile(rf"[{WIDE}]|[^\W{WIDE}]+(?:[.-]\d\w*)*")
_NUMBER = re.compile(r"\d+(?:[.\-\w]*\d)?")


class Codes(dict):
    """Token -> hash of its folded form with all numbers alike, the same on every machine. Emptied when it holds LIMIT tokens."""

    LIMIT = 200_000

    def __missing__(self, token: str) -> int:
        w = _NUMBER.sub("0", token.casefold()).encode("utf-8", "surrogatepass")
        code = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        if len(token) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = code
        return code

    def __reduce__(self):
        return Codes, ()


CODES = Codes()


def grams(tokens: list[str], n: int = NGRAM) -> np.ndarray:
    """64-bit hashes of the n-grams; two different ones of a text share theirs with a chance of 2**-64 a pair."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(CODES.__getitem__, tokens), np.uint64, len(tokens))
    code = a[:m].copy()
    for k in range(1, n):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
        code += a[k : k + m]
    code *= np.uint64(0xD6E8FEB86659FD93)
    return code


def recurring(code: np.ndarray) -> np.ndarray:
    """Whether each n-gram stood earlier."""
    again = np.ones(len(code), bool)
    again[np.unique(code, return_index=True)[1]] = False
    return again


def covered(ws: list[str], again: np.ndarray, n: int = NGRAM) -> float:
    """Share of the words' characters in n-grams that stood earlier."""
    if not again.any():
        return 0.0
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    at = np.zeros(len(ws) + 1, np.int64)
    at[:-n][again] += 1
    at[n:][again] -= 1
    return float(lengths[np.cumsum(at[:-1]) > 0].sum() / lengths.sum())


def share(text: str | None, n: int = NGRAM) -> float:
    """Share of the text's word characters in n-grams that stood earlier in it."""
    ws = _TOKEN.findall(text) if text else []
    return covered(ws, recurring(grams(ws, n)), n)


def cells_of(code: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Cells of n-grams, 2 * bucket + recurs."""
    return (code >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) * 2 + again


def features(text: str | None) -> tuple[np.ndarray, float]:
    """Cells of the document's n-grams and the share of n-grams that recur."""
    code = grams(_TOKEN.findall(text)) if text else np.empty(0, np.uint64)
    if not len(code):
        return np.empty(0, np.int64), 0.0
    again = recurring(code)
    return cells_of(code, again), float(again.mean())


def multinomials(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Log of raw / target for each cell, from all documents. Tasks send one row per used cell; 2 * BUCKETS reach the driver."""
    schema = pa.schema([("cell", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            trusted, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for t in batch.column(0).to_pylist():
                cells, part = features(t)
                (trusted if part <= TRUSTED else other).append(cells)
            n = np.bincount(np.concatenate(trusted), minlength=2 * BUCKETS)
            target += n
            raw += n + np.bincount(np.concatenate(other), minlength=2 * BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], schema=schema)

    cells = spread(documents.where(F.col(text).isNotNull()).select(text)).mapInArrow(count, "cell int, raw bigint, target bigint")
    n = np.zeros((2, 2 * BUCKETS))
    for r in cells.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        n[:, r["cell"]] = r["raw"], r["target"]
    return log_ratio(n)


def log_ratio(n: np.ndarray) -> np.ndarray:
    """Each cell is smoothed with the share its kind (recurring or not) has in its multinomial, spread over the buckets."""
    kind = np.array([n[:, 0::2].sum(1), n[:, 1::2].sum(1)]).T + 1.0
    prior = np.tile(kind / kind.sum(1, keepdims=True), BUCKETS) / BUCKETS
    weight = 20.0 * BUCKETS
    p = (n + weight * prior) / (n.sum(1, keepdims=True) + weight)
    return np.log(p[0]) - np.log(p[1])


def repetition(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, llr, share of every document; both are 0 without n-grams."""
    ratio = multinomials(documents, text)
    schema = pa.schema([("doc_id", pa.int64()), ("llr", pa.float64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            llr, shares = [], []
            for t in batch.column(1).to_pylist():
                ws = _TOKEN.findall(t) if t else []
                code = grams(ws)
                again = recurring(code)
                llr.append(float(ratio[cells_of(code, again)].mean()) if len(code) else 0.0)
                shares.append(covered(ws, again))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(llr, pa.float64()), pa.array(shares, pa.float64())], schema=schema)

    return spread(documents.select(F.col(doc_id).cast("bigint"), F.col(text))).mapInArrow(run, "doc_id bigint, llr double, share double")
