"""Queries of the text problems over the whole tables. Only repetition can be put in SQL; tests compare the others with brute force."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import leakage, markup, repetition, tokens, truncation

#: Where the public tokenizers' files are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.used_markup(table(spark, d, "pr"))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_text(table(spark, d, "pr"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "pr"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(truncation.scored(table(spark, d, "pr")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return p8_ids(spark, d).select("doc_id", F.size("ids").alias("n_ids"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, d), table(spark, d, "eval_item"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


def p10_repeated(spark: SparkSession, d: str) -> DataFrame:
    return p10_share(spark, d).select("doc_id", F.round("share", 6).alias("share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_share(spark, d).where(F.col("share") >= repetition.CASE_SHARE).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p8_counts": p8_counts,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_share": p10_share,
    "p10_repeated": p10_repeated,
}
#: Tokens as of repetition: characters of scripts without blanks stand alone, numbers are all alike.
_W = r"[\p{L}\p{N}_]"
_SHARES = rf"""
t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([{repetition.WIDE}])', ' \1 ', 'g'), '{_W}+(?:[.-][0-9]{_W}*)*') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
n AS (SELECT *, regexp_replace(lower(w), '[0-9]+(?:(?:{_W}|[.-])*[0-9])?', '0', 'g') AS x FROM u),
g AS (SELECT *, {" || chr(1) || ".join(["x"] + [f"lead(x, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, repetition.NGRAM)])} AS gram FROM n),
a AS (SELECT *, CAST(gram IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, gram) AS INT) AS again FROM g),
c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {repetition.NGRAM - 1} PRECEDING AND CURRENT ROW) AS covered FROM a),
shares AS (SELECT doc_id, sum(length(w) * covered) / sum(length(w)) AS share FROM c GROUP BY doc_id)"""
SQL: dict[str, str] = {
    "p10_repeated": f"WITH {_SHARES} SELECT doc_id, round(coalesce(share, 0.0), 6) AS share FROM documents LEFT JOIN shares USING (doc_id)",
    "p10_found": f"WITH {_SHARES} SELECT doc_id FROM shares WHERE share >= {repetition.CASE_SHARE}",
}
