"""JSON-lines files and JSON reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import gold


def read_jsonl(spark: SparkSession, path: str, schema: str = gold.SCHEMA) -> DataFrame:
    """Rows of JSON lines. A missing file is empty, blank lines are passed over, a line that is no JSON fails the read and is named."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").isNull().alias("bad"), F.from_json("value", schema).alias("x"), "value")
    bad = F.when(F.col("bad"), F.raise_error(F.concat(F.lit("not a JSON line: "), F.left("value", F.lit(200)))).cast("boolean"))
    return parsed.where(bad.isNull()).select("x.*")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Appends rows that are valid gold rows; any that is not fails the call before anything is written."""
    wrong = gold.validate(rows).where(F.size("errors") > 0).select("pr_id", "errors").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"pr {r['pr_id']}: {', '.join(r['errors'])}" for r in wrong))
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).write.mode("append").text(path)


def write_report(report: dict[str, DataFrame | object], path: str) -> dict:
    """A JSON file of small results, a list of rows for each DataFrame, with sorted keys. Results are aggregates; nothing larger belongs here."""
    out = {k: [r.asDict(True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in report.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, default=str), encoding="utf-8")
    return out
