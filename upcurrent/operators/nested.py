"""Deeply nested records as related flat tables: structural-variant tables.

A bottom-up tree automaton reads every record: the children of an object get their states first, and the object's own state
follows from its members and the set of its children's states (DELTA). A state is the variant of its level, so that a hunk with
version bumps is another variant than one without, and a file with such hunks another than a bare one. Each variant goes to a
typed table that has the columns this variant has; the tables of a level share its supertype's columns and the keys
(id, file_no, hunk_no, bump_no, label_no). A child's parent is its key with the last number left off.

Numbers count positions from 1; nodes that yield nothing keep theirs. Rules: the files are a bare list, an object with `nodes`, pages of
such objects counted on as one list, or a single file. Text that holds JSON is read again, however often it was wrapped, at any place
where a list or object may stand. A single object in place of a list is its only element; null elements and lists yield
nothing. A file without a path or filename yields nothing, nor do its children. JSON of any depth is read. Text that is no JSON and cut
JSON yield no rows, like null and blank. A scalar column that holds a list or object gets it as JSON text, or null if that is nested too deeply to be written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import spread

NODE_SCHEMA = """id bigint, level string, variant string, file_no int, hunk_no int, bump_no int, label_no int, path string,
previous_path string, additions bigint, deletions bigint, header string, package string, from_version string,
to_version string, dimension string, label string"""
KEYS = ["id", "file_no", "hunk_no", "bump_no", "label_no"]
LEVELS = ("file", "hunk", "bump", "label")
#: The columns of each level's supertype beside its keys.
COLUMNS = {"file": ["path", "previous_path", "additions", "deletions"], "hunk": ["header"], "bump": ["package", "from_version", "to_version"], "label": ["dimension", "label"]}
#: The member that holds the children of each level.
CHILDREN = {"file": "hunks", "hunk": "bumps", "bump": "labels", "label": None}
#: Columns of the supertype that a variant does not have.
LACKS = {"file": ["previous_path"], "bare_file": ["previous_path"], "named_file": ["previous_path"], "bare_named_file": ["previous_path"], "new_bump": ["from_version"], "labelled_new_bump": ["from_version"], "bare_label": ["dimension"]}
VARIANTS = {
    "file": [b + k for b in ("", "bare_") for k in ("file", "named_file", "renamed_file")],
    "hunk": ["hunk", "empty_hunk"],
    "bump": ["bump", "new_bump", "labelled_bump", "labelled_new_bump"],
    "label": ["label", "bare_label"],
}


# --- Reading ---

_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def loads_deep(text: str):
    """json.loads without recursion, for JSON nested deeper than that goes. Raises ValueError likewise."""
    skip = lambda i: _BLANK.match(text, i).end()
    open_: list = []  # containers from the outermost to the one being filled, each with the key its next value goes to
    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "[" or c == "{":
            j = skip(i + 1)
            empty = text[j : j + 1] == ("]" if c == "[" else "}")
            value = [] if c == "[" else {}
            if not empty:
                open_.append([value, None])
                i = j
                if c == "{":
                    open_[-1][1], i = _key(text, i, skip)
                continue
            i = j + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _SCALAR.match(text, i):
            value, i = json.loads(m[0]), m.end()
        else:
            raise ValueError(f"no value at {i}")
        while True:  # the value is whole: it goes into its container, which may be whole with it
            i = skip(i)
            if not open_:
                if i < len(text):
                    raise ValueError(f"more text at {i}")
                return value
            box, key = open_[-1]
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if key is not None:
                    open_[-1][1], i = _key(text, i, skip)
                break
            if c != ("]" if key is None else "}"):
                raise ValueError(f"no end at {i}")
            value = box
            open_.pop()
            i += 1


def _key(text: str, i: int, skip) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError(f"no name at {i}")
    key, i = scanstring(text, i + 1, True)
    i = skip(i)
    if text[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, skip(i + 1)


def read(value):
    """value, or what the JSON in it says; None if it is text of another kind. Each wrapping is shorter than what it wraps."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = loads_deep(value)
            except ValueError:
                return None
        except ValueError:
            return None
    return value


def elements(value) -> list:
    value = read(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def filled(value) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return None


def whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 2**63 else None


def file_list(value) -> list:
    """All file nodes in order; pages are counted on as one list."""
    value = read(value)
    if isinstance(value, dict):
        return elements(value["nodes"]) if "nodes" in value else [value]
    if not isinstance(value, list):
        return []
    out = []
    for x in value:
        x = read(x) if isinstance(x, str) else x
        if isinstance(x, dict) and "nodes" in x:
            out += elements(x["nodes"])
        elif isinstance(x, list):
            out += x
        else:
            out.append(x)
    return out


# --- The automaton ---


def symbol(level: str, v: dict) -> str:
    """What the object's own members say."""
    if level == "file":
        return "renamed_file" if filled(v.get("previous_path")) else "file" if filled(v.get("path")) else "named_file"
    if level == "bump":
        return "bump" if v.get("from") is not None else "new_bump"
    if level == "label":
        return "label" if v.get("dimension") is not None else "bare_label"
    return "hunk"


@cache
def delta(level: str, own: str, below: frozenset[str]) -> str:
    """The transition: an object's state from its symbol and the states of its children."""
    if level == "file":
        return own if "hunk" in below else "bare_" + own
    if level == "hunk":
        return own if below else "empty_hunk"
    if level == "bump":
        return "labelled_" + own if "label" in below else own
    return own


Tree = tuple[str, dict, list]


def accept(level: int, v: dict) -> Tree:
    """State, object and accepted children, null where an element yields nothing; children first."""
    name = LEVELS[level]
    member = CHILDREN[name]
    kids: list = []
    if member is not None and (inner := v.get(member)) is not None:
        for x in elements(inner):
            x = read(x) if isinstance(x, str) else x
            kids.append(accept(level + 1, x) if isinstance(x, dict) else None)
    return delta(name, symbol(name, v), frozenset(k[0] for k in kids if k)), v, kids


def nodes(doc) -> Iterator[tuple[str, str, dict, tuple[int, int, int, int]]]:
    """Level, variant, object and numbers of every node, parents first."""
    for n, f in enumerate(file_list(doc), 1):
        f = read(f) if isinstance(f, str) else f
        if not isinstance(f, dict) or not (filled(f.get("path")) or filled(f.get("filename"))):
            continue
        state, v, hunks = accept(0, f)
        yield "file", state, v, (n, 0, 0, 0)
        for m, h in enumerate(hunks, 1):
            if h:
                yield "hunk", h[0], h[1], (n, m, 0, 0)
                for k, b in enumerate(h[2], 1):
                    if b:
                        yield "bump", b[0], b[1], (n, m, k, 0)
                        for j, x in enumerate(b[2], 1):
                            if x:
                                yield "label", x[0], x[1], (n, m, k, j)


def _columns(level: str, v: dict) -> tuple:
    is_file, is_bump = level == "file", level == "bump"
    return (
        (filled(v.get("path")) or filled(v.get("filename"))) if is_file else None,
        text(v.get("previous_path")) if is_file else None,
        whole(v.get("additions")) if is_file else None,
        whole(v.get("deletions")) if is_file else None,
        text(v.get("header")) if level == "hunk" else None,
        text(v.get("package")) if is_bump else None,
        text(v.get("from")) if is_bump else None,
        text(v.get("to")) if is_bump else None,
        text(v.get("dimension")) if level == "label" else None,
        text(v.get("label")) if level == "label" else None,
    )


# --- Over a table ---

BATCH_ROWS = 20_000


def flatten(df: DataFrame, row_id: str, payload: str, levels: tuple[str, ...] = LEVELS, values: bool = True) -> DataFrame:
    """One row per node of the given levels, as NODE_SCHEMA; without values only level, variant and keys are filled.

    Nodes leave in batches of bounded size, however many one record holds.
    """
    names = [x.split()[0] for x in NODE_SCHEMA.replace("\n", " ").split(",")]
    kinds = [x.split()[1] for x in NODE_SCHEMA.replace("\n", " ").split(",")]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, arrow[k]) for n, k in zip(names, kinds)])
    empty = (None,) * 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        for batch in batches:
            for i, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for level, variant, v, at in nodes(doc):
                    if level in levels:
                        rows.append((i, level, variant, *at, *(_columns(level, v) if values else empty)))
                        if len(rows) >= BATCH_ROWS:
                            yield make(rows)
                            rows = []
        if rows:
            yield make(rows)

    return spread(df.where(F.col(payload).isNotNull()).select(F.col(row_id).cast("bigint"), F.col(payload))).mapInArrow(run, NODE_SCHEMA)


def _keys(level: str) -> list[str]:
    return KEYS[: 2 + LEVELS.index(level)]


def level_table(flat: DataFrame, level: str) -> DataFrame:
    """The supertype's table of one level: its keys, the variant and the columns all its variants share or may have."""
    return flat.where(F.col("level") == level).select(*_keys(level), "variant", *COLUMNS[level])


def variant_columns(level: str, variant: str) -> list[str]:
    return _keys(level) + [c for c in COLUMNS[level] if c not in LACKS.get(variant, [])]


def route(flat: DataFrame, root: str) -> dict[str, DataFrame]:
    """Reads every record once and writes each node to its variant's typed table under root; variant -> table, empty ones included."""
    flat.write.partitionBy("variant").parquet(root)
    spark = flat.sparkSession
    every = spark.read.schema(NODE_SCHEMA).parquet(root)
    # Each table is one folder: the filter on the partition column reads no other, and only the variant's columns are read.
    return {v: every.where(F.col("variant") == v).select(*variant_columns(level, v)) for level, vs in VARIANTS.items() for v in vs}
