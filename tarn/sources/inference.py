"""Schemas from the first records, by fixed lattices instead of Spark's own inference."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import types as T

#: Records that a schema is inferred from.
SAMPLE = 100
_INT = re.compile(r"[+-]?\d+\Z")
_NUMERIC = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)\Z")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z|[+-]?(inf|infinity|nan)\Z", re.I)
# Spellings of booleans.
_BOOLS = frozenset("t f true false yes no on off y n".split())
_NUMBER = T.DecimalType(38, 9)


def check_names(names: list[str]) -> list[str]:
    if any(not n or len(n.encode()) >= 64 or "\0" in n for n in names):
        raise ValueError("column names must be neither empty nor 64 bytes or longer, without NUL")
    if len(set(names)) < len(names):
        raise ValueError("column names must be unique")
    return names


def _value_type(values: list[str | None]) -> T.DataType:
    """int8, then numeric, float8, bool, text; a column without values is text."""
    given = [v for v in values if v is not None]
    if not given:
        return T.StringType()
    if all(_INT.match(v) and -(2**63) <= int(v) < 2**63 for v in given):
        return T.LongType()
    if all(_NUMERIC.match(v) for v in given):
        whole = max(len(v.lstrip("+-").split(".")[0]) for v in given)
        scale = max(len(v.split(".")[1]) if "." in v else 0 for v in given)
        return T.DecimalType(min(38, max(whole + scale, 1)), scale) if whole + scale <= 38 else T.DoubleType()
    if all(_FLOAT.match(v) for v in given):
        return T.DoubleType()
    if all(v.lower() in _BOOLS for v in given):
        return T.BooleanType()
    return T.StringType()


def infer_csv_schema(lines: list[str], header: bool = True, sep: str = ",", quote: str = '"', null: str = "") -> T.StructType:
    """From the first ``SAMPLE`` records of CSV or tab-separated text."""
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep, quotechar=quote))
    if not rows:
        raise ValueError("no records to infer a schema from")
    names = check_names(rows[0] if header else [f"column{k}" for k in range(1, len(rows[0]) + 1)])
    body = [r for r in rows[1 if header else 0 :] if r][:SAMPLE]
    if any(len(r) != len(names) for r in body):
        raise ValueError("a record has another number of fields")
    return T.StructType([T.StructField(n, _value_type([None if r[k] == null else r[k] for r in body])) for k, n in enumerate(names)])


def infer_json_schema(lines: list[str]) -> T.StructType:
    """null, bool, int8, numeric, text and jsonb; int and numeric meet in numeric, any other mix is jsonb (JSON text)."""
    kinds: dict[str, set[str]] = {}
    for line in [x for x in lines if x.strip()][:SAMPLE]:
        record = json.loads(line, parse_float=lambda s: ("numeric", s))
        if not isinstance(record, dict):
            raise ValueError("a JSON record must be an object")
        for name, v in record.items():
            kind = "null" if v is None else "bool" if isinstance(v, bool) else "numeric" if isinstance(v, tuple) else ("int8" if -(2**63) <= v < 2**63 else "numeric") if isinstance(v, int) else "text" if isinstance(v, str) else "jsonb"
            kinds.setdefault(name, set()).add(kind)
    types = {frozenset({"bool"}): T.BooleanType(), frozenset({"int8"}): T.LongType(), frozenset({"numeric"}): _NUMBER, frozenset({"int8", "numeric"}): _NUMBER}
    check_names(list(kinds))
    return T.StructType([T.StructField(n, types.get(frozenset(k - {"null"}), T.StringType())) for n, k in kinds.items()])
