"""Printers: values in the classic form, and tables."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from pyspark.sql import Row

from lumenrel.plans.query import Query


def classic(value: Any, option: bool = False) -> str:
    """1 ~> 1, -1 ~> ~1, "a" quoted, lists in brackets, records in braces with labels in order; with option, SOME and NONE."""
    if value is None:
        return "NONE"
    text = _plain(value)
    return f"SOME {text}" if option else text


def _plain(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float, Decimal)):
        text = f"{v:.6g}" if isinstance(v, float) else str(v)
        text = text if not isinstance(v, float) or "." in text or "e" in text or "n" in text else text + ".0"
        return text.replace("-", "~")
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    if isinstance(v, Row):
        v = v.asDict()
    if isinstance(v, Mapping):
        return "{" + ",".join(f"{k}={classic(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(classic(x) for x in v) + "]"
    return str(v)


def tabular(q: Query, rows: int = 1000) -> str:
    """A table of the first rows: labels, rules and values in columns; numbers to the right."""
    df = q.frame()
    found = df.limit(rows).collect()
    cells = [[_cell(r[n]) for n in df.columns] for r in found]
    width = [max([len(n), *(len(c[i]) for c in cells)]) for i, n in enumerate(df.columns)]
    right = [t in ("int", "bigint", "double", "float") or t.startswith("decimal") for _, t in df.dtypes]
    line = lambda parts: " ".join(p.rjust(w) if r else p.ljust(w) for p, w, r in zip(parts, width, right, strict=True)).rstrip()
    return "\n".join([line(df.columns), " ".join("-" * w for w in width), *map(line, cells)])


def _cell(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else classic(v)
