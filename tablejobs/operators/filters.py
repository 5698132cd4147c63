"""Row filters: filter text, filter boxes, document filters."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import NUMBER
from ..functions.types import quote

# Fixed value: the operators a filter box may begin with.
_BOX = re.compile(r"^(>=|<=|<>|!=|>|<|=)\s*(.*)$", re.S)

_COMPARE = {
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
    "<>": lambda c, v: c != v, "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, "=": lambda c, v: c == v,
}


def where_text(df: DataFrame, text: str | None) -> DataFrame:
    return df.where(F.expr(text)) if text and text.strip() else df


def _box_value(text: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType) and re.match(NUMBER, text.strip()):
        plain = text.strip()
        return F.lit(float(plain)) if "." in plain else F.lit(int(plain))
    return F.lit(text)


def box_condition(name: str, text: str, dtype: T.DataType) -> Column:
    """One filter box: operator prefix, ``%`` at an end for LIKE, or equality."""
    text, c = text.strip(), F.col(quote(name))
    found = _BOX.match(text)
    if found:
        return _COMPARE[found.group(1)](c, _box_value(found.group(2), dtype))
    if text.startswith("%") or text.endswith("%"):
        return c.cast("string").like(text)
    return c == _box_value(text, dtype)


def filter_boxes(df: DataFrame, boxes: dict[str, str]) -> DataFrame:
    """Rows that meet every box; blank boxes are left out."""
    conditions = [box_condition(name, text, df.schema[name].dataType)
                  for name, text in boxes.items() if text.strip()]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def _document_conditions(wanted: dict, prefix: tuple = ()) -> list[Column]:
    out = []
    for key, value in wanted.items():
        path = (*prefix, *key.split("."))
        column = F.col(".".join(quote(p) for p in path))
        if isinstance(value, dict):
            out += _document_conditions(value, path)
        else:
            out.append(column.isNull() if value is None else column == F.lit(value))
    return out


def document_filter(df: DataFrame, text: str | None) -> DataFrame:
    """Equality filter from a JSON object; text that is no object filters
    nothing."""
    try:
        wanted = json.loads(text or "")
    except ValueError:
        return df
    conditions = _document_conditions(wanted) if isinstance(wanted, dict) else []
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
