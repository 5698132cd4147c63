"""Column changes of a table as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.types import quote


def reshape(df: DataFrame, add: dict[str, tuple[str, str | None]] | None = None,
            drop: list[str] | None = None, rename: dict[str, str] | None = None,
            retype: dict[str, str] | None = None) -> DataFrame:
    """Drop, retype and rename columns, then add new ones (type, default SQL).

    Naming a column that does not exist is an error.
    """
    add, drop, rename, retype = add or {}, drop or [], rename or {}, retype or {}
    unknown = {*drop, *rename, *retype} - set(df.columns)
    if unknown:
        raise ValueError(f"no such column: {sorted(unknown)}")
    out = []
    for name in df.columns:
        if name in drop:
            continue
        value = F.col(quote(name))
        if name in retype:
            value = value.cast(retype[name])
        out.append(value.alias(rename.get(name, name)))
    out += [F.expr(default or "NULL").cast(dtype).alias(name) for name, (dtype, default) in add.items()]
    return df.select(out)
