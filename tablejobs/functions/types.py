"""Type rules: portable type lattice, typed binds, display forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Raw type names of each source kind and their portable type.
LATTICE_NAMES = {
    "mysql": {
        "INTEGER": ("int", "integer", "tinyint", "smallint", "mediumint"),
        "BIGINT": ("bigint",),
        "REAL": ("float", "double", "decimal", "numeric", "real"),
        "BLOB": ("blob", "mediumblob", "longblob", "binary", "varbinary"),
    },
    "postgresql": {
        "INTEGER": ("integer", "int4", "int2", "smallint", "int", "serial",
                    "smallserial", "boolean", "bool"),
        "BIGINT": ("bigint", "int8", "bigserial"),
        "REAL": ("real", "float4", "double precision", "float8", "numeric"),
        "BLOB": ("bytea", "blob"),
    },
    "sqlite": {
        "INTEGER": ("integer", "int", "bigint", "smallint", "tinyint", "mediumint"),
        "REAL": ("real", "double", "float", "numeric", "decimal"),
        "BLOB": ("blob",),
    },
    "spark": {
        "INTEGER": ("int", "smallint", "tinyint", "boolean"),
        "BIGINT": ("bigint",),
        "REAL": ("float", "double", "decimal"),
        "BLOB": ("binary",),
    },
}

LATTICE_SPARK = {
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "REAL": T.DoubleType(),
    "TEXT": T.StringType(),
    "BLOB": T.BinaryType(),
}

_SIZE = re.compile(r"\s*\(([^)]*)\)")


def _split_type(raw: str) -> tuple[str, list[str]]:
    """``decimal(10,2) unsigned`` → (``decimal unsigned``, [``10``, ``2``])."""
    found = _SIZE.search(raw)
    args = [a.strip() for a in found.group(1).split(",")] if found else []
    return " ".join(_SIZE.sub("", raw.lower()).split()), args


def lattice_type(raw: str, kind: str) -> str:
    """Portable type of a raw type name; anything unknown is TEXT."""
    name, args = _split_type(raw)
    if kind == "oracle":
        if "number" in name:
            return "REAL" if len(args) == 2 else "BIGINT"
        if name in ("float", "binary_float", "binary_double"):
            return "REAL"
        return "BLOB" if name in ("blob", "raw", "long raw") else "TEXT"
    name = name.removesuffix(" unsigned")
    for portable, names in LATTICE_NAMES.get(kind, {}).items():
        if name in names:
            return portable
    return "TEXT"


def spark_type(raw: str, kind: str) -> T.DataType:
    """Spark type of a raw type name, keeping decimal precision."""
    name, args = _split_type(raw)
    unsigned = name.endswith(" unsigned")
    name = name.removesuffix(" unsigned")
    if name in ("decimal", "numeric", "number") and args and args[0].isdigit():
        scale = int(args[1]) if len(args) == 2 else 0
        return T.DecimalType(min(int(args[0]), 38), scale)
    if name == "tinyint" and args == ["1"] or name in ("boolean", "bool"):
        return T.BooleanType()
    if name == "bigint" and unsigned:
        return T.DecimalType(20, 0)
    if name in ("int", "integer") and unsigned:
        return T.LongType()
    if name == "date" and kind != "oracle":
        return T.DateType()
    if name in ("datetime", "timestamp", "timestamp without time zone", "date"):
        return T.TimestampNTZType()
    if name in ("timestamptz", "timestamp with time zone"):
        return T.TimestampType()
    if name in ("float4", "real") and kind == "postgresql":
        return T.FloatType()
    return LATTICE_SPARK[lattice_type(raw, kind)]


def type_map(columns: list[tuple[str, str]], kind: str) -> dict[str, str]:
    return {name: lattice_type(raw, kind) for name, raw in columns}


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value: nested values as JSON, binary in its display form."""
    if is_nested(dtype):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return display_bytes(c)
    return c.cast("string")


def to_lattice(df: DataFrame) -> DataFrame:
    """Cast every column to the portable type of its Spark type."""
    out = []
    for field in df.schema.fields:
        target = LATTICE_SPARK[lattice_type(field.dataType.simpleString(), "spark")]
        if isinstance(target, T.StringType):
            value = as_text(F.col(_q(field.name)), field.dataType)
        else:
            value = F.col(_q(field.name)).cast(target)
        out.append(value.alias(field.name))
    return df.select(out)


def display_bytes(c: Column) -> Column:
    """Bytes that are all 0 or 32..126 as text, others as 0x and lower hex."""
    text = F.decode(c, "ISO-8859-1")
    return F.when(text.rlike(r"[^\x00\x20-\x7E]"), hex_text(c)).otherwise(text)


def hex_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def hex_to_bytes(c: Column) -> Column:
    """Hex text to bytes; characters that are no hex digits are dropped, and so
    is a last single digit. Text that is clean but for spaces and line breaks is
    decoded without the pattern match."""
    body = F.when(c.startswith("0x") | c.startswith("0X"), F.substr(c, F.lit(3))).otherwise(c)
    body = F.replace(F.replace(body, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    digits = F.regexp_replace(body, "[^0-9a-fA-F]+", "")
    even = F.substring(digits, F.lit(1), (F.floor(F.length(digits) / 2) * 2).cast("int"))
    clean = F.when(F.length(body) % 2 == 0, F.unhex(body))
    return F.coalesce(clean, F.unhex(even))


def display(df: DataFrame) -> DataFrame:
    """All columns in the form a result grid shows."""
    out = []
    for field in df.schema.fields:
        c, dtype = F.col(_q(field.name)), field.dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = c.cast("string")
        elif isinstance(dtype, T.BinaryType) or is_nested(dtype):
            c = as_text(c, dtype)
        out.append(c.alias(field.name))
    return df.select(out)


def bind(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A value as the target type takes it: JSON values as text, hex text as
    bytes, booleans as 1/0 or the text TRUE/FALSE."""
    if have == want:
        return c
    if isinstance(want, T.BinaryType) and isinstance(have, T.StringType):
        return F.when(c.rlike("^0x[0-9a-fA-F]*$"), hex_to_bytes(c)).otherwise(
            F.encode(c, "UTF-8"))
    if isinstance(want, T.StringType):
        if isinstance(have, T.BooleanType):
            return F.upper(c.cast("string"))
        return as_text(c, have)
    return c.cast(want)


def bind_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast ``df`` to ``schema`` by column name; a missing column is NULL."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select([
        (bind(F.col(_q(f.name)), have[f.name], f.dataType) if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


quote = _q


def text(value: str) -> str:
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
