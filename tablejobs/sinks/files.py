"""File exports: CSV, JSON, INSERT and UPDATE scripts, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions.scalars import number_text, sql_literal
from ..functions.types import as_text, is_nested, quote
from ..operators.documents import to_documents
from ..operators.ordering import number_rows

ROWS_PER_INSERT = 100


def flat_text(df: DataFrame) -> DataFrame:
    """Nested and binary columns as text, the others as they are."""
    return df.select([
        (as_text(F.col(quote(f.name)), f.dataType)
         if is_nested(f.dataType) or isinstance(f.dataType, T.BinaryType)
         else F.col(quote(f.name))).alias(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, max_records: int = 0) -> None:
    """CSV with header; NULL and empty text are both an empty field.

    ``max_records`` cuts files, so that readers of multi-line fields, who take
    one task per file, still run in parallel.
    """
    (flat_text(df).write
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", max_records)
     .csv(path))


def _csv_field(c: Column, dtype: T.DataType) -> Column:
    text = number_text(c, dtype) if isinstance(dtype, T.NumericType) else as_text(c, dtype)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_record(df: DataFrame) -> Column:
    """A row of ``df`` as one CSV record."""
    return F.concat_ws(",", *[_csv_field(F.col(quote(f.name)), f.dataType)
                              for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with NULL fields kept."""
    df.write.option("ignoreNullFields", False).json(path)


def write_documents(df: DataFrame, path: str) -> int:
    """One document per row; returns the number written."""
    written = Observation()
    to_documents(df, "value").observe(written, F.count(F.lit(1)).alias("n_rows")).write.text(path)
    return written.get["n_rows"]


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literals(df: DataFrame) -> dict[str, Column]:
    return {f.name: sql_literal(F.col(quote(f.name)), f.dataType) for f in df.schema.fields}


def insert_statements(df: DataFrame, table: str, order: list[str],
                      per_statement: int = ROWS_PER_INSERT) -> DataFrame:
    """statement_no and an INSERT of up to 100 rows each, rows in order.

    The row number comes from a range-partitioned sort; a statement then is a
    group of at most ``per_statement`` rows.
    """
    row = F.concat(F.lit("("), F.concat_ws(", ", *_literals(df).values()), F.lit(")"))
    keyed = df.select(*[quote(c) for c in order], row.alias("_row"))
    numbered = number_rows(keyed, order, "_pos")
    head = f"INSERT INTO {_name(table)} ({', '.join(_name(c) for c in df.columns)}) VALUES\n  "
    rows = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_row"))), lambda r: r["_row"])
    return (numbered.groupBy(F.floor(F.col("_pos") / per_statement).alias("statement_no"))
            .agg(F.concat(F.lit(head), F.array_join(rows, ",\n  "), F.lit(";")).alias("statement")))


def update_statements(df: DataFrame, table: str, keys: list[str] | None = None) -> DataFrame:
    """One UPDATE per row; without keys all columns identify the row."""
    literals = _literals(df)
    pair = lambda c: F.concat(F.lit(f"{_name(c)} = "), literals[c])
    sets = F.concat_ws(", ", *[pair(c) for c in df.columns])
    where = F.concat_ws(" AND ", *[pair(c) for c in keys or df.columns])
    return df.select(F.concat(F.lit(f"UPDATE {_name(table)} SET "), sets,
                              F.lit(" WHERE "), where, F.lit(";")).alias("statement"))


def write_script(statements: DataFrame, path: str) -> None:
    """Statements as text files, in statement order where they are numbered."""
    if "statement_no" in statements.columns:
        statements = (statements.repartitionByRange("statement_no")
                      .sortWithinPartitions("statement_no"))
    statements.select("statement").write.text(path)
