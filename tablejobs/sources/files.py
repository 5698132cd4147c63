"""File scans: CSV with header, JSON row files, JSON-lines documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.types import quote

BLANKS = " \t\n\r\u000b\f\u00a0\ufeff"


def _require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, ragged: bool = False) -> DataFrame:
    """All columns as trimmed text. A quoted field may hold line breaks (read
    by ``read_csv_split``, many tasks a file); ``multi_line=False`` (no such
    fields) reads lines by Spark's CSV reader, also split.

    Every file must have the same header; one with other columns, or in another
    order, fails the scan. So does a row of more or fewer fields, unless
    ``ragged`` rows are to be cut or filled with NULL."""
    if multi_line:
        return read_csv_split(spark, path, ragged)
    df = (spark.read
          .option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", multi_line).option("enforceSchema", False)
          .option("mode", "PERMISSIVE" if ragged else "FAILFAST").option("columnPruning", ragged)
          .csv(path))
    df = df.select([F.btrim(F.col(quote(c)), F.lit(BLANKS)).alias(c.strip()) for c in df.columns])
    return _require_rows(df, "a CSV import needs a header line and data below it")


def read_json_rows(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """Rows of JSON files, all columns text: an array of objects, an object with
    ``rows`` or ``data``, or arrays whose first one holds the names. Each file
    has its own form and its own names; columns are all names of all files (over
    ``most`` fail), NULL where a row lacks one. A file that is no JSON, or a row
    of more or fewer cells than its file has names, fails the scan.

    Each file is one row until its rows are taken out; large inputs belong in
    JSON lines (``read_json_lines``), which are split.
    """
    strict = {"mode": "FAILFAST"}
    message = "a JSON import needs at least one row"
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", "rows string, data string", strict)
    whole = whole.withColumn("_in", F.when(F.col("value").rlike(r"^\s*\{"), wrapped))
    body = F.when(F.col("_in").isNull(), F.col("value")).otherwise(F.coalesce("_in.rows", "_in.data"))
    body = whole.select(body.alias("body")).where("body IS NOT NULL")
    cells = F.from_json("body", "array<array<string>>", strict)
    ragged = F.raise_error(F.lit("a row has more or fewer cells than there are names"))
    named = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: F.when(
        F.size(c) == F.size(F.col("cells")[0]), F.map_from_arrays(F.col("cells")[0], c)).otherwise(ragged))
    lists = F.col("body").rlike(r"^\s*\[\s*\[")
    rows = (body.withColumn("cells", F.when(lists, cells))
            .select(F.explode(F.when(lists, named).otherwise(
                F.from_json("body", "array<map<string,string>>", strict))).alias("m")))
    found = (rows.select(F.posexplode(F.map_keys("m")).alias("pos", "name")).groupBy("name")
             .agg(F.min("pos").alias("pos")).orderBy("pos", "name").limit(most + 1).collect())
    if not found:
        raise ValueError(message)
    if len(found) > most:
        raise ValueError(f"the files have over {most} columns")
    return rows.select([F.col("m")[r["name"]].alias(r["name"]) for r in found])


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, all columns text; large files are split over tasks."""
    df = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    return _require_rows(df.select([
        (F.to_json(F.col(quote(f.name))) if not isinstance(f.dataType, T.StringType) else F.col(quote(f.name)))
        .alias(f.name) for f in df.schema.fields]), "a JSON import needs at least one row")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines documents; columns are the sorted union of all keys."""
    df = spark.read.json(path)
    return df.select([quote(c) for c in sorted(df.columns)])



_PIECES = "f string, kb long, ki long, ob long, oi long, text string, whole boolean"


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and split start; files are split over tasks and a
    split's lines come in order. Lines keep a trailing ``\\r``."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")


def _split_facts(batches):
    """Per split: lines, quote parity, and the last line that begins a record
    if the split begins outside quotes (``even``) or inside them (``odd``)."""
    import pyarrow as pa
    facts = {}
    for batch in batches:
        for f, b, line in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "value"))):
            n, parity, even, odd = facts.get((f, b), (0, 0, -1, -1))
            if parity == 0:
                even = n
            else:
                odd = n
            facts[(f, b)] = (n + 1, (parity + line.count('"')) % 2, even, odd)
    rows = [{"f": f, "b": b, "n": n, "parity": p, "even": e, "odd": o} for (f, b), (n, p, e, o) in facts.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("f", pa.string()), ("b", pa.int64()), ("n", pa.int64()), ("parity", pa.int32()),
        ("even", pa.int64()), ("odd", pa.int64())]))


def _split_states(facts) -> dict:
    """For each split: quote parity at its start, where the record open at its
    start began (or None), and whether the record open at its end ends there."""
    states, by_file = {}, {}
    for r in facts:
        by_file.setdefault(r.f, []).append(r)
    for f, splits in by_file.items():
        parity, carry = 0, None
        for r in sorted(splits, key=lambda r: r.b):
            states[(f, r.b)] = (parity, carry, (parity + r.parity) % 2 == 0)
            last = r.even if parity == 0 else r.odd
            if last >= 0:
                carry = (r.b, last)
            parity = (parity + r.parity) % 2
    return states


def _records(states: dict):
    def cut(batches):
        import pyarrow as pa
        schema = pa.schema([("f", pa.string()), ("kb", pa.int64()), ("ki", pa.int64()), ("ob", pa.int64()),
                            ("oi", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])
        out, split, key, buf, first, parity, i = [], None, None, [], 0, 0, 0

        def flush(last: bool):
            if buf:
                whole = key[0] == split[1] and (not last or states[split][2])
                out.append({"f": split[0], "kb": key[0], "ki": key[1], "ob": split[1], "oi": first,
                             "text": "\n".join(buf), "whole": whole})

        for batch in batches:
            for f, b, line in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "value"))):
                if (f, b) != split:
                    if split is not None:
                        flush(True)
                    split, i, buf, first = (f, b), 0, [], 0
                    if split not in states:
                        raise RuntimeError("file splits changed between the two passes of a CSV scan; "
                                           "keep spark.sql.files.maxPartitionBytes fixed while it runs")
                    parity, key = states[split][0], states[split][1]
                if parity == 0:
                    flush(False)
                    key, buf, first = (b, i), [], i
                buf.append(line)
                parity = (parity + line.count('"')) % 2
                i += 1
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if split is not None:
            flush(True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return cut


def read_csv_split(spark: SparkSession, path: str, ragged: bool = False) -> DataFrame:
    """``read_csv`` for files whose quoted fields hold line breaks, split over
    many tasks per file.

    A line begins a record when the quotes before it in its file are even in
    number. One pass sums each split's quote parity (one small row per split
    goes to the driver); the prefix over a file's splits gives each split's
    state at its start. A second pass cuts records inside each split in order;
    only a record that crosses a split's end travels, as pieces joined by key,
    so the text itself is never shuffled. Records are parsed by ``from_csv``
    with the header's names; all files must have the same header. Blank lines
    outside quotes are skipped, as the CSV reader does.
    """
    import csv

    lines = _raw_lines(spark, path)
    facts = lines.mapInArrow(_split_facts, "f string, b long, n long, parity int, even long, odd long").collect()
    states = _split_states(facts)
    cut = lines.mapInArrow(_records(states), _PIECES)
    pieces = (cut.where(~F.col("whole")).groupBy("f", "kb", "ki")
              .agg(F.array_sort(F.collect_list(F.struct("ob", "oi", "text"))).alias("p"))
              .select("f", "kb", "ki", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    records = (cut.where("whole").select("f", "kb", "ki", "text").unionByName(pieces)
               .withColumn("text", F.regexp_replace("text", "\r$", "")))
    is_header = F.col("ki") == 0
    heads = records.where(is_header & (F.col("kb") == 0)).select("f", "text").collect()
    if not heads:
        raise ValueError("a CSV import needs a header line and data below it")
    names = {tuple(next(csv.reader([h.text], quotechar='"', doublequote=True))) for h in heads}
    if len(names) != 1:
        raise ValueError("the files have different headers")
    header = [n.strip() for n in names.pop()]
    schema = ", ".join(f"`c{j}` string" for j in range(len(header)))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE" if ragged else "FAILFAST"}
    body = records.where(~(is_header & (F.col("kb") == 0)) & (F.col("text") != ""))
    parsed = body.select(F.from_csv("text", schema, options).alias("r"))
    df = parsed.select([F.btrim(F.col(f"r.c{j}"), F.lit(BLANKS)).alias(name) for j, name in enumerate(header)])
    return _require_rows(df, "a CSV import needs a header line and data below it")


# JSON arrays of objects, split at every "}" so that one large line is split too.
_JSON_PIECES = "f string, kb long, ki long, ko long, ob long, oi long, text string, whole boolean"


def _json_scanner():
    import re

    inside, outside = re.compile(r'[\\"]'), re.compile(r'["{\[\]]')

    def scan(piece: str, state: bool, depth: int, row_depth: int | None):
        """Quote state and depth after ``piece`` (which holds no "}"), and where
        an object at ``row_depth`` opens in it (at most once: it closes only at
        a "}")."""
        pos, opened = 0, None
        while True:
            if state:
                m = inside.search(piece, pos)
                if not m:
                    return state, depth, opened
                if m.group() == "\\":
                    pos = m.end() + 1
                    continue
                state, pos = False, m.end()
            else:
                m = outside.search(piece, pos)
                if not m:
                    return state, depth, opened
                c = m.group()
                if c == '"':
                    state = True
                elif c == "{":
                    if depth == row_depth and opened is None:
                        opened = m.start()
                    depth += 1
                elif c == "[":
                    depth += 1
                else:
                    depth -= 1
                pos = m.end()
    return scan


def _json_split_facts(batches):
    """Per split and for either quote state at its start: the state and depth
    change after its pieces (the "}" after its last piece not counted), and the
    first non-blank character of a file's first split."""
    import pyarrow as pa
    scan = _json_scanner()
    splits = {}
    for batch in batches:
        for f, b, piece in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "value"))):
            facts = splits.setdefault((f, b), {"n": 0, "runs": [[False, 0], [True, 0]], "head": None})
            for run in facts["runs"]:
                if facts["n"] and not run[0]:
                    run[1] -= 1
                run[0], run[1], _ = scan(piece, run[0], run[1], None)
            if facts["head"] is None and piece.strip():
                facts["head"] = piece.strip()[0]
            facts["n"] += 1
    rows = [{"f": f, "b": b, "n": v["n"], "out0": v["runs"][0][0], "delta0": v["runs"][0][1],
             "out1": v["runs"][1][0], "delta1": v["runs"][1][1], "head": v["head"]} for (f, b), v in splits.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("f", pa.string()), ("b", pa.int64()), ("n", pa.int64()), ("out0", pa.bool_()), ("delta0", pa.int64()),
        ("out1", pa.bool_()), ("delta1", pa.int64()), ("head", pa.string())]))


def _json_objects(states: dict):
    def cut(batches):
        import pyarrow as pa
        scan = _json_scanner()
        schema = pa.schema([("f", pa.string()), ("kb", pa.int64()), ("ki", pa.int64()), ("ko", pa.int64()),
                            ("ob", pa.int64()), ("oi", pa.int64()), ("text", pa.string()), ("whole", pa.bool_())])
        out, split = [], None
        st = depth = row = buf = key = first = None
        i = 0

        def emit(whole: bool):
            kb, ki, ko = key if key is not None else (None, None, None)
            out.append({"f": split[0], "kb": kb, "ki": ki, "ko": ko, "ob": split[1], "oi": first,
                        "text": "".join(buf), "whole": whole})

        def brace():  # the "}" that ended the last piece
            nonlocal st, depth, buf
            if buf is not None:
                buf.append("}")
            if not st:
                depth -= 1
                if buf is not None and depth == row:
                    emit(key is not None and key[0] == split[1])
                    buf = None

        def end_split():
            if split is not None:
                if not states[split]["final"]:
                    brace()
                if buf is not None:
                    emit(False)

        for batch in batches:
            for f, b, piece in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "value"))):
                if (f, b) != split:
                    end_split()
                    split, i = (f, b), 0
                    s = states[split]
                    st, depth, row = s["state"], s["depth"], s["row"]
                    key, first = s["carry"], 0
                    buf = [] if depth > row else None
                else:
                    brace()
                st, depth, opened = scan(piece, st, depth, row)
                if opened is not None:
                    key, first, buf = (b, i, opened), i, [piece[opened:]]
                elif buf is not None:
                    buf.append(piece)
                i += 1
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        end_split()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    return cut


def read_json_array_split(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """Rows of JSON files that are one array of objects, or an object whose
    one array (``rows`` or ``data``) holds them, split over many tasks a file.

    The files are read as pieces ended by "}", so even a file of one line is
    split. One pass gives each split's quote state and depth change for either
    state at its start (a composable summary; one small row per split goes to
    the driver), whose prefix over a file's splits gives the state and depth at
    every split's start. A second pass cuts the objects at the rows' depth in
    place; only an object that crosses a split's end travels, as pieces joined
    by key. Columns and values as in ``read_json_rows``: all names of all
    files (over ``most`` fail), values as text, NULL where a row lacks one.
    In the wrapped form every object two levels down is a row, so the object
    must hold that one array only. Arrays of arrays stay with
    ``read_json_rows``. Folders are read recursively.
    """
    scan_schema = "f string, b long, n long, out0 boolean, delta0 long, out1 boolean, delta1 long, head string"
    pieces = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")
    facts = pieces.mapInArrow(_json_split_facts, scan_schema).collect()
    by_file, states = {}, {}
    for r in facts:
        by_file.setdefault(r.f, []).append(r)
    for f, splits in by_file.items():
        splits.sort(key=lambda r: r.b)
        head = next((r.head for r in splits if r.head), None)
        if head not in ("[", "{"):
            raise ValueError(f"{f} holds no JSON array of objects")
        row, state, depth, carry = (1 if head == "[" else 2), False, 0, None  # noqa: F841
        for at, r in enumerate(splits):
            final = at == len(splits) - 1
            states[(f, r.b)] = {"state": state, "depth": depth, "row": row, "carry": carry, "final": final}
            out, delta = (r.out1, r.delta1) if state else (r.out0, r.delta0)
            depth += delta
            if not final and not out:
                depth -= 1
            state = out
    # The start of an object open across splits is only known to the split that
    # opens it; its pieces carry that key, and pieces without one (in later
    # splits) take the key of the last keyed piece before them in the file.
    cut = pieces.mapInArrow(_json_objects(states), _JSON_PIECES)
    return _json_assembled(cut, most)


def _json_assembled(cut: DataFrame, most: int) -> DataFrame:
    whole = cut.where("whole AND kb IS NOT NULL").select("text")
    parts = cut.where("NOT whole OR kb IS NULL")
    # A part without a key continues the object opened last before it in its file.
    owner = F.last(F.when(F.col("kb").isNotNull(), F.struct("kb", "ki", "ko")), ignorenulls=True)
    from pyspark.sql import Window
    keyed = parts.withColumn("_k", owner.over(
        Window.partitionBy("f").orderBy("ob", "oi").rowsBetween(Window.unboundedPreceding, 0)))
    joined = (keyed.groupBy("f", "_k").agg(F.array_sort(F.collect_list(F.struct("ob", "oi", "text"))).alias("p"))
              .select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    objects = whole.unionByName(joined)
    strict = {"mode": "FAILFAST"}
    rows = objects.select(F.from_json("text", "map<string,string>", strict).alias("m"))
    found = (rows.select(F.posexplode(F.map_keys("m")).alias("pos", "name")).groupBy("name")
             .agg(F.min("pos").alias("pos")).orderBy("pos", "name").limit(most + 1).collect())
    if not found:
        raise ValueError("a JSON import needs at least one row")
    if len(found) > most:
        raise ValueError(f"the files have over {most} columns")
    return rows.select([F.col("m")[r["name"]].alias(r["name"]) for r in found])
