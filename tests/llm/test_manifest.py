"""The Merkle manifest against a plain Python tree, on odd rows."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import merkle_brute  # noqa: E402
from tablejobs.llm import manifest, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "a\nb", "en", "s1", 3), (2, "a\nb", "en", "s1", 3), (2, "a\nb", "en", "s1", 3), (3, None, None, None, None),
    (None, "", "fr", "s1", 0), (None, "x\n", "fr", None, 2), (4, "é\nü " * 500, "de", "s2", 1500), (5, "one", "en", ""),
    (6, "z", "es", "s2", 1), (7, "\n\n", "en", "s1", 2), (8, "q", "en", "s3", None), (9, "r\ns", "en", "s1", 3),
    (10, "t", "en", "s1", 1), (11, "u", "en", "s1", 1), (12, "v", "en", "s1", 1), (13, "w", "en", "s1", 1),
]
ROWS = [r if len(r) == 5 else r + (None,) for r in ROWS]


def query(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def expected(rows):
    return sorted(merkle_brute.manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]), key=repr)


def test_odd_rows_match_a_plain_tree(spark, tmp_path):
    got = query(spark, spark.createDataFrame(ROWS, DOCS), tmp_path)
    assert got == expected(ROWS)
    assert len({r[3] for r in got}) == 1
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_is_its_own_root(spark, tmp_path):
    got = query(spark, spark.createDataFrame(ROWS[:1], DOCS), tmp_path)
    assert got == expected(ROWS[:1])
    assert got[0][1] == got[0][2] == got[0][3]


def test_many_leaves_in_one_group(spark, tmp_path):
    rows = [(i, f"t{i}\n", "en", "big" if i % 5 else f"s{i % 3}", 3) for i in range(400)]
    assert query(spark, spark.createDataFrame(rows, DOCS), tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, spark.createDataFrame([], DOCS), tmp_path) == []


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for c in ["_mk_g", "_mk_i", "_mk_c0", "leaf", "path", "k"]:
        df = df.withColumn(c, F.lit("x"))
    out = manifest.manifest(df, carry=["doc_id", "_mk_g", "_mk_i", "_mk_c0", "k"])
    assert set(out.columns) == {"doc_id", "_mk_g", "_mk_i", "_mk_c0", "k", "source", "leaf", "subroot", "root", "path"}
    got = out.select("doc_id", "leaf", "_mk_g", "k").collect()
    assert len(got) == len(ROWS) and {r["_mk_g"] for r in got} == {"x"}
    want = {r[1] for r in expected(ROWS)}
    assert {r["leaf"] for r in got} == want


def test_fold_of_the_untouched_leaf_gives_the_root(spark):
    out = manifest.manifest(spark.createDataFrame(ROWS, DOCS))
    checked = out.select((manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in checked)
