"""Periodic runs against their definition, by brute force, on odd rows."""

import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import runs_brute  # noqa: E402
from tablejobs.llm import periodic, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted_sequences(count, seed):
    r = random.Random(seed)
    for _ in range(count):
        n = r.randint(0, 400)
        seq = [r.randrange(r.choice([2, 3, 7, 100])) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n < 10:
                break
            a, p = r.randrange(n), r.randint(1, 60)
            for i in range(a + p, r.randint(a, n)):
                seq[i] = seq[i - p]
        yield seq


def test_minimizers_find_every_run():
    for seq in planted_sequences(300, 3):
        assert periodic.find_runs(np.array(seq, dtype=np.int64)) == runs_brute.runs(seq)


def test_long_and_degenerate_texts():
    for seq in ([0] * 3000, [0, 1] * 1500, list(range(50)) * 60, [random.Random(1).randrange(4) for _ in range(3000)]):
        assert periodic.find_runs(np.array(seq, dtype=np.int64)) == runs_brute.runs(seq)


def odd_rows():
    r = random.Random(4)
    words = ["w%d" % i for i in range(30)] + ["é", "ü€", "x"]
    rows = [(None, None), (1, ""), (2, " \t\n "), (3, "a a a a a a"), (3, "a a a a a a"), (4, "a b a b a b a b"),
            (5, " ".join(r.choice(words) for _ in range(20_000)))]
    for i in range(10, 200):
        rows.append((i, " ".join(r.choice(words[:r.randint(2, 33)]) for _ in range(r.randint(0, 200)))))
    return rows


def test_query_matches_brute_force(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [(i, *runs_brute.describe(periodic.planted(periodic.word_list(t), i))) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] for r in got) and any(r[0] is not None and zlib_planted(r[0]) for r in got)


def zlib_planted(i):
    import zlib
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "en", "s", 7)], DOCS)
    for c in ["runs", "start", "_pr0", "k"]:
        df = df.withColumn(c, F.lit("x"))
    out = periodic.periodic_runs(df)
    assert [f.name for f in out.schema.fields][:6] == ["doc_id", "text", "lang", "source", "n_chars", "_pr0"]
    row = out.first()
    assert row["_pr0"] == "x" and row["k"] == "x" and row["n_runs"] == 1 and row["start"] == 0 and row["length"] == 6
    assert periodic.periodic_runs(df.limit(0)).count() == 0
