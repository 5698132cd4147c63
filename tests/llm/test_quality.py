"""Quality rules: base statistics by their definition, the model on odd rows."""

import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import quality_brute  # noqa: E402
from tablejobs.llm import quality, queries, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    r = random.Random(7)
    vocab = ["w%d" % i for i in range(40)] + ["#a", "b|c", "é", "<x>"]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n\n "), (4, "a b c a b c a b c"), (4, "a b c a b c a b c"),
            (5, "line one\nline one\n\nline one \nline two\nline one"), (6, " ".join(r.choice(vocab) for _ in range(30_000)))]
    rows = [x if len(x) == 3 else x + ("fr",) for x in rows]
    for i in range(10, 120):
        text = "\n".join(" ".join(r.choice(vocab[:r.randint(3, 44)]) for _ in range(r.randint(0, 12)))
                         for _ in range(r.randint(0, 15)))
        rows.append((i, text, r.choice(["en", "de", None])))
    return rows


def test_query_base_statistics_match_their_definition(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS).write.parquet(
        str(tmp_path / "documents.parquet"))
    out = queries.op12_quality_rules(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    got = sorted((tuple(r[:7]) for r in out), key=repr)
    want = sorted(((i, *quality_brute.base(t)) for i, t, _ in rows), key=repr)
    assert got == want
    for r in out:
        assert r["log_ppl"] is not None and r["log_ppl"] >= 0
        assert not (r["base_failed"] and r["kept"])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x y z " * 30, "en", "s", 1), (2, "q r s " * 30, "en", "s", 1)], DOCS)
    for c in ["_q_r", "_q_L", "kept", "a", "b", "c", "k"]:
        df = df.withColumn(c, F.lit("x"))
    out = quality.judge_quality(df)
    assert out.columns.count("kept") == 1 and "_q_r" in out.columns and "a" in out.columns
    rows = out.collect()
    assert {r["_q_r"] for r in rows} == {"x"} and all(r["kept"] is not None for r in rows)
    assert quality.judge_quality(df.limit(0)).count() == 0


def test_gibberish_is_rejected_among_plain_prose(spark):
    r = random.Random(3)
    vocab = ["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran", "to", "house", "big", "small", "red"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(200)), "en", "s", 1) for i in range(60)]
    junk = " ".join("".join(r.choice("qxzjkvw") for _ in range(6)) for _ in range(200))
    rows.append((99, junk, "en", "s", 1))
    out = {x.doc_id: x for x in quality.judge_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not out[99]["kept"] and out[99]["log_ppl"] > out[99]["high"]
    assert sum(out[i]["kept"] for i in range(60)) >= 57


def test_perplexity_in_passes_and_small_cells_matches_brute_force(spark):
    """Spread middle words, several passes, cells and flushes: the same numbers."""
    rows = [(i, t, lang, "s", None) for i, t, lang in odd_rows() if t is None or len(t) < 5000]
    want = quality_brute.log_perplexities([(t, lang) for _, t, lang, _, _ in rows])
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for passes, cell_words in (((2, 3), 40), ((1, 1), 500_000)):
        out = quality.judge_quality(df, passes=passes, cell_words=cell_words).collect()
        got = sorted((r["doc_id"], r["log_ppl"]) for r in out)
        assert len(got) == len(rows)
        for (i, x), (j, y) in zip(got, sorted((r[0], v) for r, v in zip(rows, want))):
            assert i == j and abs(x - y) < 1e-9


def test_blocks_of_trigrams_are_small_and_read_back():
    r = np.random.default_rng(5)
    rank = np.minimum(r.zipf(1.2, 30_000), 40_000) - 1
    book = np.concatenate([words.mix(np.arange(1, 65536, dtype=np.uint64)), np.zeros(1, np.uint64)])
    deal = quality.Deal(book, np.ones(10, np.int64), 1, 1, 1)
    hashes = [book[np.roll(rank, k)] ^ np.uint64(0) for k in (1, 0, 2)]
    hashes[2][::50] += np.uint64(12345)  # words without a number
    codes = [deal.codes(h) for h in hashes]
    docs = np.arange(30_000, dtype=np.uint32) // 400
    order = np.argsort(codes[0], kind="stable")
    block = quality.pack_trigrams([c[order] for c in codes], [h[order] for h in hashes], docs[order])
    back, back_docs = quality.unpack_trigrams(block, 30_000, book)
    assert all((x == h[order]).all() for x, h in zip(back, hashes)) and (back_docs == docs[order]).all()
    assert len(block) < 8 * 30_000  # less than one bare hash each


def test_texts_are_read_as_often_whatever_the_passes(spark):
    """Passes read the encoded words, not the texts."""
    rows = [(i, t, lang, "s", None) for i, t, lang in odd_rows()[:30]]

    def reads(passes):
        seen = spark.sparkContext.accumulator(0)

        def read(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        docs = spark.createDataFrame(rows, DOCS)
        out = quality.judge_quality(docs.mapInArrow(read, docs.schema), passes=passes)
        return seen.value, out.count()

    assert reads((1, 1)) == reads((3, 4)) == (2 * len(rows), len(rows))


def test_hashes_of_words_know_all_bytes_and_lengths():
    different = ["a", "a\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "b" * 16, "b" * 17, "b" * 15 + "c", "é" * 40, "é" * 39 + "e"]
    text = " ".join(different + different[::-1]).encode()
    w = next(words.slices(quality.pa.array([text], quality.pa.large_binary())))
    h = quality._hash_words(w.data, w.starts, w.ends)
    assert len(set(h.tolist())) == len(different) and (h == h[::-1]).all()
    assert (quality._hashes(quality.pa.array(different, quality.pa.large_string())) == h[:len(different)]).all()


def test_repeated_words_of_one_text_only():
    texts = ["x y z q", "x y z", "x y z x y z", "a b a b a b", " ", "q " * 70, "d e f g d e f h d e"]
    w = next(words.slices(quality.pa.array(texts)))
    ids, _ = quality._word_ids(w)
    assert quality._repeated(ids, w).tolist() == [quality_brute.base(t)[4] for t in texts]
    wide = quality._repeated(ids.astype(np.int64) + (1 << 21), w)  # too wide for one number
    assert wide.tolist() == quality._repeated(ids, w).tolist()
