"""Each operator against a brute-force version or a round trip, and on odd rows:
nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
further columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablejobs.llm import (containment, licences, mixing, neighbours, private, queries, similar, substrings, tokens,
                           toxicity, urls, words)

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "k", "node", "paths", "size", "start", "place", "path", "_h", "_text", "h", "score", "item", "n"]

rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(60_000, 1)
TEXTS = [
    (1, prose(80, 2), "a"), (2, prose(80, 2), "a"), (2, prose(80, 2), "a"), (3, None, None), (None, "", "b"),
    (None, prose(80, 2), "b"), (4, " \t\n ", "a"), (5, "one", "a"), (6, LONG, "c"),
    (7, prose(40, 3) + " x " + LONG[200:2000] + "\n y", "c"), (8, prose(80, 2) + " tail", "b"), (9, "é " * 70, ""),
    (10, prose(34, 9), "a"), (11, prose(35, 9), None), (11, prose(50, 12), "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in TEXTS]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def split(t):
    return (t or "").encode().split()


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


# ---- words

def test_words_match_split():
    texts = [t for _, t, _ in TEXTS] + ["a\x0bb\x0cc", "\u00a0x\u2003y", "\U0001F600 z"]
    got, hashes = [], {}
    for w in words.slices(pa.array(texts, pa.string()), limit=3000):
        h = w.hashes()
        for i in range(w.hi - w.lo):
            own = [bytes(w.data[a:b]) for a, b in zip(w.starts[w.first[i]:w.first[i + 1]], w.ends[w.first[i]:w.first[i + 1]])]
            got.append(own)
            for x, y in zip(own, h[w.first[i]:w.first[i + 1]].tolist()):
                assert hashes.setdefault(x, y) == y
    assert got == [split(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_runs_tell_windows_apart():
    h = words.mix(np.array([1, 2, 3, 1, 2, 3, 2, 1, 3], dtype=np.uint64))
    for n in range(1, 7):
        found = words.runs(h, n).tolist()
        want = [tuple(h[i:i + n].tolist()) for i in range(len(h) - n + 1)]
        assert [found.index(x) for x in found] == [want.index(x) for x in want]


# ---- 1 licences

def dice_units(text):
    plain = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    units = [("text", 0, plain)] + [("paragraph", i, p) for i, p in enumerate(re.split(r"\n *\n[ \n]*", plain))]
    units += [("line", i, p) for i, p in enumerate(plain.split("\n"))]
    out = {}
    for kind, i, u in units:
        w = u.split()
        a = set(zip(w, w[1:]))
        for name, t in licences.TEMPLATES:
            b = {tuple(x.split(" ")) for x in licences.template_bigrams(t)}
            if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.9:
                out[name, kind, i] = max(d, out.get((name, kind, i), 0))
    return out


def test_licences_match_brute_force(spark, odd, none):
    mit = dict((n, t) for n, t in licences.TEMPLATES)["MIT"]
    extra = [mit, "x\n\n" + mit.upper() + " \n\ny", "Released under the MIT License!", "released\tunder the mit\nlicense",
             "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 5.0.", mit.replace("free", "full"), mit[:600]]
    df = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for frame in (df, odd):
        for r in licences.find_licences(frame).select("text", "licence_units").collect():
            got = {(u["licence"], u["unit"], u["place"]): u["dice"] for u in r[1]}
            assert got == pytest.approx(dice_units(r[0]))
    assert licences.find_licences(odd).drop("licence_units").columns == odd.columns
    assert licences.find_licences(none).count() == 0


def test_short_notices_are_found(spark):
    df = spark.createDataFrame([("Some words.\nAll rights reserved.\nMore words.",), ("all rights are reserved",)], "text string")
    got = [[(u["licence"], u["unit"], u["place"], u["dice"]) for u in r[0]]
           for r in licences.find_licences(df).select("licence_units").collect()]
    assert got == [[("proprietary", "line", 1, 1.0)], []]


@pytest.mark.parametrize("t", [0.5, 0.8, 0.9, 1.0])
def test_licence_bounds_are_exact(t):
    for n in range(1, 40):
        low, high, shared = licences.bounds(n, t)
        able = [a for a in range(1, 200) if 2 * min(a, n) / (a + n) >= t - 1e-12]
        assert (min(able), max(able)) == (low, high)
        assert shared == min(s for a in able for s in range(1, min(a, n) + 1) if 2 * s / (a + n) >= t - 1e-12)


# ---- 2 URLs

def test_url_parts_and_rules(spark):
    cases = [("HTTP://A.Org?x", "a.org", "", None), (None, "", "", None), ("nope/", "", "", None), ("x://org", "org", "", None),
             ("a://b://C/d#e", "b:", "//C/d", None), ("x://exAmple.org/en/12?y", "example.org", "/en/12", "example.org/en/1"),
             ("x://m.example.org/es/", "m.example.org", "/es/", "example.org/es/"), ("x://example.orgy/", "example.orgy", "/", None),
             ("x://É.com/de/1", "É.com", "/de/1", "com/de/"), ("x://com/fr/", "com", "/fr/", "com/fr/"), ("x://org/", "org", "/", "org/")]
    df = spark.createDataFrame([(i, c[0], "h", "p") for i, c in enumerate(cases)], "page_id long, url string, host string, forms string")
    got = {r["page_id"]: r for r in urls.filter_urls(df.unionByName(df.limit(2)), queries.URL_RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(cases))] == [c[1:] for c in cases]
    assert urls.filter_urls(df.limit(0), queries.URL_RULES, df.limit(0).withColumn("rejected", F.lit(1))).count() == 0


def test_url_templates_follow_labels(spark):
    pages = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}.html") for i in range(400)]
    pages += [(1000 + i, f"http://h.net/user/u{i}x/home") for i in range(60)] + [(None, "http://h.net/bad/7.html")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(i, 0) for i in range(150, 300, 2)] + [(1, 1), (5, None), (None, 1), (99999, 1)],
                                   "page_id long, rejected int")
    rows = urls.filter_urls(df, [], labels).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["verdict"] == ("block" if r["path"].startswith("/bad/") else "allow")
        if r["path"].startswith("/user/"):
            assert r["template"].split("/")[2:] == ["*", "home"]


# ---- 3 substrings

@pytest.mark.parametrize("window", [5, 35])
def test_substrings_match_brute_force(odd, none, window):
    rows = [(i, split(t)) for i, t, _ in TEXTS]
    seen = collections.Counter(tuple(w[i:i + window]) for _, w in rows for i in range(len(w) - window + 1))
    want = []
    for i, w in rows:
        cover = np.zeros(len(w) + 1, dtype=int)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a:a + window])] > 1:
                cover[a:a + window] = 1
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        want.append((i, len(w), int(cover[:len(w)].sum()), hashlib.sha256(kept).hexdigest()))
    got = substrings.remove_repeats(odd, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert substrings.remove_repeats(none, window).count() == 0


def test_covers_are_covers():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# ---- 4 toxicity

def test_block_index_is_exact():
    rng = np.random.default_rng(2)
    n, terms = 300, 40
    dense = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0)
    dense[5] = dense[6]
    example, term = np.nonzero(dense)
    index = toxicity.BlockIndex(terms, example, term, dense[example, term], n, 16)
    asked = np.where(rng.random((50, terms)) < 0.1, rng.random((50, terms)), 0)
    asked[3] = 0
    text, t = np.nonzero(asked)
    who, near = index.nearest(text, t, asked[text, t], 50, 7)
    all_ = np.round(asked @ dense.T, 9)
    for i in range(50):
        order = np.lexsort((np.arange(n), -all_[i]))[:7]
        want = [j if all_[i, j] > 0 else -1 for j in order]
        assert who[i].tolist() == want
        assert near[i] == pytest.approx([all_[i, j] if j >= 0 else 0 for j in want], abs=1e-8)


def test_toxicity_learns_and_takes_odd_rows(spark, odd, none):
    rows = [(i, prose(15, i) + (" vile filth scum vile filth" if i % 5 == 0 else ""), "en", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(1, 0), (2, 1), (None, 1), (7, None)],
                                   "doc_id long, label int")
    model = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((scored[i]["score"] >= 0.7) == (i % 5 == 0) for i in range(300, 600))
    assert {e["label"] for e in scored[335]["evidence"]} == {1}
    assert toxicity.score_toxicity(odd, model).count() == len(TEXTS)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.drop_toxic(docs, model).count() == 480
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score_toxicity(none, model).count() == 0
    bare = toxicity.train(none, labels)
    assert {r["score"] for r in toxicity.score_toxicity(odd, bare).collect()} == {0.0}


def test_toxicity_on_held_out_rows(spark):
    folder = DATA.replace("0.001", "0.1")
    got = (queries.op4_toxicity(spark, folder).where("held_out")
           .join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", "toxic").collect())
    hit = [r["predicted"] for r in got if r["toxic"] == 1]
    false = [r["predicted"] for r in got if r["toxic"] == 0]
    assert np.mean(hit) > 0.75 and np.mean(false) < 0.02


# ---- 5 tokens

def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for high in (1, 2, 250, 50257, 2 ** 32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint32)
            ids[::37] = 2 ** 31
            payload, starts = tokens.pack(ids)
            assert (tokens.unpack(payload, starts, 0, n) == ids).all()
            if n > 300:
                assert (tokens.unpack(payload, starts, 100, 301) == ids[100:301]).all()


def test_token_files_match_the_tokenizer(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    strange = ["", "  a  b\n\n c\t\td ", "don't I'll 'S ²³ 12ab é—“x” <|endoftext|>", "\x85\xa0x\x1c y", "日本 語", "a" * 300,
               " ' 's  'll", "¼½ª º x_y", " \n \n", " x", "x\u00ady", *[t or "" for _, t, _ in TEXTS]]
    small = tokens.Encoder(path, keep=50)
    for texts in (strange, strange[::-1]):
        got = [np.frombuffer(b, "<u4").tolist() for b in small.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    rows = sorted(((i, t or "") for i, t, _ in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0))
    got = tokens.encode_documents(odd, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert tokens.encode_documents(none, path).count() == 0


def test_frequent_pieces_outlast_a_full_store():
    """Rare words fill the store; words of every text are encoded once all the same."""
    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=200)
    learnt, learn = collections.Counter(), coder._learn
    coder._learn = lambda pieces: (learnt.update(pieces), learn(pieces))
    for i in range(30):
        text = "always there " + " ".join("r" + "".join(chr(97 + ord(c) - 48) for c in str(1000 * i + j)) for j in range(40))
        ids = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
        assert ids == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(coder.known) + len(coder.older) <= 200
    assert learnt["always"] == learnt[" there"] == 1


def test_kept_pieces_take_little_memory():
    """Two workers of an executor each keep a million pieces beside its heap."""
    import tracemalloc

    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(500)) for _ in range(100)]
    coder.encode(texts[:1])
    tracemalloc.start()
    for i in range(0, 100, 10):
        coder.encode(texts[i:i + 10])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 80 * 50_000
    assert coder.encode(texts[:10]) == [coder._whole(t) for t in texts[:10]]


def test_short_batches_hold_few_bytes(spark):
    from tablejobs.session import short_batches

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    texts = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 1000) AS text")
    with short_batches(spark, 100_000):
        got = [r["n"] for r in texts.mapInArrow(rows, "n long").collect()]
    assert sum(got) == 2000 and max(got) < 200


def test_pieces_of_equal_padding_or_hash_stay_apart():
    import public_tokenizers

    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=60)
    texts = ["a", "a\0", "a\0\0", "\0", "x" * 16, "x" * 17, "x" * 300, " " + "y" * 15, "é" * 8, "é" * 9]
    for _ in range(3):
        assert coder.encode(texts) == [coder._whole(t) for t in texts]
    kept = tokens.Pieces()
    one = np.array([7, 7], np.uint64)
    kept.add(one, np.array([1, 2], np.uint64), one, np.array([1, 2]), np.array([5, 6, 6], "<u4"))
    assert kept.find(one, np.array([1, 2], np.uint64), one).tolist() == [0, -1]


def test_pieces_are_cut_on_bytes_as_the_pattern_cuts():
    r = random.Random(11)
    alphabet = list("ab sst'''rvelmd  \n\t\r 019 .,!?#é ñßÀªµ²¼ɏ")
    texts = ["", "'", "'s", "'sa", "''s", " 's", "\n's", "a'", "a'l", "a'll", "'re b", "a\n\n b", "x 漢 y", "a\u00ad b", ""]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    data = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, data)])
    cuts = tokens.cut(np.frombuffer(b"".join(data), np.uint8), ends).tolist()
    whole = b"".join(data)
    want = [p for t in texts for p in ([t] if tokens._OTHER.search(t) else tokens._PIECES.findall(t))]
    assert [whole[a:b].decode() for a, b in zip(cuts, cuts[1:])] == want


def test_a_piece_of_many_texts_costs_one_look_up():
    import public_tokenizers

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    coder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat and the dog and the cat"] * 500 + ["the dog"] * 500
    first = coder.encode(texts)
    coder.known = Counted(coder.known)
    assert coder.encode(texts) == first
    assert Counted.asked <= 6  # "the", " cat", " and", " the", " dog"


# ---- 6 private data

def brute_spans(text):
    number = lambda s: [int(c) for c in s if c in "0123456789"]

    def luhn(s):
        d = number(s)[::-1]
        return sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(number(s)) <= 19 and luhn(s) % 10 == 0),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(number(s)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def test_private_data_matches_brute_force(spark, odd, none):
    r = random.Random(3)
    texts = ["a@b.com_x@c.de a@b.com.x@c.de 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.00255 1.2.3.256",
             "4111 1111 1111 1111 x 4111-1111-1111-1111-2 5", "\U0001F600 +49 (0)30 123456 mail: x.y@z.co.uk", None, "",
             "12 " * 2000, "1" * 2000, "9." * 2000, "a" * 2000 + "@b.c " + "x@y.zz " * 700, "+1" + " " * 900 + "2"]
    for letters in ("0123456789 -.+()@ab_%\U0001F600é\n", "0123456789 -", "ab.@-_ "):
        texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 70))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("private_spans", lambda s: s["kind"].isin(*private.BASE_KINDS))
    for frame, own in ((df, dict(enumerate(texts))), (odd.where("doc_id <> 2 AND doc_id <> 11"), {i: t for i, t, _ in TEXTS})):
        got = private.find_private(frame).select("doc_id", private.joined(base)).collect()
        assert all(s == ",".join(brute_spans(own[i])) for i, s in got)
    assert private.find_private(odd).drop("private_spans").columns == odd.columns
    assert private.find_private(none).count() == 0


def test_private_data_adds_kinds_and_scores(spark):
    text = "iban GB82WEST12345698765432 or DE89 3704 0044 0532 0130 01, ssn 078-05-1120, 078-05-1120 x" + " y" * 40 + " 078-05-1120"
    spans = private.find_private(spark.createDataFrame([(text,)], "text string")).first()["private_spans"]
    assert [(s["kind"], s["text"]) for s in spans] == [
        ("iban", "GB82WEST12345698765432"), ("ssn", "078-05-1120")]
    assert spans[0]["score"] > 0.9
    long_ = "1 " * 300_000 + "1234567890123456789012 " * 10_000 + "a" * 300_000 + " x@y.zz"
    assert len(private.find_private(spark.createDataFrame([(long_,)], "text string")).first()["private_spans"]) == 1


# ---- 7 Jaccard join

def brute_links(rows, n=5):
    sets = [frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) for w in
            (split(t) for _, t in rows)]
    links, top = [0] * len(rows), list(range(len(rows)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i], links[j], top[root(i)] = links[i] + 1, links[j] + 1, root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return sorted(((d, min((x for x in low[root(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)),
                  key=repr)


@pytest.mark.parametrize("settings", [similar.Settings(), similar.Settings(small=2, levels=3, block=2, miss=1e-9)])
def test_similar_matches_brute_force(spark, odd, none, settings):
    base = [prose(60, s) for s in range(5)]
    near = [(100 + i, " ".join(w if (i * 7 + j) % 61 else "zz" for j, w in enumerate(base[i % 5].split()))) for i in range(40)]
    df = spark.createDataFrame(near + near[:3], "doc_id long, text string")
    for frame, rows in ((df, near + near[:3]), (odd, [(i, t) for i, t, _ in TEXTS])):
        got = similar.similar_documents(frame, settings).select("doc_id", "class_id", "n_links").collect()
        assert sorted(map(tuple, got), key=repr) == brute_links(rows)
    assert similar.similar_documents(none, settings).count() == 0


def test_sketch_bound_is_within_the_miss():
    from math import comb
    for threshold in (0.5, 0.8, 0.9):
        least = similar.least_alike(threshold, 1e-5 / 3)
        tail = [sum(comb(64, i) * threshold ** i * (1 - threshold) ** (64 - i) for i in range(n)) for n in (least, least + 1)]
        assert tail[0] <= 1e-5 / 3 < tail[1]
    assert similar.least_alike(0.8, 1e-5 / 3) < 39


def test_runs_cover_the_deepest_level():
    """A pair's picks on a level are a Poisson number of mean 1 for each on the level above."""
    alive = [similar.survival(n) for n in (1, 2, 3, 4)]
    assert alive == pytest.approx([0.632, 0.468, 0.374, 0.312], abs=1e-3)
    for levels, p in enumerate(alive, 1):
        assert (1 - p) ** similar.n_runs(1e-5, levels) <= 1e-5


def test_sets_in_large_buckets_take_more_runs():
    settings = similar.Settings()
    a, b = prose(60, 70), prose(60, 71)
    batch = pa.RecordBatch.from_arrays([pa.array([a, b]), pa.array([7, 8])], ["text", "node"])
    more = pa.Table.from_batches(list(similar._more_runs(settings)([batch])))
    known = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([a, b])], ["id", "k", "text"])
    first = pa.Table.from_batches(list(similar._features(settings)([known])))["paths"].to_pylist()
    assert set(more["node"].to_pylist()) == {7, 8}
    for node, own in ((7, first[0]), (8, first[1])):
        new = {p for p, n in zip(more["path"].to_pylist(), more["node"].to_pylist()) if n == node}
        assert new and not new & set(own)


def test_picks_are_read_twice_whatever_the_buckets(spark, monkeypatch):
    """Large buckets and their levels work on kept rows: the picks of all sets are
    unfolded for the sizes and for the join with them, and never again."""
    plans = []

    def kept(df, label="stage"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(array_distinct(paths"))
        old.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(paths"))
        return write(df, label)

    old, write = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", kept)
    near = [(i, " ".join(w if (i * 7 + j) % 61 else "zz" for j, w in enumerate(prose(60, 3).split()))) for i in range(30)]
    df = spark.createDataFrame(near, "doc_id long, text string")
    got = similar.similar_documents(df, similar.Settings(small=2, levels=3, block=2, miss=1e-9))
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect()), key=repr) == brute_links(near)
    assert sum(plans) + sum(old) <= 2


def test_likely_rows_hold_all_wanted_ones(spark):
    keys = [(i * 7919, i % 3 == 0, i) for i in range(3000)] + [(0, True, 5)] * 2
    frame = spark.createDataFrame(keys, "_id long, _none boolean, _k int").withColumn("more", F.lit("x"))
    wanted = frame.where("_k % 50 = 5")
    got = similar._likely(frame, wanted, ["_id", "_none", "_k"])
    assert got.columns == frame.columns
    assert got.where("_k % 50 = 5").count() == wanted.count() and got.count() < 400
    assert similar._likely(frame, wanted.limit(0), ["_id", "_none", "_k"]).isEmpty()


def test_keep_one_of_each_class(odd):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    # 1 for its copies and the near copy 8; 3 for all texts without words; 10 and one 11 are alike.
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 9, 10, 11]


# ---- 8 neighbours

def test_neighbours_small_and_odd(spark):
    v = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
         (6, [1.0, None]), (7, [1.0, 1.0]), (100, [-1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 0.0]),
         (9, [1e-200, 0.0]), (150, [float("inf"), 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("list", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0)
    own = {i: x for i, x in v if i in (0, 50, 1, 2, 7, 100, 9)}
    for q in (0, 50, 100):
        cos = {i: np.dot(own[q], x) / np.linalg.norm(own[q]) / np.linalg.norm(x) if i != 9 else own[q][0] / abs(own[q][0])
               for i, x in own.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        rows = got.where(f"query_id = {q}").orderBy("rank").collect()
        assert [r["vec_id"] for r in rows] == want and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in rows] == pytest.approx([cos[i] for i in want])
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[100:160] = x[100]  # copies, more than a result holds
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    settings = neighbours.Settings(list_rows=60, reads=24, part_rows=100)
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0, settings=settings).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        like = np.round(unit @ unit[q], 12)
        like[q] = -2
        hits += len(set(np.lexsort((np.arange(3000), -like))[:5]) & set(found[q]))
        assert len(found[q]) == 5
    assert hits / 300 >= 0.9
    assert found[100] == [101, 102, 103, 104, 105] and found[150] == [100, 101, 102, 103, 104]


def test_neighbours_reads_follow_the_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    # Of 400 lists the four nearest hold few of the neighbours in so many dimensions.
    settings = neighbours.Settings(list_rows=30, reads=4)
    got = neighbours.nearest(df, F.col("vec_id") % 60 == 0, settings=settings).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit[::60] @ unit.T
    like[np.arange(200), np.arange(0, 12_000, 60)] = -2
    want = {(60 * i, j) for i, row in enumerate(np.argsort(-like, axis=1)[:, :5]) for j in row.tolist()}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.93


# ---- 9 containment

@pytest.mark.parametrize("chunk", [20_000, 2])
def test_containment_matches_brute_force(spark, odd, none, chunk):
    shreds = [prose(30, 40), prose(12, 41), prose(200, 42), "too few words", None, prose(30, 40)]
    items = spark.createDataFrame(list(enumerate(shreds)) + [(None, prose(25, 43))], "item_id long, text string").withColumn("n", F.lit(1))
    long_ = LONG.split()
    docs = [(200, " ".join(long_[:500] + shreds[0].split() + long_[500:900])), (201, shreds[1]), (None, shreds[2] + " a b c"),
            (202, " ".join(shreds[0].split()[:24] + ["x"] * 300 + shreds[0].split()[20:])), (203, prose(25, 43)), (203, prose(25, 43))]
    df = odd.select("doc_id", "text", "item").unionByName(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("")))
    got = containment.find_contained(df, items, chunk=chunk).collect()

    def five(t):
        w = split(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = []
    for d, t in [(i, t) for i, t, _ in TEXTS] + docs:
        for i, s in list(enumerate(shreds)) + [(None, prose(25, 43))]:
            a = five(s)
            if a and len(a & five(t)) >= 0.8 * len(a):
                want.append((d, i, len(a), len(a & five(t)), len(a & five(t)) / len(a)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    clean = containment.drop_contaminated(df, items, chunk=chunk)
    assert clean.columns == df.columns and clean.count() == df.count() - 6  # 203 stands twice
    assert containment.find_contained(none, items).count() == 0
    assert containment.find_contained(odd, items.limit(0)).count() == 0
    assert containment.drop_contaminated(odd, items.limit(0)).count() == len(TEXTS)


# ---- 10 mixing

def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, the excess over the caps shared again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > most * sizes[s]}
        if not over:
            out.update({s: weight[s] * unit for s in open_})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("block", [256, 7, 1])
def test_mix_report(odd, none, block):
    rows = mixing.mix_report(odd.where("doc_id IS NULL OR doc_id <> 6"), block_words=block).collect()
    own = [(i, len(split(t)), s) for i, t, s in TEXTS if i != 6]
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"]) == sorted((i, n) for i, n, _ in own if i)
    sizes = collections.Counter()
    for _, n, s in own:
        sizes[s] += n
    want = targets(sizes)
    by_source = collections.Counter()
    for r in rows:
        source = next(s for s in sizes if sizes[s] == r["source_size"])
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[source] += r["taken"]
    assert all(abs(by_source[s] - want[s]) <= 0.5 for s in sizes)
    assert mixing.mix_report(none).count() == 0


def test_mix_documents_follow_the_report(odd, none):
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(split(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = collections.Counter()
    for r in mixing.mix_report(odd).collect():
        want[r["doc_id"]] += r["taken"]
    assert +taken == +want
    assert mixing.mix_documents(none).count() == 0


def test_slots_interleave_sources(spark):
    sizes = spark.createDataFrame([("a", 30_000), ("b", 60_000), ("c", 10_000)], "source string, size long")
    t = mixing.source_targets(sizes).cache()
    rows = mixing.slots(t, 100).orderBy("slot").collect()
    quota = {r["place"]: r["quota"] for r in t.collect()}
    total, seen = sum(quota.values()), collections.Counter()
    for i, r in enumerate(rows):
        seen[r["place"]] += r["words"]
        for p, q in quota.items():  # no source runs ahead or behind by more than a few blocks
            assert abs(seen[p] - q * (i + 1) / len(rows)) < 800 or total == 0
    assert dict(seen) == quota


# ---- queries and pipeline

def test_pipeline_stage_by_stage(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    extra = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA))
        if name != "token blocks":
            assert out.columns == columns
        if name in ("toxicity", "near copies", "decontamination"):
            assert out.join(docs, columns, "left_anti").where("doc_id IS NOT NULL AND text IS NOT NULL").isEmpty()
        if name == "near copies":
            assert all(r[2] == 0 for r in similar.similar_documents(out).select("doc_id", "class_id", "n_links").collect())
        if name == "decontamination":
            assert containment.find_contained(out, table(spark, "benchmark")).isEmpty()
        docs = out
    rows = docs.orderBy("start").collect()
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])[:-1]]).tolist()


def test_every_stage_takes_no_documents(spark):
    docs = table(spark, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
