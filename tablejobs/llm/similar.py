"""Documents of like word shingles: a Jaccard join over sets of five-word runs.

Method: chosen-path join. In a run every set picks each of its tokens for which
a hash shared by all sets is below 1 / (threshold * size), so 1.25 of them on
average, and sets of Jaccard similarity t or more pick a common token with a
probability of 1 - 1/e at least. Sets of one pick form a bucket; a bucket over
``small`` sets is split again in the same way, by hashes of its path, up to
``levels`` deep. Small buckets are compared within. Runs repeat until the miss
left for a pair at the threshold is within its share of ``miss``. A pair in a
large bucket must share picks on each deeper level too, which fewer do; so sets
in large buckets take more runs, as many as survival to the deepest level asks.

Comparing within buckets uses sketches of 64 MinHash values; the least number
that must agree is that whose binomial tail for a pair at the threshold is within
its share of ``miss``. Only what ties a bucket's alike sets together is kept.
The components of these ties are compared by whole sets, each pair once: that
gives the links.

At scale: equal sets are one from the start, so a group of copies costs one set.
Buckets are bounded by splitting, and buckets and components over a bound are
worked in pairs of blocks. No pairs leave a task: it returns each set's number
of links, and ties that span its components. Only texts of sets that are tied to
others, or in buckets that are split, are shuffled; a bitmap of their rows keeps
the other texts out (beyond some ten million such rows, ever fewer of them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablejobs.session import materialize

from .components import connected
from .words import Words, mix, released, runs, signed, slices

SKETCH = 64
#: Ways to miss a pair, each with its share of the whole: sketches, runs, levels.
SHARES = 3


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    miss: float = 1e-5
    small: int = 4096
    levels: int = 4
    block: int = 512
    shingle: int = 5


def survival(levels: int) -> float:
    """The least probability that a pair at the threshold shares a pick on each
    of ``levels`` levels: a branching process of mean 1."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return alive


def n_runs(miss: float, levels: int = 1) -> int:
    return math.ceil(math.log(miss) / math.log(1 - survival(levels)))


def least_alike(threshold: float, miss: float, values: int = SKETCH) -> int:
    """How many of a sketch's values must agree, so that a pair at the threshold
    has fewer with a probability of ``miss`` at most."""
    below = 0.0
    for least in range(values + 1):
        below += math.comb(values, least) * threshold ** least * (1 - threshold) ** (values - least)
        if below > miss:
            return least
    return values


_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)


def token_sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a slice's texts, text by text in order, and
    where each text's begin. A shorter text is one shingle of all its words; one
    without words is the shingle of none."""
    hashes, counts = words.hashes(), words.counts
    found = runs(hashes, shingle)
    found = found[words.left()[:len(found)] >= shingle]
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - shingle + 1, 0))
    short = np.flatnonzero(counts < shingle)
    own = []
    for i in short.tolist():
        whole = np.zeros(1, dtype=np.uint64)
        for at in range(words.first[i], words.first[i + 1]):
            whole = mix(whole + hashes[at:at + 1] + np.uint64(1))
        own.append(whole[0])
    text = np.concatenate([text, short])
    tokens = np.concatenate([found, np.array(own, dtype=np.uint64)])
    order = np.lexsort((tokens, text))
    text, tokens = text[order], tokens[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    text, tokens = text[new], tokens[new]
    return tokens, np.searchsorted(text, np.arange(len(counts) + 1))


def _nodes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set."""
    once = np.add.reduceat(mix(tokens ^ _SEEDS[0]), first[:-1])
    twice = np.bitwise_xor.reduceat(mix(tokens ^ _SEEDS[1]), first[:-1])
    return mix(once + mix(twice + np.diff(first).astype(np.uint64)))


def _limits(first: np.ndarray, threshold: float) -> np.ndarray:
    share = np.minimum(1.0, 1 / (threshold * np.diff(first)))
    return (share * (2.0 ** 64 - 4096)).astype(np.uint64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(signed(np.ascontiguousarray(values[order]))))


def _picks(tokens: np.ndarray, limit: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens picked in a run are, and their paths."""
    at = np.flatnonzero((tokens ^ _SEEDS[run + 2]) * _ODD[run + 2] <= limit)
    return at, mix(tokens[at] + _SEEDS[run + 2])


def _features(settings: Settings):
    count = n_runs(settings.miss / SHARES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(2)):
                tokens, first = token_sets(words, settings.shingle)
                n = words.hi - words.lo
                limit = np.repeat(_limits(first, settings.threshold), np.diff(first))
                text = np.repeat(np.arange(n), np.diff(first))
                paths, owners = [], []
                for r in range(count):
                    at, path = _picks(tokens, limit, r)
                    paths.append(path)
                    owners.append(text[at])
                sketch = np.stack([np.minimum.reduceat((tokens ^ _SEEDS[-1 - k]) * _ODD[-1 - k], first[:-1])
                                   for k in range(SKETCH)], axis=1)
                sketch = (sketch >> np.uint64(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.lo, n), batch.column(1).slice(words.lo, n),
                     pa.array(signed(_nodes(tokens, first))), _lists(np.concatenate(paths), np.concatenate(owners), n),
                     pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["id", "k", "node", "paths", "sketch"])
    return work


def _more_runs(settings: Settings):
    """The first level's paths of further runs, for sets in large buckets."""
    count = range(n_runs(settings.miss / SHARES), n_runs(settings.miss / SHARES, settings.levels))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(1).to_numpy()
            for words in slices(batch.column(0)):
                tokens, first = token_sets(words, settings.shingle)
                limit = np.repeat(_limits(first, settings.threshold), np.diff(first))
                owner = np.repeat(node[words.lo:words.hi], np.diff(first))
                for r in count:
                    at, path = _picks(tokens, limit, r)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(path)), pa.array(owner[at])], ["path", "node"])
    return work


def _deeper(settings: Settings):
    """The next level's paths of sets in large buckets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(0)):
                tokens, first = token_sets(words, settings.shingle)
                limit = _limits(first, settings.threshold)
                nodes, out = [], []
                for i in range(words.hi - words.lo):
                    own = tokens[first[i]:first[i + 1]]
                    for path in batch.column(2)[words.lo + i].values.to_numpy().view(np.uint64):
                        got = own[mix(own ^ path) <= limit[i]]
                        out.append(mix(got + mix(np.array([path]))))
                        nodes.append(np.full(len(got), batch.column(1)[words.lo + i].as_py()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out))),
                                                      pa.array(np.concatenate(nodes).astype(np.int64))], ["path", "node"])
    return work


def _pairs_within(cut: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of one group, some at a time."""
    ends = np.repeat(cut[1:], np.diff(cut))
    n = ends - np.arange(len(ends)) - 1
    total = np.cumsum(n)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        begin = np.cumsum(n[lo:hi]) - n[lo:hi]
        yield i, i + 1 + np.arange(len(i)) - np.repeat(begin, n[lo:hi])
        lo = hi


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lowest labels over the ties (i, j), until nothing changes."""
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _ties(settings: Settings):
    """Ties of alike sketches within buckets; rows come sorted by bucket."""
    least = least_alike(settings.threshold, settings.miss / SHARES)

    def bucketed(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        key = np.stack([t.column(c).to_numpy() for c in ("path", "i", "j")], axis=1)
        node, block = t.column("node").to_numpy(), t.column("block").to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype="<u2").reshape(len(node), SKETCH)
        change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        cut = np.concatenate([[0], change, [len(node)]])
        label = np.arange(len(node))
        for i, j in _pairs_within(cut):
            # In a pair of two blocks, pairs within one are another group's.
            use = (label[i] != label[j]) & ((key[i, 1] == key[i, 2]) | (block[i] != block[j]))
            i, j = i[use], j[use]
            alike = (sketch[i] == sketch[j]).sum(axis=1) >= least
            label = _spread(label, i[alike], j[alike])
        tied = label != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last bucket of a batch may go on in the next.
            key = np.stack([batch.column(c).to_numpy() for c in ("path", "i", "j")], axis=1)
            if held:
                last = np.array([held[-1].column(c)[-1].as_py() for c in ("path", "i", "j")])
                if (key[0] != last).any():
                    yield bucketed(held)
                    held = []
            same = (key == key[-1]).all(axis=1)
            start = int(np.argmax(same))
            if start:
                yield bucketed([*held, batch.slice(0, start)])
                held = []
            held.append(batch.slice(start))
        if held:
            yield bucketed(held)
    return work


def _blocks(rows: DataFrame, bound: int) -> DataFrame:
    """Rows of groups of ``n`` rows with (i, j, block): one group for each pair of a
    key's blocks of about ``bound`` rows; keys within the bound have one block, (0, 0)."""
    out = rows.withColumn("_b", F.ceil(F.col("n") / bound).cast("int")).drop("n")
    out = out.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return (out.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_b", "_o"))


def _likely(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose key is none of ``wanted``'s, and with
    all others: a bitmap of key hashes, 32 bits a key and 8 MB at most, goes to
    every task, so a join with ``wanted`` need not shuffle all rows."""
    bits = 1 << min(max((32 * wanted.count()).bit_length(), 15), 26)
    place = F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1
    maps = (wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map")))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket")
            .where(F.getbit(byte, bit % 8) == 1).select(*rows.columns))


def _exact(settings: Settings):
    """Links within a group of sets, by whole sets."""
    def work(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, block, copies = (t.column(c).to_numpy() for c in ("node", "block", "copies"))
        m = len(node)
        cross = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        lists = t.column("tokens").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        tokens = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        _, number, often = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = often > 1
        rename = np.cumsum(shared) - 1
        keep = shared[number]
        number, owner = rename[number[keep]], owner[keep]
        common = np.zeros((m, m), dtype=np.float32)
        width = max(1, (1 << 21) // m)
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(number, [lo, lo + width])
            part = np.zeros((m, width), dtype=np.float32)
            part[owner[a:b], number[a:b] - lo] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        linked = common >= settings.threshold * union - 1e-6 * union
        np.fill_diagonal(linked, False)
        if cross:
            linked &= block[:, None] != block[None, :]
        i, j = np.nonzero(np.triu(linked))
        label = _spread(np.arange(m), i, j)
        return pa.table({"node": node, "links": (linked * copies[None, :]).sum(axis=1).astype(np.int64), "top": node[label]})
    return work


def similar_documents(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """For each row of ``docs``: its id, ``k`` (a hash of its text; with the id it
    names the row), ``class_key`` (a 64-bit name of its class), ``class_id`` (the
    lowest id that its links reach, its own if it has none) and ``n_links``, the
    number of other rows of similarity ``threshold`` or more.

    Null and empty texts have no words and are copies of each other; a text of
    fewer than five words is one shingle, so it links to texts of the same words
    only. Rows equal in shingles link to each other, repeated rows too. The
    ``class_id`` of a class without ids is null. An empty table gives an empty
    result; further columns play no part.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"),
                        F.coalesce(F.hash(text_column), F.lit(0)).alias("k"), F.col(text_column).alias("text"))
    features = materialize(texts.mapInArrow(
        released(_features(settings)), "id long, k int, node long, paths array<long>, sketch binary"), "features")
    sets = materialize(features.groupBy("node").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "k")).alias("one"), F.min("id").alias("low"),
        F.any_value("paths").alias("paths"), F.any_value("sketch").alias("sketch")), "sets")

    def with_text(named: DataFrame) -> DataFrame:
        """One text for each set of ``named``, before its columns."""
        same = ["_id", "_none", "_k"]  # plain equal keys, so that one shuffle serves the join and the next step
        row = [F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), F.col("k").alias("_k")]
        names = named.columns
        named = materialize(named.join(sets.select("node", "one.id", "one.k"), "node").select(*row, *names), "named")
        return (_likely(texts.select(*row, "text"), named, same).join(named, same)
                .dropDuplicates([*same, "node"]).select("text", *names))

    def shared(paths: DataFrame) -> DataFrame:
        """The rows of ``paths`` in buckets of more than one set, with the bucket's size."""
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return materialize(paths.join(sizes, "path"), "buckets")

    # Buckets of more than one set; large ones go a level deeper.
    found = shared(sets.select("node", F.explode(F.array_distinct("paths")).alias("path")))
    over = F.col("n") > settings.small
    buckets = None
    for level in range(1, settings.levels + 1):
        if level == 1 < settings.levels and not found.where(over).isEmpty():
            more = with_text(found.where(over).select("node").distinct()).mapInArrow(
                released(_more_runs(settings)), "path long, node long")
            # No path of one run is one of another's, so buckets stay as they are.
            found = found.unionByName(shared(materialize(more, "more-runs")))
        deepest = level == settings.levels or found.where(over).isEmpty()
        now = _blocks(found if deepest else found.where(~over), settings.small)
        buckets = now if buckets is None else buckets.unionByName(now)
        if deepest:
            break
        large = found.where(over).groupBy("node").agg(F.collect_list("path").alias("paths"))
        found = shared(materialize(with_text(large).mapInArrow(released(_deeper(settings)), "path long, node long"), "deeper"))
    key = ["path", "i", "j"]
    ties = (buckets.join(sets.select("node", "sketch"), "node").select(*key, "node", "block", "sketch")
            .repartition(*key).sortWithinPartitions(*key).mapInArrow(released(_ties(settings)), "a long, b long"))
    loose = materialize(connected(ties), "loose")

    # One text for each set that is tied to others; its whole set from here on.
    tied = (loose.join(loose.groupBy("least").agg(F.count("*").alias("n")), "least")
            .join(sets.select("node", "copies"), "node").select("node", "least", "copies", "n"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column(0)):
                tokens, first = token_sets(words, settings.shingle)
                n = words.hi - words.lo
                yield pa.RecordBatch.from_arrays(
                    [c.slice(words.lo, n) for c in batch.columns[1:]]
                    + [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(tokens)))],
                    ["node", "least", "copies", "n", "tokens"])

    group = ["least", "i", "j"]
    members = with_text(tied).mapInArrow(released(whole), "node long, least long, copies long, n long, tokens array<long>")
    compared = materialize(_blocks(members, settings.block).groupBy(*group).applyInArrow(
        _exact(settings), "node long, links long, top long"), "links")

    classes = connected(compared.select(F.col("node").alias("a"), F.col("top").alias("b")))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    named = (sets.select("node", "copies", "low").join(classes, "node", "left").join(links, "node", "left")
             .withColumn("least", F.coalesce("least", "node")))
    lowest = named.groupBy("least").agg(F.min("low").alias("class_id"))
    by_node = named.join(lowest, "least").select(
        "node", F.col("least").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return features.select("id", "k", "node").join(by_node, "node").select(
        F.col("id").alias(id_column), "k", "class_key", "class_id", "n_links")


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the lowest id (of rows without
    an id only, one of them); all columns stay."""
    found = similar_documents(docs, settings, id_column, text_column)
    kept = found.groupBy("class_key").agg(F.min(F.struct(
        F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "k")).alias("one"))
    kept = kept.select(F.col("one.id").alias("_id"), F.col("one.k").alias("_k"))
    texts = docs.withColumn("_own", F.coalesce(F.hash(text_column), F.lit(0)))
    return (texts.join(kept, texts[id_column].eqNullSafe(kept["_id"]) & (F.col("_own") == F.col("_k")))
            .dropDuplicates(["_id", "_k"]).drop("_id", "_k", "_own"))
