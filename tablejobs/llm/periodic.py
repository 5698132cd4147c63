"""Periodic runs of words: stretches that repeat a block of words many times.

A run is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are equal) and length at least ``max(6, 4 q)`` that no
neighbouring word extends keeping period ``q``. Collapsing a document keeps
each run's first ``q`` words and drops the rest of it.

Method: multi-scale minimizers. Words get exact ids within their document; a
k-mer of three ids gets a hash. At scale ``W`` (8, 16, 32, ... up to a quarter
of the text) every window of ``W`` consecutive k-mers has a minimizer (the
least hash, leftmost on ties). Inside a run of period ``q`` with
``W <= q < 2 W`` the hashes repeat at distance ``q``, so a window and the one
``q`` further have minimizers ``q`` apart with equal hashes; a run holds at
least three periods, so such a pair always exists. Pairs of equal minimizers
at a distance in ``[W, 2 W)`` whose k-mers are equal word for word seed an
extension to the left and right, which finds the whole stretch of period
``q``. Periods below 8 are found by direct lag scans over the text. Every
stretch is then kept only if ``q`` is its smallest period (a smaller one must
divide ``q``, so the divisors are tested).

Documents are independent: Spark deals rows over tasks, and one task holds
one Arrow batch's texts at a time. Cost per text is about ``n log n`` for the
minimizers plus one linear lag scan for each seeded period.

Defined cases: null and empty texts have no words (no run; digests of the
empty string); very long texts are read whole; ties of the longest run go to
the smallest start, then period; repeated rows give repeated result rows;
further columns, whatever their names, pass through, and result columns of
the same names replace them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import mix

SHORT = 8  # periods below this are found by lag scans
K = 3      # words in a minimizer's k-mer

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                    T.StructField("period", T.LongType())])


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes (``bytes.split`` cuts at
    exactly those six characters)."""
    return [] if text is None else text.encode("utf-8").split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The dealt test alteration: where ``crc32(decimal id) % 10 == 0``, the
    words from ``a`` on repeat the block of ``p`` words at ``a``."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _intervals(eq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of True in ``eq``: starts and (exclusive) ends."""
    padded = np.concatenate(([False], eq, [False])).astype(np.int8)
    change = np.diff(padded)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _primitive(codes: np.ndarray, start: int, length: int, q: int) -> bool:
    for d in range(1, q // 2 + 1):
        if q % d == 0 and np.array_equal(codes[start:start + length - d], codes[start + d:start + length]):
            return False
    return True


def _window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` consecutive keys (van Herk / Gil-Werman)."""
    m = len(keys)
    blocks = -(-m // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:m] = keys
    rows = padded.reshape(blocks, w)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(m - w + 1)
    return np.minimum(suffix[starts], prefix[starts + w - 1])


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of word ids, as (start, length, period), by start then period."""
    n = len(codes)
    found: set[tuple[int, int, int]] = set()

    def keep(x: int, y: int, q: int) -> None:
        length = y - x + q
        if length >= max(6, 4 * q) and _primitive(codes, x, length, q):
            found.add((x, length, q))

    for q in range(1, min(SHORT, n)):
        for x, y in zip(*_intervals(codes[:-q] == codes[q:])):
            keep(int(x), int(y), q)

    if n >= 4 * SHORT:
        grams = codes[:n - K + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(1, K):
            grams = mix(grams ^ codes[j:n - K + 1 + j].astype(np.uint64))
        keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        stretches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: set[tuple[int, int]] = set()
        w = SHORT
        while 4 * w <= n:
            if w <= len(keys):
                places = np.unique(_window_minima(keys, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                values = keys[places] >> np.uint64(32)
                order = np.lexsort((places, values))
                places, values = places[order], values[order]
                shift = 1
                while shift < len(places):
                    same = values[shift:] == values[:-shift]
                    gap = places[shift:] - places[:-shift]
                    near = same & (gap < 2 * w)
                    if not near.any():
                        break
                    pick = near & (gap >= w)
                    seeds, periods = places[:-shift][pick], gap[pick]
                    if len(seeds):
                        exact = np.all(np.stack([codes[seeds + j] == codes[seeds + periods + j] for j in range(K)]), 0)
                        seeds, periods = seeds[exact], periods[exact]
                        for q in np.unique(periods).tolist():
                            if q not in stretches:  # every stretch of period q, once
                                stretches[q] = _intervals(codes[:-q] == codes[q:])
                            starts, ends = stretches[q]
                            hit = np.unique(np.searchsorted(starts, seeds[periods == q], "right") - 1)
                            for at in hit.tolist():
                                if (q, at) not in seen:
                                    seen.add((q, at))
                                    keep(int(starts[at]), int(ends[at]), q)
                    shift += 1
            w *= 2
    return sorted(found)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside every run's repeats (each run keeps its first period)."""
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    drop = np.cumsum(cover[:-1]) > 0
    return [w for w, d in zip(words, drop) if not d]


def codes_of(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.int64)
    return pd.factorize(pd.Series(words, dtype=object))[0].astype(np.int64)


def describe(words: list[bytes]) -> dict:
    """Runs, the longest run and digests of one document's words."""
    runs = find_runs(codes_of(words))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return {
        "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs],
        "n_runs": len(runs),
        "start": best[0] if best else None, "length": best[1] if best else None,
        "period": best[2] if best else None,
        "exponent_milli": (1000 * best[1]) // best[2] if best else None,
        "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest(),
    }


OUT = T.StructType([
    T.StructField("runs", T.ArrayType(RUN)), T.StructField("n_runs", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType()),
])


def periodic_runs(docs: DataFrame, text: str = "text", id_column: str | None = "doc_id",
                  alter: bool = False) -> DataFrame:
    """``docs`` with the columns of :data:`OUT` for the words of ``text``.

    ``alter`` applies :func:`planted` (keyed by ``id_column``) before the
    search, as the dealt check does.
    """
    names = [f.name for f in OUT.fields]
    rest = [c for c in docs.columns if c not in names]
    inner = {c: f"_pr{i}" for i, c in enumerate(rest)}
    frame = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in rest])
    text_in, id_in = inner[text], inner.get(id_column) if id_column else None
    schema = T.StructType([*frame.schema.fields, *OUT.fields])
    arrow_out = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in OUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_in).to_pylist()
            ids = batch.column(id_in).to_pylist() if id_in else [None] * len(texts)
            rows = []
            for t, i in zip(texts, ids):
                words = word_list(t)
                rows.append(describe(planted(words, i) if alter else words))
            extra = pa.Table.from_pylist(rows, schema=arrow_out)
            table = pa.Table.from_batches([batch])
            for f in arrow_out:
                table = table.append_column(f, extra.column(f.name))
            yield from table.combine_chunks().to_batches()

    out = frame.mapInArrow(run, schema)
    return out.select(*[F.col(inner[c]).alias(c) for c in rest], *names)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)
