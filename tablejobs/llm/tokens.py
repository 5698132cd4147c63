"""Token ids of documents in packed binary blocks.

The ids of all documents, in ascending order of document id, form one stream.
A file row ("segment") holds whole documents of one stretch of it:

* ``payload``: blocks of 128 ids. A block subtracts its least id (u4), packs
  the differences at the width that a percentile of them needs (u1), and lists
  the outliers: how many (u1), their places (u1 each) and values (u4 each).
  The last block of a segment is filled up with its last id.
* ``blocks``: the byte at which each block starts, so a range of ids is read
  without the blocks before it.
* ``doc_ids``, ``doc_tokens``: the documents of the segment and their lengths.
* ``part``, ``first``, ``n_ids``: where the segment stands in the stream.

At scale: one range shuffle of the texts by id (with the text's hash, so a
repeated id can be cut), then each task encodes and packs as it reads, holding
one segment. Offsets come from one sum per file part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablejobs.session import scratch_path, short_batches

from .words import mix, release_memory, released

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 16
SLICE_BYTES = 1 << 21
RELEASE_BYTES = 1 << 22  # of texts after which freed memory goes back
_WHOLE_BYTES = {8: "<u1", 16: "<u2", 32: "<u4"}

_SCHEMA = ("part int, seq int, first long, n_ids long, doc_ids array<long>, doc_tokens array<int>, "
           "blocks array<int>, payload binary")


# ---- packing

def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` (unsigned 32-bit) and the byte each starts at."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, dtype=np.int32)
    m = -(-n // BLOCK)
    full = np.full(m * BLOCK, ids[-1], dtype=np.uint32)
    full[:n] = ids
    full = full.reshape(m, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    chosen = np.partition(rest, at, axis=1)[:, at].astype(np.uint64)
    widths = np.ceil(np.log2(chosen + 1)).astype(np.uint8)
    out = rest >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    packed: list[bytes] = [b""] * m
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        if w in _WHOLE_BYTES:  # the same bytes, without going by bits
            for r, value in zip(rows.tolist(), rest[rows].astype(_WHOLE_BYTES[w])):
                packed[r] = value.tobytes()
            continue
        wide = rest[rows].astype("<u2" if w < 16 else "<u4")  # the bits above the width are not kept
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
        bits = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little") if w else np.zeros((len(rows), 0), np.uint8)
        for i, r in enumerate(rows.tolist()):
            packed[r] = bits[i].tobytes()
    where, place = np.nonzero(out)
    cut = np.searchsorted(where, np.arange(m + 1))
    values = rest[out].astype("<u4")
    place = place.astype(np.uint8)
    parts, starts, size = [], np.zeros(m, dtype=np.int32), 0
    heads = least.astype("<u4")
    for i in range(m):
        a, b = cut[i], cut[i + 1]
        block = b"".join((heads[i].tobytes(), bytes((int(widths[i]), int(b - a))), packed[i],
                          place[a:b].tobytes(), values[a:b].tobytes()))
        starts[i] = size
        size += len(block)
        parts.append(block)
    return b"".join(parts), starts


def unpack(payload: bytes, starts: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` .. ``end`` - 1 of a segment, from the blocks they are in."""
    if end <= begin:
        return np.zeros(0, dtype=np.uint32)
    lo, hi = begin // BLOCK, -(-end // BLOCK)
    data = np.frombuffer(payload, dtype=np.uint8)
    starts = np.asarray(starts[lo:hi], dtype=np.int64)
    m = hi - lo
    least = np.zeros(m, dtype=np.uint32)
    for byte in range(4):
        least |= data[starts + byte].astype(np.uint32) << np.uint32(8 * byte)
    widths, outliers = data[starts + 4], data[starts + 5]
    out = np.zeros((m, BLOCK), dtype=np.uint32)
    for w in np.unique(widths).tolist():
        if w:
            rows = np.flatnonzero(widths == w)
            packed = data[(starts[rows] + 6)[:, None] + np.arange(BLOCK * w // 8)]
            if w in _WHOLE_BYTES:
                out[rows] = packed.view(_WHOLE_BYTES[w])
                continue
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            wide = np.zeros((len(rows), BLOCK, 16 if w < 16 else 32), dtype=np.uint8)
            wide[:, :, :w] = bits
            out[rows] = np.packbits(wide.reshape(len(rows), -1), axis=1, bitorder="little").view("<u2" if w < 16 else "<u4")
    for i in np.flatnonzero(outliers).tolist():
        n, at = int(outliers[i]), int(starts[i]) + 6 + BLOCK // 8 * int(widths[i])
        out[i, data[at:at + n]] = np.frombuffer(payload, dtype="<u4", count=n, offset=at + n)
    return (out + least[:, None]).reshape(-1)[begin - lo * BLOCK:end - lo * BLOCK]


# ---- encoding

# Characters up to U+024F whose class the tokenizer's split pattern and this one
# agree on; texts with other ones go to the tokenizer whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
# What ``cut`` does on bytes, for one text.
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _class(char: str) -> int:
    if _OTHER.match(char):
        return _ODD
    if char.isspace():
        return _SPACE
    return _LETTER if re.match(f"[{_LETTERS}]", char) else _DIGIT if re.match(f"[{_DIGITS}]", char) else _SIGN


_ONE_BYTE = np.array([_class(chr(i)) for i in range(128)] + [_ODD] * 128, dtype=np.uint8)
_TWO_BYTES = np.array([_class(chr(i)) for i in range(0x250)] + [_ODD] * (0x800 - 0x250), dtype=np.uint8)


def cut(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the tokenizer's split pattern cuts UTF-8 bytes, as byte offsets
    with the end. ``texts``: the first byte of each text, and the end. A text
    with characters of other classes stays whole.

    The pattern takes ``'s 't 're 've 'm 'll 'd`` where a piece starts, else a
    run of letters, digits or signs with one blank before it, else blanks up
    to the one before a word.
    """
    n = len(data)
    if not n:
        return np.zeros(1, dtype=np.int64)
    kind = _ONE_BYTE[data]
    lead = np.flatnonzero((data & 0xE0) == 0xC0)
    two = _TWO_BYTES[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    kind[lead] = two
    kind[lead + 1] = two
    first = np.zeros(n + 1, dtype=bool)
    first[texts] = True
    last = first[1:]  # ends of texts
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # Before the last blank of several, if a word follows; not after a single ' '.
    space = kind == _SPACE
    before_word = np.flatnonzero(space[:-1] & ~space[1:] & ~last[:-1])
    starts[before_word] = True
    starts[before_word[data[before_word] == 0x20] + 1] = False
    # An apostrophe by itself, not behind a ' ': with the letters of the pattern.
    quote = np.flatnonzero((data[:-1] == 0x27) & starts[:-1] & ~last[:-1])
    if len(quote):
        one, after = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
        room = (quote + 2 < n) & ~last[np.minimum(quote + 1, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = room & (((after == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (after == 0x6C)))
        starts[quote[short | long] + 1] = False
        follow = np.concatenate([quote[short] + 2, quote[long] + 3])
        starts[follow[follow < n]] = True
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        for t in np.unique(np.searchsorted(texts, odd, side="right") - 1).tolist():
            starts[texts[t] + 1:texts[t + 1]] = False
    return np.append(np.flatnonzero(starts), n)


KEY_BYTES = 16


class Pieces:
    """Ids of short pieces, in arrays: less than 80 bytes each, fewer than a
    dict of strings takes. Found by a hash, told apart by their bytes (``lo``,
    ``hi``); of two with one hash only the first is kept."""

    def __init__(self):
        self.hash = self.lo = self.hi = np.zeros(0, np.uint64)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.dtype("<u4"))

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each, -1 if it is not there."""
        if not len(self):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self) - 1)
        return np.where((self.lo[at] == lo) & (self.hi[at] == hi), at, -1)

    def add(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.ids) + np.cumsum(n) - n
        order = np.argsort(h, kind="stable")
        spot = np.searchsorted(self.hash, h[order])
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        if len(self):
            new &= self.hash[np.minimum(spot, len(self) - 1)] != h[order]
        order, spot = order[new], spot[new]
        self.hash, self.lo, self.hi, self.at, self.n = (
            np.insert(have, spot, more[order]) for have, more in
            ((self.hash, h), (self.lo, lo), (self.hi, hi), (self.at, at), (self.n, n)))
        self.ids = np.concatenate([self.ids, ids])


def _keys(different: pa.Array) -> tuple[np.ndarray, ...]:
    """Hash and bytes (two numbers) of each piece, and whether these say all of it."""
    _, offsets, data = different.buffers()
    offsets, data = np.frombuffer(offsets, np.int64)[:len(different) + 1], np.frombuffer(data, np.uint8)
    lengths, byte = np.diff(offsets), np.arange(KEY_BYTES)
    key = data[np.minimum(offsets[:-1, None] + byte, len(data) - 1)]
    key[byte >= lengths[:, None]] = 0
    lo, hi = (np.ascontiguousarray(x) for x in key.view("<u8").T)
    return mix(lo ^ mix(hi)), lo, hi, np.count_nonzero(key, axis=1) == lengths


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    """Encodes with a byte-level BPE file, piece by piece.

    The tokenizer splits a text into pieces and encodes each by itself, so the
    ids of a piece are kept. Many texts are cut at once on their bytes; Arrow
    finds the different pieces among them, each costs one look-up, and the ids
    are gathered by offsets. New pieces are encoded together. At most ``keep``
    pieces are kept (or those of one call), in two halves: the half used
    longest ago goes. Pieces of up to 16 bytes are kept in arrays, longer ones
    in dicts, those over ``longest`` characters not at all.
    """

    def __init__(self, path: str, keep: int = 1_000_000, longest: int = 256):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keep, self.longest = keep, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.short, self.older_short = Pieces(), Pieces()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _joined(self, pieces: list[str], between: str) -> None:
        """Ids of many pieces by one call; ``between`` keeps them apart."""
        step = 2 if between else 1
        for i in range(0, len(pieces), 2000):
            some = pieces[i:i + 2000]
            got = self.tokenizer.encode(between + between.join(some), add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            cut = 4 * np.searchsorted(np.array(got.word_ids), np.arange(len(some) * step + 1))
            begin, end = cut[step - 1::step][:len(some)].tolist(), cut[step::step].tolist()
            self.known.update(zip(some, (ids[a:b] for a, b in zip(begin, end))))

    def _learn(self, pieces: list[str]) -> None:
        spaced, bare = [], []
        for p in pieces:
            if p.isspace() or _OTHER.search(p):
                self.known[p] = self._whole(p)
            else:
                (spaced if p[0] == " " else bare).append(p)
        self._joined(spaced, "")
        self._joined(bare, "\n")

    def _look_up(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece start, how many there are, and the ids."""
        h, lo, hi, is_short = _keys(different)
        short, older_short, known, older = self.short, self.older_short, self.known, self.older
        place = short.find(h, lo, hi)
        here, rest = np.flatnonzero(is_short & (place >= 0)), np.flatnonzero(is_short & (place < 0))
        before = older_short.find(h[rest], lo[rest], hi[rest])
        new, long = rest[before < 0], np.flatnonzero(~is_short)
        new_pieces, long_pieces = (different.take(pa.array(x)).to_pylist() for x in (new, long))
        lost = [p for p in long_pieces if p not in known and len(p) <= self.longest]
        more = len(rest) + len(lost)
        if more and len(short) + len(known) + more > self.keep // 2:
            self.short, self.older_short, self.known, self.older = Pieces(), short, {}, known
        self.known.update((p, older[p]) for p in lost if p in older)
        self._learn([*new_pieces, *(p for p in lost if p not in older)])
        found = [self.known.pop(p) for p in new_pieces]
        for p in long_pieces:
            found.append(self.known[p] if p in self.known else known[p] if p in known else self._whole(p))
        starts, sizes = np.zeros(len(different), np.int64), np.zeros(len(different), np.int64)
        starts[here], sizes[here] = short.at[place[here]], short.n[place[here]]
        old, base = rest[before >= 0], len(short.ids)
        starts[old], sizes[old] = base + older_short.at[before[before >= 0]], older_short.n[before[before >= 0]]
        learnt, base = np.concatenate([new, long]), base + len(older_short.ids)
        sizes[learnt] = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts[learnt] = base + np.cumsum(sizes[learnt]) - sizes[learnt]
        ids = np.concatenate([short.ids, older_short.ids, np.frombuffer(b"".join(found), dtype="<u4")])
        if len(rest):
            self.short.add(h[rest], lo[rest], hi[rest], sizes[rest], ids[_ragged(starts[rest], sizes[rest])])
        return starts, sizes, ids

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        _, offsets, content = column.buffers()
        docs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(content, dtype=np.uint8)[docs[0]:docs[-1]] if content else np.zeros(0, np.uint8)
        docs = docs - docs[0]
        bounds = cut(data, docs)
        cuts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        which = cuts.indices.to_numpy()
        starts, sizes, ids = self._look_up(cuts.dictionary)
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        stream = ids[_ragged(starts[which], n)].tobytes()
        at = (4 * ends[np.searchsorted(bounds, docs)]).tolist()
        return [stream[a:b] for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- files

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the stream to ``path``.

    Null texts are empty: one id, the end. Documents come in ascending id order,
    nulls first; rows of one id follow their text's hash. An empty table gives a
    folder without segments. Further columns are left out.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        part, state = TaskContext.get().partitionId(), {"seq": 0, "first": 0}
        ids, lengths, parts, held, seen = [], [], [], 0, 0

        def flush():
            stream = np.frombuffer(b"".join(parts), dtype="<u4")
            payload, starts = pack(stream)
            row = {"part": part, "seq": state["seq"], "first": state["first"], "n_ids": len(stream), "doc_ids": ids[:],
                   "doc_tokens": lengths[:], "blocks": starts.tolist(), "payload": payload}
            state["seq"] += 1
            state["first"] += len(stream)
            for x in (ids, lengths, parts):
                x.clear()
            return pa.RecordBatch.from_pylist([row], _arrow())

        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
            # Slices of whole texts, up to SLICE_BYTES or one text.
            slots = np.cumsum(sizes) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                got = coder.encode(texts.slice(lo, hi - lo))
                for doc, doc_ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), got):
                    parts.append(doc_ids + end)
                    ids.append(doc)
                    lengths.append(len(parts[-1]) // 4)
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield flush()
                        held = 0
            seen += int(sizes.sum())
            if seen >= RELEASE_BYTES:
                release_memory()
                seen = 0
        if ids:
            yield flush()

    order = ["_id", "_h"]
    with short_batches(docs.sparkSession, SLICE_BYTES):
        (docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"),
                     F.xxhash64(text_column).alias("_h"))
         .repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
         .mapInArrow(released(segments), _SCHEMA).write.parquet(path))


def _arrow() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())),
                      ("blocks", pa.list_(pa.int32())), ("payload", pa.binary())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of written files: ``doc_id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, if asked for, the ``ids``."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(name)[r]
                lengths = get("doc_tokens").values.to_numpy()
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = unpack(get("payload").as_py(), get("blocks").values.to_numpy(), 0,
                             int(ends[-1])).astype("<u4")
                docs = [ids[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
                n = len(docs)
                cols = [pa.array([get("part").as_py()] * n, pa.int32()),
                        get("doc_ids").values, pa.array(get("first").as_py() + ends - lengths),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([d.tolist() for d in docs], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.schema(_SCHEMA).parquet(path)
    ids = ", ids array<long>" if with_ids else ""
    docs = files.select("part", "first", "doc_ids", "doc_tokens", "blocks", "payload").mapInArrow(
        released(decode), "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ids)
    # One row for each written part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write ``docs`` (to the shared folder if no path is given) and read back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_column, text_column)
    return read_tokens(docs.sparkSession, path)
