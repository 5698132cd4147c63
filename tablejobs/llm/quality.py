"""Quality rules: simple text statistics, then n-gram perplexity bands.

Base rules (fixed values of the dealt check): fewer than 50 words, or more
than half of the words inside 3-word windows that occur twice or more in the
text, fail. Beyond them a document is judged by its perplexity under a
modified Kneser-Ney trigram model of its language, counted by Spark over all
documents; per language, documents whose log-perplexity lies beyond the
far-out fences (``width`` interquartile ranges below the first or above the
third quartile, over documents that pass the base rules) are rejected: too
repetitive or templated below, gibberish above. Quartiles, not mean and
deviation, since copies of a text pull their own perplexity down and make
the distribution two-peaked.

The model (Chen and Goodman's interpolated modified Kneser-Ney, order 3):
counts of trigrams; continuation counts (distinct left words) for bigrams and
unigrams; three discounts per order and language from the counts of counts.
Every trigram is counted. A document is scored leave-one-out: its own counts
are taken from the trigram counts, its context counts and the counts of types
by count before its trigrams are predicted, so that a text does not predict
itself (lower orders keep them).

At scale: trigrams about as many as words make one shuffle of all of them
larger than the text, so words are dealt to passes by the hash of a trigram's
middle word. Texts are cut once and written as numbers of their words; each
pass reads these, shuffles only its trigrams and frees its shuffle files. Within a pass and language, the middle word also names the
cell (one group of Spark's): it holds all counts of the contexts (a, b) and
bigrams (b, c). Very frequent middle words are spread over cells by their left
word; their bigrams are then summed by right word, in key cells. The unigram
counts live in key cells by right word too: a cell sends the right words it
holds and gets their counts back. The first round of passes counts, the second
scores, and the log-probabilities go back to the encoding task's documents.
Trigrams travel in packed blocks: words as 64-bit hashes, the 262,000 most
frequent ones as 18-bit numbers (any list is right, it only saves bytes). One
pair of words in one language is the largest group that stays together.

Documents are known by the hash of their text and language (SHA-256).

Defined cases: null texts are empty; an empty text has one predicted token
(the end), so it gets a perplexity too; null languages form one language
with ``\\x00``; repeated rows are scored alike; very long texts are read
whole; extra columns pass through (internal ones are prefixed ``_q_``);
result columns of the same names replace input ones. A language with too
few counts for the discount formula takes the discounts 0.5, 1, 1.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tablejobs.session import delete_path, freed_shuffles, materialize, scratch_path

from . import words

#: Fixed values of the dealt base rules.
MIN_WORDS = 50
MAX_REPEAT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"

BOS, EOS = np.uint64(2**64 - 0x0B05), np.uint64(2**64 - 0x0E05)  # hashes of the start and end marks
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)
CODE = "code"  # packed numbers of words
ESCAPE = 0x3FFFF  # a word without a number
HELD = 1_000_000  # trigrams a reading task holds
COUNTED = 1 << 20  # different words a task counts at a time
SLICE_BYTES = 1 << 20  # of texts at a time
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_ROW = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("src", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()),
                  ("b", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("x3", pa.int64()), ("x4", pa.int64()),
                  ("s", pa.int64())])
_TOKENS = pa.schema([("src", pa.int64()), ("base", pa.int64()), ("texts", pa.int64()), ("n", pa.int64()),
                     ("langs", pa.list_(pa.string())), ("per_text", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary())])
_TOKEN_ROWS = "src long, base long, texts long, n long, langs array<string>, per_text binary, codes binary, keys binary"
_ROWS = ("lang string, key long, src long, n long, payload binary, b long, x1 long, x2 long, x3 long, x4 long, s long")


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _ROW)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 100 * MAX_REPEAT_SHARE * n_words)


# ---- words

def _word_ids(w: words.Words) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the different words (bytes)."""
    ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int64)
    data = np.ascontiguousarray(w.data[~words._SEPARATOR[w.data]])
    found = pa.Array.from_buffers(pa.large_binary(), len(w.starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first bytes of eight


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    lengths = ends - starts
    out = words.mix((eight[starts] & _FIRST[np.minimum(lengths, 8)]) + words._STEP * lengths.astype(np.uint64))
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        out[more] = words.mix((out[more] ^ eight[starts[more] + at] & _FIRST[np.minimum(lengths[more] - at, 8)]) + words._STEP)
        at += 8
        more = more[lengths[more] > at]
    return out


def _hashes(different: pa.Array) -> np.ndarray:
    if not len(different):
        return np.zeros(0, np.uint64)
    _, offsets, data = different.buffers()
    ends = np.frombuffer(offsets, np.int64)[:len(different) + 1]
    return _hash_words(np.frombuffer(data, np.uint8)[:ends[-1]], ends[:-1], ends[1:])


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start in sorted rows."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _repeated(ids: np.ndarray, w: words.Words) -> np.ndarray:
    """Per text, the words in 3-word windows found twice or more in it."""
    n = len(ids)
    covered = np.zeros(n, dtype=bool)
    if n >= 3:
        text = np.repeat(np.arange(w.hi - w.lo), w.counts)
        common = (np.bincount(ids) > 1)[ids]  # no others can repeat
        at = np.flatnonzero(common[:-2] & common[1:-1] & common[2:] & (text[:-2] == text[2:]))
        bits, top = int(ids.max()).bit_length(), (w.hi - w.lo).bit_length()
        if 3 * bits + top <= 64:
            keys = [text[at].astype(np.uint64)]
            for k in range(3):
                keys = [keys[0] << np.uint64(bits) | ids[at + k].astype(np.uint64)]
            order = np.argsort(keys[0])
        else:
            keys = [text[at], ids[at], ids[at + 1], ids[at + 2]]
            order = np.lexsort(keys)
        lengths = _lengths(_runs(*[k[order] for k in keys]), len(at))
        twice = at[order[np.repeat(lengths > 1, lengths)]]
        for k in range(3):
            covered[twice + k] = True
    return np.diff(np.searchsorted(np.flatnonzero(covered), w.first))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))


def text_statistics(texts: pa.Array) -> Iterator[tuple[words.Words, np.ndarray, pa.Array, list[np.ndarray]]]:
    """Some texts at a time: their words, word numbers, different words and
    the base statistics in the order of ``STATISTICS``."""
    plain = texts.cast(pa.large_binary()).fill_null(b"")
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    for w in words.slices(texts, limit=SLICE_BYTES):
        some = plain.slice(w.lo, w.hi - w.lo).to_pylist()
        bounds = np.cumsum([0, *map(len, some)])
        ids, different = _word_ids(w)
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in some]
        inside = np.concatenate([[0], np.cumsum(w.ends - w.starts)])[w.first]  # bytes of words; all later bytes of characters are
        yield w, ids, different, [w.counts, np.diff(inside) - _sums((w.data & 0xC0) == 0x80, bounds),
                                  _sums(symbol[w.data], bounds), np.array([len(x) - len(set(x)) for x in lines]),
                                  _repeated(ids, w)]


# ---- packed blocks

def _planes(array: np.ndarray) -> bytes:
    return array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()


def _code_planes(codes: np.ndarray) -> bytes:
    """Numbers of words: three bytes each."""
    return b"".join((codes >> shift).astype(np.uint8).tobytes() for shift in (0, 8, 16))


def pack(*arrays: np.ndarray, codes: tuple[np.ndarray, ...] = ()) -> bytes:
    raw = b"".join([*map(_code_planes, codes), *map(_planes, arrays)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes, n: int, *types: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Arrays of ``n`` values, and the one of 64-bit values behind them."""
    size = int.from_bytes(payload[:8], "little")
    raw = np.frombuffer(pa.decompress(payload[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for t in types:
        width = 3 if t == CODE else np.dtype(t).itemsize
        planes = raw[at:at + n * width].reshape(width, n)
        if t == CODE:
            out.append(planes[0] | planes[1].astype(np.uint32) << 8 | planes[2].astype(np.uint32) << 16)
        else:
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * width
    rest = (size - at) // 8
    return out, np.ascontiguousarray(raw[at:].reshape(8, rest).T).reshape(-1).view(np.uint64)


def pack_trigrams(codes: list[np.ndarray], hashes: list[np.ndarray], docs: np.ndarray) -> bytes:
    escaped = np.concatenate([h[c == ESCAPE] for c, h in zip(codes, hashes)])
    return pack(docs, escaped, codes=tuple(codes))


def _unpack_codes(payload: bytes, n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Codes of the three words, documents, and hashes of the words without a
    number, by place."""
    (*codes, docs), escaped = unpack(payload, n, CODE, CODE, CODE, "<u4")
    ends = np.cumsum([int((c == ESCAPE).sum()) for c in codes])
    return codes, docs, [escaped[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)]


def unpack_trigrams(payload: bytes, n: int, book: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    codes, docs, escaped = _unpack_codes(payload, n)
    out = []
    for c, e in zip(codes, escaped):
        rare = c == ESCAPE
        h = book[np.where(rare, 0, c)]
        h[rare] = e
        out.append(h)
    return out, docs


class Deal:
    """How trigrams go to passes, cells and key cells. ``book``: the hashes of
    the most frequent words by number; ``parts``: into how many each of the
    first of them is spread as a middle word."""

    def __init__(self, book: np.ndarray, parts: np.ndarray, cells: int, key_cells: int, passes: int):
        self.given = book, parts, cells, key_cells, passes
        self.cells, self.key_cells, self.passes = cells, key_cells, passes
        self.sorted = np.argsort(book).astype(np.uint32)
        self.ranked, self.numbered = book[self.sorted], len(book)
        self.book = book = np.concatenate([book, np.zeros(ESCAPE + 1 - len(book), np.uint64)])
        self.by_code = np.ones(ESCAPE + 1, dtype=np.int64)  # parts
        self.by_code[:len(parts)] = parts
        self.hot = self.by_code > 1
        self.cell_by_code, self.pass_by_code = self.cell(book), self.pass_of(book)

    def __reduce__(self):
        return Deal, self.given

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        order, at = np.argsort(hashes), np.empty(len(hashes), dtype=np.int64)
        at[order] = np.searchsorted(self.ranked, hashes[order])  # sorted ones are found faster
        at = np.minimum(at, len(self.ranked) - 1)
        return np.where(self.ranked[at] == hashes, self.sorted[at], ESCAPE).astype(np.uint32)

    def pass_of(self, b: np.ndarray) -> np.ndarray:
        return (words.mix(b ^ words._M1) >> np.uint64(32)) % np.uint64(self.passes)

    def cell(self, b: np.ndarray) -> np.ndarray:
        return (words.mix(b + words._STEP) % np.uint64(self.cells)).astype(np.int64)

    def key_cell(self, c: np.ndarray) -> np.ndarray:
        return (words.mix(c ^ words._M2) % np.uint64(self.key_cells)).astype(np.int64)

    def cells_of(self, b: np.ndarray, escaped: np.ndarray, a: np.ndarray, escaped_a: np.ndarray) -> np.ndarray:
        """From codes, and hashes where these are ``ESCAPE``."""
        out = self.cell_by_code[b]
        out[b == ESCAPE] = self.cell(escaped)
        spread = np.flatnonzero(self.hot[b])
        if len(spread):
            left = self.book[a]
            left[a == ESCAPE] = escaped_a
            code = b[spread]
            part = words.mix(left[spread]) % self.by_code[code].astype(np.uint64)
            out[spread] = self.cell(words.mix(self.book[code]) + part)
        return out


def _sorted_by(cells: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order by cell, and about by two codes (it only saves bytes)."""
    n = len(cells)
    bits, top = max(n - 1, 1).bit_length(), int(cells.max()).bit_length()
    wide = ESCAPE.bit_length()
    left = min(64 - bits - top - wide, wide)
    if left < 0:
        return np.lexsort((second, first, cells))
    key = (cells.astype(np.uint64) << np.uint64(wide) | first) << np.uint64(left) | np.minimum(second, (1 << left) - 1)
    key = key << np.uint64(bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _encode(deal):
    """All texts as numbers of their words, once: the passes read these. A row
    holds some texts (with marks): ``codes`` and hashes of words without a
    number; ``src`` and ``base`` name the texts: the task and how many it had
    before. ``deal``: broadcast."""
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, task, base = deal.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).dictionary_encode()
            lang, names = names.indices.to_numpy().astype(np.uint32), names.dictionary.to_pylist()
            for w in words.slices(batch.column(2), limit=SLICE_BYTES):
                found = pa.array(_hash_words(w.data, w.starts, w.ends)).dictionary_encode()
                hashes = np.concatenate([found.dictionary.to_numpy(), [BOS, EOS]])
                texts = w.hi - w.lo
                begins = w.first[:-1] + 3 * np.arange(texts)
                word = np.ones(w.first[-1] + 3 * texts, dtype=bool)
                word[begins] = word[begins + 1] = word[begins + w.counts + 2] = False
                line = np.full(len(word), len(hashes) - 1, dtype=np.int32)
                line[begins] = line[begins + 1] = len(hashes) - 2
                line[word] = found.indices.to_numpy()
                codes = d.codes(hashes)[line]
                yield pa.RecordBatch.from_pylist([{
                    "src": task, "base": base, "texts": texts, "n": len(line), "langs": names,
                    "per_text": pack(w.counts.astype(np.uint32), lang[w.lo:w.hi]),
                    "codes": pack(hashes[line[codes == ESCAPE]], codes=(codes,)), "keys": b"".join(keys[w.lo:w.hi])}], _TOKENS)
                base += texts
    return tokens


def _read(deal, k: int, with_docs: bool):
    """The trigrams of pass ``k`` (their middle words' pass) and, if asked for,
    their documents, from the rows of ``_encode``."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, langs, held = deal.value, {}, []
        mine = d.pass_by_code == k
        mine[ESCAPE] = False

        def flush(src: int) -> pa.RecordBatch:
            names = list(langs)
            cells, docs = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            codes = [np.concatenate([x[2][i] for x in held]) for i in range(3)]
            escaped = [np.concatenate([x[3][i] for x in held]) for i in range(3)]
            held.clear()
            order = _sorted_by(cells, codes[0], codes[1])
            cells, docs, places = cells[order], docs[order], []
            for i, c in enumerate(codes):
                slot = np.cumsum(c == ESCAPE) - 1
                codes[i] = c[order]
                rare = codes[i] == ESCAPE
                escaped[i] = escaped[i][slot[order[rare]]]
                places.append(np.concatenate([[0], np.cumsum(rare)]))
            starts = _runs(cells)
            rows = [{"lang": names[int(cells[lo]) // d.cells], "key": int(cells[lo]) % d.cells, "src": src, "n": int(hi - lo),
                     "payload": pack(docs[lo:hi], np.concatenate([e[at[lo]:at[hi]] for e, at in zip(escaped, places)]),
                                     codes=tuple(x[lo:hi] for x in codes))}
                    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)])]
            return pa.RecordBatch.from_pylist(rows, _ROW)

        last, size = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if size and (size >= HELD or last != row["src"]):
                    yield flush(last)
                    size = 0
                last = row["src"]
                (line,), escapes = unpack(row["codes"], row["n"], CODE)
                (counts, lang), _ = unpack(row["per_text"], row["texts"], "<u4", "<u4")
                rare = np.flatnonzero(line == ESCAPE)
                chosen = mine[line]
                chosen[rare] = d.pass_of(escapes) == k
                ends = np.cumsum(counts.astype(np.int64) + 3)
                begins = np.concatenate([[0], ends[:-1]])
                chosen[begins] = chosen[ends - 1] = False  # no middle words
                at = np.flatnonzero(chosen)
                text = np.repeat(np.arange(len(counts)), np.diff(np.searchsorted(at, np.append(begins, len(line)))))
                codes, escaped = [], []
                for step in (0, -1, 1):
                    place = at + step
                    codes.append(line[place])
                    escaped.append(escapes[np.searchsorted(rare, place[codes[-1] == ESCAPE])])
                number = np.array([langs.setdefault(x, len(langs)) for x in row["langs"]], dtype=np.int64)
                held.append((number[lang][text] * d.cells + d.cells_of(codes[0], escaped[0], codes[1], escaped[1]),
                             (row["base"] + text if with_docs else 0 * text).astype(np.uint32), codes, escaped))
                size += len(at)
        if size:
            yield flush(last)
    return blocks


# ---- one cell

class Cell:
    """The trigrams of one cell, sorted: types, contexts, bigrams, and what is
    asked of the key cells (``keys``: key cell, c, b or 0, count). Words are
    known by their codes; ones without a number follow these."""

    def __init__(self, table: pa.Table, d: Deal, with_docs: bool):
        found = [_unpack_codes(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("n").to_pylist())]
        rare = pa.array(np.concatenate([e[i] for i in range(3) for _, _, e in found])).dictionary_encode()
        self.hashes = np.concatenate([d.book[:d.numbered], rare.dictionary.to_numpy()])
        numbers, at, bac = rare.indices.to_numpy().astype(np.uint64) + np.uint64(d.numbered), 0, []
        for i in range(3):
            codes = np.concatenate([c[i] for c, _, _ in found])
            x, escaped = codes.astype(np.uint64), codes == ESCAPE
            more = int(escaped.sum())
            x[escaped] = numbers[at:at + more]
            at += more
            bac.append(x)
        n, bits = len(bac[0]), np.uint64(max(len(self.hashes) - 1, 1).bit_length())
        if 3 * bits <= 64:
            packed = (bac[0] << bits | bac[1]) << bits | bac[2]
            order = np.argsort(packed) if with_docs else None
            packed = packed[order] if with_docs else np.sort(packed)
            types = _runs(packed)
            mask = np.uint64((1 << int(bits)) - 1)
            packed = packed[types]
            tb, ta, tc = packed >> bits >> bits, packed >> bits & mask, packed & mask
        else:
            order = np.lexsort((bac[2], bac[1], bac[0]))
            sb, sa, sc = [x[order] for x in bac]
            types = _runs(sb, sa, sc)
            tb, ta, tc = sb[types], sa[types], sc[types]
        self.c3 = _lengths(types, n)
        grams = tb << bits | tc  # two numbers below 2**32
        by = np.argsort(grams) if with_docs else None
        grams = grams[by] if with_docs else np.sort(grams)
        starts = _runs(grams)
        self.c2 = _lengths(starts, len(grams))
        self.gb = (grams[starts] >> bits).astype(np.int64)
        gc = (grams[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        self.hot = np.concatenate([d.hot[:d.numbered], np.zeros(len(rare.dictionary), dtype=bool)])[self.gb]
        # One question for each right word; for spread middle words, one for each bigram.
        counts = np.bincount(gc[~self.hot], minlength=len(self.hashes))
        right = np.flatnonzero(counts)
        qc = np.concatenate([self.hashes[right], self.hashes[gc[self.hot]]])
        qb = np.concatenate([np.zeros(len(right), np.uint64), self.hashes[self.gb[self.hot]]])
        qn = np.concatenate([counts[right], self.c2[self.hot]])
        sort, cell = _question_order(d, qc, qb)
        self.keys = cell[sort], qc[sort], qb[sort], qn[sort]
        if with_docs:
            place = np.empty(len(sort), dtype=np.int64)
            place[sort] = np.arange(len(sort))
            of_word = np.zeros(len(self.hashes), dtype=np.int64)
            of_word[right] = place[:len(right)]
            self.question = of_word[gc]  # of each bigram
            self.question[self.hot] = place[len(right):]
            self.gram = np.empty(len(tb), dtype=np.int64)  # of each type
            self.gram[by] = np.repeat(np.arange(len(starts)), self.c2)
            contexts = _runs(tb, ta)
            self.context = np.repeat(np.arange(len(contexts)), _lengths(contexts, len(tb)))
            self.s3 = np.add.reduceat(self.c3, contexts)
            self.m = [np.add.reduceat(x.astype(np.int64), contexts) for x in (self.c3 == 1, self.c3 == 2, self.c3 >= 3)]
            self._documents(found, table.column("src").to_pylist(), types, order)

    def _documents(self, found: list, src: list[int], types: np.ndarray, order: np.ndarray) -> None:
        """Each document's own types and how often it has them and their contexts."""
        sources = sorted(set(src))
        most = {x: 0 for x in sources}
        for (_, docs, _), x in zip(found, src):
            most[x] = max(most[x], int(docs.max()) + 1)
        self.sources, self.first = np.array(sources), np.cumsum([0, *[most[x] for x in sources]])
        begin = dict(zip(sources, self.first.tolist()))
        doc = np.concatenate([docs.astype(np.uint64) + np.uint64(begin[x]) for (_, docs, _), x in zip(found, src)])
        bits = np.uint64(max(int(self.first[-1]) - 1, 1).bit_length())  # types are fewer than 2**31, documents than 2**33
        mask = np.uint64((1 << int(bits)) - 1)
        own = np.repeat(np.arange(len(types), dtype=np.uint64), self.c3) << bits | doc[order]
        own.sort()
        starts = _runs(own)
        self.own3, own = _lengths(starts, len(own)), own[starts]
        self.type, doc = (own >> bits).astype(np.int64), own & mask
        self.doc = doc.astype(np.int64)
        pairs = self.context[self.type].astype(np.uint64) << bits | doc
        other = np.argsort(pairs)
        starts = _runs(pairs[other])
        self.own_context = np.empty(len(own), dtype=np.int64)
        self.own_context[other] = np.repeat(np.add.reduceat(self.own3[other], starts), _lengths(starts, len(own)))

    def ask(self, lang: str, src: int) -> list[dict]:
        return _asked(lang, src, *self.keys)


def _question_order(d: Deal, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key cell, c and b, and the key cells."""
    cell = d.key_cell(c)
    if b.any():
        return np.lexsort((b, c, cell)), cell
    order = np.argsort(c)  # all different
    return order[np.argsort(cell[order].astype(np.uint16 if d.key_cells <= 1 << 16 else np.int64), kind="stable")], cell


def _asked(lang: str, src: int, cell: np.ndarray, c: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[dict]:
    starts = _runs(cell)
    return [{"lang": lang, "key": int(cell[lo]), "src": src, "n": int(hi - lo), "payload": pack(n[lo:hi].astype(np.uint32), c[lo:hi], b[lo:hi])}
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])]


def _ask(deal):
    """Second round, a cell: the questions of ``Cell``, in its order; right
    words are counted only if a spread middle word needs it."""
    def cell(table: pa.Table) -> pa.Table:
        d, (lang, key) = deal.value, _key_of(table)
        found = [_unpack_codes(p, n) for p, n in zip(table.column("payload").to_pylist(), table.column("n").to_pylist())]
        if any(d.hot[codes[0]].any() for codes, _, _ in found):
            return _table(Cell(table, d, False).ask(lang, key))
        seen = np.zeros(ESCAPE + 1, dtype=bool)
        for codes, _, _ in found:
            seen[codes[2]] = True
        c = np.concatenate([d.book[:ESCAPE][seen[:ESCAPE]], np.unique(np.concatenate([e[2] for _, _, e in found]))])
        b = np.zeros(len(c), np.uint64)
        sort, cells = _question_order(d, c, b)
        return _table(_asked(lang, key, cells[sort], c[sort], b, np.zeros(len(c), np.uint32)))
    return cell


def _counts_of_counts(x: np.ndarray) -> dict:
    return {f"x{k}": int((x == k).sum()) for k in (1, 2, 3, 4)}


def _questions(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for p, n in zip(table.column("payload").to_pylist(), table.column("n").to_pylist()):
        (count, c, b), _ = unpack(p, n, "<u4", "<u8", "<u8")
        out.append((c, b, count.astype(np.int64)))
    return out


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    starts = _runs(*keys)
    return [k[starts] for k in keys], np.add.reduceat(counts[order], starts)


def _key_of(table: pa.Table) -> tuple[str, int]:
    return table.column("lang")[0].as_py(), table.column("key")[0].as_py()


def _count(deal):
    """First round, a cell: its questions, and counts of counts."""
    def cell(table: pa.Table) -> pa.Table:
        lang, key = _key_of(table)
        found = Cell(table, deal.value, False)
        return _table(found.ask(lang, key) + [{"lang": lang, "key": -3, **_counts_of_counts(found.c3)},
                                              {"lang": lang, "key": -2, **_counts_of_counts(found.c2[~found.hot])}])
    return cell


def _merge_pass(table: pa.Table) -> pa.Table:
    """First round, a key cell of one pass: how many middle words are left of
    each word; spread bigrams counted, and summed by middle word."""
    lang, key = _key_of(table)
    if key < 0:
        return table
    c, b, n = (np.concatenate(x) for x in zip(*_questions(table)))
    rows, spread = [], b != 0
    if spread.any():
        (hc, hb), c2 = _summed([c[spread], b[spread]], n[spread])
        rows.append({"lang": lang, "key": -2, **_counts_of_counts(c2)})
        order = np.argsort(hb, kind="stable")
        hb, c2s = hb[order], c2[order]
        starts = _runs(hb)
        sums = [np.add.reduceat(x.astype(np.int64), starts) for x in (c2s, c2s == 1, c2s == 2, c2s >= 3)]
        rows += [{"lang": lang, "key": -4, "b": h, "s": s, "x1": x, "x2": y, "x3": z} for h, s, x, y, z in
                 zip(hb[starts].view(np.int64).tolist(), *[x.tolist() for x in sums])]
        c, n = np.concatenate([c[~spread], hc]), np.concatenate([n[~spread], np.ones(len(hc), np.int64)])
    (c,), n = _summed([c], n)
    return _table([*rows, {"lang": lang, "key": key, "n": len(c), "payload": pack(n.astype(np.uint32), c)}])


def _merge(table: pa.Table) -> pa.Table:
    """A key cell of all passes: the unigrams' counts."""
    lang, key = _key_of(table)
    found = [unpack(p, n, "<u4") for p, n in zip(table.column("payload").to_pylist(), table.column("n").to_pylist())]
    (c,), n = _summed([np.concatenate([x[1] for x in found])], np.concatenate([x[0][0] for x in found]).astype(np.int64))
    return _table([{"lang": lang, "key": key, "n": len(c), "payload": pack(n.astype(np.uint32), c)},
                   {"lang": lang, "key": -1, "n": len(c), "s": int(n.sum()), **_counts_of_counts(n)}])


def _answer(asked: pa.Table, unigrams: pa.Table) -> pa.Table:
    """Second round, a key cell: c1 and, of spread bigrams, c2 for each question."""
    if not asked.num_rows:
        return _table([])
    lang, key = _key_of(asked)
    (c1,), c = unpack(unigrams.column("payload")[0].as_py(), unigrams.column("n")[0].as_py(), "<u4")
    questions = _questions(asked)
    qc, qb, qn = (np.concatenate(x) for x in zip(*questions))
    c2 = np.zeros(len(qc), np.uint32)
    spread = np.flatnonzero(qb != 0)
    if len(spread):
        order = spread[np.lexsort((qb[spread], qc[spread]))]
        starts = _runs(qc[order], qb[order])
        c2[order] = np.repeat(np.add.reduceat(qn[order], starts), _lengths(starts, len(order)))
    first = c1[np.searchsorted(c, qc)]
    ends = np.cumsum([len(x[0]) for x in questions]).tolist()
    return _table([{"lang": lang, "key": src, "src": key, "n": hi - lo, "payload": pack(first[lo:hi], c2[lo:hi])}
                   for src, lo, hi in zip(asked.column("src").to_pylist(), [0, *ends], ends)])


def _discounts(n: list[int]) -> list[float]:
    """The three modified Kneser-Ney discounts of one order."""
    if min(n) <= 0:
        return list(DEFAULT_DISCOUNTS)
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


def _by_count(x: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(x == 1, d[0], np.where(x == 2, d[1], d[2]))


def _score(deal, model):
    """Second round, a cell with the answers to its questions: each document's
    log-probability of each of its trigram types, leave-one-out."""
    def cell(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        lang, key = _key_of(table)
        t, m = Cell(table, deal.value, True), model.value[lang]
        got = sorted(zip(answers.column("src").to_pylist(), answers.column("n").to_pylist(), answers.column("payload").to_pylist()))
        c1, c2 = (np.concatenate(x).astype(np.int64) for x in zip(*[unpack(p, n, "<u4", "<u4")[0] for _, n, p in got]))
        c1 = c1[t.question]
        c2 = np.where(t.hot, c2[t.question], t.c2)
        p1 = (c1 - _by_count(c1, m["d1"])) / m["s1"] + m["free1"] / m["s1"] / m["v"]
        left = t.gb  # bigrams are sorted by it
        starts = _runs(left)
        size = _lengths(starts, len(left))
        s2 = np.add.reduceat(c2, starts).astype(np.float64)
        free2 = np.add.reduceat(_by_count(c2, m["d2"]), starts)
        for i in np.flatnonzero(t.hot[starts]).tolist():
            s, *x = m["spread"][int(t.hashes[left[starts[i]]].view(np.int64))]
            s2[i], free2[i] = s, sum(u * v for u, v in zip(m["d2"], x))
        s2, free2 = np.repeat(s2, size), np.repeat(free2, size)
        p2 = ((c2 - _by_count(c2, m["d2"])) / s2 + free2 / s2 * p1)[t.gram][t.type]
        c3, context = t.c3[t.type], t.context[t.type]
        c, s = c3 - t.own3, t.s3[context] - t.own_context
        free = sum(m["d3"][k - 1] * (t.m[k - 1][context] - (np.minimum(c3, 3) == k) + (np.minimum(c, 3) == k)) for k in (1, 2, 3))
        some = np.maximum(s, 1)
        p = np.where(s <= 0, p2, np.where(c > 0, (c - _by_count(c, m["d3"])) / some, 0.0) + free / some * p2)
        value = t.own3 * np.log(np.where(p > 0, p, p2))
        order = np.argsort(t.doc)
        starts = _runs(t.doc[order])
        doc, value = t.doc[order][starts], np.add.reduceat(value[order], starts)
        bounds = np.searchsorted(doc, t.first)
        return _table([{"key": src, "n": hi - lo, "payload": pack((doc[lo:hi] - first).astype(np.uint32), value[lo:hi])}
                       for src, first, lo, hi in zip(t.sources.tolist(), t.first.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())])
    return cell


def _total(table: pa.Table) -> pa.Table:
    """The documents of one encoding task: their sums of one pass."""
    total = np.zeros(0)
    for n, payload in zip(table.column("n").to_pylist(), table.column("payload").to_pylist()):
        (doc,), value = unpack(payload, n, "<u4")
        if len(doc) and doc[-1] >= len(total):
            total = np.concatenate([total, np.zeros(int(doc[-1]) + 1 - len(total))])
        total[doc] += value.view(np.float64)
    return _table([{"key": table.column("key")[0].as_py(), "n": len(total), "payload": pack(total.astype("<f8"))}])


def _named(table: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of one encoding task: their keys, and sums of all passes."""
    found = zip(table.column("base").to_pylist(), table.column("keys").to_pylist())
    every = [x[i:i + 32] for _, x in sorted(found) for i in range(0, len(x), 32)]
    total = np.zeros(len(every))
    for n, payload in zip(sums.column("n").to_pylist(), sums.column("payload").to_pylist()):
        (value,), _ = unpack(payload, n, "<f8")
        total[:n] += value
    return pa.table({"_q_k": pa.array(every, pa.binary()), "_q_s": total})


# ---- all texts

def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base statistics of every text; a task's most frequent words (as they
    are written: the list need not be right)."""
    names = ["_q_k", "_q_L", *STATISTICS, "top"]
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    more, size = [], 0

    def summed():
        if not more:
            return hashes, counts
        (h,), n = _summed([np.concatenate([hashes, *[x for x, _ in more]])], np.concatenate([counts, *[x for _, x in more]]))
        more.clear()
        keep = np.argsort(-n, kind="stable")[:COUNTED // 2]
        return h[keep], n[keep]

    for batch in batches:
        found = []
        for w, ids, different, values in text_statistics(batch.column(2)):
            found.append(values)
            more.append((_hashes(different), np.bincount(ids, minlength=len(different))))
            size += len(different)
            if size > COUNTED:
                (hashes, counts), size = summed(), 0
        stats = [pa.array(np.concatenate(x).astype(np.int64)) if found else pa.array([], pa.int64()) for x in zip(*found)] if found else []
        if found:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *stats, pa.nulls(batch.num_rows, pa.binary())], names)
    hashes, counts = summed()
    top = np.arange(min(len(counts), ESCAPE // 2))  # the most frequent come first
    if len(top):
        row = [pa.array([pack(hashes[top], counts[top])], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.string()),
                                          *[pa.array([len(top) if x == "n_words" else None], pa.int64()) for x in STATISTICS], *row], names)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            both, _ = unpack(payload, n, "<i8", "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in both], ["h", "n"])


def _numbers(survey: DataFrame, total: int, cell_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words' hashes by number, and the parts of each."""
    top = (survey.where(F.col("top").isNotNull()).select("top", "n_words").mapInArrow(_frequent, "h long, n long")
           .groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(ESCAPE - 2).toArrow())
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    # The marks stand where words of their number do: one of each a text.
    parts = np.maximum(n // (2 * cell_words), 1)
    return np.concatenate([h, [BOS, EOS]]), parts[parts > 1]  # the most frequent come first


def perplexity(rows: DataFrame, survey: DataFrame, passes: tuple[int, int], cell_words: int) -> DataFrame:
    """(_q_k, _q_s): each document's key and sum of log-probabilities, from
    ``rows`` (_q_k, _q_L, lower-cased text)."""
    spark = rows.sparkSession
    total = survey.where("top IS NULL").agg(F.coalesce(F.sum(F.col("n_words") + 1), F.lit(0))).first()[0]
    book, parts = _numbers(survey, total, cell_words)
    key_cells = max(1, -(-total // cell_words))

    def deal(count):
        return spark.sparkContext.broadcast(Deal(book, parts, max(1, -(-total // (count * cell_words))), key_cells, count))

    first, seen = deal(passes[0]), None
    # Codes do not depend on the passes.
    tokens = materialize(rows.mapInArrow(_encode(first), _TOKEN_ROWS), "lm-tokens")
    lines, counts = tokens.drop("keys"), scratch_path(spark, "lm-counts")
    for k in range(passes[0]):
        (lines.mapInArrow(_read(first, k, False), _ROWS).groupBy("lang", "key").applyInArrow(_count(first), _ROWS)
         .groupBy("lang", "key").applyInArrow(_merge_pass, _ROWS).write.parquet(f"{counts}/{k}"))
        done = spark.read.schema(_ROWS).parquet(f"{counts}/{k}")
        seen = done if seen is None else seen.unionByName(done)
    unigrams = materialize(seen.where("key >= 0").groupBy("lang", "key").applyInArrow(_merge, _ROWS), "lm-unigrams")
    sums = [F.sum(x).alias(x) for x in ("n", "s", "x1", "x2", "x3", "x4")]
    model: dict[str, dict] = {}
    for r in seen.where("key < 0").unionByName(unigrams.where("key < 0")).groupBy("lang", "key", "b").agg(*sums).collect():
        m = model.setdefault(r["lang"], {"spread": {}})
        n = [r["x1"], r["x2"], r["x3"], r["x4"]]
        if r["key"] == -4:
            m["spread"][r["b"]] = (r["s"], *n[:3])
        else:
            m[f"d{-r['key']}"] = _discounts(n)
        if r["key"] == -1:
            m["s1"], m["v"] = r["s"], r["n"]
            m["free1"] = sum(d * x for d, x in zip(m["d1"], (n[0], n[1], r["n"] - n[0] - n[1])))
    delete_path(spark, counts)  # the unigrams and the model hold what is needed
    second, model = deal(passes[1]), spark.sparkContext.broadcast(model)
    unigrams, out = unigrams.where("key >= 0"), None
    by = ("lang", "key")

    for k in range(passes[1]):
        trigrams = lines.mapInArrow(_read(second, k, True), _ROWS)
        asked = trigrams.groupBy(*by).applyInArrow(_ask(second), _ROWS)
        answers = asked.groupBy(*by).cogroup(unigrams.groupBy(*by)).applyInArrow(_answer, _ROWS)
        done = materialize(trigrams.groupBy(*by).cogroup(answers.groupBy(*by)).applyInArrow(_score(second, model), _ROWS)
                           .groupBy("key").applyInArrow(_total, _ROWS).select("key", "n", "payload"), "lm-sums")
        out = done if out is None else out.unionByName(done)
    return (tokens.select("src", "base", "keys").groupBy("src").cogroup(out.groupBy("key"))
            .applyInArrow(_named, "_q_k binary, _q_s double").groupBy("_q_k").agg(F.max("_q_s").alias("_q_s")))


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = 3.0,
                  passes: tuple[int, int] = (3, 6), cell_words: int = 500_000) -> DataFrame:
    """``docs`` with the base statistics, ``base_failed``, ``log_ppl``, the
    band of its language (``low``, ``high``) and ``kept``.

    ``passes``: how often all words are read to count and to score; more need
    less disk. ``cell_words``: about how many words a group of Spark's holds.
    """
    outputs = [*STATISTICS, "base_failed", "log_ppl", "low", "high", "kept"]
    rest = [c for c in docs.columns if c not in outputs]
    inner = {c: f"_q_c{i}" for i, c in enumerate(rest)}
    t, name = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{lang}`"), F.lit("\x00"))
    key = F.unhex(F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, t), 256)).alias("_q_k")
    columns = "_q_k binary, _q_L string, " + ", ".join(f"{x} long" for x in STATISTICS) + ", top binary"
    with freed_shuffles(docs.sparkSession):
        survey = materialize(docs.select(key, name.alias("_q_L"), t.alias("_q_text")).mapInArrow(_survey, columns), "quality-base")
        sums = perplexity(docs.select(key, name.alias("_q_L"), F.lower(t).alias("_q_text")), survey, passes, cell_words)
        scored = materialize(survey.where("top IS NULL").drop("top").join(sums, "_q_k", "left")
                             .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
                             .withColumn("log_ppl", -F.col("_q_s") / (F.col("n_words") + 1)), "quality-scored")
    fit = scored.where(~F.col("base_failed")).groupBy("_q_L").agg(
        F.percentile_approx("log_ppl", [0.25, 0.75], 10000).alias("_q_quartiles"))
    q1, q3 = F.col("_q_quartiles")[0], F.col("_q_quartiles")[1]
    bands = fit.select("_q_L", (q1 - width * (q3 - q1)).alias("low"), (q3 + width * (q3 - q1)).alias("high"))
    kept = (~F.col("base_failed")) & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    judged = scored.dropDuplicates(["_q_k"]).join(bands, "_q_L", "left").withColumn("kept", kept)
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in rest], key)
    return rows.join(judged, "_q_k").select(*[F.col(inner[c]).alias(c) for c in rest], *outputs)
