"""Operator 10, substring dedup by paragraph MinHash banding.

A paragraph is a line of at least ``least_words`` words. Its set of five-word
shingles gets ``BANDS`` bands of ``ROWS`` minimum hashes, which meets a pair at
similarity 0.8 with probability 0.999 and makes few false meetings. Different
lines that share a band are compared by their exact Jaccard similarity, and the
links' components become classes. Equal lines are one line throughout. A band
with very many lines is cut into chunks, and every pair of chunks is compared.
Shorter lines are no paragraphs; a smaller ``least_words``, down to five, bands
and compares them in the same exact way.

A passage that is quoted inside longer lines changes each line too much for
that. So sentences of at least five words, with shorter ones before them, are
read as paragraphs of their own, at similarity 1: runs of consecutive ones that
an earlier document has, ``least_words`` words or more together, are removed too.

A passage need not begin or end with a sentence or a line. So each window of
``PASSAGE`` words, wherever it lies, is filed under the eight-word gram of least
hash that it holds; equal windows are filed alike. The windows under one gram
occurrence form a segment. Equal segments are settled by their hashes, different
segments of one gram window by window; a gram with very many is counted first and
goes through an aggregate of windows instead. Every word that lies in a window of
an earlier document is removed, which is each common run of ``PASSAGE`` words or
more to its full length.

One pass over the texts hashes each word once and takes lines, sentences and
segments from sums of the same hashes. Words are compared in lower case.

The first document of a class (by id, then text) keeps its paragraph; later
documents lose theirs. Repeats inside one document are left alone. Defined
cases: null and empty texts have no paragraphs; rows that repeat id and text
alike are one document; ids of any type count in their own order, null ids last;
an empty table gives an empty result; other columns are never read, whatever
their names. Equality of words is that of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.substrings import BLOCK_BYTES, _runs, apart, crowded, without_spans
from chronofold.llm.tables import connected_components, discard, give_back, numbered, release, slices, stored, stored_parts

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
LEAST_WORDS = 20
#: Different lines of one band that one task compares at most, on average, from each of two chunks.
CHUNK = 512
#: Bands that lines share, and repeated lines, that may be broadcast (16 and 32 bytes each).
MOST_BROADCAST = 1_000_000
#: Words of a window, and of the grams that windows are filed under.
PASSAGE, GRAM = 50, 8
#: Rows of one gram that a task may sort, and different segments that one may compare; beyond, windows go through an aggregate.
MOST_ROWS, CROWD = 50_000, 2_000
#: Words that a worker remembers the hashes of.
MOST_WORDS = 200_000
#: Windows of one document that are indexed at a time; places take the low bits of a gram's sort key.
STRETCH, PLACE_BITS = 1 << 17, 18
_MIX = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240301)
_A = (_RNG.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)

#: Powers of the polynomial's base and of its inverse; longer texts make more.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers up and down."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_MIX, pow(_MIX, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), x, np.uint64)]))
    return _POWERS[0], _POWERS[1]


# The characters that str.split() takes as white space.
_SPACE = np.zeros(0x3002, bool)
_SPACE[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _shingled(h: np.ndarray) -> np.ndarray:
    """Hashes of each five words in a row."""
    out = h[: len(h) - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - SHINGLE + 1 + j]
    return _mixed(out)


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct shingles of a line's word hashes; a shorter line is one shingle."""
    if len(h) <= SHINGLE:
        h = np.concatenate([h, np.full(SHINGLE - len(h), len(h), np.uint64)])
    return np.unique(_shingled(h))


def bands(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(line, band) keys of many lines of ``size`` words each, at least five, from all their word hashes: minima of multiply-add hashes over the shingles."""
    shingle = _shingled(h)
    first = np.cumsum(size) - size
    inside = np.ones(len(shingle), bool)  # shingles that run over a line's end do not count
    for j in range(1, SHINGLE):
        at = first[1:] - j
        inside[at[at < len(inside)]] = False
    x = shingle[inside]
    starts = np.cumsum(size - SHINGLE + 1) - (size - SHINGLE + 1)
    keys = np.empty((len(size), BANDS), np.uint64)
    for i in range(BANDS):
        k = np.full(len(size), i + 1, np.uint64)
        for r in range(ROWS):
            k = (k ^ (k >> np.uint64(31))) * np.uint64(_MIX) + np.minimum.reduceat(x * _A[i * ROWS + r] + _B[i * ROWS + r], starts)
        keys[:, i] = k
    return keys.view(np.int64)


def _edges(space: np.ndarray) -> np.ndarray:
    """Places where words begin and end, in turn."""
    outside = np.ones(len(space) + 2, bool)
    outside[1:-1] = space
    return np.flatnonzero(outside[1:] != outside[:-1])


def _places(t: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of ``t.split()``."""
    if t.isascii():
        edge = _edges(_SPACE[np.frombuffer(t.encode(), np.uint8)])
    else:
        c = np.frombuffer(t.encode("utf-32-le"), "<u4")
        edge = _edges(_SPACE[np.minimum(c, 0x3001)])
        at = np.zeros(len(c) + 1, np.int64)
        np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), out=at[1:])
        edge = at[edge]
    return edge[::2], edge[1::2]


def _word_hashes(t: str, known: _Hashes) -> np.ndarray:
    words = t.lower().split()
    if len(known) > MOST_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _prefix(h: np.ndarray) -> np.ndarray:
    """Sums p of a polynomial hash: that of words a to z is (p[z] - p[a]) * down[a]."""
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=p[1:])
    return p


def _keys(p: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the words from a to z, z excluded."""
    return _mixed((p[z] - p[a]) * _powers(len(p))[1][a] + (z - a).astype(np.uint64)).view(np.int64)


def _segments(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the gram, hash of the segment's words, first window, windows) of each segment of a document's word hashes."""
    found, spare, low = [], PASSAGE - GRAM + 1, np.uint64(PLACE_BITS)
    for at in range(0, max(len(h) - PASSAGE + 1, 0), STRETCH):
        p = _prefix(h[at : at + STRETCH + PASSAGE - 1])
        down = _powers(len(p))[1]
        g = (p[GRAM:] - p[:-GRAM]) * down[: len(p) - GRAM]
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        least = (g >> low << low) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while 2 * width <= spare:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if spare > width:
            least = np.minimum(least[: len(least) - (spare - width)], least[spare - width :])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        n = np.append(first[1:], len(place)) - first
        seg = (p[first + n + PASSAGE - 1] - p[first]) * down[first] + n.astype(np.uint64)
        seg = (seg ^ (seg >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        found.append((g[place[first]].view(np.int64), seg.view(np.int64), first + at, n))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


_FILED = [("gram", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("n", pa.int32())]
_FILED_SQL = "gram long, seg long, doc long, text long, start long, end long, first long, n int"
_SPAN_SQL = "doc long, text long, start long, end long"
#: Kinds of rows that the pass over the texts makes.
LINES, SENTENCES, SEGMENTS, SPANS, LATER = range(5)
_ROW = [("kind", pa.int32()), ("key", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("ordinal", pa.int64()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))]
_ROW_SQL = "kind int, key long, seg long, doc long, text long, start long, end long, ordinal long, n int, bands array<long>"


def _row(kind: int, m: int, **given) -> pa.RecordBatch:
    """A batch of ``m`` rows of one kind; what is not given is null."""
    cols = [pa.array(np.full(m, kind, np.int32))]
    for name, t in _ROW[1:]:
        c = given.get(name)
        cols.append(pa.nulls(m, t) if c is None else c if isinstance(c, pa.Array) else pa.array(np.asarray(c), t))
    return pa.RecordBatch.from_arrays(cols, [n for n, _ in _ROW])


def _cut(doc, text, start, end):
    """A batch of spans to remove: rows without a gram."""
    m = len(doc)
    none = [pa.nulls(m, k) for _, k in _FILED]
    return pa.RecordBatch.from_arrays([none[0], none[1], *(pa.array(c, pa.int64()) for c in (doc, text, start, end)), none[6], none[7]], [k for k, _ in _FILED])


_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def _parts(t: str, h: np.ndarray, a: np.ndarray, z: np.ndarray, least: int):
    """Lines (key, first word, end word, first byte, end byte) of a text, then sentences (key, first byte, end byte, ordinal, words)."""
    raw = np.frombuffer(t.encode(), np.uint8)
    p = _prefix(h)
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    ws, we = np.searchsorted(a, starts), np.searchsorted(a, ends)
    some = we > ws
    starts, ends, ws, we = (c[some] for c in (starts, ends, ws, we))
    last = np.zeros(len(h), bool)
    last[we - 1] = True
    stop = np.flatnonzero(last | _END[raw[z - 1]])
    kept = stop[stop - np.concatenate([[-1], stop[:-1]]) >= SHINGLE]
    of = np.searchsorted(we, kept, side="right")  # the line of each kept sentence
    before = np.concatenate([[-1], kept[:-1]])
    first = np.maximum(before + 1, ws[of])
    ordinal = np.cumsum(1 + (first != before + 1))
    long_ = we - ws >= least
    lines = (_keys(p, ws[long_], we[long_]), ws[long_], we[long_], starts[long_], ends[long_])
    return lines, (_keys(p, first, kept + 1), a[first], z[kept], ordinal, kept + 1 - first)


def _scan(batches, least: int):
    """Rows of each kind for each block of text; what a block itself settles is not sent on."""
    known = _Hashes()
    for b in batches:
        order = np.lexsort((b.column(1).to_numpy(), b.column(0).to_numpy()))
        sizes = pc.binary_length(b.column(2)).to_numpy()
        i = 0
        while i < len(order):
            who, lines, sentences, segments, words, total = [], [], [], [], [], 0
            seen: set[int] = set()
            while i < len(order) and (not total or total + sizes[order[i]] <= BLOCK_BYTES):
                k = int(order[i])
                i += 1
                me = (b.column(0)[k].as_py(), b.column(1)[k].as_py())
                if who and who[-1] == me:
                    continue
                total += int(sizes[k]) + 1
                t = b.column(2)[k].as_py()
                h = _word_hashes(t, known)
                if len(h) < SHINGLE:
                    continue
                who.append(me)
                rank = len(who) - 1
                a, z = _places(t)
                (key, ws, we, start, end), (skey, sa, sz, ordinal, n) = _parts(t, h, a, z, least)
                fresh = np.zeros(len(key), bool)
                for j, x in enumerate(key.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[j] = True
                        words.append(h[ws[j] : we[j]])
                lines.append((key, np.full(len(key), rank), start, end, fresh))
                sentences.append((skey, np.full(len(skey), rank), sa, sz, ordinal, n))
                if len(h) >= PASSAGE:
                    gram, seg, first, n = _segments(h)
                    segments.append((gram, seg, np.full(len(n), rank), a[first], z[first + n + PASSAGE - 2], first, n))
            if not who:
                continue
            docs, texts = (np.array(x, np.int64) for x in zip(*who))
            key, rank, start, end, fresh = (np.concatenate(x) for x in zip(*lines))
            lines.clear()
            yield from _line_rows(key, docs[rank], texts[rank], start, end, fresh, words)
            words.clear()
            seen.clear()
            key, rank, start, end, ordinal, n = (np.concatenate(x) for x in zip(*sentences))
            sentences.clear()
            later = rank != _first_of(rank, key)
            for kind, mask in ((SENTENCES, ~later), (LATER, later)):
                at = np.flatnonzero(mask)
                for k in range(0, len(at), 65536):
                    s = at[k : k + 65536]
                    yield _row(kind, len(s), key=key[s], doc=docs[rank[s]], text=texts[rank[s]], start=start[s], end=end[s], ordinal=ordinal[s], n=n[s].astype(np.int32))
            if not segments:
                continue
            gram, seg, rank, start, end, first, n = (np.concatenate(x) for x in zip(*segments))
            segments.clear()
            again = rank != _first_of(rank, seg, gram)
            at = np.flatnonzero(~again)
            for k in range(0, len(at), 65536):
                s = at[k : k + 65536]
                yield _row(SEGMENTS, len(s), key=gram[s], seg=seg[s], doc=docs[rank[s]], text=texts[rank[s]], start=start[s], end=end[s], ordinal=first[s], n=n[s].astype(np.int32))
            if again.any():
                r, a, z = rank[again], start[again], end[again]
                at = np.flatnonzero(_runs(a, z, r))
                yield _row(SPANS, len(at), doc=docs[r[at]], text=texts[r[at]], start=a[at], end=np.maximum.reduceat(z, at))
                del r, a, z
            del gram, seg, rank, start, end, first, n, again
    known.clear()
    give_back()


def _first_of(rank: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the smallest rank of the rows with equal keys; ranks ascend."""
    by = np.lexsort(keys)  # stable, so the smallest rank comes first
    new = np.zeros(len(by), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[by[1:]] != k[by[:-1]]
    out = np.empty(len(by), rank.dtype)
    out[by] = rank[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _line_rows(key, doc, text, start, end, fresh, words):
    """Rows of lines; the bands only of those that are new to the block, some 400,000 words at a time."""
    size = np.array([len(w) for w in words], np.int64)
    found = np.empty((len(words), BANDS), np.int64)
    part = np.cumsum(size) // 400_000
    for k in np.unique(part):
        at = np.flatnonzero(part == k)
        found[at] = bands(np.concatenate(words[at[0] : at[-1] + 1]), size[at])
    done = 0
    for k in range(0, len(key), 16384):
        s = slice(k, k + 16384)
        own = int(fresh[s].sum())
        ends = np.zeros(len(key[s]) + 1, np.int32)
        ends[1:] = np.cumsum(fresh[s]) * BANDS
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[done : done + own].ravel()), mask=pa.array(~fresh[s], pa.bool_()))
        done += own
        yield _row(LINES, len(key[s]), key=key[s], doc=doc[s], text=text[s], start=start[s], end=end[s], bands=lists)


def _later(batches):
    """Over sentences sorted by key, document: those that an earlier document has."""
    key, first = None, None
    for b in batches:
        keys, docs, texts = (b.column(k).to_numpy() for k in range(3))
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        if len(keys):
            new[0] = key is None or keys[0] != key
            at = np.where(new, np.arange(len(keys)), -1)
            at = np.maximum.accumulate(at)
            d, t = np.where(at >= 0, docs[at], first[0] if first else 0), np.where(at >= 0, texts[at], first[1] if first else 0)
            later = (d != docs) | (t != texts)
            key, first = keys[-1], (d[-1], t[-1])
            kept = b.filter(pa.array(later))
            yield pa.RecordBatch.from_arrays(kept.columns[1:7], ["doc", "text", "start", "end", "ordinal", "n"])


def _settled(batches):
    """Over rows sorted by gram, segment, document: spans of segments that an earlier document has, and the other segments of grams with different ones."""
    names = [c for c, _ in _FILED]
    last, owner, held, mixed = None, None, [], False  # the key before, its first document; rows of a gram with one segment so far
    for b in batches:
        spans = b.filter(b.column(0).is_null())
        if spans.num_rows:
            yield pa.RecordBatch.from_arrays(spans.columns, names)
        b = pa.RecordBatch.from_arrays(b.filter(b.column(0).is_valid()).columns, names)
        if not b.num_rows:
            continue
        gram, seg, doc, text, start, end = (b.column(k).to_numpy() for k in range(6))
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_gram[0] = last is None or gram[0] != last[0]
        new = new_gram.copy()
        new[1:] |= seg[1:] != seg[:-1]
        new[0] |= last is None or seg[0] != last[1]
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        d, t = (np.where(at >= 0, c[at], owner[k] if owner else 0) for k, c in enumerate((doc, text)))
        later = (d != doc) | (t != text)
        last, owner = (gram[-1], seg[-1]), (d[-1], t[-1])
        if later.any():
            yield _cut(doc[later], text[later], start[later], end[later])
        group = np.cumsum(new_gram)  # 0: the gram of the batch before
        kinds = np.bincount(group, new, int(group[-1]) + 1)
        open_ = kinds > 1
        open_[0] = mixed or kinds[0] > 0
        if open_[0] and not new_gram[0]:
            yield from held
            held = []
        emit = ~later & open_[group]
        if emit.any():
            yield b.filter(pa.array(emit))
        mixed = bool(open_[group[-1]])
        if group[-1] or mixed:
            held = []
        if not mixed:
            held.append(b.filter(pa.array(~later & (group == group[-1]))))


def _window_hashes(batches):
    """Each listed segment with the hashes, first bytes and end bytes of its windows."""
    known = _Hashes()
    names, kinds = ["gram", "doc", "text", "first", "hashes", "starts", "ends"], [pa.int64()] * 4 + [pa.binary()] * 3
    for b in slices(batches):
        cols = [[] for _ in names]
        for doc, text, t, segs in zip(*(c.to_pylist() for c in b.columns)):
            h = _word_hashes(t, known)
            a, z = _places(t)
            for s in segs:
                f, n = s["first"], s["n"]
                p = _prefix(h[f : f + n + PASSAGE - 1])
                w = (p[PASSAGE:] - p[:-PASSAGE]) * _powers(n)[1][:n]
                vals = (s["gram"], doc, text, f, w.tobytes(), a[f : f + n].astype(np.int64).tobytes(), z[f + PASSAGE - 1 : f + n + PASSAGE - 1].astype(np.int64).tobytes())
                for c, v in zip(cols, vals):
                    c.append(v)
            if len(cols[0]) > 8_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                cols = [[] for _ in names]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
    known.clear()
    give_back()


def _compared(batches):
    """Over segments sorted by gram, document: spans of windows that the gram has in an earlier document."""
    gram, seen = None, {}
    for b in slices(batches, 1024):
        cols = [[] for _ in range(4)]
        for g, doc, text, _, hashes, starts, ends in zip(*(c.to_pylist() for c in b.columns)):
            if g != gram:
                gram, seen = g, {}
            me, open_at = (doc, text), None
            later = [seen.setdefault(w, me) != me for w in np.frombuffer(hashes, np.uint64).tolist()]
            if True in later:
                a, z = np.frombuffer(starts, np.int64), np.frombuffer(ends, np.int64)
                for i, x in enumerate([*later, False]):
                    if x and open_at is None:
                        open_at = i
                    elif not x and open_at is not None:
                        for c, v in zip(cols, (doc, text, int(a[open_at]), int(z[i - 1]))):
                            c.append(v)
                        open_at = None
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "text", "start", "end"])


def _windows(batches):
    """One row a window: hash, document, text, first and end byte."""
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            s = b.slice(i, 2048)
            x, a, z = (np.frombuffer(b"".join(s.column(k).to_pylist()), np.int64) for k in (4, 5, 6))
            n = np.array([len(v) // 8 for v in s.column(4).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x, np.repeat(s.column(1).to_numpy(), n), np.repeat(s.column(2).to_numpy(), n), a, z)], ["x", "doc", "text", "start", "end"])


def repeated_passages(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc, text, start, end): byte spans of ``rows`` (doc, text, body), with their ``segments``, that cover each window of ``PASSAGE`` words that an earlier document has."""
    spark = rows.sparkSession
    crowds = crowded(segments, MOST_ROWS)
    release(spark)
    calm, hot = apart(segments, crowds)
    dealt = calm.repartition("gram").sortWithinPartitions("gram", "seg", "doc", "text", "start")
    settled = stored(dealt.mapInArrow(_settled, _FILED_SQL), "passages")
    segment = ["gram", "doc", "text", "first", "n"]
    hot = stored(hot.select(segment).distinct(), "crowded-passages")
    del calm, dealt
    release(spark)

    def fetch(wanted: DataFrame, then, schema: str) -> DataFrame:
        lists = wanted.groupBy(F.col("doc").alias("d"), F.col("text").alias("t")).agg(F.collect_list(F.struct("gram", "first", "n")).alias("segs"))
        once = rows.join(lists, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t"))).select("doc", "text", "body", "segs")
        return once.mapInArrow(lambda x: then(_window_hashes(x)), schema)

    whole = settled.where("gram is null").select("doc", "text", "start", "end")
    mixed = settled.where("gram is not null").select(segment)
    mixed, more = apart(mixed, crowded(mixed, CROWD))
    hot = hot.unionByName(more)
    fetched = stored(fetch(mixed, lambda x: x, "gram long, doc long, text long, first long, hashes binary, starts binary, ends binary"), "passage-windows", texts=True)
    release(spark)
    parts = [whole, stored(fetched.repartition("gram").sortWithinPartitions("gram", "doc", "text", "first").mapInArrow(_compared, _SPAN_SQL), "compared-passages")]
    discard(fetched)
    release(spark)
    if not hot.isEmpty():
        windows = stored(fetch(hot, _windows, f"x long, {_SPAN_SQL}"), "crowded-passage-windows", texts=True)
        firsts = windows.groupBy("x").agg(F.min(F.struct("doc", "text")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
        firsts = stored(firsts.select("x", F.col("f.doc").alias("fd"), F.col("f.text").alias("ft")), "first-passages")
        later = windows.join(firsts, "x").where("not (doc = fd and text = ft)").select("doc", "text", "start", "end")
        parts.append(stored(later.distinct(), "later-passages"))
        discard(windows, firsts)
        release(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _similar(batches):
    """Links of each group of lines: a spanning forest of the pairs at ``SIMILAR`` or more."""
    known = _Hashes()
    for b in slices(batches, 256):
        a, z = [], []
        for group in b.column(0).to_pylist():
            lines = sorted({g["line"]: g["words"] for g in group}.items())
            sets = [shingles(_word_hashes(w, known)) for _, w in lines]
            if len(sets) == 2:
                hit = len(np.intersect1d(*sets, assume_unique=True))
                if hit >= SIMILAR * (len(sets[0]) + len(sets[1]) - hit) - 1e-9:
                    a.append(lines[0][0]), z.append(lines[1][0])
                continue
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            open_ = np.ones(len(sets), bool)
            for f in range(len(sets)):
                if not open_[f]:
                    continue
                open_[f] = False
                queue = [f]
                while queue:
                    x = queue.pop()
                    live = open_[owner]
                    hit = np.bincount(owner[live][np.isin(flat[live], sets[x])], minlength=len(sets))
                    near = np.flatnonzero(open_ & (hit >= SIMILAR * (size + size[x] - hit) - 1e-9))
                    open_[near] = False
                    queue += near.tolist()
                    a += [lines[x][0]] * len(near)
                    z += [lines[y][0] for y in near]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])
    known.clear()
    give_back()


def _texts(batches):
    for b in slices(batches):
        k, w = [], []
        for raw, spans in zip(*(c.to_pylist() for c in b.columns)):
            for s in spans:
                k.append(s["line"])
                w.append(" ".join(raw[s["start"] : s["end"]].decode("utf-8", "replace").lower().split()))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(w, pa.string())], ["line", "words"])


def _small(df: DataFrame) -> DataFrame:
    """A stored table of numbers, broadcast if it has at most ``MOST_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def line_classes(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, component) of the linked ones of ``lines`` (line, doc, text, start, end, bands; the bands once or more for equal lines) of ``docs`` (doc, text, body)."""
    spark = docs.sparkSession
    keyed = lines.where("bands is not null").select("line", F.explode("bands").alias("band"))
    # Most bands have one line; they are gone after an aggregate that sums up before it deals.
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("a"), F.max("line").alias("z")).where("a <> z").select(F.col("band").alias("shared"), "n")
    shared = stored(shared, "shared-bands")
    release(spark)
    chunks = F.when(F.col("n") > 2 * CHUNK, F.ceil(F.col("n") / CHUNK).cast("int"))
    met = keyed.join(_small(shared), F.col("band") == F.col("shared")).select("band", "line", chunks.alias("chunks"))
    met = stored(met, "lines-met")
    plain = met.where("chunks is null").groupBy("band").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    dealt = met.where("chunks is not null").withColumn("c", F.pmod(F.xxhash64("line"), F.col("chunks")).cast("int"))
    both = dealt.select("band", "line", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    hot = both.groupBy("band", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y")).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    groups = stored(plain.select("lines").unionByName(hot.select("lines")).distinct().withColumn("g", F.xxhash64("lines")), "paragraph-groups")
    discard(shared, met)
    in_group = groups.select("g", F.explode("lines").alias("line"))
    wanted = stored(in_group.select("line").distinct(), "lines-wanted")
    sample = lines.select("line", "doc", "text", "start", "end").join(_small(wanted), "line", "left_semi").groupBy("line").agg(F.min(F.struct("doc", "text", "start", "end")).alias("s"))
    lists = sample.groupBy(F.col("s.doc").alias("d"), F.col("s.text").alias("t")).agg(F.collect_list(F.struct("line", "s.start", "s.end")).alias("spans"))
    fetched = docs.join(lists, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t"))).select(F.encode("body", "UTF-8").alias("raw"), "spans")
    texts = stored(fetched.mapInArrow(_texts, "line long, words string").dropDuplicates(["line"]), "paragraph-texts", texts=True)
    release(spark)
    full = in_group.join(texts, "line").groupBy("g").agg(F.collect_list(F.struct("line", "words")).alias("lines")).select("lines")
    links = stored(full.mapInArrow(_similar, "a long, b long"), "paragraph-links", texts=True)
    discard(groups, wanted, texts)
    release(spark)
    return stored(connected_components(links, "paragraphs"), "paragraph-classes")


def _repeated_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, text, start, end): lines that an earlier document has, alike or similar."""
    classes = line_classes(docs, lines)
    members = lines.select("line", "doc", "text", "start", "end")
    firsts = stored(members.groupBy("line").agg(F.min(F.struct("doc", "text")).alias("f"), F.count(F.lit(1)).alias("n")), "line-firsts")
    named = firsts.join(classes, F.col("line") == F.col("node"), "left").select("line", "f", "n", F.coalesce("component", "line").alias("c"))
    best = named.groupBy("c").agg(F.min("f").alias("best"), F.sum("n").alias("all")).where("all > 1")
    best = stored(named.join(best.withColumnRenamed("c", "k"), F.col("c") == F.col("k")).select(F.col("line").alias("l"), F.col("best.doc").alias("fd"), F.col("best.text").alias("ft")), "repeated-lines")
    out = members.join(_small(best), F.col("line") == F.col("l")).where("not (doc = fd and text = ft)").select("doc", "text", "start", "end")
    out = stored(out, "repeated-paragraphs")
    discard(firsts, best)
    release(docs.sparkSession)
    return out


def _sentence_runs(batches, least: int):
    """Over each document's sentences that an earlier one has: runs of consecutive ones with ``least`` words or more."""
    for b in slices(batches, 1024):
        cols = [[] for _ in range(4)]
        for doc, text, s in zip(*(c.to_pylist() for c in b.columns)):
            found, at = [], None
            for x in s:
                if at is not None and x["ordinal"] == at:
                    continue  # from another row of the same id and text
                if at is not None and x["ordinal"] == at + 1:
                    found[-1][1], found[-1][2] = x["end"], found[-1][2] + x["n"]
                else:
                    found.append([x["start"], x["end"], x["n"]])
                at = x["ordinal"]
            for start, end, n in found:
                if n >= least:
                    for c, v in zip(cols, (doc, text, start, end)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "text", "start", "end"])


def _repeated_sentences(first: DataFrame, later: DataFrame, least: int) -> DataFrame:
    """(doc, text, start, end): runs of consecutive sentences that earlier documents have. ``later`` were settled by their own block."""
    columns = ["doc", "text", "start", "end", "ordinal", "n"]
    dealt = first.select("key", *columns).repartition("key").sortWithinPartitions("key", "doc", "text")
    found = stored(dealt.mapInArrow(_later, "doc long, text long, start long, end long, ordinal long, n int"), "later-sentences")
    del dealt
    release(first.sparkSession)
    per_doc = found.unionByName(later.select(columns)).groupBy("doc", "text").agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end", "n"))).alias("s"))
    out = stored(per_doc.mapInArrow(lambda x: _sentence_runs(x, least), _SPAN_SQL), "repeated-sentences")
    discard(found)
    release(first.sparkSession)
    return out


def repeated_paragraphs(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, text, start, end): byte spans of ``rows`` (doc, text, body) that an earlier document has too."""
    if least_words < SHINGLE:
        raise ValueError(f"paragraphs have at least {SHINGLE} words")
    docs = rows.select("doc", "text", "body")
    parts = stored_parts(docs.mapInArrow(lambda x: _scan(x, least_words), _ROW_SQL), "paragraphs", "kind", 5)
    lines = _repeated_lines(docs, parts[LINES].withColumnRenamed("key", "line"))
    discard(parts[LINES])
    sentences = _repeated_sentences(parts[SENTENCES], parts[LATER], least_words)
    discard(parts[SENTENCES], parts[LATER])
    segments = parts[SEGMENTS].select(F.col("key").alias("gram"), "seg", "doc", "text", "start", "end", F.col("ordinal").alias("first"), "n")
    passages = repeated_passages(docs, segments)
    spans = lines.unionByName(sentences).unionByName(passages).unionByName(parts[SPANS].select("doc", "text", "start", "end"))
    spans = stored(spans, "repeated-spans")
    discard(parts[SEGMENTS], parts[SPANS])
    return spans


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256; ``with_bytes`` adds ``kept``."""
    rows = numbered(docs, id_col, text_col)
    return without_spans(rows, repeated_paragraphs(rows, least_words), id_col, with_bytes)
