"""Operator 2, removal of every byte that an earlier 100-byte string covers.

Each window of ``length`` bytes is filed under the rarest-looking gram it holds:
the ``GRAM``-byte string of least hash, leftmost on ties. The choice depends on
the window's bytes alone, so equal windows of any documents are filed under equal
grams and only windows that share a gram need comparing. The windows that one
gram occurrence takes form a segment.

1. Equal segments (128 bits of hash) have equal windows: all but the earliest
   are removed whole. Each task does this for its own block of text first, so a
   copied passage leaves one row a block, not one a copy.
2. Grams that still have two different segments keep them; their bytes are
   fetched and windows at the same place are compared byte by byte, in the order
   of documents and starts.

Grams with more than ``MOST_ROWS`` segments, such as a line that every document
has, are counted first and never dealt by gram, and grams that still have more than
``CROWD`` different segments after step 1 are not compared in one task: the segments of
both are compared window by window through an aggregate, which no hot key can hold up.

Defined cases: texts under ``length`` bytes, null or empty lose nothing. Rows
that repeat id and text alike are one document and get the same result. Rows of
one id with different texts are ordered by a hash of the text. Ids of any type
count in their own order; null ids come last. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.tables import discard, numbered, release, slices, stored

LENGTH, GRAM = 100, 32
#: Rows of one gram that a task may sort, and different segments that one may compare.
MOST_ROWS, CROWD = 50_000, 2_000
#: Crowded grams that may be broadcast.
MOST_CROWDS = 1_000_000
BLOCK_BYTES = 24 << 20
#: A stretch of one document that is indexed at a time; places take the low bits of a gram's sort key.
STRETCH_BITS = 20
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_MIX = 0x9E3779B97F4A7C15


def _rolling(b: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all ``length``-byte strings, by doubling."""
    parts, have, out, x, step, width = length, 0, None, _BYTE[b], _MIX, 1
    while parts:
        if parts & 1:
            if out is None:
                out, have = x, width
            else:
                n = len(b) - have - width + 1
                out = out[:n] * np.uint64(step) + x[have : have + n]
                have += width
        parts >>= 1
        if parts:
            x = x[:-width] * np.uint64(step) + x[width:]
            step, width = step * step % (1 << 64), width * 2
    return out


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash of the gram, first window, windows, place of the gram) of each segment of a document."""
    found, spare = [], length - gram + 1
    stretch = (1 << STRETCH_BITS) - length
    for at in range(0, max(len(raw) - length + 1, 0), stretch):
        b = np.frombuffer(raw[at : at + stretch + length - 1], np.uint8)
        h = _rolling(b, gram)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = np.uint64(STRETCH_BITS)
        least = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= spare:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if spare > width:
            least = np.minimum(least[: len(least) - (spare - width)], least[spare - width :])
        place = (least & np.uint64((1 << STRETCH_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        n = np.diff(np.append(first, len(place)))
        found.append((h[place[first]], first + at, n, place[first] + at))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows at which a new run begins when spans, sorted by document and start, are merged."""
    far = doc.astype(np.int64) << 40  # keeps documents of one block apart
    new = np.ones(len(start), bool)
    new[1:] = (start + far)[1:] > np.maximum.accumulate(end + far)[:-1]
    return new


_SPAN = [("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
_FILED = "gram long, seg long, doc long, text long, start long, n int, off int, end long"


def _filed(batches, length: int):
    """Rows of segments, the earliest of each in a block of text, and of spans (gram null) that the block itself removes."""
    for b in batches:
        sizes = pc.binary_length(b.column(2)).to_numpy()
        i = 0
        while i < len(sizes):
            j, total = i, 0
            while j < len(sizes) and (j == i or total + sizes[j] <= BLOCK_BYTES):
                total, j = total + sizes[j], j + 1
            ids, texts = b.column(0).slice(i, j - i).to_numpy(), b.column(1).slice(i, j - i).to_numpy()
            order = np.lexsort((texts, ids))
            keep = [k for p, k in enumerate(order) if not p or (ids[k], texts[k]) != (ids[order[p - 1]], texts[order[p - 1]])]
            cols, segs = [], []
            for rank, k in enumerate(keep):
                raw = b.column(2)[int(i + k)].as_py()
                g, first, n, place = segments(raw, length)
                if len(g):
                    cols.append((g.view(np.int64), np.full(len(g), rank), first, n, place - first))
                    segs += [xxhash.xxh3_64_intdigest(raw[a:z]) for a, z in zip(first.tolist(), (first + n + length - 1).tolist())]
            i = j
            if not cols:
                continue
            gram, rank, first, n, off = (np.concatenate(x) for x in zip(*cols))
            seg = np.array(segs, np.uint64).view(np.int64)
            by = np.lexsort((seg, gram))  # stable, so the earliest comes first
            again = np.zeros(len(by), bool)
            again[by[1:]] = (gram[by[1:]] == gram[by[:-1]]) & (seg[by[1:]] == seg[by[:-1]])
            d, t = ids[keep], texts[keep]
            stay = np.flatnonzero(~again)
            for k in range(0, len(stay), 65536):
                s = stay[k : k + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[s]), pa.array(seg[s]), pa.array(d[rank[s]]), pa.array(t[rank[s]]), pa.array(first[s]), pa.array(n[s].astype(np.int32)), pa.array(off[s].astype(np.int32)), pa.nulls(len(s), pa.int64())],
                    ["gram", "seg", "doc", "text", "start", "n", "off", "end"],
                )
            if again.any():
                r, a, z = rank[again], first[again], (first + n + length - 1)[again]
                new = _runs(a, z, r)
                at = np.flatnonzero(new)
                z = np.maximum.reduceat(z, at)
                m = len(at)
                none = lambda kind: pa.nulls(m, kind)
                yield pa.RecordBatch.from_arrays(
                    [none(pa.int64()), none(pa.int64()), pa.array(d[r[at]]), pa.array(t[r[at]]), pa.array(a[at]), none(pa.int32()), none(pa.int32()), pa.array(z)],
                    ["gram", "seg", "doc", "text", "start", "n", "off", "end"],
                )


def _settle(batches, length: int):
    """Over rows sorted by gram, segment, document, start: spans of later equal segments (end set), and grams' different segments."""
    names = ["gram", "seg", "doc", "text", "start", "n", "off", "end"]
    kinds = [np.int64] * 5 + [np.int32] * 2 + [np.int64]
    last, held, held_open = None, None, False  # the sort key before; a segment that waits for its gram's next
    row = None  # the row before: a row that repeats id and text files the same segments at the same places

    def out(cols):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], names)

    for b in batches:
        spans = b.filter(b.column(0).is_null())
        if spans.num_rows:
            yield pa.RecordBatch.from_arrays(spans.columns, names)
        b = b.filter(b.column(0).is_valid())
        if not b.num_rows:
            continue
        gram, seg, doc, text, start, n, off = (b.column(k).to_numpy() for k in range(7))
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1])
        fresh[0] = row != (gram[0], seg[0], doc[0], text[0], start[0])
        row = (gram[-1], seg[-1], doc[-1], text[-1], start[-1])
        if not fresh.all():
            gram, seg, doc, text, start, n, off = (c[fresh] for c in (gram, seg, doc, text, start, n, off))
        if not len(gram):
            continue
        first_gram = np.ones(len(gram), bool)
        first_gram[1:] = gram[1:] != gram[:-1]
        first_seg = first_gram.copy()
        first_seg[1:] |= seg[1:] != seg[:-1]
        if last is not None:
            first_gram[0] = gram[0] != last[0]
            first_seg[0] = first_gram[0] or seg[0] != last[1]
        last = (gram[-1], seg[-1])
        again = ~first_seg
        if again.any():
            zero = np.zeros(int(again.sum()), np.int64)
            cut = out([zero, zero, doc[again], text[again], start[again], zero, zero, (start + n + length - 1)[again]])
            yield cut.set_column(0, "gram", pa.nulls(cut.num_rows, pa.int64()))
        at = np.flatnonzero(first_seg)
        if not len(at):
            continue
        rows = [c[at] for c in (gram, seg, doc, text, start, n, off)]
        joins = ~first_gram[at]  # its gram has an earlier segment
        if held is not None:
            if joins[0]:
                held_open = True
            if held_open:
                yield out([np.array([x]) for x in held] + [np.array([-1])])
        some = joins.copy()
        some[:-1] |= joins[1:]
        emit = some[:-1]
        if emit.any():
            yield out([c[:-1][emit] for c in rows] + [np.full(int(emit.sum()), -1)])
        held, held_open = [c[-1] for c in rows], bool(joins[-1])
    if held is not None and held_open:
        yield out([np.array([x]) for x in held] + [np.array([-1])])


def _fetched(batches, length: int):
    """The bytes of each listed segment."""
    names = ["gram", "doc", "text", "start", "n", "off", "raw"]
    for b in slices(batches):
        lists = b.column(3)
        per = pc.list_value_length(lists).to_numpy()
        flat = lists.flatten()
        gram, start, n, off = (pc.struct_field(flat, k).to_numpy() for k in range(4))
        owner = np.repeat(np.arange(b.num_rows), per)
        doc, text = b.column(0).to_numpy()[owner], b.column(1).to_numpy()[owner]
        end = start + n + length - 1
        at = 0
        while at < len(owner):  # a long document's segments go out a few at a time
            stop = min(len(owner), at + 4096)
            raws, held, last = [], None, -1
            for k in range(at, stop):
                if owner[k] != last:
                    last = owner[k]
                    held = b.column(2)[int(last)].as_py()
                raws.append(held[start[k] : end[k]])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at:stop]) for c in (gram, doc, text, start, n, off)), pa.array(raws, pa.binary())], names)
            at = stop


def _compared(batches, length: int):
    """Over segments sorted by gram, document, start: spans of windows that the gram's earlier segments hold."""
    gram, seen, row = None, set(), None
    for b in slices(batches, 1024):
        cols = [[] for _ in range(4)]
        for g, doc, text, start, n, off, raw in zip(*(c.to_pylist() for c in b.columns)):
            if row == (g, doc, text, start):  # fetched from another row of the same id and text
                continue
            row = (g, doc, text, start)
            if g != gram:
                gram, seen = g, set()
            open_at = None
            for i in range(n):
                w = (off - i, raw[i : i + length])  # equal windows hold the gram at the same place
                if w in seen:
                    if open_at is None:
                        open_at = i
                else:
                    seen.add(w)
                    if open_at is not None:
                        for c, v in zip(cols, (doc, text, start + open_at, start + i - 1 + length)):
                            c.append(v)
                        open_at = None
            if open_at is not None:
                for c, v in zip(cols, (doc, text, start + open_at, start + n - 1 + length)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _SPAN)], [k for k, _ in _SPAN])


def _windows(batches, length: int):
    """Each window of crowded grams with two hashes of its bytes."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            cols = [[] for _ in range(5)]
            for _, doc, text, start, n, off, raw in zip(*(c.to_pylist() for c in b.slice(i, 512).columns)):
                for k in range(n):
                    d = xxhash.xxh3_128_intdigest(raw[k : k + length])
                    for c, v in zip(cols, ((d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63), doc, text, start + k)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["x", "y", "doc", "text", "start"])


def crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """The grams of ``rows`` that more than ``crowd`` rows have; counted in parts, so that a hot gram is no hot key."""
    return stored(rows.where("gram is not null").groupBy("gram").count().where(F.col("count") > crowd).select("gram"), "crowded-grams")


def apart(rows: DataFrame, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of calm grams and rows without a gram, rows of crowded grams).

    A join that is dealt by gram would bring a hot gram back into one task; up to
    ``MOST_CROWDS`` crowded grams are broadcast (8 bytes each), more meet by a
    join that adaptive execution splits.
    """
    n = crowds.count()
    if not n:
        return rows, rows.where("false")
    few = F.broadcast(crowds) if n <= MOST_CROWDS else crowds
    return rows.join(few, "gram", "left_anti"), rows.join(few, "gram", "left_semi")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, text, start, end): byte spans, overlapping or not, that cover exactly the bytes to remove in ``rows`` (doc, text, body)."""
    spark = rows.sparkSession
    long_rows = rows.select("doc", "text", F.encode("body", "UTF-8").alias("raw")).where(F.octet_length("raw") >= length)
    filed = stored(long_rows.mapInArrow(lambda x: _filed(x, length), _FILED), "filed-segments", texts=True)
    crowds = crowded(filed, MOST_ROWS)
    release(spark)
    calm, hot = apart(filed, crowds)
    dealt = calm.repartition(F.coalesce("gram", F.xxhash64("doc", "start"))).sortWithinPartitions("gram", "seg", "doc", "text", "start")
    settled = stored(dealt.mapInArrow(lambda x: _settle(x, length), _FILED), "segments")
    segment = ["gram", "doc", "text", "start", "n", "off"]
    hot = stored(hot.select(segment).distinct(), "crowded-segments")
    discard(filed)
    del dealt, calm
    release(spark)

    def fetch(wanted: DataFrame, then, schema: str) -> DataFrame:
        lists = wanted.groupBy(F.col("doc").alias("d"), F.col("text").alias("t")).agg(F.collect_list(F.struct("gram", "start", "n", "off")).alias("segs"))
        once = long_rows.join(lists, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t"))).select("doc", "text", "raw", "segs")
        return once.mapInArrow(lambda x: then(_fetched(x, length)), schema)

    whole = settled.where("gram is null").select("doc", "text", "start", "end")
    mixed = settled.where("gram is not null").select(segment)
    mixed, more = apart(mixed, crowded(mixed, CROWD))
    hot = hot.unionByName(more)
    fetched = stored(fetch(mixed, lambda x: x, "gram long, doc long, text long, start long, n int, off int, raw binary"), "segment-bytes", texts=True)
    release(spark)
    calm = fetched.repartition("gram").sortWithinPartitions("gram", "doc", "text", "start")
    found = stored(calm.mapInArrow(lambda x: _compared(x, length), "doc long, text long, start long, end long"), "compared-spans")
    del calm
    discard(fetched)
    release(spark)
    parts = [whole, found]
    if not hot.isEmpty():
        windows = stored(fetch(hot, lambda x: _windows(x, length), "x long, y long, doc long, text long, start long"), "crowded-windows", texts=True)
        firsts = windows.groupBy("x", "y").agg(F.min(F.struct("doc", "text", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        firsts = stored(firsts.select("x", "y", F.col("least.doc").alias("d"), F.col("least.text").alias("t"), F.col("least.start").alias("s")), "first-windows")
        later = windows.join(firsts, ["x", "y"]).where("not (doc = d and text = t and start = s)")
        parts.append(stored(later.select("doc", "text", "start", (F.col("start") + length).alias("end")), "later-windows"))
        discard(windows, firsts)
        release(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kept(raw: bytes, spans: list | None) -> tuple[bytes, int]:
    if not spans:
        return raw, 0
    parts, at, runs = [], 0, 0
    end = -1
    for s in sorted((x["start"], x["end"]) for x in spans):
        if s[0] > end:
            runs += 1
            if end >= 0:
                at = end
            parts.append(raw[at : s[0]])
            end = s[1]
        else:
            end = max(end, s[1])
    parts.append(raw[end:])
    return b"".join(parts), runs


def without_spans(rows: DataFrame, spans: DataFrame, id_col: str = "doc_id", with_bytes: bool = False) -> DataFrame:
    """One row per row of ``rows`` (id, doc, text, body): id, n_bytes, n_removed, n_spans, kept_sha256 once ``spans`` (doc, text, start, end) are cut out; ``with_bytes`` adds ``kept``."""
    lists = spans.groupBy(F.col("doc").alias("d"), F.col("text").alias("t")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    raw = rows.select("id", "doc", "text", F.encode("body", "UTF-8").alias("raw"))
    both = raw.join(lists, (F.col("doc") == F.col("d")) & (F.col("text") == F.col("t")), "left").select("id", "raw", "spans")
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    if with_bytes:
        fields.append(T.StructField("kept", T.BinaryType()))

    def go(batches):
        for b in slices(batches):
            out = []
            for r, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, runs = _kept(r, s)
                out.append((len(r), len(r) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(cols[k], kinds[k]) for k in range(len(fields))]], ["id", *[f.name for f in fields]])

    return stored(both.mapInArrow(go, T.StructType([both.schema["id"], *fields])), "without-spans", texts=True).withColumnRenamed("id", id_col)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """``without_spans`` for every byte that an earlier ``length``-byte string covers."""
    rows = numbered(docs, id_col, text_col)
    return without_spans(rows, repeated_spans(rows, length), id_col, with_bytes)
