"""Operator 8, SimHash near-dedup by anchor-point covering.

A fingerprint's 64 bits are read as blocks of 21, 21 and 22 bits. Each block is
decoded to its nearest word in the binary Golay code of length 23 (short blocks
are padded with zeros), a perfect code whose balls of radius 3 cover every word:
its 4096 words are the block's anchors. Two fingerprints that differ in at most
four bits differ in at most two within some pair of blocks, so a word half way
between them, one bit flip from each, decodes to one pair of anchors. Each
fingerprint is therefore replicated to the anchor pairs that it or one of its
one-bit neighbours decodes to (covering radius plus half the threshold, from
both sides), about 11 for each of the three pairs of blocks; there are
3 * 2**24 anchor pairs. All links at four bits or fewer meet at some anchor, and
each anchor compares what it holds exactly.

A crowded anchor is cut into chunks by hash, and every pair of chunks is
compared in a task of bounded size. A comparison returns a spanning forest of
the links it finds, never all pairs; the forests have the same components.

``near_groups`` is the same for documents at a similarity of 0.8 or more of their
five-word shingles, which differ in about 15 of 100 bits, too many for one
fingerprint. It takes ``SKETCH_WORDS`` independent fingerprints a document, puts the
first ``ANCHOR_WORDS`` of them to their anchors, and links documents that meet and
whose whole sketches differ in at most ``most_bits(similarity)`` bits. Chance meetings,
which grow with the square of the documents, end at the anchor: each member brings one
more fingerprint, and who is within ``CHECK_BITS`` of nobody there goes no further. Meetings
are gathered by one of their members, so a sketch goes once to each gathering, not to each
anchor, and is looked up once. That finds
0.94 of the meetings at a similarity of 0.8 and 0.99 from 0.85 on; the sketch estimates
the similarity to within 0.035 (standard error), so pairs around 0.77 may be linked too.

Defined cases: null, empty and all-space texts have fingerprint zero, linked like
any other; equal fingerprints are one node, so copies never multiply. Rows with a
null id take part but never name a component unless all its ids are null. Repeated
ids are different documents. An empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.tables import connected_components, content, discard, give_back, keep_rows, release, slices, stored, text_of

SHINGLE, MOST_BITS = 4, 4
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Lowest bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints that one comparison task holds at most, on average, from each of two chunks.
CHUNK = 2048

#: Fingerprints of 64 bits in a sketch, those of them that go to anchors, the sketch's shingle, and the similarity of near copies.
SKETCH_WORDS, ANCHOR_WORDS, NEAR_SHINGLE, NEAR = 8, 5, 5, 0.8
#: Bits in which the fingerprint after the anchors' may differ: 3.5 standard errors above near copies' 10, 3 under strangers' 32.
CHECK_BITS = 20
#: Members up to which a meeting is gathered with others; a larger one stays by itself, so that no gathering is without bound.
GATHER = 512
#: Allowance for the error of the estimate, as a share of the similarity's distance from 1: links reach down to 0.77 for 0.8.
SLACK = 0.15
_SEEDS = np.random.default_rng(20240411).integers(0, 1 << 63, SKETCH_WORDS, dtype=np.uint64)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = _words(text)
    if not words:
        return 0
    raw = " ".join(words).encode("utf-8")
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(raw, 42)
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = [0, *(spaces[: n - shingle] + 1).tolist()]
    ends = [*spaces[shingle - 1 :].tolist(), len(raw)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], 42) for a, b in zip(starts, ends)], np.uint64)
    return int(_majority(h))


#: For each byte, a number whose eight bytes are its eight bits.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def _majority(h: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 128):
        lanes = _LANES[h[i : i + 255 * 128].view(np.uint8)].reshape(-1, 8)  # 255 bits fit a lane
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def _words(text: str | None) -> list[str]:
    text = text or ""
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_UPPER))


class _Hashes(dict):
    """64-bit hashes of words, remembered; the caller empties it."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def sketch(text: str | None, known: dict, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """``SKETCH_WORDS`` fingerprints of independent hashes of a text's shingles; zeros for a text without words."""
    words = _words(text)
    if not words:
        return np.zeros(SKETCH_WORDS, np.uint64)
    if len(known) > 300_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    x = h[:n].copy()
    for j in range(1, min(shingle, len(h))):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : n + j]
    out = np.empty(SKETCH_WORDS, np.uint64)
    for k, seed in enumerate(_SEEDS):
        y = (x ^ (x >> np.uint64(31)) ^ seed) * np.uint64(0x94D049BB133111EB)
        y = (y ^ (y >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = _majority(y ^ (y >> np.uint64(32)))
    return out


def most_bits(similarity: float) -> int:
    """Differing bits of two sketches that still make a link: shingle sets of that Jaccard similarity, and ``SLACK``, have this angle."""
    s = similarity - SLACK * (1 - similarity)
    return int(64 * SKETCH_WORDS * np.arccos(2 * s / (1 + s)) / np.pi)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])

    def go(batches):
        for b in slices(batches, 256):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])
        give_back()

    return rows.mapInArrow(go, schema)


def _remainders(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def _corrections() -> np.ndarray:
    """For each remainder, the error of at most three bits that has it."""
    table = np.zeros(1 << 11, np.int64)
    ones = 1 << np.arange(23)
    errors = np.concatenate([[0], ones, [a | b for i, a in enumerate(ones) for b in ones[:i]],
                             [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]]).astype(np.int64)
    table[_remainders(errors)] = errors
    return table


_fix: np.ndarray | None = None


def _anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor pair that a fingerprint or a one-bit neighbour of it decodes to."""
    global _fix
    if _fix is None:
        _fix = _corrections()
    own, near = [], []
    for low, width in BLOCKS:
        x = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        decode = lambda v: (v ^ _fix[_remainders(v)]) >> 11  # noqa: E731  the message bits number the anchors
        own.append(decode(x))
        near.append(np.stack([decode(x ^ (1 << b)) for b in range(width)], axis=1))
    rows, keys = [], []
    everyone = np.arange(len(fps))
    for k, (i, j) in enumerate(PAIRS):
        key = lambda a, b: (k << 24) | (a << 12) | b  # noqa: E731, B023
        rows.append(everyone)
        keys.append(key(own[i], own[j]))
        for near_i in (True, False):
            moved = near[i] if near_i else near[j]
            k2 = key(moved, own[j][:, None]) if near_i else key(own[i][:, None], moved)
            changed = moved != (own[i] if near_i else own[j])[:, None]
            r, c = np.nonzero(changed)
            rows.append(r)
            keys.append(k2[r, c])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    both = np.unique(rows.astype(np.int64) << 26 | keys)
    return both >> 26, both & ((1 << 26) - 1)


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of rows, of the links at ``most`` differing bits between the rows of ``fps``."""
    links, open_ = [], np.ones(len(fps), bool)
    for first in range(len(fps)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(open_)
            near = rest[np.bitwise_count(fps[rest] ^ fps[x]).sum(1, dtype=np.int64) <= most]
            open_[near] = False
            links += [(x, int(y)) for y in near]
            queue += near.tolist()
    return links


def _meetings(keyed: DataFrame, chunk: int) -> DataFrame:
    """(members): the values ``v`` at each anchor of ``keyed`` (anchor, v) that has two or more; a crowded anchor gives a row for each pair of its chunks."""
    crowded = stored(keyed.groupBy("anchor").count().where(F.col("count") > 2 * chunk).select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "crowded")
    plain = keyed.join(crowded, "anchor", "left_anti").groupBy("anchor").agg(F.collect_list("v").alias("members")).where("size(members) > 1").select("members")
    dealt = keyed.join(crowded, "anchor").withColumn("c", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    both = dealt.select("anchor", "v", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    hot = both.groupBy("anchor", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y")).agg(F.collect_list("v").alias("members")).select("members")
    return plain.unionByName(hot)


def _near_meetings(keyed: DataFrame, crowded: DataFrame, chunk: int, alone: bool) -> tuple[DataFrame, list[DataFrame]]:
    """``_meetings``, and the stored tables that they read, of (anchor, node, check, c) for members that are linked already if they have one ``c``.

    At a ``crowded`` anchor each ``c`` of more than a chunk has chunks of its own, and all others share some. Two chunks of one
    ``c`` are not compared, so a linked group is sent once for each chunk of others there, not once for each of its own.
    ``alone``: chunks are compared within themselves, not with each other.
    """
    v = F.struct("node", "check", "c").alias("v")
    plain = keyed.join(crowded, "anchor", "left_anti").groupBy("anchor").agg(F.collect_list(v).alias("members")).where("size(members) > 1").select("members")
    if crowded.isEmpty():
        return plain, []
    there = keyed.join(crowded, "anchor")
    large = stored(there.groupBy("anchor", "c").count().where(F.col("count") > chunk).select("anchor", "c", F.col("c").alias("own")), "near-large")
    dealt = stored(there.join(large, ["anchor", "c"], "left").select("anchor", "node", "check", "c", F.coalesce("own", F.lit(-1)).alias("own")), "near-dealt")
    sizes = dealt.groupBy("anchor", "own").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    sizes = stored(sizes, "near-sizes")
    part = sizes.select("anchor", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct("own", k.alias("k")))).alias("x"))
    met = (F.col("x") == F.col("y")) if alone else (F.col("x") <= F.col("y"))
    pairs = stored(part.join(part.withColumnRenamed("x", "y"), "anchor").where(met & ((F.col("x.own") != F.col("y.own")) | (F.col("x.own") == -1))).withColumn("meeting", F.monotonically_increasing_id()), "near-pairs")
    ends = pairs.select("meeting", "anchor", "x.own", "x.k").unionByName(pairs.where("x <> y").select("meeting", "anchor", "y.own", "y.k"))
    placed = dealt.join(sizes, ["anchor", "own"]).withColumn("k", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    hot = placed.join(ends, ["anchor", "own", "k"]).groupBy("meeting").agg(F.collect_list(v).alias("members")).select("members")
    return plain.unionByName(hot), [large, dealt, sizes, pairs]


def fingerprint_links(nodes: DataFrame, most: int = MOST_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``nodes.fp`` at ``most`` (up to 4) differing bits."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError("the anchors cover thresholds up to 4 bits")

    def spread(batches):
        for b in slices(batches, 4096):
            fps = b.column(0).to_numpy().view(np.uint64)
            row, key = _anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], ["anchor", "v"])

    keyed = stored(nodes.select("fp").mapInArrow(spread, "anchor long, v long"), "anchored")

    def compare(batches):
        for b in batches:
            found = []
            for fps in b.column(0):
                x = np.unique(fps.values.to_numpy()).view(np.uint64)
                if len(x) == 2:
                    if int(x[0] ^ x[1]).bit_count() <= most:
                        found.append((x[0], x[1]))
                else:
                    found += [(x[i], x[j]) for i, j in _forest(x[:, None], most)]
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    links = stored(_meetings(keyed, chunk).mapInArrow(compare, "a long, b long"), "links")
    discard(keyed)
    return links


def _groups(lists: pa.ListArray):
    """Rows of the flattened members, and (first, end) of each list among them."""
    end = np.cumsum(np.array([len(x) for x in lists], np.int64))
    return lists.flatten(), zip((end - np.diff(end, prepend=0)).tolist(), end.tolist())


def _likely(batches):
    """Of each anchor's members (node, check, c), those within ``CHECK_BITS`` of another one, unless all of these are linked already (``c``); ``hub`` is one of them, the same wherever they meet."""
    for b in slices(batches, 4096):
        flat, groups = _groups(b.column(0))
        node, check, c = (flat.field(k).to_numpy() for k in ("node", "check", "c"))
        check = check.view(np.uint64)
        out = []
        for first, end in groups:
            x = check[first:end]
            if end - first == 2:
                if c[first] != c[first + 1] and int(x[0] ^ x[1]).bit_count() <= CHECK_BITS:
                    out.append(node[first:end])
                continue
            if (c[first:end] == c[first]).all():
                continue
            some = np.zeros(len(x), bool)
            for k in range(0, len(x), 256):
                d = np.bitwise_count(x[k : k + 256, None] ^ x)
                d[np.arange(len(d)), np.arange(k, k + len(d))] = 64
                some[k : k + 256] = (d <= CHECK_BITS).any(1)
            if some.any() and np.ptp(c[first:end][some]):
                out.append(node[first:end][some])
        hubs = [x[(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).argmin()] for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["hub", "nodes"])


def sketch_links(nodes: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose components are those of the pairs of ``nodes`` (node, sketch) that meet at an anchor and differ in at most ``most`` bits.

    The first fingerprint's anchors go first. A large group of near copies meets at all anchors of all fingerprints; what
    the first has linked is not met again at the others, unless someone else is there too. Where an anchor of the first is
    crowded, its chunks are compared only within themselves at first, and with each other once those links are known.
    """
    first, crowded = _links_at(nodes.withColumn("c", F.col("node")), range(1), most, chunk, "sketch-first", alone=True)
    comps = stored(connected_components(first, "near-first"), "near-first-comps")
    linked = comps.select(F.col("node").alias("n"), F.col("component").alias("c"))
    rest = nodes.join(linked, F.col("node") == F.col("n"), "left").select("node", "sketch", F.coalesce("c", "node").alias("c"))
    second, _ = _links_at(rest, range(0 if crowded else 1, ANCHOR_WORDS), most, chunk, "sketch-rest")
    links = stored(first.unionByName(second), "sketch-links")
    discard(first, second, comps)
    return links


def _links_at(nodes: DataFrame, which: range, most: int, chunk: int, name: str, alone: bool = False) -> tuple[DataFrame, bool]:
    """(a, b): a spanning forest, anchor by anchor of the fingerprints ``which``, of ``nodes`` (node, sketch, c); anchors where all have one ``c`` are left out. And whether any anchor is crowded."""

    def spread(batches):
        for b in slices(batches, 1024):
            node = b.column(0).to_numpy()
            words = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            check = np.ascontiguousarray(words[:, ANCHOR_WORDS]).view(np.int64)
            linked = b.column(2).to_numpy()
            for k in which:
                row, key = _anchors(np.ascontiguousarray(words[:, k]))
                yield pa.RecordBatch.from_arrays([pa.array(key | (k << 26)), pa.array(node[row]), pa.array(check[row]), pa.array(linked[row])], ["anchor", "node", "check", "c"])

    keyed = stored(nodes.select("node", "sketch", "c").mapInArrow(spread, "anchor long, node long, check long, c long"), f"{name}-anchors")
    crowded = stored(keyed.groupBy("anchor").count().where(F.col("count") > 2 * chunk).select("anchor"), f"{name}-crowded")
    members, read = _near_meetings(keyed, crowded, chunk, alone)
    met = members.mapInArrow(_likely, "hub long, nodes array<long>")
    groups = stored(met.withColumn("hub", F.when(F.size("nodes") > GATHER, F.xxhash64("nodes")).otherwise(F.col("hub"))), f"{name}-meetings")
    any_crowded = not crowded.isEmpty()
    discard(keyed, crowded, *read)
    release(nodes.sparkSession)
    gathered = stored(groups.groupBy("hub").agg(F.collect_list("nodes").alias("meetings")), f"{name}-gathered")
    asked = gathered.select("hub", F.explode(F.array_distinct(F.flatten("meetings"))).alias("n")).groupBy("n").agg(F.collect_list("hub").alias("hubs"))
    brought = asked.join(nodes, F.col("n") == F.col("node")).select(F.explode("hubs").alias("hub"), F.struct("node", "sketch").alias("member"))
    full = brought.groupBy("hub").agg(F.collect_list("member").alias("members")).join(gathered, "hub").select("members", "meetings")

    def compare(batches):
        for b in slices(batches, 64):
            flat, groups_ = _groups(b.column(0))
            node = flat.field("node").to_numpy()
            words = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            a, z = [], []
            for (first, end), met_ in zip(groups_, b.column(1)):
                order = first + np.argsort(node[first:end])
                seen = set()
                for x in met_.values:
                    at = order[np.searchsorted(node[order], np.sort(x.values.to_numpy()))]
                    if at.tobytes() in seen:
                        continue
                    seen.add(at.tobytes())
                    if len(at) == 2:
                        if int(np.bitwise_count(words[at[0]] ^ words[at[1]]).sum()) <= most:
                            a.append(node[at[0]]), z.append(node[at[1]])
                        continue
                    for i, j in _forest(words[at], most):
                        a.append(node[at[i]]), z.append(node[at[j]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    links = stored(full.mapInArrow(compare, "a long, b long"), f"{name}-links", texts=True)
    discard(groups, gathered)
    return links, any_crowded


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints", texts=True)
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    links = fingerprint_links(nodes, most)
    comps = stored(connected_components(links, "simhash"), "simhash-comps")
    named = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    named = stored(named, "simhash-named")
    leaders = stored(named.groupBy("c").agg(F.min("least").alias("component_id")), "simhash-leaders")
    of_fp = stored(named.join(leaders, "c").select("fp", "component_id"), "simhash-of")
    discard(links, comps, named, leaders)
    out = fps.join(of_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = NEAR, shingle: int = NEAR_SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: __id, __x, __y (``tables.content``), leader (the same three of the group's first row: smallest id, null ids last)."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("__id"), *content(text), text.alias("text"))

    def go(batches):
        known = _Hashes()
        for b in slices(batches, 256):
            found = [sketch(t, known, shingle).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], ["__id", "__x", "__y", "sketch"])
        known.clear()
        give_back()

    schema = T.StructType([rows.schema["__id"], rows.schema["__x"], rows.schema["__y"], T.StructField("sketch", T.BinaryType())])
    rows = stored(rows.mapInArrow(go, schema), "sketches", texts=True)
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__x", "__y")).alias("first")
    nodes = stored(rows.groupBy("sketch").agg(first).withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    links = sketch_links(nodes.select("node", "sketch"), most_bits(similarity), chunk)
    comps = stored(connected_components(links, "near"), "near-comps").withColumnRenamed("node", "__n")
    named = stored(nodes.join(comps, F.col("node") == F.col("__n"), "left").select("sketch", "first", F.coalesce("component", "node").alias("c")), "near-named")
    leaders = stored(named.groupBy("c").agg(F.min("first").alias("leader")), "near-leaders")
    of_sketch = stored(named.join(leaders, "c").select("sketch", "leader"), "near-of")
    discard(nodes, links, named, leaders)
    return rows.join(of_sketch, "sketch").select("__id", "__x", "__y", "leader")


def keep_one_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = NEAR) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest id; all columns unchanged."""
    found = near_groups(docs, id_col, text_col, similarity)
    own = F.struct(F.col("__id").isNull().alias("none"), "__id", "__x", "__y")
    return keep_rows(docs, found.withColumn("stays", own.eqNullSafe(F.col("leader"))), id_col, text_col, once=True)
