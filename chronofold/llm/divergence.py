"""Operator 12, source divergence audit: how far the sources of a language differ in their terms, by an integer dictionary.

A first pass cuts blocks of documents into terms, numbers a block's terms, and
counts by ``bincount``: occurrences a (language, source), documents a language. The
counts meet by key, then lie in order of language and term over range partitions,
where every term has its rows of all sources side by side. There the terms of
enough documents are kept; they are the sorted dictionary, cut into chunks of one
language. Rows find their ids in it by ``searchsorted``; ids follow the order of
UTF-8, so ties are settled by number.

A chunk's counts become dense vectors, a row a source, zeros included, and all pairs
of sources are compared on it in integers. Sums over chunks are the pairs' values;
the best terms of a source come from the best of each chunk. Sources beyond
``BLOCK`` in a language are compared block by block, so a task holds two blocks of
sources on one chunk, whatever the table's size.

All arithmetic is exact: shares are taken by long division within 64 bits, in Python
integers where a language has over 9 * 10^15 terms.

Defined cases: null text, language and source are empty strings; a source without
terms, or without kept ones, has its rows; a language without kept terms has pairs of
value 0 and no terms; repeated rows and ids are documents of their own; a language
with one source has no pairs; an empty table gives an empty result; other columns
are never read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.llm.tables import discard, give_back, release, stored, text_of

LEAST_DOCS, TOP_TERMS, SCALE, PSEUDO = 3, 200, 1_000_000_000, 1
#: Kept terms of a chunk, sources of a block, keys that a language's chunks are dealt over.
CHUNK, BLOCK, SALTS = 4096, 256, 64
#: Tokens and distinct terms that a task holds before it writes its counts; rows of counts cut into chunks at once; bytes of a text in work.
MOST_TOKENS, MOST_TERMS, CUT_ROWS, SLICE = 4 << 20, 1 << 19, 1 << 18, 8 << 20
#: Bytes up to 0x7F other than letters end a term; A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class _Numbers(dict):
    """Numbers of terms in order of appearance."""

    def __missing__(self, term):
        n = self[term] = len(self)
        return n


def _slices(text: bytes):
    """A translated text in pieces that end where a term ends."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, summed over all rows; each group also has a row without a term."""
    key = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(key(lang_col).alias("lang"), key(source_col).alias("source"), text_of(docs, text_col).alias("text"))

    def count(batches):
        numbers, groups, held = _Numbers(), {}, 0

        def flush():
            terms = pa.array(list(numbers), pa.binary()).cast(pa.string())
            for (lang, source), (all_ids, own_ids) in groups.items():
                n = np.bincount(np.concatenate(all_ids), minlength=len(terms)) if all_ids else np.zeros(len(terms), np.int64)
                docs = np.bincount(np.concatenate(own_ids), minlength=len(terms)) if own_ids else n
                at = np.flatnonzero(n)
                column = pa.concat_arrays([pa.nulls(1, pa.string()), terms.take(pa.array(at))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(column)), pa.array([source] * len(column)), column, pa.array(np.r_[0, n[at]]), pa.array(np.r_[0, docs[at]])],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in batches:
            langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
            for k in range(b.num_rows):
                group = groups.setdefault((langs[k], sources[k]), ([], []))
                parts = []
                for piece in _slices(texts[k].as_py().translate(_TABLE)):
                    words = piece.split()
                    parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                if parts:
                    ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
                    group[0].append(ids)
                    group[1].append(np.unique(ids))
                    held += len(ids)
                if held >= MOST_TOKENS or len(numbers) >= MOST_TERMS:
                    yield from flush()
                    numbers.clear(), groups.clear()
                    held = 0
        yield from flush()
        groups.clear(), numbers.clear()
        give_back()

    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_CHUNK = "lang string, chunk long, source string, size int, total long, ids binary, counts binary, terms array<string>"


def chunks(counts: DataFrame, least_docs: int = LEAST_DOCS, chunk: int = CHUNK) -> DataFrame:
    """The dictionary in chunks: for each of one language's kept terms, a row with the terms and the language's counts (source null), and a row a source that has any."""
    rows = counts.where("term is not null").select("lang", "term", "source", "n", "docs").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("size", pa.int32()), ("total", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("terms", pa.list_(pa.string()))])

        def of(t: pa.Table):
            """Whole terms of one language, in order."""
            nonlocal number
            term, n, docs = t.column("term").combine_chunks(), t.column("n").to_numpy(), t.column("docs").to_numpy()
            starts = np.r_[0, 1 + np.flatnonzero(pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False))]
            keep = np.add.reduceat(docs, starts) >= least_docs
            kept, run = starts[keep], np.searchsorted(starts, np.arange(len(n)), "right") - 1
            mine = np.flatnonzero(keep[run])
            if not len(mine):
                return
            ids = np.searchsorted(kept, mine, "right") - 1  # rows lie in the order of terms: a row's id is the number of the last kept term that begins at or before it
            words, totals = term.take(pa.array(kept)), np.add.reduceat(n[mine], np.flatnonzero(np.diff(ids, prepend=-1)))
            source = t.column("source").combine_chunks().dictionary_encode()
            names, code = source.dictionary.to_pylist(), source.indices.to_numpy()[mine]
            lang = t.column("lang")[0].as_py()
            for a in range(0, len(kept), chunk):
                size = min(chunk, len(kept) - a)
                here = slice(*np.searchsorted(ids, [a, a + size]))
                by = np.argsort(code[here], kind="stable")
                c, i, m = code[here][by], (ids[here][by] - a).astype("<i4"), n[mine][here][by].astype("<i8")
                edges = np.flatnonzero(np.diff(c, prepend=-1, append=-1))
                out = [(lang, number, None, size, int(totals[a : a + size].sum()), b"", totals[a : a + size].astype("<i8").tobytes(), words[a : a + size].to_pylist())]
                out += [(lang, number, names[c[x]], size, int(m[x:y].sum()), i[x:y].tobytes(), m[x:y].tobytes(), None) for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                number += 1

        def languages(t: pa.Table):
            if t.num_rows:
                lang = t.column("lang").combine_chunks()
                edges = [0, *(1 + np.flatnonzero(pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False))).tolist(), len(lang)]
                for x, y in zip(edges, edges[1:]):
                    yield from of(t.slice(x, y - x))

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CUT_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                lang, term = t.column("lang").combine_chunks(), t.column("term").combine_chunks()
                last = np.flatnonzero(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False))
                end = int(last[-1]) + 1 if len(last) else 0  # the last term may go on
                yield from languages(t.slice(0, end))
                held, size = t.slice(end).to_batches(), t.num_rows - end
        if held:
            yield from languages(pa.Table.from_batches(held).combine_chunks())
        give_back()

    return rows.mapInArrow(cut, _CHUNK)


def shares(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PSEUDO) / whole), exactly."""
    rest = count + PSEUDO
    if whole >= 1 << 53:  # then a thousandfold remainder may not fit 64 bits
        return np.array([1 + SCALE * int(c) // whole for c in rest.tolist()], np.int64)
    out = rest // whole
    rest = rest % whole
    left = SCALE
    while left > 1:  # long division, three digits at a time
        step = min(left, 1000)
        rest = rest * step
        out = out * step + rest // whole
        rest = rest % whole
        left //= step
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q): shares are at most SCALE + 1, so the square fits 64 bits."""
    d = p - q
    return d * d // q


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top_terms: int = TOP_TERMS,
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): each source against every other of its language (``pair``), and the terms that tell it most (``term``)."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col), "term-counts", texts=True)
    release(docs.sparkSession)
    table = stored(chunks(counts, least_docs, chunk), "term-chunks")
    own, whole = table.where("source is not null"), table.where("source is null")

    groups = counts.select("lang", "source").distinct()
    many = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sums = own.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    kept = whole.groupBy("lang").agg(F.sum("size").alias("v"), F.sum("total").alias("all_n"))
    sizes = many.join(kept, "lang", "left")
    groups = stored(groups.join(sums, ["lang", "source"], "left").join(sizes, "lang").fillna(0, ["n", "v", "all_n"]).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "term-groups")

    # Every source stands in every chunk of its language, with or without terms there; a language without any has one empty chunk.
    named = whole.select("lang", "chunk", "size").unionByName(groups.where("v = 0").select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("size")).distinct())
    salted = named.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    roster = salted.join(spread, ["lang", "salt"]).drop("salt")
    roster = roster.join(own.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left").withColumn("terms", F.lit(None).cast("array<string>"))
    tops = whole.select("lang", "chunk", "source", "size", "ids", "counts", "terms").join(groups.groupBy("lang").agg(F.first("blocks").alias("blocks"), F.first("v").alias("v"), F.first("all_n").alias("n")), "lang")

    columns = ["source", "size", "n", "v", "ids", "counts", "terms"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = roster.select("lang", "chunk", F.col("block").alias("a"), other.alias("b"), *columns)
    right = roster.select("lang", "chunk", other.alias("a"), F.col("block").alias("b"), *columns).unionByName(
        tops.select("lang", "chunk", other.alias("a"), F.lit(0).alias("b"), *columns)  # the language's own counts and terms go where the first block is
    )
    out_schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def compare(key, x: pa.Table, y: pa.Table) -> pa.Table:
        def vectors(t):
            """(names, counts, shares) a source on this chunk."""
            size = t.column("size")[0].as_py() if t.num_rows else 0
            c = np.zeros((t.num_rows, size), np.int64)
            p = np.empty_like(c)
            for k, (ids, counts, n, v) in enumerate(zip(*(t.column(f).to_pylist() for f in ("ids", "counts", "n", "v")))):
                if counts is not None:
                    c[k, np.frombuffer(ids, "<i4")] = np.frombuffer(counts, "<i8")
                if size:
                    p[k] = shares(c[k], n + PSEUDO * v)
            return t.column("source").to_pylist(), c, p

        lang = key[0].as_py()
        top = y.filter(pc.is_valid(y.column("terms")))
        names, c, p = vectors(x)
        others, _, q = vectors(y.filter(pc.is_null(y.column("terms"))))
        out: list[tuple] = []
        for k, name in enumerate(names):
            sums = excess(p[k], q).sum(1) if len(others) else []
            out += [(lang, name, "pair", item, int(s)) for item, s in zip(others, sums) if item != name]
        for row in top.to_pylist():
            base = shares(np.frombuffer(row["counts"], "<i8"), row["n"] + PSEUDO * row["v"])
            for k, name in enumerate(names):
                at = np.flatnonzero((c[k] > 0) & (p[k] > base))
                f = excess(p[k][at], base[at])
                best = np.lexsort((at, -f))[:top_terms]
                out += [(lang, name, "term", row["terms"][i], int(s)) for i, s in zip(at[best].tolist(), f[best].tolist())]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out) if out else [[]] * 5, out_schema)], schema=out_schema)

    keys = ["lang", "chunk", "a", "b"]
    renamed = right.select(*[F.col(c).alias(f"{c}_" if c in keys else c) for c in right.columns])
    found = stored(left.groupBy(*keys).cogroup(renamed.groupBy(*[f"{k}_" for k in keys])).applyInArrow(compare, "lang string, source string, part string, item string, value long"), "term-found")
    discard(counts, table, groups)
    best = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", best)
    terms = found.where("part = 'term'").withColumn("rank", best).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
