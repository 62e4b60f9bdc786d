"""Operator 11, token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

One pass encodes the texts and stores ids, a row a document, and each task's counts
of ids. The counts of all (at most one a vocabulary entry) give code lengths by
package-merge, at most ``MOST_BITS``; codes are canonical, so the book is ids and
lengths. The documents are then put in the order of their ids over range
partitions, and each partition writes one file.

Layout, little-endian. ``book``: ``BOOK``, number of ids (u4), ids (u4 each), lengths
(u1 each). A data file is a row of segments of whole or partial documents, each
``HEAD``: mark, partition, place of the segment in it, ids before it in the partition,
number of ids, of pieces, of blocks, bytes of the piece table and of bits, and a
CRC-32 of what follows: the piece table (Arrow stream: document id, ids of the
document before the piece, length, whether it ends the document), block sizes in
bits (u2 each; their sums are the blocks' bit offsets), and the bits, first bit
highest. A block is ``BLOCK_IDS`` ids and is decoded by itself: one look into a table of
2^bits entries gives an id and its code's length. The blocks of a segment are decoded
side by side, one id of each at a time. A line feed follows each segment.

Spark's text writer puts the bytes down through its commit protocol, on any file
system that Spark knows, so a lost task leaves no half file; ``binaryFile`` reads them
back. Files in the order of their names hold documents in the order of their ids.

Defined cases: a null or empty text is the end id alone; rows that repeat an id are
documents of their own, in the order of length and digest; null ids come last; ids of
any atomic type are kept as such; an empty table gives no data file and no rows;
other columns are never read. A file whose digest or block ends do not fit is an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from chronofold.llm.tables import discard, few_rows, give_back, release, shared_folder, slices, stored, text_of
from chronofold.llm.tokens import _PIECE, _blocks

END_ID = 2
MOST_BITS, BLOCK_IDS = 20, 128
#: Ids of a segment and of a file, about; distinct words that a worker remembers.
SEGMENT_IDS, FILE_IDS, MOST_KNOWN = 1 << 20, 64 << 20, 600_000
#: Words that are looked up at once.
WORDS = 4 << 20
BOOK, MARK = b"CFB1", b"CFS1"
#: mark, partition, segment, ids before, ids, pieces, blocks, bytes of the piece table, bytes of bits, CRC-32.
HEAD = struct.Struct("<4sIQQQIIIQI")
#: Marks a text's first word, which has no space before it; no plain text has this character.
START = "\0"


def _spread(sizes: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat``, one after another; runs lie side by side and have ``sizes``."""
    starts, n = np.cumsum(sizes) - sizes, sizes[at]
    return flat[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class _Known:
    """Ids of strings. Past ``most`` strings only those of the last call stay, so frequent ones do."""

    def __init__(self, kind: str, most: int, make):
        self.most, self.make = most, make
        self.words, self.sizes, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, kind)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all of ``words``, number of ids of each)."""
        coded = words.dictionary_encode()
        own, place = coded.dictionary, coded.indices.to_numpy()
        at = pc.index_in(own, value_set=self.words)
        missed = own.filter(pc.is_null(at))
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(missed))
        if len(missed):
            flat, sizes = self.make(missed)
            self.words, self.sizes, self.flat = pa.concat_arrays([self.words, missed]), np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        out = _spread(self.sizes, self.flat, at[place]), self.sizes[at[place]]
        if len(self.words) > self.most:
            self.words, self.flat, self.sizes = own, _spread(self.sizes, self.flat, at), self.sizes[at]
        return out


class ByteTokenizer:
    """Ids of texts under a byte-level vocabulary of the tokenizers library.

    Texts are cut at their spaces, and the distinct words of many texts, with the
    space before them, are looked up once. Words that are not remembered are cut by
    the vocabulary's own pattern, and pieces that are not go to the library's model.
    Texts outside Latin-1, with an added token's string, or where white space runs
    across a cut, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.kind, self.letter = ("<u2", "H") if self.lib.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.words, self.pieces = _Known(self.kind, MOST_KNOWN, self._cut), _Known(self.kind, MOST_KNOWN, self._tokenize)
        keep = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(256 + k) for k, b in enumerate(rest)}  # byte-level vocabularies write such bytes as characters from 256 on

    def _tokenize(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(pieces, r"\A[ -~]+\z")  # there all but the space stands for itself
        letters = pc.if_else(plain, pc.replace_substring(pieces, " ", self.letters[0x20]), pieces).to_pylist()
        for k in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            letters[k] = letters[k].encode().decode("latin-1").translate(self.letters)
        ids, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for a in range(0, len(letters), 20_000):
            found = list(map(self.model.tokenize, letters[a : a + 20_000]))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), self.kind, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def _cut(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words have a space before them, but for those that ``START`` marks as a text's first."""
        odd = pc.match_substring_regex(words, r"\A\z|\A[\x00\t\n\r]|[\t\n\r]\z")  # side by side, white space of two words would run together
        rest = words.filter(pc.invert(odd))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(rest)], rest), " ")[0].as_py()
        cut = _PIECE.findall(" " + joined) if len(rest) else []
        own = [_PIECE.findall(w[1:] if w[:1] == START else " " + w) for w in words.filter(odd).to_pylist()]
        pieces = pa.array([*cut, *chain.from_iterable(own)], pa.string())
        first = np.flatnonzero(pc.starts_with(pieces[: len(cut)], " ").to_numpy(zero_copy_only=False))  # each word's first piece has its space, and no other piece has one
        alone = odd.to_numpy(zero_copy_only=False)
        count = np.empty(len(words), np.int64)
        count[~alone] = np.diff(first, append=len(cut))
        count[alone] = list(map(len, own))
        flat, sizes = self.pieces(pieces)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])  # of the words, as their pieces lie
        upto = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(count[order])]]
        back = np.argsort(order)
        return _spread(np.diff(upto), flat, back), np.diff(upto)[back]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text."""
        matches = lambda pattern: pc.match_substring_regex(texts, pattern)
        plain = pc.and_(matches(r"\A[\t\n\r -~\x{a1}-\x{ac}\x{ae}-\x{ff}]*\z"), pc.invert(matches(r"[\t\n\r ] (?:[\t\n\r ]|\z)")))
        for a in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, a)))
        lists = pc.split_pattern(pc.binary_join_element_wise(START, texts.filter(plain), ""), " ")
        words, ends = lists.flatten(), lists.offsets.to_numpy()
        parts = [self.words(words.slice(a, WORDS)) for a in range(0, len(words), WORDS)] or [(np.zeros(0, self.kind), np.zeros(0, np.int64))]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        upto = np.r_[0, np.cumsum(sizes)][ends - ends[0]].tolist()
        runs = zip(upto, upto[1:])
        out = []
        for k, ok in enumerate(plain.to_pylist()):
            if ok:
                a, z = next(runs)
                out.append(ids[a:z].tobytes())
            else:
                got = self.lib.encode(texts[k].as_py(), add_special_tokens=False).ids
                out.append(np.array(got, self.kind).tobytes())
        return out

    def __call__(self, text: str) -> bytes:
        return self.encode(pa.array([text], pa.string()))[0]


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """This worker's tokenizer; it and its words outlive a task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``most`` bits for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << most:
        raise ValueError(f"{n} ids do not fit codes of {most} bits")
    by = np.argsort(counts, kind="stable")
    coins = counts[by].astype(object) if int(counts.sum()) * most > 1 << 62 else counts[by].astype(np.int64)
    levels, packages = [], coins[:0]
    for _ in range(most):
        both = np.concatenate([coins, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)  # which of the merged row are coins
        merged = both[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, need = np.zeros(n, np.int64), 2 * n - 2
    for is_coin in reversed(levels):
        taken = int(is_coin[:need].sum())
        lengths[:taken] += 1
        need = 2 * (need - taken)
    out = np.empty(n, np.uint8)
    out[by] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length and place."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = order[lengths[order] == length]
        code <<= length - last
        last = length
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


class Book:
    """Ids and code lengths; the codes and the decoding table follow from them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids.astype("<u4"), lengths.astype(np.uint8)
        self.bits = int(lengths.max(initial=1))

    def to_bytes(self) -> bytes:
        return BOOK + struct.pack("<I", len(self.ids)) + self.ids.tobytes() + self.lengths.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Book:
        if raw[:4] != BOOK:
            raise ValueError("not a code book")
        (n,) = struct.unpack_from("<I", raw, 4)
        return cls(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n))

    def by_id(self) -> np.ndarray:
        """code * 32 + length by id; 0 for an id without a code."""
        out = np.zeros(int(self.ids.max(initial=0)) + 1, np.uint64)
        out[self.ids] = canonical(self.lengths).astype(np.uint64) << np.uint64(5) | self.lengths
        return out

    def table(self) -> np.ndarray:
        """id * 32 + length for every window of ``bits`` bits; 0 where no code begins so."""
        if len(self.ids) and int(self.ids.max()) >= 1 << 27:
            raise ValueError("an id of more than 27 bits")
        out = np.zeros(1 << self.bits, np.uint32)
        order = np.lexsort((np.arange(len(self.ids)), self.lengths))
        spans = 1 << (self.bits - self.lengths[order].astype(np.int64))
        filled = np.repeat(self.ids[order] << np.uint32(5) | self.lengths[order], spans)
        out[: len(filled)] = filled  # canonical codes lie side by side
        return out


def encode_bits(ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(bits of each block, the bits of all), first bit highest."""
    if not len(ids):
        return np.zeros(0, "<u2"), b""
    both = codes[ids]
    sizes = (both & np.uint64(31)).astype(np.int64)
    if not sizes.all():
        raise ValueError("an id without a code")
    ends = np.cumsum(sizes)
    at = ends - sizes
    word = at >> 5
    v = (both >> np.uint64(5)) << (64 - (at & 31) - sizes).astype(np.uint64)  # a code in 64 bits from its word on
    # Codes are shorter than words, so each word has one that begins there, and codes do not overlap, so sums are unions.
    runs = np.add.reduceat(v, np.r_[0, 1 + np.flatnonzero(np.diff(word))])
    whole = np.r_[runs >> np.uint64(32), np.uint64(0)]
    whole[1:] |= runs & np.uint64(0xFFFFFFFF)
    total = int(ends[-1])
    cuts = ends[np.r_[np.arange(BLOCK_IDS - 1, len(ids) - 1, BLOCK_IDS), len(ids) - 1]]
    return np.diff(cuts, prepend=0).astype("<u2"), whole.astype(">u4").tobytes()[: (total + 7) // 8]


def decode_blocks(bits, sizes: np.ndarray, n: int, table: np.ndarray, width: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` of a segment of ``n`` ids; each block starts at its own bit offset."""
    last = len(sizes) if last is None else last
    ends = np.cumsum(sizes.astype(np.int64))
    at = (ends - sizes)[first:last].copy()
    base = int(at[0]) >> 3 if len(at) else 0
    raw = np.frombuffer(bits, np.uint8)[base : (int(ends[last - 1]) + 7 >> 3) if len(at) else 0]
    raw = np.concatenate([raw, np.zeros(BLOCK_IDS * MOST_BITS // 8 + 8, np.uint8)]).astype(np.uint32)
    windows = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits that begin at each byte
    at = (at - 8 * base).astype(np.int32)
    out = np.empty((BLOCK_IDS, len(at)), np.uint32)
    tail = n - (last - 1) * BLOCK_IDS if last == len(sizes) else BLOCK_IDS
    want = ends[first:last] - 8 * base
    for j in range(BLOCK_IDS if len(at) else 0):
        if j == tail:  # the last block is shorter
            if at[-1] != want[-1]:
                raise ValueError("a block does not end where the next begins")
            at, out[j:, -1] = at[:-1], 0
        k = len(at)
        hit = table[windows[at >> 3] >> (32 - width - (at & 7)).view(np.uint32) & np.uint32((1 << width) - 1)]
        out[j, :k] = hit >> np.uint32(5)
        at += (hit & np.uint32(31)).view(np.int32)
    if not (at == want[: len(at)]).all():
        raise ValueError("a block does not end where the next begins")
    return out.T.ravel()[: (last - first - 1) * BLOCK_IDS + tail] if len(want) else out.ravel()


def segment(part: int, number: int, before: int, ids: np.ndarray, pieces: pa.RecordBatch, codes: np.ndarray) -> bytes:
    """One segment of a data file."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pieces.schema) as out:
        out.write_batch(pieces)
    table = sink.getvalue().to_pybytes()
    sizes, bits = encode_bits(ids, codes)
    body = table + sizes.tobytes() + bits
    return HEAD.pack(MARK, part, number, before, len(ids), pieces.num_rows, len(sizes), len(table), len(bits), zlib.crc32(body)) + body


def segments(raw):
    """(partition, segment, ids before, ids, pieces, block sizes, bits) of each segment of a file's bytes."""
    raw, at = memoryview(raw), 0
    while at < len(raw):
        mark, part, number, before, n, _, blocks, t, b, crc = HEAD.unpack_from(raw, at)
        at += HEAD.size
        end = at + t + 2 * blocks + b
        if mark != MARK or end > len(raw) or zlib.crc32(raw[at:end]) != crc:
            raise ValueError(f"segment {number} of partition {part} is damaged")
        pieces = pa.ipc.open_stream(pa.py_buffer(raw[at : at + t])).read_all()
        yield part, number, before, n, pieces, np.frombuffer(raw[at + t : at + t + 2 * blocks], "<u2"), raw[at + t + 2 * blocks : end]
        at = end + 1  # a line feed


def _write(df: DataFrame, path: str) -> None:
    """The bytes of a binary column, each followed by a line feed, as files under ``path``."""
    df.select(F.col(df.columns[0]).cast("string").alias("bytes")).write.option("lineSep", "\n").option("compression", "none").text(path)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode ``docs`` and write ``path``/book and ``path``/data."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    id_field = rows.schema["id"]
    names = ["id", "n", "crc", "ids", "seen", "times"]

    def tokens(batches):
        tok = tokenizer(vocabulary)
        end = np.array([end_id], tok.kind).tobytes()
        counts = np.zeros(tok.lib.get_vocab_size() + end_id + 1, np.int64)
        width = np.dtype(tok.kind).itemsize
        for ids, texts in _blocks(batches):
            raw = [r + end for r in tok.encode(texts)]
            big = [r for r in raw if len(r) > 1 << 20]
            for part in (b"".join([r for r in raw if len(r) <= 1 << 20]), *big):
                counts += np.bincount(np.frombuffer(part, tok.kind), minlength=len(counts))
            for a in range(0, len(raw), 512):
                some = raw[a : a + 512]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, k), pa.array([len(r) // width for r in some], pa.int64()), pa.array([zlib.crc32(r) for r in some], pa.int64()), pa.array(some, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names
                )
        seen = np.flatnonzero(counts)
        k = len(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, _arrow(id_field)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(seen, pa.int32()), pa.array(counts[seen])], names)
        give_back()

    kinds = [id_field.dataType, T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.LongType()]
    table = stored(rows.mapInArrow(tokens, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])), "token-ids", texts=True)
    release(spark)
    counts = table.where("seen is not null").groupBy("seen").agg(F.sum("times").alias("times")).toPandas().sort_values("seen")  # an entry of the vocabulary a row
    ids, times = counts["seen"].to_numpy(np.int64), counts["times"].to_numpy(np.int64)
    book = Book(ids, code_lengths(times))
    _write(spark.createDataFrame([(bytearray(book.to_bytes()),)], "b binary").coalesce(1), f"{path}/book")
    codes = book.by_id()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(times.sum()) // FILE_IDS))
    order = ["id", "n", "crc"]
    first = F.col("id").isNull()

    def pack(batches):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held, pieces = [], []  # ids of pieces; (id, start, length, ends)
        size = 0

        def flush():
            nonlocal number, before, size
            batch = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([p[0] for p in pieces]), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()), pa.array([p[3] for p in pieces], pa.bool_())], ["id", "start", "n", "ends"]
            )
            raw = segment(part, number, before, np.concatenate(held), batch, codes)
            number, before, size = number + 1, before + size, 0
            held.clear(), pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["segment"])

        for b in slices(batches, 64):
            for k in range(b.num_rows):
                ids = b.column(1)[k].as_py()
                n = b.column(2)[k].as_py()
                ids, at = np.frombuffer(ids, f"<u{len(ids) // n}"), 0
                while at < n:
                    take = min(n - at, SEGMENT_IDS - size)
                    held.append(ids[at : at + take])
                    pieces.append((b.column(0).slice(k, 1), at, take, at + take == n))
                    at, size = at + take, size + take
                    if size >= SEGMENT_IDS:
                        yield flush()
        if held:
            yield flush()
        give_back()

    dealt = table.where("seen is null").repartitionByRange(n, first, *order).sortWithinPartitions(first, *order)
    with few_rows(spark):
        _write(dealt.select("id", "ids", "n").mapInArrow(pack, "segment binary"), f"{path}/data")
    discard(table)
    release(spark)


def read_book(spark: SparkSession, path: str) -> Book:
    return Book.from_bytes(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/book").where("length > 0").first()["content"])


def read_token_files(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, decoded from the files under ``path``; ``start`` counts the ids of all documents before it."""
    book = read_book(spark, path)

    def decode(batches):
        table = book.table()
        for b in batches:
            for file in range(b.num_rows):
                crc, starts = 0, 0
                for part, number, before, n, pieces, sizes, bits in segments(b.column(0)[file].as_buffer()):
                    ids, at, out = decode_blocks(bits, sizes, n, table, book.bits), 0, []
                    for k, (start, length, ends) in enumerate(zip(*(pieces.column(c).to_pylist() for c in ("start", "n", "ends")))):
                        crc = zlib.crc32(ids[at : at + length].astype("<u4"), crc if start else 0)
                        starts = before + at if not start else starts
                        at += length
                        if ends:
                            out.append((k, starts, start + length, crc))
                    own = [list(v) for v in zip(*out)] if out else [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(own[0]), pa.int32()), pieces.column("id").combine_chunks().take(pa.array(own[0], pa.int64())), *(pa.array(v, pa.int64()) for v in own[1:])], ["part", "id", "at", "n_tokens", "ids_crc32"]
                    )
        give_back()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("at", "n_tokens", "ids_crc32")]])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # a file at a time
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").where("length > 0").select("content")
        found = stored(files.mapInArrow(decode, schema), "token-files")
    finally:
        spark.conf.set(key, before)
    sums = found.groupBy("part").agg(F.sum("n_tokens").alias("s"))  # a row a file
    ahead = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return found.join(F.broadcast(ahead), F.col("part") == F.col("p")).select("id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files of ``docs`` and read them back: one row per document; ``path``: a shared folder of its own unless named."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/chronofold/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, vocabulary, path, id_col, text_col)
    return read_token_files(spark, path, docs.schema[id_col].dataType).withColumnRenamed("id", id_col)
