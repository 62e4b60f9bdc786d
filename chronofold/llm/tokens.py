"""Operator 6, token counts: pieces are counted once for each distinct pre-token.

One pass cuts the texts into pre-tokens, block by block, and stores two kinds of
rows: the block's distinct pre-tokens, numbered, and each document's pre-token
frequencies as numbers and counts. The pre-tokens are then dealt by their text,
so that equal ones of all blocks meet (a block sends one compressed row to each
part); each distinct one is encoded once and its
number of pieces goes back to every block that has it. There the pieces are
joined to the frequencies and summed. No ids are kept anywhere. A pre-token has
one row a block however often it occurs, so frequent words are no hot keys, and
a block holds at most ``BLOCK_BYTES`` of text or one document.

Texts of characters up to Latin-1 are cut by the vocabulary's pattern with its
classes spelt out; all others by the library's own pre-tokenizer, so every text
goes through the same distinct pre-tokens. An added token's string counts one and
parts the text; only added tokens with flags of their own (single words, stripped
neighbours, normalised) leave a text to the library as a whole.

Defined cases: null and empty texts have 0 tokens; rows that repeat are counted
separately; ids may repeat or be null; an empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronofold.llm.tables import discard, give_back, release, stored, text_of

LIMIT = 512
BLOCK_BYTES = 16 << 20
#: Parts that pre-tokens are dealt to by hash, for each shuffle partition.
PARTS = 4
#: Counted pre-tokens that a task holds before it writes a row a block, and distinct ones that it remembers at most.
FLUSH_ROWS, MOST_KNOWN = 1 << 18, 1 << 20
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-\xff]*\Z")
#: The vocabulary's pre-token pattern with its classes spelt out for the characters of ``_PLAIN``.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _added(path: str) -> tuple[list[str], list[str]]:
    """The strings of the vocabulary's added tokens, those without and those with flags; read without building the vocabulary."""
    with open(path, encoding="utf-8") as f:
        head = f.read(1 << 20)
    at = head.index('"added_tokens"')
    tokens, _ = json.JSONDecoder().raw_decode(head, head.index("[", at))
    odd = [t["content"] for t in tokens if any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) or t.get("normalized") and not t.get("special")]
    return [t["content"] for t in tokens if t["content"] not in odd], odd


class _Cutter:
    """Pre-tokens of a text, and how many tokens it has besides."""

    def __init__(self, path: str):
        self.path, self.lib = path, None  # the library itself is only loaded for texts that need it
        self.plain, self.odd = _added(path)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.plain, key=len, reverse=True)))) if self.plain else None

    def _cut(self, t: str) -> list[str]:
        if _PLAIN.match(t):
            return _PIECE.findall(t)
        self.lib = self.lib or _library(self.path)
        if self.lib.normalizer is not None:
            t = self.lib.normalizer.normalize_str(t)
        return [t[a:z] for _, (a, z) in self.lib.pre_tokenizer.pre_tokenize_str(t)]

    def __call__(self, t: str) -> tuple[list[str], int]:
        if any(x in t for x in self.odd):
            self.lib = self.lib or _library(self.path)
            return [], len(self.lib.encode(t, add_special_tokens=False).ids)
        if self.marks is None or not any(x in t for x in self.plain):
            return self._cut(t), 0
        parts = self.marks.split(t)
        return [w for p in parts for w in self._cut(p)], len(parts) - 1


def _blocks(batches):
    """(ids, texts) of whole batches joined up to about ``BLOCK_BYTES``."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(1).nbytes
        if total >= BLOCK_BYTES:
            yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))
            held, total = [], 0
    if held:
        yield tuple(pa.concat_arrays([x.column(k) for x in held]) for k in (0, 1))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, so that the high zeros lie together."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _joined(words: list[str]) -> bytes:
    """Words with their lengths before them, compressed; any character may be in them."""
    return zlib.compress(_packed(np.fromiter(map(len, words), np.int64, len(words))) + "".join(words).encode(), 1)


def _parted(raw: bytes, n: int) -> list[str]:
    raw = zlib.decompress(raw)
    ends = np.cumsum(_unpacked(raw[: 4 * n]), dtype=np.int64).tolist()
    text = raw[4 * n :].decode()
    return [text[a:z] for a, z in zip([0, *ends], ends)]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, for a byte-level vocabulary file of the tokenizers library."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    id_field = rows.schema["id"]
    names = ["block", "id", "n_bytes", "whole", "freq", "part", "numbers", "tokens"]
    kinds = [T.LongType(), id_field.dataType, T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.BinaryType(), T.BinaryType()]
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # so that give_back reaches it
        cutter = _Cutter(vocabulary)
        block = TaskContext.get().partitionId() << 32
        for ids, texts in _blocks(batches):
            sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
            start = 0
            while start < len(ids):
                total, end = 0, start
                while end < len(ids) and (end == start or total + sizes[end] <= BLOCK_BYTES):
                    total, end = total + sizes[end], end + 1
                first: dict[str, int] = {}  # the block's pre-tokens in order of appearance; documents keep only numbers
                whole, found = [], []
                for k in range(start, end):
                    words, more = cutter(texts[k].as_py())
                    c = Counter(words)
                    del words
                    at = np.fromiter((first.setdefault(w, len(first)) for w in c), np.int32, len(c))
                    found.append((at, np.fromiter(c.values(), np.uint32, len(c))))
                    whole.append(more)
                total_of = np.zeros(len(first), np.int64)
                for at, n in found:
                    total_of[at] += n
                tokens = list(first)
                first.clear()
                order = np.array(sorted(range(len(tokens)), key=tokens.__getitem__), np.int64)
                order = order[np.argsort(-total_of[order], kind="stable")] if len(order) else order
                number = np.empty(len(tokens), np.int64)
                number[order] = np.arange(len(tokens))
                tokens = [tokens[i] for i in order.tolist()]
                freqs = []
                for k, (at, n) in enumerate(found):
                    at = number[at]
                    by = np.argsort(at)
                    freqs.append(_packed(np.concatenate([np.diff(at[by], prepend=0), n[by]])))
                    found[k] = None
                del found
                d, k = end - start, len(tokens)
                none = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(d, block)), ids.slice(start, d), pa.array(sizes[start:end]), pa.array(whole, pa.int64()), pa.array(freqs, pa.binary()), none(pa.int32(), d), none(pa.binary(), d), none(pa.binary(), d)], names
                )
                part = np.fromiter((zlib.crc32(t.encode()) % parts for t in tokens), np.int32, k)
                by = np.argsort(part, kind="stable")
                groups = np.split(by, np.flatnonzero(np.diff(part[by])) + 1) if k else []
                m = len(groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, block)), none(ids.type, m), none(pa.int64(), m), none(pa.int64(), m), none(pa.binary(), m), pa.array([part[g[0]] for g in groups], pa.int32()),
                        pa.array([_packed(g) for g in groups], pa.binary()), pa.array([_joined([tokens[i] for i in g.tolist()]) for g in groups], pa.binary()),
                    ],
                    names,
                )
                block, start = block + 1, end
                del tokens, number, order, freqs, first
            give_back()

    table = stored(rows.mapInArrow(cut, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])), "pretokens", texts=True)

    def count(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        lib = _library(vocabulary)
        many: dict[str, int] = {}  # the task's distinct pre-tokens; equal ones of all blocks are in one task. Past MOST_KNOWN it starts anew.
        held, size = [], 0

        def flush():
            """One row a block for what has been counted: its pre-tokens' numbers and pieces."""
            nonlocal size
            blocks, numbers, per = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = 0
            by = np.argsort(blocks, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(blocks[by])) + 1) if len(by) else []
            return pa.RecordBatch.from_arrays(
                [pa.array([blocks[p[0]] for p in parts], pa.int64()), pa.array([_packed(np.concatenate([numbers[p], per[p]])) for p in parts], pa.binary())], ["b", "pieces"]
            )

        for b in batches:
            for raw, block, numbers in zip(*(b.column(k).to_pylist() for k in range(3))):
                numbers = _unpacked(numbers)
                tokens = _parted(raw, len(numbers))
                if len(many) > MOST_KNOWN:
                    many.clear()
                todo = [t for t in tokens if t not in many]
                many.update(zip(todo, (len(e.ids) for e in lib.encode_batch_fast(todo, add_special_tokens=False))))
                held.append((np.full(len(tokens), block), numbers, np.fromiter(map(many.__getitem__, tokens), np.int64, len(tokens))))
                size += len(tokens)
                if size >= FLUSH_ROWS:
                    yield flush()
        if held:
            yield flush()
        del lib
        many.clear()
        give_back()

    tokens = table.where("part is not null").select("tokens", "block", "numbers", "part").repartition("part").drop("part")
    pieces = stored(tokens.mapInArrow(count, "b long, pieces binary"), "pieces")
    del tokens
    release(docs.sparkSession)
    freq = table.where("part is null").select("block", "id", "n_bytes", "whole", "freq")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_unpacked(p).reshape(2, -1) for p in right.column("pieces").to_pylist()]
        both = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint32)
        per = np.zeros(int(both[0].max()) + 1 if both.size else 0, np.int64)
        per[both[0]] = both[1]
        sums = []
        for w, f in zip(left.column("whole").to_pylist(), left.column("freq").to_pylist()):
            at, n = _unpacked(f).reshape(2, -1)
            sums.append(w + int(per[np.cumsum(at, dtype=np.int64)] @ n.astype(np.int64)) if len(at) else w)
        return pa.table([left.column("id"), left.column("n_bytes"), pa.array(sums, pa.int64())], names=[id_field.name, "n_bytes", "n_tokens"])

    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = stored(freq.groupBy("block").cogroup(pieces.groupBy("b")).applyInArrow(add, schema), "token-counts")
    discard(table, pieces)
    release(docs.sparkSession)
    return out.withColumnRenamed("id", id_col)
