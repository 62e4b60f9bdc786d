"""Operator 4, best-fit packing from a length histogram.

Documents are tokenized once; each piece leaves only its length and digest. The
histogram of lengths (at most ``capacity`` numbers) goes to the driver, where
best-fit decreasing runs over counts: whole groups of equally filled sequences
take whole groups of equal lengths. The plan is a list of runs; a run gives
ranks first..first+n-1 of a length the sequences seq..seq+n-1 at one offset.
Pieces are then numbered within their length and joined to the runs.

Defined cases: a null or empty text is the single id 0; rows that repeat are
packed separately; ids may repeat or be null; an empty table gives an empty result;
other columns are never read, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.tables import gapless_rank, give_back, slices, stored, text_of

CAPACITY, END_ID = 2048, 0
#: Rows of the plan that may be broadcast (six numbers each), and ranks of one length that share a key of the join.
MOST_BROADCAST, RANKS = 500_000, 1 << 16
#: Texts of these characters alone take the cached path: their case, normal form and classes are the same in every library.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-\xff]*\Z")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")


class _Ids(dict):
    """Ids of pre-tokens as bytes, encoded when first asked for; emptied when ``size`` is reached."""

    def __init__(self, lib, size: int):
        self.whole, self.tokenize, self.size = lib.encode, lib.model.tokenize, size

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        # ASCII stands for itself in the model's alphabet; other bytes go through the library's own mapping.
        ids = [t.id for t in self.tokenize(word)] if word.isascii() else self.whole(word, add_special_tokens=False).ids
        raw = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return raw


class WordTokenizer:
    """Ids of texts under a vocabulary that lower-cases, drops white space and marks word ends.

    Pre-tokens are encoded once while they stay in a cache of ``size`` words and
    their ids are strung together as bytes. Texts outside ``_PLAIN``, or with an
    added token's string in them, go to the library whole.
    """

    def __init__(self, path: str, size: int = 250_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.known = _Ids(self.lib, size)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if _PLAIN.match(t) and not any(a in t for a in self.added):
                out.append(b"".join(map(self.known.__getitem__, _PIECE.findall(t.lower()))))
            else:
                ids = self.lib.encode(t, add_special_tokens=False).ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc) of every document's pieces."""
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))

    def go(batches):
        tok = WordTokenizer(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for part in slices(batches, 256):
            at, piece, start, length, crc = [], [], [], [], []
            for k, raw in enumerate(tok.ids(part.column(1).to_pylist())):
                raw += end
                for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[a : a + 4 * capacity]
                    at.append(k), piece.append(p), start.append(a // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "crc"],
            )
        del tok
        give_back()

    fields = [T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "crc")]]
    return rows.mapInArrow(go, T.StructType([rows.schema["id"], *fields]))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, n, first sequence, offset)."""
    runs, room, filled, sequences = [], defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(filled, length)
            if k < len(filled):
                free = filled[k]
                seq, n = room[free].pop()
                used = min(n, left)
                if used < n:
                    room[free].append((seq + used, n - used))
                elif not room[free]:
                    filled.pop(k)
                steps = [(used, seq, capacity - free, free - length)]
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                steps = [(full, sequences, i * length, capacity - each * length if i == each - 1 else 0) for i in range(each) if full]
                steps += [(1, sequences + full, i * length, capacity - rest * length if i == rest - 1 else 0) for i in range(rest)]
                sequences += full + (rest > 0)
            for n, seq, offset, free in steps:
                runs.append((length, rank, n, seq, offset))
                rank += n
                left -= n
                if free:
                    if not room[free]:
                        bisect.insort(filled, free)
                    room[free].append((seq, n))
    return runs


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, ranks: int = RANKS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    rows = stored(pieces(docs, vocabulary, id_col, text_col, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces", texts=True)
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(plan(counts, capacity), "l long, first long, n long, seq long, offset long")
    # A run is cut where ranks change their share, so that pieces of a common length meet their runs under many keys.
    share = F.explode(F.sequence(F.expr(f"first div {ranks}"), F.expr(f"(first + n - 1) div {ranks}")))
    slots = stored(runs.withColumn("share", share), "packing-plan")
    if slots.count() <= MOST_BROADCAST:
        slots = F.broadcast(slots)
    ranked = gapless_rank(rows, ["length"], ["id", "piece", "crc"], "rank", "row")
    own = (F.col("length") == F.col("l")) & (F.expr(f"rank div {ranks}") == F.col("share")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    out = ranked.join(slots, own)
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        (F.col("seq") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
