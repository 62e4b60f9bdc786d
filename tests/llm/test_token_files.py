"""Token-id files: exact round trips, the library's own ids, optimal code lengths, damaged files."""

import glob
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from chronofold.llm import token_files as F
from chronofold.llm.queries import vocabulary
from llm_cases import ODD, prose

PATH = vocabulary("byte_bpe_50k.json")
LIB = F.ByteTokenizer(PATH).lib
TOK = F.ByteTokenizer(PATH)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids + [F.END_ID]


def expected(rows):
    """Brute force: (id, start, n, crc) in the order of ids, ties by length and digest, nulls last."""
    found = []
    for i, t in rows:
        ids = np.array(ids_of(t), "<u4")
        found.append((i is None, i if i is not None else 0, len(ids), zlib.crc32(ids.astype(TOK.kind)), zlib.crc32(ids), i))
    out, start = [], 0
    for *_, n, _, crc, i in sorted(found):
        out.append((i, start, n, crc))
        start += n
    return sorted(out, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\r'sabcT1²é!. \0\x0b日<|>"), max_size=30) | st.text(max_size=40) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "don't", "x1", "...", "<|endoftext|>", "É"]), max_size=12).map("".join))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(TOK(text), TOK.kind).tolist() == LIB.encode(text, add_special_tokens=False).ids


def huffman_cost(counts):
    """The least total of an unlimited code."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def best_limited(counts, most):
    """The least total of a code of at most ``most`` bits, over all length vectors."""
    counts, found = sorted(counts, reverse=True), []

    def go(k, last, room, cost):
        if k == len(counts):
            found.append(cost)
            return
        for length in range(last, most + 1):
            if room >= (len(counts) - k) / 2**most and room - 2.0**-length >= 0:
                go(k + 1, length, room - 2.0**-length, cost + length * counts[k])

    go(0, 1, 1.0, 0)
    return min(found)


def test_code_lengths_are_optimal_and_limited():
    r = random.Random(1)
    for n in (2, 3, 10, 300):
        counts = np.array([r.randint(1, 10 ** r.randint(1, 6)) for _ in range(n)])
        lengths = F.code_lengths(counts, 40)
        assert (lengths @ counts) == huffman_cost(counts.tolist()) and sum(0.5 ** lengths.astype(float)) == 1
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = F.code_lengths(np.array(fib), 12)
    assert lengths.max() == 12 and sum(0.5 ** lengths.astype(float)) <= 1
    for _ in range(10):
        counts = np.array([r.randint(1, 1000) ** 2 for _ in range(6)])
        assert int(F.code_lengths(counts, 3) @ counts) == best_limited(counts.tolist(), 3)
    assert F.code_lengths(np.array([1 << 60] * 5 + [1])).tolist() and F.code_lengths(np.array([5])).tolist() == [1]
    with pytest.raises(ValueError):
        F.code_lengths(np.ones(9, int), 3)


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 256, 5000])
def test_segment_round_trip_and_single_blocks(n):
    ids = (np.random.default_rng(n).geometric(0.02, n) * 7).astype(np.uint32)
    seen, times = np.unique(ids, return_counts=True)
    book = F.Book.from_bytes(F.Book(seen, F.code_lengths(times)).to_bytes())
    codes = book.by_id()
    pieces = pa.RecordBatch.from_arrays([pa.array(["d"]), pa.array([0]), pa.array([n]), pa.array([True])], ["id", "start", "n", "ends"])
    raw = F.segment(3, 4, 5, ids, pieces, codes) + b"\n"
    ((part, number, before, m, back, sizes, bits),) = F.segments(raw)
    assert (part, number, before, m, back.to_pydict()) == (3, 4, 5, n, {"id": ["d"], "start": [0], "n": [n], "ends": [True]})
    table = book.table()
    assert (F.decode_blocks(bits, sizes, n, table, book.bits) == ids).all()
    for k in range(len(sizes)):  # any block by itself, from its offset
        assert (F.decode_blocks(bits, sizes, n, table, book.bits, k, k + 1) == ids[k * 128 : (k + 1) * 128]).all()
    assert len(bits) <= (int((codes[ids] & np.uint64(31)).sum()) + 7) // 8
    for at in (0, len(raw) // 2, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(Exception):
            list(F.segments(bad))
    if n > 1:
        wrong = sizes.copy()
        wrong[-1] -= 1
        with pytest.raises(ValueError):
            F.decode_blocks(bits, wrong, n, table, book.bits)


def run(docs, rows, **more):
    out = F.token_files(docs(rows), PATH, **more)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_documents_round_trip(spark, docs, monkeypatch, tmp_path):
    r = random.Random(5)
    rows = ODD + [(i, prose(i, r.randint(0, 90))) for i in r.sample(range(-50, 400), 120)] + [(77, "same text")] * 40 + [(500, "a\0b <|endoftext|> 日本 \x0b\n  x"), (501, "Don't  stop \n\n now ")]
    assert run(docs, rows) == expected(rows)
    monkeypatch.setattr(F, "SEGMENT_IDS", 300)  # long documents then lie in several segments
    assert run(docs, rows, path=f"file://{tmp_path}/t") == expected(rows)
    files = sorted(glob.glob(f"{tmp_path}/t/data/part-*"))
    ordered = []
    for f in files:
        for *_, pieces, _, _ in F.segments(open(f, "rb").read()):
            ordered += [i for i, s in zip(pieces.column("id").to_pylist(), pieces.column("start").to_pylist()) if s == 0]
    assert ordered == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    assert all(re.match(r"part-\d", f.rsplit("/", 1)[1]) for f in files)


def test_empty_table_and_other_ids(spark, docs):
    assert run(docs, []) == [] and run(docs, [(1, None)]) == expected([(1, None)])
    df = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "")], "k string, body string")
    out = F.token_files(df, PATH, "k", "body")
    assert out.schema["k"].dataType == T.StringType()
    assert [(r["k"], r["start"], r["n_tokens"]) for r in out.orderBy("start").collect()] == [("a", 0, 2), ("b", 2, len(ids_of("two words"))), (None, 2 + len(ids_of("two words")), 1)]
