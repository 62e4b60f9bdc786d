import os
import zlib
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import packing, tokens
from llm_cases import ODD, prose

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE), reason="no vocabularies")
ROWS = ODD + [(20, "  \n\n x y <|endoftext|> don't 's"), (21, "日本語 ΑΣ İ é á ½ x²"), (22, "it's !'s '' 12ab _a_ <</w>>\r\n\t z  "), (23, "  nbsp\u0085next")] + [(100 + i, prose(i, 30 + 7 * i)) for i in range(60)]


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_counts(docs, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    lib = tokenizers.Tokenizer.from_file(BYTE)
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs(ROWS).repartition(4), BYTE).collect()) == want


def test_packing(docs):
    lib = tokenizers.Tokenizer.from_file(WORD)
    got = packing.pack(docs(ROWS), WORD, capacity=256).collect()
    want = Counter()
    for i, t in ROWS:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            want[(i, p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in seqs.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 256
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 256) + 1


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 20), rng.integers(1, 50, 20))}
        runs = packing.plan(counts, 64)
        full = {}
        for length, first, n, seq, offset in runs:
            for k in range(n):
                full.setdefault(length, []).append(first + k)
                assert offset + length <= 64
        assert {k: sorted(v) for k, v in full.items()} == {k: list(range(n)) for k, n in counts.items()}
        used = {}
        for length, _, n, seq, offset in runs:
            for k in range(n):
                used.setdefault(seq + k, []).append((offset, length))
        for spans in used.values():
            end = 0
            for o, n in sorted(spans):
                assert o == end
                end = o + n


def test_empty_tables(docs):
    assert tokens.token_counts(docs([]), BYTE).count() == 0 and packing.pack(docs([]), WORD).count() == 0
