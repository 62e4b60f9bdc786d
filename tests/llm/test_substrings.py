import hashlib

import pytest

from chronofold.llm import substrings
from llm_cases import ODD, prose


def brute(rows, length=100):
    docs = sorted({((2**63 - 1) if i is None else i, (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, b in docs:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                m[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, k in zip(b, m) if not k)
        runs = sum(1 for j in range(len(m)) if m[j] and (not j or not m[j - 1]))
        out[(i, b)] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


PASSAGE, OTHER = prose(1, 40), prose(2, 60)
ROWS = [r for r in ODD if r != (8, "other")] + [(20 + i, prose(30 + i, 50) + " " + PASSAGE + " " + prose(60 + i, 30)) for i in range(12)] + [(50, OTHER), (51, OTHER), (52, OTHER[:300] + "#" + OTHER[301:]), (53, "é" * 200), (54, "ab" * 150), (55, OTHER + OTHER)]


@pytest.mark.parametrize(("crowd", "rows", "block"), [(2000, 50_000, 24 << 20), (2, 50_000, 1500), (2000, 2, 1500)])
def test_against_brute_force(docs, monkeypatch, crowd, rows, block):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "MOST_ROWS", rows)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    want = brute(ROWS)
    got = substrings.dedup_substrings(docs(ROWS).repartition(3)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        mine = [v for (i, b), v in want.items() if i == (2**63 - 1 if r["doc_id"] is None else r["doc_id"])]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in mine


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeated_rows_in_different_partitions_are_one_document(docs, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    twice = [(70, OTHER[:300]), (71, PASSAGE + "!" + PASSAGE), (None, prose(80, 50)), (72, OTHER[:150] + "#" + prose(81, 40))]
    rows = [*twice, *twice, (60, PASSAGE), *twice]
    d = docs(rows[:1])
    for r in rows[1:]:
        d = d.union(docs([r]))  # each row in a partition of its own
    want = brute(rows)
    got = substrings.dedup_substrings(d).collect()
    assert len(got) == len(rows)
    texts = {i: (t or "").encode() for i, t in rows}
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[(2**63 - 1 if r["doc_id"] is None else r["doc_id"], texts[r["doc_id"]])]


def test_kept_bytes(docs):
    got = {r["doc_id"]: r["kept"] for r in substrings.dedup_substrings(docs([(1, OTHER), (2, "head " + OTHER)]), with_bytes=True).collect()}
    assert bytes(got[1]).decode() == OTHER and bytes(got[2]) == b"head "


def test_empty_table(docs):
    assert substrings.dedup_substrings(docs([])).count() == 0


def test_ids_that_are_text_are_ordered_as_text(spark):
    rows = [("b10", OTHER), ("b9", "head " + OTHER), (None, OTHER + " tail"), ("b10", "other"), ("x", None)]
    got = {(r["doc_id"], bytes(r["kept"]).decode()) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string"), with_bytes=True).collect()}
    assert got == {("b10", OTHER), ("b9", "head "), (None, " tail"), ("b10", "other"), ("x", "")}
