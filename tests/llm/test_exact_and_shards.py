import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronofold.llm import exact, shards
from llm_cases import ODD


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    out = []
    for n, (i, t) in enumerate(rows):
        g = groups[re.sub("[\x20\x09-\x0d]", "", t or "")]
        out.append((i, None if min(g)[1] else min(g)[2], len(g), hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact(docs, digest_all):
    rows = ODD + [(100 + i, f"copy{' ' * (i % 3)} of one") for i in range(40)] + [(200 + i, f"text {i}") for i in range(30)]
    got = exact.exact_dedup(docs(rows), digest_all=digest_all).collect()
    want, groups = brute(rows)
    if digest_all:
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    assert sum(r["kept"] for r in got) == groups


def test_keep_distinct_keeps_columns_and_one_of_repeated_rows(docs):
    d = docs(ODD)
    out = exact.keep_distinct(d)
    assert out.columns == d.columns and out.count() == brute(ODD)[1]


def test_empty_tables(docs):
    d = docs([])
    assert exact.exact_dedup(d).count() == 0 and exact.keep_distinct(d).count() == 0 and shards.kd_shards(d).count() == 0


def test_shards_are_even_and_gapless(docs):
    rows = ODD + [(1000 + i, "z" * (i * 37 % 400)) for i in range(3000)]
    d = docs(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = shards.kd_shards(d).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes, slots = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    target = sum(sizes.values()) / 16
    assert max(abs(v - target) for v in sizes.values()) <= 15001  # the largest document


def plain_tree(rows, leaves, first=0):
    """Shard of each row (number, size, keys) by a k-d tree in plain Python."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    widths = [max(r[2][d] >> shards.HASH_BITS for r in rows) - min(r[2][d] >> shards.HASH_BITS for r in rows) for d in range(len(rows[0][2]))]
    d = widths.index(max(widths))
    want, low, cut = sum(r[1] for r in rows) * (leaves // 2) / leaves, 0, 0
    for r in sorted(rows, key=lambda r: r[2][d]):
        if low + r[1] >= want:
            cut = r[2][d] + (want - low > r[1] / 2)
            break
        low += r[1]
    left, right = [r for r in rows if r[2][d] < cut], [r for r in rows if r[2][d] >= cut]
    return plain_tree(left, leaves // 2, first) | plain_tree(right, leaves - leaves // 2, first + leaves // 2)


def test_shards_are_those_of_a_plain_tree(docs, monkeypatch):
    monkeypatch.setattr(shards, "NEAR", 0.0)
    rows = [(i, "w" * (1 + i * 7919 % 97)) for i in range(600)]
    source = F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit("src1"), F.col("doc_id") % 13))
    d = docs(rows).withColumn("source", source).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise("enm"))
    keys, dims, _ = shards.shard_keys(d)
    table = [(r["id"], r["size"], [r[k] for k in dims]) for r in keys.collect()]
    # Sources that begin alike are told apart, and lie in their order.
    places = {}
    for i, _, k in table:
        places.setdefault(None if i % 5 == 0 else f"src1{i % 13}", set()).add(k[0] >> shards.HASH_BITS)
    assert all(len(p) == 1 for p in places.values()) and len({min(p) for p in places.values()}) == 14
    named = sorted((k for k in places if k), key=str)
    assert min(places[None]) < min(places[named[0]]) and [min(places[k]) for k in named] == sorted(min(places[k]) for k in named)
    for n in (16, 5):
        got = {r["doc_id"]: r["shard"] for r in shards.kd_shards(d, n).collect()}
        assert got == plain_tree(table, n)


def test_written_shards_hold_every_row(docs, tmp_path, spark):
    rows = ODD + [(7, "Éa  b ")] * 5
    shards.write_shards(docs(rows), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(rows, key=str)


def test_any_number_of_shards(docs):
    rows = [(i, "y" * (i % 50)) for i in range(700)]
    for n in (1, 3, 7):
        got = shards.kd_shards(docs(rows), n).groupBy("shard").agg(F.sum("size").alias("b")).collect()
        assert len(got) == n and max(r["b"] for r in got) - min(r["b"] for r in got) <= 150
