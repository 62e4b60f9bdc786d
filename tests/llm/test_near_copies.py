import random
import re

import numpy as np
import pytest
import xxhash

from chronofold.llm import paragraphs, simhash
from chronofold.llm.tables import numbered, stored_parts
from llm_cases import ODD, prose


def brute_fp(t):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    parent = list(range(len(nodes)))

    def find(a):
        while parent[a] != a:
            a = parent[a] = parent[parent[a]]
        return a

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(nodes))]


def test_documents(docs):
    rows = ODD + [(100 + i, prose(1, 400).replace("a", "e", i)) for i in range(8)] + [(200 + i, prose(i, 50)) for i in range(20)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_groups(docs(rows)).collect()}
    assert {k for k in got} == {(i, f"{brute_fp(t):016x}") for i, t in rows}
    pairs = sorted(got, key=str)
    fps = [int(f, 16) for _, f in pairs]
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for k, p in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if root[j] == root[k] and pairs[j][0] is not None]
        assert got[p] == (min(ids) if ids else None)


@pytest.mark.parametrize("chunk", [2048, 3])
def test_no_link_is_lost(spark, chunk):
    r = random.Random(4)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.fingerprint_links(nodes, chunk=chunk).collect()
    for x in links:
        assert ((x["a"] ^ x["b"]) & (2**64 - 1)).bit_count() <= 4
    at = {int(np.uint64(f).astype(np.int64)): i for i, f in enumerate(fps)}
    have = {(at[x["a"]], at[x["b"]]) for x in links}
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    got = classes(list(range(len(fps))), lambda a, b: (a, b) in have or (b, a) in have)
    assert got == want


def test_every_pair_within_four_bits_meets():
    r = np.random.default_rng(0)
    x = r.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in r.choice(64, 4, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    rows, keys = simhash._anchors(np.concatenate([x, y]))
    sets = [set() for _ in range(600)]
    for a, k in zip(rows.tolist(), keys.tolist()):
        sets[a].add(k)
    assert all(sets[k] & sets[300 + k] for k in range(300))


def test_keep_one(docs):
    d = docs([(5, prose(1)), (3, prose(1)), (9, prose(2))])
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_group(d).collect()) == [3, 9]


def test_near_copies_with_repeated_and_absent_ids(docs):
    rows = [(2, prose(1)), (2, prose(5)), (1, prose(1)), (None, prose(1)), (None, prose(6)), (None, prose(6)), (4, None), (4, ""), (7, prose(7)), (7, prose(7))]
    left = sorted(((r["doc_id"], r["text"] or "") for r in simhash.keep_one_of_group(docs(rows)).collect()), key=str)
    assert left == sorted([(1, prose(1)), (2, prose(5)), (None, prose(6)), (7, prose(7)), (4, "")], key=str)


@pytest.mark.parametrize("chunk", [2048, 2])
def test_near_copies_are_found_and_others_stay(docs, chunk):
    """Recall over pairs of a similarity of 0.8 or more, and no link far below it."""
    r = random.Random(5)
    rows, pairs = [], []
    for k in range(150):
        w = prose(7000 + k, r.randint(80, 400)).split()
        v = list(w)
        for _ in range(max(1, int(len(v) * r.choice([0.005, 0.01, 0.015, 0.02, 0.05, 0.1])))):
            v[r.randrange(len(v))] = "zz" + str(r.randrange(10**6))
        a, b = grams(" ".join(w)), grams(" ".join(v))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append((2 * k, len(a & b) / len(a | b)))
    left = {x["__id"] for x in simhash.near_groups(docs(rows), chunk=chunk).where("__id = leader.__id").collect()}
    near, far = [i for i, j in pairs if j >= 0.8], [i for i, j in pairs if j < 0.65]
    assert len(near) >= 40 and len(far) >= 30
    assert all(i in left for i, _ in pairs)
    assert sum(i + 1 not in left for i in near) >= 0.9 * len(near)
    assert all(i + 1 in left for i in far)


PASSAGE = ". ".join(prose(70 + i, 14).capitalize() for i in range(5)) + "."


def test_paragraphs(docs):
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    rows = ODD + [
        (20, base + "\n" + prose(2, 40)), (21, prose(3, 40) + "\n" + " ".join(near)), (22, prose(4, 40) + "\n" + base.upper()), (23, prose(5, 30) + ". " + PASSAGE + " " + prose(6, 30)), (24, prose(7, 30) + ". " + PASSAGE + " " + prose(8, 30)),
        (25, prose(9, 200)), (26, prose(10, 30) + "\nAll rights reserved here today folks"), (27, prose(11, 30) + "\nAll rights reserved here today folks"), (28, "\n".join([prose(12, 40)] * 3)),
    ]
    got = {r["doc_id"]: r for r in paragraphs.dedup_paragraphs(docs(rows), with_bytes=True).collect()}
    removed = {i for i, r in got.items() if r["n_removed"]}
    assert removed == {21, 22, 24}
    assert bytes(got[21]["kept"]).decode() == prose(3, 40) + "\n" and PASSAGE[:-1] not in bytes(got[24]["kept"]).decode() and prose(8, 30) in bytes(got[24]["kept"]).decode()


def parts_of(d, least=20):
    """Rows (doc, text, body) of documents and their parts by kind."""
    from pyspark.sql import functions as F

    rows = numbered(d, "doc_id", "text").select("doc", "text", "body")
    parts = stored_parts(rows.mapInArrow(lambda x: paragraphs._scan(x, least), paragraphs._ROW_SQL), "test", "kind", 5)
    segments = parts[paragraphs.SEGMENTS].select(F.col("key").alias("gram"), "seg", "doc", "text", "start", "end", F.col("ordinal").alias("first"), "n")
    return rows, parts[paragraphs.LINES].withColumnRenamed("key", "line"), segments, parts[paragraphs.SPANS].select("doc", "text", "start", "end")


def grams(line, n=5):
    w = line.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


@pytest.mark.parametrize("chunk", [512, 2])
def test_line_links_match_brute_force(docs, monkeypatch, chunk):
    monkeypatch.setattr(paragraphs, "CHUNK", chunk)
    r = random.Random(2)
    lines = []
    for g in range(6):
        w = prose(500 + g, 60).split()
        for _ in range(6):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(60)] = "zz" + str(r.randrange(999))
            lines.append(" ".join(v))
    lines = sorted(set(lines))
    d, members, _, _ = parts_of(docs(list(enumerate(lines))))
    line_of = {m["doc"]: m["line"] for m in members.collect()}
    comp = {c["node"]: c["component"] for c in paragraphs.line_classes(d, members).collect()}
    sets = [grams(x) for x in lines]
    want = classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    got = [comp.get(line_of[i], line_of[i]) for i in range(len(lines))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def brute_windows(rows):
    """Byte marks of each (id, text): words in a window of an earlier document, both lower case."""
    firsts, marks = {}, {}
    for i, t in sorted({((2**63 - 1) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], hash64(r[1]))):
        w, m = [(x.start(), x.end(), x[0].lower()) for x in re.finditer(r"\S+", t)], bytearray(len(t.encode()))
        for k in range(len(w) - paragraphs.PASSAGE + 1):
            span = w[k : k + paragraphs.PASSAGE]
            if firsts.setdefault(tuple(x[2] for x in span), (i, t)) != (i, t):
                a, z = len(t[: span[0][0]].encode()), len(t[: span[-1][1]].encode())
                m[a:z] = b"\1" * (z - a)
        marks[(i, t)] = bytes(m)
    return marks


def hash64(t):
    return xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >= 1 << 63 else 0)


CUT = prose(300, 60)  # 60 words without a sentence end
INSIDE = [(40 + i, prose(310 + i, 45) + " é\u3000" + CUT + " " + prose(330 + i, 35)) for i in range(9)] + [
    (60, prose(350, 40) + "\n" + prose(351, 9) + " " + CUT.upper()), (61, CUT[: len(CUT) // 2] + "\n\t" + CUT[len(CUT) // 2 :].lstrip() + " " + prose(352, 30)), (62, " ".join([prose(353, 60)] * 3)),
    (63, prose(354, 30) + " " + " ".join(CUT.split()[:49])), (64, prose(355, 70)), (64, prose(355, 70)), (64, prose(355, 70) + " more"), (None, prose(356, 80)), (None, prose(356, 80)), (65, "a " * 300), (66, "a " * 400),
]


def marked(rows, spans):
    want = {(i, hash64(t)): m for (i, t), m in brute_windows(rows).items()}
    got = {k: bytearray(len(m)) for k, m in want.items()}
    for doc, text, start, end in spans:
        got[(doc, text)][start:end] = b"\1" * (end - start)
    assert {k: bytes(m) for k, m in got.items()} == want and sum(map(sum, want.values())) > 4000


@pytest.mark.parametrize(("crowd", "most"), [(2000, 50_000), (2, 50_000), (2000, 2)])
def test_passages_match_brute_force(docs, monkeypatch, crowd, most):
    monkeypatch.setattr(paragraphs, "CROWD", crowd)
    monkeypatch.setattr(paragraphs, "MOST_ROWS", most)
    rows = ODD + INSIDE
    d, _, segments, spans = parts_of(docs(rows).repartition(5))
    marked(rows, [tuple(r) for r in paragraphs.repeated_passages(d, segments).unionByName(spans).collect()])


@pytest.mark.parametrize(("block", "stretch", "batch"), [(24 << 20, 1 << 17, 10_000), (1500, 64, 7), (1, 1 << 17, 1)])
def test_passages_of_small_blocks_and_batches(monkeypatch, block, stretch, batch):
    monkeypatch.setattr(paragraphs, "BLOCK_BYTES", block)
    monkeypatch.setattr(paragraphs, "STRETCH", stretch)
    import pyarrow as pa

    rows = ODD + INSIDE
    random.Random(3).shuffle(rows)
    table = [(2**63 - 1 if i is None else i, hash64(t or ""), t or "") for i, t in rows]
    bodies = {r[:2]: r[2] for r in table}
    tables = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table[k : k + 9])], ["doc", "text", "body"]) for k in range(0, len(table), 9)]
    cut = lambda rs, kind: [pa.RecordBatch.from_pylist(rs[k : k + batch], kind) for k in range(0, len(rs), batch)]
    made = [r for b in paragraphs._scan(tables, 20) for r in b.to_pylist()]
    filed = [{"gram": r["key"], "first": r["ordinal"], **{k: r[k] for k in ("seg", "doc", "text", "start", "end", "n")}} for r in made if r["kind"] == paragraphs.SEGMENTS]
    filed.sort(key=lambda r: (r["gram"], r["seg"], r["doc"], r["text"], r["start"]))
    settled = [r for b in paragraphs._settled(cut(filed, pa.schema(paragraphs._FILED))) for r in b.to_pylist()]
    mixed = [r for r in settled if r["gram"] is not None]
    per_doc = [pa.RecordBatch.from_pylist([{"doc": k[0], "text": k[1], "body": t, "segs": [r for r in mixed if (r["doc"], r["text"]) == k]}]) for k, t in bodies.items() if any((r["doc"], r["text"]) == k for r in mixed)]
    hashed = sorted((r for b in paragraphs._window_hashes(per_doc) for r in b.to_pylist()), key=lambda r: (r["gram"], r["doc"], r["text"], r["first"]))
    spans = [r for r in settled if r["gram"] is None] + [r for b in paragraphs._compared(cut(hashed, None)) for r in b.to_pylist()] + [r for r in made if r["kind"] == paragraphs.SPANS]
    marked(rows, [(r["doc"], r["text"], r["start"], r["end"]) for r in spans])


def brute_paragraphs(rows, least=20):
    """Kept bytes of each (id, text) by plain Python: similar lines, runs of equal sentences, windows."""
    table = sorted({((2**63 - 1) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], hash64(r[1])))
    marks = {k: bytearray(m) for k, m in brute_windows(rows).items()}
    byte = lambda t, at: len(t[:at].encode())
    lines, sentences = [], {}
    parsed = {}
    for me in table:
        units, at, n = [], 0, 0
        for ln in me[1].split("\n"):
            w = [(at + x.start(), at + x.end(), x[0].lower()) for x in re.finditer(r"\S+", ln)]
            if len(w) >= least:
                lines.append((me, byte(me[1], at), byte(me[1], at + len(ln)), tuple(x[2] for x in w)))
            begin = own = 0
            for k, x in enumerate(w):
                own += 1
                if me[1][x[1] - 1] in ".!?" or k == len(w) - 1:
                    if own >= 5:
                        units.append((n + begin, n + k, w[begin][0], x[1], tuple(y[2] for y in w[begin : k + 1])))
                        begin = k + 1
                    own = 0
            at, n = at + len(ln) + 1, n + len(w)
        parsed[me] = units
        for u in units:
            sentences.setdefault(u[4], me)
    sets = [grams(" ".join(x[3])) for x in lines]
    for k, root in enumerate(classes(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))):
        me, start, end, _ = lines[k]
        if lines[root][0] != me:
            marks[me][start:end] = b"\1" * (end - start)
    for me, units in parsed.items():
        run = []
        for u in [*units, None]:
            if u and sentences[u[4]] != me and (not run or run[-1][1] + 1 == u[0]):
                run.append(u)
                continue
            if sum(len(x[4]) for x in run) >= least:
                a, z = byte(me[1], run[0][2]), byte(me[1], run[-1][3])
                marks[me][a:z] = b"\1" * (z - a)
            run = [u] if u and sentences[u[4]] != me else []
    return {me: bytes(x for x, m in zip(me[1].encode(), marks[me]) if not m) for me in table}


SHORT = [". ".join(prose(600 + i, n) for i, n in ((0, 8), (1, 3), (2, 9), (3, 12), (4, 2), (5, 6))) + "!", prose(610, 24) + ". " + prose(611, 3) + ". " + prose(612, 7) + "?"]
MIXED = [(80, prose(620, 25) + ". " + SHORT[0] + "\n" + SHORT[1]), (81, SHORT[0] + " " + prose(621, 30)), (82, prose(622, 9) + ". " + SHORT[1] + " " + prose(623, 12) + ".\nHead\n" + SHORT[0]), (83, SHORT[1].replace(prose(611, 3), prose(624, 3))), (84, SHORT[0].replace(". ", ".")), ("x", None)][:5]


@pytest.mark.parametrize("least", [20, 6])
def test_removal_matches_brute_force(docs, least):
    near = prose(1, 60).split()
    near[30] = "changed"
    rows = ODD + INSIDE + MIXED + [(20, prose(1, 60) + "\n" + prose(2, 40)), (21, prose(3, 40) + "\n" + " ".join(near)), (22, prose(4, 40) + "\n" + prose(1, 60).upper() + "\n" + prose(640, 7)), (23, prose(640, 7) + "\n" + prose(641, 5))]
    want = brute_paragraphs(rows, least)
    got = paragraphs.dedup_paragraphs(docs(rows).repartition(4), with_bytes=True, least_words=least).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [v for (i, _), v in want.items() if i == (2**63 - 1 if r["doc_id"] is None else r["doc_id"])]
        assert bytes(r["kept"]) in mine
    assert sorted(bytes(r["kept"]) for r in got) == sorted(want[(2**63 - 1 if i is None else i, t or "")] for i, t in rows)
    assert sum(r["n_removed"] for r in got) > 5000


def test_ids_that_are_text_are_ordered_as_text(spark):
    rows = [("b10", prose(401, 31) + " " + CUT), ("b9", CUT + " " + prose(402, 33)), ("a", "x"), (None, CUT + " " + prose(403, 33)), ("b10", "other")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], bytes(r["kept"]).decode()) for r in paragraphs.dedup_paragraphs(d, with_bytes=True).collect()}
    assert got == {("b10", rows[0][1]), ("b9", " " + prose(402, 33)), ("a", "x"), (None, " " + prose(403, 33)), ("b10", "other")}


def test_passage_inside_unlike_lines(docs):
    rows = [(1, prose(401, 31) + " " + CUT + " " + prose(402, 33)), (2, prose(403, 37) + " " + CUT + " " + prose(404, 29))]
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in paragraphs.dedup_paragraphs(docs(rows), with_bytes=True).collect()}
    assert got == {1: rows[0][1], 2: prose(403, 37) + "  " + prose(404, 29)}


def test_empty_tables(docs):
    assert simhash.simhash_groups(docs([])).count() == 0 and paragraphs.dedup_paragraphs(docs([])).count() == 0


def test_a_large_group_of_near_copies_is_not_met_again_at_each_fingerprint(spark, monkeypatch):
    base = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(base[:i] + [f"other{i}"] + base[i + 1 :])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"lone{i}x{j}" for j in range(30))) for i in range(20)]
    met = []
    real = simhash.stored

    def counted(df, name, **more):
        out = real(df, name, **more)
        if name.endswith("meetings"):
            met.append(out.selectExpr("coalesce(sum(size(nodes)), 0)").first()[0])
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["leader"]["__id"] for x in found if x["__id"] < 1000} == {0}
    assert all(x["leader"]["__id"] == x["__id"] for x in found if x["__id"] >= 1000)
    assert sum(met) < 300 * 45


@pytest.mark.parametrize("t", ["", " ", "a", " a", "a ", "ab  c\n", "\x1cab\x1fc", "é\u3000ab\u2003ç 𝄞 x"])
def test_edges_are_those_of_split(t):
    space = paragraphs._SPACE[np.minimum(np.frombuffer(t.encode("utf-32-le"), "<u4"), 0x3001)]
    edge = paragraphs._edges(space)
    assert [t[a:z] for a, z in zip(edge[::2], edge[1::2])] == t.split()
    a, z = paragraphs._places(t)
    assert [t.encode()[i:j].decode() for i, j in zip(a, z)] == t.split()


def joined(df):
    """Rows that the joins of ``df`` make."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(walk(p.children().apply(k)) for k in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_sketch_is_looked_up_once_however_often_its_document_meets_others(spark, monkeypatch):
    base = [f"word{i}" for i in range(400)]
    n = 200
    rows = [(i, " ".join(base[:i] + [f"other{i}"] + base[i + 1 :])) for i in range(n)]
    rows += [(1000 + i, " ".join(f"lone{i}x{j}" for j in range(30))) for i in range(20)]
    made, real = {}, simhash.stored

    def counted(df, name, **more):
        if name in ("sketch-first-links", "sketch-rest-links"):
            made[name] = joined(df)
        return real(df, name, **more)

    monkeypatch.setattr(simhash, "stored", counted)
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["leader"]["__id"] for x in found if x["__id"] < n} == {0}
    assert all(x["leader"]["__id"] == x["__id"] for x in found if x["__id"] >= n)
    assert n / 2 <= made["sketch-first-links"] <= 2 * n and made["sketch-rest-links"] <= 2 * n  # 5,291 and more before


def test_a_linked_group_at_a_crowded_anchor_is_not_sent_once_for_each_of_its_chunks(spark):
    n, chunk = 400, 10
    others = {n: 7, n + 1: 8, n + 2: 8}
    rows = [(5, i, 0, 0) for i in range(n)] + [(5, i, 0, c) for i, c in others.items()] + [(6, 1, 0, 0), (6, n, 0, 7), (7, 2, 0, 0)]
    keyed = spark.createDataFrame(rows, "anchor long, node long, check long, c long")
    crowded = spark.createDataFrame([(5,)], "anchor long")
    met = [{v["node"] for v in r["members"]} for r in simhash._near_meetings(keyed, crowded, chunk, False)[0].collect()]
    for a in range(n + 3):
        for b in others:
            assert a == b or any({a, b} <= x for x in met)
    assert sum(map(len, met)) <= 2 * n  # 41 * n where each pair of chunks meets
    alone = [{v["node"] for v in r["members"]} for r in simhash._near_meetings(keyed.withColumn("c", keyed["node"]), crowded, chunk, True)[0].collect()]
    assert sorted(x for m in alone for x in m if m != {1, n}) == list(range(n + 3))
