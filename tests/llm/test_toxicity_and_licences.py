import random
import tracemalloc

import numpy as np
import pytest

from chronofold.llm import licences, toxicity
from llm_cases import ODD, prose


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = prose(seed * 10_000 + i, 40).split()
        insult, group = r.random() < 0.5, r.random() < 0.5
        if insult:
            w.insert(r.randrange(40), "rotten")
        if group:
            w.insert(r.randrange(40), "martians")
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_are_learnt_and_held_out(spark, docs):
    rows, labels = corpus(1200, 3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs(rows), lab)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(rows), machine).collect()}
    import zlib

    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i]["predicted"] == dict(labels)[i] for i in held)
    assert right >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs(rows), machine)
    assert kept.columns == docs(rows).columns and kept.count() == sum(not r["predicted"] for r in got.values())


def test_pairs_of_which_neither_term_tells_alone():
    """Toxic if both words are there or neither is: each word by itself leaves the odds as they are."""
    import zlib

    import numpy as np

    rows, _ = corpus(2400, 9)
    y = np.array([("rotten" in t.split()) == ("martians" in t.split()) for _, t in rows], np.int64)
    terms = [toxicity.terms_of(t) for _, t in rows]
    held = np.array([zlib.crc32(str(i).encode()) % 3 == toxicity.HELD_OUT for i, _ in rows])
    train = [t for t, h in zip(terms, held) if not h]
    both = {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in ("rotten$", "martians$")}
    for w in both:
        has = np.array([w in set(t.tolist()) for t in train])
        assert toxicity.told(y[~held][has].sum() * 1.0, has.sum() * 1.0, int(y[~held].sum()), len(train)) < toxicity.LEAST_RATIO
    machine = toxicity.fit(train, y[~held])
    assert all(machine.slots[w] >= 0 for w in both)
    s = machine.score([(p := machine.slots[t])[p >= 0] for t, h in zip(terms, held) if h])
    assert ((s >= 0.5) == (y[held] == 1)).mean() >= 0.95


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.1')", reason="no test tables")
def test_counts_of_pairs_take_little_of_the_driver():
    """2,048 terms: two tables of counts of 8 MB each, the presence of 1,000 texts, and no third table beside them."""
    r = np.random.default_rng(3)
    terms = [np.sort(r.choice(2048, 60, replace=False)).astype(np.int32) for _ in range(1500)]
    labels = (r.random(1500) < 0.2).astype(np.int64)
    tracemalloc.start()
    toxicity.telling_pairs(terms, labels, np.arange(2048))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_held_out_labels_of_the_given_tables():
    """The labels of the held-out third, from a machine of the other two thirds."""
    import zlib

    import duckdb
    import numpy as np

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT l.doc_id, max(l.toxic), any_value(text) FROM '{sf}/labels.parquet' l JOIN '{sf}/documents.parquet' USING (doc_id) WHERE l.toxic IS NOT NULL GROUP BY 1 ORDER BY 1").fetchall()
    terms, y = [toxicity.terms_of(t) for _, _, t in rows], np.array([x for _, x, _ in rows])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == toxicity.HELD_OUT for i, _, _ in rows])
    machine = toxicity.fit([t for t, h in zip(terms, held) if not h], y[~held])
    found = machine.score([(s := machine.slots[t])[s >= 0] for t, h in zip(terms, held) if h]) >= toxicity.THRESHOLD
    assert found[y[held] == 1].mean() >= 0.8 and found[y[held] == 0].mean() <= 0.005


def test_odd_rows_and_labels(spark, docs):
    for labels in ([], [(8, 0)], [(8, 1)], [(None, 1), (8, None)]):
        machine = toxicity.train(docs(ODD), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.toxicity_scores(docs(ODD), machine).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity_scores(docs([]), machine).count() == 0


def test_licences(spark, docs):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    rows = ODD + [(20, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (21, mit.replace("sublicense", "sub-licence").replace('"', "''")), (22, mit + " Also pay me."), (23, "Some prose\nLicensed under the Apache Licence, version 2.0\nReleased under the MIT License."), (24, "# (c) Me"), (25, "All  rights RESERVED")]
    got = {}
    for r in licences.licence_scan(docs(rows), licences.known_licences(spark)).collect():
        got[r["doc_id"]] = (r["licence"], r["notices"], r["n_notices"])
    assert got[20] == ("MIT", "", 0) and got[21][0] == "MIT" and got[22] == (None, "", 0) and got[23] == (None, "Apache-2.0,MIT", 2) and got[24] == (None, "", 0) and got[25] == ("all-rights-reserved", "all-rights-reserved", 1)
    assert licences.licence_scan(docs([]), licences.known_licences(spark)).count() == 0
    # Every form is respelt, however long and whatever is known.
    spelt = [(30, "https " * 900 + "sub\nlicence"), (31, "http " * 900 + "sublicense")]
    for known in ([("Mine", "http " * 900 + "SUB-LICENSE")], []):
        found = licences.licence_scan(docs(spelt), licences.known_licences(spark, known)).collect()
        assert len({r["text_digest"] for r in found}) == 1 and {r["licence"] for r in found} == ({"Mine"} if known else {None})
    assert licences.licence_scan(docs(rows), licences.known_licences(spark, [])).where("licence is not null or n_notices > 0").count() == 0


def test_full_licence_texts(spark, docs):
    texts = {p.stem: p.read_text() for p in (__import__("pathlib").Path(licences.__file__).parent / "licence_texts").glob("*.txt")}
    names = sorted(texts)
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "BSL-1.0", "0BSD"} <= set(names)
    rows = [(100 + i, "Copyright (c) 2021 B. Person\n\n" + __import__("re").sub(r"\blicense\b", "licence", texts[n]).upper()) for i, n in enumerate(names)]
    rows += [(10, texts["GPL-3.0"].split("END OF TERMS")[0]), (11, texts["GPL-3.0"] + " And more."), (12, "Prose.\n" + " ".join(texts["MPL-2.0"].split())), (13, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + licences.KNOWN[0][1]), (14, "BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n" + texts["BSD-3-Clause"])]
    scan = lambda **more: {r["doc_id"]: r for r in licences.licence_scan(docs(rows), licences.known_licences(spark), **more).collect()}
    got, before = scan(texts=licences.known_texts(spark)), scan()
    assert {n: got[100 + i]["licence"] for i, n in enumerate(names)} == {n: n for n in names}
    assert [got[i]["licence"] for i in range(10, 15)] == ["GPL-3.0", None, None, "MIT", "BSD-3-Clause"] and got[12]["notices"] == "MPL-2.0"
    assert {i: r["text_digest"] for i, r in got.items()} == {i: r["text_digest"] for i, r in before.items()}


def test_full_texts_inside_documents(spark, docs):
    texts = dict(licences.full_texts())
    bsd, mpl = texts["BSD-2-Clause"], texts["MPL-2.0"]
    rows = [(1, "Some prose.\n" + bsd + "\nMore prose."), (2, "A\n" + mpl + "\nB\n" + bsd.upper()), (3, "A\n" + bsd.replace("source", "sauce", 1) + "\nB"), (4, " ".join(bsd.split()[:40])), (5, "x\n" + " ".join(mpl.split()))]
    got = {r["doc_id"]: r for r in licences.licence_scan(docs(rows), licences.known_licences(spark), texts=licences.known_texts(spark)).collect()}
    assert [got[i]["notices"] for i in range(1, 6)] == ["BSD-2-Clause", "BSD-2-Clause,MPL-2.0", "", "", "MPL-2.0"]
    assert all(r["licence"] is None for r in got.values())


@pytest.mark.skipif("not __import__('os').path.isdir('/root/testdata/sf0.001')", reason="no test tables")
def test_pipeline_is_its_stages_by_brute_force(spark):
    """Each stage's survivors from plain Python, on the smallest tables; only the trained model is shared."""
    import re

    import corpus_pipeline
    from chronofold.llm import simhash
    from test_contamination import words
    from test_near_copies import classes

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[a : a + min(13, len(w))]) for w in bench if w for a in range(len(w) - min(13, len(w)) + 1)}
    machine = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in toxicity.toxicity_scores(docs, machine).where("predicted = 0").collect()}
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] in good}
    best = {}
    for i, t in text.items():
        k = re.sub("[\x20\x09-\x0d]", "", t)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t), i))
    ids = sorted(i for _, i in best.values())
    import numpy as np

    found = np.stack([simhash.sketch(text[i], simhash._Hashes()) for i in ids])
    anchors = [set() for _ in ids]
    for k in range(simhash.ANCHOR_WORDS):
        for row, key in zip(*simhash._anchors(np.ascontiguousarray(found[:, k]))):
            anchors[row].add((k, int(key)))
    most = simhash.most_bits(simhash.NEAR)
    root = classes(range(len(ids)), lambda a, b: np.bitwise_count(found[a] ^ found[b]).sum() <= most and (not anchors[a].isdisjoint(anchors[b]) or not found[a].any() and not found[b].any()))
    ids = [i for k, i in enumerate(ids) if root[k] == k]

    def clean(t):
        w, hit = words(t), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
        return not hit or 20 * len(hit) < len(w)

    want = {i for i in ids if clean(text[i])}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == want


def stages(spark, rows, schema, tmp_path):
    """What each stage of the pipeline but the last keeps of ``rows``; benchmark and labels are small."""
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, prose(2, 13))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out
    return docs, corpus_pipeline.run(spark, sf)


def test_pipeline_with_repeated_and_absent_ids(spark, tmp_path):
    from collections import Counter

    rows = [(2, prose(1)), (2, prose(5)), (1, prose(1)), (None, prose(1)), (None, prose(6)), (None, prose(6)), (4, None), (4, ""), (7, "x " + prose(2, 13)), (7, prose(7)), (None, "y " + prose(2, 13)), (9, prose(8, 6000))]
    left, packed = stages(spark, [(i, t, "s", "a", "b", 1) for i, t in rows], "doc_id long, text string, source string, row string, id string, size int", tmp_path)
    want = Counter([(2, prose(5)), (1, prose(1)), (None, prose(6)), (4, ""), (7, prose(7)), (9, prose(8, 6000))])
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == want
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(i for i, _ in want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    left, packed = stages(spark, [], "doc_id long, text string, source string, lang string, n_chars long", tmp_path)
    assert left.count() == 0 and packed.count() == 0
