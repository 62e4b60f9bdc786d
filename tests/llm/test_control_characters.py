"""Every query of the text operators, and the pipeline, over texts with every control character, U+0000 among them; against SQL where there is any."""

from collections import Counter

import pytest

from chronofold.llm import queries as Q
from llm_cases import prose

duckdb = pytest.importorskip("duckdb")
CONTROLS = [chr(c) for c in (*range(0x20), *range(0x7F, 0xA1), 0xAD, 0x200B, 0x2028, 0xFEFF, 0xFFFD)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("controls"))
    item = prose(3, 13)
    rows = [(i, f"{prose(i, 30)} a{c}b {c} {c}{c}x{c} {item} {prose(99 - i, 30)}") for i, c in enumerate(CONTROLS)]
    rows += [(200 + i, c) for i, c in enumerate(CONTROLS)] + [(300, "\0" * 300), (301, "\0" * 300), (302, None), (303, "".join(CONTROLS) * 9), (304, prose(5, 300) + "\0"), (305, prose(5, 300))]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "\0 \0"), (3, "a\0b")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(i, [float(i % 7)] * 64) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    return sf, len(rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, folder, name):
    sf, n = folder
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    if "doc_id" in cols and "piece" not in cols:
        assert sum(got.values()) == n
    if name in Q.ORACLES:
        db = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        res = db.execute(Q.ORACLES[name])
        names = [d[0] for d in res.description]
        assert got == Counter(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())


def test_pipeline(spark, folder):
    import corpus_pipeline

    sf, n = folder
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len({r["doc_id"] for r in out}) < n
