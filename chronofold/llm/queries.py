"""The registered queries of the llm operators and the SQL that some of them equal.

Each query applies its operator to its whole table with production parameters
and derives the digest columns of its contract from the operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import centroids, decontaminate, divergence, exact, licences, packing, paragraphs, shards, simhash, substrings, token_files, tokens, toxicity
from chronofold.llm.tables import documents


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(c):
    return F.crc32(c.cast("string").cast("binary")) % 3 == toxicity.HELD_OUT


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir), digest_all=True)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.kd_shards(documents(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(docs, machine).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(documents(spark, sf_dir), licences.known_licences(spark), texts=licences.known_texts(spark))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_paragraphs(documents(spark, sf_dir))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_substrings, op3_shards, op4_packing, op5_decontaminate, op6_token_counts, op7_toxicity, op8_simhash, op9_licences, op10_paragraphs, op11_token_files, op12_divergence, op13_centroids,
    )
}


def _licence_sql() -> str:
    """The licence scan in SQL, from the same fixed texts, spellings and patterns."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    form = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    bare = lambda c: f"regexp_replace({c}, {quote(licences.COPYRIGHT_LINE)}, '', 'g')"

    def spelt(c: str) -> str:
        for old, new in licences.SPELLINGS:
            c = f"regexp_replace({c}, {quote(chr(92) + 'b' + old + chr(92) + 'b')}, {quote(new)}, 'g')"
        return c

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in licences.KNOWN)
    return f"""
        WITH k AS (SELECT sha256(form) AS digest, string_agg(DISTINCT name, ' OR ' ORDER BY name) AS licence FROM (SELECT name, {spelt(form(bare('t')))} AS form FROM (VALUES {rows}) v(name, t)) GROUP BY form),
        l AS (SELECT doc_id, i, x FROM (SELECT doc_id, string_split({bare("coalesce(text, '')")}, chr(10)) AS a FROM documents), unnest(list_transform(a, lambda y: {form('y')})) WITH ORDINALITY AS u(x, i)),
        w AS (SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS whole FROM l GROUP BY doc_id),
        d AS (SELECT doc_id, sha256({spelt('whole')}) AS text_digest FROM w),
        h AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices FROM (SELECT doc_id, sha256({spelt('x')}) AS g FROM l WHERE x <> '') JOIN k ON g = digest GROUP BY doc_id)
        SELECT doc_id, text_digest, licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices FROM d LEFT JOIN k ON text_digest = digest LEFT JOIN h USING (doc_id)"""


def _centroid_sql() -> str:
    """The clustering in SQL: rounds written out one by one, distances over all dimensions."""
    k, dims, scale, rounds, seed = centroids.K, centroids.DIMS, centroids.SCALE, centroids.ROUNDS, centroids.SEED
    parts = [
        f"""kept AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"v AS (SELECT r, d, v[d] AS x FROM kept, unnest(range(1, {dims + 1})) AS t(d))",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
        f"c0 AS (SELECT c, d, v[d] AS y FROM first, unnest(range(1, {dims + 1})) AS t(d))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS (SELECT r, c, s FROM (SELECT r, c, sum((x - y) * (x - y)) AS s FROM v JOIN c{i} USING (d) GROUP BY r, c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS (SELECT c{i}.c, c{i}.d, CASE WHEN n IS NULL THEN y ELSE (t - ((t % n) + n) % n) // n END AS y FROM c{i}
                LEFT JOIN (SELECT c, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY c, d) USING (c, d))"""
            )
    parts.append(f"named AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN named USING (c)"""


_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

ORACLES = {
    "op12_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        g AS (SELECT DISTINCT lang, source FROM d),
        dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        own AS (SELECT *, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
        whole AS (SELECT lang, term, 1 + CAST({divergence.SCALE} AS HUGEINT) * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q
                  FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                  GROUP BY a.lang, a.source, b.source),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
        QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}""",
    "op9_licences": _licence_sql(),
    "op13_centroids": _centroid_sql(),
    "op1_exact_dedup": f"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({_NORM}) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256
        FROM n WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)""",
    "op5_decontaminate": r"""
        WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        items AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        grams AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[p:p + least(len(w), 13) - 1] AS g
                  FROM items, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(p) WHERE len(w) > 0),
        spots AS (SELECT doc_id, p, n, w[p:p + n - 1] AS g
                  FROM words, (SELECT DISTINCT n FROM grams), unnest(range(1, len(w) - n + 2)) AS t(p)),
        hits AS (SELECT doc_id, p, spots.n, item_id FROM spots JOIN grams ON spots.g = grams.g AND spots.n = grams.n),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
        named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                         sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM hits GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
