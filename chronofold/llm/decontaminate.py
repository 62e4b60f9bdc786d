"""Operator 5, benchmark decontamination, DataFrame operations only.

Benchmark items become windows of 13 words (an item of fewer words is one
window). Their 64-bit hashes are broadcast if their measured bytes are within
``MOST_BROADCAST``, else joined by shuffle. One scan hashes every window of every
document, of each length that items have, looks it up and verifies it word by word.

Defined cases: null and wordless texts have no words, no hits and are clean; a
null, empty or wordless item has no window; equal windows of several items count
for each; rows that repeat are counted separately, and rows of one id (or of none)
with different texts are judged each by its own text; empty tables are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.tables import content, discard, keep_rows, lower_ascii, stored, text_of

WINDOW = 13
#: Runs of characters that separate words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters before A-Z become lower case: gaps and words of an original text.
PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of benchmark windows that may be broadcast: words, and ``ROW_BYTES`` a window and ``WORD_BYTES`` a word for their frames.
MOST_BROADCAST, ROW_BYTES, WORD_BYTES = 128 << 20, 120, 16
#: The key of the row that every document matches once, which carries its word count.
SELF = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), GAP), "")


def _hash(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(n)])


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, gram, h): the distinct windows of each item."""
    words = bench.select(bench[id_col].alias("item"), words_of(text_of(bench, text_col)).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    cut = words.select("item", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    hashes = F.coalesce(*[F.when(F.col("n") == k, _hash(F.col("gram"), F.lit(0), k)) for k in range(1, window + 1)])
    return cut.distinct().withColumn("h", hashes)


def window_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(id, __x, __y, n_words, pos, n, item): each verified window; pos -1 once for each row of ``docs``."""
    table = stored(item_windows(bench, item_col, "text", window), "bench-windows")
    width = F.sum(F.lit(ROW_BYTES) + WORD_BYTES * F.col("n") + F.octet_length(F.array_join("gram", "")))
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect()) or [window]  # at most 13 numbers
    keys = table.select("h", "n", "gram", "item")
    small = (table.agg(width).first()[0] or 0) <= most_broadcast
    text = text_of(docs, text_col)
    base = docs.select(docs[id_col].alias("id"), *content(text), words_of(text).alias("w")).withColumn("n_words", F.size("w"))
    names = ["id", "__x", "__y", "n_words"]
    if small:
        # One broadcast row that every document matches once brings the documents' own rows out of the same scan.
        own = keys.sparkSession.range(1).select(
            F.lit(SELF).cast("long").alias("h"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("gram"), F.lit(None).cast(keys.schema["item"].dataType).alias("item")
        )
        keys = F.broadcast(keys.unionByName(own))
    keys = keys.withColumnRenamed("n", "m")
    at = F.sequence(F.lit(-1 if small else 0), F.greatest(F.col("n_words") - lengths[0], F.lit(-1)))
    rows = base.where(F.lit(True) if small else F.col("n_words") >= lengths[0]).select(*names, "w", F.explode(at).alias("pos"))
    if len(lengths) > 1:
        fit = F.filter(F.array(*map(F.lit, lengths)), lambda k: F.col("pos") + k <= F.col("n_words"))
        rows = rows.select(*names, "w", "pos", F.explode(F.when(F.col("pos") < 0, F.array(F.lit(0))).otherwise(fit)).alias("n"))
    else:
        rows = rows.withColumn("n", F.when(F.col("pos") < 0, 0).otherwise(lengths[0]))
    h = F.when(F.col("pos") < 0, F.lit(SELF).cast("long"))
    for k in lengths:
        h = h.when(F.col("n") == k, _hash(F.col("w"), F.col("pos"), k))
    rows = rows.withColumn("key", h)
    same = (F.col("n") == F.col("m")) & ((F.col("pos") < 0) | (F.slice("w", F.col("pos") + 1, F.col("n")) == F.col("gram")))
    found = rows.join(keys, rows["key"] == keys["h"]).where(same).select(*names, "pos", "n", "item")
    if small:
        return found
    # A row that all documents match would be a hot key of a shuffle join; a second scan counts their words instead.
    none = F.lit(None).cast(keys.schema["item"].dataType)
    return found.unionByName(base.select(*names, F.lit(-1).alias("pos"), F.lit(0).alias("n"), none.alias("item")))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (pos, n) spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["n"] - F.greatest(acc["end"], s["pos"]))).alias("n"),
        F.greatest(acc["end"], s["pos"] + s["n"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", one_in: int = 20, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: id, __x, __y (``tables.content``), n_words, n_hit, n_items, items, spans, contaminated.

    ``spans`` are the sorted (pos, n) word windows that occur; a document is
    contaminated if they cover a word and at least one in ``one_in`` words.
    """
    found = stored(window_hits(docs, bench, id_col, text_col, item_col, most_broadcast=most_broadcast), "window-hits")
    keys = ["id", "__x", "__y"]
    hits = found.where("pos >= 0").groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(
        F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("spans"), F.collect_set("item").alias("items")
    )
    rows = found.where("pos < 0").select(*keys, "n_words")
    out = rows.join(hits, F.col("id").eqNullSafe(F.col("id_")) & (F.col("__x") == F.col("__x_")) & (F.col("__y") == F.col("__y_")), "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    out = out.select(
        F.col("id").alias(id_col), "__x", "__y", F.col("n_words").cast("long"), n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items", "spans",
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def _without_words(text: Column, spans: Column) -> Column:
    """The original text without the words of the spans and without the gaps inside a removed run; all else stays as it is."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))  # gaps and words take turns
    first = F.when(F.regexp_like(text, F.lit("^" + PIECES.split("|")[0])), 1).otherwise(0)
    hit = lambda w: F.exists(spans, lambda s: (w >= s["pos"]) & (w < s["pos"] + s["n"]))
    word = lambda i: F.floor((i - first) / 2)
    gone = lambda i: F.when((i - first) % 2 == 0, hit(word(i))).otherwise((i > 0) & hit(word(i - 1)) & hit(word(i + 1)))
    return F.array_join(F.filter(pieces, lambda x, i: ~gone(i)), "")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``words``) with the covered words cut out of the original texts; all columns stay.

    Documents are known by id and text together, so ids may repeat or be null.
    """
    found = stored(contamination(docs, bench, id_col, text_col), "contamination")
    keyed = found.withColumnRenamed(id_col, "__id")
    if mode == "documents":
        out = keep_rows(docs, keyed.withColumn("stays", ~F.col("contaminated")), id_col, text_col)
        discard(found)  # which rows go is a table of its own by now
        return out
    hit = keyed.where("n_hit > 0").select(F.col("__id").alias("__i"), F.col("__x").alias("__u"), F.col("__y").alias("__v"), F.col("spans").alias("__s")).dropDuplicates(["__i", "__u", "__v"])
    marked = docs.select(*docs.columns, *content(text_of(docs, text_col)))
    same = marked[id_col].eqNullSafe(hit["__i"]) & (marked["__x"] == hit["__u"]) & (marked["__y"] == hit["__v"])
    joined = marked.join(hit, same, "left")
    cut = F.when(F.col("__s").isNull(), F.col(text_col)).otherwise(_without_words(F.col(text_col), F.col("__s")))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
