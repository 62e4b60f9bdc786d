"""Operator 1, exact dedup by progressive refinement.

Rows are grouped by the length of the normalised text, then by a hash of its
first bytes, then by the full digest; each step only looks at groups that the
step before left with two rows or more.

Defined cases: a null text counts as empty, so null, empty and all-space texts
are one group. Rows with a null id lose to rows with one. Of rows that repeat id
and text alike, exactly one is kept. An empty table gives an empty result. Other
columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.tables import SPACES, content, discard, keep_rows, stored, text_of

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 64


def _shared(rows: DataFrame) -> DataFrame:
    """(bytes, prefix) of the groups that both steps leave with two rows.

    Rows are summed to one per length and prefix before anything is dealt by
    length alone, so neither a common length nor a group of copies is a hot key.
    """
    counts = rows.groupBy("bytes", "prefix").count()
    lengths = counts.groupBy("bytes").agg(F.sum("count").alias("n")).where("n > 1").select("bytes")
    return counts.join(lengths, "bytes", "left_semi").where("count > 1").select("bytes", "prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, with_content: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for rows that length or prefix proved unique, whose
    content is then never digested. ``digest_all`` fills it for every row; the
    digest is then taken while the lengths are, and the refinement runs over the
    narrow table of lengths and hashes alone. ``with_content`` adds the two columns of
    ``tables.content``, which tell rows of one id apart.
    """
    marks = ["__x", "__y"] if with_content else []
    norm = F.translate(text_of(docs, text_col), SPACES, "")
    sketch = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("id"),
        F.octet_length(norm).alias("bytes"),
        F.char_length(text_of(docs, text_col)).alias("points"),
        F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("prefix"),
        *(content(text_of(docs, text_col)) if with_content else []),
        *([F.sha2(norm, 256).alias("sha")] if digest_all else [F.lit(None).cast("string").alias("sha"), norm.alias("norm")]),
    )
    narrow = stored(sketch.drop("norm"), "exact-sketch") if digest_all else sketch
    shared = _shared(narrow)
    if digest_all:
        rows, survivors = narrow, narrow.join(shared, ["bytes", "prefix"], "left_semi")
    else:
        marked = sketch.join(shared.withColumn("__s", F.lit(True)), ["bytes", "prefix"], "left")
        rows = stored(marked.select("row", "id", "bytes", "points", "prefix", *marks, F.when(F.col("__s"), F.sha2("norm", 256)).alias("sha")), "exact-rows")
        survivors = rows.where("sha is not null")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), "id", "row"))
    groups = stored(
        survivors.groupBy("bytes", "sha").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1"), "exact-groups"
    )
    out = rows.join(groups, ["bytes", "sha"], "left")
    alone = F.col("best").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *marks,
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    found = stored(exact_dedup(docs, id_col, text_col, digest_all=True, with_content=True), "exact-found")
    out = keep_rows(docs, found.select(F.col(id_col).alias("__id"), "__x", "__y", F.col("kept").alias("stays")), id_col, text_col)
    discard(found)  # which rows go is a table of its own by now
    return out
