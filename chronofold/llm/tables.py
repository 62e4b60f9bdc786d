"""Shared-folder tables, gapless ranks and connected components for the llm operators.

Everything that is reused is written to the folder that the cluster names in
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and
never a recomputation from half-lost blocks.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: The white space that the exact-dedup and SimHash contracts name: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a folder of this process in local mode (tests), an error on a cluster."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="chronofold-")
    return f"file://{_local_folder}"


def stored(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and return a scan of it; ``texts``: Python workers get whole texts, so few rows at a time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronofold/{label}-{uuid.uuid4().hex}"
    with few_rows(spark) if texts else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_parts(df: DataFrame, label: str, by: str, n: int) -> list[DataFrame]:
    """Write ``df`` once, dealt by its int column ``by`` into ``n`` tables, which are returned in order; each may be discarded by itself."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronofold/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))  # a file a part and task is open at once, so rows need no sort
    try:
        df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    finally:
        spark.conf.set(key, before)
    schema = T.StructType([f for f in df.schema.fields if f.name != by])
    empty = spark.createDataFrame([], schema)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = []
    for k in range(n):
        own = f"{path}/{by}={k}"
        there = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(own))
        part = spark.read.schema(schema).parquet(own) if there else empty
        part.stored_at = own
        parts.append(part)
    return parts


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later plan reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def give_back() -> None:
    """Return a Python worker's freed memory to the system; workers live on for later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that Python workers get at a time where rows hold whole texts. The default of Spark counts rows of any width.
TEXT_ROWS = 512


@contextlib.contextmanager
def few_rows(spark: SparkSession):
    """Arrow batches of ``TEXT_ROWS`` rows at most for what is planned inside; the session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(TEXT_ROWS, int(before)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches, rows: int = 64):
    """Each Arrow batch in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z; every other character, accented ones too, stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def content(text: Column) -> list[Column]:
    """Two columns, __x and __y, that tell texts apart (128 bits of hash)."""
    return [F.xxhash64(text).alias("__x"), F.xxhash64(F.lit(1), text).alias("__y")]


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    ``verdicts`` has a row for each row of ``docs``: __id, __x, __y (``content``)
    and ``stays``. Ids may repeat or be null: a row is known by id and text
    together. Of rows alike in both, one stays if not all of them do, or if ``once``.
    """
    keys = ["__id", "__x", "__y"]
    gone = stored(verdicts.groupBy(*keys).agg(F.count_if("stays").alias("__stay"), F.count(F.lit(1)).alias("__rows")).where("__stay < __rows" + (" or __rows > 1" if once else "")).drop("__rows"), "rows-gone")
    marked = docs.select(*docs.columns, *content(text_of(docs, text_col)))
    other = gone.select(*[F.col(k).alias(f"{k}_") for k in keys], "__stay")
    same = marked[id_col].eqNullSafe(F.col("__id_")) & (F.col("__x") == F.col("__x_")) & (F.col("__y") == F.col("__y_"))
    rest = marked.join(other, same, "left_anti").select(docs.columns)
    if gone.where("__stay > 0").isEmpty():
        return rest
    few = marked.join(other.where("__stay > 0"), same, "left_semi").dropDuplicates([id_col, "__x", "__y"]).select(docs.columns)
    return rest.unionByName(few)


def with_place(df: DataFrame, by: str, name: str) -> DataFrame:
    """The distinct values of ``by`` that are not null, with their place in ascending order, from 0 without gaps; a range sort, no window over all."""
    values = df.select(by).where(F.col(by).isNotNull()).distinct()
    dealt = stored(values.repartitionByRange(by).sortWithinPartitions(by).withColumn("__m", F.monotonically_increasing_id()), "places")
    part = F.shiftright("__m", 33)
    counts = dealt.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = counts.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return dealt.join(F.broadcast(before), part == F.col("__p")).select(by, (F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias(name))


#: The number of a null id in ``numbered``: after all others.
LAST = 2**63 - 1


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text, body) of each row: ``doc`` is a long in the order of the ids, whatever their type; ``text`` a hash of the text ``body``."""
    body = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(body).alias("text"), body.alias("body"))
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        return rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("doc"), "text", "body")
    places = stored(with_place(docs.select(docs[id_col].alias("id")), "id", "place"), "id-places").withColumnRenamed("id", "__i")
    return rows.join(places, F.col("id") == F.col("__i"), "left").select("id", F.coalesce("place", F.lit(LAST)).alias("doc"), "text", "body")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, row: str, rows_per_bucket: int = 1_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, whatever a group's size.

    A window over a whole group would put it in one task. Rows of a group are
    dealt by a hash of ``row``, a number that no other row has, over a number of
    buckets in proportion to the group's size; only the bucket counts are summed up
    in order, and each row takes its bucket's offset plus its place in the bucket.
    ``df`` must be a stored table since it is read three times.
    """
    sizes = stored(df.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)]).agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).alias("__m")), "group-sizes")
    own = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    dealt = df.join(sizes, own).select(*df.columns, F.pmod(F.xxhash64(row), F.col("__m")).alias("__b"))
    keys = [*group, "__b"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    inner = W.partitionBy(*keys).orderBy(*order, row)
    placed = dealt.withColumn("__r", F.row_number().over(inner) - 1)
    match = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = placed.join(offsets, match, "inner")
    return out.select(*df.columns, (F.col("__r") + F.col("__o")).cast("long").alias(name))


def connected_components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the long columns ``a``, ``b``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Minima come
    from partial aggregates and are written before they are joined back, so both
    sides of each join are plain exchanges that adaptive execution can split when a
    hub node is hot.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-e"
    )
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-m")
        large = stored(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(),
            f"{label}-l",
        )
        discard(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-m")
        hooked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(hooked.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(), f"{label}-e")
        row = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(least, large, e)
        e = small
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LONG = T.LongType()
