"""Readers and writers of curves, targets, period tables, labels and model tables (IO1-IO10, IO13, IO14, IO16-IO23, IO26, IO27, J9)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.functions.columns import clean_id, clean_text, match_key, median, number


#: Different header lines that one reading may have.
MOST_HEADERS = 200


def read_curves(
    spark: SparkSession,
    paths: str | list[str],
    recursive: bool = False,
    exclude: tuple[str, ...] = ("_cleaned", "summary"),
    max_files: int | None = None,
) -> DataFrame:
    """CSV curves with headers as strings, one ``input_file`` and ``source_id`` (from the name) a row.

    A file is one row until its lines are parted, in the executors; only the different
    header lines reach the driver. Files with different headers are parsed apart and
    united by name. Any store that Spark reads will do. ``max_files``: the first ones by name.
    """
    paths = [paths] if isinstance(paths, str) else paths
    opts = {"recursiveFileLookup": str(recursive).lower(), "pathGlobFilter": "*.csv", "wholetext": "true"}
    whole = spark.read.format("text").options(**opts).load(paths).select(
        F.col("_metadata.file_name").alias("input_file"),
        F.col("_metadata.file_path").alias("input_path"),
        "value",
    )
    for x in exclude:
        whole = whole.where(~F.col("input_file").contains(x))
    if max_files is not None:
        first = whole.select("input_path").orderBy("input_path").limit(max_files)
        whole = whole.join(first, "input_path", "left_semi")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    whole = whole.select("input_file", lines.alias("lines")).where("size(lines) > 0").withColumn("head", F.col("lines")[0])
    heads = [r["head"] for r in whole.select("head").distinct().limit(MOST_HEADERS + 1).collect()]
    if not heads:
        raise ValueError("no curve files found")
    if len(heads) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different header lines; are these curve files?")
    out = None
    for head in sorted(heads):
        names = [c.strip().strip('"') or f"_c{i}" for i, c in enumerate(head.split(","))]
        body = whole.where(F.col("head") == F.lit(head)).select("input_file", F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
        part = body.select(
            "input_file",
            F.from_csv("line", ", ".join(f"`{n}` string" for n in names)).alias("r"),
        ).select("r.*", "input_file")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    stem = F.regexp_replace(F.col("input_file"), r"(_cleaned)?\.csv$", "")
    return out.withColumn("source_id", source_from_name(stem)).withColumn("row_id", F.monotonically_increasing_id())


def source_from_name(stem: Column) -> Column:
    """The id in a file's name: a long number, or what follows 'gaia', 'source' or 'target', else the name itself."""
    long_ = F.regexp_extract(stem, r"(\d{15,20})", 1)
    named = F.regexp_extract(stem, r"(?i)(?:gaia(?:_?dr\d)?|source|target)[_\- ]+([A-Za-z0-9.]+)", 1)
    return F.coalesce(F.nullif(long_, F.lit("")), F.nullif(named, F.lit("")), stem)


def listing_digest(spark: SparkSession, paths: str | list[str]) -> str:
    """A digest of the names, sizes and times of change of all files under ``paths``: it changes when an input does."""
    import hashlib

    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for top in fs.globStatus(p) or []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths listed in a text file; # starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("p")).where("p <> ''").distinct()
    return sorted(r["p"] for r in lines.collect())


def parse_download(text: DataFrame) -> DataFrame:
    """Rows of downloaded tables (id, value): comma or white space; '###MJD' is the time; 'no data' bodies are empty; a header without a time is an error row."""
    lines = text.select("id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    sep = F.when(F.col("line").contains(","), F.split("line", ",")).otherwise(F.split(F.trim("line"), r"\s+"))
    parts = lines.withColumn("cells", sep).withColumn(
        "head",
        F.first(F.transform("cells", lambda c: F.regexp_replace(F.trim(c), "^#+", ""))).over(W.partitionBy("id").orderBy("pos")),
    )
    body = parts.where("pos > 0").where(~F.lower("line").contains("no data"))
    return body.select(
        "id",
        "pos",
        F.map_from_arrays(F.slice("head", 1, F.size("cells")), F.slice("cells", 1, F.size("head"))).alias("row"),
        (~F.array_contains("head", "MJD")).alias("bad"),
    )


def standard_observations(rows: DataFrame, bands: tuple[str, ...] = ("c", "o"), mag_range: tuple[float, float] = (2.0, 25.0)) -> DataFrame:
    """(source_id, dataset, row_id, time, mag, err, filter): finite, in range, positive flux where there is one; a bad error becomes the median of its file and band, of the file, or 0.02."""
    r = rows.withColumn("time", number(F.col("time"))).withColumn("mag", number(F.col("mag"))).withColumn("err", number(F.col("err")))
    r = r.withColumn("filter", F.coalesce(F.nullif(F.lower(F.trim("filter")), F.lit("")), F.lit("o"))).where(
        F.col("filter").isin(*bands)
        & F.col("time").isNotNull()
        & (F.col("mag") > mag_range[0])
        & (F.col("mag") < mag_range[1])
    )
    if "flux" in rows.columns:
        r = r.where(number(F.col("flux")).isNull() | (number(F.col("flux")) > 0))
    good = F.when(F.col("err") > 0, F.col("err"))
    by_band, by_file = W.partitionBy("source_id", "dataset", "filter"), W.partitionBy("source_id", "dataset")
    return r.withColumn(
        "err",
        F.coalesce(good, median(good).over(by_band), median(good).over(by_file), F.lit(0.02)),
    ).select("source_id", "dataset", "row_id", "time", "mag", "err", "filter")


def merge_datasets(frames: DataFrame, minimum: int = 50) -> tuple[DataFrame, DataFrame]:
    """(observations, problems): datasets united by source, repeats of (time, filter) once, the lowest ``priority`` first; sources under ``minimum`` are problems."""
    w = W.partitionBy("source_id", "time", "filter").orderBy("priority", "dataset", "row_id")
    r = frames.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    n = F.count(F.lit(1)).over(W.partitionBy("source_id"))
    name = F.first("dataset").over(
        W.partitionBy("source_id").orderBy("priority", "dataset").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    r = r.withColumn("n", n).withColumn("dataset", name)
    return r.where(F.col("n") >= minimum).drop("n"), r.where(F.col("n") < minimum).groupBy("source_id").agg(
        F.first("n").alias("n"),
        F.lit("too_few_observations").alias("problem"),
    )


def selected(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the requested sources."""
    return rows.join(ids.select("source_id").distinct(), "source_id", "left_semi")


def period_precedence(records: DataFrame, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(chosen, conflicts) of (source_id, period, authoritative, priority, arrival, table): authoritative first, then priority, then arrival; other records that differ by more than ``tolerance`` conflict."""
    w = W.partitionBy("source_id").orderBy(F.desc("authoritative"), "priority", "arrival")
    r = records.where("period > 0").withColumn("__r", F.row_number().over(w)).withColumn("kept", F.first("period").over(w)).withColumn(
        "kept_table",
        F.first("table").over(w),
    )
    clash = r.where((F.col("__r") > 1) & (F.abs(F.col("period") - F.col("kept")) > tolerance * F.greatest("period", "kept")))
    return r.where("__r = 1").drop("__r", "kept", "kept_table"), clash.select(
        "source_id",
        F.col("kept").alias("kept_period_days"),
        F.col("period").alias("other_period_days"),
        "kept_table",
        F.col("table").alias("other_table"),
    )


def prepare_targets(
    raw: DataFrame,
    group: str | None = None,
    equal: dict[str, str] | None = None,
    radius: tuple[float, float, float] | None = None,
    offset: int = 0,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(targets, counters): resolved columns, valid coordinates, optional group, equality and radius filters, one row a key."""
    lower = {c.lower(): c for c in raw.columns}
    find = lambda *names: next((F.col(f"`{lower[n]}`") for n in names if n in lower), None)
    ra, dec, gaia, grp = find("radeg", "ra_deg", "ra"), find("dedeg", "dec_deg", "dec"), find(
        "gaiadr3",
        "gaia_dr3",
        "source_id",
    ), find("group", "notes")
    if ra is None or dec is None:
        raise ValueError("targets need right ascension and declination")
    t = raw.select(
        "*",
        number(ra).alias("__ra"),
        number(dec).alias("__dec"),
        (clean_id(gaia) if gaia is not None else F.lit("")).alias("__id"),
        (clean_text(grp) if grp is not None else F.lit("")).alias("__grp"),
        F.monotonically_increasing_id().alias("__n"),
    )
    t = t.withColumn("valid", F.coalesce(F.col("__ra").between(0, 360) & F.col("__dec").between(-90, 90), F.lit(False)))
    keep = F.lit(True)
    if group:
        keep = keep & (match_key(F.col("__grp")) == match_key(F.lit(group)))
    for c, value in (equal or {}).items():
        keep = keep & (match_key(F.col(f"`{lower[c.lower()]}`")) == match_key(F.lit(value)))
    if radius:
        a, d, r = (F.radians(F.lit(float(x))) for x in radius)
        x, y = F.radians("__ra"), F.radians("__dec")
        keep = keep & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(y) * F.sin(d) + F.cos(y) * F.cos(d) * F.cos(x - a)))) <= r)
    key = F.when(
        F.col("__id") != "",
        F.concat(F.lit("gaia:"), F.col("__id")),
    ).otherwise(F.format_string("coord:%.7f,%.7f", "__ra", "__dec"))
    t = t.withColumn("wanted", F.coalesce(keep, F.lit(False))).withColumn("target_key", F.when(F.col("valid"), key))
    ok = t.where("valid and wanted").withColumn("__r", F.row_number().over(W.partitionBy("target_key").orderBy("__n"))).where("__r = 1")
    out = ok.select(
        "target_key",
        F.concat(F.lit("T"), F.substring(F.sha1("target_key"), 1, 14)).alias("target_id"),
        F.col("__id").alias("gaia_dr3"),
        F.col("__ra").alias("ra_deg"),
        F.col("__dec").alias("dec_deg"),
        F.col("__grp").alias("target_group"),
        "__n",
    )
    counters = t.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.count_if(F.col("valid") & ~F.col("wanted")).alias("n_filtered"),
        F.countDistinct(F.when(F.col("valid") & F.col("wanted"), F.col("target_key"))).alias("n_targets"),
    )
    out = out.orderBy("__n").offset(offset)
    return (out.limit(limit) if limit is not None else out).drop("__n"), counters


def target_summary(t: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of a column."""
    return t.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def with_metadata(curves: DataFrame, targets: DataFrame) -> DataFrame:
    """Curves with their target's columns; targets have one row an id."""
    meta = targets.select(
        F.col("gaia_dr3").alias("source_id"),
        *[F.col(c).alias(f"target_{c}") for c in ("target_id", "ra_deg", "dec_deg", "target_group")],
    )
    return curves.join(meta, "source_id", "left")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Write a table; Spark's committer makes it appear whole or not at all."""
    w = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    w.option("header", True).format(kind).save(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved table, or an empty one with ``schema`` if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def publish_model(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Write a model's tables under root/version, then point root/current to it."""
    for name, df in tables.items():
        write_table(df, f"{root}/{version}/{name}")
    spark.createDataFrame(
        [(json.dumps({"version": version, "tables": sorted(tables)}),)],
        "value string",
    ).coalesce(1).write.mode("overwrite").text(f"{root}/current")


def current_model(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the model that root/current points to."""
    at = json.loads(spark.read.text(f"{root}/current").first()["value"])
    return {t: spark.read.parquet(f"{root}/{at['version']}/{t}") for t in at["tables"]}
