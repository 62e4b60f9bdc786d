"""Streams as increments: the same operators over micro-batches, with results equal to one batch run.

The batch engine needs none of this; it is for surveys whose curves arrive daily.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.config import CleanConfig, PeriodConfig
from chronofold.operators.aliases import merge_memory
from chronofold.operators.clean import audit


def read_observations(spark: SparkSession, path: str, schema: str, kind: str = "parquet", max_files: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(path)


def audited(stream: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """The cleaning audit is elementwise, so it runs on a stream as it does on a table."""
    return audit(stream, cfg)


def nightly_counts(stream: DataFrame, time_col: str = "ts", late: str = "2 days") -> DataFrame:
    """(night, source_id, n, mean): per source and night, with late rows up to ``late`` behind."""
    w = stream.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("w"), "source_id")
    return w.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
    ).select(F.col("w.start").alias("night"), "source_id", "n", "mean")


def excursion_sessions(stream: DataFrame, time_col: str = "ts", gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """(source_id, start, end, n): excursions grouped by gaps, the streaming form of the batch events; nights are kept apart by key."""
    s = stream.withWatermark(time_col, late).groupBy(
        "source_id",
        F.date_trunc("day", time_col).alias("night"),
        F.session_window(time_col, gap).alias("w"),
    )
    return s.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak")).select(
        "source_id",
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        "n",
        "peak",
    )


def alias_memory(inventories: DataFrame, root: str, checkpoint: str, cfg: PeriodConfig = PeriodConfig()) -> StreamingQuery:
    """Merge each micro-batch of field inventories into the memory saved under ``root``, one generation a batch.

    A batch reads the last generation before its own, so one that is run again after
    a failure writes the same generation once more and counts no star twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = remembered(spark, root, number - 1)
        both = batch if before is None else batch.unionByName(before.select(batch.columns))
        merge_memory(both, cfg).write.mode("overwrite").parquet(f"{root}/batch-{number}")

    return inventories.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remembered(spark: SparkSession, root: str, last: int | None = None) -> DataFrame | None:
    """The saved memory: the newest whole generation, or the newest up to ``last``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = [
        int(n[6:])
        for n in names
        if n.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))
    ]
    whole = [n for n in whole if last is None or n <= last]
    return spark.read.parquet(f"{root}/batch-{max(whole)}") if whole else None


def append_new(
    stream: DataFrame,
    read_known: Callable[[], DataFrame],
    write: Callable[[DataFrame, int], None],
    keys: list[str],
    checkpoint: str,
    trigger_once: bool = True,
) -> StreamingQuery:
    """Hand each micro-batch's rows with unknown keys to ``write``, the first of repeats only; saved rows never change."""

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys).join(read_known().select(*keys), keys, "left_anti")
        write(fresh, number)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()
