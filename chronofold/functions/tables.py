"""Table functions for SQL (§2.14): peaks of a periodogram and events of a residual curve, from a table argument.

    register(spark)
    SELECT * FROM spectral_peaks(TABLE(grid), 12, 0.02)
    SELECT * FROM excursions(TABLE(residuals), 5.0, 1.0)

Each function names its own partitioning and order, so a call needs neither
PARTITION BY nor ORDER BY; a partition is one series or one source. They are the SQL
surface of ``spectral.top_peaks`` and ``features.excursion_events``, whose native
forms do the same without Python and are what large tables should go through.
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _columns(table: AnalyzeArgument, needed: tuple[str, ...]) -> dict:
    """The types of the table's columns; an error that names what it lacks."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    lacks = [c for c in needed if c not in kinds]
    if lacks:
        raise ValueError(f"the table lacks {', '.join(lacks)}")
    return kinds


class SpectralPeaks:
    """(source_id, series, rank, period, power): local maxima by falling power, none within ``separation`` of a stronger one's period."""

    def __init__(self) -> None:
        self.key, self.n, self.separation = None, 0, 0.0
        self.grid: list[tuple[float, float]] = []

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument, separation: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(table, ("source_id", "series", "frequency", "power"))
        out = StructType().add("source_id", kinds["source_id"]).add("series", kinds["series"]).add("rank", IntegerType()).add("period", DoubleType()).add("power", DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("source_id"), PartitioningColumn("series")], orderBy=[OrderingColumn("frequency")])

    def eval(self, row: Row, n: int, separation: float) -> None:
        self.key, self.n, self.separation = (row["source_id"], row["series"]), n, float(separation)
        self.grid.append((row["frequency"], row["power"]))

    def terminate(self):
        rows = self.grid
        above = lambda a, b: a is not None and b is not None and a > b
        top = [i for i in range(1, len(rows) - 1) if above(rows[i][1], rows[i - 1][1]) and rows[i + 1][1] is not None and not above(rows[i + 1][1], rows[i][1])]
        kept: list[float] = []
        for i in sorted(top, key=lambda i: (-rows[i][1], rows[i][0])):
            period = 1 / rows[i][0]
            if len(kept) < self.n and all(abs(period - k) / k >= self.separation for k in kept):
                kept.append(period)
                yield (*self.key, len(kept), period, rows[i][1])


class Excursions:
    """(source_id, event_type, event_number, n_measurements, first_time, last_time, peak_significance): runs of points past ``sigma`` on one side, within ``gap`` days and a night."""

    def __init__(self) -> None:
        self.source, self.sigma, self.gap = None, 0.0, 0.0
        self.rows: dict[str, list[tuple[float, float]]] = {"brightening": [], "dimming": []}

    @staticmethod
    def analyze(table: AnalyzeArgument, sigma: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(table, ("source_id", "row_id", "time", "z"))
        out = StructType().add("source_id", kinds["source_id"]).add("event_type", StringType()).add("event_number", IntegerType()).add("n_measurements", IntegerType())
        for name in ("first_time", "last_time", "peak_significance"):
            out = out.add(name, DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("source_id")], orderBy=[OrderingColumn("time"), OrderingColumn("row_id")])

    def eval(self, row: Row, sigma: float, gap: float) -> None:
        self.source, self.sigma, self.gap = row["source_id"], float(sigma), float(gap)
        if row["z"] is not None and abs(row["z"]) > self.sigma:
            self.rows["dimming" if row["z"] > 0 else "brightening"].append((row["time"], abs(row["z"])))

    def terminate(self):
        for kind, points in self.rows.items():
            runs: list[list[tuple[float, float]]] = []
            for t, z in points:
                if runs and t - runs[-1][-1][0] <= self.gap and t // 1 == runs[-1][-1][0] // 1:
                    runs[-1].append((t, z))
                else:
                    runs.append([(t, z)])
            for k, run in enumerate(runs):
                yield (self.source, kind, k + 1, len(run), run[0][0], run[-1][0], max(z for _, z in run))


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("spectral_peaks", udtf(SpectralPeaks))
    spark.udtf.register("excursions", udtf(Excursions))
