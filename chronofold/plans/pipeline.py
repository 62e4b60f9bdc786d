"""The stages as one restartable run: clean, select, periods, morphology.

Each stage writes tables under the run's folder and a receipt with a digest of
its settings and of the receipts before it. A stage whose receipt still holds is
read, not run. Failed series are kept in their own table; ``strict`` makes them
an error at the end.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.config import CleanConfig, MorphologyConfig, PeriodConfig, SelectConfig, configured
from chronofold.operators import aliases as A
from chronofold.operators import classify as K
from chronofold.operators import clean as C
from chronofold.operators import measures as M
from chronofold.operators import recommend as R
from chronofold.operators import series as S
from chronofold.operators import spectral as P

log = logging.getLogger("chronofold")
STAGES = ("clean", "select", "periods", "morphology")
_CONFIGS = {"clean": CleanConfig, "select": SelectConfig, "periods": PeriodConfig, "morphology": MorphologyConfig}


@dataclasses.dataclass(frozen=True)
class RunConfig:
    clean: CleanConfig = CleanConfig()
    select: SelectConfig = SelectConfig()
    periods: PeriodConfig = PeriodConfig()
    morphology: MorphologyConfig = MorphologyConfig()
    bls: bool = True
    strict: bool = False

    @classmethod
    def of(cls, values: dict) -> RunConfig:
        """From nested plain values, such as a YAML file's; unknown names at any level are errors."""
        extra = set(values) - set(_CONFIGS) - {"bls", "strict"}
        if extra:
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        parts = {k: configured(_CONFIGS[k], v) for k, v in values.items() if k in _CONFIGS}
        return cls(**parts, **{k: v for k, v in values.items() if k in ("bls", "strict")})


def code_digest() -> str:
    """A digest of the package's own sources, so that a run of other code is not taken for this one's."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    files = [root / "config.py", *sorted(p for d in ("functions", "operators", "plans", "sources") for p in (root / d).glob("*.py"))]
    return hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()


def _digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=dataclasses.asdict).encode()).hexdigest()


class Run:
    """One run's tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, cfg: RunConfig = RunConfig(), force: bool = False):
        self.spark, self.root, self.cfg, self.force, self.ran = spark, root.rstrip("/"), cfg, force, []

    def path(self, stage: str, table: str) -> str:
        return f"{self.root}/{stage}/{table}"

    def read(self, stage: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, table))

    def _receipt(self, stage: str) -> str | None:
        try:
            return self.spark.read.text(self.path(stage, "_receipt.txt")).first()["value"]
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return None
            raise

    def _there(self, stage: str, table: str) -> bool:
        """Was the table written to its end?"""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(stage, table) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def _stage(self, name: str, digest: str, tables: dict) -> None:
        if not self.force and self._receipt(name) == digest and all(self._there(name, t) for t in tables):
            log.info("stage %s: its receipt holds", name)
            return
        log.info("stage %s: running", name)
        for table, make in tables.items():
            make().write.mode("overwrite").parquet(self.path(name, table))
        self.spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name, "_receipt.txt"))
        self.ran.append(name)

    def all(
        self,
        obs: DataFrame,
        input_digest: str,
        catalogue: DataFrame | None = None,
        fields: DataFrame | None = None,
        manual: DataFrame | None = None,
    ) -> DataFrame:
        """Run what is out of date and return the classified catalogue. ``input_digest`` names the input's state."""
        c = self.cfg
        named = lambda df: None if df is None else [df.schema.simpleString(), df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()]
        d = _digest(code_digest(), input_digest, c.clean)
        self._stage(
            "clean",
            d,
            {
                "observations": lambda: C.clean(obs, c.clean),
                "summary": lambda: C.summary(self.read("clean", "observations")),
                "reasons": lambda: C.reason_counts(self.read("clean", "observations")),
            },
        )
        d = _digest(d, c.select)
        self._stage(
            "select",
            d,
            {
                "selection": lambda: C.select_sources(self.read("clean", "summary"), c.select),
                "reasons": lambda: C.selection_reasons(self.read("select", "selection")),
            },
        )
        d = _digest(d, c.periods, c.bls, str(named(catalogue)), str(named(fields)))
        self._stage(
            "periods",
            d,
            {
                "series": self._series,
                "analysis": self._analysis,
                "peaks": lambda: P.peak_table(self.read("periods", "analysis")),
                "inventory": lambda: A.learn_inventory(self._placed(fields), c.periods),
                "summary": lambda: self._summary(catalogue, fields),
                "recommendations": lambda: R.recommend(self.read("periods", "summary"), c.periods),
                "consensus": lambda: R.consensus(self.read("periods", "summary"), self.read("periods", "recommendations"), c.periods),
                "forced": self._forced,
                "failures": lambda: self.read("periods", "analysis").where("status <> 'ok'"),
            },
        )
        self._stage(
            "morphology",
            _digest(d, c.morphology, str(named(manual))),
            {
                "features": self._features,
                "events": lambda: M.event_table(self.read("morphology", "features")),
                "catalogue": lambda: self._classified(manual),
                "memberships": lambda: K.memberships(self.read("morphology", "catalogue")),
            },
        )
        if c.strict and not self.read("periods", "failures").isEmpty():
            raise RuntimeError("some series failed; see the table periods/failures")
        return self.read("morphology", "catalogue")

    def _series(self) -> DataFrame:
        kept = C.selected_observations(self.read("clean", "observations"), self.read("select", "selection"))
        rows = S.prepare(kept, cfg=self.cfg.periods)
        good = S.gate(rows, self.cfg.periods).where("status = 'ok'").select("source_id", "series")
        return rows.join(good, ["source_id", "series"], "left_semi")

    def _analysis(self) -> DataFrame:
        return P.analyse(self.read("periods", "series"), self.cfg.periods, self.cfg.bls)

    def _placed(self, fields: DataFrame | None) -> DataFrame:
        peaks = self.read("periods", "peaks")
        window = self.read("periods", "analysis").select("source_id", "series", "raw_sampling_window_power")
        peaks = peaks.join(window, ["source_id", "series"])
        if fields is None:
            return peaks.withColumn("ra_deg", F.lit(None).cast("double")).withColumn("dec_deg", F.lit(None).cast("double"))
        return peaks.join(fields, "source_id", "left")

    def _summary(self, catalogue: DataFrame | None, fields: DataFrame | None) -> DataFrame:
        cfg, key = self.cfg.periods, ["source_id", "series"]
        adopted = A.replace(A.score(self._placed(fields), self.read("periods", "inventory"), cfg), cfg)
        a = self.read("periods", "analysis").where("status = 'ok'").drop("peak_periods", "peak_powers", "status", "error")
        rows = a.join(adopted, key)
        points = self.read("periods", "series").join(adopted.select(*key, F.col("recommended_series_period_days").alias("period")), key)
        points = points.withColumn("phase", F.col("mjd") / F.col("period") - F.floor(F.col("mjd") / F.col("period"))).withColumn(
            "phase2",
            F.col("mjd") / (2 * F.col("period")) - F.floor(F.col("mjd") / (2 * F.col("period"))),
        )
        points = points.withColumn(
            "half",
            F.when(F.col("phase2") < 0.5, 0).otherwise(1),
        ).withColumn("subphase", F.col("phase2") * 2 - F.col("half"))
        fold = S.fold_coherence(points, cfg).select(
            *key,
            F.col("fold_amp_snr").alias("raw_fold_amp_snr"),
            F.col("fold_scatter_reduction").alias("raw_fold_scatter_reduction"),
        )
        peaks = self.read("periods", "peaks")
        at = lambda r: F.max(F.when(F.col("rank") == r, F.col("power")))
        ratios = peaks.groupBy(*key).agg(
            F.try_divide(at(1), at(2)).alias("best_to_second_power_ratio"),
            F.try_divide(
                at(1),
                F.coalesce(at(4), F.when(F.count(F.lit(1)) > 1, F.max_by("power", "rank"))),
            ).alias("best_to_fourth_power_ratio"),
            F.count(F.lit(1)).alias("n_peaks"),
        )
        ratios = ratios.withColumn(
            "top4_flat",
            F.coalesce((F.col("n_peaks") >= 4) & (F.col("best_to_fourth_power_ratio") <= cfg.flat_ratio4), F.lit(False)),
        )
        two = A.two_p_support(peaks, adopted, cfg).select(*key, "top_peak_2p_present")
        rows = rows.join(fold, key, "left").join(
            S.odd_even(points, cfg).select(*key, "two_p_supported"),
            key,
            "left",
        ).join(ratios, key, "left").join(two, key, "left")
        if catalogue is None:
            return rows.withColumn("catalogue_period_days", F.lit(None).cast("double"))
        return rows.join(catalogue.select("source_id", "catalogue_period_days"), "source_id", "left")

    def _points(self) -> DataFrame:
        """Accepted points of every selected source with its period, null where none is recommended, and the period's warnings."""
        kept = C.selected_observations(self.read("clean", "observations"), self.read("select", "selection")).where("m is not null")
        p = self.read("periods", "recommendations").select(
            "source_id",
            F.when(F.col("recommended_period_days") > 0, F.col("recommended_period_days")).alias("period"),
            F.concat_ws(";", "alias_flags", "warning_flags", "harmonic_status", "detection_label").alias("period_flags"),
        )
        return kept.select(
            "source_id",
            "row_id",
            F.col("mjd").alias("time"),
            F.col("m").alias("mag"),
            F.col("dm").alias("err"),
            F.col("band").alias("filter"),
        ).join(p, "source_id", "left")

    def _features(self) -> DataFrame:
        return M.source_features(self._points(), self.cfg.morphology)

    def _forced(self) -> DataFrame:
        return R.forced_folds(self.read("periods", "series"), self.read("periods", "recommendations"), self.cfg.periods)

    def _classified(self, manual: DataFrame | None) -> DataFrame:
        rows = K.classified(self.read("morphology", "features").drop("events"), self.cfg.morphology).withColumn("dataset", F.lit("main"))
        if manual is None:
            manual = self.spark.createDataFrame([], "source_id string, dataset string, manual_primary_tag string")
        return K.overlay(rows, manual)
