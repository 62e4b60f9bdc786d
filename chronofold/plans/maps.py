"""Saved maps of classified sources, and the modes that work on them.

A map folder holds generations ``gen-N``, each a whole catalogue: features,
coordinates and labels, events. A generation counts once its ``_COMPLETE`` marker is
there, so an interrupted run leaves the one before in force. The models (scaler,
weights, and the reference sources' places in each space) are written by ``fit`` alone
and never change afterwards: ``transform`` puts new sources among the nearest reference
sources and leaves every old coordinate as it is.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.config import MorphologyConfig
from chronofold.functions.columns import median
from chronofold.operators import classify as K
from chronofold.operators import embed as E
from chronofold.operators import layout as L
from chronofold.operators import measures as P

log = logging.getLogger("chronofold")
#: The version of what the blocks hold; a model of another version is refused.
SCHEMA = 2
SPACES = ("periodic", "transient", "combined", "evidence")
#: How neighbours are found in each space.
METRIC = {"periodic": "cosine", "transient": "cosine", "combined": "cosine", "evidence": "euclidean"}
#: Settings that change a feature's value. Thresholds of the classifier only change labels.
REPRESENTATION = ("phase_bins", "sections", "map_bins", "event_sigma", "event_gap_days", "event_min_points")

# The scalar space that validation falls back on.
SCALARS = (
    "profile_chi2",
    "profile_snr",
    "dip_duty_cycle",
    "dip_dominance",
    "secondary_dip_depth_norm",
    "secondary_dip_phase_separation",
    "out_of_dip_variation",
    "mirror_symmetry",
    "harmonic_energy_ratio",
    "coherent_dimming_score",
    "dip_cycle_support_fraction",
    "wave_model_score",
    "dimming_model_score",
    "flare_event_count",
    "flare_asymmetry",
    "irregular_variability_score",
    "temporal_coherence_score",
    "scatter_over_error",
    "phase_coverage",
)


def settings_digest(cfg: MorphologyConfig) -> str:
    """What the representation depends on; equal digests mean comparable features."""
    values = {k: getattr(cfg, k) for k in REPRESENTATION}
    return hashlib.sha256(json.dumps({**values, "schema": SCHEMA}, sort_keys=True).encode()).hexdigest()


def space_names(space: str, cfg: MorphologyConfig) -> list[str]:
    """The columns of a space in order; the combined one has each name once."""
    periodic, transient = P.block_names(cfg)
    return {
        "periodic": periodic,
        "transient": transient,
        "combined": [*periodic, *(n for n in transient if n not in periodic)],
        "evidence": list(K.SCORES),
    }[space]


def space_values(table: DataFrame, space: str, cfg: MorphologyConfig) -> DataFrame:
    """Long rows (source_id, dim, x) of a space; the table's columns must be those that the space was made of."""
    names = space_names(space, cfg)
    if space == "evidence":
        missing = [n for n in names if n not in table.columns]
        if missing:
            raise ValueError(f"the catalogue lacks the scores {', '.join(missing)}")
        v = K.hellinger(table).select("source_id", F.col("evidence").alias("v"))
    else:
        periodic, transient = P.block_names(cfg)
        kept = [i + 1 for i, n in enumerate(transient) if n not in periodic]
        block = {
            "periodic": F.col("periodic_block"),
            "transient": F.col("transient_block"),
            "combined": F.concat("periodic_block", F.transform(F.array(*map(F.lit, kept)), lambda i: F.element_at("transient_block", i))),
        }[space]
        v = table.select("source_id", block.alias("v"))
    return v.select("source_id", F.posexplode("v").alias("dim", "x"))


def scalar_space(table: DataFrame) -> DataFrame:
    """(id, v): the scalar features, median-imputed and scaled by their interquartile ranges."""
    names = [n for n in SCALARS if n in table.columns]
    values = table.select(
        F.col("source_id").alias("id"),
        F.posexplode(F.array(*[F.col(n).cast("double") for n in names] or [F.lit(0.0)])).alias("dim", "x"),
    )
    return E.vectors(E.scaled(values, E.fit_scaler(values)), "id")


class Maps:
    """The saved maps under ``root``."""

    def __init__(self, spark: SparkSession, root: str, cfg: MorphologyConfig = MorphologyConfig()):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg

    # Files.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def generation(self) -> int | None:
        """The last complete generation."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [
            int(n[4:])
            for n in names
            if n.startswith("gen-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_COMPLETE"))
        ]
        return max(done, default=None)

    def read(self, table: str) -> DataFrame:
        at = self.generation()
        if at is None:
            raise FileNotFoundError(f"no complete map under {self.root}; run fit first")
        return self.spark.read.parquet(f"{self.root}/gen-{at}/{table}")

    def _held(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back, so that what follows does not classify again."""
        path = f"{self.root}/work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _write(self, tables: dict[str, DataFrame]) -> None:
        at = -1 if self.generation() is None else self.generation()
        new = f"{self.root}/gen-{at + 1}"
        fs, p = self._fs(new)
        fs.delete(p, True)  # what an interrupted run left
        for name, df in tables.items():
            df.write.parquet(f"{new}/{name}")
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{new}/_COMPLETE")).close()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/work"), True)
        log.info("wrote generation %d under %s", at + 1, self.root)

    def _model(self, space: str) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(f"{self.root}/models/{space}/{t}") for t in ("scaler", "reference"))

    def _meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/models/meta").first()["value"])

    def _gate(self) -> None:
        """A model of other feature settings or of another schema is refused."""
        meta = self._meta()
        if meta["settings"] != settings_digest(self.cfg):
            raise ValueError("the saved maps were made with other feature settings; fit anew under another root")
        for s in SPACES:
            if meta["names"][s] != space_names(s, self.cfg):
                raise ValueError(f"the columns of the {s} space are not those of the saved model")

    # Coordinates.

    def _place(self, table: DataFrame, space: str) -> DataFrame:
        """(source_id, space_1, space_2, space_vector) by the saved scaler and the reference sources' places."""
        scaler, reference = self._model(space)
        v = self._held(E.vectors(E.scaled(space_values(table, space, self.cfg), scaler), "source_id").withColumnRenamed("source_id", "id"))
        xy = L.placed(v, reference, METRIC[space])
        return xy.join(v, "id").select(F.col("id").alias("source_id"), F.col("x").alias(f"{space}_1"), F.col("y").alias(f"{space}_2"), F.col("v").alias(f"{space}_vector"))

    def _scored(self, features: DataFrame, manual: DataFrame | None) -> DataFrame:
        rows = features.drop("events") if "events" in features.columns else features
        rows = rows if "dataset" in rows.columns else rows.withColumn("dataset", F.lit("main"))
        empty = self.spark.createDataFrame([], "source_id string, dataset string, manual_primary_tag string")
        return K.overlay(K.classified(rows, self.cfg), empty if manual is None else manual)

    def _mapped(self, table: DataFrame) -> DataFrame:
        for space in SPACES:
            table = table.join(self._place(table, space), "source_id", "left")
        return table

    # Modes.

    def fit(self, features: DataFrame, manual: DataFrame | None = None, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
        """Models of the four spaces from ``measures.source_features`` and the first generation of the catalogue."""
        scored = self._held(self._scored(features, manual))
        for space in SPACES:
            names = space_names(space, self.cfg)
            values = space_values(scored, space, self.cfg)
            given = (weights or {}).get(space, {})
            table = self.spark.createDataFrame([(i, float(given.get(n, 1.0))) for i, n in enumerate(names)], "dim int, weight double")
            E.fit_scaler(values, table).write.mode("overwrite").parquet(f"{self.root}/models/{space}/scaler")
            scaler = self.spark.read.parquet(f"{self.root}/models/{space}/scaler")
            v = self._held(E.vectors(E.scaled(values, scaler), "source_id").withColumnRenamed("source_id", "id"))
            v.join(L.manifold_map(v, METRIC[space]), "id").write.mode("overwrite").parquet(f"{self.root}/models/{space}/reference")
        meta = json.dumps(
            {
                "settings": settings_digest(self.cfg),
                "names": {s: space_names(s, self.cfg) for s in SPACES},
                "config": dataclasses.asdict(self.cfg),
            },
            sort_keys=True,
        )
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/models/meta")
        self._write(
            {
                "features": features,
                "catalogue": self._mapped(scored).withColumn("is_reference", F.lit(True)).withColumn("is_latest_batch", F.lit(True)),
            }
        )
        return self.read("catalogue")

    def _distances(self, table: DataFrame, reference: DataFrame) -> DataFrame:
        """``table`` with out_of_distribution_score: the mean distance to the nearest reference rows over its 99 % quantile in the reference."""
        v = lambda df: df.select(F.col("source_id").alias("id"), F.col("combined_vector").alias("v"))
        n = reference.count()
        k = int(min(6, max(2, n - 1))) - 1
        scale = E.ood_scores(E.nearest(v(reference), v(reference), k), n).agg(
            F.max(F.col("typical") / F.greatest("out_of_distribution_score", F.lit(1e-12)))
        ).first()[0] or 1e-9
        far = E.nearest(v(table), v(reference), k).groupBy("query").agg(
            (F.avg("distance") / F.lit(scale)).alias("out_of_distribution_score")
        )
        return table.drop("out_of_distribution_score").join(far, F.col("source_id") == F.col("query"), "left").drop("query")

    def transform(self, features: DataFrame, existing: str = "skip", manual: DataFrame | None = None) -> DataFrame:
        """Puts sources on the saved maps. ``existing`` says what known sources do: skip, replace or error. Coordinates of all others stay as they are."""
        self._gate()
        old, old_features = self.read("catalogue"), self.read("features")
        known = old.select("source_id")
        if existing not in ("skip", "replace", "error"):
            raise ValueError(f"existing={existing!r} is not skip, replace or error")
        if existing == "error" and not features.join(known, "source_id", "left_semi").isEmpty():
            raise ValueError("the batch has sources that the map has")
        new = features if existing == "replace" else features.join(known, "source_id", "left_anti")
        if new.isEmpty():
            return old
        # Two steps: the distance from the reference is one of the rules' inputs, the scores make the evidence map.
        far = self._distances(
            new.drop("events").join(self._place(new, "combined").select("source_id", "combined_vector"), "source_id"),
            old.where("is_reference"),
        ).drop("combined_vector")
        batch = self._mapped(
            self._held(self._scored(far, manual))
        ).withColumn("is_reference", F.lit(False)).withColumn("is_latest_batch", F.lit(True))
        kept = old.join(new.select("source_id"), "source_id", "left_anti").withColumn("is_latest_batch", F.lit(False))
        self._write(
            {
                "features": old_features.join(new.select("source_id"), "source_id", "left_anti").unionByName(new, allowMissingColumns=True),
                "catalogue": kept.unionByName(batch, allowMissingColumns=True),
            }
        )
        return self.read("catalogue")

    def relabel(self, manual: DataFrame | None = None) -> DataFrame:
        """Rules and manual labels anew over the saved features, thresholds as configured now; no feature and no coordinate but the evidence map's changes."""
        self._gate()
        table = self.read("catalogue")
        bare = table.drop(*_labels(table), *[c for c in table.columns if c.startswith("evidence_")])
        rows = self._held(self._scored(bare, manual))
        self._write({"features": self.read("features"), "catalogue": rows.join(self._place(rows, "evidence"), "source_id", "left")})
        return self.read("catalogue")

    def families(self, space: str = "combined", k: int = 20, least: int = 100) -> tuple[DataFrame, DataFrame]:
        """(members, summary) of the bodies that lie apart from the main one on a map."""
        table = self.read("catalogue").where(f"{space}_1 is not null and {space}_2 is not null")
        points = table.select(F.col("source_id").alias("id"), F.array(f"{space}_1", f"{space}_2").alias("v"))
        found = E.density_families(points, k=k, least=least).withColumnRenamed("id", "source_id")
        members = table.select("source_id", "final_primary_tag", f"{space}_1", f"{space}_2").join(found, "source_id")
        return members, family_summary(members, f"{space}_1", f"{space}_2")

    def neighbours(self, source_id: str, k: int = 8) -> DataFrame:
        """The nearest sources of one in the combined space and on its map, side by side."""
        table = self.read("catalogue")
        parts = []
        for name, v in (("feature", F.col("combined_vector")), ("map", F.array("combined_1", "combined_2"))):
            rows = table.select(F.col("source_id").alias("id"), v.alias("v")).where("v is not null")
            one = rows.where(F.col("id") == source_id)
            if one.isEmpty():
                raise ValueError(f"source {source_id} is not on the map")
            parts.append(E.nearest(one, rows, k).withColumn("space", F.lit(name)))
        label = table.select(F.col("source_id").alias("neighbour"), "final_primary_tag", "recommended_period_days")
        return parts[0].unionByName(parts[1]).join(label, "neighbour").select(
            "space",
            "rank",
            "neighbour",
            "distance",
            "final_primary_tag",
            "recommended_period_days",
        )

    def validation(self) -> dict[str, DataFrame]:
        """Neighbour validation of the saved catalogue: rows by source, by category, and the neighbours of each category's strongest source."""
        table = self.read("catalogue")
        complete = table.where("combined_vector is null").isEmpty()
        space = table.select(F.col("source_id").alias("id"), F.col("combined_vector").alias("v")) if complete else scalar_space(table)
        flat = table.select(
            F.col("source_id").alias("id"),
            F.array(F.coalesce("combined_1", F.lit(0.0)), F.coalesce("combined_2", F.lit(0.0))).alias("v"),
        )
        return neighbour_validation(table, space, flat)


def _labels(table: DataFrame) -> list[str]:
    """Columns that classification adds."""
    made = {
        *K.SCORES,
        "rung",
        "primary_tag",
        "secondary_tags",
        "review_reasons",
        "confidence",
        "interest_status",
        "interest_confidence",
        "interest_reasons",
        "needs_review",
        "final_primary_tag",
        "final_secondary_tags",
        "final_interest_status",
        "label_source",
    }
    return [c for c in table.columns if c in made]


def family_summary(members: DataFrame, x: str, y: str) -> DataFrame:
    """Per family: size, centroid, box and most frequent category (first by name on ties)."""
    kinds = members.groupBy("family", "final_primary_tag").count()
    modal = kinds.groupBy("family").agg(
        F.min(F.struct((-F.col("count")).alias("n"), "final_primary_tag"))["final_primary_tag"].alias("dominant_category")
    )
    box = members.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_sources"),
        *[f(c).alias(f"{n}_{i}") for i, c in ((1, x), (2, y)) for n, f in (("centroid", F.avg), ("minimum", F.min), ("maximum", F.max))],
    )
    return box.join(modal, "family")


def score_margin(table: DataFrame) -> DataFrame:
    """(id, classification_score_margin): the best category score over the second, as shares of all."""
    s = K.hellinger(table).select(
        F.col("source_id").alias("id"),
        F.sort_array(F.transform("evidence", lambda x: x * x), asc=False).alias("s"),
    )
    return s.select("id", (F.element_at("s", 1) - F.element_at("s", 2)).alias("classification_score_margin"))


def typical_distances(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(id, label, distance): how far each row (id, label, v) lies from its label's medoid, the row with the least sum of distances to all others of the label.

    Sums are taken block by block: a task holds two blocks of one label and returns a
    sum a row, so no pair leaves it.
    """
    import numpy as np
    import pyarrow as pa

    from chronofold.operators.neighbours import _matrix, _squared

    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("m"))
    base = rows.join(F.broadcast(sizes), "label").withColumn("a", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    left = base.select("id", "label", "v", "a", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("b"))
    right = base.select(F.col("label").alias("label_"), F.col("v").alias("v_"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("a_"), F.col("a").alias("b_"))
    kind = dict(rows.dtypes)["id"]

    def sums(x: pa.Table, y: pa.Table) -> pa.Table:
        p, q = _matrix(x.column("v")), _matrix(y.column("v_"))
        total = np.sqrt(_squared(p, q)).sum(1) if len(p) and len(q) else np.zeros(len(p))
        return pa.table([x.column("id"), x.column("label"), pa.array(total)], names=["id", "label", "s"])

    keys = ["label", "a", "b"]
    per = left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_" for k in keys])).applyInArrow(
        sums,
        f"id {kind}, label string, s double",
    ).groupBy("id", "label").agg(F.sum("s").alias("s"))
    medoid = per.groupBy("label").agg(F.min(F.struct(F.round("s", 9).alias("s"), "id"))["id"].alias("medoid"))
    at = medoid.join(rows.select(F.col("id").alias("medoid"), F.col("v").alias("w")), "medoid").select(F.col("label").alias("l"), "w")  # a row a label
    gap = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return rows.join(F.broadcast(at), F.col("label") == F.col("l")).select("id", "label", gap.alias("distance"))


def neighbour_validation(table: DataFrame, space: DataFrame, flat: DataFrame, anchors: int = 5) -> dict[str, DataFrame]:
    """Do neighbours in ``space`` (id, v) share category and scores, and are they neighbours on the map ``flat`` (id, v)?"""
    labels = table.select(F.col("source_id").alias("id"), F.col("final_primary_tag").alias("label"))
    evidence = K.hellinger(table).select(F.col("source_id").alias("id"), F.transform("evidence", lambda x: x * x).alias("v"))
    near, mapped = E.nearest(space, space, 10), E.nearest(flat, flat, 5)
    by = E.neighbour_agreement(near, labels)
    on_map = E.neighbour_agreement(mapped, labels, (5,)).select("query", F.col("agreement_at_5").alias("map_agreement_at_5"))
    first = near.where("rank = 1").select(
        "query",
        F.col("neighbour").alias("nearest_source_id"),
        F.col("distance").alias("nearest_distance"),
    )
    kept = first.join(
        mapped.select(F.col("query").alias("q"), F.col("neighbour").alias("n")),
        (F.col("query") == F.col("q")) & (F.col("nearest_source_id") == F.col("n")),
        "left_semi",
    ).select("query", F.lit(True).alias("kept"))
    out = by.join(on_map, "query", "left").join(first, "query", "left").join(kept, "query", "left").withColumn(
        "nearest_preserved_on_map",
        F.coalesce("kept", F.lit(False)),
    ).drop("kept")
    out = out.join(
        E.score_similarity(near, evidence, 10).select("query", F.col("similarity").alias("score_similarity_at_10")),
        "query",
        "left",
    )
    out = out.join(score_margin(table).withColumnRenamed("id", "query"), "query", "left")
    away = typical_distances(space.join(labels, "id")).select(
        F.col("id").alias("query"),
        F.col("distance").alias("distance_to_typical_example"),
    )
    out = out.join(away, "query", "left").withColumnRenamed("query", "source_id")
    summary = out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.avg("agreement_at_5").alias("neighbour_agreement"),
        F.avg("map_agreement_at_5").alias("map_neighbour_agreement"),
        median(F.col("classification_score_margin")).alias("median_score_margin"),
        median(F.col("distance_to_typical_example")).alias("median_distance_to_typical_example"),
    )
    w = W.partitionBy("final_primary_tag").orderBy(F.desc_nulls_last("strength"), "source_id")
    strongest = table.withColumn("strength", K.strength(table)).withColumn("r", F.row_number().over(w)).where("r = 1").select(
        F.col("source_id").alias("query"),
        F.col("final_primary_tag").alias("anchor_category"),
    )
    pairs = near.where(F.col("rank") <= anchors).join(strongest, "query").join(
        labels.select(F.col("id").alias("neighbour"), F.col("label").alias("neighbour_category")),
        "neighbour",
    )
    pairs = pairs.select(
        F.col("query").alias("anchor_source_id"),
        "anchor_category",
        "rank",
        F.col("neighbour").alias("neighbour_source_id"),
        "distance",
        "neighbour_category",
        (F.col("anchor_category") == F.col("neighbour_category")).alias("same_category"),
    )
    return {"sources": out, "categories": summary, "anchors": pairs}


def trustworthiness(space_near: DataFrame, map_near: DataFrame, ranks: DataFrame, n: int, k: int) -> float:
    """How far map neighbours are neighbours in the space: 1 less the mean excess of their ranks there. ``ranks`` is (query, neighbour, rank) up to n - 1."""
    wrong = map_near.where(F.col("rank") <= k).select("query", "neighbour").join(
        space_near.where(F.col("rank") <= k).select("query", "neighbour"),
        ["query", "neighbour"],
        "left_anti",
    )
    excess = wrong.join(
        ranks.select("query", "neighbour", F.col("rank").alias("r")),
        ["query", "neighbour"],
    ).agg(F.sum(F.col("r") - k)).first()[0] or 0
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * excess


def weight_sweep(
    features: DataFrame,
    choices: dict[str, dict[str, float]],
    cfg: MorphologyConfig = MorphologyConfig(),
    space: str = "combined",
    k: int = 5,
) -> list[dict]:
    """For each named choice of block weights: the share of map neighbours that are neighbours in the unweighted space too, best first."""
    values = space_values(features, space, cfg).withColumnRenamed("source_id", "id")
    names = space_names(space, cfg)
    spark, plain = features.sparkSession, E.vectors(E.scaled(values, E.fit_scaler(values)), "id")
    truth = E.nearest(plain, plain, k).select("query", "neighbour")
    total, rows = truth.count(), []
    for name, given in choices.items():
        table = spark.createDataFrame([(i, float(given.get(n, 1.0))) for i, n in enumerate(names)], "dim int, weight double")
        placed = E.pca_map(E.vectors(E.scaled(values, E.fit_scaler(values, table)), "id"))[0].select("id", F.col("components").alias("v"))
        same = E.nearest(placed, placed, k).select("query", "neighbour").join(truth, ["query", "neighbour"], "left_semi").count()
        rows.append({"choice": name, "preserved": same / max(total, 1)})
    return sorted(rows, key=lambda r: (-r["preserved"], r["choice"]))
