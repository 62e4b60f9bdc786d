"""python -m chronofold COMMAND: a run from curve files to a catalogue, its saved maps, target lists, registered queries."""

from __future__ import annotations

import argparse
import logging
import os
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronofold")
    p.add_argument("--log", help="a file for the log, besides the terminal")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def staged(name: str, text: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=text)
        s.add_argument("config", help="YAML with input, output, optional catalogue, fields and manual tables, and stage settings")
        s.add_argument("--set", action="append", default=[], metavar="STAGE.NAME=VALUE", help="a setting over the file's")
        return s

    run = staged("run", "clean, select, search periods and classify")
    run.add_argument("--force", action="store_true")
    staged("fit", "make the maps of a run's features and their first catalogue")
    transform = staged("transform", "put a run's sources on the saved maps")
    transform.add_argument("--existing", choices=("skip", "replace", "error"), default="skip")
    staged("relabel", "rules and manual labels anew over the saved features")
    staged("families", "bodies that lie apart on the combined map")
    staged("validate", "do neighbours share their categories?")
    near = staged("neighbours", "the nearest sources of one, in the feature space and on its map")
    near.add_argument("source_id")
    near.add_argument("-k", type=int, default=8)
    targets = sub.add_parser("targets", help="summarise a target list")
    targets.add_argument("file")
    targets.add_argument("--group")
    one = sub.add_parser("query", help="print a registered query's rows")
    one.add_argument("sf_dir")
    one.add_argument("name")
    return p


def settings(path: str, changes: list[str]) -> dict:
    """A YAML file's settings with changes laid over them; relative paths start at the file's folder."""
    import yaml

    from chronofold.config import overridden

    with open(path) as f:
        values = overridden(yaml.safe_load(f) or {}, changes)
    base = os.path.dirname(os.path.abspath(path))
    for name in ("input", "output", "catalogue", "fields", "manual"):
        x = values.get(name)
        if isinstance(x, str) and "://" not in x and not os.path.isabs(x):
            values[name] = os.path.join(base, x)
    for name in ("input", "output"):
        if name not in values:
            raise ValueError(f"{path} lacks {name}")
    return values


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(
        level=logging.DEBUG if a.verbose else logging.INFO,
        format="%(asctime)s %(levelname)s %(message)s",
        handlers=[logging.StreamHandler(), *([logging.FileHandler(a.log)] if a.log else [])],
    )
    logging.getLogger("py4j").setLevel(logging.WARNING)
    from pyspark.sql import SparkSession

    from chronofold.operators import clean as C
    from chronofold.plans import maps, pipeline, registry
    from chronofold.sources import io

    spark = SparkSession.builder.appName("chronofold").getOrCreate()
    if a.command == "targets":
        found, counters = io.prepare_targets(spark.read.option("header", True).csv(a.file), group=a.group)
        counters.show()
        io.target_summary(found, "target_group").show()
        return 0
    if a.command == "query":
        registry.queries()[a.name](spark, a.sf_dir).show(50, truncate=False)
        return 0

    values = settings(a.config, a.set)
    src, out = values.pop("input"), values.pop("output")
    tables = {n: values.pop(n, None) for n in ("catalogue", "fields", "manual")}
    read = lambda n: spark.read.option("header", True).csv(tables[n]) if tables[n] else None
    cfg = pipeline.RunConfig.of(values)
    number = lambda df, *names: df if df is None else df.withColumns({n: df[n].cast("double") for n in names if n in df.columns})
    run = pipeline.Run(spark, out, cfg, getattr(a, "force", False))
    saved = maps.Maps(spark, f"{out}/maps", cfg.morphology)
    if a.command == "run":
        obs = C.standardise(io.read_curves(spark, src))
        run.all(
            obs,
            io.listing_digest(spark, src),
            number(read("catalogue"), "catalogue_period_days"),
            number(read("fields"), "ra_deg", "dec_deg"),
            read("manual"),
        ).show()
    elif a.command == "fit":
        saved.fit(run.read("morphology", "features"), read("manual")).groupBy("final_primary_tag").count().show()
    elif a.command == "transform":
        saved.transform(run.read("morphology", "features"), a.existing, read("manual")).groupBy("is_latest_batch").count().show()
    elif a.command == "relabel":
        saved.relabel(read("manual")).groupBy("final_primary_tag", "label_source").count().show()
    elif a.command == "families":
        saved.families()[1].show()
    elif a.command == "validate":
        saved.validation()["categories"].show()
    else:
        saved.neighbours(a.source_id, a.k).orderBy("space", "rank").show(2 * a.k, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
