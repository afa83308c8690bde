"""Command line.

``python -m faciesforge run (--wells W --samples S | --manifest M --las DIR) --out DIR [--config C.yaml] [--steps 0,1,2]
[--pairwise] [--grid-types]`` runs the correlation pipeline on tables, or on the files of a manifest; ``python -m faciesforge framework --reps R.csv --edges E.csv --out DIR [--paths P.jsonl]``
builds a framework and its shifts from files.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import artifacts, config
from .plans.scan import Scan
from .plans.steps import Run, Settings
from .scratch import drop
from .sources.delimited import read_delimited
from .sources.state import heartbeat
from .sources.tables import read_wells


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="faciesforge", description="Well-log correlation over Parquet tables.")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="the correlation pipeline")
    run.add_argument("--wells", help="Parquet table with well_id and coordinates")
    run.add_argument("--samples", help="Parquet table of well_id, depth, value")
    run.add_argument("--manifest", help="delimited text that lists wells and the URLs of their LAS files")
    run.add_argument("--las", help="folder of those files")
    run.add_argument("--out", required=True)
    run.add_argument("--config", help="YAML file of settings")
    run.add_argument("--section", default="", help="dotted name of the settings in that file")
    run.add_argument("--steps", default="0,1,2,3,4")
    run.add_argument("--pairwise", action="store_true", help="align every edge of the spatial graph")
    run.add_argument("--grid-types", action="store_true", help="type wells of the finer grid")
    frame = commands.add_parser("framework", help="a framework from files of representatives and aligned edges")
    frame.add_argument("--reps", required=True)
    frame.add_argument("--edges", required=True)
    frame.add_argument("--out", required=True)
    frame.add_argument("--paths", help="JSON lines of tie points, for the shifts")
    frame.add_argument("--curve", default="GR")
    frame.add_argument("--samples", type=int, default=400, dest="n")
    frame.add_argument("--framework", default="mst", choices=("mst", "topk", "threshold", "mst_plus_topk"), dest="mode")
    frame.add_argument("--topk", type=int, default=3)
    frame.add_argument("--sim-threshold", type=float, default=0.60, dest="least")
    frame.add_argument("--sim-scale", type=float, default=0.25, dest="scale")
    frame.add_argument("--rgt-damping", type=float, default=0.01, dest="damping")
    frame.add_argument("--rgt-maxiter", type=int, default=500, dest="most")
    frame.add_argument("--rgt-tol", type=float, default=1e-6, dest="tol")
    frame.add_argument("--rgt-precise", action="store_true", dest="precise")
    return p


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("faciesforge").getOrCreate()
    if args.command == "framework":
        own = {k: v for k, v in vars(args).items() if k not in ("command", "reps", "edges", "out", "paths")}
        print(artifacts.framework(spark, args.reps, args.edges, args.out, args.paths, **own))
        return
    values = config.load(args.config) if args.config else {}
    values = config.value_at(values, args.section, {}) if args.section else values
    steps = tuple(dict.fromkeys(int(x) for x in args.steps.split(",")))
    run, files = Run(spark, args.out, Settings.of(values)), {}
    if args.manifest:
        files, wells, samples = run.from_files(read_delimited(spark, args.manifest), args.las, Scan(min_finite=run.settings.min_finite))
    else:
        wells, samples = read_wells(spark, args.wells), spark.read.parquet(args.samples)
    out = files | run.run(wells, samples, steps)
    if args.pairwise:
        out |= run.pairwise(wells, samples)
    if args.grid_types:
        out["grid_types"] = run.grid_type_wells(wells, samples)
    counts = {name: df.count() for name, df in out.items()}
    for name, n in counts.items():
        print(name, n)
    if args.out.startswith(("/", "file://")):
        heartbeat(f"{args.out.removeprefix('file://')}/state.json", step="done", rows=counts)
    drop(spark)


if __name__ == "__main__":
    main()
