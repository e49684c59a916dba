"""Command line: ``python -m chronotile stack | tile | export --help``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from chronotile.operators import kernels, obs, segments
from chronotile.schema import Grid
from chronotile.sources import files, ingest, tiff
from chronotile.streaming import nrt


def _grid(args) -> Grid:
    return Grid(args.rows, args.cols, args.blocks_x, args.blocks_y)


def stack(spark: SparkSession, args) -> None:
    """Archived scenes to observations by block."""
    rows = ingest.read_scenes(spark, args.source, args.kind, _grid(args), args.low, args.high, args.clear_threshold, tuple(args.bounds) if args.bounds else None)
    files.write_scenes(rows, _grid(args), args.out)


def tile(spark: SparkSession, args) -> None:
    """Observations by block to segments (and magnitudes) or packs by block; blocks that are done stay."""
    grid, began = _grid(args), time.time()
    blocks = spark.range(1, grid.n_block_x * grid.n_block_y + 1).withColumnRenamed("id", "block_id")
    left = [r[0] for r in files.unfinished(blocks, f"{args.out}/{args.method}").collect()]  # a tile has some hundred blocks
    rows = files.read_obs(spark, args.obs, left, args.low, args.high)
    if args.method == "sccd":
        files.write_blocks(nrt.detect(rows, t_cg=args.t_cg, conse=args.conse, collection2=args.c2), grid, f"{args.out}/sccd")
    elif args.cm_interval:
        start, _, n = files.read_obs(spark, args.obs).transform(lambda o: obs.date_range(o, args.cm_interval)).first()
        both = kernels.detect_both(rows, start, n, args.cm_interval, args.t_cg, args.conse, args.c2).persist()
        files.write_blocks(kernels.magnitudes_of(both), grid, f"{args.out}/cm")
        files.write_blocks(kernels.segments_of(both), grid, f"{args.out}/cold")
        both.unpersist()
    else:
        files.write_blocks(kernels.detect(rows, args.t_cg, args.conse, args.c2), grid, f"{args.out}/cold")
    files.report(spark, f"{args.out}/report", blocks=len(left), seconds=round(time.time() - began), **{k: v for k, v in vars(args).items() if k != "run"})


def export(spark: SparkSession, args) -> None:
    """Segments to yearly break maps, and the first and the most recent year of disturbance, as tables and images."""
    grid = _grid(args)
    found = files.read_segments(spark, args.segments).filter("seg is not null")
    kinds = segments.category_obcold(found) if args.flavour == "obcold" else segments.category(found, args.flavour)
    maps = segments.break_map(kinds).persist()  # read three times
    maps.repartition("year").write.mode("overwrite").partitionBy("year").parquet(f"{args.out}/break_map")
    ends = segments.first_recent(maps, found.select("pos").distinct()).persist()
    ends.write.mode("overwrite").parquet(f"{args.out}/first_recent")
    place = tiff.Place(*args.place[:4], int(args.place[4])) if args.place else None
    files.save_images(files.images(maps, grid, "year", "value", place), f"{args.out}/images", "break_map")
    for name in ("first_year", "recent_year"):
        files.save_images(files.images(ends.withColumn("one", F.lit(0)), grid, "one", name, place), f"{args.out}/images", name)
    maps.unpersist()
    ends.unpersist()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronotile")
    sub = top.add_subparsers(required=True)

    def command(run):
        p = sub.add_parser(run.__name__, help=run.__doc__)
        p.set_defaults(run=run)
        for name in ("rows", "cols"):
            p.add_argument(f"--{name}", type=int, required=True)
        for name in ("blocks-x", "blocks-y"):
            p.add_argument(f"--{name}", type=int, default=1)
        p.add_argument("--out", required=True)
        return p

    p = command(stack)
    p.add_argument("--source", required=True)
    p.add_argument("--kind", choices=sorted(ingest.KINDS), required=True)
    p.add_argument("--clear-threshold", type=float, default=0.0)
    p.add_argument("--bounds", type=float, nargs=4)
    q = command(tile)
    q.add_argument("--obs", required=True)
    q.add_argument("--method", choices=["cold", "sccd"], default="cold")
    q.add_argument("--cm-interval", type=int, default=0)
    q.add_argument("--t-cg", type=float, default=15.0863)
    q.add_argument("--conse", type=int, default=6)
    q.add_argument("--c2", action="store_true")
    for x in (p, q):
        x.add_argument("--low", type=int)
        x.add_argument("--high", type=int)
    p = command(export)
    p.add_argument("--segments", required=True)
    p.add_argument("--flavour", choices=["cold", "obcold", "sccd"], default="cold")
    p.add_argument("--place", type=float, nargs=5, help="x, y, pixel width and height, projection code")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("chronotile").getOrCreate(), args)


if __name__ == "__main__":
    main()
