"""Command line: ``python -m mosaiq.cli <command>``. Every command reads with Spark and prints or writes a table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.functions import footprints as fp
from mosaiq.operators import images, overlap
from mosaiq.session import session
from mosaiq.sources import files, labels, manifest


def _labels(spark, a) -> DataFrame:
    return files.listing(spark, a.root, ["*.xml", "*.XML"])


def inspect(spark, a) -> DataFrame:
    """Leaf elements of the labels below a folder."""
    return labels.leaves(labels.elements(_labels(spark, a)))


def catalog(spark, a) -> DataFrame:
    """The manifest of the labels below a folder."""
    return manifest.products(_labels(spark, a), a.archive)


def outcome(spark, a) -> DataFrame:
    return manifest.outcomes(_labels(spark, a))


def overlaps(spark, a) -> DataFrame:
    """Overlapping footprints of a manifest (Parquet), largest first."""
    m = spark.read.parquet(a.root)
    corners = [(F.col(f"corner{i}_lat"), F.col(f"corner{i}_lon")) for i in range(1, 5)]
    made = fp.ring_of(corners, F.lit(None).cast("array<struct<lat:double,lon:double>>"), tuple(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")))
    rows = m.select(F.col("label_path").alias("id"), "product_id", made["ring"].alias("ring"), F.coalesce(made["from_box"], F.lit(False)).alias("from_box"))
    return overlap.usable(overlap.overlaps(rows), a.fraction).drop("rings", "extent")


def preprocess(spark, a) -> DataFrame:
    """Image rows (Parquet) after a preset."""
    return images.preprocess(spark.read.parquet(a.root), a.preset)


def register(spark, a) -> DataFrame:
    """Pairs (Parquet) of image rows (Parquet), registered."""
    return images.register_pairs(spark.read.parquet(a.pairs), spark.read.parquet(a.root), preset=a.preset, model=a.model)


COMMANDS = {"inspect": inspect, "catalog": catalog, "outcomes": outcome, "overlap": overlaps, "preprocess": preprocess, "register": register}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mosaiq")
    sub = p.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        c = sub.add_parser(name, help=run.__doc__)
        c.add_argument("root")
        c.add_argument("--out", help="folder for Parquet; without it the rows are printed")
        c.add_argument("--limit", type=int, default=20, help="rows printed")
        if name == "catalog":
            c.add_argument("--archive", default="default")
        if name == "overlap":
            c.add_argument("--fraction", type=float, default=0.0)
        if name in ("preprocess", "register"):
            c.add_argument("--preset", choices=sorted(images.PRESETS), default="none")
        if name == "register":
            c.add_argument("--pairs", required=True)
            c.add_argument("--model", choices=("homography", "affine", "partial_affine"), default="homography")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    out = COMMANDS[a.command](spark or session("mosaiq"), a)
    if a.out:
        out.write.mode("error").parquet(a.out)
    else:
        out.show(a.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
