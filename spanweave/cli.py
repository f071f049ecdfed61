"""Command line: enrichment of region sets among loci, and overlaps of each locus.

    python -m spanweave.cli enrichment --chrom-sizes S --loci L.bed --regions 'dir/*.bed' --out O
    python -m spanweave.cli overlaps --loci L.bed --regions 'dir/*.bed' --out O
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrichment, intervals
from .session import session
from .sources import annotations, bed


def _sets(spark: SparkSession, pattern: str) -> DataFrame:
    """Ranges of all files that match, with the file's name as `name`."""
    fmt = bed.detect(spark, pattern)
    paths = spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()
    out = None
    for (path,) in paths:  # one small plan for each region file
        one = bed.locations(bed.read(spark, path, fmt)).withColumn("name", F.lit(path.rsplit("/", 1)[-1]))
        out = one if out is None else out.unionAll(one)
    return out


def _flank(df: DataFrame, args) -> DataFrame:
    wide = intervals.flanked(df, args.flank)
    return intervals.merged(wide) if args.merge else wide


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="spanweave")
    p.add_argument("command", choices=("enrichment", "overlaps"))
    p.add_argument("--loci", required=True)
    p.add_argument("--regions", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--chrom-sizes")
    p.add_argument("--background")
    p.add_argument("--masked")
    p.add_argument("--allowed")
    p.add_argument("--simulations", type=int, default=1000)
    p.add_argument("--h1", choices=("two_sided", "greater", "less"), default="two_sided")
    p.add_argument("--metric", choices=("overlap", "intersection_number"), default="overlap")
    p.add_argument("--flank", type=int, default=0)
    p.add_argument("--merge", action="store_true")
    p.add_argument("--seed", type=int, default=1)
    args = p.parse_args(argv)
    spark = spark or session()
    loci, sets = _flank(bed.locations(bed.read(spark, args.loci)), args), _sets(spark, args.regions)
    if args.command == "overlaps":
        named = loci.withColumn("id", F.concat_ws(":", "chrom", "strand", "start", "stop"))
        found = enrichment.overlap_per_locus(named, sets, args.metric, "name")
        found.write.mode("overwrite").option("sep", "\t").option("header", True).csv(args.out)
        return
    if not args.chrom_sizes:
        p.error("--chrom-sizes is needed")
    genome = annotations.read_table(spark, args.chrom_sizes, "sizes")
    whole = genome.select(F.col("chrom").alias("id"), "chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))
    read = lambda path: bed.locations(bed.read(spark, path)) if path else None
    base = intervals.merged(read(args.background), ("chrom",)).withColumn("id", F.concat_ws(":", "chrom", "start")) if args.background else whole
    background = enrichment.allowed_background(base, read(args.masked), read(args.allowed))
    if args.background and (n := loci.count() - intervals.within(loci.select("chrom", "start", "stop"), background.select("chrom", "start", "stop"), ("chrom",)).count()):
        raise SystemExit(f"{n} loci aren't within the background")
    out = enrichment.permutation_test(loci.select("chrom", "start", "stop"), sets.select("name", "chrom", "start", "stop"), background, genome, simulations=args.simulations, alternative=args.h1, seed=args.seed, metric=args.metric)
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(args.out)  # a row for each set


if __name__ == "__main__":
    run()
