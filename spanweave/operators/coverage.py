"""Tag coverage: tags of single and paired reads, counts in ranges, fragment size, peak reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .intervals import bound5, range_join

MAX_FRAGMENT = 500


def single_tags(reads: DataFrame, unique: bool = True) -> DataFrame:
    """(chrom, strand, pos): the 5' end of each read; with unique each place once."""
    tags = reads.select("chrom", "strand", bound5().cast("long").alias("pos"))
    return tags.distinct() if unique else tags


def paired_tags(pairs: DataFrame, unique: bool = True, most: int = MAX_FRAGMENT) -> tuple[DataFrame, DataFrame]:
    """Tags (chrom, strand '+', pos) in the middle of fragments of (chrom, pos, mate, length), and
    one row (pairs, fragment) with their mean size; longer fragments don't count at all."""
    p = pairs.select("chrom", F.least("pos", "mate").alias("a"), F.greatest("pos", "mate").alias("b"), "length")
    p = p.withColumn("size", F.col("b") + F.col("length") - F.col("a")).where(F.col("size") <= most)
    tags = p.select("chrom", F.lit("+").alias("strand"), F.expr("a + size div 2").cast("long").alias("pos"))
    mean = p.agg(F.count("*").alias("pairs"), F.expr("coalesce(try_divide(sum(size), count(*)), 0)").cast("long").alias("fragment"))
    return (tags.distinct() if unique else tags), mean


def counts(regions: DataFrame, tags: DataFrame, fragment: int = 0, both_strands: bool = False) -> DataFrame:
    """Regions with `coverage`: tags in [start, stop) once they are moved by half a fragment
    along their strand; regions without tags have 0."""
    half = fragment // 2
    shifts = F.when(F.col("strand") == "+", -half).otherwise(half)
    cols = regions.columns
    if both_strands:
        sides = regions.drop("strand").withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    else:
        sides = regions
    asked = sides.select("chrom", "strand", "id", F.greatest(F.col("start") + shifts, F.lit(0)).alias("start"), (F.col("stop") + shifts).alias("stop"))
    points = tags.groupBy("chrom", "strand", "pos").agg(F.count("*").alias("n")).select("chrom", "strand", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), "n")
    hit = range_join(asked.where("start < stop"), points).groupBy("id").agg(F.sum("b_n").alias("coverage"))
    return regions.join(hit, "id", "left").select(*cols, F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def depth(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count("*").alias("depth"))


def cross_correlation(tags: DataFrame, genome: DataFrame, read_length: float, most: int = MAX_FRAGMENT) -> DataFrame:
    """(fragment, value): over chromosomes the mean, weighted by tags, of the Pearson correlation of
    plus tags moved by `fragment` with minus tags; repeated tags count in sizes, not in matches."""
    low = -int(-read_length * 1.5 // 1)
    side = lambda s: tags.where(F.col("strand") == s)
    a = side("+").select("chrom", "pos").distinct().select("chrom", (F.col("pos") + low).alias("start"), (F.col("pos") + most + 1).alias("stop"), F.col("pos").alias("p"))
    b = side("-").select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop")).distinct()
    met = range_join(a, b, ("chrom",)).groupBy("chrom", (F.col("b_start") - F.col("p")).alias("fragment")).agg(F.count("*").alias("m"))
    sizes = tags.groupBy("chrom").agg(F.count_if(F.col("strand") == "+").cast("double").alias("np"), F.count_if(F.col("strand") == "-").cast("double").alias("nm"))
    sizes = sizes.join(genome.select("chrom", F.col("length").cast("double").alias("lc")), "chrom")  # a row for each chromosome
    every = sizes.withColumn("fragment", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(most).cast("long"))))
    each = every.join(met, ["chrom", "fragment"], "left").withColumn("m", F.coalesce("m", F.lit(0)).cast("double"))
    top = F.col("lc") * F.col("m") - F.col("np") * F.col("nm")
    r = F.coalesce(F.try_divide(top, F.sqrt(F.col("np") * (F.col("lc") - F.col("np")) * F.col("nm") * (F.col("lc") - F.col("nm")))), F.lit(0.0))
    return each.groupBy("fragment").agg(F.try_divide(F.sum((F.col("np") + F.col("nm")) * r), F.sum(F.col("np") + F.col("nm"))).alias("value"))


def fragment_size(tags: DataFrame, genome: DataFrame, read_length: float, most: int = MAX_FRAGMENT) -> DataFrame:
    """The fragment size with the largest correlation, the least of equal ones."""
    if -int(-read_length * 1.5 // 1) > most:
        return tags.sparkSession.createDataFrame([(int(read_length),)], "fragment long")
    cc = cross_correlation(tags, genome, read_length, most)
    return cc.agg(F.max(F.struct("value", (-F.col("fragment")).alias("f"))).alias("best")).select((-F.col("best.f")).alias("fragment"))


def peaks_info(peaks: DataFrame, genome: DataFrame) -> DataFrame:
    """Number, length and share of the genome of peaks, and lengths cut to whole numbers."""
    size = F.col("stop") - F.col("start")
    whole = lambda c: F.coalesce(F.floor(c), F.lit(0)).cast("long")
    total = genome.agg(F.sum("length").alias("genome"))
    one = peaks.agg(F.count("*").alias("count"), whole(F.sum(size)).alias("total"), whole(F.min(size)).alias("least"), whole(F.max(size)).alias("most"), whole(F.avg(size)).alias("mean"), whole(F.percentile(size, 0.5)).alias("median"))
    return one.crossJoin(total).select("count", "total", F.try_divide(F.col("total").cast("double"), "genome").alias("share"), "least", "most", "mean", "median")  # two single rows


def frip(peaks: DataFrame, genome: DataFrame, replicates: list[DataFrame], fragment: int = 0) -> DataFrame:
    """Mean over replicates of the share of tags in peaks, of all tags on the genome."""
    whole = genome.select(F.col("chrom").alias("id"), "chrom", F.lit("+").alias("strand"), F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))
    parts = None
    for tags in replicates:
        inside = counts(peaks.select("id", "chrom", "strand", "start", "stop"), tags, fragment, True).agg(F.sum("coverage").alias("a"))
        everything = counts(whole, tags, fragment, True).agg(F.sum("coverage").alias("b"))
        one = inside.crossJoin(everything).select(F.try_divide(F.col("a").cast("double"), "b").alias("r"))  # two single rows
        parts = one if parts is None else parts.unionAll(one)
    return parts.agg(F.avg("r").alias("frip"))


# ---- histograms -------------------------------------------------------------------------


def histogram(df: DataFrame, value) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def add_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionAll(b).groupBy("value").agg(F.sum("n").alias("n"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """(count, mean, stdev): from value counts; the mean of nothing is NaN."""
    s = hist.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("value") * F.col("n")).cast("double").alias("s"), F.sum(F.col("value") * F.col("value") * F.col("n")).cast("double").alias("q"))
    mean = F.coalesce(F.try_divide("s", "n"), F.lit(float("nan")))
    return s.select(F.coalesce("n", F.lit(0)).cast("long").alias("count"), mean.alias("mean"), F.sqrt(F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)).alias("stdev"))


def histogram_median(hist: DataFrame) -> DataFrame:
    """The first value at which over half of the counts are reached; -1 without any.

    The window runs over different values only, after they are counted.
    """
    w = W.orderBy("value")
    held = hist.select("value", F.sum("n").over(w).alias("upto"), F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    return held.where("2 * upto > all").agg(F.coalesce(F.min("value"), F.lit(-1)).cast("long").alias("median"))
