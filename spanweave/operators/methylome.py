"""Methylation counts of single cytosines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import merge_inner
from .intervals import TILE
from .prefix import prefix

MOST, FIRST = 32767, 2147483647


def build(calls: DataFrame, ignore_duplicates: bool = True) -> DataFrame:
    """(chrom, strand, pos, tag, k, n): calls with a positive total, counts cut at 32767.  Of
    several at a place of a chromosome, whatever the strand, the first by `arrival` counts (of equal
    arrivals the least by strand, tag and counts)."""
    held = calls.where("n > 0").withColumns({"k": F.least("k", F.lit(MOST)), "n": F.least("n", F.lit(MOST))})
    if ignore_duplicates:
        held = held.groupBy("chrom", "pos").agg(F.min(F.struct("arrival", "strand", "tag", "k", "n")).alias("c")).select("chrom", "c.strand", "pos", "c.tag", "c.k", "c.n")
    return held.select("chrom", "strand", "pos", "tag", "k", "n")


def duplicates(calls: DataFrame) -> DataFrame:
    """How many calls a chromosome has beyond the first of each place."""
    return calls.where("n > 0").groupBy("chrom", "pos").count().groupBy("chrom").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def peel(methylome: DataFrame, strand: str | None = None) -> DataFrame:
    """Calls with their level; of one strand, or of both with `strand` true for plus."""
    level = F.try_divide(F.col("k").cast("float"), F.col("n").cast("float")).cast("float")
    if strand:
        return methylome.where(F.col("strand") == strand).select("chrom", "pos", "tag", level.alias("level"), "k", "n")
    return methylome.select("chrom", "pos", "tag", level.alias("level"), "k", "n", (F.col("strand") == "+").alias("strand"))


def frame(methylome: DataFrame, strand: str | None = None, context: int | None = None) -> DataFrame:
    """Calls of a strand and context with `d`, the distance to the call before on the chromosome;
    the first has the largest int."""
    held = methylome.where(F.col("strand") == strand) if strand else methylome
    held = held.where(F.col("tag") == context) if context is not None else held
    rows = held.withColumn("__tile", F.expr(f"pos div {TILE}"))
    before = prefix(rows, ["chrom"], "__tile", [F.col("pos")], F.col("pos"), "__before", "max")
    return before.withColumn("d", F.coalesce(F.col("pos") - F.col("__before"), F.lit(FIRST)).cast("long")).drop("__tile", "__before")


def joined(frames: list[DataFrame]) -> DataFrame:
    """Frames of one chromosome joined by position: k, n and d of each, one tag and strand."""
    out = merge_inner("pos", *[f.select("pos", "tag", "strand", "k", "n", "d") for f in frames])
    n = range(1, len(frames) + 1)
    return out.select("pos", F.col("tag1").alias("tag"), F.col("strand1").alias("strand"), *[f"{c}{i}" for i in n for c in ("k", "n", "d")])


def cytosine_context(seq: Column, at: Column) -> Column:
    """CG, CHG or CHH of the 0-based place, or null: by the two bases after a c, or before a g on
    the other strand."""
    base = lambda k: F.substring(seq, F.greatest(at + k + 1, F.lit(1)).cast("int"), F.when(at + k >= 0, 1).otherwise(0).cast("int"))
    here = base(0)

    def context(one, two, last):
        h = lambda c: ~c.isin(last, "n", "")
        return F.when(one == last, "CG").when(h(one) & (two == last), "CHG").when(h(one) & h(two), "CHH")

    return F.when(here == "c", context(base(1), base(2), "g")).when(here == "g", context(base(-1), base(-2), "c"))


def pileup(aligned: DataFrame, reference: DataFrame, min_quality: int = 0) -> DataFrame:
    """Calls (chrom, strand, pos, k, n) from aligned bases (chrom, pos, base, quality, strand) and
    reference bases (chrom, pos, ref): at a c on plus and a g on minus, how many bases are
    unconverted among those of the strand."""
    site = reference.where(F.col("ref").isin("c", "g")).withColumn("strand", F.when(F.col("ref") == "c", "+").otherwise("-"))
    hits = aligned.where(F.col("quality") >= min_quality).join(site, ["chrom", "pos", "strand"])
    return hits.groupBy("chrom", "strand", "pos").agg(F.count_if(F.col("base") == F.col("ref")).alias("k"), F.count("*").alias("n"))


def bisulfite(aligned: DataFrame, chunks: DataFrame, min_quality: int = 0, size: int = 1024) -> DataFrame:
    """Calls (chrom, strand, pos, context, k, n) from aligned bases of treated reads and the reference
    in chunks (id, at, seq), id being the chromosome.

    Bases are counted by place first.  The reference is dealt to pieces of `size` places with two
    bases before and behind them, and a place meets its own piece only.  At a c on plus and a g on
    minus, k of n bases are unconverted; context is CG, CHG or CHH, null near an end or an n.
    """
    from .chunks import haloed

    counts = aligned.where(F.col("quality") >= min_quality).groupBy("chrom", "strand", "pos", "base").agg(F.count("*").alias("m"))
    sites = counts.groupBy("chrom", "strand", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("base") == b, F.col("m"))), F.lit(0)).alias(b) for b in "cg"], F.sum("m").alias("n"))
    # a place lies in the piece that begins two bases before its own, so that both sides are there
    held = haloed(chunks, size + 4).select(F.col("id").alias("chrom"), "at", F.length("seq").alias("own"), F.lower(F.concat("seq", "halo")).alias("text"))
    first = F.expr(f"(at + {size - 1}) div {size}L")
    cut = held.where("own > 0").select("chrom", "at", "own", "text", F.explode(F.sequence(first, F.greatest(first, F.expr(f"(at + own - 1) div {size}L")))).alias("piece"))
    begin = (F.col("piece") * size - F.col("at")).cast("int")
    pieces = cut.where((begin >= 0) & (begin < F.col("own"))).select("chrom", "piece", F.substring(F.col("text"), begin + 1, F.lit(size + 4)).alias("ref"))
    asked = sites.withColumn("piece", F.expr(f"greatest(pos - 2, 0L) div {size}L"))
    met = asked.join(pieces, ["chrom", "piece"]).withColumn("i", (F.col("pos") - F.col("piece") * size).cast("int"))
    here = F.substring(F.col("ref"), F.col("i") + 1, F.lit(1))
    calls = met.select("chrom", "strand", "pos", here.alias("here"), cytosine_context(F.col("ref"), F.col("i")).alias("context"), F.when(F.col("strand") == "+", F.col("c")).otherwise(F.col("g")).alias("k"), "n")
    return calls.where((F.col("here") == "c") & (F.col("strand") == "+") | (F.col("here") == "g") & (F.col("strand") == "-")).drop("here")
