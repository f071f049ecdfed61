"""Nearest points on a chromosome, and the association of ranges with genes built on them.

Left neighbours are prefix maxima over the union of points and queries, right neighbours are
prefix minima from the other end; both run in tiles.  Points at a found position are then
fetched by an equi-join, so ties and duplicates all come back.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .intervals import TILE, bound5
from .prefix import looked_up, prefix

LIMIT = 1_000_000


def neighbours(queries: DataFrame, points: DataFrame, at: str = "mid", pos: str = "pos", keys: Sequence[str] = ("chrom",), strict: bool = False) -> DataFrame:
    """Add `left` and `right`: the nearest point positions on either side of queries, the
    query's own position included unless strict; null where there is none."""
    cols = [c for c in queries.columns if c not in keys]
    q = queries.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(None).cast("long").alias("__pos"), F.struct(*cols).alias("__q"))
    p = points.select(*keys, F.col(pos).cast("long").alias("__at"), F.col(pos).cast("long").alias("__pos")).distinct()
    rows = q.unionAll(p.withColumn("__q", F.lit(None).cast(q.schema["__q"].dataType))).withColumn("__tile", F.expr(f"__at div {TILE}"))
    asks = F.col("__q").isNotNull()  # with strict, queries come before points at their place
    tie = asks.desc() if strict else asks.asc()
    rows = prefix(rows, keys, "__tile", [F.col("__at").asc(), tie], F.col("__pos"), "left", "max")
    rows = prefix(rows, keys, "__tile", [F.col("__at").desc(), tie], F.col("__pos"), "right", "min", reverse=True)
    return rows.where(asks).select(*keys, *[F.col("__q")[c].alias(c) for c in cols], "left", "right")


def nearest(queries: DataFrame, points: DataFrame, at: str = "mid", pos: str = "pos", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Each query with all points at the least distance, on both sides and repeated ones."""
    held = neighbours(queries, points, at, pos, keys)
    gap = F.least(F.col(at) - F.col("left"), F.col("right") - F.col(at))
    side = lambda c, d: F.when(d == F.col("distance"), F.col(c))
    held = held.withColumn("distance", gap).withColumn(pos, F.explode(F.array_distinct(F.array_compact(F.array(side("left", F.col(at) - F.col("left")), side("right", F.col("right") - F.col(at)))))))
    return held.drop("left", "right").join(points, [*keys, pos])


def within_distance(queries: DataFrame, points: DataFrame, left: int, right: int, at: str = "mid", pos: str = "pos", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Pairs with at - left <= pos <= at + right."""
    a = queries.withColumns({"start": F.greatest(F.col(at) - left, F.lit(0)), "stop": F.col(at) + right + 1})
    return holding(a, points, left + right + 1, pos, keys).drop("start", "stop")


def holding(ranges: DataFrame, points: DataFrame, size: int, pos: str = "pos", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Pairs of a range and a point in it, whose columns get the prefix b_.

    A point lies in one bin, a range is dealt to all that it spans; bins are half as long as most
    ranges (`size`) or less, so few points of its bins lie outside of a range, however many there are.
    """
    level = max(0, (max(size, 1) // 2).bit_length() - 1)
    place = lambda c: F.shiftright(c.cast("long"), level)
    left = ranges.where("start < stop").select("*", F.explode(F.sequence(place(F.col("start")), place(F.col("stop") - 1))).alias("__bin"))
    right = points.select(*keys, *[F.col(c).alias(f"b_{c}") for c in points.columns if c not in keys], place(F.col(pos)).alias("__bin"))
    return left.join(right, [*keys, "__bin"]).where((F.col("start") <= F.col(f"b_{pos}")) & (F.col(f"b_{pos}") < F.col("stop"))).drop("__bin")


# ---- association with genes -------------------------------------------------------------


def midpoints(loci: DataFrame) -> DataFrame:
    return loci.withColumn("mid", F.expr("(start + stop) div 2"))


def starts(transcripts: DataFrame, coding_only: bool = False) -> DataFrame:
    """(chrom, pos, tid, strand): the 5' ends of transcripts."""
    t = transcripts.where("coding") if coding_only else transcripts
    return t.select("chrom", bound5().cast("long").alias("pos"), "tid", F.col("strand").alias("t_strand"))


def associated_single(loci: DataFrame, tss: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, tid): transcripts at the least distance, if that is under the limit."""
    return nearest(midpoints(loci).select("chrom", "id", "mid"), tss).where(F.col("distance") < limit).select("id", "tid")


def associated_two(loci: DataFrame, tss: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, tid): of the transcripts at the two framing positions and at the midpoint itself, within
    the limit, the two with the largest 5' positions."""
    held = neighbours(midpoints(loci).select("chrom", "id", "mid"), tss, strict=True)
    held = held.withColumn("pos", F.explode(F.array_compact(F.array("left", "mid", "right"))))
    found = held.join(tss, ["chrom", "pos"]).where(F.abs(F.col("pos") - F.col("mid")) <= limit)
    w = W.partitionBy("id").orderBy(F.col("pos").desc(), F.col("tid"))
    return found.withColumn("__r", F.row_number().over(w)).where("__r <= 2").select("id", "tid")


def associated_multiple(loci: DataFrame, tss: DataFrame, genome: DataFrame, near: int = 50_000, limit: int = LIMIT) -> DataFrame:
    """(id, tid): all from the left neighbour of mid - near to the right neighbour of mid + near."""
    m = midpoints(loci).join(F.broadcast(genome.select("chrom", "length")), "chrom")  # one row for each chromosome
    m = m.select("chrom", "id", "mid", F.greatest(F.col("mid") - near, F.lit(0)).alias("ml"), F.least(F.col("mid") + near, "length").alias("mr"))
    low = neighbours(m, tss, at="ml", strict=True).select("chrom", "id", "mid", "mr", F.col("left").alias("low"))
    both = neighbours(low, tss, at="mr", strict=True).select("chrom", "id", "mid", "low", F.col("right").alias("high"))
    reach = both.select("chrom", "id", "mid", F.greatest(F.coalesce("low", F.lit(0)), F.col("mid") - limit, F.lit(0)).alias("start"), (F.least(F.coalesce("high", F.col("mid") + limit), F.col("mid") + limit) + 1).alias("stop"))
    return holding(reach, tss, 2 * near).select("id", F.col("b_tid").alias("tid"))


def associated_basal(loci: DataFrame, tss: DataFrame, upstream: int = 5_000, downstream: int = 1_000, distal: int = LIMIT) -> DataFrame:
    """(id, tid): transcripts whose basal domain holds the midpoint; without any, those whose
    basal domains are the nearest on either side.  The distal limit counts on a side only where
    both strands have a boundary there."""
    m = midpoints(loci).select("chrom", "id", "mid")
    # what a midpoint may lie before and behind a 5' end of each strand
    sides = [(tss.where(F.col("t_strand") == s), low, high) for s, low, high in (("+", downstream, upstream), ("-", upstream, downstream))]
    basal = reduce(DataFrame.unionAll, [within_distance(m, points, low, high).select("id", F.col("b_tid").alias("tid")) for points, low, high in sides])
    rest, furthest = m, []
    for i, (points, low, high) in enumerate(sides):  # a scan finds the midpoints without any, not the pairs
        rest = looked_up(rest, F.col("mid") + high, points.select("chrom", F.col("pos").alias("__pos"), F.col("pos").alias(f"__last{i}")), "__pos", [f"__last{i}"], ("chrom",), inclusive=True, tiled=m)
        furthest.append(F.coalesce(F.col(f"__last{i}") >= F.greatest(F.col("mid") - low, F.lit(0)), F.lit(False)))
    there = rest.select("chrom", "id", "mid", reduce(Column.__or__, furthest).alias("there"))
    rest = there.where("NOT there").join(there.where("there").select("id").distinct(), "id", "left_anti").select("chrom", "id", "mid")
    frames = rest
    for s, name in (("+", "p"), ("-", "m")):
        frames = neighbours(frames, tss.where(F.col("t_strand") == s), strict=True).withColumnsRenamed({"left": f"{name}l", "right": f"{name}r"})
    mid = F.col("mid")
    shifted = {
        "pl_b": F.when(F.col("pl") + downstream < mid, F.col("pl") + downstream), "ml_b": F.when(F.col("ml") + upstream < mid, F.col("ml") + upstream),
        "pr_b": F.when(F.col("pr") - upstream > mid, F.col("pr") - upstream), "mr_b": F.when(F.col("mr") - downstream > mid, F.col("mr") - downstream),
    }
    frames = frames.withColumns(shifted)
    left = F.when(F.col("pl_b").isNull() | F.col("ml_b").isNull(), F.coalesce("pl_b", "ml_b")).otherwise(F.when(mid - F.greatest("pl_b", "ml_b") <= distal, F.greatest("pl_b", "ml_b")))
    right = F.when(F.col("pr_b").isNull() | F.col("mr_b").isNull(), F.coalesce("pr_b", "mr_b")).otherwise(F.when(F.least("pr_b", "mr_b") - mid <= distal, F.least("pr_b", "mr_b")))
    frames = frames.withColumns({"lb": left, "rb": right})
    pick = lambda c, s, hit: F.when(hit, F.struct(F.col(c).alias("pos"), F.lit(s).alias("t_strand")))
    chosen = F.array_compact(F.array(
        pick("pl", "+", F.col("pl") + downstream == F.col("lb")), pick("pr", "+", F.col("pr") - upstream == F.col("rb")),
        pick("ml", "-", F.col("ml") + upstream == F.col("lb")), pick("mr", "-", F.col("mr") - downstream == F.col("rb")),
    ))
    far = frames.select("chrom", "id", F.explode(chosen).alias("e")).select("chrom", "id", "e.pos", "e.t_strand").join(tss, ["chrom", "pos", "t_strand"]).select("id", "tid")
    return basal.unionAll(far)


STRATEGIES = {"single": associated_single, "two": associated_two, "multiple": associated_multiple, "basal_plus_extension": associated_basal}


def great_distance(mid, pos):
    """Distance of a midpoint to a 5' end; -1 where there is none."""
    return F.coalesce(F.abs(mid - pos), F.lit(-1))


def signed_great_distance(mid, pos):
    """How far a midpoint lies above a 5' end, below zero if it lies before it, whatever the strand."""
    return mid - pos
