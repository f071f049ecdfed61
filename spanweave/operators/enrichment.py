"""Permutation enrichment of region sets among loci, random placement, per-locus overlaps."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import staged
from .frame import uniform
from .intervals import KEY, complement, merged, met_numbers, named_sets, range_join
from .prefix import prefix, ranges

#: Positions in a tile, at least; tiles in order make up stretches of the background.
TILE = 1 << 16
#: Loci that a task places at a time, and ranges of background and sets in a stretch, about.
LOCI, RANGES = 250_000, 250_000
#: Chromosomes lie so many positions apart (as a power of two) where a task compares places.
_APART = 40
#: No place; numbers that a block of sets holds to look places up, at most (or one set).
_NONE, _CELLS = np.iinfo(np.int64).max, 1 << 22


def _near(at: np.ndarray, who: np.ndarray, gone: np.ndarray, new: np.ndarray, stop: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each new range meets the one before it, and the numbers of those that one meets
    behind it; ranges in order that are apart, but for those that are gone."""
    low = np.searchsorted(at, new, "right")
    i = low - 1
    while len(back := np.flatnonzero((i >= 0) & gone[i])) if len(at) else ():
        i[back] -= 1
    met = (i >= 0) & (new < at[i] + lengths[who[i]]) if len(at) else np.zeros(len(new), bool)
    n = np.maximum(np.searchsorted(at, stop, "left"), low) - low
    hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return met, np.unique(hit[~gone[hit]])


def places(lengths: np.ndarray, chrom: np.ndarray, begin: np.ndarray, size: np.ndarray, limit: np.ndarray, rng: np.random.Generator, retries: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the length) of ranges with the given lengths that don't overlap, in order;
    a place has its chromosome above the bits of _APART.

    A start is drawn uniformly over the background, and a range must end within its chromosome
    (`limit`).  All ranges are drawn at once; those that end too late or meet one before them
    are drawn again, up to `retries` times.  Ranges that stay are apart and in order, so a round
    only looks at what is near the new ones.
    """
    order = np.lexsort((begin, chrom))
    far = np.asarray(chrom, np.int64)[order] << _APART
    first, last, size = far + begin[order], far + limit[order], size[order]
    cum = np.cumsum(size)
    none = np.zeros(0, np.int64)
    at, who, gone = none, none, np.zeros(0, bool)
    more, of = none, none  # placed since, a few, so that a round needn't copy all
    todo = np.arange(len(lengths))
    for _ in range(retries if len(todo) else 0):
        draw = np.sort(rng.integers(0, cum[-1], len(todo)))
        row = np.searchsorted(cum, draw, "right")
        new, mine = (first - cum + size)[row] + draw, rng.permutation(todo)
        if (new[1:] < new[:-1]).any():  # pieces of background that overlap
            by = np.argsort(new, kind="stable")
            new, row = new[by], row[by]
        stop = new + lengths[mine]
        again = stop > last[row]
        again[1:] |= new[1:] < np.maximum.accumulate(stop)[:-1]
        met, hit = _near(at, who, gone, new, stop, lengths)
        also, out = _near(more, of, np.zeros(len(more), bool), new, stop, lengths)
        good = ~(again | met | also)
        todo = np.concatenate([mine[~good], who[hit], of[out]])
        gone[hit] = True
        more, of = np.delete(more, out), np.delete(of, out)
        to = np.searchsorted(more, new[good], "right")
        more, of = np.insert(more, to, new[good]), np.insert(of, to, mine[good])
        if not len(todo) or 16 * len(more) > len(at):
            at, who = at[~gone], who[~gone]
            to = np.searchsorted(at, more, "right")
            at, who, more, of = np.insert(at, to, more), np.insert(who, to, of), none, none
            gone = np.zeros(len(at), bool)
        if not len(todo):
            return at, who
    if len(todo):
        raise RuntimeError("too many attempts to place ranges")
    return at, who


def place(lengths: np.ndarray, chrom: np.ndarray, begin: np.ndarray, size: np.ndarray, limit: np.ndarray, rng: np.random.Generator, retries: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(background row, start) of places() for each of the lengths."""
    at, who = places(lengths, chrom, begin, size, limit, rng, retries)
    order = np.flatnonzero(size > 0)
    order = order[np.lexsort((begin[order], chrom[order]))]
    row, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    row[who] = order[np.searchsorted((np.asarray(chrom, np.int64)[order] << _APART) + begin[order], at, "right") - 1] if len(at) else 0
    start[who] = at & ((1 << _APART) - 1)
    return row, start


# ---- stretches of the background ---------------------------------------------------------


def _stretches(background: DataFrame, genome: DataFrame, n_loci: int, longest: int, sets: DataFrame | None, loci_each: int) -> tuple[DataFrame, DataFrame, int]:
    """(pieces, tiles, tile): background pieces (stretch, chrom, start, stop, limit), the stretch of
    each tile (chrom, tile, stretch, opens, bases) and the length of tiles.

    A stretch is a run of tiles, over chromosomes if need be, with its share of about `loci_each`
    loci and of about RANGES pieces and ranges of sets.  A placed range ends at `limit` or before:
    where the next stretch begins on its chromosome, or at the chromosome's end.  By this seam
    rule ranges of different stretches can't meet.  Tiles are 64 times as long as the longest
    locus at least, so that it bars few starts.
    """
    tile = max(TILE, 64 * longest)
    bounds = genome.where("length > 0").select("chrom", F.col("length").cast("long").alias("length"))
    every = bounds.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {tile}L"))).alias("tile"))
    first = F.greatest(F.lit(0).cast("long"), F.col("start"))
    held = background.join(bounds, "chrom").select("chrom", first.alias("start"), F.least("stop", "length").alias("stop")).where("start < stop")
    cut = held.select("*", F.explode(F.sequence(F.expr(f"start div {tile}L"), F.expr(f"(stop - 1) div {tile}L"))).alias("tile"))
    pieces = cut.select("chrom", "tile", F.greatest("start", F.col("tile") * tile).alias("start"), F.least("stop", (F.col("tile") + 1) * tile).alias("stop"))
    load = every.join(pieces.groupBy("chrom", "tile").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"), F.count("*").alias("ranges")), ["chrom", "tile"], "left")
    if sets is not None:
        there = sets.groupBy("chrom", F.greatest(F.lit(0).cast("long"), F.expr(f"start div {tile}L")).alias("tile")).agg(F.count("*").alias("more"))
        load = load.join(there, ["chrom", "tile"], "left")
    ranges = F.coalesce("ranges", F.lit(0)) + (F.coalesce("more", F.lit(0)) if sets is not None else F.lit(0))
    # these windows see a row for each tile, that is for each 65,536 positions of the genome or more
    whole = W.partitionBy(F.lit(0))
    share = F.coalesce("bases", F.lit(0)) * (n_loci / loci_each) / F.greatest(F.sum("bases").over(whole), F.lit(1)) + ranges / RANGES
    before = F.sum("share").over(whole.orderBy("chrom", "tile").rowsBetween(W.unboundedPreceding, -1))
    tiles = load.withColumn("share", share).withColumn("stretch", F.floor(F.coalesce(before, F.lit(0.0))).cast("long"))
    along = W.partitionBy("chrom").orderBy("tile")
    tiles = tiles.withColumn("opens", F.coalesce(F.lag("stretch").over(along) != F.col("stretch"), F.lit(True)))
    after = F.min(F.when(F.col("opens"), F.col("tile") * tile)).over(along.rowsBetween(1, W.unboundedFollowing))
    tiles = tiles.select("chrom", "tile", "stretch", "opens", F.coalesce("bases", F.lit(0)).alias("bases"), F.coalesce(after, F.col("length")).alias("limit"))
    return pieces.join(tiles.drop("bases", "opens"), ["chrom", "tile"]).select("stretch", "chrom", "start", "stop", "limit"), tiles, tile


def share(counts: np.ndarray, bases: np.ndarray, mine: int, seed: list[int]) -> np.ndarray:
    """How many loci of each length fall to stretch `mine`: a multinomial by bases, drawn as a tree
    of binomials, so that each task that walks down to its own leaf sees the same draws."""
    low, high = 0, len(bases)
    while high - low > 1:
        mid = (low + high) // 2
        whole = bases[low:high].sum()
        left = np.random.default_rng([*seed, low, high]).binomial(counts, bases[low:mid].sum() / whole if whole else 0.0)
        counts, low, high = (left, low, mid) if mine < mid else (counts - left, mid, high)
    return counts


def _numbers(row: pa.ListScalar) -> dict[str, np.ndarray]:
    """The fields of an array of structs, numbers as arrays and others as lists."""
    held = row.values
    kinds = [held.type.field(i) for i in range(held.type.num_fields)] if held is not None else []
    return {k.name: c.to_numpy() if pa.types.is_integer(k.type) else c.to_pylist() for k, c in zip(kinds, held.flatten() if held is not None else ())}


class _Placer:
    """Random places of loci in one stretch, by simulation."""

    def __init__(self, stretch: int, pieces: pa.ListScalar, lengths: np.ndarray, counts: np.ndarray, bases: np.ndarray, seed: int, retries: int):
        p = _numbers(pieces)
        self.names, self.chrom = np.unique(np.array(p["chrom"], object), return_inverse=True)
        self.begin, self.size, self.limit = p["start"], p["stop"] - p["start"], p["limit"]
        self.stretch, self.lengths, self.counts, self.bases, self.seed, self.retries = stretch, lengths, counts, bases, seed, retries

    def draw(self, sim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chromosome's place in names, start, stop) of the simulation's ranges here."""
        own = np.repeat(self.lengths, share(self.counts, self.bases, self.stretch, [self.seed, sim]))
        at, who = places(own, self.chrom, self.begin, self.size, self.limit, np.random.default_rng([self.seed, sim, self.stretch, 0]), self.retries)
        start = at & ((1 << _APART) - 1)
        return at >> _APART, start, start + own[who]


def _units(loci: DataFrame, background: DataFrame, genome: DataFrame, simulations: int, sets: DataFrame | None, loci_each: int):
    """(units, lengths, counts, bases): rows (stretch, first, last, pieces, ranges), each for some
    simulations of a stretch with its background and the sets' ranges that meet it; the loci's
    lengths and their counts; the bases of each stretch.  Of all that, the driver sees a row for
    each length and each stretch."""
    spark = loci.sparkSession
    classes = loci.groupBy((F.col("stop") - F.col("start")).cast("long").alias("length")).count().orderBy("length").collect()
    lengths, counts = (np.array([r[i] for r in classes], np.int64) for i in (0, 1))
    pieces, tiles, tile = _stretches(background, genome, int(counts.sum()), int(lengths.max(initial=0)), sets, loci_each)
    size = {r[0]: r[1] for r in tiles.groupBy("stretch").agg(F.sum("bases")).collect()}
    bases = np.array([size.get(i, 0) for i in range(max(size, default=0) + 1)], np.int64)
    if len(counts) and not bases.sum():
        raise ValueError("no background to place ranges in")
    units = pieces.groupBy("stretch").agg(F.collect_list(F.struct("chrom", "start", "stop", "limit")).alias("pieces"))  # about RANGES at most
    if sets is not None:
        at = F.greatest(F.lit(0).cast("long"), F.expr(f"start div {tile}L"))
        dealt = sets.select("*", at.alias("at"), F.explode(F.sequence(at, F.greatest(at, F.expr(f"(stop - 1) div {tile}L")))).alias("tile"))
        dealt = dealt.join(tiles.select("chrom", "tile", "stretch", "opens"), ["chrom", "tile"]).where("tile = at OR opens")  # once in each stretch
        units = units.join(dealt.groupBy("stretch").agg(F.collect_list(F.struct("set", "chrom", "start", "stop")).alias("ranges")), "stretch", "left")
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = max(1, simulations * len(bases) // tasks)
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long"), F.lit(chunk).cast("long"))).alias("first")
    units = units.select("*", runs).withColumn("last", F.least(F.col("first") + chunk, F.lit(simulations).cast("long")))
    return units.repartition(min(tasks, len(bases) * -(-simulations // chunk)), "stretch", "first"), lengths, counts, bases


def shuffled(loci: DataFrame, background: DataFrame, genome: DataFrame, simulations: int, seed: int = 1, retries: int = 1000, loci_each: int = LOCI) -> DataFrame:
    """(sim, chrom, start, stop): for each simulation ranges of the loci's lengths at random, free of
    overlaps, that start in the background.  Their number isn't bounded: beyond `loci_each` the
    background is dealt to stretches, and lengths to stretches by their bases."""
    units, *shape = _units(loci, background, genome, simulations, None, loci_each)
    held = loci.sparkSession.sparkContext.broadcast(shape)  # a number for each length and each stretch

    def run(parts):
        for b in parts:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                placer = _Placer(col["stretch"][i].as_py(), col["pieces"][i], *held.value, seed, retries)
                for sim in range(col["first"][i].as_py(), col["last"][i].as_py()):
                    chrom, start, stop = placer.draw(sim)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), sim)), pa.array(placer.names[chrom], pa.string()), pa.array(start), pa.array(stop)], ["sim", "chrom", "start", "stop"])

    return units.mapInArrow(run, "sim long, chrom string, start long, stop long")


class _Index:
    """The ranges of sets by set, sorted, over the chromosomes of a stretch."""

    def __init__(self, ranges: pa.ListScalar, names: np.ndarray):
        r = _numbers(ranges)
        self.sets: list[tuple] = []
        self.blocks: list = []
        held = 0
        if not r:
            return
        places = {c: i for i, c in enumerate(names)}
        chrom = np.array([places.get(c, -1) for c in r["chrom"]], np.int64)
        code, which = np.unique(np.array(r["set"], object), return_inverse=True)
        for k, name in enumerate(code.tolist()):
            own = (which == k) & (chrom >= 0)
            far = chrom[own] << _APART
            begin, end = far + np.maximum(r["start"][own], 0), far + np.maximum(r["stop"][own], 0)
            self.sets.append((name, np.sort(begin), np.sort(end)))
            by = np.argsort(end)
            least = np.minimum.accumulate(begin[by][::-1])[::-1]  # of the ranges that stop here or later
            if not self.blocks or (len(self.blocks[-1]) + 1) * (held := held + len(by)) > _CELLS:
                self.blocks.append([])
                held = len(by)
            self.blocks[-1].append((name, end[by], np.append(least, _NONE)))
        for k, block in enumerate(self.blocks):
            stops = np.unique(np.concatenate([e for _, e, _ in block]))
            self.blocks[k] = stops, [(name, least[np.searchsorted(e, np.append(stops, _NONE), "left")]) for name, e, least in block]

    def counts(self, chrom: np.ndarray, start: np.ndarray, stop: np.ndarray, pairs: bool):
        """(set, metric): ranges, in order, that meet the set, or pairs of ranges that meet.

        A range meets a set if, of the set's ranges that stop beyond its start, one starts before
        its stop; the place among all stops is looked up once for a block of sets."""
        begin, end = (chrom << _APART) + start, (chrom << _APART) + stop
        if pairs:
            for name, starts, stops in self.sets:
                yield name, int((np.searchsorted(starts, end, "left") - np.searchsorted(stops, begin, "right")).sum())
            return
        for stops, block in self.blocks:
            k = np.searchsorted(stops, begin, "right")
            for name, least in block:
                yield name, int(np.count_nonzero(least[k] < end))


def simulated_counts(loci: DataFrame, sets: DataFrame, background: DataFrame, genome: DataFrame, set_col: str, simulations: int, metric: str = "overlap", seed: int = 1, retries: int = 1000, loci_each: int = LOCI) -> DataFrame:
    """(set, metric, n): in how many simulations a set has a metric, zeros left out.

    A task places the ranges of a simulation and counts them at once against the sorted ranges of
    its sets, so neither places nor pairs are shuffled: only counts are, of one stretch already
    as histograms.
    """
    held_sets = sets.where(F.col(set_col).isNotNull()).select(F.col(set_col).alias("set"), "chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    units, *shape = _units(loci, background, genome, simulations, held_sets, loci_each)
    held = loci.sparkSession.sparkContext.broadcast(shape)  # a number for each length and each stretch
    alone = len(shape[-1]) == 1

    def run(parts):
        for b in parts:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            kind = col["ranges"].type.value_type.field(0).type
            for i in range(b.num_rows):
                placer = _Placer(col["stretch"][i].as_py(), col["pieces"][i], *held.value, seed, retries)
                index = _Index(col["ranges"][i], placer.names)
                seen: Counter = Counter()
                for sim in range(col["first"][i].as_py(), col["last"][i].as_py()):
                    for name, m in index.counts(*placer.draw(sim), metric != "overlap"):
                        if m:
                            seen[name, None if alone else sim, m] += 1
                name, sim, m = zip(*seen) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(name, kind), pa.array(sim, pa.int64()), pa.array(m, pa.int64()), pa.array(list(seen.values()), pa.int64())], ["set", "sim", "metric", "n"])

    made = units.mapInArrow(run, f"set {sets.schema[set_col].dataType.simpleString()}, sim long, metric long, n long")
    if alone:
        return made.groupBy("set", "metric").agg(F.sum("n").alias("n"))
    whole = made.groupBy("set", "sim").agg(F.sum("metric").alias("metric"))
    return whole.groupBy("set", "metric").agg(F.count("*").alias("n"))


def overlap_counts(ranges: DataFrame, sets: DataFrame, set_col: str, by: str, metric: str = "overlap") -> DataFrame:
    """(by, set, metric) for groups and sets that meet: how many ranges of the group meet a range
    of the set ("overlap"; equal ranges count once), or how many pairs meet ("intersection_number")."""
    if metric not in ("overlap", "intersection_number"):
        raise ValueError(f"unsupported metric {metric!r}")
    pairs = range_join(ranges.select(by, "chrom", "start", "stop"), sets.select(set_col, "chrom", "start", "stop"), ("chrom",))
    met = pairs.select(by, "chrom", "start", "stop", F.col(f"b_{set_col}").alias(set_col))
    return (met.distinct() if metric == "overlap" else met).groupBy(by, set_col).agg(F.count("*").alias("metric"))


def permutation_test(loci: DataFrame, sets: DataFrame, background: DataFrame, genome: DataFrame, set_col: str = "name", simulations: int = 100, alternative: str = "two_sided", seed: int = 1, metric: str = "overlap") -> DataFrame:
    """One row for each set: observed metric, median, mean and variance of the simulated ones,
    p-value (not capped when two-sided) and q-value, sorted by p-value."""
    from ..functions.hypothesis_tests import benjamini_hochberg

    if simulations < 1:
        raise ValueError("at least one simulation is needed")
    if metric not in ("overlap", "intersection_number"):
        raise ValueError(f"unsupported metric {metric!r}")
    names = sets.where(F.col(set_col).isNotNull()).select(F.col(set_col).alias("set")).distinct()
    seen = overlap_counts(loci.select(F.lit(0).alias("g"), "chrom", "start", "stop"), sets, set_col, "g", metric).select(F.col(set_col).alias("set"), F.col("metric").alias("seen"))
    drawn = simulated_counts(loci, sets, background, genome, set_col, simulations, metric, seed)
    # a set's simulations without a row have a metric of 0
    none = names.join(drawn.groupBy("set").agg(F.sum("n").alias("n")), "set", "left").select("set", F.lit(0).cast("long").alias("metric"), (F.lit(simulations) - F.coalesce("n", F.lit(0))).cast("long").alias("n"))
    full = staged(drawn.unionAll(none.where("n > 0")), "simulated").join(names.join(seen, "set", "left").select("set", F.coalesce("seen", F.lit(0)).alias("seen")), "set")
    upto = F.sum("n").over(W.partitionBy("set").orderBy("metric").rowsBetween(W.unboundedPreceding, 0))  # a row for each simulation of a set at most
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("metric")))
    mean = F.sum(F.col("metric") * F.col("n")) / simulations
    stats = full.withColumn("upto", upto).groupBy("set", "seen").agg(
        F.sum(F.when(F.col("metric") >= F.col("seen"), F.col("n")).otherwise(0)).alias("above"), F.sum(F.when(F.col("metric") <= F.col("seen"), F.col("n")).otherwise(0)).alias("below"),
        ((at((simulations - 1) // 2) + at(simulations // 2)) / 2).alias("median"), mean.alias("mean"),
        F.sum(F.col("n") * F.col("metric") * F.col("metric")).alias("squares"),
    )
    spread = F.lit(None).cast("double") if simulations == 1 else (F.col("squares") - simulations * F.col("mean") * F.col("mean")) / (simulations - 1)
    above, below = (F.col("above") + 1) / (simulations + 1), (F.col("below") + 1) / (simulations + 1)
    p = {"two_sided": 2 * F.least(above, below), "greater": above, "less": below}[alternative]
    rows = stats.select(F.col("set").alias(set_col), "seen", F.lit(simulations).cast("long").alias("simulations"), "above", "below", "median", "mean", F.greatest(spread, F.lit(0.0)).alias("variance"), p.alias("p"))
    one_each = staged(rows, "enrichment")  # a row for each set; ranking reads it several times
    return benjamini_hochberg(one_each, "p", set_col, "q").orderBy("p", set_col)


def sample_locations(spark: SparkSession, genome: DataFrame, n: int, length: int, seed: int = 1, gaps: DataFrame | None = None) -> DataFrame:
    """(id, chrom, start, stop, strand): n ranges of one length, uniform over the genome.

    With `gaps` (chrom, start, stop: unknown bases) none meets a gap: starts are drawn from the
    places where a range fits, which has the distribution of drawing until it does.  A draw
    follows from the seed and the id; it meets its range by a range join over running sums of
    the ranges' sizes, so neither ranges nor draws pass through the driver.
    """
    room = genome.where(F.col("length") >= length).select("chrom", (F.col("length") - length + 1).cast("long").alias("length"))
    fits = room.select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"))
    if gaps is not None:  # a range that starts less than its length before a gap meets it
        taken = gaps.where("start < stop").select("chrom", F.greatest(F.col("start") - (length - 1), F.lit(0).cast("long")).alias("start"), "stop")
        fits = complement(merged(taken, ("chrom",)), room, ("chrom",))
    order = [F.col("chrom"), F.col("start")]
    tiled = ranges(fits.withColumn("size", F.col("stop") - F.col("start")), order, int(spark.conf.get("spark.sql.shuffle.partitions")))
    summed = prefix(tiled, [], "__tile", order, F.col("size"), "low", "sum")
    total = tiled.agg(F.sum("size")).first()[0]
    if not total:
        raise ValueError("no chromosome is long enough, or gaps leave no room")
    one = F.lit(0).alias("g")
    places = summed.select(one, F.col("low").cast("long").alias("start"), (F.col("low") + F.col("size")).cast("long").alias("stop"), "chrom", F.col("start").alias("first"))
    at = F.floor(uniform(seed, F.col("id")) * F.lit(total)).cast("long")
    draws = spark.range(n).select(one, "id", at.alias("start"), (at + 1).alias("stop"), F.when(uniform(seed + 1, F.col("id")) < 0.5, "-").otherwise("+").alias("strand"))
    start = F.col("b_first") + F.col("start") - F.col("b_start")
    return range_join(draws, places, ("g",)).select("id", F.col("b_chrom").alias("chrom"), start.alias("start"), (start + length).alias("stop"), "strand")


def randomized(loci: DataFrame, genome: DataFrame, gaps: DataFrame | None = None, seed: int = 1, attempts: int = 1000) -> DataFrame:
    """(id, chrom, start, stop, strand): for each locus (unique `id`) one of its length at random on
    its chromosome; they may overlap.  One that meets a gap is drawn again, all of a round at
    once; more than `attempts` rounds, or a locus longer than its chromosome, are an error."""
    size = F.col("stop") - F.col("start")
    todo = loci.select("id", "chrom", size.alias("size")).join(genome.select("chrom", F.col("length").cast("long").alias("length")), "chrom")
    if not todo.where("size > length").isEmpty():
        raise ValueError("a locus is longer than its chromosome")
    done = None
    for k in range(attempts):
        start = F.floor(uniform(seed, F.col("id"), F.lit(k)) * (F.col("length") - F.col("size") + 1)).cast("long")
        drawn = todo.withColumn("start", start).withColumn("stop", F.col("start") + F.col("size"))
        if gaps is not None:
            drawn = staged(drawn, "drawn")
            met = staged(range_join(drawn.select("chrom", "start", "stop", "id"), gaps.where("start < stop").select("chrom", "start", "stop"), ("chrom",)).select("id").distinct(), "met")
            todo = drawn.join(met, "id", "left_semi").drop("start", "stop")
            drawn = drawn.join(met, "id", "left_anti")
        strand = F.when(uniform(seed + 1, F.col("id")) < 0.5, "-").otherwise("+")
        good = drawn.select("id", "chrom", "start", "stop", strand.alias("strand"))
        done = good if done is None else done.unionAll(good)
        if gaps is None or met.isEmpty():
            return done
    raise RuntimeError("too many attempts to place ranges outside of gaps")


def overlap_per_locus(loci: DataFrame, sets: DataFrame, metric: str = "overlap", set_col: str | None = None) -> DataFrame:
    """Each locus (ids name one each) with the number of ranges it meets, or of their merged ranges that it meets
    ("intersection_number": touching and overlapping ones are one).

    With `set_col` there is a row for each locus and set; names of sets come to the driver;
    ranges without one are left out.
    """
    if metric not in ("overlap", "intersection_number"):
        raise ValueError(f"unsupported metric {metric!r}")
    by = [set_col] if set_col else []
    against = sets.select(*by, *KEY, "start", "stop") if metric == "overlap" else merged(sets, (*by, *KEY))
    rows = loci.select("id", *KEY, "start", "stop")
    if not set_col:
        return met_numbers(rows, against, {"metric": F.lit(True)}).select("id", "chrom", "start", "stop", "metric")
    kind, parts = sets.schema[set_col].dataType, []
    for batch in named_sets(sets, set_col):
        found = met_numbers(rows, against, {f"n{i}": F.col(set_col) == F.lit(n).cast(kind) for i, n in enumerate(batch)})
        each = F.array(*[F.struct(F.lit(n).cast(kind).alias("set"), F.col(f"n{i}").alias("metric")) for i, n in enumerate(batch)])
        parts.append(found.select("id", "chrom", "start", "stop", F.explode(each).alias("__e")).select("id", "chrom", "start", "stop", F.col("__e.set").alias(set_col), "__e.metric"))
    if not parts:
        return rows.where("false").select("id", "chrom", "start", "stop", F.lit(None).cast(kind).alias(set_col), F.lit(0).cast("long").alias("metric"))
    return reduce(DataFrame.unionAll, parts)


def allowed_background(background: DataFrame, masked: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Background ranges (id, chrom, start, stop) cut to allowed ones, without masked ones."""
    from .intervals import intersections, subtract

    out = background.select("id", "chrom", "start", "stop")
    if allowed is not None:
        cut = intersections(out, allowed.select("chrom", "start", "stop"), keys=("chrom",))
        out = cut.select(F.xxhash64("id", "i_start").alias("id"), "chrom", F.col("i_start").alias("start"), F.col("i_stop").alias("stop"))
    return out if masked is None else subtract(out, masked.select("chrom", "start", "stop"), "id", ("chrom",))
