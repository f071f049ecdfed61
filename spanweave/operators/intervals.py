"""Interval algebra over relations (chrom, strand, start, stop), half-open, by strand.

Joins of ranges deal both sides into bins of several sizes, so the plan is an equi-join at any
length of range; merging and gaps are prefix scans over tiles of positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged
from .prefix import looked_up, prefix, running

KEY = ("chrom", "strand")
#: Powers of two of the bin sizes; a range is dealt at the least size that it spans few of.
LEVELS = (10, 14, 18, 23)
SPAN = 4
#: Positions in a tile of the prefix scans.
TILE = 1 << 16


# ---- scalar operations ------------------------------------------------------------------


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (b1 > a0) & (a1 > b0)


def hull(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """The least range that holds both, the gap between them included."""
    return F.least(a0, b0), F.greatest(a1, b1)


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """0 if the ranges meet, else the shorter way from an end of one to the other."""
    return F.when(intersects(a0, a1, b0, b1), F.lit(0)).otherwise(F.least(F.abs(a0 - b1), F.abs(a1 - b0)))


def slices(df: DataFrame, width: int) -> DataFrame:
    """Bins of `width` positions of each range; the last may be shorter, an empty range has none."""
    held = df.where("start < stop").withColumn("bin_start", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(width).cast("long"))))
    return held.withColumn("bin_stop", F.least(F.col("bin_start") + width, F.col("stop")))


def _wide(flank: int) -> tuple[Column, Column]:
    if flank < 0:
        raise ValueError("a flank can't be negative")
    return (F.greatest(F.col("start") - flank, F.lit(0)), F.col("stop") + flank) if flank else (F.col("start"), F.col("stop"))


def flanked(df: DataFrame, flank: int) -> DataFrame:
    """Ranges widened on both sides, not below 0."""
    start, stop = _wide(flank)
    return df.withColumns({"start": start, "stop": stop})


# ---- range join -------------------------------------------------------------------------


def _own_level(mark: str = "") -> Column:
    own = F.lit(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        own = F.when(F.shiftright(F.col(f"{mark}stop") - F.col(f"{mark}start"), level) < SPAN, level).otherwise(own)
    return own


def levels_of(*frames: DataFrame) -> list[set[int]]:
    """The bin sizes that ranges of each frame are dealt at, by one job: a number for each frame."""
    mask = lambda i, df: df.select(_own_level().alias("l")).agg(F.lit(i).alias("i"), F.bit_or(F.expr("shiftleft(1, l)")).alias("m"))
    parts = [mask(i, df) for i, df in enumerate(frames)]
    held = dict(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect())
    return [{level for level in LEVELS if (held[i] or 0) >> level & 1} for i in range(len(frames))]


#: A bin is one number: its level above this bit, its place below.
_PLACE = 44


def _dealt(df: DataFrame, mark: str, own_levels: set[int], others: set[int]) -> DataFrame:
    """One row (bin, own) for each bin of each range, at its own level and the coarser ones in
    `others`."""
    start, stop = F.col(f"{mark}start"), F.col(f"{mark}stop")
    own, last = _own_level(mark), F.greatest(start, stop - 1)

    def at(level: int) -> Column:
        code = F.lit(level << _PLACE)
        bins = F.sequence(F.shiftright(start, level) + code, F.shiftright(last, level) + code)
        used = own <= level if level in others else own == level
        return bins if len(levels) == 1 else F.when(used, bins).otherwise(F.array().cast("array<bigint>"))

    levels = sorted(own_levels | others) or [LEVELS[0]]
    bins = F.concat(*map(at, levels)) if len(levels) > 1 else at(levels[0])
    return df.select("*", F.explode(bins).alias("bin")).withColumn("own", F.shiftright("bin", _PLACE) == own)


def range_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY, how: str = "overlap") -> DataFrame:
    """Pairs of ranges that meet ("overlap") or where b holds a ("within").

    Columns of a keep their names, those of b get the prefix b_; both have start and stop.  A
    pair is made once: at the larger of the two ranges' bin sizes, in the bin where the later
    start lies.  Ranges go only to coarser sizes that the other side has.  Two ranges that are
    both dealt to a coarser size than their own never meet there: a's own bins meet all bins of
    b, and a's coarser ones meet b's own ones only.
    """
    la, lb = levels_of(a, b)
    left = _dealt(a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys]), "a_", la, lb)
    right = _dealt(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys]), "b_", lb, la)
    on = [*keys, "bin"]
    if any(x < y for x in la for y in lb):
        left = left.withColumn("coarser", ~F.col("own"))
        right = right.withColumn("coarser", F.explode(F.when(F.col("own"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        on.append("coarser")
    joined = left.drop("own").join(right.drop("own"), on)
    met = F.expr(f"shiftright(greatest(a_start, b_start), cast(shiftright(bin, {_PLACE}) as int)) = (bin & {(1 << _PLACE) - 1})")
    if how == "overlap":
        met = met & (F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop"))
    else:
        met = met & (F.col("b_start") <= F.col("a_start")) & (F.col("a_stop") <= F.col("b_stop"))
    return joined.where(met).select(*[F.col(c) if c in keys else F.col(f"a_{c}").alias(c) for c in a.columns], *[f"b_{c}" for c in b.columns if c not in keys])


def _numbered(a: DataFrame) -> DataFrame:
    """Rows with equal columns as one with their number, so that a join can be undone by group."""
    return a.groupBy(*a.columns).agg(F.count("*").alias("__n"))


def _named(a: DataFrame) -> DataFrame:
    """Rows with a 128-bit name of their values, so that repeated rows share one."""
    cols = [F.col(c) for c in a.columns]
    return a.withColumns({"__h1": F.xxhash64(*cols), "__h2": F.xxhash64(F.lit(1), *cols)})


def _hit(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those rows, as often as they are given, whose name is in pairs."""
    return named.join(pairs.select("__h1", "__h2").distinct(), ["__h1", "__h2"], "left_semi").drop("__h1", "__h2")


def overlapping(a: DataFrame, b: DataFrame, flank: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of a that meet a range of b, each once and as it is; a is widened by the flank.

    A range meets one of b if, of those that start before its stop, one reaches beyond its start:
    a scan of both sides, without pairs, so ranges that meet very many cost no more than others.
    """
    start, stop = _wide(flank)
    reach = b.select(*keys, F.col("start").alias("__place"), F.col("stop").cast("long").alias("__reach"))
    found = looked_up(a.withColumns({"__start": start, "__stop": stop}), F.col("__stop"), reach, "__place", ["__reach"], keys)
    return found.where(F.col("__reach") > F.col("__start")).select(*a.columns)


def intersections(a: DataFrame, b: DataFrame, flank: int = 0, keys: Sequence[str] = KEY) -> DataFrame:
    """Each pair's common range, clipped to the widened a; empty ones are none."""
    pairs = range_join(flanked(a, flank), b, keys)
    out = pairs.withColumns({"i_start": F.greatest("start", "b_start"), "i_stop": F.least("stop", "b_stop")})
    return out.where("i_start < i_stop")


def within(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of a that lie in a range of b."""
    named = _named(a)
    pairs = range_join(named.select(*keys, "start", "stop", "__h1", "__h2"), b.select(*keys, "start", "stop"), keys, "within")
    return _hit(named, pairs).select(*a.columns)


# ---- merging ----------------------------------------------------------------------------


def _tiled(df: DataFrame, tile: int = TILE) -> DataFrame:
    return df.withColumn("__tile", F.expr(f"start div {tile}"))


def merged(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Disjoint ranges: overlapping and touching ones become one.

    One pass over tiles of positions.  A tile knows, from a row for each tile, how far the ranges
    before it reach and where the next one begins; a range begins a merged one if it starts
    beyond that reach, and ends one if the next starts beyond it.  Only begins and ends are
    kept, staged, and those of one merged range in two tiles, at most two for each tile, paired.
    """
    rows = _tiled(df.select(*keys, "start", "stop"))
    tiles = rows.groupBy(*keys, "__tile").agg(F.max("stop").alias("top"), F.min("start").alias("low"))
    along = W.partitionBy(*keys).orderBy("__tile")  # a row for each tile
    carried = tiles.select(*keys, "__tile", F.max("top").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("__before"), F.lead("low").over(along).alias("__next"))
    inside = W.partitionBy(*keys, "__tile").orderBy("start", "stop")
    reach = F.greatest("__before", F.max("stop").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    after = F.coalesce(F.lead("start").over(inside), F.col("__next"))
    marked = rows.join(carried, [*keys, "__tile"]).select(*keys, "__tile", "start", "stop", reach.alias("__reach"), after.alias("__after"))
    upto = F.greatest("__reach", "stop")
    begins, ends = F.col("__reach").isNull() | (F.col("start") > F.col("__reach")), F.col("__after").isNull() | (F.col("__after") > upto)
    kept = marked.select(*keys, "__tile", "start", "stop", upto.alias("__upto"), begins.alias("__begins"), ends.alias("__ends")).where("__begins OR __ends")
    # in a tile begins and ends take turns, so a begin's end is the next row
    stop = F.when(F.col("__begins") & ~F.col("__ends"), F.lead("__upto").over(inside)).otherwise(F.col("__upto"))
    alone = F.col("__begins") | F.lag("__begins").over(inside).isNull()
    out = kept.select(*keys, "__tile", F.when(F.col("__begins"), F.col("start")).alias("start"), stop.alias("stop"), alone.alias("__alone")).where("__alone")
    held = staged(out.drop("__alone"), "merged")
    loose = held.where("start IS NULL OR stop IS NULL")
    closed = loose.withColumn("stop", F.lead("stop").over(W.partitionBy(*keys).orderBy("__tile", F.col("start").asc_nulls_first()))).where("start IS NOT NULL")
    return held.where("start IS NOT NULL AND stop IS NOT NULL").unionAll(closed).drop("__tile")


def merged_where(df: DataFrame, predicate: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Ranges for which the predicate holds, merged again."""
    return merged(df.where(predicate), keys)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    cols = [*keys, "start", "stop"]
    return merged(a.select(*cols).unionAll(b.select(*cols)), keys)


def complement(merged_ranges: DataFrame, universe: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Gaps of disjoint ranges in [0, length) of each row (keys, length) of `universe`; a key
    without ranges is one gap.  Ranges are clipped to the universe."""
    cut = merged_ranges.join(universe, list(keys)).select(*keys, "length", F.greatest("start", F.lit(0).cast("long")).alias("start"), F.least("stop", F.col("length").cast("long")).alias("stop")).where("start < stop")
    ends = universe.select(*keys, "length", F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("stop"))
    rows = _tiled(cut.unionAll(ends))
    gap = prefix(rows, keys, "__tile", [F.col("start"), F.col("stop")], F.col("stop"), "__reach", "max")
    return gap.select(*keys, F.coalesce("__reach", F.lit(0)).cast("long").alias("gap_start"), F.col("start").alias("gap_stop")).where("gap_start < gap_stop").select(*keys, F.col("gap_start").alias("start"), F.col("gap_stop").alias("stop"))


def subtract(a: DataFrame, b: DataFrame, id_col: str, keys: Sequence[str] = KEY) -> DataFrame:
    """What is left of each range of a (unique `id_col`) without the ranges of b: its common parts
    with the gaps of b, a row for each, so a range with very many holes is no row or task of its own."""
    cut = a.select(id_col, *keys, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    reach = cut.groupBy(*keys).agg(F.max("stop").alias("length"))
    left = intersections(cut, complement(merged(b, keys), reach, keys), keys=keys)
    return left.select(id_col, *keys, F.col("i_start").alias("start"), F.col("i_stop").alias("stop"))


def runs(df: DataFrame, keys: Sequence[str], pos: str = "pos", gap: int = 0) -> DataFrame:
    """Ranges of positions, joined over holes of at most `gap` positions (0: none)."""
    rows = df.select(*keys, F.col(pos).alias("start")).distinct().withColumn("stop", F.col("start") + 1)
    joined = merged(rows.withColumn("stop", F.col("stop") + gap), keys)
    return joined.withColumn("stop", F.col("stop") - gap)


# ---- metrics ----------------------------------------------------------------------------


def length(df: DataFrame) -> Column:
    return F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).cast("long")


def overlap_number(a: DataFrame, b: DataFrame, flank: int = 0) -> DataFrame:
    return overlapping(a, b, flank).agg(F.count("*").alias("overlap"))


def intersection_number(a: DataFrame, b: DataFrame, flank: int = 0) -> DataFrame:
    return intersections(a, b, flank).agg(F.count("*").alias("intersection_number"))


def overlap_fraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of ranges of a that meet b; NaN if a is empty."""
    n = a.agg(F.count("*").alias("n"))
    return overlap_number(a, b).crossJoin(n).select(F.when(F.col("n") == 0, float("nan")).otherwise(F.try_divide("overlap", "n")).alias("overlap_fraction"))  # two single rows


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common positions of merged a and b over all their positions."""
    a, b = merged(a), merged(b)  # staged, as each is read for its size and for the join
    sizes = [a.agg(length(a).alias("la")), b.agg(length(b).alias("lb")), intersections(a, b).agg(F.coalesce(F.sum(F.col("i_stop") - F.col("i_start")), F.lit(0)).alias("lab"))]
    one = sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])  # three single rows
    return one.select(F.try_divide(F.col("lab").cast("double"), F.col("la") + F.col("lb") - F.col("lab")).alias("jaccard"))


METRICS = {"overlap": overlap_number, "intersection_number": intersection_number, "jaccard": jaccard, "overlap_fraction": overlap_fraction}


def metric(name: str):
    """The metric of two sets of ranges by its name."""
    if name not in METRICS:
        raise ValueError(f"unsupported metric {name!r}; names are {sorted(METRICS)}")
    return METRICS[name]


def additive(a: DataFrame, b: DataFrame, value: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, metric): sums of `value`, a column of pairs of ranges that meet (start, stop, b_start,
    b_stop, and their common i_start, i_stop).  Sums over the rows are the metric of the whole."""
    return intersections(a.select(*keys, "start", "stop"), b.select(*keys, "start", "stop"), keys=keys).groupBy(*keys).agg(F.sum(value).alias("metric"))


def common_length(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, metric): additive() of the common length of pairs, without the pairs.

    The length is the integral of how many ranges of a, times how many of b, hold a position.  With
    steps da and db of these numbers at the places x, whose sums are 0, it is the sum of
    -x (da (B + db) + db A), A and B being the numbers before x; so a row for each place will do.
    """
    steps = lambda df, da, db: df.where("start < stop").select(*keys, F.explode(F.array(*[F.struct(F.col(c).cast("long").alias("at"), F.lit(n * da).cast("long").alias("da"), F.lit(n * db).cast("long").alias("db")) for c, n in (("start", 1), ("stop", -1))])).alias("e")).select(*keys, "e.*")
    places = steps(a, 1, 0).unionAll(steps(b, 0, 1)).dropna(subset=list(keys)).groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db")).where("da <> 0 OR db <> 0")
    held = running(places.select("*", F.expr(f"at div {TILE}L").alias("__tile"), F.col("da").alias("own_a"), F.col("db").alias("own_b")), keys, [F.col("at")], ["da", "db"], "sum")
    part = -F.col("at") * (F.col("own_a") * (F.col("db") + F.col("own_b")) + F.col("own_b") * F.col("da"))
    return held.groupBy(*keys).agg(F.sum(part.cast("decimal(38,0)")).cast("long").alias("metric")).where("metric > 0")


#: Sets that one scan looks up, a column or two for each.
_SETS = 32


def named_sets(df: DataFrame, name: str) -> list[list]:
    """Names of sets, in order and without a null, in batches."""
    names = sorted(r[0] for r in df.select(name).dropna().distinct().collect())
    return [names[i : i + _SETS] for i in range(0, len(names), _SETS)]


def metric_matrix(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Overlap numbers of each set in a with each set in b as long rows (a_name, b_name, value),
    zeros included; names are columns.  Names of b's sets come to the driver; ranges are looked up
    as in overlapping(), all sets of a batch by one scan."""
    kind = b.schema[b_name].dataType
    asks = a.select(F.col(a_name).alias("__name"), *KEY, F.col("start").alias("__start"), F.col("stop").alias("__stop"))
    parts = []
    for batch in named_sets(b, b_name):
        cols = [f"r{i}" for i in range(len(batch))]
        reach = b.select(*KEY, F.col("start").alias("__place"), *[F.when(F.col(b_name) == F.lit(n).cast(kind), F.col("stop").cast("long")).alias(c) for n, c in zip(batch, cols)])
        found = looked_up(asks, F.col("__stop"), reach, "__place", cols, KEY)
        sums = found.groupBy("__name").agg(*[F.count_if(F.col(c) > F.col("__start")).alias(c) for c in cols])
        each = F.explode(F.array(*[F.struct(F.lit(n).cast(kind).alias("b"), F.col(c).alias("value")) for n, c in zip(batch, cols)])).alias("e")
        parts.append(sums.select(F.col("__name").alias(a_name), each).select(a_name, F.col("e.b").alias(f"b_{b_name}"), "e.value"))
    names = a.select(a_name).distinct().crossJoin(b.select(F.col(b_name).alias(f"b_{b_name}")).distinct())  # names of sets only
    value = F.lit(0)
    if parts:
        names, value = names.join(reduce(DataFrame.unionAll, parts), [a_name, f"b_{b_name}"], "left"), F.coalesce("value", F.lit(0))
    return names.select(a_name, F.col(f"b_{b_name}").alias(b_name), value.cast("long").alias("value"))


def met_numbers(a: DataFrame, b: DataFrame, sets: dict[str, Column], keys: Sequence[str] = KEY) -> DataFrame:
    """Rows of a, each as it is, with a column for each of `sets`: how many ranges of b that meet it
    its condition holds for.

    They are the ranges that start before its stop less those that stop at its start or before: two
    scans without pairs.  That holds where ranges of b aren't empty and those of a don't stop before
    they start; if there are others, theirs are paired.
    """
    proper = b.where("start < stop")

    def ends(c: str) -> DataFrame:
        held = proper.select(*keys, F.col(c).alias("__place"), *[s.alias(f"__{n}") for n, s in sets.items()])
        return held.groupBy(*keys, "__place").agg(*[F.count_if(f"__{n}").alias(f"{c}_{n}") for n in sets])

    odd_a, odd_b = a.where("start > stop"), b.where("start >= stop")
    odd = not (odd_b.isEmpty() and odd_a.isEmpty())
    asks = staged(a.withColumn("__row", F.monotonically_increasing_id()), "odd") if odd else a
    found = looked_up(asks, F.col("stop"), ends("start"), "__place", [f"start_{n}" for n in sets], keys, "sum")
    found = looked_up(found, F.col("start"), ends("stop"), "__place", [f"stop_{n}" for n in sets], keys, "sum", True, tiled=asks)
    fair = (F.col("start") <= F.col("stop")) & F.forall(F.array(*keys), lambda k: k.isNotNull())
    found = found.select(*asks.columns, *[F.when(fair, F.col(f"start_{n}") - F.col(f"stop_{n}")).otherwise(0).cast("long").alias(n) for n in sets])
    if odd:
        place = ["__row", *keys, "start", "stop"]
        held = [df.select(*keys, "start", "stop", *[F.coalesce(s, F.lit(False)).alias(n) for n, s in sets.items()]) for df in (odd_b, proper)]
        pairs = range_join(asks.select(*place), held[0], keys).unionAll(range_join(asks.where("start > stop").select(*place), held[1], keys))
        more = pairs.groupBy("__row").agg(*[F.count_if(f"b_{n}").alias(f"more_{n}") for n in sets])
        found = found.join(more, "__row", "left").select(*a.columns, *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in sets])
    return found


def merged_counts(df: DataFrame, name: str) -> DataFrame:
    """(name, merged): how many ranges each set has once they are merged."""
    return merged(df, (name, *KEY)).groupBy(name).agg(F.count("*").alias("merged"))


# ---- sets of positions ------------------------------------------------------------------


def bits_joined(a: DataFrame, size: int, b: DataFrame, pos: str = "pos") -> DataFrame:
    """The set positions of two bit lists one after the other; the first has `size` bits."""
    return a.select(pos).unionAll(b.select((F.col(pos) + size).alias(pos)))


def bits_set(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Each set position once; one outside of [0, size) is an error."""
    inside = (F.col(pos) >= 0) & (F.col(pos) < size)
    checked = F.when(inside, F.col(pos)).otherwise(F.raise_error(F.concat(F.lit("no such bit: "), F.col(pos).cast("string"))))
    return df.select(checked.cast(df.schema[pos].dataType).alias(pos)).distinct()


# ---- strand-aware positions -------------------------------------------------------------


def bound5(offset: int | Column = 0) -> Column:
    """The position `offset` from the 5' end."""
    return F.when(F.col("strand") == "+", F.col("start") + offset).otherwise(F.col("stop") - 1 - offset)


def bound3(offset: int | Column = 0) -> Column:
    return F.when(F.col("strand") == "+", F.col("stop") - 1 + offset).otherwise(F.col("start") - offset)


def relative(df: DataFrame, anchor: str, left: int, right: int, chrom_length: str = "length") -> DataFrame:
    """Windows [left, right) around the 5' end ("five"), the 3' end ("three"), or from the one to
    the other ("all"), along the strand and inside the chromosome."""
    if anchor == "all" and left == right == 0:
        return df.withColumns({"w_start": F.col("start"), "w_stop": F.col("stop")})
    plus = F.col("strand") == "+"
    first = bound3() if anchor == "three" else bound5()
    last = bound5() if anchor == "five" else bound3()
    low = F.when(plus, first + left).otherwise(last - right + 1)
    high = F.when(plus, last + right).otherwise(first - left + 1)
    clip = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, F.col(chrom_length).cast("long")))
    return df.withColumns({"w_start": clip(low), "w_stop": clip(high)})
