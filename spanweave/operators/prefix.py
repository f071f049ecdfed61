"""Prefix scans over ordered rows that don't put a whole key, or table, into one task.

A window without partitions, or over a chromosome, is a single task at any size.  Here rows
are dealt into tiles that follow the order; a window runs inside each tile, tiles are reduced
to one row each, and a second window over those few rows carries totals from tile to tile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import staged

_REDUCE = {"max": F.max, "min": F.min, "sum": F.sum}


def _merge(how: str, carried: Column, own: Column) -> Column:
    if how == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(own, F.lit(0))
    return (F.greatest if how == "max" else F.least)(carried, own)  # both skip nulls


def prefix(df: DataFrame, keys: Sequence[str], tile: str, order: Sequence[Column], value: Column, out: str, how: str = "max", inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """Add `out`: max, min or sum of `value` over the rows of the key that come before.

    `tile` is a column that doesn't fall along the order (or doesn't rise, with reverse=True);
    rows of different tiles are never tied in the order.  Before the first row the value is
    null for max and min, 0 for sum.
    """
    if reverse and "tile_down" not in df.columns:
        tile_order = F.col(tile).desc()
    else:
        tile_order = F.col(tile).asc()
    inside = W.partitionBy(*keys, tile).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    over = W.partitionBy(*keys).orderBy(tile_order).rowsBetween(W.unboundedPreceding, -1)
    name = f"{out}__carried"
    per_tile = df.groupBy(*keys, tile).agg(_REDUCE[how](value).alias("__v"))
    if not keys:
        over = W.orderBy(tile_order).rowsBetween(W.unboundedPreceding, -1)  # one row for each tile
    carried = per_tile.select(*keys, tile, _REDUCE[how]("__v").over(over).alias(name))
    joined = df.join(carried, [*keys, tile])
    return joined.withColumn(out, _merge(how, F.col(name), _REDUCE[how](value).over(inside))).drop(name)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], how: str, tiled: DataFrame | None = None) -> DataFrame:
    """Rows with each of `values` replaced by its max or sum over the rows of the keys before, in
    the order of `__tile` and then `order`; one window over tiles.

    A row for each tile is broadcast, which carries totals from tile to tile; these are taken from
    `tiled`, rows with the same keys, tiles and values that cost less to compute.
    """
    tiles = (rows if tiled is None else tiled).groupBy(*keys, "__tile").agg(*[_REDUCE[how](v).alias(v) for v in values])
    along = W.partitionBy(*keys).orderBy("__tile").rowsBetween(W.unboundedPreceding, -1)  # a row for each tile
    carried = tiles.select(*[F.col(k).alias(f"{k}__c") for k in keys], F.col("__tile").alias("__tile__c"), *[_REDUCE[how](v).over(along).alias(f"{v}__c") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"{k}__c")) for k in (*keys, "__tile")]
    inside = W.partitionBy(*keys, "__tile").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumns({f"{v}__i": _REDUCE[how](v).over(inside) for v in values}).drop(*values)
    return found.join(F.broadcast(carried), same, "left").select(*[c for c in rows.columns if c not in values], *[_merge(how, F.col(f"{v}__c"), F.col(f"{v}__i")).alias(v) for v in values])


def looked_up(asks: DataFrame, at: Column, events: DataFrame, place: str, values: Sequence[str], keys: Sequence[str], how: str = "max", inclusive: bool = False, width: int = 1 << 16, tiled: DataFrame | None = None) -> DataFrame:
    """Rows of `asks`, each as it is, with the max or sum of each of the columns `values` over the
    events of its keys whose `place` lies before `at` (or there, if inclusive).

    Without an event before it, a row has nulls for max and 0 for sum; so have rows with a null
    place.  These are dealt over many tiles.  `tiled` are rows with the same keys and places as
    asks that cost less to compute.
    """
    tile, by = F.expr(f"__at div {width}L"), [f"__{k}" for k in keys]
    named = [F.col(k).alias(f"__{k}") for k in keys]
    empty = [F.lit(None).cast(events.schema[v].dataType).alias(f"__{v}") for v in values]
    nowhere = lambda df: -1 - F.pmod(F.xxhash64(*[c for c in ("id", "start", "stop") if c in df.columns], *keys), F.lit(1024))
    held = events.dropna(subset=[*keys, place]).withColumn("__at", F.col(place).cast("long"))
    there = lambda *more: held.select(*named, *more, "__at", tile.alias("__tile"), *[F.col(v).alias(f"__{v}") for v in values])
    asked = lambda df, *more: df.withColumn("__at", at.cast("long")).select(*named, *more, "__at", F.coalesce(tile, nowhere(df)).alias("__tile"), *empty)
    rows = asked(asks, *asks.columns, F.lit(True).alias("__asks")).unionAll(there(*[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in asks.columns], F.lit(False).alias("__asks")))
    order = [F.col("__at").asc(), F.col("__asks").asc() if inclusive else F.col("__asks").desc()]
    found = running(rows, by, order, [f"__{v}" for v in values], how, asked(asks if tiled is None else tiled).unionAll(there())).where("__asks")
    none = F.lit(0 if how == "sum" else None)
    return found.select(*asks.columns, *[F.when(F.col("__at").isNotNull(), F.col(f"__{v}")).otherwise(none).alias(v) for v in values])


def ranges(df: DataFrame, order: Sequence[Column], tiles: int, out: str = "__tile") -> DataFrame:
    """Add tile numbers that rise along `order`, with about equally many rows each.

    Tiles are ranges of the whole order, ties included, so a value that most rows have is split.
    The rows are staged by tile: their ranges come from a sample, and all later passes must see
    the same ones.
    """
    dealt = df.repartitionByRange(tiles, *order)
    return staged(dealt.withColumn(out, F.spark_partition_id().cast("long")), "ranges")


def row_number(df: DataFrame, by: str, ties: Sequence[Column], out: str = "_row", tiles: int | None = None, descending: bool = False) -> DataFrame:
    """Add 0-based row numbers in the order of a column and then `ties`."""
    tiles = tiles or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(by).desc() if descending else F.col(by).asc(), *ties]
    held = ranges(df, order, tiles, "__tile")
    return prefix(held, [], "__tile", order, F.lit(1).cast("long"), out, "sum").withColumn(out, F.col(out).cast("long")).drop("__tile")
