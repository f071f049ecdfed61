"""Accessors of track tables (data_type, cell, replicate, path, meta) and key/value reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of data that are told apart; every other name is a ChIP-seq target.
KINDS = ("methylation", "transcription", "mirna")


def kind_of(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin(*KINDS), low).otherwise("chip-seq")


def cells(tracks: DataFrame) -> DataFrame:
    return tracks.select("cell").distinct()


def data_types(tracks: DataFrame) -> DataFrame:
    return tracks.select("data_type", kind_of(F.col("data_type")).alias("kind")).distinct()


def cell_ids(tracks: DataFrame, data_type: str) -> DataFrame:
    """The different replicates of each cell that have a data type."""
    return tracks.where(F.lower("data_type") == data_type.lower()).select("cell", "replicate").distinct()


def usable(tracks: DataFrame) -> DataFrame:
    """Tracks that aren't marked as failed."""
    return tracks.where(~F.coalesce(F.lower(F.try_element_at("meta", F.lit("failed"))) == "true", F.lit(False)))


def report(metrics: DataFrame) -> DataFrame:
    """(metric, value) rows of a frame of metrics, in the order of its columns, values as text."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for i, c in enumerate(metrics.columns)])
    return metrics.select(F.explode(pairs).alias("p")).select("p.i", "p.metric", "p.value").orderBy("i").drop("i")
