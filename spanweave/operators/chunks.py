"""Long sequences as chunks (id, at, seq): pieces in a row, each with its place in the sequence.

A chromosome needn't fit in a task.  What looks at neighbouring bases takes chunks with halos, the
bases that follow a chunk: an equi-join of chunk ends with the chunks that begin there, of which
only heads are sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Bases of a chunk.
SIZE = 1 << 20


def chunked(sequences: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of sequences (id, seq); an empty sequence has one empty chunk, a null one none."""
    n = F.length("seq")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))).alias("at")
    cut = sequences.where(F.col("seq").isNotNull()).select("id", "seq", at)
    return cut.select("id", F.col("at").cast("long").alias("at"), F.substring(F.col("seq"), F.col("at") + 1, F.lit(size)).alias("seq"))


def haloed(chunks: DataFrame, width: int) -> DataFrame:
    """(id, at, seq, halo): chunks with the `width` bases that follow, fewer at a sequence's end.

    A head that ends before `width` bases, because its chunk is short, is lengthened by the head
    that begins there; each round doubles the number of chunks that it spans.
    """
    end = (F.col("at") + F.length("seq")).alias("end")
    heads = staged(chunks.where(F.length("seq") > 0).select("id", F.col("at").cast("long").alias("at"), F.substring(F.col("seq"), 1, width).alias("head")), "heads")
    while True:
        more = heads.select("id", F.col("at").alias("end"), F.col("head").alias("more"))
        longer = heads.where(F.length("head") < width).withColumn("end", F.col("at") + F.length("head")).join(more, ["id", "end"])
        grown = staged(longer.select("id", "at", F.substring(F.concat("head", "more"), 1, width).alias("grown")), "heads")
        if grown.isEmpty():
            break
        heads = staged(heads.join(grown, ["id", "at"], "left").select("id", "at", F.coalesce("grown", "head").alias("head")), "heads")
    follow = heads.select("id", F.col("at").alias("end"), F.col("head").alias("halo"))
    held = chunks.select("id", F.col("at").cast("long").alias("at"), "seq", end)
    return held.join(follow, ["id", "end"], "left").select("id", "at", "seq", F.coalesce("halo", F.lit("")).alias("halo"))


def whole(sequences: DataFrame) -> DataFrame:
    """Sequences (id, seq) as chunks with halos: one chunk each, nothing behind it."""
    return sequences.select("id", F.lit(0).cast("long").alias("at"), "seq", F.lit("").alias("halo"))
