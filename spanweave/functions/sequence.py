"""Nucleotide sequences in lower case over a, c, g, t and n."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bases that a IUPAC code stands for.
IUPAC = {"a": "a", "c": "c", "g": "g", "t": "t", "r": "ag", "y": "ct", "s": "cg", "w": "at", "k": "gt", "m": "ac", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"}
#: Two-bit codes.
CODES = {"t": 0, "c": 1, "a": 2, "g": 3}


def complement(seq: Column) -> Column:
    return F.translate(seq, "acgt", "tgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def subsequence(seq: Column, start: Column, stop: Column, strand: Column) -> Column:
    """The bases of [start, stop) along the strand."""
    part = F.substring(F.lower(seq), (start + 1).cast("int"), (stop - start).cast("int"))
    return F.when(strand == "-", reverse_complement(part)).otherwise(part)


def base_at(seq: Column, at: Column, strand: Column) -> Column:
    return subsequence(seq, at, at + 1, strand)


def count_cg(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "cg", ""))


def count_cpg(seq: str | Column) -> Column:
    """Neighbouring pairs cg and gc, overlapping ones too; a null sequence has none."""
    return F.coalesce(F.regexp_count(seq, F.lit("c(?=g)")) + F.regexp_count(seq, F.lit("g(?=c)")), F.lit(0))


def _windows(seqs: pd.Series, own: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(any window rich in pairs, largest ratio) of each text over windows that begin in its first
    `own` bases; the ratio is -inf where none fits.  All texts of a batch are one array."""
    texts = [(s or "").lower().encode() for s in seqs]
    size = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    c, g = b == 99, b == 103
    cg = np.concatenate([[0], np.cumsum(c | g)])
    pair = np.concatenate([[0], np.cumsum((c[:-1] & g[1:]) | (g[:-1] & c[1:]))]) if len(b) else np.zeros(1, np.int64)
    first = np.cumsum(size) - size
    places = np.maximum(np.minimum(own.fillna(0).to_numpy(np.int64), size - width + 1), 0)
    row = np.repeat(np.arange(len(size)), places)
    at = np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places) + first[row]
    n = cg[at + width] - cg[at]
    ratio = np.where(n > 0, 2.0 * (pair[at + width - 1] - pair[at]) / np.maximum(n, 1), 0.0)
    rich, most, there = np.zeros(len(size), bool), np.full(len(size), -np.inf), places > 0
    if there.any():
        begin = (np.cumsum(places) - places)[there]
        rich[there] = np.logical_or.reduceat((n / width >= 0.55) & (ratio >= 0.6), begin)
        most[there] = np.maximum.reduceat(ratio, begin)
    return rich, most


def _kind(rich: Column, most: Column) -> Column:
    return F.when(rich, "HCP").when((most >= 0) & (most < 0.4), "LCP").when(most >= 0, "ICP")


def cpg_class(width: int = 500):
    """HCP, ICP or LCP of sequences with at least `width` bases, else null: HCP if any window
    has 55 % of c and g and twice its pairs over them is 0.6; LCP if that ratio stays under 0.4."""

    @F.pandas_udf(T.StringType())
    def classify(seqs: pd.Series) -> pd.Series:
        rich, most = _windows(seqs, seqs.str.len(), width)
        kind = np.where(rich, "HCP", np.where(most < 0.4, "LCP", "ICP")).astype(object)
        return pd.Series(np.where(np.isfinite(most), kind, None), index=seqs.index)

    return classify


def cpg_classes(chunks: DataFrame, width: int = 500) -> DataFrame:
    """(id, kind) of sequences in chunks with halos (id, at, seq, halo) of width - 1 bases or more: each
    chunk judges the windows that begin in it, a sequence is judged by all of them."""
    kinds = "rich boolean, most double"

    @F.pandas_udf(kinds)
    def judge(seqs: pd.Series, own: pd.Series) -> pd.DataFrame:
        rich, most = _windows(seqs, own, width)
        return pd.DataFrame({"rich": rich, "most": most})

    each = chunks.select("id", judge(F.concat("seq", "halo"), F.length("seq").cast("long")).alias("w"))
    by_id = each.groupBy("id").agg(F.bool_or("w.rich").alias("rich"), F.max("w.most").alias("most"))
    return by_id.select("id", _kind(F.col("rich"), F.col("most")).alias("kind"))


def gc_bins_of_chunks(chunks: DataFrame, width: int) -> DataFrame:
    """(id, bin, gc) as gc_bins() over sequences in chunks (id, at, seq): a bin that lies in several
    chunks adds up their bases."""
    held = chunks.where(F.length("seq") > 0).select("id", "at", "seq", F.explode(F.sequence(F.expr(f"at div {width}L"), F.expr(f"(at + length(seq) - 1) div {width}L"))).alias("b"))
    low = F.greatest(F.col("b") * width, F.col("at"))
    high = F.least((F.col("b") + 1) * width, F.col("at") + F.length("seq"))
    part = F.substring(F.col("seq"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    sums = held.select("id", (F.col("b") * width).alias("bin"), count_cg(part).alias("cg"), F.length(part).alias("n"))
    return sums.groupBy("id", "bin").agg((F.sum("cg") / F.sum("n")).alias("gc"))


def gc_bins(df: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    """Share of c and g in each bin of `width` bases; the last bin may be shorter."""
    n = F.length(seq).cast("long")
    held = df.where(F.length(seq) > 0).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(width).cast("long"))))
    part = F.substring(F.col(seq), (F.col("bin") + 1).cast("int"), F.lit(width))
    return held.withColumn("gc", count_cg(part) / F.length(part))
