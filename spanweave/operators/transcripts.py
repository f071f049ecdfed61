"""Transcripts and genes: locus queries, derived ranges, grouping, name resolution."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import bound5, complement, merged, relative
from .prefix import row_number

_TILE = ("tid", "chrom", "strand")


def exons(t: DataFrame) -> DataFrame:
    """(tid, chrom, strand, start, stop) of each exon in the array `exons`."""
    return t.select(*_TILE, F.explode("exons").alias("e")).select(*_TILE, "e.start", "e.stop")


def _clipped(t: DataFrame, low: Column, high: Column) -> DataFrame:
    held = t.where("cds IS NOT NULL").select(*_TILE, low.alias("low"), high.alias("high"), F.explode("exons").alias("e"))
    return held.select(*_TILE, F.greatest("e.start", "low").alias("start"), F.least("e.stop", "high").alias("stop")).where("start < stop")


def cds(t: DataFrame) -> DataFrame:
    return _clipped(t, F.col("cds.start"), F.col("cds.stop"))


def utr5(t: DataFrame) -> DataFrame:
    """Exon parts between the 5' end and the coding part."""
    plus = F.col("strand") == "+"
    return _clipped(t, F.when(plus, F.col("start")).otherwise(F.col("cds.stop")), F.when(plus, F.col("cds.start")).otherwise(F.col("stop")))


def utr3(t: DataFrame) -> DataFrame:
    """Exon parts from `utr3` (the 5' end of that region, null: none) to the 3' end."""
    plus = F.col("strand") == "+"
    held = t.where("utr3 IS NOT NULL")
    return _clipped(held, F.when(plus, F.col("utr3")).otherwise(F.col("start")), F.when(plus, F.col("stop")).otherwise(F.col("utr3") + 1))


def introns(t: DataFrame) -> DataFrame:
    """What exons leave of a transcript; exons of one transcript are sorted and disjoint."""
    ends = F.concat(F.array("start"), F.transform("exons", lambda e: e["stop"]))
    begins = F.concat(F.transform("exons", lambda e: e["start"]), F.array("stop"))
    gaps = F.arrays_zip(ends.alias("a"), begins.alias("b"))
    return t.select(*_TILE, F.explode(gaps).alias("g")).select(*_TILE, F.col("g.a").alias("start"), F.col("g.b").alias("stop")).where("start < stop")


def body(t: DataFrame) -> DataFrame:
    return t.select(*_TILE, "start", "stop")


def around(anchor: str, left: int = -2000, right: int = 2000) -> Callable[[DataFrame], DataFrame]:
    """Windows around the 5' ("five") or 3' ("three") end; needs the chromosome's `length`."""
    if left >= right:
        raise ValueError(f"empty window {left}..{right}")
    return lambda t: relative(t, anchor, left, right).select(*_TILE, F.col("w_start").alias("start"), F.col("w_stop").alias("stop"))


LOCI = {"tss": around("five"), "tes": around("three"), "transcript": body, "cds": cds, "utr5": utr5, "utr3": utr3, "introns": introns, "exons": exons}
_QUERY = re.compile(r"(tss|tes)\s*\[?\s*(-?\d+)\s*(?:(?:\.\.|_|;)\s*(-?\d+)\s*)?\]?", re.I)


def parse_locus(text: str) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    """(id, query) of a locus text: a name, or tss/tes with one width or two bounds."""
    name = text.strip()
    if name.lower() in ("tss", "tes"):
        name += "[-2000..2000]"
    elif name.lower() in LOCI:
        return name.lower(), LOCI[name.lower()]
    m = _QUERY.fullmatch(name)
    if not m:
        raise ValueError(f"unsupported locus {text!r}; names are {sorted(LOCI)}")
    left = int(m[2])
    left, right = (left, int(m[3])) if m[3] is not None else (-abs(left), abs(left))
    kind = m[1].lower()
    return f"{kind}[{left}..{right}]", around("five" if kind == "tss" else "three", left, right)


def cpg_islands(islands: DataFrame) -> DataFrame:
    """The ranges of CpG islands, all on plus."""
    return islands.select("chrom", F.lit("+").alias("strand"), "start", "stop")


def repeats(table: DataFrame, kind: str | None = None) -> DataFrame:
    """The ranges of repeats, of all classes or one."""
    return (table if kind is None else table.where(F.col("class") == kind)).select("chrom", "strand", "start", "stop")


def non_repeats(table: DataFrame, genome: DataFrame) -> DataFrame:
    """What the repeats of the plus strand leave of each chromosome, the same on both strands."""
    gaps = complement(merged(table.where("strand = '+'"), ("chrom",)), genome.select("chrom", "length"), ("chrom",))
    return gaps.select("chrom", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), "start", "stop")


def of_class(t: DataFrame, kind: str) -> DataFrame:
    return {"CODING": t.where("cds IS NOT NULL"), "NON_CODING": t.where("cds IS NULL"), "ALL": t}[kind]


def genes(t: DataFrame) -> DataFrame:
    """Genes of transcripts: hull, symbol of the first transcript by id, and how many there are."""
    return t.groupBy("gid", "chrom").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("symbol", "tid").alias("symbol"), F.count("*").alias("transcripts"))


def longest(t: DataFrame) -> DataFrame:
    """The longest transcript of each gene, the least id of equal ones."""
    best = t.groupBy("gid").agg(F.max(F.struct((F.col("stop") - F.col("start")).alias("size"), (-F.col("tid")).alias("t"))).alias("b"))
    return best.select("gid", (-F.col("b.t")).alias("tid"), F.col("b.size").alias("size"))


def aliases(t: DataFrame) -> DataFrame:
    """(alias, kind, tid): upper-case names by which a transcript can be asked for; blank ones are none."""
    text = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    names = F.array(*[F.struct(F.lit(k).alias("kind"), text(c).alias("alias")) for k, c in (("symbol", "symbol"), ("transcript", "tid"), ("gene", "gid"))])
    return t.select("tid", F.explode(names).alias("n")).select("n.alias", "n.kind", "tid").where("alias <> ''")


def resolve(names: DataFrame, t: DataFrame, column: str = "name") -> DataFrame:
    """Names with the transcripts they mean, whatever their case; `first` marks the least id."""
    found = names.withColumn("alias", F.upper(F.trim(column))).join(aliases(t), "alias")
    best = found.groupBy("alias").agg(F.min("tid").alias("__t"))
    return found.join(best, "alias").withColumn("first", F.col("tid") == F.col("__t")).drop("__t")


def chromosome_aliases(genome: DataFrame) -> DataFrame:
    """(alias, chrom): names with and without chr, in lower case."""
    bare = F.regexp_replace(F.lower("chrom"), "^chr", "")
    return genome.select("chrom", F.explode(F.array_distinct(F.array(F.lower("chrom"), bare, F.concat(F.lit("chr"), bare)))).alias("alias"))


def in_order(t: DataFrame) -> DataFrame:
    """Transcripts with `_row`, their number in the order of 5' ends and then ids."""
    return row_number(t.withColumn("five", bound5()), "five", [F.col("tid")]).drop("five")


def described(t: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Transcripts with the description of their gene, from (name, description); null if it has
    none or a blank one.  Of several the last by text counts."""
    one = descriptions.where("description <> ''").groupBy(F.col("name").alias("gid")).agg(F.max("description").alias("description"))
    return t.join(one, "gid", "left")
