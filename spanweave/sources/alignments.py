"""Aligned reads: SAM text, BAM files, pairs, pileups of bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bgzf

#: Flag bits of a read.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 4, 8, 16, 32, 256, 1024, 2048


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text; pos is 1-based, 0 if there is none."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("NOT startswith(value, '@') AND value <> ''")
    mate = F.when(c[6] == "=", c[2]).otherwise(c[6])
    return rows.select(c[0].alias("name"), c[1].cast("int").alias("flag"), c[2].alias("chrom"), c[3].cast("long").alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), mate.alias("mate_chrom"), c[7].cast("long").alias("mate_pos"), c[9].alias("seq"), c[10].alias("quality"))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files; a file is read by many tasks, by its blocks."""
    return bgzf.read(spark, path)


def _off(*bits: int):
    return F.col("flag").bitwiseAND(sum(bits)) == 0


def cigar_length(cigar):
    """Reference bases that a CIGAR covers."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def mapped(records: DataFrame) -> DataFrame:
    """(chrom, strand, start, stop) of primary, placed reads that aren't duplicates; 0-based."""
    good = records.where(_off(UNMAPPED, SECONDARY, SUPPLEMENTARY, DUPLICATE) & (F.col("pos") > 0))
    strand = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+")
    return good.select("chrom", strand.alias("strand"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + cigar_length(F.col("cigar"))).alias("stop"))


def pairs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chrom, pos, mate, length) of each proper pair, by its read on minus, and one row with the
    number of unpaired reads."""
    good = records.where(_off(UNMAPPED, SECONDARY, SUPPLEMENTARY, DUPLICATE))
    bit = lambda b: F.col("flag").bitwiseAND(b) != 0
    proper = bit(PAIRED) & ~bit(MATE_UNMAPPED) & (F.col("chrom") == F.col("mate_chrom")) & (bit(REVERSE) != bit(MATE_REVERSE))
    out = good.where(proper & bit(REVERSE)).select("chrom", (F.col("pos") - 1).alias("pos"), (F.col("mate_pos") - 1).alias("mate"), F.length("seq").cast("long").alias("length"))
    return out, good.where(~bit(PAIRED) | bit(MATE_UNMAPPED)).agg(F.count("*").alias("unpaired"))


def is_paired(records: DataFrame) -> bool:
    first = records.where(_off(UNMAPPED, SECONDARY, SUPPLEMENTARY, DUPLICATE)).select("flag").head()
    return bool(first and first[0] & PAIRED)


def aligned_bases(records: DataFrame) -> DataFrame:
    """(chrom, pos, base, quality, strand): aligned bases, with reads of mapping quality 0 left out.

    The CIGAR is folded to stretches of matched bases (place in the reference, place in the read,
    length) by built-in functions, and these to bases; a read without qualities has 255.
    """
    good = records.where(_off(UNMAPPED, SECONDARY, SUPPLEMENTARY, DUPLICATE) & (F.col("pos") > 0) & (F.col("mapq") > 0))
    size = lambda op: F.regexp_extract(op, r"\d+", 0).cast("int")
    kind = lambda op, kinds: F.substring(op, -1, 1).isin(*kinds)
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MIDNSHP=X]"), 0)
    none = F.array().cast("array<struct<ref:bigint,read:int,n:int>>")
    start = F.struct((F.col("pos") - 1).cast("long").alias("ref"), F.lit(0).alias("read"), none.alias("out"))

    def step(acc, op):
        here = F.struct(acc["ref"].alias("ref"), acc["read"].alias("read"), size(op).alias("n"))
        ref = acc["ref"] + F.when(kind(op, "MDN=X"), size(op)).otherwise(0)
        read = acc["read"] + F.when(kind(op, "MIS=X"), size(op)).otherwise(0)
        return F.struct(ref.alias("ref"), read.alias("read"), F.when(kind(op, "M=X"), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    strand = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+")
    runs = good.select("chrom", strand.alias("strand"), "seq", "quality", F.explode(F.aggregate(ops, start, step, lambda acc: acc["out"])).alias("run")).where("run.n > 0")
    each = runs.select("chrom", "strand", "seq", "quality", "run", F.explode(F.sequence(F.lit(0), F.col("run.n") - 1)).alias("i"))
    at = F.col("run.read") + F.col("i") + 1
    quality = F.when(F.col("quality") == "*", 255).otherwise(F.ascii(F.substring(F.col("quality"), at, F.lit(1))) - 33)
    return each.select("chrom", (F.col("run.ref") + F.col("i")).alias("pos"), F.lower(F.substring(F.col("seq"), at, F.lit(1))).alias("base"), quality.cast("int").alias("quality"), "strand")


#: Formats of reads by extension.
FORMATS = {"bam": "BAM", "sam": "SAM", "cram": "CRAM", "bed": "BED", "gz": "BED", "zip": "BED"}


def reads_format(path: str) -> str | None:
    return FORMATS.get(path.rsplit(".", 1)[-1].lower())
