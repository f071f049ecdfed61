"""Queries that write a relation in a file format and read it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..operators import frame as fr
from ..operators import named
from ..operators import nearest as nn
from ..operators import transcripts as tr
from ..session import shared_folder
from ..sources import alignments, annotations, bed, bgzf, sequences, typed_csv
from .catalog import Catalog
from .catalog_intervals import _merge_sql
from .catalog_signal import _CC, _EX, _MID, _TSS, _model

CATALOG = Catalog()
add = CATALOG.add


def _through(df: DataFrame, suffix: str, write: Callable[[DataFrame, str], None]) -> str:
    """Write a relation into a folder of its own that all executors see."""
    path = f"{shared_folder(df.sparkSession)}/format-{uuid.uuid4().hex}{suffix}"
    write(df, path)
    return path


def _bed(loci: DataFrame, fields: int) -> DataFrame:
    path = _through(loci.withColumn("name", F.col("id").cast("string")), ".bed", lambda d, p: bed.write(d, p, fields))
    return bed.read(loci.sparkSession, path, bed.BedFormat(fields)).where("bad IS NULL")


def _text(lines: DataFrame, suffix: str) -> str:
    return _through(lines.select("value"), suffix, lambda d, p: d.write.text(p))


def _typed(regions: DataFrame, suffix: str) -> DataFrame:
    return typed_csv.read(regions.sparkSession, _through(regions.withColumn("even", F.col("id") % 2 == 0), suffix, typed_csv.write))


def _sam(reads: DataFrame) -> DataFrame:
    flag = F.when(F.col("strand") == "-", "16").otherwise("0")
    cells = [F.col("id").cast("string"), flag, "chrom", (F.col("start") + 1).cast("string"), F.lit("30"), F.format_string("%dM", F.col("stop") - F.col("start"))]
    line = F.concat_ws("\t", *cells, *map(F.lit, ("*", "0", "0", "*", "*")))
    return alignments.mapped(alignments.read_sam(reads.sparkSession, _text(reads.select(line.alias("value")), ".sam")))


def _records(reads: DataFrame) -> DataFrame:
    """Reads as records of an alignment, without bases."""
    cells = {"name": F.col("id").cast("string"), "flag": F.when(F.col("strand") == "-", 16).otherwise(0), "chrom": F.col("chrom"), "pos": F.col("start") + 1, "mapq": F.lit(30), "cigar": F.format_string("%dM", F.col("stop") - F.col("start"))}
    return reads.select(*[c.alias(n) for n, c in cells.items()], F.lit("*").alias("mate_chrom"), F.lit(0).cast("long").alias("mate_pos"), F.lit("*").alias("seq"), F.lit("*").alias("quality"))


def _bam(reads: DataFrame, genome: DataFrame) -> str:
    return _through(_records(reads), ".bam", lambda d, p: bgzf.write(d, genome, p))


def _sam_lines(records: DataFrame) -> DataFrame:
    c = {n.split()[0]: F.col(n.split()[0]).cast("string") for n in bgzf.RECORD.split(", ")}
    order = ("name", "flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos")
    return records.select(F.concat_ws("\t", *[c[n] for n in order], F.lit("0"), c["seq"], c["quality"]).alias("value"))


def _stored_coverage(regions: DataFrame, reads: DataFrame, genome: DataFrame) -> DataFrame:
    """Coverage from a file of reads: tags and fragment size are kept by the first query, read by the second."""
    spark, path, folder = reads.sparkSession, _bam(reads, genome), f"{shared_folder(reads.sparkSession)}/kept"
    first, second = (named.Reads(spark, folder, path, genome) for _ in range(2))
    first.store()
    return second.coverage(regions).select("id", "coverage")


def _treated(s: DataFrame) -> DataFrame:
    """Four reads of each longer sequence with clips, a gap and an insertion; treated on both strands, and not."""
    each = s.where(F.length("seq") >= 60).select("id", "seq", F.explode(F.array(*map(F.lit, range(4)))).alias("r")).withColumn("s", (F.col("id") * 31 + F.col("r") * 17) % (F.length("seq") - 30))
    part = lambda a, n: F.substring(F.col("seq"), (F.col("s") + a + 1).cast("int"), F.lit(n))
    treated = lambda c: F.when(F.col("r") == 0, F.translate(c, "c", "t")).when(F.col("r") == 1, F.translate(c, "g", "a")).otherwise(c)
    bases = F.upper(F.concat(F.lit("ttt"), treated(part(0, 6)), treated(part(8, 5)), F.lit("a"), treated(part(13, 4))))
    cells = {"name": F.concat_ws(":", "id", "r"), "flag": F.col("r") % 2 * 16, "chrom": F.concat(F.lit("s"), "id"), "pos": F.col("s") + 1, "mapq": F.lit(30), "cigar": F.lit("3S6M2D5M1I4M"), "mate_chrom": F.lit("*"), "mate_pos": F.lit(0), "seq": bases, "quality": F.lit("I" * 19)}
    return each.select(*[c.alias(n) for n, c in cells.items()])


def _methylome(s: DataFrame) -> DataFrame:
    spark, chunks = s.sparkSession, ch.chunked(s.select(F.concat(F.lit("s"), "id").alias("id"), "seq"), 4096)
    return named.Methylome(spark, f"{shared_folder(spark)}/kept", _text(_sam_lines(_treated(s)), ".sam"), chunks).get()


def _fasta(s: DataFrame) -> DataFrame:
    named = s.where(F.length("seq") > 0).select(F.col("id").cast("string").alias("name"), "seq")
    return sequences.read_fasta(s.sparkSession, _through(named, ".fa", sequences.write_fasta))


def _gtf(t: DataFrame) -> DataFrame:
    back = annotations.read_gtf(t.sparkSession, _text(annotations.gtf_lines(_model(t)), ".gtf"))
    return tr.exons(back).withColumn("tid", F.col("tid").cast("long"))


def _detected(loci: DataFrame) -> DataFrame:
    """Records of six fields and two more, read by the format that their first lines show."""
    path = _through(loci, ".bed", lambda d, p: d.select(F.concat_ws("\t", "chrom", "start", "stop", F.concat(F.lit("n"), "id"), "score", "strand", F.lit("x"), "id").alias("value")).write.text(p))
    fmt = bed.detect(loci.sparkSession, path)
    return bed.read(loci.sparkSession, path, fmt).select("chrom", "start", "stop", "name", "score", "strand", F.array_join("extras", "|").alias("extras"), F.lit(str(fmt)).alias("format"))


def _npz(regions: DataFrame) -> DataFrame:
    return typed_csv.read_npz(regions.sparkSession, _through(regions.withColumn("even", F.col("id") % 2 == 0), ".npz", typed_csv.write_npz))


def _twobit(s: DataFrame) -> DataFrame:
    named_rows = s.where(F.length("seq") > 0).select(F.col("id").cast("string").alias("name"), "seq")
    return sequences.read_twobit(s.sparkSession, _through(named_rows, ".2bit", sequences.write_twobit), 200)


def _sizes(g: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", "chrom", F.col("length").cast("string"))
    return annotations.read_table(g.sparkSession, _text(g.select(line.alias("value")), ".sizes"), "sizes")


add("bed_round_trip", "loci", lambda x: _bed(x, 6).select("chrom", "start", "stop", "name", "score", "strand"),
    "SELECT chrom, cast(start AS int) AS start, cast(stop AS int) AS stop, id::varchar AS name, cast(score AS int) AS score, strand FROM loci")
add("bed_locations", "loci", lambda x: bed.locations(_bed(x, 3)), "SELECT chrom, '+' AS strand, start, stop FROM loci")
add("typed_tsv_round_trip", "regions", lambda r: _typed(r, ".tsv"), "SELECT *, id % 2 = 0 AS even FROM regions")
add("typed_csv_round_trip", "regions", lambda r: _typed(r, ".csv"), "SELECT *, id % 2 = 0 AS even FROM regions")
add("sam_round_trip", "reads", _sam, "SELECT chrom, strand, start, stop FROM reads")
add("bam_round_trip", "reads genome", lambda r, g: alignments.mapped(alignments.read_bam(r.sparkSession, _bam(r, g))), "SELECT chrom, strand, start, stop FROM reads")
_MOVED = "CASE t.strand WHEN '+' THEN -(fragment // 2) ELSE fragment // 2 END"
add("reads_query", "regions reads genome", _stored_coverage,
    f"SELECT id, count(pos) AS coverage FROM (SELECT * FROM regions, best) a LEFT JOIN tags t ON a.chrom = t.chrom AND pos >= greatest(start + {_MOVED}, 0) AND pos < stop + {_MOVED} GROUP BY id",
    **_CC, best="SELECT fragment FROM v ORDER BY value DESC, fragment LIMIT 1")
add("bisulfite_methylome", "sequences", _methylome,
    "SELECT chrom, strand, pos, tag, k, n FROM (SELECT chrom, strand, pos, any_value(CASE WHEN y = e THEN 0 WHEN y <> '' AND z = e THEN 1 WHEN y <> '' AND z <> '' THEN 2 END) AS tag, count(*) FILTER (WHERE r >= 2) AS k, count(*) AS n FROM w GROUP BY 1, 2, 3) WHERE tag IS NOT NULL",
    rd="SELECT id, seq, r, (id * 31 + r * 17) % (length(seq) - 30) AS s FROM sequences, range(4) t(r) WHERE length(seq) >= 60",
    b="SELECT concat('s', id) AS chrom, CASE WHEN r % 2 = 0 THEN '+' ELSE '-' END AS strand, s + o AS pos, r, seq FROM rd, (SELECT unnest([0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 14, 15, 16]) AS o)",
    w="SELECT chrom, strand, pos, r, CASE strand WHEN '+' THEN 'g' ELSE 'c' END AS e, CASE WHEN strand = '+' THEN substr(seq, pos + 2, 1) WHEN pos >= 1 THEN substr(seq, pos, 1) ELSE '' END AS y, CASE WHEN strand = '+' THEN substr(seq, pos + 3, 1) WHEN pos >= 2 THEN substr(seq, pos - 1, 1) ELSE '' END AS z FROM b WHERE substr(seq, pos + 1, 1) = CASE strand WHEN '+' THEN 'c' ELSE 'g' END")
add("fasta_round_trip", "sequences", _fasta, "SELECT id::varchar AS name, seq FROM sequences WHERE length(seq) > 0")
add("gtf_round_trip", "transcripts", _gtf, "SELECT tid, chrom, strand, start, stop FROM ex", ex=_EX)
add("bed_detected", "loci", _detected,
    "SELECT chrom, cast(start AS int) AS start, cast(stop AS int) AS stop, concat('n', id) AS name, cast(score AS int) AS score, strand, concat('x|', id) AS extras, 'bed6+2' AS format FROM loci")
add("npz_round_trip", "regions", _npz, "SELECT *, id % 2 = 0 AS even FROM regions")
add("twobit_round_trip", "sequences", _twobit, "SELECT id::varchar AS name, start, substr(seq, start + 1, 200) AS seq FROM (SELECT *, unnest(range(0, length(seq), 200)) AS start FROM sequences)")
add("sizes_round_trip", "genome", _sizes, "SELECT chrom, length FROM genome")

# ---- locus queries over annotation tables ------------------------------------------------

add("repeats_of_class", "regions", lambda r: tr.repeats(r.withColumnRenamed("name", "class"), "1-URGENT"), "SELECT chrom, strand, start, stop FROM regions WHERE name = '1-URGENT'")
add("cpg_islands", "regions", tr.cpg_islands, "SELECT chrom, '+' AS strand, start, stop FROM regions")
add("non_repeats", "regions genome", tr.non_repeats,
    "SELECT chrom, strand, gap_start AS start, start AS stop FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY chrom ORDER BY start, stop), 0) AS gap_start FROM e) CROSS JOIN (VALUES ('+'), ('-')) s(strand) WHERE gap_start < start",
    plus="SELECT chrom, start, stop FROM regions WHERE strand = '+'", m=_merge_sql("plus", "chrom"), e="SELECT chrom, start, stop FROM m UNION ALL SELECT chrom, length, length FROM genome")
add("signed_distance", "regions transcripts", lambda r, t: nn.nearest(nn.midpoints(r).select("id", "chrom", "mid"), nn.starts(t)).select("id", "tid", nn.signed_great_distance(F.col("mid"), F.col("pos")).alias("distance")),
    "SELECT id, tid, mid - pos AS distance FROM q JOIN tss USING (chrom) WHERE abs(pos - mid) = (SELECT min(abs(pos - mid)) FROM tss s WHERE s.chrom = q.chrom)", tss=_TSS, q=_MID)
for _name, _back, _order in (("argsort_text", False, "name, r"), ("argsort_text_desc", True, "name DESC, r DESC")):
    add(_name, "regions", lambda r, back=_back: fr.permutation(fr.with_row(r.select("id", "name"), "id"), "name", back),
        f"SELECT r AS _row, row_number() OVER (ORDER BY {_order}) - 1 AS position FROM (SELECT name, row_number() OVER (ORDER BY id) - 1 AS r FROM regions)")
