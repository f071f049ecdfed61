"""Files read back what was written, and awkward records are handled as documented."""

import random
import struct
import zlib

import numpy as np
import pytest

from spanweave.operators import methylome, named
from spanweave.sources import alignments, annotations, bed, bgzf, sequences, typed_csv


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_typed_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, True, "a\tb"), (2, -1.0, False, "c")], "i int, d double, f boolean, s string")
    typed_csv.write(df.coalesce(1), str(tmp_path / "t.tsv"))
    part = next((tmp_path / "t.tsv").glob("part-*"))
    assert part.read_text().splitlines()[:2] == ["# Integer;\tDouble;\tBoolean;\tString", "i\td\tf\ts"]
    got = typed_csv.read(spark, str(part.rename(tmp_path / "one.tsv")))
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "f.npz", a=np.array([1, 2], np.int32), b=np.array([True, False]), c=np.array(["x", "y"]))
    got = typed_csv.load(spark, str(tmp_path / "f.npz"))
    assert sorted(map(tuple, got.collect())) == [(1, True, "x"), (2, False, "y")]


def test_bed12(spark, tmp_path):
    p = put(tmp_path, "a.bed", "track name=x\n# c\nchr2\t1\t2\tDescription\t0\t+\t1000\t5000\t255,0,0\t2\t10,20\t1,2\nchr2\t10\t20\tD2\t0\t.\t1\t5\t0\t1\t5,\t1\n")
    assert str(bed.detect(spark, p)) == "bed12"
    a, b = bed.read(spark, p).orderBy("start").collect()
    assert (a.chrom, a.start, a.stop, a.item_rgb, a.block_sizes) == ("chr2", 1, 2, -65536, [10, 20]) and (b.strand, b.item_rgb, b.block_sizes) == ("+", 0, [5])


def test_bed_formats_and_bad_lines(spark, tmp_path):
    assert str(bed.detect_line("chr1 1 2 n 5 + x")) == "bed6+1" and str(bed.BedFormat.parse("bed6+3")) == "bed6+3" and bed.BedFormat.parse("bed3+").extra is None
    p = put(tmp_path, "b.bed", "chr1\t1\t2\nchr1\tx\t2\nchr1\t5\t5\n")
    got = bed.read(spark, p, bed.BedFormat(3))
    assert got.where("bad IS NOT NULL").count() == 1 and sorted(r.stop for r in bed.reads(got).collect()) == [2, 6]
    with pytest.raises(Exception, match="bad BED"):
        bed.read(spark, p, bed.BedFormat(3), strict=True).collect()
    assert bed.lines(bed.locations(got)).count() == 2


def test_fasta_and_twobit(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one x\nACGT\nNNac\n>two\nGG\n")
    fa = sequences.read_fasta(spark, p)
    assert sorted(map(tuple, fa.collect())) == [("one x", "acgtnnac"), ("two", "gg")]
    sequences.write_fasta(fa.coalesce(1), str(tmp_path / "out"), 3)
    back = sequences.read_fasta(spark, str(next((tmp_path / "out").glob("part-*"))))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fa.collect()))
    seq = "".join(np.random.default_rng(1).choice(list("acgtn"), 1003))
    (tmp_path / "g.2bit").write_bytes(sequences.encode_twobit({"a": seq, "b": "ac"}))
    got = sequences.read_twobit(spark, str(tmp_path / "g.2bit"), 97).orderBy("name", "start").collect()
    assert "".join(r.seq for r in got if r.name == "a") == seq and [r.seq for r in got if r.name == "b"] == ["ac"]
    assert sequences.pair_fastq(["x_1.fq", "x_2.fq", "y_1.fq"]) == ([("x_1.fq", "x_2.fq")], ["y_1.fq"])


SAM = "@HD\tVN:1.0\nr1\t0\tchr1\t11\t30\t4M1D2M\t*\t0\t0\tACGTAC\tIIIIII\nr2\t16\tchr1\t21\t0\t3M\t*\t0\t0\tCCC\tIII\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"


def test_sam(spark, tmp_path):
    s = alignments.read_sam(spark, put(tmp_path, "a.sam", SAM))
    assert sorted(map(tuple, alignments.mapped(s).collect())) == [("chr1", "+", 10, 17), ("chr1", "-", 20, 23)]
    assert not alignments.is_paired(s) and alignments.pairs(s)[1].first()[0] == 2
    bases = sorted((r.pos, r.base) for r in alignments.aligned_bases(s).collect())
    assert bases == [(10, "a"), (11, "c"), (12, "g"), (13, "t"), (15, "a"), (16, "c")]


def test_bam(spark, tmp_path):
    name, cigar, seq = b"r1\0", struct.pack("<2I", 4 << 4, 2 << 4 | 4), bytes([0x12, 0x48, 0x12])
    body = struct.pack("<iiBBHHHiiii", 0, 10, len(name), 30, 0, 2, 16, 6, -1, -1, 0) + name + cigar + seq + bytes([40] * 6)
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(bgzf._block(raw[:20]) + bgzf._block(raw[20:]) + bgzf._LAST)
    r = alignments.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (r.name, r.flag, r.chrom, r.pos, r.cigar, r.seq) == ("r1", 16, "chr1", 11, "4M2S", "ACGTAC")


def _records(r, n, refs):
    out = []
    for i in range(n):
        size = r.choice([0, 1, 30, 31, 200, 3000])
        seq, flag = "".join(r.choices("ACGTN", k=size)), r.choice([0, 16, 4, 1024])
        cigar = f"{size}M" if size else "*"
        quality = "".join(chr(r.randint(33, 126)) for _ in range(size)) if r.random() < 0.8 else "*"
        out.append((f"read/{i}", flag, r.choice(refs), r.randint(1, 900), r.randint(0, 60), cigar, r.choice([*refs, "*"]), r.randint(0, 900), seq or "*", quality if size else "*"))
    return out


def test_one_bam_file_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(5)
    refs = [f"chr{i}" for i in range(40)]
    rows = _records(r, 2500, refs)
    genome = spark.createDataFrame([(c, 1000) for c in refs], "chrom string, length long")
    bgzf.write(spark.createDataFrame(rows, bgzf.RECORD).coalesce(1), genome, str(tmp_path / "x"))
    (whole,) = [f for f in (tmp_path / "x").iterdir() if f.name.startswith("part-")]
    whole.rename(tmp_path / "one.bam")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("150000", "70000", held):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = alignments.read_bam(spark, str(tmp_path / "one.bam"))
            begins = bgzf.lines(spark, str(tmp_path / "one.bam")).select("begin").distinct().count()
            assert (begins > 5) == (size != held) and sorted(map(tuple, got.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    bgzf.write(spark.createDataFrame(rows, bgzf.RECORD).repartition(5), genome, str(tmp_path / "many"))
    assert sorted(map(tuple, alignments.read_bam(spark, str(tmp_path / "many")).collect())) == sorted(rows)
    bgzf.write(spark.createDataFrame([], bgzf.RECORD), genome, str(tmp_path / "none"))


def test_blocks_with_separators_by_chance():
    data = [bytes([i]) * 700 for i in range(5)]
    # stored, not compressed, so that the separator stands in the block
    stored = lambda d: (z := zlib.compressobj(0, zlib.DEFLATED, -15)).compress(d) + z.flush()
    block = lambda d: bgzf._MAGIC + b"\0" * 4 + b"\0\xff\x06\0" + bgzf._EXTRA + struct.pack("<H", len(stored(d)) + 25) + stored(d) + struct.pack("<II", zlib.crc32(d), len(d))
    data[2] = b"ab" + bgzf._MAGIC + bgzf._MAGIC + b"c" * 40 + bgzf._MAGIC
    raw = b"".join(map(block, data)) + bgzf._LAST
    assert list(bgzf._inflated(iter(raw.split(bgzf._MAGIC)))) == [*data, b""]
    with pytest.raises(ValueError):
        list(bgzf._inflated(iter(raw[:1700].split(bgzf._MAGIC))))
    one = bgzf._packed({"name": "n", "flag": 0, "chrom": "a", "pos": 5, "mapq": 9, "cigar": "3M", "mate_chrom": "*", "mate_pos": 0, "seq": "ACG", "quality": "III"}, {"a": 0})
    assert bgzf.first_record(b"\0\1\2xyz" + one * 9) == 6 and bgzf.first_record(one * 3 + one[:20]) == 0 and bgzf.first_record(b"junk" * 30) == 120


def test_bisulfite_calls_equal_plain_python(spark):
    r = random.Random(9)
    reference = {c: "".join(r.choices("acgtn" if c == "b" else "acgt", k=n)) for c, n in (("a", 2300), ("b", 60))}
    rows, want = [], {}
    for i in range(150):
        chrom, reverse = r.choice(["a", "b"]), r.random() < 0.5
        ops, ref, seq, at = [], r.randint(0, len(reference[chrom]) - 1), "", []
        start = ref
        for op in r.sample(["M", "I", "M", "D", "S", "=", "X", "N", "H", "P"], 6):
            n = r.randint(1, 9)
            if op in "M=XDN":
                n = min(n, len(reference[chrom]) - ref)
            if not n:
                continue
            ops.append(f"{n}{op}")
            if op in "M=X":
                at += [(ref + j, len(seq) + j) for j in range(n)]
            if op in "M=XIS":
                seq += "".join(r.choices("ACGT", k=n))
            ref += n if op in "M=XDN" else 0
        quality, mapq, flag = "".join(r.choices("+5I", k=len(seq))), r.choice([0, 30, 30]), (16 if reverse else 0) | r.choice([0, 0, 1024])
        rows.append((f"r{i}", flag, chrom, start + 1, mapq, "".join(ops) or "*", "*", 0, seq or "*", quality or "*"))
        for p, q in at if mapq and not flag & 1024 else ():
            if ord(quality[q]) - 33 >= 20 and reference[chrom][p] == ("g" if reverse else "c"):
                s = want.setdefault((chrom, "-" if reverse else "+", p), [0, 0])
                s[0] += seq[q].lower() == ("g" if reverse else "c")
                s[1] += 1
    def context(c, strand, p):
        s, step, last = reference[c], (1, -1)[strand == "-"], "g" if strand == "+" else "c"
        one, two = (s[q] if 0 <= (q := p + k * step) < len(s) else "" for k in (1, 2))
        h = lambda x: x not in (last, "n", "")
        return "CG" if one == last else "CHG" if h(one) and two == last else "CHH" if h(one) and h(two) else None

    cut = spark.createDataFrame([(c, a, s[a : a + 100]) for c, s in reference.items() for a in range(0, len(s), 100)], "id string, at long, seq string")
    aligned = alignments.aligned_bases(spark.createDataFrame(rows, bgzf.RECORD))
    for size in (16, 1024):
        got = methylome.bisulfite(aligned, cut, 20, size).collect()
        assert {(x["chrom"], x["strand"], x["pos"]): (x["context"], [x["k"], x["n"]]) for x in got} == {k: (context(*k), v) for k, v in want.items()} and len(got) == len(want) > 50


def test_reads_are_kept_by_their_content(spark, tmp_path):
    lines = [f"r{i}\t{16 * (i % 2)}\tchr1\t{1 + 37 * i % 900}\t30\t10M\t*\t0\t0\t*\t*" for i in range(60)]
    path = put(tmp_path, "a.sam", "\n".join(lines))
    genome = spark.createDataFrame([("chr1", 1000)], "chrom string, length long")
    q = named.Reads(spark, str(tmp_path), path, genome, fragment=20)
    tags, about = q.get()
    assert about == {"fragment": 20, "read_length": 10.0} and tags.count() == 60
    same = named.Reads(spark, str(tmp_path), put(tmp_path, "b.sam", "\n".join(lines[::-1])), genome, fragment=20)
    assert same.store() == q.store() and named.Reads(spark, str(tmp_path), path, genome, fragment=21).store() != q.store()
    put(tmp_path, "a.sam", "\n".join(lines[:50]))  # stale now
    assert named.Reads(spark, str(tmp_path), path, genome, fragment=20).get()[0].count() == 50
    assert named.Reads(spark, str(tmp_path), put(tmp_path, "none.sam", "@HD\n"), genome).get()[1] == {"fragment": 0, "read_length": 0.0}
    estimated = named.Reads(spark, str(tmp_path), path, genome).get()[1]["fragment"]
    regions = spark.createDataFrame([(1, "chr1", "+", 0, 1000)], "id long, chrom string, strand string, start long, stop long")
    assert 15 <= estimated <= 500 and q.coverage(regions).first()["coverage"] > 40
    with pytest.raises(ValueError):
        named.Reads(spark, str(tmp_path), "x.cram", genome)


GTF = """#!x
chr1\ts\ttranscript\t11\t100\t.\t+\t.\tgene_id "g"; transcript_id "t"; gene_name "N";
chr1\ts\texon\t11\t40\t.\t+\t.\tgene_id "g"; transcript_id "t";
chr1\ts\texon\t61\t100\t.\t+\t.\tgene_id "g"; transcript_id "t";
chr1\ts\tCDS\t21\t40\t.\t+\t.\tgene_id "g"; transcript_id "t";
chr1\ts\tstop_codon\t38\t40\t.\t+\t.\tgene_id "g"; transcript_id "t";
"""


def test_gtf(spark, tmp_path):
    t = annotations.read_gtf(spark, put(tmp_path, "a.gtf", GTF))
    r = t.first()
    assert (r.tid, r.symbol, r.start, r.stop, r.cds.start, r.cds.stop, r.utr3) == ("t", "N", 10, 100, 20, 40, 60)
    back = annotations.read_gtf(spark, put(tmp_path, "b.gtf", "\n".join(x.value for x in annotations.gtf_lines(t).collect())))
    assert [tuple(e) for e in back.first().exons] == [(10, 40), (60, 100)]


def test_ontology_and_tables(spark, tmp_path):
    terms, edges = annotations.read_obo(spark, put(tmp_path, "a.obo", "format: 1\n\n[Term]\nid: A\nname: root\n\n[Term]\nid: B\nname: leaf\nis_a: A ! root\n\n[Term]\nid: C\nis_obsolete: true\nis_a: A\n"))
    assert terms.count() == 3 and [tuple(x) for x in edges.collect()] == [("B", "A")]
    gaf = put(tmp_path, "a.gaf", "!x\n" + "\t".join(["d", "1", "SYM", "", "B", "", "", "", "P", "", "s1|s2"] + [""] * 6) + "\n")
    assert sorted(x.symbol for x in annotations.read_gaf(spark, gaf, "P").collect()) == ["SYM", "s1", "s2"]
    gaps = annotations.read_table(spark, put(tmp_path, "gap.txt", "1\tchr1\t5\t9\t1\tN\t4\tcentromere\tno\n1\tchr1\t20\t30\t1\tN\t10\tcentromere\tno\n"), "gap")
    assert [tuple(x) for x in annotations.centromeres(gaps).collect()] == [("chr1", 5, 30)]
    config = "genome: x\ntracks:\n  chip:\n    od:\n      r1: a.bed\n      r2: {path: b.bed, failed: true}\n    yd: [c.bed]\n"
    assert sorted((r.cell, r.replicate, r.path) for r in annotations.tracks(spark, config).collect()) == [("od", "r1", "a.bed"), ("od", "r2", "b.bed"), ("yd", "rep1", "c.bed")]


def test_texts():
    from spanweave.functions import text

    assert text.parse_place("chr1: 1,000-2.000", {"chr1": 5000}) == ("chr1", 1000, 2000)
    for bad in ("chr1:5", "chr2:1-2", "chr1:1-9000"):
        with pytest.raises(ValueError):
            text.parse_place(bad, {"chr1": 5000})
    assert text.parse_genome_id("hg[chr1,chr2]") == ("hg", ["chr1", "chr2"]) and text.parse_genome_id("hg") == ("hg", [])
    assert text.short_id(["a/b c#1.bed", "x/b-c"]) == "b_c" and len(text.short_id(["n" * 300])) == 100
    assert text.short_id([f"GSM{i}_{'x' * 60}" for i in range(3)]) == "GSM0_GSM1_GSM2"


def test_named_tables(spark, tmp_path):

    built = []
    make = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert named.stored(spark, str(tmp_path), "t", {"a": 1}, make).count() == 3
    q = named.Named("n", make)
    assert q.get() is q.get() and len(built) == 2
    q.forget()


def test_command_line(spark, tmp_path):
    from spanweave import cli

    put(tmp_path, "loci.bed", "".join(f"chr1\t{i * 100}\t{i * 100 + 10}\n" for i in range(20)))
    (tmp_path / "sets").mkdir()
    put(tmp_path, "sets/a.bed", "chr1\t0\t1000\n")
    put(tmp_path, "sets/b.bed", "chr1\t50000\t50010\n")
    sizes = put(tmp_path, "sizes", "chr1\t100000\n")
    cli.run(["enrichment", "--loci", str(tmp_path / "loci.bed"), "--regions", str(tmp_path / "sets" / "*.bed"), "--chrom-sizes", sizes, "--simulations", "30", "--out", str(tmp_path / "out")], spark)
    got = {r.name: r for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).collect()}
    assert got["a.bed"].seen == "10" and float(got["a.bed"].p) < 0.1 and got["b.bed"].seen == "0"
    cli.run(["overlaps", "--loci", str(tmp_path / "loci.bed"), "--regions", str(tmp_path / "sets" / "*.bed"), "--out", str(tmp_path / "each")], spark)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "each")).count() == 40


def test_track_accessors(spark):
    from spanweave.operators import tracks

    t = annotations.tracks(spark, "tracks:\n  methylation:\n    od: {r1: a, r2: {path: b, failed: true}}\n  H3K4me3:\n    yd: [c]\n")
    assert sorted(r.cell for r in tracks.cells(t).collect()) == ["od", "yd"] and tracks.usable(t).count() == 2
    assert sorted(map(tuple, tracks.data_types(t).collect())) == [("H3K4me3", "chip-seq"), ("methylation", "methylation")]
    assert sorted(r.replicate for r in tracks.cell_ids(t, "METHYLATION").collect()) == ["r1", "r2"]


def test_builds_of_genomes(spark, tmp_path):
    text = "version: 7\ngenomes:\n  xx1:\n    species: X y\n    gtf: a.gtf\n    sequence: a.2bit\n    chromsizes: a.sizes\n    aliases: [p, q]\n    chr_alt_name_to_canonical:\n      - MT: chrM\n"
    rows = {tuple(r) for r in annotations.builds(spark, text).collect()}
    assert {("xx1", "aliases", "p"), ("xx1", "aliases", "q"), ("xx1", "chrom:MT", "chrM"), ("xx1", "gtf", "a.gtf")} < rows and len(rows) == 7
    assert {tuple(r) for r in annotations.builds(spark, annotations.builds_text(annotations.builds(spark, text))).collect()} == rows
    for bad in (text.replace("7", "6"), text.replace("    gtf: a.gtf\n", "")):
        with pytest.raises(ValueError):
            annotations.builds(spark, bad)
    path = put(tmp_path, "b.yaml", text.replace("7", "6"))
    assert {tuple(r) for r in annotations.read_builds(spark, path, text).collect()} == rows and (tmp_path / "b.yaml.version-6").exists()
    assert {tuple(r) for r in annotations.read_builds(spark, path, "version: 7").collect()} == rows


def test_arrays_have_no_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5, True), (2, "bé", -1.0, False)], "i int, s string, d double, f boolean")
    typed_csv.write_npz(df.repartition(2), str(tmp_path / "x.npz"))
    assert sorted(map(tuple, typed_csv.load(spark, str(tmp_path / "x.npz")).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="nulls"):
        typed_csv.write_npz(spark.createDataFrame([(None,)], "i int"), str(tmp_path / "y.npz"))
