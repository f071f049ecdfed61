"""Queries of nearest neighbours, coverage, methylation, transcripts and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import chunks as ch
from ..operators import coverage as cv
from ..operators import methylome as me
from ..operators import nearest as nn
from ..operators import search as se
from ..operators import tracks as tk
from ..operators import transcripts as tr
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add

# ---- nearest ----------------------------------------------------------------------------

_TSS = "SELECT chrom, CASE strand WHEN '+' THEN start ELSE stop - 1 END AS pos, tid, strand FROM transcripts"
_MID = "SELECT id, chrom, (start + stop) // 2 AS mid FROM regions"
_N = {"tss": _TSS, "q": _MID}
_LR = "SELECT q.*, (SELECT max(pos) FROM tss WHERE tss.chrom = q.chrom AND pos < mid) AS l, (SELECT min(pos) FROM tss WHERE tss.chrom = q.chrom AND pos > mid) AS r FROM q"
add("nearest_tss", "regions transcripts", lambda r, t: nn.associated_single(r, nn.starts(t)), "SELECT id, tid FROM q JOIN tss USING (chrom) WHERE abs(pos - mid) = (SELECT min(abs(pos - mid)) FROM tss s WHERE s.chrom = q.chrom) AND abs(pos - mid) < 1000000", **_N)
add("two_nearest", "regions transcripts", lambda r, t: nn.associated_two(r, nn.starts(t)),
    "SELECT id, tid FROM (SELECT id, tid, row_number() OVER (PARTITION BY id ORDER BY pos DESC, tid) AS k FROM lr JOIN tss USING (chrom) WHERE pos IN (l, r, mid) AND abs(pos - mid) <= 1000000) WHERE k <= 2", **_N, lr=_LR)
add("multiple_genes", "regions transcripts genome", lambda r, t, g: nn.associated_multiple(r, nn.starts(t), g),
    "SELECT id, tid FROM m JOIN tss USING (chrom) WHERE pos >= coalesce((SELECT max(pos) FROM tss s WHERE s.chrom = m.chrom AND s.pos < ml), 0) AND pos <= coalesce((SELECT min(pos) FROM tss s WHERE s.chrom = m.chrom AND s.pos > mr), 100000000) AND abs(pos - mid) <= 1000000",
    **_N, m="SELECT q.*, greatest(0, mid - 50000) AS ml, least(length, mid + 50000) AS mr FROM q JOIN genome USING (chrom)")
add("within_distance", "regions transcripts", lambda r, t: nn.within_distance(nn.midpoints(r).select("id", "chrom", "mid"), nn.starts(t), 1000, 300).select("id", F.col("b_tid").alias("tid")), "SELECT id, tid FROM q JOIN tss USING (chrom) WHERE pos BETWEEN mid - 1000 AND mid + 300", **_N)
add("basal_extension", "regions transcripts", lambda r, t: nn.associated_basal(r, nn.starts(t)),
    "SELECT id, tid FROM basal UNION ALL SELECT id, tid FROM e JOIN tss USING (chrom) WHERE (tss.strand = '+' AND ((pos = pl AND pos + 1000 = lb) OR (pos = pr AND pos - 5000 = rb))) OR (tss.strand = '-' AND ((pos = ml AND pos + 5000 = lb) OR (pos = mr AND pos - 1000 = rb)))",
    **_N, basal="SELECT id, tid FROM q JOIN tss USING (chrom) WHERE (strand = '+' AND pos - mid BETWEEN -1000 AND 5000) OR (strand = '-' AND pos - mid BETWEEN -5000 AND 1000)",
    f="SELECT q.*, " + ", ".join(f"(SELECT {f}(pos) FROM tss WHERE tss.chrom = q.chrom AND strand = '{s}' AND pos {o} mid) AS {n}" for n, f, s, o in (("pl", "max", "+", "<"), ("pr", "min", "+", ">"), ("ml", "max", "-", "<"), ("mr", "min", "-", ">"))) + " FROM q WHERE id NOT IN (SELECT id FROM basal)",
    b="SELECT *, CASE WHEN pl + 1000 < mid THEN pl + 1000 END AS a1, CASE WHEN ml + 5000 < mid THEN ml + 5000 END AS a2, CASE WHEN pr - 5000 > mid THEN pr - 5000 END AS b1, CASE WHEN mr - 1000 > mid THEN mr - 1000 END AS b2 FROM f",
    e="SELECT *, CASE WHEN a1 IS NULL OR a2 IS NULL THEN coalesce(a1, a2) WHEN mid - greatest(a1, a2) <= 1000000 THEN greatest(a1, a2) END AS lb, CASE WHEN b1 IS NULL OR b2 IS NULL THEN coalesce(b1, b2) WHEN least(b1, b2) - mid <= 1000000 THEN least(b1, b2) END AS rb FROM b")
add("great_distance", "regions transcripts", lambda r, t: nn.nearest(nn.midpoints(r).select("id", "chrom", "mid"), nn.starts(t)).groupBy("id").agg(F.min(nn.great_distance(F.col("mid"), F.col("pos"))).alias("distance")),
    "SELECT id, min(abs(pos - mid)) AS distance FROM q JOIN tss USING (chrom) GROUP BY id", **_N)

# ---- coverage ---------------------------------------------------------------------------

_RAW = "SELECT chrom, strand, CASE strand WHEN '+' THEN start ELSE stop - 1 END AS pos FROM reads"
_TAGS = {"raw": _RAW, "tags": "SELECT DISTINCT * FROM raw"}
add("coverage_single", "regions reads", lambda r, x: cv.counts(r, cv.single_tags(x), 150).select("id", "coverage"),
    "SELECT id, count(pos) AS coverage FROM regions a LEFT JOIN tags t ON a.chrom = t.chrom AND a.strand = t.strand AND pos >= start - CASE a.strand WHEN '+' THEN 75 ELSE -75 END AND pos < stop - CASE a.strand WHEN '+' THEN 75 ELSE -75 END GROUP BY id", **_TAGS)
add("coverage_both", "regions reads", lambda r, x: cv.counts(r, cv.single_tags(x, False), 0, True).select("id", "coverage"), "SELECT id, count(pos) AS coverage FROM regions a LEFT JOIN raw t ON a.chrom = t.chrom AND pos >= start AND pos < stop GROUP BY id", raw=_RAW)
_PAIR = "SELECT chrom, least(start, mate) AS a, greatest(start, mate) + 50 - least(start, mate) AS size FROM reads"
_PTAGS = {"pairs": _PAIR, "tags": "SELECT chrom, '+' AS strand, a + size // 2 AS pos FROM pairs WHERE size <= 500"}


def _pairs(x):
    return x.select("chrom", F.col("start").alias("pos"), "mate", F.lit(50).cast("long").alias("length"))


add("paired_tags", "reads", lambda x: cv.paired_tags(_pairs(x), False)[0], "SELECT * FROM tags", **_PTAGS)
add("paired_fragment", "reads", lambda x: cv.paired_tags(_pairs(x))[1], "SELECT count(*) AS pairs, cast(sum(size) // count(*) AS bigint) AS fragment FROM pairs WHERE size <= 500", pairs=_PAIR)
add("coverage_paired", "regions reads", lambda r, x: cv.counts(r, cv.paired_tags(_pairs(x))[0]).select("id", "coverage"),
    "SELECT id, count(DISTINCT pos) AS coverage FROM regions a LEFT JOIN tags t ON a.chrom = t.chrom AND a.strand = t.strand AND pos >= start AND pos < stop GROUP BY id", **_PTAGS)
add("unique_tags", "reads", cv.single_tags, "SELECT * FROM tags", **_TAGS)
add("depth", "reads", lambda x: cv.depth(cv.single_tags(x)), "SELECT count(*) AS depth FROM tags", **_TAGS)
_CC = {
    **_TAGS, "s": "SELECT chrom, sum((strand = '+')::int)::double AS np, sum((strand = '-')::int)::double AS nm, any_value(length)::double AS lc FROM tags JOIN genome USING (chrom) GROUP BY chrom",
    "m": "SELECT p.chrom, n.pos - p.pos AS d, count(*) AS m FROM tags p JOIN tags n ON p.chrom = n.chrom AND p.strand = '+' AND n.strand = '-' AND n.pos - p.pos BETWEEN 75 AND 500 GROUP BY 1, 2",
    "v": "SELECT f AS fragment, sum((np + nm) * coalesce((lc * coalesce(m, 0) - np * nm) / nullif(sqrt(np * (lc - np) * nm * (lc - nm)), 0), 0)) / sum(np + nm) AS value FROM s CROSS JOIN range(75, 501) r(f) LEFT JOIN m ON m.chrom = s.chrom AND m.d = f GROUP BY f",
}
add("cross_correlation", "reads genome", lambda x, g: cv.cross_correlation(cv.single_tags(x), g, 50).select("fragment", F.round("value", 8).alias("value")), "SELECT fragment, round(value, 8) AS value FROM v", **_CC)
add("fragment_size", "reads genome", lambda x, g: cv.fragment_size(cv.single_tags(x), g, 50), "SELECT fragment FROM v ORDER BY value DESC, fragment LIMIT 1", **_CC)
add("peaks_info", "regions genome", lambda r, g: cv.peaks_info(r, g).withColumn("share", F.round("share", 6)),
    "SELECT count(*) AS count, cast(sum(n) AS bigint) AS total, round(sum(n)::double / (SELECT sum(length) FROM genome), 6) AS share, min(n) AS least, max(n) AS most, cast(floor(avg(n)) AS bigint) AS mean, cast(floor(median(n)) AS bigint) AS median FROM (SELECT stop - start AS n FROM regions)")
add("frip", "regions reads genome", lambda r, x, g: cv.frip(r, g, [cv.single_tags(x), cv.single_tags(x, False)]).select(F.round("frip", 6).alias("frip")),
    "SELECT round(((SELECT count(*) FROM regions a JOIN tags t ON a.chrom = t.chrom AND pos >= start AND pos < stop) / (SELECT count(*)::double FROM tags) + (SELECT count(*) FROM regions a JOIN raw t ON a.chrom = t.chrom AND pos >= start AND pos < stop) / (SELECT count(*)::double FROM raw)) / 2, 6) AS frip", **_TAGS)
_HIST = "SELECT stop - start AS value, count(*) AS n FROM regions GROUP BY 1"


def _hist(r):
    return cv.histogram(r, F.col("stop") - F.col("start"))


add("histogram", "regions loci", lambda r, l: cv.add_histograms(_hist(r), _hist(l)), "SELECT value, count(*) AS n FROM (SELECT stop - start AS value FROM regions UNION ALL SELECT stop - start FROM loci) GROUP BY 1")
add("hist_stats", "regions", lambda r: cv.histogram_stats(_hist(r)).select("count", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev")), "SELECT count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev FROM (SELECT (stop - start)::double AS v FROM regions)")
add("hist_median", "regions", lambda r: cv.histogram_median(_hist(r)), "SELECT min(value) AS median FROM (SELECT value, sum(n) OVER (ORDER BY value) AS c, (SELECT sum(n) FROM h) AS t FROM h) WHERE 2 * c > t", h=_HIST)
add("stdev", "regions", lambda r: r.groupBy("chrom").agg(F.round(F.stddev_samp(F.col("stop") - F.col("start")), 6).alias("stdev")), "SELECT chrom, round(stddev_samp(stop - start), 6) AS stdev FROM regions GROUP BY 1")

# ---- methylation ------------------------------------------------------------------------

_METH = "SELECT chrom, strand, pos, tag, least(k, 32767) AS k, least(n, 32767) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY arrival, strand, tag, k, n) AS i FROM methyl WHERE n > 0) WHERE i = 1"
add("methylome_build", "methyl", me.build, "SELECT * FROM m", m=_METH)
add("methylome_duplicates", "methyl", me.duplicates, "SELECT chrom, count(*) - count(DISTINCT pos) AS duplicates FROM methyl WHERE n > 0 GROUP BY 1")
add("methylome_peel", "methyl", lambda d: me.peel(me.build(d)).withColumn("level", F.round(F.col("level").cast("double"), 5)), "SELECT chrom, pos, tag, round(((k::float) / (n::float))::double, 5) AS level, k, n, strand = '+' AS strand FROM m", m=_METH)
add("methylome_frame", "methyl", lambda d: me.frame(me.build(d), "+", 1), "SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 2147483647) AS d FROM m WHERE strand = '+' AND tag = 1", m=_METH)
add("methylome_distance", "methyl", lambda d: me.frame(me.build(d)), "SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 2147483647) AS d FROM m", m=_METH)


def _two(d):
    m = me.build(d)
    return me.joined([me.frame(m.where("chrom = 'chr1'")), me.frame(m.where("chrom = 'chr2'"))])


add("methylome_join", "methyl", _two, "SELECT a.pos, a.tag, a.strand, a.k AS k1, a.n AS n1, a.d AS d1, b.k AS k2, b.n AS n2, b.d AS d2 FROM f a JOIN f b USING (pos) WHERE a.chrom = 'chr1' AND b.chrom = 'chr2'",
    m=_METH, f="SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 2147483647) AS d FROM m")

# ---- transcripts ------------------------------------------------------------------------

_SEG = "(stop - start) {div} (2 * exons - 1)"


def _model(t):
    """Transcripts with exon arrays: equal parts with gaps of the same size between."""
    seg = F.expr(f"({_SEG.format(div='div')})")
    ex = F.transform(F.sequence(F.lit(0).cast("long"), F.col("exons") - 1), lambda i: F.struct((F.col("start") + 2 * i * seg).alias("start"), F.when(i == F.col("exons") - 1, F.col("stop")).otherwise(F.col("start") + (2 * i + 1) * seg).alias("stop")))
    cds = F.when(F.col("coding"), F.struct(F.expr("start + (stop - start) div 10").alias("start"), F.expr("stop - (stop - start) div 8").alias("stop")))
    m = t.withColumn("exons", ex).withColumn("cds", cds)
    return m.withColumn("utr3", F.when(F.col("strand") == "+", F.col("cds.stop")).otherwise(F.col("cds.start") - 1))


_EX = f"SELECT tid, chrom, strand, start AS t0, stop AS t1, coding, start + 2 * i * seg AS start, CASE WHEN i = exons - 1 THEN stop ELSE start + (2 * i + 1) * seg END AS stop, start + (stop - start) // 10 AS c0, stop - (stop - start) // 8 AS c1 FROM (SELECT *, {_SEG.format(div='//')} AS seg, unnest(range(exons)) AS i FROM transcripts)"
_CUT = "SELECT tid, chrom, strand, greatest(start, {0}) AS start, least(stop, {1}) AS stop FROM ex WHERE coding AND greatest(start, {0}) < least(stop, {1})"
add("exons", "transcripts", lambda t: tr.exons(_model(t)), "SELECT tid, chrom, strand, start, stop FROM ex", ex=_EX)
add("cds", "transcripts", lambda t: tr.cds(_model(t)), _CUT.format("c0", "c1"), ex=_EX)
add("utr5", "transcripts", lambda t: tr.utr5(_model(t)), _CUT.format("CASE strand WHEN '+' THEN t0 ELSE c1 END", "CASE strand WHEN '+' THEN c0 ELSE t1 END"), ex=_EX)
add("utr3", "transcripts", lambda t: tr.utr3(_model(t)), _CUT.format("CASE strand WHEN '+' THEN c1 ELSE t0 END", "CASE strand WHEN '+' THEN t1 ELSE c0 END"), ex=_EX)
add("introns", "transcripts", lambda t: tr.introns(_model(t)), "SELECT tid, chrom, strand, p AS start, start AS stop FROM (SELECT *, lag(stop) OVER (PARTITION BY tid ORDER BY start) AS p FROM ex) WHERE p < start", ex=_EX)
for _k, _p, _m in (("tss", ("start - 2000", "start + 2000"), ("stop - 2000", "stop + 2000")), ("tes[-500..100]", ("stop - 501", "stop + 99"), ("start - 99", "start + 501"))):
    add(_k[:3], "transcripts genome", lambda t, g, k=_k: tr.parse_locus(k)[1](t.join(F.broadcast(g), "chrom")),
        f"SELECT tid, chrom, strand, least(length, greatest(0, CASE strand WHEN '+' THEN {_p[0]} ELSE {_m[0]} END)) AS start, least(length, greatest(0, CASE strand WHEN '+' THEN {_p[1]} ELSE {_m[1]} END)) AS stop FROM transcripts JOIN genome USING (chrom)")
add("gene_class", "transcripts", lambda t: tr.of_class(_model(t), "NON_CODING").select("tid", "gid"), "SELECT tid, gid FROM transcripts WHERE NOT coding")
add("genes", "transcripts", tr.genes, "SELECT gid, chrom, min(start) AS start, max(stop) AS stop, arg_min(symbol, tid) AS symbol, count(*) AS transcripts FROM transcripts GROUP BY 1, 2")
add("longest_transcript", "transcripts", tr.longest, "SELECT gid, tid, size FROM (SELECT gid, tid, stop - start AS size, row_number() OVER (PARTITION BY gid ORDER BY stop - start DESC, tid) AS i FROM transcripts) WHERE i = 1")
add("alias_lookup", "transcripts supplier", lambda t, s: tr.resolve(s.select(F.concat(F.lit(" brand#"), F.expr("11 + s_suppkey % 5")).alias("name")).distinct(), t).select("name", "kind", "tid", "first"),
    "SELECT name, kind, tid, tid = min(tid) OVER (PARTITION BY name) AS first FROM n JOIN a ON upper(trim(name)) = alias",
    n="SELECT DISTINCT concat(' brand#', 11 + s_suppkey % 5) AS name FROM supplier",
    a="SELECT upper(trim(symbol)) AS alias, 'symbol' AS kind, tid FROM transcripts UNION ALL SELECT tid::varchar, 'transcript', tid FROM transcripts UNION ALL SELECT upper(trim(gid)), 'gene', tid FROM transcripts")
add("chrom_aliases", "genome", tr.chromosome_aliases, "SELECT chrom, chrom AS alias FROM genome UNION ALL SELECT chrom, replace(chrom, 'chr', '') FROM genome")

# ---- sequences --------------------------------------------------------------------------

add("revcomp", "sequences", lambda s: s.select("id", sq.reverse_complement(F.col("seq")).alias("rc")), "SELECT id, reverse(translate(seq, 'acgt', 'tgca')) AS rc FROM sequences")
add("subsequence", "sequences", lambda s: s.select("id", sq.subsequence(F.col("seq"), F.lit(3), F.lit(40), F.when(F.col("id") % 2 == 0, "+").otherwise("-")).alias("part")),
    "SELECT id, CASE WHEN id % 2 = 0 THEN substr(seq, 4, 37) ELSE reverse(translate(substr(seq, 4, 37), 'acgt', 'tgca')) END AS part FROM sequences")
#: Sequences whole, and in chunks that cut bins, windows and matches.
_CUTS = (("", lambda s, halo: s), ("_chunks", lambda s, halo: ch.haloed(ch.chunked(s, 97), halo)))
add("gc_bins", "sequences", lambda s: sq.gc_bins(s, 100).select("id", "bin", F.round("gc", 6).alias("gc")), "SELECT id, bin, round(length(regexp_replace(p, '[^cg]', '', 'g'))::double / length(p), 6) AS gc FROM (SELECT id, b AS bin, substr(seq, b + 1, 100) AS p FROM (SELECT *, unnest(range(0, length(seq), 100)) AS b FROM sequences))")
add("gc_bins_chunks", "sequences", lambda s: sq.gc_bins_of_chunks(ch.chunked(s, 97), 100).select("id", "bin", F.round("gc", 6).alias("gc")), "SELECT id, bin, round(length(regexp_replace(p, '[^cg]', '', 'g'))::double / length(p), 6) AS gc FROM (SELECT id, b AS bin, substr(seq, b + 1, 100) AS p FROM (SELECT *, unnest(range(0, length(seq), 100)) AS b FROM sequences))")
add("cpg_count", "sequences", lambda s: s.select("id", sq.count_cg(F.col("seq")).cast("long").alias("cg"), sq.count_cpg("seq").cast("long").alias("cpg")),
    "SELECT id, length(regexp_replace(seq, '[^cg]', '', 'g')) AS cg, length(list_filter(range(1, length(seq)), lambda i: substr(seq, i, 2) IN ('cg', 'gc'))) AS cpg FROM sequences")
for _name, _kinds in (("", lambda s: s.select("id", sq.cpg_class()("seq").alias("kind"))), ("_chunks", lambda s: sq.cpg_classes(ch.haloed(ch.chunked(s, 97), 499)))):
    add(f"cpg_class{_name}", "sequences", lambda s, kinds=_kinds: kinds(s.where(F.length("seq") >= 500)),
        "SELECT id, CASE WHEN bool_or(cg / 500.0 >= 0.55 AND oe >= 0.6) THEN 'HCP' WHEN max(oe) < 0.4 THEN 'LCP' ELSE 'ICP' END AS kind FROM (SELECT id, cg, CASE WHEN cg > 0 THEN 2.0 * cpg / cg ELSE 0 END AS oe FROM w WHERE i >= 500) GROUP BY id",
        p="SELECT id, unnest(range(1, length(seq) + 1)) AS i, seq FROM sequences WHERE length(seq) >= 500",
        w="SELECT id, i, sum((substr(seq, i, 1) IN ('c', 'g'))::int) OVER (PARTITION BY id ORDER BY i ROWS 499 PRECEDING) AS cg, sum((i > 1 AND substr(seq, i - 1, 2) IN ('cg', 'gc'))::int) OVER (PARTITION BY id ORDER BY i ROWS 498 PRECEDING) AS cpg FROM p")
add("cytosine_context", "sequences", lambda s: s.where(F.length("seq") > 0).select("id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)).alias("i")).select("id", F.col("i").cast("long").alias("place"), me.cytosine_context(F.col("seq"), F.col("i")).alias("context")).where("context IS NOT NULL"),
    "SELECT * FROM (SELECT id, place, CASE WHEN x = 'c' THEN CASE WHEN y = 'g' THEN 'CG' WHEN y <> '' AND z = 'g' THEN 'CHG' WHEN y <> '' AND z <> '' THEN 'CHH' END WHEN x = 'g' THEN CASE WHEN u = 'c' THEN 'CG' WHEN u <> '' AND v = 'c' THEN 'CHG' WHEN u <> '' AND v <> '' THEN 'CHH' END END AS context FROM b) WHERE context IS NOT NULL",
    b="SELECT id, place, substr(seq, place + 1, 1) AS x, substr(seq, place + 2, 1) AS y, substr(seq, place + 3, 1) AS z, CASE WHEN place >= 1 THEN substr(seq, place, 1) ELSE '' END AS u, CASE WHEN place >= 2 THEN substr(seq, place - 1, 1) ELSE '' END AS v FROM (SELECT id, seq, unnest(range(length(seq))) AS place FROM sequences)")
add("exact_search", "sequences", lambda s: se.exact(s, "tat"), "SELECT id, p AS pos FROM (SELECT id, seq, unnest(range(length(seq) - 2)) AS p FROM sequences) WHERE substr(seq, p + 1, 3) = 'tat'")
for _name, _cut in _CUTS:
    add(f"kmismatch_search{_name}", "sequences", lambda s, cut=_cut: se.search(cut(s, 6), ["acgtat", "ttnaca"], 1),
        "SELECT id, pattern, p AS pos, strand FROM c, q WHERE p + 6 < length(seq) AND list_sum(list_transform(range(1, 7), lambda j: CASE WHEN substr(w, j, 1) = 'n' OR substr(w, j, 1) = substr(seq, p + j, 1) THEN 0 ELSE 1 END)) <= 1",
        q="SELECT pattern, strand, CASE strand WHEN '+' THEN pattern ELSE reverse(translate(pattern, 'acgt', 'tgca')) END AS w FROM (VALUES ('acgtat'), ('ttnaca')) v(pattern), (VALUES ('+'), ('-')) s(strand)",
        c="SELECT id, seq, unnest(range(length(seq) - 6)) AS p FROM sequences WHERE length(seq) > 6")
add("peaks_report", "regions genome", lambda r, g: tk.report(cv.peaks_info(r, g).select("count", "total", "most")), "SELECT unnest(['count', 'total', 'most']) AS metric, unnest([n, t, m]) AS value FROM (SELECT count(*)::varchar AS n, cast(sum(stop - start) AS bigint)::varchar AS t, max(stop - start)::varchar AS m FROM regions)")
