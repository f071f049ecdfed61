"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add

_MET = "a.chrom = b.chrom AND a.strand = b.strand AND a.start < b.stop AND b.start < a.stop"


def _merge_sql(source: str, keys: str = "chrom, strand") -> str:
    return (
        f"SELECT {keys}, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY start, stop, new DESC ROWS UNBOUNDED PRECEDING) AS island FROM "
        f"(SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY {keys} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {source})) GROUP BY {keys}, island"
    )


_M = {"ml": _merge_sql("loci"), "mr": _merge_sql("regions")}
_PAIRS = f"SELECT a.id, b.id AS b_id, greatest(a.start, b.start) AS i_start, least(a.stop, b.stop) AS i_stop FROM loci a JOIN regions b ON {_MET}"

add("range_distance", "regions", lambda r: r.select("id", iv.distance(F.col("start"), F.col("stop"), F.lit(500000), F.lit(500500)).cast("long").alias("distance")),
    "SELECT id, CASE WHEN stop > 500000 AND start < 500500 THEN 0 ELSE least(abs(start - 500500), abs(stop - 500000)) END AS distance FROM regions")
add("range_hull", "regions", lambda r: r.select("id", *[c.alias(n) for c, n in zip(iv.hull(F.col("start"), F.col("stop"), F.lit(500000), F.lit(500500)), ("low", "high"))]), "SELECT id, least(start, 500000) AS low, greatest(stop, 500500) AS high FROM regions")
add("slice_bins", "regions", lambda r: iv.slices(r, 64).select("id", "bin_start", "bin_stop"), "SELECT id, s AS bin_start, least(s + 64, stop) AS bin_stop FROM (SELECT *, unnest(range(start, stop, 64)) AS s FROM regions)")
add("merge_overlaps", "regions", iv.merged, "SELECT * FROM mr", mr=_M["mr"])
add("interval_union", "loci regions", iv.union, "SELECT * FROM m", u="SELECT chrom, strand, start, stop FROM loci UNION ALL SELECT chrom, strand, start, stop FROM regions", m=_merge_sql("u"))
add("overlap", "loci regions", lambda a, b: iv.overlapping(a, b).select("id", "chrom", "strand", "start", "stop"), f"SELECT id, chrom, strand, start, stop FROM loci a WHERE EXISTS (SELECT 1 FROM regions b WHERE {_MET})")
add("overlap_flank", "loci regions", lambda a, b: iv.overlapping(a, b, 100).select("id", "start"),
    "SELECT id, start FROM loci a WHERE EXISTS (SELECT 1 FROM regions b WHERE a.chrom = b.chrom AND a.strand = b.strand AND greatest(a.start - 100, 0) < b.stop AND b.start < a.stop + 100)")
add("intersect_pairs", "loci regions", lambda a, b: iv.intersections(a, b).select("id", "b_id", "i_start", "i_stop"), "SELECT * FROM p WHERE i_start < i_stop", p=_PAIRS)
add("intersect_flank", "loci regions", lambda a, b: iv.intersections(a, b, 100).select("id", "b_id", "i_start", "i_stop"), "SELECT * FROM p WHERE i_start < i_stop",
    f="SELECT id, chrom, strand, greatest(start - 100, 0) AS start, stop + 100 AS stop FROM loci", p=_PAIRS.replace("FROM loci a", "FROM f a"))
add("contains", "loci regions", lambda a, b: iv.within(a, iv.merged(b)).select("id", "start", "stop"),
    "SELECT id, start, stop FROM loci a WHERE EXISTS (SELECT 1 FROM mr b WHERE a.chrom = b.chrom AND a.strand = b.strand AND b.start <= a.start AND a.stop <= b.stop)", mr=_M["mr"])
add("intersection_length", "loci regions", lambda a, b: iv.intersections(a, iv.merged(b)).groupBy("id").agg(F.sum(F.col("i_stop") - F.col("i_start")).alias("bases")),
    "SELECT id, cast(sum(i_stop - i_start) AS bigint) AS bases FROM p WHERE i_start < i_stop GROUP BY id", mr=_M["mr"], p=_PAIRS.replace("b.id AS b_id, ", "").replace("regions b", "mr b"))
_UNIVERSE = "SELECT chrom, strand, length FROM genome CROSS JOIN (VALUES ('+'), ('-')) s(strand)"


def _universe(g):
    return g.select("chrom", "length", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))


add("complement", "regions genome", lambda r, g: iv.complement(iv.merged(r), _universe(g)),
    "SELECT chrom, strand, gap_start AS start, start AS stop FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY chrom, strand ORDER BY start, stop), 0) AS gap_start FROM e) WHERE gap_start < start",
    mr=_M["mr"], u=_UNIVERSE, e="SELECT chrom, strand, start, stop FROM mr UNION ALL SELECT chrom, strand, length, length FROM u")
add("subtract", "regions loci", lambda r, l: iv.subtract(r, l, "id").select("id", "start", "stop"),
    "SELECT id, g AS start, h AS stop FROM (SELECT id, coalesce(lag(h1) OVER w, a0) AS g, h0 AS h FROM c WINDOW w AS (PARTITION BY id ORDER BY h0) UNION ALL SELECT id, max(h1), max(a1) FROM c GROUP BY id "
    "UNION ALL SELECT id, start, stop FROM regions WHERE id NOT IN (SELECT id FROM c)) WHERE g < h",
    ml=_M["ml"], c=f"SELECT a.id, a.start AS a0, a.stop AS a1, greatest(a.start, b.start) AS h0, least(a.stop, b.stop) AS h1 FROM regions a JOIN ml b ON {_MET}")
add("intersect_merged", "loci regions", lambda a, b: iv.merged(iv.intersections(iv.merged(a), iv.merged(b)).select("chrom", "strand", F.col("i_start").alias("start"), F.col("i_stop").alias("stop"))), "SELECT * FROM m",
    **_M, i=f"SELECT a.chrom, a.strand, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM ml a JOIN mr b ON {_MET}", m=_merge_sql("i"))
add("both_strands", "loci regions", lambda a, b: iv.overlapping(a, b.select("chrom", "start", "stop"), keys=("chrom",)).select("id", "start"),
    "SELECT id, start FROM loci a WHERE EXISTS (SELECT 1 FROM regions b WHERE a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop)")
add("metric_overlap", "loci regions", lambda a, b: iv.overlapping(a, b).groupBy("chrom", "strand").agg(F.count("*").alias("overlap")), f"SELECT chrom, strand, count(*) AS overlap FROM loci a WHERE EXISTS (SELECT 1 FROM regions b WHERE {_MET}) GROUP BY 1, 2")
add("metric_intersection_number", "loci regions", iv.intersection_number, "SELECT count(*) AS intersection_number FROM p WHERE i_start < i_stop", p=_PAIRS)
add("metric_overlap_fraction", "loci regions", lambda a, b: iv.overlap_fraction(a, b).select(F.round("overlap_fraction", 6).alias("overlap_fraction")),
    f"SELECT round((SELECT count(*) FROM loci a WHERE EXISTS (SELECT 1 FROM regions b WHERE {_MET})) / (SELECT count(*)::double FROM loci), 6) AS overlap_fraction")
add("metric_jaccard", "loci regions", lambda a, b: iv.jaccard(a, b).select(F.round("jaccard", 6).alias("jaccard")), "SELECT round(i::double / (la + lb - i), 6) AS jaccard FROM s", **_M,
    s=f"SELECT (SELECT sum(stop - start) FROM ml) AS la, (SELECT sum(stop - start) FROM mr) AS lb, (SELECT sum(least(a.stop, b.stop) - greatest(a.start, b.start)) FROM ml a JOIN mr b ON {_MET}) AS i")
add("metric_matrix", "loci regions", lambda a, b: iv.metric_matrix(a.select("id", "chrom", "strand", "start", "stop", (F.col("score") % 3).alias("a_set")), b.withColumnRenamed("name", "b_set"), "a_set", "b_set"),
    f"SELECT s.a_set, t.b_set, count(h.a_set) AS value FROM (SELECT DISTINCT score % 3 AS a_set FROM loci) s CROSS JOIN (SELECT DISTINCT name AS b_set FROM regions) t LEFT JOIN h ON h.a_set = s.a_set AND h.b_set = t.b_set GROUP BY 1, 2",
    h=f"SELECT a.score % 3 AS a_set, n.name AS b_set FROM loci a, (SELECT DISTINCT name FROM regions) n WHERE EXISTS (SELECT 1 FROM regions b WHERE b.name = n.name AND {_MET})")
add("bit_runs", "loci", lambda l: iv.runs(l, ("chrom",), "start", 0), "SELECT chrom, min(start) AS start, max(start) + 1 AS stop FROM i GROUP BY chrom, island",
    i="SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS island FROM (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY chrom ORDER BY start) > 1 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT chrom, start FROM loci))")
add("bit_runs_gap", "loci", lambda l: iv.runs(l, ("chrom",), "start", 20), "SELECT chrom, min(start) AS start, max(start) + 1 AS stop FROM i GROUP BY chrom, island",
    i="SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS island FROM (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY chrom ORDER BY start) > 21 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT chrom, start FROM loci))")
for _name, _anchor, _l, _r, _plus, _minus in (
    ("relative_five_prime", "five", -500, 200, ("start - 500", "start + 200"), ("stop - 200", "stop + 500")),
    ("relative_three_prime", "three", -500, 200, ("stop - 501", "stop + 199"), ("start - 199", "start + 501")),
    ("relative_all", "all", -500, 200, ("start - 500", "stop + 199"), ("start - 199", "stop + 500")),
):
    add(_name, "regions genome", lambda r, g, a=_anchor, l=_l, h=_r: iv.relative(r.join(F.broadcast(g), "chrom"), a, l, h).select("id", "w_start", "w_stop"),
        f"SELECT id, greatest(0, least(length, CASE strand WHEN '+' THEN {_plus[0]} ELSE {_minus[0]} END)) AS w_start, greatest(0, least(length, CASE strand WHEN '+' THEN {_plus[1]} ELSE {_minus[1]} END)) AS w_stop FROM regions JOIN genome USING (chrom)")
add("bounds", "regions", lambda r: r.select("id", iv.bound5().alias("five"), iv.bound3().alias("three"), iv.bound5(10).alias("inside")),
    "SELECT id, CASE strand WHEN '+' THEN start ELSE stop - 1 END AS five, CASE strand WHEN '+' THEN stop - 1 ELSE start END AS three, CASE strand WHEN '+' THEN start + 10 ELSE stop - 11 END AS inside FROM regions")
