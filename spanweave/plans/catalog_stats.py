"""Queries of tests, multiple-testing control and special functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hypothesis_tests as ts
from ..functions import text as tx
from ..operators import enrichment as en
from ..operators import intervals as iv
from ..operators import ontology as on
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


add("bh", "pvalues", lambda d: _round(ts.benjamini_hochberg(d), "q").select("id", "q"),
    "SELECT id, round(min(least(1.0, p * m / r)) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS r FROM pvalues)")
add("bh_log", "pvalues", lambda d: _round(ts.benjamini_hochberg(d.withColumn("p", F.log("p")), logs=True), "q").select("id", "q"),
    "SELECT id, round(min(least(0.0, ln(p) + ln(m) - ln(r))) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS r FROM pvalues)")
_RUN = "SELECT *, avg(p) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS mean, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM pvalues"
add("fdr_control", "pvalues", lambda d: ts.fdr_control(d.withColumn("logpep", F.log("p")), alpha=0.1).select("id", "rejected"), "SELECT id, mean <= 0.1 AND r < m AS rejected FROM run", run=_RUN)
add("pep_qvalues", "pvalues", lambda d: _round(ts.pep_qvalues(d.withColumn("logpep", F.log("p"))), "q").select("id", "q"), "SELECT id, round(min(mean) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING), 6) AS q FROM run", run=_RUN)
_LF = "SELECT *, a + b + c + d AS t, a + b AS kk, a + c AS nn FROM tables2x2"
_PMF = "exp(lgamma(kk + 1) - lgamma(x + 1) - lgamma(kk - x + 1) + lgamma(t - kk + 1) - lgamma(nn - x + 1) - lgamma(t - kk - nn + x + 1) - lgamma(t + 1) + lgamma(nn + 1) + lgamma(t - nn + 1))"
_EACH = f"SELECT id, a, x, {_PMF} AS p FROM (SELECT *, unnest(range(greatest(0, nn - t + kk), least(nn, kk) + 1)) AS x FROM lf)"
for _k, _c in (("less", "x <= a"), ("greater", "x >= a"), ("two_sided", "p <= (1 + 1e-7) * o")):
    add(f"fisher_{_k}", "tables2x2", lambda d, k=_k: _round(d.select("id", ts.fisher(k)("a", "b", "c", "d").alias("p")), "p"),
        f"SELECT id, round(least(1.0, sum(p)), 6) AS p FROM (SELECT *, max(CASE WHEN x = a THEN p END) OVER (PARTITION BY id) AS o FROM e) WHERE {_c} GROUP BY id", lf=_LF, e=_EACH)
add("log_factorial", "orders", lambda d: _round(d.select("o_orderkey", (F.col("o_custkey") % 300).alias("n")).withColumn("v", ts.log_factorial("n")), "v"), "SELECT o_orderkey, o_custkey % 300 AS n, round(lgamma(o_custkey % 300 + 1), 6) AS v FROM orders")
add("log_choose", "orders", lambda d: _round(d.select("o_orderkey", ts.log_choose(F.col("o_custkey") % 90 + 40, F.col("o_orderkey") % 40).alias("v")), "v"),
    "SELECT o_orderkey, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1), 6) AS v FROM (SELECT o_orderkey, o_custkey % 90 + 40 AS n, o_orderkey % 40 AS k FROM orders)")
add("log_add_exp", "pvalues", lambda d: _round(d.select("id", ts.log_add_exp(F.log("p"), F.lit(-3.5)).alias("v")), "v"), "SELECT id, round(ln(p + exp(-3.5)), 6) AS v FROM pvalues")
add("overlap_per_locus", "regions loci", en.overlap_per_locus,
    "SELECT a.id, a.chrom, a.start, a.stop, count(b.id) AS metric FROM regions a LEFT JOIN loci b ON a.chrom = b.chrom AND a.strand = b.strand AND a.start < b.stop AND b.start < a.stop GROUP BY ALL")


def _allowed(regions, transcripts, reads):
    """Bases of the background that are allowed and not masked, by chromosome."""
    base = iv.merged(regions, ("chrom",)).withColumn("id", F.concat_ws(":", "chrom", "start"))
    out = en.allowed_background(base, reads, iv.merged(transcripts, ("chrom",)))
    return out.groupBy("chrom").agg(F.sum(F.col("stop") - F.col("start")).alias("bases"))


_AT = "SELECT DISTINCT chrom, unnest(range(start, stop)) AS p FROM"
add("background_rules", "regions transcripts reads", _allowed, "SELECT chrom, count(*) AS bases FROM (SELECT * FROM b INTERSECT SELECT * FROM a EXCEPT SELECT * FROM m) GROUP BY chrom",
    b=f"{_AT} regions", a=f"{_AT} transcripts", m=f"{_AT} reads")
_EDGES = "SELECT DISTINCT n_nationkey + 100 AS child, n_regionkey AS parent FROM nation UNION SELECT s_suppkey + 1000, s_nationkey + 100 FROM supplier UNION SELECT s_suppkey + 1000, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def _edges(n, s):
    up = n.select((F.col("n_nationkey") + 100).cast("long").alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    low = s.select((F.col("s_suppkey") + 1000).alias("child"), (F.col("s_nationkey") + 100).cast("long").alias("parent"))
    skip = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") + 1000).alias("child"), F.col("n_regionkey").cast("long").alias("parent"))
    return up.unionAll(low).unionAll(skip).distinct()


add("dag_depth", "nation supplier", lambda n, s: on.depths(_edges(n, s)),
    "SELECT node, cast(max(depth) AS bigint) AS depth FROM d GROUP BY node", e=_EDGES,
    d="SELECT DISTINCT parent AS node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT child, 1 FROM e WHERE parent NOT IN (SELECT child FROM e) UNION SELECT b.child, 2 FROM e a JOIN e b ON b.parent = a.child WHERE a.parent NOT IN (SELECT child FROM e)")
add("ontology_associations", "part supplier", lambda p, s: on.associations(p.select(F.col("p_brand").alias("term"), F.lit(False).alias("obsolete")).distinct(), p.select(F.col("p_brand").alias("term"), F.col("p_type").alias("symbol"))).select("term", F.concat_ws("|", "symbols").alias("symbols")),
    "SELECT p_brand AS term, array_to_string(list_sort(list(DISTINCT upper(p_type))), '|') AS symbols FROM part GROUP BY 1")
add("is_input", "part", lambda p: p.select("p_partkey", F.lower("p_name").rlike("input|control|5").alias("input")), "SELECT p_partkey, regexp_matches(lower(p_name), 'input|control|5') AS input FROM part")
add("location_text", "regions", lambda r: r.select("id", tx.location_text(F.col("chrom"), F.col("strand"), F.col("start"), F.col("stop")).alias("text")).select("id", "text", tx.parse_location(F.col("text")).alias("l")).select("id", "text", "l.chrom", "l.strand", "l.start", "l.stop"),
    "SELECT id, concat(chrom, ':', strand, '[', start, ', ', stop, ')') AS text, chrom, strand, start, stop FROM regions")
add("number_text", "regions", lambda r: r.select("id", tx.long_number(F.col("start"), True).alias("text"), tx.percent_of(F.col("start"), F.col("stop")).alias("share")),
    "SELECT id, replace(format('{:,}', start), ',', ' ') AS text, round(100.0 * start / stop, 2) AS share FROM regions")
