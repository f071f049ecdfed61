"""Queries of the typed tabular operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame as fr
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add

_LINE = "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS _row FROM lineitem"
_PART = "SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS _row FROM part"


def _line(df):
    return fr.with_row(df, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _part(df):
    return fr.with_row(df, "p_partkey")


add("select_omit", "part", lambda d: fr.omit(fr.only(d, "p_size", "p_partkey", "p_name"), "p_name", "no_such"), "SELECT p_size, p_partkey FROM part")
add("with_column", "part", lambda d: fr.only(fr.rename(fr.with_column(fr.with_column(d, "p_size", F.col("p_size") * 2), "big", F.col("p_size") > 50), "p_brand", "brand"), "p_partkey", "brand", "p_size", "big"),
    "SELECT p_partkey, p_brand AS brand, p_size * 2 AS p_size, p_size * 2 > 50 AS big FROM part")
add("filter_all", "lineitem", lambda d: fr.where(d, fr.every(F.col("l_quantity") > 25, F.col("l_returnflag") == "N", ~(F.col("l_linestatus") == "F"))).select("l_orderkey", "l_linenumber", "l_quantity"),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N' AND NOT l_linestatus = 'F'")
add("filter_slice", "lineitem", lambda d: fr.where(_line(d), F.col("l_quantity") > 10, 100, 5000).select("_row", "l_orderkey", "l_quantity"),
    "SELECT _row, l_orderkey, l_quantity FROM t WHERE _row >= 100 AND _row < 5000 AND l_quantity > 10", t=_LINE)
add("filter_mask", "part", lambda d: (lambda r: fr.where_mask(r, fr.mask(r, F.col("p_size") > 20)))(_part(d)).select("_row", "p_partkey"), "SELECT _row, p_partkey FROM t WHERE p_size > 20", t=_PART)
add("iloc_step", "lineitem", lambda d: fr.iloc(_line(d), 3, 4000, 7).select("_row", "l_orderkey", "l_linenumber"), "SELECT _row, l_orderkey, l_linenumber FROM t WHERE _row >= 3 AND _row < 4000 AND (_row - 3) % 7 = 0", t=_LINE)
add("reorder_asc", "part", lambda d: fr.permutation(_part(d), "p_size"), "SELECT _row, row_number() OVER (ORDER BY p_size, _row) - 1 AS position FROM t", t=_PART)
add("reorder_desc", "part", lambda d: fr.permutation(_part(d), "p_size", True), "SELECT _row, row_number() OVER (ORDER BY p_size DESC, _row DESC) - 1 AS position FROM t", t=_PART)
add("reorder_bool", "part", lambda d: fr.permutation(_part(d).withColumn("flag", F.col("p_size") > 25), "flag", True), "SELECT _row, row_number() OVER (ORDER BY p_size > 25 DESC, _row) - 1 AS position FROM t", t=_PART)
add("resize_pad", "nation", lambda d: fr.resize(fr.with_row(d, "n_nationkey"), 40).select("_row", "n_nationkey", "n_name"),
    "SELECT i AS _row, coalesce(n_nationkey, 0) AS n_nationkey, n_name FROM range(40) r(i) LEFT JOIN t ON _row = i", t="SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS _row FROM nation")
add("resize_cut", "part", lambda d: fr.resize(_part(d), 100).select("_row", "p_partkey", "p_brand"), "SELECT _row, p_partkey, p_brand FROM t WHERE _row < 100", t=_PART)
add("row_as_double", "part", lambda d: fr.row_as_double(d.select("p_size", (F.col("p_size") > 20).alias("big"), "p_retailprice")).select(*[F.col("vector")[i].alias(f"v{i}") for i in range(3)]),
    "SELECT p_size::double AS v0, (CASE WHEN p_size > 20 THEN 1 ELSE 0 END)::double AS v1, p_retailprice AS v2 FROM part")

_BY_CUST = "SELECT o_custkey AS k, count(*) AS n, cast(min(o_orderkey) AS bigint) AS least FROM orders GROUP BY 1"
_CUST = "SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer"
_SUPP = "SELECT s_suppkey * 3 AS k, s_nationkey AS n, s_name AS name FROM supplier"


def _by_cust(o):
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def _cust(c):
    return c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("seg"))


def _supp(s):
    return s.select((F.col("s_suppkey") * 3).alias("k"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"))


_THREE = {"a": _BY_CUST, "b": _CUST, "c": _SUPP}
add("merge_inner2", "orders customer", lambda o, c: fr.merge_inner("k", _by_cust(o), _cust(c)), "SELECT a.n AS n1, least, b.n AS n2, seg, k FROM a JOIN b USING (k)", a=_BY_CUST, b=_CUST)
add("merge_inner3", "orders customer supplier", lambda o, c, s: fr.merge_inner("k", _by_cust(o), _cust(c), _supp(s)), "SELECT a.n AS n1, least, b.n AS n2, seg, c.n AS n3, name, k FROM a JOIN b USING (k) JOIN c USING (k)", **_THREE)
add("merge_outer2", "orders customer", lambda o, c: fr.merge_outer("k", _by_cust(o), _cust(c)), "SELECT coalesce(a.n, 0) AS n1, coalesce(least, 0) AS least, coalesce(b.n, 0) AS n2, seg, k FROM a FULL JOIN b USING (k)", a=_BY_CUST, b=_CUST)
add("merge_outer3", "orders customer supplier", lambda o, c, s: fr.merge_outer("k", _by_cust(o), _cust(c), _supp(s)),
    "SELECT coalesce(a.n, 0) AS n1, coalesce(least, 0) AS least, coalesce(b.n, 0) AS n2, seg, coalesce(c.n, 0) AS n3, name, k FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)", **_THREE)
add("column_bind", "nation", lambda d: (lambda r: fr.column_bind(r, r.withColumn("n_name", F.upper("n_name")), exclude=("n_regionkey",)))(fr.with_row(d, "n_nationkey")),
    "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _row, n_nationkey AS n_nationkey1, n_name AS n_name1, n_nationkey AS n_nationkey2, upper(n_name) AS n_name2 FROM nation")
add("row_bind", "customer supplier", lambda c, s: fr.row_bind(c.select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("v")), s.select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("v"))),
    "SELECT c_nationkey AS n, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
add("column_merge", "orders lineitem", lambda o, l: fr.column_merge(fr.with_row(o, "o_orderkey").select(F.col("o_custkey").alias("v"), "_row"), _line(l).select(F.col("l_partkey").alias("v"), "_row"), "v").select("v", "side", "_row"),
    "SELECT v, side, _row FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY side, _row) AS r FROM u) WHERE r = 1",
    t=_LINE, u="SELECT o_custkey AS v, 0 AS side, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row FROM orders UNION ALL SELECT l_partkey, 1, _row FROM t")
add("column_semi", "lineitem part", lambda l, p: fr.column_semi(l.select(F.col("l_partkey").alias("k"), "l_orderkey"), p.where("p_size > 40").select(F.col("p_partkey").alias("k")), "k"),
    "SELECT l_partkey AS k, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
