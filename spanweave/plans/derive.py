"""Relations of the library's model, derived from the driver's tables by plain expressions.

The same expressions serve Spark and the SQL that checks it; `{div}` is integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHROM_LENGTH = 1_001_000
#: name -> (source, columns); a source is a table or another relation here.
RELATIONS: dict[str, tuple[str, dict[str, str]]] = {
    "genome": ("region", {"chrom": "concat('chr', r_regionkey + 1)", "length": f"cast({CHROM_LENGTH} as bigint)"}),
    "loci": (
        "lineitem",
        {
            "id": "l_orderkey * 8 + l_linenumber", "chrom": "concat('chr', l_suppkey % 5 + 1)", "strand": "case when l_returnflag = 'N' then '+' else '-' end",
            "start": "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000000", "stop": "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000000 + cast(l_quantity as bigint)",
            "score": "cast(l_quantity as bigint)",
        },
    ),
    "regions": (
        "orders",
        {
            "id": "o_orderkey", "chrom": "concat('chr', o_custkey % 5 + 1)", "strand": "case when o_orderkey % 2 = 0 then '+' else '-' end",
            "start": "(o_orderkey * 6007 + o_custkey * 193) % 1000000", "stop": "(o_orderkey * 6007 + o_custkey * 193) % 1000000 + 100 + o_orderkey % 400", "name": "o_orderpriority",
        },
    ),
    "reads": (
        "events",
        {
            "id": "event_id", "chrom": "concat('chr', user_id % 5 + 1)", "strand": "case when event_id % 2 = 0 then '+' else '-' end",
            "start": "(event_id * 97) % 100000", "stop": "(event_id * 97) % 100000 + 50", "mate": "(event_id * 97) % 100000 + user_id * 5 % 700 - 100",
        },
    ),
    "transcripts": (
        "part",
        {
            "tid": "p_partkey", "gid": "p_brand", "symbol": "p_name", "coding": "p_size % 5 <> 0", "exons": "cast(1 + p_size % 8 as bigint)", "chrom": "concat('chr', p_partkey % 5 + 1)",
            "strand": "case when p_size % 2 = 0 then '+' else '-' end", "start": "(p_partkey * 4801) % 900000", "stop": "(p_partkey * 4801) % 900000 + 200 + cast(floor(p_retailprice) as bigint)",
        },
    ),
    "methyl": (
        "lineitem",
        {
            "chrom": "concat('chr', l_suppkey % 5 + 1)", "strand": "case when l_orderkey % 2 = 0 then '+' else '-' end", "pos": "(l_partkey * 97 + l_orderkey * 13) % 200000",
            "tag": "l_linenumber % 4", "k": "cast(floor(l_quantity * l_discount * 10) as bigint)", "n": "cast(l_quantity as bigint)", "arrival": "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey",
        },
    ),
    "sequences": ("documents", {"id": "doc_id", "seq": "{acgt}"}),
    "pvalues": ("orders", {"id": "o_orderkey", "p": "power((cast(floor(o_totalprice) as bigint) * 7919 % 100000 + 1) / cast(100001.0 as double), 3)"}),
    "tables2x2": ("orders", {"id": "o_orderkey", "a": "o_orderkey % 7 + 1", "b": "o_custkey % 11", "c": "o_custkey % 13", "d": "o_orderkey % 17 + 3"}),
}

_ACGT = {"spark": "regexp_replace(lower(text), '[^acgt]', '')", "duck": "regexp_replace(lower(text), '[^acgt]', '', 'g')"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation or a table of the input folder."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = RELATIONS[name]
    return relation(spark, sf_dir, source).select(*[F.expr(e.format(div="div", acgt=_ACGT["spark"])).alias(c) for c, e in columns.items()])


def sql(query: str, **ctes: str) -> str:
    """The checking SQL: the relations that the query names, then further steps, then the query."""
    parts = []
    text = " ".join([query, *ctes.values()])
    for name, (source, columns) in RELATIONS.items():
        if name in text:
            cols = ", ".join(f"{e.format(div='//', acgt=_ACGT['duck'])} AS {c}" for c, e in columns.items())
            parts.append(f"{name} AS (SELECT {cols} FROM {source})")
    parts += [f"{k} AS ({v})" for k, v in ctes.items()]
    return f"WITH {', '.join(parts)} {query}" if parts else query
