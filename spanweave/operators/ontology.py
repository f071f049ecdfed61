"""Ontologies as edge tables, and clustering of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def associations(terms: DataFrame, annotations: DataFrame) -> DataFrame:
    """(term, symbols): the different upper-case symbols of each term that isn't obsolete."""
    live = terms.where("NOT obsolete").select("term")
    return annotations.join(live, "term", "left_semi").groupBy("term").agg(F.sort_array(F.collect_set(F.upper("symbol"))).alias("symbols"))


def depths(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, depth): the longest way from a root, over edges (child, parent) without cycles.

    One plan: a recursive query whose step moves a level down and keeps each node once.  A cycle
    would never end and is an error of Spark beyond `most` levels; rows aren't limited.
    """
    query = """
    WITH RECURSIVE level(node, depth) MAX RECURSION LEVEL {most} AS (
        SELECT DISTINCT parent, 0L FROM {{edges}} WHERE parent IS NOT NULL AND parent NOT IN (SELECT child FROM {{edges}} WHERE child IS NOT NULL)
        UNION ALL
        SELECT DISTINCT e.child, l.depth + 1 FROM level l JOIN {{edges}} e ON e.parent = l.node
    )
    SELECT node, max(depth) AS depth FROM (SELECT * FROM level LIMIT ALL) GROUP BY node
    """
    return edges.sparkSession.sql(query.format(most=int(most)), edges=edges)


def kmeans(df: DataFrame, columns: list[str], clusters: int, seed: int = 1, trials: int = 1) -> DataFrame:
    """Rows with `cluster`; rows with a null or NaN are left out.  Of several trials the one with
    the least cost counts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    rows = df
    for c in ok:
        rows = rows.where(c)
    rows = VectorAssembler(inputCols=columns, outputCol="__v").transform(rows)
    models = [KMeans(k=clusters, seed=seed + t, featuresCol="__v", predictionCol="cluster").fit(rows) for t in range(trials)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).drop("__v")


def summarize(clustered: DataFrame, column: str) -> DataFrame:
    """Size, mean and deviation of clusters, sorted by mean plus standard error."""
    s = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("stdev"))
    return s.orderBy(F.col("mean") + F.col("stdev") / F.sqrt("n"))
