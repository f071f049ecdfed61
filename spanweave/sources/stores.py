"""Stored results: tables in order of place with a version, model files, matrices in CSV."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.emissions import SCHEMES, Emissions
from ..functions.hmm import Hmm, PoissonHmm
from ..functions.mixture import Blend, Mixture, Normal, Poisson

#: Kind of store -> (version, columns).
STORES = {
    "tags": (4, "chrom string, strand string, pos long"),
    "paired_tags": (3, "chrom string, strand string, pos long"),
    "methylome": (7, "chrom string, strand string, pos long, tag int, k long, n long"),
}
MODEL_VERSION = 1


# ---- tables by chromosome and strand ----------------------------------------------------


def write_store(df: DataFrame, path: str, kind: str, **about: float) -> None:
    """Write rows as Parquet in order of chromosome, strand and place.

    Rows are dealt by ranges of places, so a large chromosome is many tasks and files, and many
    small ones are few: a reference may have as many sequences as it likes.  What files hold shows
    in their statistics, so a query of some chromosomes skips the others.  `about` (fragment size,
    read length) is kept beside them with the kind and its version.
    """
    version, schema = STORES[kind]
    kinds = [c.split() for c in schema.split(", ")]
    dealt = df.select(*[F.col(n).cast(k).alias(n) for n, k in kinds]).repartitionByRange("chrom", "strand", "pos").sortWithinPartitions("chrom", "strand", "pos")
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    _write_text(df.sparkSession, json.dumps({"kind": kind, "version": version, "about": about}), f"{path}/about")


def read_store(spark: SparkSession, path: str, kind: str, chroms: list[str] | None = None, strict: bool = True) -> tuple[DataFrame, dict]:
    """The rows and what is kept about them; another kind or version is an error.

    Of `chroms`, those without rows are an error, or left out if not strict.  A store that has
    a folder for each chromosome and strand, as former ones have, is read too.
    """
    version, schema = STORES[kind]
    held = json.loads(_read_text(spark, f"{path}/about"))
    if (held["kind"], held["version"]) != (kind, version):
        raise ValueError(f"{path} holds {held['kind']} of version {held['version']}, not {kind} of version {version}")
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if chroms is not None:
        rows = rows.where(F.col("chrom").isin(chroms))
        missing = set(chroms) - {r[0] for r in rows.select("chrom").distinct().collect()} if strict else ()
        if missing:
            raise ValueError(f"{path} has no {sorted(missing)}")
    return rows, held["about"]


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


# ---- models -----------------------------------------------------------------------------


def _emissions_body(e: Emissions) -> dict:
    return {"schemes": [{"class": type(p).__name__, **asdict(p)} for p in e.schemes], "of": e.of}


def _emissions_of(body: dict) -> Emissions:
    return Emissions(tuple(SCHEMES[p["class"]](**{k: v for k, v in p.items() if k != "class"}) for p in body["schemes"]), tuple(map(tuple, body["of"])))


def model_text(model: Mixture | PoissonHmm | Blend | Hmm) -> str:
    """A model as JSON with its class and version."""
    if isinstance(model, Blend):
        body = {"weights": list(model.weights), "emissions": _emissions_body(model.emissions)}
    elif isinstance(model, Hmm):
        body = {"prior": np.asarray(model.prior).tolist(), "transition": np.asarray(model.transition).tolist(), "emissions": _emissions_body(model.emissions)}
    elif isinstance(model, Mixture):
        body = {"weights": list(model.weights), "parts": [{"class": type(p).__name__, **asdict(p)} for p in model.parts]}
    else:
        body = {k: np.asarray(v).tolist() for k, v in asdict(model).items()}
    return json.dumps({"class": type(model).__name__, "version": MODEL_VERSION, "model": body})


def model_of(text: str) -> Mixture | PoissonHmm | Blend | Hmm:
    """The model of a JSON text; an unknown class or another version is an error."""
    held = json.loads(text)
    if held.get("version") != MODEL_VERSION:
        raise ValueError(f"a model of version {held.get('version')}, not {MODEL_VERSION}")
    body, kinds = held["model"], {"Poisson": Poisson, "Normal": Normal}
    if held.get("class") == "Mixture":
        parts = tuple(kinds[p["class"]](**{k: v for k, v in p.items() if k != "class"}) for p in body["parts"])
        return Mixture(tuple(body["weights"]), parts)
    if held.get("class") == "PoissonHmm":
        return PoissonHmm(*(np.array(body[k]) for k in ("prior", "transition", "rates")), tuple(body["emission_of"]))
    if held.get("class") == "Blend":
        return Blend(tuple(body["weights"]), _emissions_of(body["emissions"]))
    if held.get("class") == "Hmm":
        return Hmm(np.array(body["prior"]), np.array(body["transition"]), _emissions_of(body["emissions"]))
    raise ValueError(f"unknown model {held.get('class')}")


def save_model(spark: SparkSession, model: Mixture | PoissonHmm | Blend | Hmm, path: str) -> None:
    _write_text(spark, model_text(model), path)


def load_model(spark: SparkSession, path: str) -> Mixture | PoissonHmm | Blend | Hmm:
    return model_of(_read_text(spark, path))


# ---- metric matrices --------------------------------------------------------------------


def write_matrix(values: DataFrame, a_counts: DataFrame, b_counts: DataFrame, path: str) -> None:
    """A CSV of (a, b, value) rows: a line for each set a, a column for each set b, and how many
    merged ranges each of them has.  Sizes are numbers of sets, so one task writes it."""
    a, b = values.columns[:2]
    names = sorted(r[0] for r in values.select(F.col(b).cast("string")).distinct().collect())  # columns of the file
    counts = {str(r[0]): r[1] for r in b_counts.select(b, "merged").collect()}
    wide = values.groupBy(F.col(a).cast("string").alias(a)).pivot(b, names).agg(F.first("value"))
    cells = [F.col(f"`{n}`").cast("string").alias(n) for n in names]
    body = wide.join(a_counts.select(F.col(a).cast("string").alias(a), "merged"), a).select(F.lit(1).alias("__k"), F.col(a).alias("a_names"), F.col("merged").cast("string").alias("a_merged_loci_count"), *cells)
    first = values.sparkSession.range(1).select(F.lit(0).alias("__k"), F.lit("b_merged_loci_count").alias("a_names"), F.lit(".").alias("a_merged_loci_count"), *[F.lit(str(counts.get(n, 0))).alias(n) for n in names])
    lines = first.unionAll(body).repartition(1).sortWithinPartitions("__k", "a_names").drop("__k")
    lines.write.mode("overwrite").csv(path, header=True)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a_name, b_name, value, a_merged, b_merged) of such a file."""
    lines = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    first = F.col("a_names") == "b_merged_loci_count"
    names = lines.columns[2:]
    long = lines.unpivot(["a_names", "a_merged_loci_count"], names, "b_name", "value")
    counts = long.where(first).select("b_name", F.col("value").cast("long").alias("b_merged"))
    rows = long.where(~first).select(F.col("a_names").alias("a_name"), "b_name", F.col("value").cast("double").alias("value"), F.col("a_merged_loci_count").cast("long").alias("a_merged"))
    return rows.join(counts, "b_name").select("a_name", "b_name", "value", "a_merged", "b_merged")
