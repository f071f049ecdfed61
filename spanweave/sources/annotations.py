"""Genome annotation: sizes, GTF, repeat and band tables, ontologies, track configurations."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of downloaded tables.
TABLES = {
    "rmsk": "bin int, sw_score int, mismatches int, deletions int, insertions int, chrom string, start long, stop long, genomic_left long, strand string, name string, class string, family string, repeat_start int, repeat_end int, repeat_left int, id string",
    "cytoband": "chrom string, start long, stop long, name string, stain string",
    "gap": "bin int, chrom string, start long, stop long, ix int, n string, size long, type string, bridge string",
    "cpg_islands": "bin int, chrom string, start long, stop long, name string, length int, cpg_num int, gc_num int, per_cpg double, per_gc double, obs_exp double",
    "cpg_islands_legacy": "chrom string, start long, stop long, name string, length int, cpg_num int, gc_num int, per_cpg double, per_gc double, obs_exp double",
    "sizes": "chrom string, length long",
    "descriptions": "name string, description string",
}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A tab-separated table of a known kind; records that don't parse are an error."""
    return spark.read.schema(TABLES[kind]).option("sep", "\t").option("comment", "#").option("mode", "FAILFAST").csv(path)


def read_repeats_spaced(spark: SparkSession, path: str) -> DataFrame:
    """Repeats in the white-space format of the masking program; C is minus."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d"))
    kind = F.split(c[10], "/")
    return rows.select(c[4].alias("chrom"), (c[5].cast("long") - 1).alias("start"), c[6].cast("long").alias("stop"), F.when(c[8] == "C", "-").otherwise("+").alias("strand"), c[9].alias("name"), F.lower(kind[0]).alias("class"), F.lower(F.coalesce(F.try_element_at(kind, F.lit(2)), kind[0])).alias("family"))


def renamed(df: DataFrame, aliases: DataFrame, column: str = "chrom") -> DataFrame:
    """Chromosomes by their names in `aliases` (alias, chrom); unknown ones are dropped."""
    names = aliases.withColumnsRenamed({"chrom": "__chrom", "alias": "__alias"})
    held = df.join(F.broadcast(names), F.lower(column) == F.col("__alias"))  # a few names for each chromosome
    return held.withColumn(column, F.col("__chrom")).drop("__chrom", "__alias")


def centromeres(gaps: DataFrame) -> DataFrame:
    """The hull of the gaps that are called centromere, by chromosome."""
    return gaps.where(F.lower("type") == "centromere").groupBy("chrom").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts: ids, symbol, place, exons (sorted array), cds hull and start of the 3' region.

    The coding part is the hull of CDS records from the start codon on; the 3' region starts
    with the first exon base after the stop codon along the strand.
    """
    names = ["chrom", "source", "feature", "first", "last", "score", "strand", "frame", "attributes"]
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')").select(*[c[i].alias(n) for i, n in enumerate(names)])
    rows = rows.where(F.col("feature").isin("transcript", "exon", "CDS", "stop_codon", "three_prime_utr")).select(
        "chrom", "feature", "strand", (F.col("first").cast("long") - 1).alias("start"), F.col("last").cast("long").alias("stop"),
        attribute("transcript_id").alias("tid"), attribute("gene_id").alias("gid"), attribute("gene_name").alias("symbol"),
    )
    of = lambda f, v: F.when(F.col("feature") == f, v)
    span = F.struct("start", "stop")
    g = rows.where("tid IS NOT NULL").groupBy("tid", "chrom", "strand").agg(
        F.first("gid", True).alias("gid"), F.first("symbol", True).alias("symbol"),
        F.coalesce(F.min(of("transcript", F.col("start"))), F.min(of("exon", F.col("start")))).alias("start"), F.coalesce(F.max(of("transcript", F.col("stop"))), F.max(of("exon", F.col("stop")))).alias("stop"),
        F.array_sort(F.collect_set(of("exon", span))).alias("exons"), F.min(of("CDS", F.col("start"))).alias("c0"), F.max(of("CDS", F.col("stop"))).alias("c1"),
        F.min(of("stop_codon", F.col("start"))).alias("s0"), F.max(of("stop_codon", F.col("stop"))).alias("s1"),
    )
    plus = F.col("strand") == "+"
    after = F.filter(F.transform("exons", lambda e: F.greatest(e["start"], F.col("s1"))), lambda x: F.exists("exons", lambda e: (e["start"] <= x) & (x < e["stop"])))
    before = F.filter(F.transform("exons", lambda e: F.least(e["stop"], F.col("s0")) - 1), lambda x: F.exists("exons", lambda e: (e["start"] <= x) & (x < e["stop"])))
    utr3 = F.when(plus, F.array_min(after)).otherwise(F.array_max(before))
    cds = F.when(F.col("c0").isNotNull(), F.struct(F.col("c0").alias("start"), F.col("c1").alias("stop")))
    return g.select("tid", "gid", "symbol", "chrom", "strand", "start", "stop", "exons", cds.alias("cds"), F.when(F.col("s0").isNotNull(), utr3).alias("utr3"))


def gtf_lines(t: DataFrame) -> DataFrame:
    """Transcripts as GTF text: transcript, exon and CDS records."""
    attrs = F.format_string('gene_id "%s"; transcript_id "%s"; gene_name "%s";', F.col("gid").cast("string"), F.col("tid").cast("string"), F.coalesce("symbol", F.lit("")))
    whole = F.array(F.struct(F.lit("transcript").alias("f"), F.col("start").alias("a"), F.col("stop").alias("z")))
    ex = F.transform("exons", lambda e: F.struct(F.lit("exon").alias("f"), e["start"].alias("a"), e["stop"].alias("z")))
    coding = F.when(F.col("cds").isNotNull(), F.filter(F.transform("exons", lambda e: F.struct(F.lit("CDS").alias("f"), F.greatest(e["start"], F.col("cds.start")).alias("a"), F.least(e["stop"], F.col("cds.stop")).alias("z"))), lambda x: x["a"] < x["z"])).otherwise(F.filter(ex, lambda x: F.lit(False)))
    rows = t.select("chrom", "strand", attrs.alias("attrs"), F.explode(F.concat(whole, ex, coding)).alias("r"))
    return rows.select(F.concat_ws("\t", "chrom", F.lit("spanweave"), "r.f", (F.col("r.a") + 1).cast("string"), F.col("r.z").cast("string"), F.lit("."), "strand", F.lit("."), "attrs").alias("value"))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(term, name, namespace, obsolete) of the terms and (child, parent) of those that aren't
    obsolete."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value").startswith("[Term]"))
    tag = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1)), F.lit(""))
    parents = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), 1), lambda x: x)
    terms = blocks.select(tag("id").alias("term"), tag("name").alias("name"), tag("namespace").alias("namespace"), F.coalesce(tag("is_obsolete") == "true", F.lit(False)).alias("obsolete"), parents.alias("parents"))
    return terms.drop("parents"), terms.where("NOT obsolete").select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def read_gaf(spark: SparkSession, path: str, aspect: str | None = None) -> DataFrame:
    """(term, symbol) of gene associations, a row for each symbol and synonym."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND NOT startswith(value, '!')").select(c[4].alias("term"), c[8].alias("aspect"), F.concat(F.array(c[2]), F.split(c[10], r"\|")).alias("symbols"))
    rows = rows.where(F.col("aspect") == aspect) if aspect else rows
    return rows.select("term", F.explode(F.array_distinct("symbols")).alias("symbol")).where("symbol <> ''")


def read_tracks(text: str) -> Iterator[tuple[str, str, str, str, dict]]:
    """(data type, condition, replicate, path, attributes) of a YAML track configuration."""
    import yaml

    config = yaml.safe_load(text)
    for kind, conditions in (config.get("tracks") or {}).items():
        for condition, replicates in conditions.items():
            items = replicates.items() if isinstance(replicates, dict) else ((f"rep{i}", r) for i, r in enumerate(replicates, 1))
            for name, r in items:
                attributes = dict(r) if isinstance(r, dict) else {"path": r}
                yield str(kind), str(condition), str(name), str(attributes.pop("path", "")), {str(k): str(v) for k, v in attributes.items()}


def tracks(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(read_tracks(text)), "data_type string, cell string, replicate string, path string, meta map<string,string>")


def is_input(name: Column) -> Column:
    """Whether a target is a control."""
    return F.lower(name).rlike("input|control")


# ---- annotation sources of genome builds -------------------------------------------------

#: Version of the builds' configuration that is read and written.
CONFIG = 7
#: Keys of a build in such a file, those that each build has first.
BUILD_KEYS = ("species", "gtf", "sequence", "chromsizes", "ucsc_alias", "aliases", "description", "repeats", "cytobands", "gaps", "centromeres", "cgis")


def builds(spark: SparkSession, text: str) -> DataFrame:
    """(build, key, value) of a YAML configuration of genome builds, other names of chromosomes as
    keys `chrom:<name>`.  Another version, or a build without one of the first keys, is an error."""
    import yaml

    held = yaml.safe_load(text) or {}
    if held.get("version") != CONFIG:
        raise ValueError(f"a configuration of version {held.get('version')}, not {CONFIG}")
    rows = []
    for build, keys in (held.get("genomes") or {}).items():
        if missing := [k for k in BUILD_KEYS[:4] if not keys.get(k)]:
            raise ValueError(f"{build} has no {missing}")
        for k in BUILD_KEYS:
            v = keys.get(k)
            rows += [(build, k, str(x)) for x in (v if isinstance(v, list) else [v]) if x is not None]
        names = keys.get("chr_alt_name_to_canonical") or []
        rows += [(build, f"chrom:{a}", str(c)) for one in (names if isinstance(names, list) else [names]) for a, c in one.items()]
    return spark.createDataFrame(rows, "build string, key string, value string")


def builds_text(rows: DataFrame) -> str:
    """The configuration of such rows; there are a few for each build."""
    import yaml

    out: dict = {}
    for build, key, value in sorted(map(tuple, rows.select("build", "key", "value").collect())):
        own = out.setdefault(build, {})
        if key.startswith("chrom:"):
            own.setdefault("chr_alt_name_to_canonical", []).append({key.removeprefix("chrom:"): value})
        else:
            own[key] = [*(own[key] if isinstance(own[key], list) else [own[key]]), value] if key in own else value
    return yaml.safe_dump({"version": CONFIG, "genomes": out})


def read_builds(spark: SparkSession, path: str, default: str) -> DataFrame:
    """builds() of a file; an outdated one is kept beside it under its version, and the default's
    text takes its place, as it does where there is no file."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        try:
            return builds(spark, text)
        except ValueError:
            import yaml

            version = (yaml.safe_load(text) or {}).get("version")
            if version == CONFIG:
                raise
            fs.rename(place, place.suffix(f".version-{version}"))
    spark.createDataFrame([(default,)], "value string").coalesce(1).write.text(path)
    return builds(spark, default)
