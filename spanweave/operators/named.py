"""Named queries that are computed once: in memory for a session, or as a table in a folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..sources import alignments, bed, bgzf, stores
from . import coverage, methylome


class Named:
    """A supplier of a frame with an id; its rows are kept after the first use."""

    def __init__(self, name: str, build: Callable[[], DataFrame]):
        self.name, self._build, self._held = name, build, None

    def get(self) -> DataFrame:
        if self._held is None:
            self._held = self._build().persist()
        return self._held

    def forget(self) -> None:
        if self._held is not None:
            self._held.unpersist()
            self._held = None


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def built_once(spark: SparkSession, path: str, build: Callable[[str], None]) -> str:
    """`path`, built if it isn't there yet: build(another path) and a move, so that half of it is
    never read; of two that build at once the first one moved counts."""
    place, fs = _place(spark, path)
    if not fs.exists(place):
        part = f"{path}.building-{uuid.uuid4().hex}"
        build(part)
        if not fs.rename(_place(spark, part)[0], place) and not fs.exists(place):
            raise OSError(f"can't move {part}")
    return path


def _key(settings: dict) -> str:
    return hashlib.sha1(repr(sorted(settings.items())).encode()).hexdigest()[:16]


def stored(spark: SparkSession, folder: str, name: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a name and its settings in a folder, built if it isn't there yet."""
    path = f"{folder.rstrip('/')}/{name}-{_key(settings)}"
    return spark.read.parquet(built_once(spark, path, lambda p: build().write.mode("overwrite").parquet(p)))


def digest(df: DataFrame) -> str:
    """A name for the rows of a frame whatever their order: their number and sums of two 64-bit
    hashes, added up by all tasks."""
    cols = [F.col(c) for c in df.columns]
    sums = [F.sum(F.xxhash64(*extra, *cols).cast("decimal(38,0)")) for extra in ([], [F.lit("again")])]
    return hashlib.sha1(repr(tuple(df.agg(F.count("*"), *sums).first())).encode()).hexdigest()[:16]


# ---- queries over files ------------------------------------------------------------------


class Reads:
    """Tags of a file of reads, kept in a folder by what the file holds and the settings.

    The store's name is made of a digest of the file's lines or blocks, so a file that has
    changed has another store, and a copied or renamed file the same one.
    """

    def __init__(self, spark: SparkSession, folder: str, path: str, genome: DataFrame, unique: bool = True, fragment: int | None = None):
        self.spark, self.folder, self.path, self.genome, self.unique, self.fragment = spark, folder.rstrip("/"), path, genome, unique, fragment
        self.format = alignments.reads_format(path)
        if self.format not in ("SAM", "BAM", "BED"):
            raise ValueError(f"can't read {path}")

    def _content(self) -> DataFrame:
        return bgzf.lines(self.spark, self.path).select("piece") if self.format == "BAM" else self.spark.read.text(self.path)

    def _ranges(self) -> DataFrame:
        if self.format == "BED":
            return bed.locations(bed.read(self.spark, self.path))
        return alignments.mapped((alignments.read_bam if self.format == "BAM" else alignments.read_sam)(self.spark, self.path))

    def _build(self, path: str) -> None:
        on = self._ranges().join(F.broadcast(self.genome.select("chrom")), "chrom", "left_semi")  # a row for each chromosome
        reads = staged(on.select("chrom", "strand", "start", "stop"), "reads")
        length = reads.agg(F.avg(F.col("stop") - F.col("start"))).first()[0] or 0.0
        tags = coverage.single_tags(reads, self.unique)
        size = self.fragment if self.fragment is not None else coverage.fragment_size(tags, self.genome, length).first()[0] if length else 0
        stores.write_store(tags, path, "tags", fragment=int(size), read_length=float(length))

    def store(self) -> str:
        """Where the tags are kept; built if no store has this content and these settings."""
        key = _key({"content": digest(self._content()), "unique": self.unique, "fragment": self.fragment, "genome": digest(self.genome.select("chrom", "length"))})
        return built_once(self.spark, f"{self.folder}/reads-{key}", self._build)

    def get(self) -> tuple[DataFrame, dict]:
        """(tags, {fragment, read_length}): of a file without reads no tags and sizes of 0."""
        return stores.read_store(self.spark, self.store(), "tags")

    def coverage(self, regions: DataFrame, both_strands: bool = True) -> DataFrame:
        """Regions with the tags in them, moved by half a fragment."""
        tags, about = self.get()
        return coverage.counts(regions, tags, about["fragment"], both_strands)


class Methylome:
    """Calls of a file of treated reads against a reference in chunks (id, at, seq), kept like Reads."""

    def __init__(self, spark: SparkSession, folder: str, path: str, chunks: DataFrame, min_quality: int = 20):
        self.spark, self.folder, self.path, self.chunks, self.min_quality = spark, folder.rstrip("/"), path, chunks, min_quality
        self.format = alignments.reads_format(path)
        if self.format not in ("SAM", "BAM"):
            raise ValueError(f"can't read {path}")

    def _records(self) -> DataFrame:
        return (alignments.read_bam if self.format == "BAM" else alignments.read_sam)(self.spark, self.path)

    def _build(self, path: str) -> None:
        calls = methylome.bisulfite(alignments.aligned_bases(self._records()), self.chunks, self.min_quality)
        tag = F.when(F.col("context") == "CG", 0).when(F.col("context") == "CHG", 1).when(F.col("context") == "CHH", 2)
        kept = calls.where(F.col("context").isNotNull()).withColumn("tag", tag)
        calls = staged(methylome.build(kept, ignore_duplicates=False), "calls")  # read for the ranges and for the rows
        stores.write_store(calls, path, "methylome", min_quality=self.min_quality)

    def get(self) -> DataFrame:
        """(chrom, strand, pos, tag, k, n); tags are 0, 1, 2 for CG, CHG, CHH."""
        content = bgzf.lines(self.spark, self.path).select("piece") if self.format == "BAM" else self.spark.read.text(self.path)
        key = _key({"content": digest(content), "reference": digest(self.chunks.select("id", "at", "seq")), "min_quality": self.min_quality})
        return stores.read_store(self.spark, built_once(self.spark, f"{self.folder}/methylome-{key}", self._build), "methylome")[0]
