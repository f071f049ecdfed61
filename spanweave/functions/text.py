"""Text forms of places, numbers and ids, as column expressions and for the driver."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_number(value: Column, universal: bool = False) -> Column:
    """Digits in groups of three, by commas, or by blanks which no reader takes for a point."""
    text = F.format_number(value, 0)
    return F.replace(text, F.lit(","), F.lit(" ")) if universal else text


def percent_of(part: Column, total: Column, digits: int = 2) -> Column:
    """100 * part / total; null where the total is 0."""
    return F.round(F.try_divide(part * F.lit(100.0), total), digits)


def percent_text(part: Column, total: Column, digits: int = 2) -> Column:
    value = percent_of(part, total, digits)
    return F.concat(value.cast("int").cast("string"), F.lit("%")) if digits == 0 else F.format_string(f"%.{digits}f%%", value)


def location_text(chrom: Column, strand: Column, start: Column, stop: Column) -> Column:
    return F.concat(chrom, F.lit(":"), strand, F.lit("["), start.cast("string"), F.lit(", "), stop.cast("string"), F.lit(")"))


def parse_location(text: Column) -> Column:
    """struct(chrom, strand, start, stop) of `chr:strand[start, stop)`; null if it isn't one."""
    part = lambda i: F.regexp_extract(text, r"^([^:]+):([+\-.])\[(\d+), (\d+)\)$", i)
    strand = F.when(part(2) == "-", "-").otherwise("+")
    parsed = F.struct(part(1).alias("chrom"), strand.alias("strand"), part(3).try_cast("long").alias("start"), part(4).try_cast("long").alias("stop"))
    return F.when(part(1) != "", parsed)


def parse_place(text: str, lengths: dict[str, int]) -> tuple[str, int, int]:
    """(chrom, start, stop) of `chrom:start-stop`, whatever white space and digit separators."""
    m = re.fullmatch(r"([^:]+):(\d+)-(\d+)", re.sub(r"[\s.,]", "", text))
    if not m:
        raise ValueError(f"a place is chromosome:start-stop, not {text!r}")
    chrom, start, stop = m[1], int(m[2]), int(m[3])
    if chrom not in lengths:
        raise ValueError(f"unknown chromosome {chrom!r}")
    if not (start < lengths[chrom] and stop < lengths[chrom]):
        raise ValueError(f"{text!r} is outside of {chrom}, which has {lengths[chrom]} positions")
    return chrom, start, stop


def parse_genome_id(text: str) -> tuple[str, list[str]]:
    """(build, chromosomes) of `build` or `build[chr1,chr2]`; no chromosomes mean all."""
    build, bracket, rest = text.partition("[")
    names = [n for n in rest.replace("]", "").split(",") if n.strip()]
    if bracket and not names:
        raise ValueError("an empty restriction isn't allowed")
    return build, names


def short_id(names: list[str], most: int = 100, mark: str = "#") -> str:
    """A file-safe id of names: their stems without repeats, cut and ended by a digest if long."""
    digest = hashlib.sha1("_".join(names).encode()).hexdigest()
    if most <= len(digest):
        raise ValueError("too short")

    def safe(name: str) -> str:
        stem = name.rsplit("/", 1)[-1].split(mark, 1)[0]
        return re.sub(r"_{2,}", "_", re.sub(r"[^A-Za-z0-9_]+", "_", stem)).strip("_")

    def joined(ids: list[str]) -> str:
        return "_".join(dict.fromkeys(ids))

    ids = [safe(n) for n in names]
    if len(whole := joined(ids)) <= most:
        return whole
    accessions = [m[0] if (m := re.search(r"GSM\d+", i)) else i for i in ids]
    whole = joined(accessions)
    return whole if len(whole) <= most and accessions != ids else whole[: most - len(digest)] + digest


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last point of the file name; empty if there is none."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def stem(path: Column, packed: bool = False) -> Column:
    """The file name without its extension; with `packed` without one before .gz too."""
    name = file_name(path)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(name.rlike(r"^(?i).*\.[a-z0-9_]+\.gz$"), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(bare) if packed else bare


def path_safe(value: Column) -> Column:
    """Lower-case letters, digits, points and single underscores, none at an end or before a point."""
    for pattern, new in ((r"[^a-zA-Z0-9_.]", "_"), ("_{2,}", "_"), ("^_|_$", ""), (r"_\.", ".")):
        value = F.regexp_replace(value, pattern, new)
    return F.lower(value)


def short_digest(value: Column) -> Column:
    """A hash sign and the first five hexadecimal digits of the SHA-1."""
    return F.concat(F.lit("#"), F.substring(F.sha1(value.cast("binary")), 1, 5))
